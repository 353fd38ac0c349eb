from unittest.mock import MagicMock

import pytest

from lodestar.operators.settled import shared_folder


def session(named, local):
    spark = MagicMock()
    spark.sparkContext.getConf().get.return_value = named
    spark.sparkContext._jsc.sc().isLocal.return_value = local
    return spark


def test_the_named_folder_is_taken_everywhere():
    assert shared_folder(session("hdfs://shared/ckpt", False)) == "hdfs://shared/ckpt"
    assert shared_folder(session("/shared/ckpt", True)) == "/shared/ckpt"


def test_a_cluster_has_to_name_its_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session(None, False))


def test_one_machine_makes_its_own():
    assert "lodestar-" in shared_folder(session(None, True))


def test_the_session_knows_whether_it_is_local(spark):
    assert spark.sparkContext._jsc.sc().isLocal() is True
    assert shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
