"""Cutting a plan where its rows are read more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a session on one machine gets a temporary folder; a cluster, whose executors
    would not see that, gets an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="lodestar-")


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` worked out now and kept in the cluster's shared folder."""
    sc = rows.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint(eager=True)
