import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("ckpt")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    rows = [
        (1, None, "en", "s0"), (2, "", None, "s0"), (3, "same words in this text here", "en", None),
        (3, "same words in this text here", "en", None), (4, "same words in this text here", "fr", "s1"),
        (None, "a text without an id", "en", "s1"), (5, "word " * 30000, "en", "s1"), (6, "\x0b \t\n", "de", "s2"),
        (7, "x" * 5000, "de", "s2"), (8, "é中\U0001f600 mixed ▁ text", "zz", "s2"),
    ]
    out = [(i, t, lang, s, len(t or ""), "extra", 1.5, "clash") for i, t, lang, s in rows]
    return spark.createDataFrame(out, DOCS + ", score string, fp double, root string")
