"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.settled import settled

#: Deterministic split of labelled rows into folds, by crc32 of the id as text.
LABEL_FOLDS = 5
LANG_FOLDS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null ids: fold 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def persist(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    return settled(df)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of frames that are gone, and of the driver's memory that is free.

    Spark drops the files when the driver's collector finds that nothing refers to them any more; a
    driver that makes little garbage may hold them for long, on every executor's disk.  Python's
    allocator keeps what has been freed unless it is told, where the C library can be told at all.
    """
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    spark.sparkContext._jvm.System.gc()


def text_bytes(df: DataFrame, *keep: str) -> DataFrame:
    """The columns named, and ``text`` as UTF-8 bytes (null: empty)."""
    return df.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
