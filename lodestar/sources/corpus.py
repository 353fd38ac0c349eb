"""Search collections built from the supplied tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COMMITTED, UNCOMMITTED, UNKNOWN_LANGUAGE


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_path() -> Column:
    return F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/doc_"), "doc_id", F.lit(".txt"))


def _item_path() -> Column:
    return F.concat(F.lit("untracked/item_"), "item_id", F.lit(".txt"))


def committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.select(_doc_path().alias("path"), F.lit(COMMITTED).alias("repo"), F.lit(False).alias("is_overlay"), "lang", F.col("text").alias("content"))


def uncommitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document edited, and the benchmark's items as files that are not tracked."""
    docs = _read(spark, sf_dir, "documents").where("doc_id % 10 = 3")
    edited = docs.select(_doc_path().alias("path"), F.lit(UNCOMMITTED).alias("repo"), F.lit(True).alias("is_overlay"), "lang", F.replace("text", F.lit("the"), F.lit("THEX")).alias("content"))
    items = _read(spark, sf_dir, "benchmark")
    new = items.select(_item_path().alias("path"), F.lit(UNCOMMITTED).alias("repo"), F.lit(True).alias("is_overlay"), F.lit(UNKNOWN_LANGUAGE).alias("lang"), F.col("text").alias("content"))
    return edited.union(new)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return committed(spark, sf_dir).union(uncommitted(spark, sf_dir))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths edited, not tracked, or deleted (every fiftieth document)."""
    docs = _read(spark, sf_dir, "documents").where("doc_id % 10 = 3 or doc_id % 50 = 7")
    return docs.select(_doc_path().alias("path")).union(_read(spark, sf_dir, "benchmark").select(_item_path().alias("path")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages")
    return rows.select(F.col("url").alias("path"), F.lit(COMMITTED).alias("repo"), F.lit(False).alias("is_overlay"), F.lit("html").alias("lang"), F.col("html").alias("content"))
