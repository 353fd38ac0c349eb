"""The corpus pipeline: documents in, token ids of a deduplicated, cleaned and mixed corpus out.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; its rows
are written as Parquet and read again before the next stage.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import mix, pieces, pii, quality, simhash
from lodestar.llm.common import table
from lodestar.operators.settled import shared_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) keep the document with the smallest id."""
    return simhash.keep_one(docs)


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal numbers, dates and addresses by pseudonyms, under the session's key."""
    return pii.pseudonymise(docs, pii.key_of(spark))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take sources to their target weights: half of all tokens, no document twice."""
    return mix.mix(docs, share=(1, 2), epochs=1)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return pieces.tokenised(docs, pieces.load(), ["doc_id", "lang", "source"])


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", near_deduplicated),
    ("PII", pseudonymised),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding", tokenised),
]

#: The classifier and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``.

    The rows between stages are written to the folder that ``spark.checkpoint.dir`` names, and
    dropped once the next stage is written; if a stage fails, all of them are.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")

    def drop(path: str) -> None:
        before = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(before, True)

    try:
        for i, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                drop(f"{folder}/{i - 1}")
    except BaseException:
        drop(folder)
        raise
    return docs
