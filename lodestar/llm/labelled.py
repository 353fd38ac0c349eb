"""Bounded samples of labelled documents, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LABEL_FOLDS, fold

#: The longest document that a sample takes, in characters (all are scored, whatever their length).
SAMPLE_CHARS = 20_000


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], max_chars: int = SAMPLE_CHARS
) -> list[tuple[str, int]]:
    """At most ``per_class[y]`` pairs (text, y) of each class, in a fixed order.

    Taken are documents of ``max_chars`` characters or fewer whose id is outside fold 0 of
    ``LABEL_FOLDS``, in the order of a hash of the id; the ids are chosen before any text comes to
    the driver, so ``per_class`` and ``max_chars`` bound what does.  An id with several labels counts
    with the largest, one with several texts with one of them; null ids, texts and labels are left
    out.
    """
    usable = labels.where((fold(F.col("doc_id"), LABEL_FOLDS) != 0) & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    short = docs.where(F.length("text") <= max_chars).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    usable = usable.join(short.select("doc_id"), "doc_id", "left_semi")
    parts = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in per_class.items()]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.union(p)
    rows = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()  # sum(per_class) rows at most
    return [(r.text, r.y) for r in sorted(rows, key=lambda r: r.doc_id)]
