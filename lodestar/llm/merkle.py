"""Merkle-tree fingerprints of documents, in DataFrame functions only.

The tree's levels are the text, its sections (cut behind blank lines), their paragraphs (cut
behind line ends) and, as leaves, runs of up to eight words.  Every cut keeps all characters, so
equal roots mean equal texts.  A node's hash is the SHA-256 of its children's hashes; comparing
two trees from the root down finds the branches that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION = r"(?<=\n\n)(?!\n)"
PARAGRAPH = r"(?<=\n)"
LEAF = r"(?:\S{1,64}\s*){1,8}|\s+"
LEAST = -(1 << 63)
#: Ranges of ids, by default as many as shuffle partitions are set, but no more than this.
MOST_BUCKETS = 1 << 16


def _hash_all(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def _leaf_hashes(paragraph: Column) -> Column:
    return F.transform(F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x.cast("binary"), 256))


def tree(text: Column) -> Column:
    """Sections as structs of their hash and paragraphs, those as structs of hash and leaf hashes."""

    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.array(_leaf_hashes(p)), lambda x: F.struct(_hash_all(x).alias("hash"), x.alias("leaves")))
        return leaves[0]

    def section(s: Column) -> Column:
        inner = F.transform(F.split(s, PARAGRAPH), paragraph)
        return F.transform(
            F.array(inner),
            lambda x: F.struct(_hash_all(F.transform(x, lambda y: y["hash"])).alias("hash"), x.alias("paragraphs")),
        )[0]

    return F.transform(F.split(text, SECTION), section)


def root(sections: Column) -> Column:
    return _hash_all(F.transform(sections, lambda s: s["hash"]))


def paragraph_hashes(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.transform(s["paragraphs"], lambda p: p["hash"])))


def nodes(sections: Column) -> Column:
    """The distinct nodes below the root, each as 64 bits of hash."""
    leaves = F.flatten(F.flatten(F.transform(sections, lambda s: F.transform(s["paragraphs"], lambda p: p["leaves"]))))
    every = F.concat(F.transform(sections, lambda s: s["hash"]), paragraph_hashes(sections), leaves)
    return F.array_distinct(F.transform(every, lambda h: F.xxhash64(h)))


def likeness(root_a: Column, nodes_a: Column, root_b: Column, nodes_b: Column) -> Column:
    """Dice's coefficient over all nodes, the root included: 1 only if the roots are equal."""
    shared = F.size(F.array_intersect(nodes_a, nodes_b)) + (root_a == root_b).cast("int")
    return 2.0 * shared / (F.size(nodes_a) + F.size(nodes_b) + 2.0)


def fingerprinted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sections`` (the tree), ``root``, ``paragraphs`` and ``nodes``; null text is empty."""
    out = docs.withColumn("sections", tree(F.coalesce(F.col(text), F.lit(""))))
    return out.select(
        "*",
        root(F.col("sections")).alias("root"),
        paragraph_hashes(F.col("sections")).alias("paragraphs"),
        nodes(F.col("sections")).alias("nodes"),
    )


def first_difference(a: Column, b: Column) -> Column:
    """Place of the first paragraph that differs, from 1; 0 if none does."""
    return F.coalesce(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False), F.lit(0))


def _bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """``ord`` (the id, null first), ``tie`` (a hash of the text) and ``bucket``: ranges of both of
    nearly equal size, so many texts of one id, or without an id, are spread too.

    Spark's own range partitioning gives the bounds, one for each bucket; any bounds would give the
    same result.
    """
    docs = docs.withColumn("ord", F.coalesce(F.col("doc_id"), F.lit(LEAST))).withColumn("tie", F.xxhash64("text"))
    key = F.struct("ord", "tie")
    parts = docs.select("ord", "tie").repartitionByRange(buckets, "ord", "tie").groupBy(F.spark_partition_id()).agg(F.min(key).alias("low"))
    most = (1 << 63) - 1
    bounds = sorted((r.low.ord, r.low.tie) for r in parts.collect())[1:]
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))] or [1]
    bounds += [(most, most)] * (2 * steps[0] - len(bounds))
    # one text each in the plan, which the optimizer turns into an array before any row is read
    ids, ties = (F.split(F.lit(",".join(str(b[i]) for b in bounds)), ",").cast("array<long>") for i in range(2))
    # binary search: the number of bounds not above the row
    place = F.reduce(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, s: F.when(F.struct(F.element_at(ids, at + s).alias("ord"), F.element_at(ties, at + s).alias("tie")) <= key, at + s).otherwise(at),
    )
    return docs.withColumn("bucket", place)


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """``(doc_id, text, root, paragraphs, nodes)`` and ``next_...`` of the next row by descending doc_id.

    After the last row comes the first.  Rows of one id follow each other by a hash of their
    text; null ids come last.  The rows are dealt by ranges of id and hash, and each range gets a
    copy of the row that follows its smallest one, so one exchange is all that moves the texts and
    no task holds more than its range.
    """
    carried = ["text", "root", "paragraphs", "nodes"]
    rows = _bucketed(docs, max(2, buckets))
    highest = rows.groupBy("bucket").agg(F.max(F.struct("ord", "tie")).alias("top"))  # one row for each range
    whole = Window.orderBy("bucket")
    chain = highest.select(
        F.col("top.ord").alias("top"), F.col("top.tie").alias("top_tie"),
        F.coalesce(F.lead("bucket").over(whole), F.first("bucket").over(whole)).alias("to"),
    )
    ghosts = (
        rows.drop("bucket")
        .join(F.broadcast(chain.withColumnRenamed("to", "bucket")), (F.col("ord") == F.col("top")) & (F.col("tie") == F.col("top_tie")))
        .dropDuplicates(["bucket"])  # rows of one key are alike
        .select("doc_id", "text", "bucket", "ord", "tie", F.lit(True).alias("ghost"))
    )
    together = rows.select("doc_id", "text", "bucket", "ord", "tie", F.lit(False).alias("ghost")).union(ghosts)
    order = Window.partitionBy("bucket").orderBy(F.desc("ghost"), "ord", "tie")
    nexts = [F.lag(c).over(order).alias(f"next_{c}") for c in carried]
    return fingerprinted(together).select("doc_id", "ghost", *carried, *nexts).where("not ghost").drop("ghost")


def half_edited(text: Column, other: Column, n_chars: Column) -> Column:
    """The last half of ``text`` replaced by as many characters from the start of ``other``."""
    half = F.floor(n_chars / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars - half), F.substring(other, F.lit(1), half))


def fingerprint_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its half-edited text, and how alike they are.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    first_edit)``; ``first_edit`` is the first paragraph that the edit changed (0: none).  Null
    text counts as empty; a lone document is its own next; an empty table gives no rows; other
    columns are ignored; repeated rows each keep a row; very long texts are hashed whole.
    """
    buckets = buckets or min(MOST_BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = with_next(base, buckets)
    chars = placed.withColumn("n_chars", F.length("text").cast("long")).drop("next_paragraphs")
    edited = chars.withColumn("edited", half_edited(F.col("text"), F.col("next_text"), F.col("n_chars").cast("int")))
    slim = edited.drop("text", "next_text").withColumn("edited_sections", tree(F.col("edited")))
    done = slim.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "root", "nodes", "paragraphs", "next_root", "next_nodes",
        root(F.col("edited_sections")).alias("edited_root"), nodes(F.col("edited_sections")).alias("edited_nodes"),
        paragraph_hashes(F.col("edited_sections")).alias("edited_paragraphs"),
    )
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("root").alias("fingerprint"),
        F.col("edited_root").alias("edited_fingerprint"),
        likeness(F.col("root"), F.col("nodes"), F.col("edited_root"), F.col("edited_nodes")).alias("near_edited"),
        likeness(F.col("root"), F.col("nodes"), F.col("next_root"), F.col("next_nodes")).alias("near_next"),
        first_difference(F.col("paragraphs"), F.col("edited_paragraphs")).cast("int").alias("first_edit"),
    )
