"""Parsing the NUL-separated status records of a working tree."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import skip_fields

NO_HEAD = "no-head"
# Fixed numbers of the record format: fields before the path, by the record's first sign.
FIELDS = {"1": 8, "2": 9, "u": 10, "?": 1}


@dataclass
class RepoState:
    head_sha: str = NO_HEAD
    raw: str = ""
    files: list[str] = field(default_factory=list)


def parse_status(raw: str) -> RepoState:
    """State of one status output; records that make no sense are passed over."""
    state, seen, skip = RepoState(raw=raw), {}, False
    for record in raw.split("\0")[:-1]:  # what no NUL ends is incomplete
        if skip:
            skip = False
            continue
        if record.startswith("# branch.oid "):
            state.head_sha = record[len("# branch.oid ") :] or NO_HEAD
            continue
        if len(record) < 2 or record[0] not in FIELDS:
            continue
        skip = record[0] == "2"  # the old name follows as a record of its own
        parts = record.split(" ", FIELDS[record[0]])
        if len(parts) > FIELDS[record[0]] and parts[-1]:
            seen.setdefault(parts[-1], None)
    state.files = list(seen)
    return state


def parse_statuses(raws: DataFrame) -> DataFrame:
    """``(id, head_sha, files)`` for ``raws(id, raw)``: the same for many outputs at once."""
    records = raws.select("id", F.posexplode(F.split(F.coalesce("raw", F.lit("")), "\0", -1)).alias("pos", "record"))
    order = Window.partitionBy("id").orderBy("pos")
    last = Window.partitionBy("id")
    records = records.withColumn("__last", F.max("pos").over(last)).where("pos < __last").drop("__last")
    kind = F.substring("record", 1, 1)
    records = records.withColumn("kind", kind)
    # after a rename comes its old name, whatever that looks like: of a run of such records every other counts
    records = records.withColumn("two", F.col("kind") == "2")
    run = F.max(F.when(~F.col("two"), F.col("pos"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    length = F.col("pos") - 1 - F.coalesce(run, F.lit(-1))
    records = records.withColumn("swallowed", length % 2 == 1).where("not swallowed")
    head = F.max(F.when(F.col("record").startswith("# branch.oid "), F.nullif(F.expr("substring(record, 14)"), F.lit(""))))
    path = F.lit("")
    for sign, fields in FIELDS.items():
        path = F.when(F.col("kind") == sign, skip_fields(F.col("record"), fields)).otherwise(path)
    records = records.withColumn("path", F.when(F.length("record") >= 2, path).otherwise(""))
    heads = records.groupBy("id").agg(head.alias("head_sha"))
    files = records.where("path <> ''").groupBy("id", "path").agg(F.min("pos").alias("pos"))
    lists = files.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("files"))
    joined = raws.select("id").join(heads, "id", "left").join(lists, "id", "left")
    return joined.select("id", F.coalesce("head_sha", F.lit(NO_HEAD)).alias("head_sha"), F.coalesce("files", F.array().cast("array<string>")).alias("files"))
