"""Rendering results as text: within a row, by array functions; one global width."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import right_align
from ..schema import UNKNOWN_LANGUAGE
from .search import displayed_tag
from .settled import settled


def line_width(results: DataFrame) -> DataFrame:
    """One row ``width``: digits of the largest line number shown, context included; 1 at least."""
    last = F.array_max(F.transform("line_matches", lambda m: m["line_number"] + F.size(m["after"])))
    top = F.coalesce(F.max(F.coalesce(last, F.lit(0))), F.lit(0))
    return results.agg(F.length(top.cast("string")).alias("width"))


def emitted(matches: Column) -> Column:
    """Lines to print: structs (n, hit, kind, line), each once, in order, matches before context."""

    def around(m: Column) -> Column:
        first = m["line_number"] - F.size(m["before"])
        none = F.lit(None).cast("string")
        context = lambda x, n: F.struct(n.cast("int").alias("n"), F.lit(1).alias("rank"), none.alias("kind"), x.alias("line"))
        return F.concat(
            F.transform(m["before"], lambda x, i: context(x, first + i)),
            F.array(F.struct(m["line_number"].alias("n"), F.lit(0).alias("rank"), m["symbol_kind"].alias("kind"), F.coalesce(m["line"], F.lit("")).alias("line"))),
            F.transform(m["after"], lambda x, i: context(x, m["line_number"] + i + 1)),
        )

    every = F.array_sort(F.flatten(F.transform(matches, around)), lambda a, b: F.when(a["n"] != b["n"], a["n"] - b["n"]).otherwise(a["rank"] - b["rank"]))
    real = F.filter(every, lambda x: (x["n"] >= 1) | (x["rank"] == 0))
    return F.transform(
        F.filter(
            F.transform(real, lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.get(real, i - 1)["n"]).alias("previous"))),
            lambda s: s["previous"].isNull() | (s["previous"] != s["x"]["n"]),
        ),
        lambda s: F.struct(s["x"]["n"].alias("n"), (s["x"]["rank"] == 0).alias("hit"), s["x"]["kind"].alias("kind"), s["x"]["line"].alias("line"), s["previous"].alias("previous")),
    )


def blocks(results: DataFrame) -> DataFrame:
    """``(path, score, block)``: each file's header and lines, with a blank line at each gap.

    The results are worked out once and then read twice, for the width and for the lines.
    """
    results = settled(results)
    sized = results.crossJoin(F.broadcast(line_width(results)))  # one row
    lang = F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit(UNKNOWN_LANGUAGE))
    header = F.concat(F.lit("## "), "path", F.lit(" ("), lang, F.lit(")"), displayed_tag(F.col("is_overlay")))
    sized = sized.withColumn("__e", emitted(F.col("line_matches")))

    def line(x: Column) -> Column:
        gap = F.when(x["previous"] + 1 < x["n"], F.lit("\n")).otherwise("")
        tag = F.when(F.coalesce(x["kind"], F.lit("")) != "", F.concat(F.lit("["), x["kind"], F.lit("] "))).otherwise("")
        own = F.when(x["hit"], F.regexp_replace(x["line"], "\n+$", "")).otherwise(x["line"])
        return F.concat(gap, F.lit("  "), right_align(x["n"], F.col("width")), F.lit(" "), F.when(x["hit"], tag).otherwise(""), own)

    body = F.concat(F.array(header), F.transform("__e", line))
    return sized.select("path", "score", F.array_join(body, "\n").alias("block"))


def pieces(results: DataFrame) -> Iterator[str]:
    """The output, piece by piece: the driver holds one partition's files at a time."""
    gap = ""
    for r in blocks(results).orderBy(F.desc("score"), "path").toLocalIterator():
        yield gap + r.block.removesuffix("\n")
        gap = "\n\n"


def rendered(results: DataFrame) -> str:
    """The whole output as one text."""
    return "".join(pieces(results))


def islands(results: DataFrame) -> DataFrame:
    """``(path, first_line, last_line, n_matches)``: the runs of lines that are printed together."""
    lines = results.select("path", F.explode(emitted(F.col("line_matches"))).alias("x")).where("x.n > 0")
    order = Window.partitionBy("path").orderBy("x.n")
    runs = lines.withColumn("__run", F.col("x.n") - F.row_number().over(order))
    return runs.groupBy("path", "__run").agg(
        F.min("x.n").alias("first_line"), F.max("x.n").alias("last_line"), F.sum(F.col("x.hit").cast("long")).alias("n_matches")
    ).drop("__run")
