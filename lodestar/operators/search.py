"""Search: filter, score, overlay, rank, limit.

Files are filtered in place by their own content; only what matched moves.  BM25 needs three
kinds of corpus-wide sums (number of files, their length, files for each atom); they are observed
while the one scan that finds the matches goes on, and the matches are kept, so a search reads its
collection once.  With an index that scan is of the files that it cannot rule out.  The overlay looks
at matched rows only, and context lines are cut after the limits, for the files that are shown.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import after, before, split_lines
from ..plans.compile import frequency, line_test, needs_content, needs_lines, needs_symbols, predicate
from ..plans.query import Atom, Query, parse, scoring_atoms
from ..schema import UNCOMMITTED, UNKNOWN_LANGUAGE
from .index import Index
from .settled import settled
from .symbols import symbol_of

# Fixed parameters of BM25 (Robertson and Zaragoza 2009).
K1, B = 1.2, 0.75
#: Most matched lines of one search, and of one shard, where ``capped`` is asked for.
MATCH_CAP, SHARD_CAP = 10_000, 10_000
WALL_SECONDS = 60


def prepared(corpus: DataFrame, query: Query) -> DataFrame:
    """``corpus`` with the columns that the query's atoms look at."""
    out = corpus
    if not needs_content(query.root):
        return out
    if needs_lines(query.root) or needs_symbols(query.root):
        out = out.withColumn("lines", split_lines(F.coalesce("content", F.lit(""))))
    if needs_symbols(query.root):
        lang = F.coalesce("lang", F.lit(UNKNOWN_LANGUAGE))
        found = F.transform("lines", lambda line: symbol_of(line, lang))
        out = out.withColumn("symbols", F.filter(found, lambda s: s.isNotNull()))
    return out


def _statistics(n_atoms: int) -> list[Column]:
    """Over rows with ``dl`` and ``tf_i``: files, their mean length, and files with atom i."""
    dfs = [F.sum((F.col(f"tf_{i}") > 0).cast("long")).alias(f"df_{i}") for i in range(n_atoms)]
    return [F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *dfs]


def _measured(corpus: DataFrame, query: Query) -> DataFrame:
    """``corpus``, prepared, with its length ``dl`` and ``tf_i`` occurrences of each scoring atom."""
    tfs = [F.coalesce(frequency(a), F.lit(0)).alias(f"tf_{i}") for i, a in enumerate(scoring_atoms(query.root))]
    return prepared(corpus, query).select("*", F.length(F.coalesce("content", F.lit(""))).alias("dl"), *tfs)


def term_statistics(corpus: DataFrame, query: Query) -> DataFrame:
    """One row: ``n`` files, ``avgdl``, and ``df_i`` files with atom i, over the whole collection."""
    return _measured(corpus, query).agg(*_statistics(len(scoring_atoms(query.root))))


def bm25(atoms: list[Atom]) -> Column:
    """Score from ``tf_i``, ``dl`` and the columns of ``term_statistics``, rounded to six places."""
    if not atoms:
        return F.lit(0.0)
    length = 1 - B + B * F.col("dl") / F.col("avgdl")

    def part(i: int) -> Column:
        tf, df = F.col(f"tf_{i}"), F.col(f"df_{i}")
        return F.log1p((F.col("n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * length)

    return F.round(reduce(lambda a, b: a + b, (part(i) for i in range(len(atoms)))), 6)


def matched(corpus: DataFrame, query: Query, index: Index | None = None) -> DataFrame:
    """``corpus`` rows that satisfy the query, with ``score``.

    A query with something to score is worked out here, in one job: its matches are kept while the
    sums are observed.  ``index`` is the collection's own; it rules files out before that job reads
    them, and knows the number of all files and their length.
    """
    atoms = scoring_atoms(query.root)
    own = [F.col(f"`{c}`") for c in corpus.columns]
    files = index.narrowed(corpus, query) if index else None
    rows = corpus if files is None else files
    if not atoms:
        return prepared(rows, query).where(predicate(query.root)).select(*own, F.lit(0.0).alias("score"))
    seen = Observation()
    found = _measured(rows, query).observe(seen, *_statistics(len(atoms))).where(predicate(query.root))
    found = settled(found.select(*own, "dl", *(f"tf_{i}" for i in range(len(atoms)))))
    sums = dict(seen.get)
    if files is not None:  # files ruled out hold none of the atoms, but count as files
        sums |= {"n": index.files, "avgdl": index.chars / max(index.files, 1)}
    known = found.withColumns({k: F.lit(v) for k, v in sums.items()})
    return known.select(*own, bm25(atoms).alias("score"))


def overlay(rows: DataFrame, dirty: DataFrame | None = None) -> DataFrame:
    """One row for each path: uncommitted before committed, and no committed row of a dirty path.

    Among rows of one class the best score wins, then a hash of the content decides.
    """
    ties = [F.desc("score")] if "score" in rows.columns else []
    ties += [F.xxhash64("content")] if "content" in rows.columns else []
    order = Window.partitionBy("path").orderBy(F.desc("is_overlay"), *(ties or [F.col("repo")]))
    kept = rows.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")
    if dirty is None:
        return kept
    stale = dirty.select("path").distinct().withColumn("is_overlay", F.lit(False))
    return kept.join(stale, ["path", "is_overlay"], "left_anti").select(*rows.columns)


def ranked(rows: DataFrame, limit: int = 0) -> DataFrame:
    """By score downwards, then by path; the first ``limit`` rows, or all if it is not positive."""
    out = rows.orderBy(F.desc("score"), "path")
    return out.limit(limit) if limit > 0 else out


def line_matches(rows: DataFrame, query: Query, max_matches: int = 0) -> DataFrame:
    """``rows`` with ``line_matches`` in place of ``content``; a file without any has one of line 0.

    Shown are the lines that some positive atom on content or symbols asks for, in order, the
    first ``max_matches`` of them if that is positive, each with its context and symbol.
    """
    atoms = scoring_atoms(query.root)
    lang = F.coalesce("lang", F.lit(UNKNOWN_LANGUAGE))
    lines = rows.withColumn("__lines", split_lines(F.coalesce("content", F.lit(""))))
    tagged = any(a.kind == "sym" for a in atoms)  # else only the lines that are shown are looked at
    untold = F.lit(None).cast("struct<name:string,kind:string>")
    numbered = F.transform(
        "__lines", lambda line, i: F.struct((i + 1).alias("n"), line.alias("line"), (symbol_of(line, lang) if tagged else untold).alias("symbol"))
    )

    def shown(x: Column) -> Column:
        tests = [line_test(x["line"], x["symbol"], a) for a in atoms]
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)

    hits = F.filter(numbered, shown) if atoms and not query.files_only else F.slice(numbered, 1, 0)
    if max_matches > 0:
        hits = F.slice(hits, 1, max_matches)
    lines = lines.withColumn("__hits", hits)

    def match(x: Column) -> Column:
        all_lines = F.col("__lines")
        return F.struct(
            x["n"].cast("int").alias("line_number"), x["line"].alias("line"), before(all_lines, x["n"]).alias("before"),
            after(all_lines, x["n"]).alias("after"), (x["symbol"] if tagged else symbol_of(x["line"], lang))["kind"].alias("symbol_kind"),
        )

    none = F.array().cast("array<string>")
    file_only = F.array(
        F.struct(F.lit(0).alias("line_number"), F.lit(None).cast("string").alias("line"), none.alias("before"), none.alias("after"), F.lit(None).cast("string").alias("symbol_kind"))
    )
    made = F.when(F.size("__hits") > 0, F.transform("__hits", match)).otherwise(file_only)
    keep = [c for c in rows.columns if c != "content"]
    return lines.select(*keep, made.alias("line_matches"))


def search(
    corpus: DataFrame, text: str, dirty: DataFrame | None = None, limit: int = 0, max_matches: int = 0, capped: bool = False,
    index: Index | None = None, shards: DataFrame | None = None,
) -> DataFrame:
    """``FILE_MATCH`` rows of a query over committed and overlay rows, best first.

    The limits come after overlay and order, so no row they would have shown is lost.  ``capped``
    ends a search after the file that reaches MATCH_CAP matched lines; with ``shards(path, repo,
    shard)`` each shard gives files, in path order, up to the one that reaches SHARD_CAP first.
    """
    query = parse(text)
    rows = ranked(overlay(matched(corpus, query, index), dirty), limit)
    out = line_matches(rows, query, max_matches)
    if capped and shards is not None:
        before = Window.partitionBy("__shard").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
        placed = out.join(shards.select("path", "repo", F.col("shard").alias("__shard")), ["path", "repo"], "left").select(*out.columns, "__shard")
        out = placed.withColumn("__seen", F.coalesce(F.sum(F.size("line_matches")).over(before), F.lit(0)))
        out = out.where(F.col("__seen") < SHARD_CAP).drop("__seen", "__shard")
    if capped:
        upto = Window.orderBy(F.desc("score"), "path").rowsBetween(Window.unboundedPreceding, -1)
        out = out.orderBy(F.desc("score"), "path").limit(MATCH_CAP).withColumn("__seen", F.coalesce(F.sum(F.size("line_matches")).over(upto), F.lit(0)))
        out = out.where(F.col("__seen") < MATCH_CAP).drop("__seen")
    return out.orderBy(F.desc("score"), "path")


@contextmanager
def limited(spark: SparkSession, seconds: float = WALL_SECONDS) -> Iterator[None]:
    """What runs inside has so many seconds: then its Spark jobs are cancelled and ``TimeoutError`` raised."""
    sc, tag, late = spark.sparkContext, f"search-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception:
        if late.is_set():
            raise TimeoutError(f"the search took more than {seconds:g} s") from None
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def within[T](spark: SparkSession, work: Callable[[], T], seconds: float = WALL_SECONDS) -> T:
    """What ``work`` gives, or ``TimeoutError``."""
    with limited(spark, seconds):
        return work()


def has_match(rows: DataFrame) -> bool:
    """Whether anything is left to show; stops at the first row."""
    return not rows.isEmpty()


def displayed_tag(is_overlay: Column) -> Column:
    return F.when(is_overlay, F.lit(f" [{UNCOMMITTED}]")).otherwise("")
