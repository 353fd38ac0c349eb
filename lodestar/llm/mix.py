"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

The rows form a tree of domain, language and source.  Every leaf offers its tokens times the
epochs allowed.  A token budget enters at the root; each node deals its budget to its children in
proportion to their weights, but gives no child more than its leaves offer: what a child cannot
take goes to its siblings (water-filling), and only a node whose children are all full leaves
part of its share to its own siblings.  A leaf then takes whole epochs and, of the next epoch, a
prefix in that epoch's seeded order.

The order is that of an MD5 of seed, epoch and id.  The prefix's end is found by a histogram over
the leading digits of the hash, so no task ever sorts a whole leaf, and the choice itself is a
comparison with the leaf's last hash: texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import persist

SEED = 7
#: Leading hex digits of the hash that number the histogram's cells.
CELL_DIGITS = 3
BROADCAST_LEAVES, SALTS = 50_000, 64
TOKEN = r"[^\x09-\x0D ]+"

#: The tree of the ``documents`` table as SQL expressions; a source's number tells its domain.
LEVELS: dict[str, str] = {
    "domain": "concat('domain', coalesce(cast(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) as bigint) % 3 as string), '_none'))",
    "lang_group": "coalesce(lang, '_none')",
    "source_group": "coalesce(source, '_none')",
}
#: Whole-number weights by level and value; any other value weighs 1.
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"domain0": 5, "domain1": 3, "domain2": 2},
    "lang_group": {"en": 5, "fr": 3, "de": 3, "es": 3},
    "source_group": {},
}


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    known = weights.get(level) or {}
    pairs = [F.when(F.col(level) == k, F.lit(int(v))) for k, v in known.items()]
    return F.coalesce(*pairs, F.lit(1)).cast("long")


def _deal(nodes: DataFrame, parent: list[str], own: str) -> DataFrame:
    """``nodes(parent..., own, cap, weight, budget)`` with ``got``: the node's share of budget.

    Siblings in the order of cap by weight fill up first; the full ones keep their cap, the rest
    share what is left by weight, rounded down.  Products are exact decimals.
    """
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("cap") / F.col("weight"), own)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    dec = lambda c, p: c.cast(f"decimal({p},0)")
    out = nodes.select(
        "*", F.coalesce(F.sum("cap").over(upto), F.lit(0)).alias("before"), F.sum("weight").over(onward).alias("rest")
    )
    full = dec(F.col("cap"), 20) * dec(F.col("rest"), 17) <= dec(F.col("weight"), 17) * dec(F.col("budget") - F.col("before"), 20)
    out = out.withColumn("full", full)
    out = out.select(
        "*",
        (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0))).alias("left"),
        F.sum(F.when(~F.col("full"), F.col("weight"))).over(by).alias("open"),
    )
    share = F.expr("cast(weight as decimal(17,0)) * cast(left as decimal(20,0)) div cast(open as decimal(17,0))")
    return out.withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(share.cast("long"))).drop(
        "before", "rest", "full", "left", "open", "budget"
    )


def budgets(
    leaves: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], epochs: int
) -> DataFrame:
    """``leaves(levels..., tokens)`` with ``budget``: tokens that each leaf is to give.

    The whole budget is ``share`` (numerator, denominator) of all tokens, at most what all leaves
    offer.  A value of weight 0 gets nothing.
    """
    capped = reduce(lambda df, lv: df.withColumn(f"w_{lv}", _weight(lv, weights)), levels, leaves)
    used = reduce(lambda c, lv: c & (F.col(f"w_{lv}") > 0), levels, F.lit(True))
    capped = capped.withColumn("cap", F.when(used, F.col("tokens") * epochs).otherwise(0)).where(used)
    whole = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * share[0] / share[1]).cast("long").alias("w"))
    dealt = None
    for i, own in enumerate(levels):
        parent = levels[:i]
        nodes = capped.groupBy(*parent, own).agg(F.sum("cap").alias("cap"), F.max(f"w_{own}").alias("weight"))
        if dealt is None:
            nodes = nodes.crossJoin(F.broadcast(whole)).withColumn("budget", F.col("w")).drop("w")  # one row
        else:
            nodes = nodes.join(dealt.select(*parent, F.col("got").alias("budget")), parent)
        dealt = _deal(nodes, parent, own)
    got = dealt.select(*levels, F.col("got").alias("budget"))
    return leaves.join(got, levels, "left").withColumn("budget", F.coalesce("budget", F.lit(0)))


def attach(rows: DataFrame, leaf: DataFrame, keys: list[str], leaves: int) -> DataFrame:
    """``rows`` joined with the leaf table: by broadcast up to a checked number of leaves.

    Beyond it both sides are dealt by leaf and salt, so a leaf that holds a third of all rows
    still spreads over SALTS tasks.
    """
    if leaves <= BROADCAST_LEAVES:
        return rows.join(F.broadcast(leaf), keys)
    salted = leaf.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    some = [c for c in ("doc_id", "tokens", "h") if c in rows.columns]  # not the id alone: many rows may lack one
    own = rows.withColumn("__salt", F.pmod(F.xxhash64(*some), F.lit(SALTS)).cast("int"))
    return own.join(salted, [*keys, "__salt"]).drop("__salt")


def order_hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    ids = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), ids).cast("binary"))


def measured(docs: DataFrame, levels: Mapping[str, str] = LEVELS) -> DataFrame:
    """``(doc_id, levels..., tokens)``: tokens are runs without white space; null text has none."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKEN)).cast("long")
    return docs.select("doc_id", *(F.expr(c).alias(k) for k, c in levels.items()), n.alias("tokens"))


def cuts(
    meta: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    share: tuple[int, int] = (1, 2), epochs: int = 2, seed: int = SEED,
) -> DataFrame:
    """``(levels..., whole, cut)`` of each leaf: whole epochs, and the last hash of the part epoch.

    ``cut`` is null where there is no part epoch: a leaf whose budget is whole epochs, or nothing,
    as that of a leaf without tokens or of weight 0.  Rows with one hash (repeats of an id) are taken
    together or not at all.
    """
    leaves = meta.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    dealt = budgets(leaves, levels, weights, share, epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    leaf = persist(dealt.withColumn("whole", whole).withColumn("part", F.col("budget") - F.col("whole") * F.col("tokens")))
    n = leaf.count()
    hashed = attach(meta, leaf.select(*levels, "whole", "part"), levels, n)
    hashed = hashed.withColumn("h", order_hash(seed, F.col("whole"), F.col("doc_id")))
    cells = hashed.groupBy(*levels, "part", F.substring("h", 1, CELL_DIGITS).alias("cell")).agg(F.sum("tokens").alias("t"))
    upto = Window.partitionBy(*levels).orderBy("cell")
    cells = cells.withColumn("sum", F.sum("t").over(upto))
    cut_cell = cells.where(F.col("sum") > F.col("part")).groupBy(*levels).agg(F.min(F.struct("cell", (F.col("sum") - F.col("t")).alias("base"))).alias("c"))
    cut_cell = persist(cut_cell.select(*levels, "c.cell", "c.base"))
    inside = attach(hashed.withColumn("cell", F.substring("h", 1, CELL_DIGITS)), cut_cell, [*levels, "cell"], n)
    each = inside.groupBy(*levels, "cell", "base", "part", "h").agg(F.sum("tokens").alias("t"))
    run = Window.partitionBy(*levels, "cell").orderBy("h")
    each = each.withColumn("sum", F.col("base") + F.sum("t").over(run)).where(F.col("sum") <= F.col("part"))
    last = each.groupBy(*levels).agg(F.max("h").alias("h"))
    found = cut_cell.join(last, levels, "left").select(*levels, F.coalesce("h", "cell").alias("cut"))
    cut = F.when(F.col("part") > 0, F.col("cut")).alias("cut")
    return persist(leaf.join(found, levels, "left").select(*levels, "whole", cut))


def copies(rows: DataFrame, leaf_cuts: DataFrame, levels: list[str], seed: int = SEED) -> DataFrame:
    """``rows(doc_id, levels..., ...)`` once for each epoch that takes them, with ``epoch`` from 0."""
    joined = attach(rows, leaf_cuts, levels, leaf_cuts.count())
    taken = F.coalesce(order_hash(seed, F.col("whole"), F.col("doc_id")) <= F.col("cut"), F.lit(False)).cast("long")
    counted = joined.withColumn("n", F.col("whole") + taken).where("n > 0")
    return counted.select(*rows.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("epoch"))


def mixed(
    docs: DataFrame, levels: Mapping[str, str] = LEVELS, weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    share: tuple[int, int] = (1, 2), epochs: int = 2, seed: int = SEED,
) -> DataFrame:
    """``(doc_id, levels..., tokens, epoch)``: one row for each time a document is taken.

    Null ids, languages and sources form groups of their own.  Null and empty texts have no tokens
    and are taken with the prefix they fall in; a leaf without tokens gives nothing.  Very long texts
    count with all their tokens, and a leaf whose next text is longer than what is left ends there.
    Repeats of an id are taken together; an empty table gives no rows.
    """
    meta = persist(measured(docs, levels))
    return copies(meta, cuts(meta, list(levels), weights, share, epochs, seed), list(levels), seed)


def mix(
    docs: DataFrame, levels: Mapping[str, str] = LEVELS, weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    share: tuple[int, int] = (1, 2), epochs: int = 1, seed: int = SEED,
) -> DataFrame:
    """``docs`` with its own columns only, each row as often as epochs take it, as by ``mixed``."""
    names = {k: f"__{k}" for k in levels}
    keyed = {names[k]: c for k, c in levels.items()}
    meta = persist(measured(docs, keyed))
    weighed = {names[k]: w for k, w in weights.items() if k in names}
    found = cuts(meta, list(keyed), weighed, share, epochs, seed)
    clash = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(F.col("doc_id"), *(F.expr(c).alias(k) for k, c in keyed.items()), *(F.col(f"`{c}`").alias(v) for c, v in clash.items()))
    return copies(rows, found, list(keyed), seed).select(*(F.col(v).alias(c) for c, v in clash.items()))
