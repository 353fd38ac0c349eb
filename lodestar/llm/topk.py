"""Exact top-k by integer inner product with Fagin's threshold algorithm.

The candidates are taken in blocks of bounded size.  A block holds, for every dimension, the list
of its rows sorted by that component.  A query reads the lists in parallel from the end that its
weight favours, a stretch at a time; rows seen for the first time are scored in full; the value
of the lists where they now stand bounds every row not yet seen.  Reading stops once that bound
cannot beat the k-th best score, which a task carries from block to block.  Each task returns k
rows for each query, and a window per query merges those.

The queries are taken in chunks whose bytes are bounded by ``chunk_bytes``; a larger query set
takes more passes over the candidates, each a job of its own, never a larger broadcast: the driver
holds one chunk at a time, and the answers to each chunk are checkpointed.

Scores are exact whatever the size of the components: products that doubles or longs might not
hold are taken in Python's integers, for the rows that need it alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import persist

BLOCK_ROWS = 16_384
#: Rows with a component beyond this are kept apart in blocks of their own, as their sums are slow.
PLAIN = float(1 << 20)
LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``(vec_id, v)``: floor(scale * x) of each component, a whole number in a double.

    ``scale`` is a power of two, so nothing is rounded.  Rows with a null id, a null vector, or a
    null or non-finite component take no part.
    """
    v = F.transform(vec_col, lambda x: _floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall(vec_col, lambda x: F.coalesce(F.abs(x.cast("double")) < math.inf, F.lit(False)) & ~F.isnan(x))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), v.alias("v")
    )


def _floor(x: Column) -> Column:
    """Doubles of 2^53 and more are whole; Spark's floor would make longs of them."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


@dataclass
class Best:
    """The k best (score, id) so far, ties to the smaller id."""

    k: int
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def kth(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -math.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        use = np.asarray(scores >= self.kth, bool)
        s, i = np.concatenate([self.scores, scores[use]]), np.concatenate([self.ids, ids[use]])
        if s.dtype == object:
            top = sorted(range(len(s)), key=lambda n: (-s[n], i[n]))[: self.k]
        else:
            top = np.lexsort((i, -s))[: self.k]
        self.scores, self.ids = s[top], i[top]


def whole(x: np.ndarray) -> np.ndarray:
    """Python's integers, for products of any size."""
    return np.array([int(y) for y in x.ravel()], object).reshape(x.shape)


def products(rows: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of rows with q; ``most`` bounds the sum of magnitudes."""
    if most < 2**53:
        return (rows @ q).astype(np.int64)
    if most < 2**62:
        return rows.astype(np.int64) @ q.astype(np.int64)
    return whole(rows) @ whole(q) if len(q) else np.zeros(len(rows), np.int64)


class Block:
    """Candidates of one dimension count, with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values.astype(np.float64)
        self.order = np.argsort(self.values, axis=0, kind="stable").astype(np.int32)
        self.largest = float(np.abs(self.values).max(initial=0))

    def search(self, own: int, q: np.ndarray, best: Best) -> int:
        """Feed ``best`` with this block's rows that may enter it; returns the rows scored."""
        n = len(self.ids)
        used = np.flatnonzero(q)
        up, down = used[q[used] > 0], used[q[used] < 0]
        seen = np.zeros(n, bool)
        most = self.largest * float(np.abs(q).max(initial=0)) * max(len(q), 1)
        depth, step, scored = 0, 32, 0
        while depth < n:
            end = min(n, depth + step)
            if len(used):
                here = np.concatenate([self.order[n - end : n - depth, up].ravel(), self.order[depth:end, down].ravel()])
                new = np.zeros(n, bool)
                new[here] = True
                new &= ~seen
                seen |= new
                rows = np.flatnonzero(new)
            else:  # a query of zeros has no list to read: every row scores zero
                rows, end = np.arange(n), n
            rows = rows[self.ids[rows] != own]
            if len(rows):
                scored += len(rows)
                best.add(products(self.values[rows], q, most), self.ids[rows])
            last = np.concatenate([self.values[self.order[n - end, up], up], self.values[self.order[end - 1, down], down]])
            bound = int(products(last[None, :], np.concatenate([q[up], q[down]]), most)[0])
            if best.kth > bound:  # an equal score could still win by a smaller id
                break
            depth, step = end, step * 2
        return scored


def _search_partition(queries: list[tuple[int, int, np.ndarray]], k: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        wait: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
        held: dict[tuple[int, bool], int] = {}

        def flush(kind: tuple[int, bool]) -> None:
            dim = kind[0]
            ids = np.concatenate([a for a, _ in wait[kind]])
            values = np.concatenate([b for _, b in wait[kind]])
            wait[kind], held[kind] = [], 0
            for lo in range(0, len(ids), block_rows):
                block = Block(ids[lo : lo + block_rows], values[lo : lo + block_rows])
                for (_, own, q), b in zip(queries, best, strict=True):
                    if len(q) == dim:
                        block.search(own, q, b)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                values = flat[starts[at][:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0))
                plain = np.abs(values).max(axis=1, initial=0) <= PLAIN
                for kind, rows in (((dim, True), plain), ((dim, False), ~plain)):
                    if rows.any():
                        wait.setdefault(kind, []).append((ids[at[rows]], values[rows]))
                        held[kind] = held.get(kind, 0) + int(rows.sum())
                        if held[kind] >= block_rows:
                            flush(kind)
        for kind in list(wait):
            if wait[kind]:
                flush(kind)
        cols = [[], [], [], []]
        for (slot, own, _), b in zip(queries, best, strict=True):
            cols[0] += [slot] * len(b.ids)
            cols[1] += [own] * len(b.ids)
            cols[2] += b.ids.tolist()
            cols[3] += [str(int(x)) for x in b.scores]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["slot", "query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, chunk_bytes: int = 32 << 20, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest inner products, all if fewer.

    Both inputs are ``(vec_id, v)`` as ``quantised`` gives.  A query meets every candidate of its
    own number of dimensions but those with its own vec_id.  Ties go to the smaller vec_id; rows
    of ``vectors`` that repeat a vec_id are candidates each.  Repeated queries count once.  Empty
    tables give no rows.  Ranks go by the exact score, however large; a score that a long cannot hold
    is shown as the nearest long.
    """
    spark = vectors.sparkSession
    asked = persist(queries.distinct())
    size = asked.agg(F.sum(8 * F.size("v") + 16)).first()[0] or 0
    chunks = math.ceil(size / chunk_bytes)
    fields = "slot long, query_id long, vec_id long, score string"
    out = spark.createDataFrame([], fields)
    for c in range(chunks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(chunks)) == c).collect()
        part = [(i, r.vec_id, np.array(r.v, np.float64)) for i, r in enumerate(sorted(rows))]
        found = vectors.mapInArrow(_search_partition(part, k, block_rows), fields).withColumn("slot", F.col("slot") * chunks + c)
        best = _best(found, k)
        if chunks > 1:
            best = persist(best)  # this chunk's job runs now, and its queries are let go
        out = out.union(best) if c else best
    exact = F.col("score").try_cast("long")
    end = F.when(F.col("score").startswith("-"), F.lit(-LONG - 1)).otherwise(F.lit(LONG))
    score = F.coalesce(exact, end)
    return out.select("query_id", "rank", "vec_id", score.alias("score")) if chunks else out.select(
        "query_id", F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query among its tasks' answers, ranked.

    Scores are digits: with their length and sign before them they sort as numbers do, of any size.
    """
    digits = F.regexp_replace("score", "^-", "")
    sign = F.when(F.col("score").startswith("-"), -1).otherwise(1)
    length = F.length(digits) * sign
    # among negative numbers of one length the smaller digits are the larger number
    order = Window.partitionBy("slot", "query_id").orderBy(
        F.desc(length), F.desc(F.when(sign > 0, digits)), F.asc(F.when(sign < 0, digits)), "vec_id"
    )
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
