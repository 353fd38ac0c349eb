import math
import random

import pytest
from pyspark.sql import functions as F

from lodestar.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k, asked):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.setdefault(i, []).append([math.floor(1024 * x) for x in v])
    out = set()
    for q in fine:
        if not asked(q):
            continue
        for own in {tuple(v) for v in fine[q]}:
            every = [
                (-sum(a * b for a, b in zip(own, v, strict=True)), i)
                for i, vs in fine.items() if i != q for v in vs if len(v) == len(own)
            ]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(sorted(every)[:k], 1)}
    return out


@pytest.mark.parametrize("block_rows,chunk_bytes", [(7, 300), (16384, 8 << 20)])
def test_against_all_scores(spark, block_rows, chunk_bytes):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.5, 1.0]) for _ in range(6)]) for i in range(120)]
    rows += [(200, None), (201, [float("nan")] * 6), (202, [float("inf")] + [1.0] * 5), (203, [None] * 6), (None, [1.0] * 6)]
    rows += [(300, [0.0] * 6), (301, []), (310, []), (400, [1.0, 2.0]), (401, [0.5, -2.0]), (5, rows[5][1])]
    df = topk.quantised(spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA))
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), 5, chunk_bytes, block_rows).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute(rows, 5, lambda i: i % 10 == 0)


def test_components_of_any_size(spark):
    """Exact ranks where doubles and longs would not do; scores beyond a long are its ends."""
    big = [70000.0, 1e6, 2.0**40, 1e300, -1e300]
    rows = [(100 * i, [x, 1.0]) for i, x in enumerate(big)] + [(i, [big[i % 5], float(i)]) for i in range(1, 12)] + [(50, [2.0**60, 0.5]), (51, [2.0**60, 0.25])]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), 4).collect()
    end = (1 << 63) - 1
    want = {(q, n, i, max(min(s, end), -end - 1)) for q, n, i, s in brute(rows, 4, lambda i: i % 100 == 0)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want


def test_stops_early():
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.integers(-50, 50, (5000, 4))
    values[17] = 4000
    best = topk.Best(1)
    scored = topk.Block(np.arange(5000), values).search(-1, np.array([5, 4, 3, 2]), best)
    assert best.ids.tolist() == [17] and scored < 500


def test_empty(spark):
    df = topk.quantised(spark.createDataFrame([], SCHEMA))
    assert topk.top_k(df, df).count() == 0
    assert topk.top_k(df, df).columns == ["query_id", "rank", "vec_id", "score"]


def test_few_candidates(spark):
    df = topk.quantised(spark.createDataFrame([(100, [1.0], 1, ""), (1, [1.0], 1, "")], SCHEMA))
    assert [tuple(r) for r in topk.top_k(df, df.where(F.col("vec_id") == 100)).collect()] == [(100, 1, 1, 1 << 20)]
