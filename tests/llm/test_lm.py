import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import lm


def split(text):
    return (text or "").encode().lower().split()


def brute(rows, good_ids):
    """Word and bigram counts by dictionaries; ``rows``: (id, text)."""
    every = Counter(w for _, t in rows for w in split(t))
    least = max(2, math.ceil(sum(every.values()) / lm.SHARE))
    known = {w for w, n in every.items() if n >= least}
    marked = lambda t: [None, *(w if w in known else "unknown" for w in split(t)), None]
    models = []
    for wanted in (True, False):
        pair, before, own = Counter(), Counter(), Counter()
        for i, t in rows:
            if split(t) and (not wanted or i in good_ids):
                w = marked(t)
                pair.update(zip(w, w[1:]))
                before.update(w[:-1])
                own.update(w[1:])
        total = sum(own.values()) + len(known) + 2

        def p(h, w, pair=pair, before=before, own=own, total=total):
            alone = (own[w] + 1) / total
            return lm.BIGRAM_SHARE * pair[h, w] / before[h] + (1 - lm.BIGRAM_SHARE) * alone if before[h] else alone

        models.append(p)
    out = {}
    for i, t in rows:
        w = marked(t)
        means = [-sum(math.log(p(a, b)) for a, b in zip(w, w[1:])) / (len(w) - 1) if len(w) > 2 else 0.0 for p in models]
        out[i] = (len(w) - 2, *means, means[0] - means[1])
    return out, models, known


TEXTS = ["the cat sat on the mat", "The cat\tate  the\nmat", "a dog sat", "", None, "dog dog dog cat", "é the É", "on the mat the cat sat"]


def compare(got, want):
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-5)


def test_against_exact_counts(spark, monkeypatch):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (2, 0), (4, 1), (5, None), (99, 1), (None, 1)], "doc_id long, quality int")
    want = brute(rows, {0, 1, 4})[0]
    for ids in (lm.BROADCAST_IDS, 0):
        monkeypatch.setattr(lm, "BROADCAST_IDS", ids)
        got = {r.doc_id: tuple(r)[1:] for r in lm.score(lm.labelled_target(docs, labels)).collect()}
        compare(got, want)


@pytest.mark.parametrize("small", [False, True])
def test_whole_table_against_exact_counts(docs, spark, monkeypatch, small):
    """All documents, with bigrams in the table and dealt; then in small slices, flushes and groups."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], good)[0]
    if small:
        for name, value in {"FLUSH": 999, "SLICE": 100, "GROUP_TOKENS": 2000}.items():
            monkeypatch.setattr(lm, name, value)
    rows = lm.score(lm.labelled_target(docs, labels)).collect()
    compare({r.doc_id: tuple(r)[1:] for r in rows}, want)
    assert min(r.background_loss for r in rows if r.n_tokens) > 0 and min(r.target_loss for r in rows if r.n_tokens) > 0


def test_probabilities_sum_to_one():
    rows = list(enumerate(TEXTS))
    _, models, known = brute(rows, {0, 1, 4})
    for p in models:
        for h in [None, "unknown", *known]:
            assert sum(p(h, w) for w in [None, "unknown", *known]) == pytest.approx(1)


def test_numbers_are_those_of_the_table(spark):
    docs = spark.createDataFrame([(0, "b b b a a c c d", True), (1, "a b", False)], "doc_id long, text string, target boolean")
    m = lm.fit(docs)
    assert [m.number(w) for w in (b"b", b"a", b"c", b"d", b"zz")][:2] == [2, 3] and m.number(b"d") == m.number(b"zz") == lm.UNKNOWN
    assert m.counts[:, [lm.UNKNOWN, lm.EDGE, 2, 3, m.number(b"c")]].tolist() == [[1, 1, 3, 2, 2], [1, 2, 4, 3, 2]]


def test_rows_that_teach_nothing(spark):
    """Texts that are not counted get the scores of the others' models."""
    rows = [(0, "a b a b c", True, True), (1, "a c b a", False, True), (2, "a b q", True, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, target boolean, counted boolean")
    taught = [(0, rows[0][1]), (1, rows[1][1])]
    want, models, known = brute(taught, {0})
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    assert got[0].score == pytest.approx(want[0][-1], abs=1e-5)
    w = [None, *(x if x in known else "unknown" for x in split("a b q")), None]
    assert got[2].background_loss == pytest.approx(-sum(math.log(models[1](a, b)) for a, b in zip(w, w[1:])) / 4, abs=1e-5)


def test_packing():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 40, 100).astype(np.uint64), rng.integers(0, 1 << 24, 100).astype(np.uint64)
    x, y = lm._unpack(lm._pack([(a, 5), (b, 3)]), [5, 3])
    assert (x == a).all() and (y == b).all()


def test_odd_rows(odd, spark):
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = lm.score(lm.labelled_target(odd, labels)).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 6)} == {0} and max(r.n_tokens for r in rows) == 30000
    assert lm.score(lm.labelled_target(odd.where(F.lit(False)), labels)).count() == 0
