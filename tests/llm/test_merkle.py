import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestar.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_tree(text):
    leaves_of = lambda p: re.findall(r"(?:[^ \t\n\x0b\f\r]{1,64}[ \t\n\x0b\f\r]*){1,8}|[ \t\n\x0b\f\r]+", p)
    sections = [s for s in re.split(r"(?<=\n\n)(?!\n)", text)]
    nodes, hashes, paras = [], [], []
    for s in sections:
        inner = []
        for p in re.split(r"(?<=\n)", s):
            leaves = [sha(x) for x in leaves_of(p)]
            inner.append(sha("".join(leaves)))
            nodes += leaves
        paras += inner
        hashes.append(sha("".join(inner)))
    return sha("".join(hashes)), set(nodes) | set(paras) | set(hashes), paras


def brute(rows):
    rows = [(i, t or "") for i, t in rows]
    out = []
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        (r, a, p), (re_, b, q), (rn, c, _) = brute_tree(t), brute_tree(edited), brute_tree(after)
        near = lambda x, u, y, v: 2.0 * (len(u & v) + (x == y)) / (len(u) + len(v) + 2.0)
        diff = next((k + 1 for k in range(max(len(p), len(q))) if p[k : k + 1] != q[k : k + 1]), 0)
        out.append((i, len(t), sha(edited), r, re_, near(r, a, re_, b), near(r, a, rn, c), diff))
    return out


@pytest.mark.parametrize("buckets", [2, 5, 64])
def test_against_brute_force(docs, buckets):
    rows = [(r.doc_id, r.text) for r in docs.orderBy(F.desc("doc_id")).collect()]
    got = merkle.fingerprint_edits(docs, buckets).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows))


def test_sections_and_spaces(spark):
    texts = ["a b\n\nc d\n\n\n e", "a b\n\nc d\n\n\n e ", "", "\n", "\n\n", " x", "x " * 9, "z" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in merkle.fingerprinted(df).collect()}
    assert [got[i].root for i in range(len(texts))] == [brute_tree(t)[0] for t in texts]
    assert len({r.root for r in got.values()}) == len(texts)


def test_odd_rows(odd):
    got = merkle.fingerprint_edits(odd, 3).collect()
    assert len(got) == odd.count()
    order = [8, 7, 6, 5, 4, 3, 3, 2, 1, None]
    by_id = {r.doc_id: r.text for r in odd.collect()}
    want = brute([(i, by_id[i]) for i in order])
    assert sorted(tuple(r) for r in got if r.doc_id) == sorted(w for w in want if w[0])
    assert [tuple(r) for r in got if not r.doc_id] == [w for w in want if not w[0]]


def test_one_and_none(odd):
    one = merkle.fingerprint_edits(odd.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert merkle.fingerprint_edits(odd.where(F.lit(False))).count() == 0


def test_many_rows_of_one_id_are_spread(spark):
    """Rows without an id, or of one id, come in as many ranges as their texts allow; the result stays."""
    rows = [(None, f"text {i}") for i in range(40)] + [(7, f"other {i}") for i in range(40)] + [(7, "same")] * 10 + [(i, f"t{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = merkle._bucketed(docs, 12).groupBy("bucket").count().collect()
    assert len(placed) >= 8 and max(r["count"] for r in placed) <= 30
    few, many = (sorted(map(repr, merkle.fingerprint_edits(docs, n).collect())) for n in (2, 16))
    assert few == many
