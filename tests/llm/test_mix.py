import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lodestar.llm import mix

LEVELS = list(mix.LEVELS)


def deal(children, budget):
    """children: name -> (cap, weight).  Water-filling by repeated passes."""
    full = {}
    while True:
        rest = {n: cw for n, cw in children.items() if n not in full}
        left = budget - sum(children[n][0] for n in full)
        total = sum(w for _, w in rest.values())
        over = [n for n, (c, w) in rest.items() if Fraction(c, w) <= Fraction(left, total)]
        if not over:
            return {n: full.get(n, children[n][1] * left // total if n not in full else 0) for n in children}
        full |= {n: children[n][0] for n in over}
        if len(full) == len(children):
            return full


def brute(rows, share, epochs):
    """rows: (doc_id, domain, lang, source, tokens)."""
    leaf = defaultdict(int)
    for _, *path, t in rows:
        leaf[tuple(path)] += t
    got = {(): sum(leaf.values()) * share[0] // share[1]}
    for depth, level in enumerate(LEVELS):
        new = {}
        for parent, budget in got.items():
            kids = defaultdict(int)
            for path, t in leaf.items():
                if path[:depth] == parent:
                    kids[path[depth]] += t * epochs
            new |= {(*parent, k): v for k, v in deal({k: (c, mix.WEIGHTS[level].get(k, 1)) for k, c in kids.items()}, budget).items()}
        got = new
    out = []
    for path, budget in got.items():
        whole, part = divmod(budget, leaf[path]) if leaf[path] else (0, 0)
        mine = [(i, t) for i, *p, t in rows if tuple(p) == path]
        h = lambda i: hashlib.md5(f"{mix.SEED}:{whole}:{'null' if i is None else i}".encode()).hexdigest()
        for i, t in mine:
            n = whole + (part > 0 and sum(u for j, u in mine if h(j) <= h(i)) <= part)
            out += [(i, *path, t, e) for e in range(n)]
    return out


def row(r):
    d = re.search(r"([0-9]{1,9})$", r.source or "")
    return (r.doc_id, f"domain{int(d[1]) % 3}" if d else "domain_none", r.lang or "_none", r.source or "_none", len((r.text or "").split()))


@pytest.mark.parametrize("share,epochs", [((1, 2), 2), ((3, 1), 4), ((9, 10), 1), ((50, 1), 3)])
def test_against_brute_force(docs, odd, share, epochs):
    for table in (docs, odd):
        rows = [row(r) for r in table.collect()]
        got = sorted((tuple(r) for r in mix.mixed(table, share=share, epochs=epochs).collect()), key=repr)
        assert got == sorted(brute(rows, share, epochs), key=repr)


def test_too_many_leaves_to_broadcast(docs, monkeypatch):
    want = sorted(mix.mixed(docs).collect())
    monkeypatch.setattr(mix, "BROADCAST_LEAVES", 0)
    assert sorted(mix.mixed(docs).collect()) == want


def test_rows_keep_their_columns(odd):
    out = mix.mix(odd, share=(3, 4))
    assert out.columns == odd.columns
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in odd.collect()}
    assert mix.mix(odd.where(F.lit(False))).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    rows = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "fr", "a", 1000), ("d1", "en", "a", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang_group string, source_group string, tokens long")
    got = {tuple(r)[:3]: r.budget for r in mix.budgets(leaves, LEVELS, {}, (400, 3010), 1).collect()}
    assert got == {("d0", "en", "a"): 10, ("d0", "en", "b"): 90, ("d0", "fr", "a"): 100, ("d1", "en", "a"): 200}


@pytest.mark.parametrize("seed", range(10))
def test_texts_without_tokens_are_not_taken_beyond_the_epochs(spark, seed):
    rows = [(i, "" if i % 3 else "one two three", "en", "s1") for i in range(30)]
    rows += [(100 + i, None, "en", "s2") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for share, epochs in (((1, 1), 1), ((2, 1), 2), ((1, 2), 1)):
        out = mix.mix(docs, share=share, epochs=epochs, seed=seed).groupBy("doc_id").count().collect()
        assert max((r["count"] for r in out), default=0) <= epochs
        assert {r.doc_id for r in out} <= set(range(30))
        if share[0] == epochs * share[1]:
            assert {r.doc_id: r["count"] for r in out} == dict.fromkeys(range(30), epochs)
    none = {"lang_group": {"en": 0}}
    assert mix.mix(docs, weights=none, seed=seed).count() == 0
