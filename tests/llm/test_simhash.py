import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import simhash


def brute_fp(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, bits):
    """items: (id, fp); the smallest id reachable, by flood fill over all pairs."""
    root = {}
    for start, _ in sorted(items):
        if start in root:
            continue
        todo = [start]
        root[start] = start
        fps = dict(items)
        while todo:
            x = fps[todo.pop()]
            for j, y in items:
                if j not in root and (x ^ y).bit_count() <= bits:
                    root[j] = start
                    todo.append(j)
    return root


def check(spark_rows, items, bits):
    want = brute_components(items, bits)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in spark_rows}
    assert got == {i: (f"{fp:016x}", want[i]) for i, fp in items}


@pytest.mark.parametrize("width,bits", [(4, 4), (5, 3), (3, 6)])
def test_against_all_pairs(docs, width, bits):
    items = [(r.doc_id, brute_fp(r.text, width)) for r in docs.collect()]
    check(simhash.near_duplicates(docs, width, bits).collect(), items, bits)


def test_chains_and_clouds(spark):
    """Groups whose links only the pair join finds, and a cloud around one fingerprint."""
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):  # a chain that walks away
            fps.add(x)
            for b in rng.sample(range(64), rng.choice([2, 3, 4, 5])):
                x ^= 1 << b
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(60):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    items = sorted(enumerate(fps))
    fp_of = dict(items)
    rows = [(i, 1, x - (1 << 64) if x >> 63 else x) for i, x in items]
    df = spark.createDataFrame(rows, "node long, copies long, f0 long")
    got = {fp_of[r.node]: fp_of[r.root] for r in simhash.groups(df).collect()}
    want = brute_components(items, 4)
    by_id = dict(items)
    classes = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert classes({x: got.get(x, x) for x in fps}) == classes({by_id[i]: r for i, r in want.items()})


def test_halves_cover_every_segment():
    """Each bit is a wildcard once, behind the other half of its segment."""
    for pieces, n in ((3, 1), (3, 4), (4, 2)):
        ways = simhash.halves(pieces, n)
        assert len(ways) == 2 * pieces * n
        assert sorted((lane, b) for lane, _, free in ways for b in free) == [(lane, b) for lane in range(n) for b in range(64)]


def test_split_deals_give_the_same_groups(spark):
    """Blocks of three rows: every deal of a cloud is split, and its groups stay those of all pairs."""
    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(40)}
    x = rng.getrandbits(64)
    fps |= {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(80)}
    items = sorted(enumerate(fps))
    df = spark.createDataFrame([(i, 1, f - (1 << 64) if f >> 63 else f) for i, f in items], "node long, copies long, f0 long")
    got = {r.node: r.root for r in simhash.groups(df, block=3).collect()}
    want = brute_components(items, 4)
    classes = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert classes(got) == classes(want)


def test_one_row_of_each_group_stays(spark):
    """Texts of one id are judged on their own, ids that are null come last, repeats leave one row."""
    same, other = " ".join(f"w{i}" for i in range(100)), " ".join(f"v{i}" for i in range(100))
    close = same.replace("w99", "end")
    rows = [(1, same), (2, close), (2, other), (2, other), (None, close), (None, "alone in this table"), (7, "alone in this table too")]
    out = simhash.keep_one(spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id long, text string, digest string, __id long, __Hash long"))
    assert out.columns == ["doc_id", "text", "digest", "__id", "__Hash"]
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(1, same), (2, other), (0, "alone in this table"), (7, "alone in this table too")])


def test_many_dropped_ids(docs, monkeypatch):
    want = sorted(simhash.keep_one(docs).collect())
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
    assert sorted(simhash.keep_one(docs).collect()) == want


def test_edited_copies_are_found(spark):
    """Copies with a few words changed, and texts that only share a passage."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, copy_of = [], {}
    passage = [word() for _ in range(60)]
    for i in range(60):
        w = [word() for _ in range(300)]
        texts.append(w[:100] + passage + w[100:])
    for i in range(60):
        w = list(texts[i])
        for k in rng.sample(range(len(w)), 5):
            w[k] = word()
        copy_of[len(texts)] = i
        texts.append(w)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    assert sum(got[i] == c for i, c in copy_of.items()) >= 57
    assert all(got[i] == i for i in range(60))


def test_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == by[6].fingerprint == "0" * 16
    assert by[6].component_id == 1 and by[4].component_id == 3
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5, 7, 8]


def test_empty_table(odd):
    assert simhash.near_duplicates(odd.where(F.lit(False))).count() == 0
    assert simhash.keep_one(odd.where(F.lit(False))).count() == 0
