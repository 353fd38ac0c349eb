import random

import pytest

from lodestar.llm import simhash

SF = "/root/testdata/sf0.01"


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x or y else 1.0


def brute(texts):
    """Groups by links of Jaccard similarity 0.8 and more, found by trying all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = {}
    for i, s in sets.items():
        for x in s or [None]:
            holders.setdefault(x, set()).add(i)
    root = {}
    for start in sorted(sets):
        todo = [start] if start not in root else []
        root.setdefault(start, start)
        while todo:
            i = todo.pop()
            for j in set().union(*(holders[x] for x in sets[i] or [None])):
                if j not in root and jaccard(sets[i], sets[j]) >= 0.8:
                    root[j] = start
                    todo.append(j)
    return root


def edited(rng, words, low, high):
    """A copy with single words changed, whose similarity is in that range."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    own = shingles(" ".join(words))
    while True:
        copy = list(words)
        for k in rng.sample(range(len(copy)), rng.randint(2, len(copy) // 20)):
            copy[k] = word()
        if low <= jaccard(own, shingles(" ".join(copy))) < high:
            return copy


def pairs(low, high, n=150):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(rng, words, low, high)))]
    return rows


def test_groups_are_those_of_the_jaccard_similarity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    root = brute({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in simhash.similar(docs).collect()} == root


def test_no_pair_below_the_similarity_links(spark):
    rows = pairs(0.7, 0.8)
    out = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and all(r.doc_id == r.component_id for r in out)


@pytest.mark.parametrize("low,high", [(0.8, 0.82), (0.85, 0.9)])
def test_pairs_at_the_similarity_are_found(spark, low, high):
    rows = pairs(low, high)
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i + 1] == i for i in range(0, len(rows), 2)) >= 0.98 * len(rows) / 2


def test_a_cloud_in_blocks(spark, monkeypatch):
    """A large group of copies with more and more edits: the groups are those of all pairs."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(150)]
    texts = {}
    for i in range(120):
        own = list(base)
        for k in rng.sample(range(150), rng.randint(0, 25)):
            own[k] = f"x{i}y{k}"
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(simhash, "CLOUD_TEXTS", 16)
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert got == brute(texts)


def test_a_passage_replaced_in_one_place_is_found(spark):
    """Edits side by side change fewer shingles but more bits than scattered ones."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(100):
        words = [word() for _ in range(300)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:270] + [word() for _ in range(20)]))]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i + 1] == i for i in range(0, len(rows), 2)) >= 90
