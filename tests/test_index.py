from lodestar.operators import index, search
from lodestar.plans.query import parse
from lodestar.schema import CORPUS


def test_more_alternatives_than_are_kept(spark):
    """Each of the 81 files matches by one pair of alternatives alone."""
    rows = [(f"f{i}{j}", "", False, None, f"alpha{i} and beta{j}") for i in range(1, 10) for j in range(1, 10)]
    corpus = spark.createDataFrame([*rows, ("none", "", False, None, "nothing here")], CORPUS)
    either = lambda word: "(" + " or ".join(f"{word}{i}" for i in range(1, 10)) + ")"
    text = f"{either('alpha')} {either('beta')}"
    direct = {r.path for r in search.matched(corpus, parse(text)).collect()}
    kept = {r.path for r in index.pruned(corpus, index.postings(corpus), text).collect()}
    assert len(direct) == 81 and direct <= kept and "none" not in kept
