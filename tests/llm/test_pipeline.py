import re

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import pieces, pii, quality
from lodestar.llm.queries import ORACLE, QUERIES
from tests.llm.test_mix import brute as mix_brute
from tests.llm.test_mix import row as mix_row
from tests.llm.test_pii import KEY
from tests.llm.test_pii import brute as pii_brute
from tests.llm.test_similar import brute as brute_similar

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, docs):
    """Each stage on the whole output of the one before it."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]

    good = stages[0](spark, docs, SF)
    assert good.columns == COLUMNS
    model = quality.fit(docs, labels)
    kept = good.collect()
    rows = docs.collect()
    want = [r for r, s in zip(rows, model.score([r.text for r in rows]), strict=True) if s >= 0.3]
    assert sorted(kept) == sorted(want) and 0 < len(kept) < len(rows)

    unique = stages[1](spark, good, SF)
    assert unique.columns == COLUMNS
    root = brute_similar({r.doc_id: r.text for r in kept})
    one = [r for r in kept if root[r.doc_id] == r.doc_id]
    assert sorted(unique.collect()) == sorted(one) and len(one) < len(kept)

    spark.conf.set(pii.KEY_SETTING, KEY)
    masked = stages[2](spark, unique, SF)
    assert masked.columns == COLUMNS
    by = {r.doc_id: r for r in masked.collect()}
    assert len(by) == len(one)
    for r in one:
        assert by[r.doc_id].text == re.sub(pii.ANY, lambda m: pii_brute(m[0]), r.text, flags=re.A)
        assert (by[r.doc_id].lang, by[r.doc_id].source, by[r.doc_id].n_chars) == (r.lang, r.source, len(by[r.doc_id].text))

    mixed = stages[3](spark, masked, SF)
    assert mixed.columns == COLUMNS
    taken = {r.doc_id for r in mixed.collect()}
    assert taken == {x[0] for x in mix_brute([mix_row(r) for r in by.values()], (1, 2), 1)} and mixed.count() == len(taken)

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in stages[4](spark, mixed, SF).collect():
        assert r.tokens == library.encode(by[r.doc_id].text) and r.n_tokens == len(r.tokens)
        assert (r.lang, r.source) == (by[r.doc_id].lang, by[r.doc_id].source)


def test_run_and_registry(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "tokens"] and out.count() > 0
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 11))
    assert set(ORACLE) <= set(QUERIES)


def test_empty_and_odd(spark, odd):
    for table in (odd, odd.where(F.lit(False))):
        d = table.select(*COLUMNS)
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, SF)
        assert d.count() <= table.count()
