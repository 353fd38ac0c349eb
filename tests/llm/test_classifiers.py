import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.1"


def out_of_fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("module,label,cut,least", [(toxicity, "toxic", 0.5, 0.95), (quality, "quality", 0.3, 0.98)])
def test_held_out_accuracy(big, module, label, cut, least):
    docs, labels = big
    model = module.fit(docs, labels)
    rows = module.score(docs, model).join(labels, "doc_id").where(f"held_out and {label} is not null").collect()
    assert all(r.predicted == int(r.score >= cut) and out_of_fold(r.doc_id, 5) == 0 for r in rows)
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    positive = [r.predicted for r in rows if r[label] == (1 if label == "toxic" else 0)]
    assert np.mean([p == (label == "toxic") for p in positive]) > 0.7


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(odd, spark, module):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, None), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = module.fit(odd, labels)
    rows = module.score(odd, model).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id} <= {True, False}
    assert module.score(odd.where(F.lit(False)), model).count() == 0
    assert len({r.score for r in module.score(odd, module.fit(odd, labels.where(F.lit(False)))).collect()}) == 1


def test_scores_do_not_depend_on_labels_or_batches(big):
    docs, labels = big
    model = quality.fit(docs, labels)
    some = docs.where("doc_id < 300").collect()
    one = [model.score([r.text])[0] for r in some]
    assert np.allclose(one, model.score([r.text for r in some]), atol=1e-6)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.keep_good(docs, model).count() == quality.score(docs, model).where("predicted = 1").count()


def test_a_toxic_window_is_found():
    near = [(a, b, c) for a in "abcdefgh" for b in "ijklm" for c in "nopqr"]
    clean = [f"the {a} house of {b} stands by the {c} river and nobody minds it" for a, b, c in near]
    toxic = [f"the {a} horrid {b} house stands {c} scoundrel {a} and {b} wretchedly by the {c} river" for a, b, c in near[::2]]
    model = toxicity.fit_texts([(t, 0) for t in clean] + [(t, 1) for t in toxic])
    assert model.score("all quiet by the river horrid z and scoundrel you and wretchedly here") > 0.5
    assert model.score("the z house of y stands by the x river") < 0.5
    assert model.score(None) == model.score("") < 0.5


def test_toxicity_against_one_window_at_a_time(docs, spark):
    """Every window compressed anew by coders made for it; the model is the same whenever it is fitted."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    many = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fit(many, labels)
    again = toxicity.fit(many, labels)
    assert (model.ordinary, model.toxic, model.thresholds) == (again.ordinary, again.toxic, again.thresholds)

    def saved(some):
        x = toxicity.CARRIER + b" " + b" ".join(some) + b" "
        cost = [len(toxicity._compressor(model.ordinary + d + toxicity.CARRIER).compress(x)) for d in (bytes(len(model.toxic)), model.toxic)]
        return cost[0] - cost[1]

    rows = sorted(docs.collect(), key=lambda r: len(r.text))[:6]
    for r in rows:
        w, features = toxicity.words(r.text), []
        for width, threshold in zip(toxicity.WIDTHS, model.thresholds, strict=True):
            s = [saved(w[i : i + width]) for i in range(0, len(w), width)]
            scale = toxicity.WIDTHS[0] / width
            hit = sum(x >= threshold for x in s)
            features += [scale * sum(s) / len(s), scale * sum(x for x in s if x > 0) / len(s), scale * hit / len(s), min(max(s), 12) / 4, np.log1p(hit)]
            features += [scale * sum(x >= g for x in s) / len(s) for g in range(1, toxicity.GAINS + 1)]
        z = model.weights[0] + sum(f * v for f, v in zip(features, model.weights[1:], strict=True))
        assert model.score(r.text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_toxic_texts_of_ordinary_words_still_train_a_dictionary():
    clean = [(f"the {a} house stands by the {b} river", 0) for a in "abcdefgh" for b in "ijklmnop"]
    toxic = [(f"river the by {b} stands house {a} the", 1) for a in "abcdefgh" for b in "ijklmnop"]
    model = toxicity.fit_texts(clean + toxic)
    assert model.toxic and 0 <= model.score("river the by q stands house r the") <= 1


def brute_pooled(model, text):
    """The mean of the vectors of a text's tokens, one token at a time."""
    words, vectors = text.split(), []
    for w in words:
        own = quality.core(w)
        vectors += [model.vector(t) for t in [*quality.look(w), own if own in model.vectors else "<rare>"]]
    vectors += [model.vector("<again>") for a, b in zip(words, words[1:]) if a == b]
    lines = text.split("\n")
    vectors += [model.vector("<line again>") for i, x in enumerate(lines) if x in lines[:i]]
    mean = np.mean(vectors, 0) if vectors else np.zeros(quality.DIM)
    return np.append(mean, np.log1p(len(words)) / 10)


def test_quality_against_one_token_at_a_time(docs, spark):
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    texts = [r.text for r in docs.collect()] + ["", "a a a\n\nb\nb", "... --- !!!", "_x_ É9 ABC"]
    mean, scale, w1, b1, w2, b2 = model.net
    for t, got in zip(texts, model.score(texts), strict=True):
        hidden = [max(0.0, float(sum((x - m) / s * w for x, m, s, w in zip(brute_pooled(model, t), mean, scale, w1[:, k], strict=True)) + b1[k])) for k in range(len(b1))]
        z = (sum(h * w for h, w in zip(hidden, w2, strict=True)) + float(b2)) / model.temperature
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))), abs=1e-4)


def test_words_of_many_signs_take_little_time():
    import time

    for word in ("a" + "-" * 1_000_000 + "a", "-" * 1_000_000, "a-" * 500_000):
        began = time.monotonic()
        assert "".join(quality.parts(word)) == word
        quality.look(word)
        assert time.monotonic() - began < 2


def test_samples_are_full_and_clashes_harmless(spark):
    docs = spark.createDataFrame([(i, "x" * (30_000 if i % 2 else 10), 1.0) for i in range(400)], "doc_id long, text string, __score double")
    labels = spark.createDataFrame([(i, i // 2 % 2) for i in range(400)], "doc_id long, quality int")
    from lodestar.llm.labelled import labelled_sample

    assert len(labelled_sample(docs, labels, "quality", {0: 30, 1: 40})) == 70
    assert max(len(t) for t, _ in labelled_sample(docs, labels, "quality", {0: 300, 1: 300}, max_chars=40_000)) == 30_000
    out = quality.keep_good(docs, quality.fit(docs, labels), 0.0)
    assert out.columns == docs.columns and out.where("__score = 1").count() == 400


def brute_em(model, text):
    """One document at a time, all nested sets tried."""
    grams = langid.trigrams(text, model.buckets)
    if not len(grams):
        return "und", 0.0
    like, n = model.p[grams], len(model.languages)

    def em(start):
        share = start
        for _ in range(langid.ROUNDS):
            part = like * share
            share = (part / part.sum(1, keepdims=True)).mean(0)
        return share, np.log((like * share).sum(1)).sum()

    full, _ = em(np.full(n, 1 / n))
    order = np.argsort(-full, kind="stable")
    best = None
    for k in range(1, n + 1):
        start = np.zeros(n)
        start[order[:k]] = 1 / k
        share, ll = em(start)
        value = ll - (k - 1) * 0.5 * np.log(len(grams))
        if best is None or value > best[0]:
            best = value, share
    return model.languages[best[1].argmax()], best[1].max()


def test_language_against_brute_force(docs):
    model = langid.fit(docs)
    assert model.languages == ["de", "en", "es", "fr"]
    texts = [r.text for r in docs.orderBy("doc_id").collect()][:60]
    texts += [a[:400] + " " + b[:300] for a, b in zip(texts[::2], texts[1::2], strict=False)] + [None, "", "123 !?", "é", "ab"]
    for t, (lang, share) in zip(texts, model.predict(texts), strict=True):
        want = brute_em(model, t or "")
        assert lang == want[0] and share == pytest.approx(want[1], abs=1e-6)


def test_language_held_out_and_mixtures(big):
    docs, _ = big
    model = langid.fit(docs)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(out_of_fold(r.doc_id, 3) == 1 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.97
    by = {r.lang: r.text for r in docs.where("length(text) between 1000 and 3000").collect()}
    lang, share = model.predict([by["de"][:800] + " " + by["es"][:400]])[0]
    assert lang == "de" and 0.5 < share < 0.85


def test_language_counts(docs):
    got = langid.fit(docs)
    want = np.full((got.buckets, 4), langid.SMOOTHING)
    for r in docs.collect():
        if out_of_fold(r.doc_id, 3) != 1 and r.lang is not None:
            np.add.at(want[:, got.languages.index(r.lang)], langid.trigrams(r.text or "", got.buckets), 1)
    assert np.allclose(got.p, want / want.sum(0))


def test_language_odd_rows(odd):
    model = langid.fit(odd)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 6)} == {"und"}
    assert all(r.lang_pred in [*model.languages, "und"] and 0 <= r.score <= 1 for r in rows)
    empty = langid.fit(odd.where(F.lit(False)))
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    assert langid.identify(odd.where(F.lit(False)), model).count() == 0
