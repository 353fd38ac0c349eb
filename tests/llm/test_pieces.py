import random

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.load()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def same(model, library, texts):
    for t, got, want in zip(texts, model.encode(texts), library.encode(texts, num_threads=1), strict=True):
        assert got.tolist() == list(want), t
        assert model.decode(got) == library.decode(list(want))


def test_documents(model, library, docs):
    texts = [r.text for r in docs.collect()]
    same(model, library, texts)
    assert [model.decode(i) for i in model.encode(texts)] == texts


def test_hard_texts(model, library):
    rng = random.Random(1)
    signs = "abcdefghijklmnopqrstuvwxyz ABCé,.;:!?'\"()0123 \n한中Ж▁"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    texts += ["".join(rng.choice("ab ▁") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    texts += ["", " ", "a" * 700, " " * 75 + "x" + " " * 33, "<s> </s> <0x0A>", "1234567890" * 30, "x" * 20000, "日本語" * 500]
    same(model, library, texts)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    model, library = test_any_text.pair
    same(model, library, [text])


test_any_text.pair = (pieces.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL))


def test_forgets_and_goes_on(library, docs, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 50)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 100)
    fresh = pieces.load()
    for r in docs.limit(20).collect():
        same(fresh, library, [r.text])


def unigram():
    words = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "aba": -3.2, "▁a": -2.2, "ba": -3.9, "bab": -4.0}
    names = ["<unk>", *words]
    kinds = np.array([pieces.UNKNOWN] + [pieces.NORMAL] * len(words))
    return pieces.PieceModel(names, np.array([0.0, *words.values()]), kinds, pieces.UNIGRAM)


def test_unigram_against_all_segmentations():
    model = unigram()

    def best(s):
        if not s:
            return 0.0, []
        options = []
        for n in range(1, min(3, len(s)) + 1):
            if s[:n] in model.pieces[1:]:
                score, rest = best(s[n:])
                options.append((score + model.scores[model.pieces.index(s[:n])], [s[:n], *rest]))
        return max(options)

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 10))) for _ in range(200)]
    for t, ids in zip(texts, model.encode(texts), strict=True):
        got = [model.pieces[i] for i in ids]
        s = "▁" + t.replace(" ", "▁")
        assert "".join(got) == s
        assert sum(model.scores[i] for i in ids) == pytest.approx(best(s)[0])
    assert [model.pieces[i] for i in model.encode(["ax"])[0]] == ["▁a", "<unk>"]


def test_frames(model, odd, library):
    rows = pieces.tokenised(odd, model, ["doc_id", "lang"])
    assert rows.columns == ["doc_id", "lang", "n_tokens", "tokens"]
    text = {r.doc_id: r.text for r in odd.collect()}
    for r in rows.collect():
        assert r.tokens == library.encode(text[r.doc_id] or "") and r.n_tokens == len(r.tokens)
    back = {r.doc_id: r.text for r in pieces.decoded(rows, model, ["doc_id"]).collect()}
    trips = {r.doc_id: r for r in pieces.round_trip(odd, model).collect()}
    for i, t in text.items():
        assert trips[i].same == (back[i] == (t or "")) == ("▁" not in (t or ""))
        ids = np.array(library.encode(t or ""), "<i4")
        assert trips[i].tokens_xxh64 == xxhash.xxh64_hexdigest(ids.tobytes())
    assert pieces.round_trip(odd.where(F.lit(False)), model).count() == 0
