"""Document quality: random-indexing word vectors, pooled, under a two-layer network.

Every token has a fixed sparse index vector drawn from its hash.  A token's word vector is the
sum of the index vectors of its neighbours over the fitting sample, scaled to unit length, plus
its own index vector.  A text's tokens are its words and what their look tells: case, runs of
signs before and behind, a word or line said again.  A document is the mean of its tokens'
vectors; a network of one hidden layer scores it, and a temperature, fitted to documents the
network has not seen, calibrates the probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LABEL_FOLDS, fold, fresh, release
from .labelled import SAMPLE_CHARS, labelled_sample

FIT_DOCS = {0: 2500, 1: 3500}
DIM, NONZERO, CONTEXT = 48, 6, 2
#: Words of the fitting sample with vectors of their own, at most.
VOCABULARY = 20_000
HIDDEN, EPOCHS, RATE = 32, 25, 3e-3
#: Pairs of neighbours whose vectors are added up at once.
PAIRS = 1 << 14
#: Words that a Python worker remembers before it starts afresh, and the length of the longest such.
_KEPT_WORDS, _KEPT_CHARS = 200_000, 64


def index_vector(token: str) -> np.ndarray:
    rng = np.random.default_rng(xxhash.xxh64_intdigest(token.encode("utf-8", "replace"), 11))
    v = np.zeros(DIM, np.float32)
    v[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO) / np.sqrt(NONZERO)
    return v


def parts(word: str) -> tuple[str, str, str]:
    """Signs before, the word itself, signs behind: each end is looked at once."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[:a], word[a:b], word[b:]


def look(word: str) -> list[str]:
    """What a word's look tells, as tokens: signs before it and behind it, its case and kind."""
    before, core, behind = parts(word)
    out = [f"<before {before[:3]}>"] if before else []
    if core:
        kind = "digits" if core.isdigit() else "mixed" if any(map(str.isdigit, core)) else "up" if core.isupper() and len(core) > 1 else "title" if core[0].isupper() else "low"
        out.append(f"<{kind}>")
    if behind:
        out.append(f"<behind {behind[:3]}>")
    return out


def core(word: str) -> str:
    return parts(word)[1].lower()


def repeats(words: list[str], text: str) -> tuple[int, int]:
    """Words equal to the one before, and lines seen before in the text."""
    lines = text.split("\n")
    return sum(map(eq, words[1:], words)), len(lines) - len(set(lines))


@dataclass
class QualityModel:
    """``vectors`` by token; ``net`` is empty where a class had no document, and ``prior`` scores."""

    vectors: dict[str, np.ndarray]
    net: list[np.ndarray]
    temperature: float
    prior: float

    def __post_init__(self) -> None:
        self._rows, self._kept = None, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rows": None, "_kept": {}}

    def vector(self, token: str) -> np.ndarray:
        v = self.vectors.get(token)
        return index_vector(token) if v is None else v

    def _row(self, word: str) -> int:
        """Number of the row with the summed vectors of a word's tokens and, last, their count."""
        own = core(word)
        tokens = look(word) + [own if own in self.vectors else "<rare>"]
        key = " ".join(tokens)
        at = self._keys.get(key)
        if at is None:
            at = self._keys[key] = len(self._keys)
            if at == len(self._rows):
                self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
            self._rows[at] = np.append(sum(map(self.vector, tokens)), len(tokens))
        return at

    def pooled(self, text: str) -> np.ndarray:
        """Mean vector of the text's tokens, and the logarithm of its words."""
        if self._rows is None:
            self._rows, self._keys = np.zeros((1024, DIM + 1), np.float32), {}
        if len(self._keys) > _KEPT_WORDS:
            self._rows, self._keys, self._kept = np.zeros((1024, DIM + 1), np.float32), {}, {}
        if len(self._kept) > _KEPT_WORDS:
            self._kept = {}
        words, kept = text.split(), self._kept
        at = []
        for w in words:
            i = kept.get(w)
            if i is None:
                i = self._row(w)
                if len(w) <= _KEPT_CHARS:
                    kept[w] = i
            at.append(i)
        total = np.zeros(DIM + 1, np.float64)
        for i in range(0, len(at), 1 << 14):
            total += self._rows[at[i : i + (1 << 14)]].sum(0, dtype=np.float64)
        again, lines = repeats(words, text)
        total[:DIM] += again * self.vector("<again>") + lines * self.vector("<line again>")
        total[DIM] += again + lines
        return np.append(total[:DIM] / max(total[DIM], 1), np.log1p(len(words)) / 10).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.net
        return np.maximum((x - mean) / scale @ w1 + b1, 0) @ w2 + b2

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.net:
            return np.full(len(texts), self.prior)
        x = np.array([self.pooled(t or "") for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def word_vectors(texts: list[str]) -> dict[str, np.ndarray]:
    """Random indexing over the sample: one vector for each frequent word and each look."""
    streams, first, kept = [], {}, {}
    for t in texts:
        own: list[int] = []
        for w in t.split():
            ids = kept.get(w)
            if ids is None:
                ids = [first.setdefault(x, len(first)) for x in filter(None, (*look(w), core(w)))]
                if len(kept) < _KEPT_WORDS:
                    kept[w] = ids
            own += ids
        streams.append(np.array(own, np.int32))
    tokens = np.concatenate([*streams, np.zeros(0, np.int32)])
    counts = np.bincount(tokens, minlength=len(first))
    known = sorted((w for w, i in first.items() if counts[i] >= 5), key=lambda w: (-counts[first[w]], w))[:VOCABULARY]
    number = {w: i for i, w in enumerate(["<rare>", *known])}
    place = np.zeros(max(len(first), 1), np.int64)  # of every token seen; the rare ones share row 0
    place[[first[w] for w in known]] = np.arange(1, len(known) + 1)
    del tokens, counts, first, kept  # the driver's memory: they hold every word of the sample
    index = np.array([index_vector(w) for w in number])
    context = np.zeros_like(index)
    for i in range(0, len(streams), 250):
        for gap in range(1, CONTEXT + 1):
            pairs = [place[s[:-gap]] * len(number) + place[s[gap:]] for s in streams[i : i + 250] if len(s) > gap]
            both, times = np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)]), return_counts=True)
            left, right = both // len(number), both % len(number)
            for to, by in ((left, right), (right, left)):
                for k in range(0, len(both), PAIRS):
                    part = slice(k, k + PAIRS)
                    np.add.at(context, to[part], index[by[part]] * times[part, None])
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return {w: index[i] + context[i] / max(norm[i, 0], 1e-9) for w, i in number.items()}


def _train_net(x: np.ndarray, y: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Adam on the log loss; inputs scaled to unit variance."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    p = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(())]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for i in range(0, len(z), 64):
            b = order[i : i + 64]
            h = np.maximum(z[b] @ p[0] + p[1], 0)
            out = h @ p[2] + p[3]
            e = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[b]) / len(b)
            back = np.outer(e, p[2]) * (h > 0)
            grads = [z[b].T @ back + 1e-4 * p[0], back.sum(0), h.T @ e + 1e-4 * p[2], e.sum()]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return [mean, scale, *p]


def fit_texts(sample: list[tuple[str, int]]) -> QualityModel:
    """A model from pairs (text, label); repeats of a text count once."""
    seen = dict(sample)
    texts, y = list(seen), np.array(list(seen.values()), float)
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    if len(set(y.tolist())) < 2:
        return QualityModel({}, [], 1.0, prior)
    model = QualityModel(word_vectors(texts), [], 1.0, prior)
    x = np.array([model.pooled(t) for t in texts])
    held = np.arange(len(texts)) % 5 == 0
    model.net = _train_net(x[~held], y[~held])
    z = model.logits(x[held])
    loss = lambda t: np.mean(np.logaddexp(0, np.where(y[held] > 0, -z, z) / t))
    model.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss)) if held.any() else 1.0
    model._rows, model._kept = None, {}  # what fitting left behind
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = FIT_DOCS, max_chars: int = SAMPLE_CHARS) -> QualityModel:
    """A model from ``labelled_sample`` by ``labels.quality``; without both classes it scores the prior."""
    model = fit_texts(labelled_sample(docs, labels, "quality", per_class, max_chars))
    release(docs.sparkSession)  # the sample's memory, on the driver
    return model


def scored(docs: DataFrame, model: QualityModel, name: str) -> DataFrame:
    """``docs`` with one more column: the probability of good quality of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY vectors, some 4 MB

    @F.pandas_udf("double")
    def probability(text):
        import pandas as pd

        return pd.Series(shared.value.score(text.tolist()), dtype="float64")

    return docs.withColumn(name, probability(F.col("text")))


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row; null and empty texts pool to zeros.

    Texts of any length are pooled whole, a stretch of words at a time.  Repeated rows each keep a
    row; null ids count as held out; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), LABEL_FOLDS) == 0).alias("held_out"), "text")
    out = scored(rows, model, "score").drop("text")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with its own columns."""
    name = fresh(docs, "__score")
    return scored(docs, model, name).where(F.col(name) >= threshold).drop(name)
