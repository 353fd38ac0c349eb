"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Two dictionaries are trained: one on ordinary text, one on what recurs in toxic texts and is
nearly unknown to ordinary ones.  (Trained on whole toxic texts, which are ordinary for the most
part, the second finds three quarters of the toxic documents where one in a hundred others is
flagged; so it is only where nothing recurs that whole texts train it.)  A text is cut into windows of words, long ones and single
words, and each is compressed twice: primed with the ordinary dictionary alone, and primed with
both.  (The first is padded to the same length, so match offsets cost the same and the difference
is what the toxic dictionary saves.)  A window is toxic from a saving that few ordinary windows reach; a logistic curve,
fitted to documents that trained no dictionary, turns the savings of a document's windows into
a probability.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LABEL_FOLDS, fold
from .labelled import SAMPLE_CHARS, labelled_sample

#: Labelled documents used to fit: at most so many of each class.
FIT_DOCS = {1: 3000, 0: 6000}
#: Windows of many words tell how much a passage saves, those of one word which words do.
WIDTHS = (24, 1)
#: Both dictionaries end in these bytes and each window begins with them, so that even a window of
#: one word is long enough to be compressed.
CARRIER = bytes(range(128, 192))
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 2_048
#: Of these classes' documents two thirds train dictionaries, the rest the thresholds.
CALIBRATION = 3
#: Shares of windows that save 1, 2, ... bytes are features up to this saving.
GAINS = 8
#: Words whose saving a Python worker remembers before it starts afresh.
KNOWN_WORDS = 400_000
#: Lengths of beginnings, in bytes; a telling unit stands in so many different places at least,
#: in so many for each toxic document, and so many times as often as in ordinary text.
STEMS = (4, 5, 6, 7, 8, 9)
LEAST_PLACES, LEAST_SHARE, LEAST_RATIO = 6, 0.01, 8
_WORD = re.compile(rb"[^\x00-\x20!-/:-@\[-`{-\x7f]+")


def words(text: str) -> list[bytes]:
    return _WORD.findall(text.lower().encode("utf-8", "replace"))


def window(some: list[bytes]) -> bytes:
    return CARRIER + b" " + b" ".join(some) + b" "


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        compression_level=3, window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=3, target_length=8,
        strategy=zstandard.STRATEGY_BTLAZY2, write_checksum=0, write_content_size=0, write_dict_id=0,
    )
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=data)


def _train(samples: list[bytes], size: int, d: int, k: int) -> bytes:
    """A trained dictionary; what there is, as it is, where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples, d=d, k=k).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def units(word: bytes) -> list[bytes]:
    """What a word may be known by: itself, and its beginnings."""
    return [b" " + word + b" ", *(b" " + word[:n] for n in STEMS if n <= len(word))]


def recurrence(texts: list[str], among: set[bytes] | None = None) -> dict[bytes, int]:
    """For each unit, the pairs of neighbours it was seen between: copied passages count once."""
    number: dict[bytes, int] = {}
    of, place = array("q"), array("q")
    for t in texts:
        w = words(t)
        for before, word, behind in zip([b"", *w], w, [*w[1:], b""], strict=False):
            where = None
            for u in units(word):
                if among is None or u in among:
                    where = where if where is not None else xxhash.xxh3_64_intdigest(before + b" " + behind) >> 31
                    of.append(number.setdefault(u, len(number)))
                    place.append(where)
    if not number:
        return {}
    pairs = np.unique((np.array(of) << 33) ^ (np.array(place) & ((1 << 33) - 1)))
    counts = np.bincount(pairs >> 33, minlength=len(number))
    return {u: int(counts[i]) for u, i in number.items()}


@dataclass
class ToxicityModel:
    """``prior`` alone scores where one of the classes had no document to learn from."""

    ordinary: bytes
    toxic: bytes
    thresholds: list[int]
    weights: np.ndarray
    prior: float

    def __post_init__(self) -> None:
        self._pair, self._known = None, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pair": None, "_known": {}}

    def savings(self, w: list[bytes], width: int) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window of ``width`` of the words."""
        if self._pair is None:
            ends = bytes(len(self.toxic)) + CARRIER, self.toxic + CARRIER
            self._pair = _compressor(self.ordinary + ends[0]), _compressor(self.ordinary + ends[1])
        a, b = self._pair[0].compress, self._pair[1].compress
        if width > 1:
            cut = [window(w[i : i + width]) for i in range(0, len(w), width)]
            return np.array([len(a(x)) - len(b(x)) for x in cut], np.int64)
        known = self._known
        if len(known) > KNOWN_WORDS:
            known.clear()
        out = []
        for x in w:
            gain = known.get(x)
            if gain is None:
                one = window([x])
                gain = known[x] = len(a(one)) - len(b(one))
            out.append(gain)
        return np.array(out, np.int64)

    def features(self, text: str) -> np.ndarray:
        out, w = [], words(text)
        for width, threshold in zip(WIDTHS, self.thresholds, strict=True):
            s = self.savings(w, width)
            if not len(s):
                return np.zeros(len(WIDTHS) * (5 + GAINS))
            hit = int((s >= threshold).sum())
            # a word's share is small: scaled to the share of a whole window
            shares = (s[:, None] >= np.arange(1, GAINS + 1)).mean(0) * WIDTHS[0] / width
            out += [s.mean() * WIDTHS[0] / width, np.maximum(s, 0).mean() * WIDTHS[0] / width, hit / len(s) * WIDTHS[0] / width]
            out += [min(int(s.max()), 12) / 4, np.log1p(hit), *shares]
        return np.array(out)

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return self.prior
        z = self.weights[0] + float(self.features(text or "") @ self.weights[1:])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights by Newton's method; the first is the intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(a.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_texts(sample: list[tuple[str, int]]) -> ToxicityModel:
    """A model from pairs (text, label); repeats of a text count once."""
    seen = dict(sample)
    prior = (sum(seen.values()) + 0.5) / (len(seen) + 1)
    by = {y: [t for t, z in seen.items() if z == y] for y in (0, 1)}
    if min(map(len, by.values())) < 2:
        return ToxicityModel(b"", b"", [], np.zeros(0), prior)
    train = {y: [t for i, t in enumerate(ts) if i % CALIBRATION] or ts for y, ts in by.items()}
    held = {y: [t for i, t in enumerate(ts) if not i % CALIBRATION] for y, ts in by.items()}
    n0, n1 = len(train[0]), len(train[1])
    found = {w: c for w, c in recurrence(train[1]).items() if c >= max(LEAST_PLACES, LEAST_SHARE * n1)}
    known = recurrence(train[0], set(found))
    recurs = {w for w, c in found.items() if c / n1 > LEAST_RATIO * (known.get(w, 0) + 0.5) / n0}
    tell = [b" " + b" ".join(own) + b" " for t in train[1] if (own := [w for w in words(t) if any(u in recurs for u in units(w))])]
    tell = tell or [b" " + b" ".join(words(t)) + b" " for t in train[1]]
    ordinary = _train([b" " + b" ".join(words(t)) + b" " for t in train[0]], ORDINARY_BYTES, 8, 16)
    toxic = _train(tell, TOXIC_BYTES, 6, 16)
    model = ToxicityModel(ordinary, toxic, [], np.zeros(0), prior)
    for width in WIDTHS:
        usual = np.concatenate([model.savings(words(t), width) for t in held[0]] + [np.zeros(1, np.int64)])
        model.thresholds.append(max(2, int(np.quantile(usual, 1 - 0.01 / np.sqrt(WIDTHS[0] / width))) + 1))
    texts, y = held[0] + held[1], np.array([0.0] * len(held[0]) + [1.0] * len(held[1]))
    model.weights = _logistic(np.array([model.features(t) for t in texts]), y)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = FIT_DOCS, max_chars: int = SAMPLE_CHARS) -> ToxicityModel:
    """A model from ``labelled_sample`` by ``labels.toxic``; without both classes it scores the prior."""
    return fit_texts(labelled_sample(docs, labels, "toxic", per_class, max_chars))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row and its whole text.

    Null and empty texts have no window and get the curve's value for no saving; texts of any length
    are cut into windows whole.  Repeated rows each keep a row; null ids count as held out; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries, under 20 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = [m.score(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), LABEL_FOLDS) == 0).alias("held_out"), "text")
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
