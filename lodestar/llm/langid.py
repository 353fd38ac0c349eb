"""Language identification as inference of a mixture of languages.

Each language is a distribution over hashed character trigrams, counted over all documents that
may teach.  A document is a mixture: expectation-maximisation estimates the share of each
language from the likelihoods of its trigrams.  The set of languages is chosen by penalised
likelihood (half the logarithm of the trigrams for each free share) among the nested sets of
those with the largest shares; the language with the largest share in the chosen set is the
prediction, and that share its score.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LANG_FOLDS, fold

#: Trigram buckets, whatever the number of languages: a model takes 256 KB for each of them.
BUCKETS = 1 << 15
#: Values of ``lang`` that a model is broadcast for (256 MB); more are an error.
MOST_LANGUAGES = 1024
ROUNDS, SMOOTHING = 12, 0.5
UNDETERMINED = "und"
#: Likelihoods worked on at once: trigrams times languages.
_CHUNK = 1 << 21
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def trigrams(text: str, buckets: int) -> np.ndarray:
    """Buckets of the trigrams of the text's letters in lower case, runs of others one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter_table()[points]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    points = np.where(is_letter, points, 32)
    kept = is_letter.copy()
    kept[1:] |= is_letter[:-1]
    line = np.concatenate([[32], points[kept], [32]]).astype(np.uint64)
    mixed = line[:-2] * np.uint64(0x9E3779B97F4A7C15) + line[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + line[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) & (buckets - 1)


@dataclass
class LanguageModel:
    languages: list[str]
    #: probability of each bucket (rows) in each language (columns)
    p: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.p)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.languages:
            return out
        wait, size = [], 0
        for i, t in enumerate(texts):
            grams = trigrams(t or "", self.buckets)
            if len(grams):
                counts = np.bincount(grams, minlength=self.buckets)
                at = np.flatnonzero(counts)
                wait.append((i, at, counts[at]))
                size += len(at)
            if size * len(self.languages) >= _CHUNK or (i == len(texts) - 1 and wait):
                for (k, _, _), found in zip(wait, self._mixtures([w[1] for w in wait], [w[2] for w in wait]), strict=True):
                    out[k] = found
                wait, size = [], 0
        if wait:
            for (k, _, _), found in zip(wait, self._mixtures([w[1] for w in wait], [w[2] for w in wait]), strict=True):
                out[k] = found
        return out

    def _mixtures(self, grams: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple[str, float]]:
        sizes = np.array([len(g) for g in grams])
        like, weight = self.p[np.concatenate(grams)], np.concatenate(counts).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        total = np.add.reduceat(weight, starts)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        penalty = 0.5 * np.log(total)

        def em(like, weight, starts, doc, total, share):
            """Shares after ROUNDS, and the log likelihood of those before the last."""
            for _ in range(ROUNDS):
                part = like * share[doc]
                whole = part.sum(1)
                share = np.add.reduceat(part * (weight / whole)[:, None], starts, axis=0) / total[:, None]
            return share, np.add.reduceat(weight * np.log((like * share[doc]).sum(1)), starts)

        n = len(self.languages)
        share, full = em(like, weight, starts, doc, total, np.full((len(sizes), n), 1 / n))
        order = np.argsort(-share, axis=1, kind="stable")
        alone = np.add.reduceat(weight * np.log(like[np.arange(len(doc)), order[doc, 0]]), starts)
        best, found = alone.copy(), np.zeros_like(share)
        found[np.arange(len(sizes)), order[:, 0]] = 1
        # no set of two or more can win where even the full mixture's likelihood does not pay for two
        open_ = np.flatnonzero(full - penalty > alone)
        for k in range(2, n + 1):
            if not len(open_):
                break
            rows = np.isin(doc, open_)
            place = np.searchsorted(open_, doc[rows])
            at = np.concatenate([[0], np.cumsum(sizes[open_])[:-1]])
            seed = np.zeros((len(open_), n))
            np.put_along_axis(seed, order[open_, :k], 1 / k, axis=1)
            got, ll = em(like[rows], weight[rows], at, place, total[open_], seed)
            ll = ll - (k - 1) * penalty[open_]
            win = ll > best[open_]
            best[open_[win]], found[open_[win]] = ll[win], got[win]
            open_ = open_[full[open_] - k * penalty[open_] > best[open_]]
        top = found.argmax(1)
        return [(self.languages[t], min(1.0, float(s))) for t, s in zip(top, found[np.arange(len(top)), top], strict=True)]


def fit(docs: DataFrame) -> LanguageModel:
    """Counts over all rows with text and language outside fold 1 of ``LANG_FOLDS``.

    Each task sums its own trigrams; what comes to the driver is one table of languages by
    buckets.  More than MOST_LANGUAGES languages raise ``ValueError``.
    """
    taught = docs.where((fold(F.col("doc_id"), LANG_FOLDS) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = sorted(r.lang for r in taught.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    buckets = BUCKETS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                own = sums.setdefault(lang.as_py(), np.zeros(buckets, np.int64))
                own += np.bincount(trigrams(text.as_py(), buckets), minlength=buckets)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"]
            )

    counted = taught.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets at most
    table = np.full((buckets, len(languages)), SMOOTHING)
    if languages:
        column = np.searchsorted(np.array(languages), np.array(rows.column("lang").to_pylist(), dtype=str))
        np.add.at(table, (rows.column("bucket").to_numpy(), column), rows.column("n").to_numpy())
    return LanguageModel(languages, table / table.sum(0))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row and its whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if no row
    taught a language.  Texts of any length are read whole.  Repeated rows each keep a row; other columns are ignored; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 256 KB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), LANG_FOLDS) == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
