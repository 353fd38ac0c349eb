"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

Texts are cut where no piece can cross: before runs of the space mark, and around characters
that only stand alone.  Distinct words of one length advance together, a character at a time:
hashes of the substrings that end there probe the sorted keys of the pieces, and a vectorised
maximum over their lengths stores the back pointer.

For a unigram model the maximum is over summed scores.  A byte-pair model has no such sums: its
result is what merging best pairs first leaves.  But merges of two neighbouring tokens' spans
do not depend on what lies further off, so a segmentation is that result if and only if each
two neighbours, encoded alone, come out as themselves, and of the pieces that end at a place
just one continues the result for its prefix.  The search admits a piece only behind a token it
is stable with; such pairs are worked out once by merging their characters and remembered.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A public model that is part of the machine, not of this repository.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Fixed numbers of the model file's format: message fields and kinds of pieces.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

_BASE = 0x9E3779B97F4A7C15 | 1
_ALL = (1 << 64) - 1
_START = -1
#: Words and pairs remembered by one Python worker before it starts afresh.
KEPT_WORDS, KEPT_PAIRS = 300_000, 1_000_000
_SIEVE, _RECENT = 1 << 19, 1 << 20
_WORDS_AT_ONCE = 20_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    kind: int
    dummy_prefix: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        pieces, scores, kinds, model_kind, prefix = [], [], [], UNIGRAM, True
        for number, value in _fields(data):
            if number == PIECES:
                own = dict(_fields(value))
                pieces.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == TRAINER:
                model_kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == NORMALIZER:
                own = dict(_fields(value))
                prefix = bool(own.get(3, 1))
                if own.get(2) or own.get(4, 1):
                    raise ValueError("only models without character maps that keep all spaces are supported")
        return cls(pieces, np.array(scores), np.array(kinds), model_kind, prefix)

    def __post_init__(self) -> None:
        self._ready = False

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("pieces", "scores", "kinds", "kind", "dummy_prefix")} | {"_ready": False}

    # Derived tables, built once in each worker.
    def _prepare(self) -> None:
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED) and self.pieces[i]]
        self.number = {self.pieces[i]: i for i in usable}
        self.bytes_of = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.longest = max(map(len, self.number), default=1)
        keys = np.array([self._key(self.pieces[i]) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable, np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.sieve = np.zeros(_SIEVE, bool)  # which low bits of a hash occur at all
        self.sieve[(self.keys & np.uint64(_SIEVE - 1)).astype(np.int64)] = True
        self.powers = np.array([pow(_BASE, i, 1 << 64) for i in range(self.longest + 1)], np.uint64)
        joined = {c for p in self.number if len(p) > 1 for c in p} - {MARK}
        crosses = any(MARK in p.lstrip(MARK) for p in self.number)
        letters = "[" + "".join(map(re.escape, sorted(joined))) + (MARK if crosses else "") + "]" if joined else "(?!)"
        self.unit = re.compile(f"{MARK}*{letters}+|{MARK}+|.", re.S)
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.raw = raw
        self.pair_keys, self.pair_good = np.zeros(0, np.int64), np.zeros(0, bool)
        self.recent, self.recent_good = np.full(_RECENT, -1, np.int64), np.zeros(_RECENT, bool)
        self._forget()
        self._ready = True

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _key(text: str) -> int:
        h = 0
        for c in text:
            h = (h * _BASE + ord(c) + 1) & _ALL
        return h

    def _text_of(self, token: int) -> str:
        return self.pieces[token] if token < len(self.pieces) else chr(token - len(self.pieces))

    def merge(self, text: str) -> list[str]:
        """Byte-pair encoding as defined: merge the pair of best score, the leftmost of equals."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                piece = self.number.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best[0]):
                    best = self.scores[piece], i
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens, joined and encoded alone, comes out as itself."""
        keys = left << 32 | right
        slot = (keys * 0x9E3779B1 ^ keys >> 29) & (_RECENT - 1)
        good = self.recent_good[slot]
        new = np.flatnonzero(self.recent[slot] != keys)
        if len(new):
            good[new] = self._looked_up(keys[new])
            self.recent[slot[new]] = keys[new]
            # of several pairs for one slot the last stays, in both tables
            self.recent_good[slot[new]] = good[new]
        return good

    def _looked_up(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        known = self.pair_keys[at] == keys if len(self.pair_keys) else np.zeros(len(keys), bool)
        if known.all():
            return self.pair_good[at]
        fresh = np.unique(keys[~known])
        good = np.zeros(len(fresh), bool)
        for i, key in enumerate(fresh.tolist()):
            a, b = self._text_of(key >> 32), self._text_of(key & 0xFFFFFFFF)
            good[i] = self.merge(a + b) == [a, b]
        out = np.zeros(len(keys), bool)
        out[known] = self.pair_good[at[known]]
        out[~known] = good[np.searchsorted(fresh, keys[~known])]
        if len(self.pair_keys) > KEPT_PAIRS:
            self.pair_keys, self.pair_good = fresh, good
        else:
            every = np.concatenate([self.pair_keys, fresh])
            order = np.argsort(every, kind="stable")
            self.pair_keys, self.pair_good = every[order], np.concatenate([self.pair_good, good])[order]
        return out

    def _viterbi(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words, one a row, one word's after another's, and how many each has.

        Places beyond a word's length hold zeros.
        """
        n, width = points.shape
        hashes = np.zeros((n, width + 1), np.uint64)
        base = np.uint64(_BASE)
        for j in range(width):
            hashes[:, j + 1] = hashes[:, j] * base + points[:, j] + np.uint64(1)
        last = np.full((n, width + 1), _START, np.int64)  # token of the best segmentation that ends here
        back = np.zeros((n, width + 1), np.int64)
        best = np.zeros((n, width + 1))
        rows = np.arange(n)
        floor = float(self.scores.min(initial=0)) - 10
        for j in range(1, width + 1):
            most = min(j, self.longest)
            sub = hashes[:, j][:, None] - hashes[:, j - most : j][:, ::-1] * self.powers[1 : most + 1]
            token = np.full(sub.shape, -1)
            maybe = np.nonzero(self.sieve[(sub & np.uint64(_SIEVE - 1)).view(np.int64)])
            probe = sub[maybe]
            at = np.searchsorted(self.keys, probe)
            at[at == len(self.keys)] = 0
            token[maybe] = np.where(self.keys[at] == probe, self.ids[at], -1) if len(self.keys) else -1
            alone = token[:, 0] < 0  # a character without a piece of its own stands for itself
            token[alone, 0] = len(self.pieces) + points[alone, j - 1].astype(np.int64)
            score = np.full(token.shape, -np.inf)
            r, k = np.nonzero(token >= 0)
            before = last[r, j - 1 - k]
            if self.kind == BPE:
                fine = before == _START
                rest = np.flatnonzero(~fine)
                fine[rest] = self._stable(before[rest], token[r[rest], k[rest]])
                score[r[fine], k[fine]] = 0.0
            else:
                own = np.where(token[r, k] < len(self.pieces), self.scores[np.minimum(token[r, k], len(self.pieces) - 1)], floor)
                score[r, k] = best[r, j - 1 - k] + own
            pick = score.argmax(1)
            best[:, j], back[:, j] = score[rows, pick], pick + 1
            last[:, j] = token[rows, pick]
        found = np.zeros((n, width), np.int64)
        count, place = np.zeros(n, np.int64), lengths.copy()
        while (live := np.flatnonzero(place > 0)).size:
            found[live, count[live]] = last[live, place[live]]
            count[live] += 1
            place[live] -= back[live, place[live]]
        flat = found[:, ::-1][np.arange(width) >= (width - count)[:, None]]
        if (flat < len(self.pieces)).all():
            return flat, count
        parts = [self._expand(p) for p in np.split(flat, np.cumsum(count)[:-1])]
        return np.concatenate(parts), np.array(list(map(len, parts)))

    def _expand(self, tokens: np.ndarray) -> np.ndarray:
        """Characters without a piece become their bytes, or the unknown piece."""
        if (tokens < len(self.pieces)).all():
            return tokens
        out: list[int] = []
        for t in tokens.tolist():
            if t < len(self.pieces):
                out.append(t)
            elif self.bytes_of:
                out += [self.bytes_of[b] for b in chr(t - len(self.pieces)).encode()]
            else:
                out.append(self.unknown)
        return np.array(out, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        """Encode words not met before and remember them."""
        fresh.sort(key=len)
        sizes = np.array([len(w) for w in fresh])
        # words of up to 32 characters go by their length, longer ones share a width within an eighth
        step = np.maximum(1, 2 ** np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1))) - 3)).astype(int)
        widths = np.where(sizes <= 32, sizes, -(-sizes // step) * step)
        found: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        lo = 0
        while lo < len(fresh):
            hi = int(np.searchsorted(widths, widths[lo], "right"))
            hi = min(hi, lo + max(1, min(_WORDS_AT_ONCE, 2_000_000 // int(widths[lo]))))
            line = np.frombuffer("".join(fresh[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32)
            points = np.zeros((hi - lo, widths[lo]), np.uint64)
            points[np.arange(widths[lo]) < sizes[lo:hi, None]] = line
            tokens, count = self._viterbi(points, sizes[lo:hi])
            found.append(tokens)
            counts.append(count)
            lo = hi
        new = np.concatenate(counts)
        starts = len(self.flat) + np.concatenate([[0], np.cumsum(new)[:-1]])
        for i, w in enumerate(fresh):
            self.words[w] = len(self.starts) + i
        self.flat = np.concatenate([self.flat, *found]).astype(np.int32)
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, new])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, as the model's own library gives them."""
        if not self._ready:
            self._prepare()
        if len(self.words) > KEPT_WORDS:
            self._forget()
        head = MARK if self.dummy_prefix else ""
        cut = [self.unit.findall(head + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = {u for units in cut for u in units if u not in self.words}
        if fresh:
            self._learn(list(fresh))
        out = []
        for units in cut:
            at = np.fromiter(map(self.words.__getitem__, units), np.int64, len(units))
            sizes = self.sizes[at]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            place = np.arange(total) + np.repeat(self.starts[at] - (ends - sizes), sizes)
            out.append(self.flat[place])
        return out

    def decode(self, ids: np.ndarray) -> str:
        if not self._ready:
            self._prepare()
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def load(path: str = MODEL) -> PieceModel:
    """Read on the driver; executors get the model by broadcast."""
    with open(path, "rb") as f:
        return PieceModel.parse(f.read())


_BATCH_CHARS = 2 << 20
#: Rows whose tokens are held at once by one Python worker.
ROWS_AT_ONCE = 1000


def _batches(model: PieceModel, texts: list[str]) -> Iterator[np.ndarray]:
    """Encode in groups of bounded size, so that one batch of rows never holds all its words."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _BATCH_CHARS or i == len(texts) - 1:
            yield from model.encode(texts[lo : i + 1])
            lo, size = i + 1, 0


def _mapped(docs: DataFrame, model: PieceModel, keep: list[str], make, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the pieces, about a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            n = whole.num_columns - 1
            for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(lo, ROWS_AT_ONCE)
                own = make(shared.value, [x if x is not None else "" for x in batch.column(n).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *own.values()], [*batch.schema.names[:n], *own])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def tokenised(docs: DataFrame, model: PieceModel, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row with ``n_tokens`` and ``tokens`` (array of int) of its whole text.

    Null and empty texts have no tokens; repeated rows each keep a row; an empty table gives none.
    """

    def make(m: PieceModel, texts: list[str]) -> dict[str, pa.Array]:
        ids = list(_batches(m, texts))
        ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
        return {"n_tokens": pa.array(np.diff(ends).astype(np.int32)), "tokens": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens int, tokens array<int>"
    return _mapped(docs, model, keep, make, schema)


def round_trip(docs: DataFrame, model: PieceModel) -> DataFrame:
    """``(doc_id, n_tokens, tokens_xxh64, same)``: a digest of each text's tokens (as 32-bit
    little-endian numbers), and whether decoding them gives the text again (null: as empty).  A text that holds the
    space mark itself does not: the mark becomes a space."""

    def make(m: PieceModel, texts: list[str]) -> dict[str, pa.Array]:
        n, digest, same = [], [], []
        for t, ids in zip(texts, _batches(m, texts), strict=True):
            n.append(len(ids))
            digest.append(xxhash.xxh64_hexdigest(ids.astype("<i4").tobytes()))
            same.append(m.decode(ids) == t)
        return {"n_tokens": pa.array(n, pa.int32()), "tokens_xxh64": pa.array(digest, pa.string()), "same": pa.array(same, pa.bool_())}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _mapped(rows, model, ["doc_id"], make, "doc_id long, n_tokens int, tokens_xxh64 string, same boolean")


def decoded(rows: DataFrame, model: PieceModel, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``text`` decoded from ``tokens`` (null: empty)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            texts = [shared.value.decode(np.array(x or [], np.int64)) for x in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], [*batch.schema.names[:n], "text"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "tokens").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string")
