"""Language-model scores by cross-entropy difference.

Two bigram models, of a target (documents labelled good) and of the background (all documents),
are matched: same order, same smoothing, one vocabulary.  A word's probability after another is a
share of the bigram's relative frequency, the rest the word's own, add-one smoothed; after a word
that a model has not seen it is the word's own alone.  Each text ends in a mark that is predicted
like a word, so both models' probabilities sum to one after every history.  A document's score is
the mean over its predictions of the target's loss less the background's: the lower, the more it
reads like the target.

The vocabulary holds the words that make up one in ``SHARE`` of all tokens or more (and come
twice): at most SHARE words, whatever the corpus, so it can be broadcast.  Other words are one
unknown word.  Bigram counts grow with the corpus and are never brought together.  Those of
the HEAD most frequent words, which hold most occurrences, are a small table.  All others are dealt
by bigram: each task gets every occurrence of its bigrams with the document it stands in, counts
them and sums their losses for each document at once, so counts need no journey of their own.
Occurrences travel packed, a few bytes each.  Losses are whole multiples of 2^-20 nats, so sums
do not depend on how tasks were cut.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist

#: A word of the vocabulary makes up at least one in so many tokens.
SHARE = 1 << 20
#: Words whose bigrams with each other are one table; any other bigram holds one in HEAD tokens at most.
HEAD = 512
BIGRAM_SHARE = 0.6
#: Numbers of the unknown word and of a text's edge (what comes before its first word and after its last).
UNKNOWN, EDGE = 0, 1
UNIT = 1 << 20
#: Tokens that a task sorts at once, and bytes of a text that are cut into words at once.
FLUSH, SLICE = 1 << 21, 1 << 20
#: Tokens that are dealt to one group on average, and documents of a chunk, at most.
GROUP_TOKENS, CHUNK_DOCS = 1 << 22, 1 << 21
#: Ids that are broadcast, at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
_SEED = 5
_KEPT = 300_000
_SPACE = re.compile(rb"[\x09-\x0d ]")


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, _SEED)
    return h - (1 << 64) if h >= 1 << 63 else h


def words(body: bytes) -> Iterator[list[bytes]]:
    """The text's words, some at a time: runs without ASCII white space, A-Z in lower case."""
    lo = 0
    while lo < len(body):
        cut = _SPACE.search(body, lo + SLICE) if lo + SLICE < len(body) else None
        hi = cut.start() if cut else len(body)
        yield body[lo:hi].lower().split()
        lo = hi


class Known(dict):
    """What ``make`` gives for a word, remembered; starts afresh when it has grown too large."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes) -> int:
        if len(self) > _KEPT:
            self.clear()
        out = self.make(word)
        if len(word) < 64:
            self[word] = out
        return out


@dataclass
class Models:
    """The vocabulary, and both models' counts by number of the word: rows target, background."""

    hashes: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray
    documents: np.ndarray

    @property
    def size(self) -> int:
        return self.counts.shape[1]

    @property
    def head(self) -> int:
        return min(self.size, HEAD + 2)

    def __post_init__(self) -> None:
        self._table: dict[int, int] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def number(self, word: bytes) -> int:
        if self._table is None:  # some 100 bytes for each word of the vocabulary
            self._table = dict(zip(self.hashes.tolist(), self.numbers.tolist(), strict=True))
        return self._table.get(word_hash(word), UNKNOWN)

    def losses(self, h: np.ndarray, w: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Both models' losses in UNITs of bigrams (h, w) that were counted ``pairs`` (2 x n) times."""
        own = (self.counts[:, w] + 1) / (self.counts.sum(1) + self.size)[:, None]
        seen = self.counts[:, h]
        joint = np.where(seen > 0, BIGRAM_SHARE * pairs / np.maximum(seen, 1) + (1 - BIGRAM_SHARE) * own, own)
        return np.rint(-np.log(joint) * UNIT).astype(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    counted = F.coalesce("counted", F.lit(True)) if "counted" in docs.columns else F.lit(True)
    good = F.coalesce("target", F.lit(False)) & counted
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"), good.alias("good"), counted.alias("counted")
    )


def fit(docs: DataFrame) -> Models:
    """Vocabulary and word counts over all rows of ``docs(doc_id, text, target[, counted])``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wait, held, documents = Known(word_hash), [], 0, np.zeros(2, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            w, good = (np.concatenate(x) for x in zip(*wait, strict=True))
            own, which = np.unique(w, return_inverse=True)
            sums = np.bincount(which, good, len(own)).astype(np.int64), np.bincount(which, minlength=len(own))
            for lo in range(0, len(own), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (own, *sums)], ["w", "good", "every"])

        for batch in batches:
            for body, good, counted in zip(batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                if not counted:
                    continue
                some = False
                for part in words(body.as_py()):
                    some = some or bool(part)
                    wait.append((np.fromiter(map(ids.__getitem__, part), np.int64, len(part)), np.full(len(part), good)))
                    held += len(part)
                    if held > FLUSH:
                        yield from flush()
                        wait, held = [], 0
                documents += some, some and good
        if wait:
            yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array(documents[1:]), pa.array(documents[:1])], ["w", "good", "every"])

    found = _rows(docs).mapInArrow(run, "w long, good long, every long").groupBy("w").agg(F.sum("good").alias("good"), F.sum("every").alias("every"))
    found = persist(found)
    total = {r.words: (r.good, r.every) for r in found.groupBy(F.col("w").isNotNull().alias("words")).agg(F.sum("good").alias("good"), F.sum("every").alias("every")).collect()}
    tokens, documents = (np.array(total.get(k) or (0, 0), np.int64) for k in (True, False))
    least = max(2, math.ceil(tokens[1] / SHARE))
    chosen = found.where(F.col("w").isNotNull() & (F.col("every") >= least)).toArrow()  # SHARE rows at most
    w, good, every = (chosen.column(c).to_numpy() for c in ("w", "good", "every"))
    order = np.lexsort((w, -every))
    counts = np.zeros((2, len(w) + 2), np.int64)
    counts[:, 2:] = good[order], every[order]
    counts[:, UNKNOWN] = tokens - counts.sum(1)
    counts[:, EDGE] = documents
    by_hash = np.argsort(w[order])
    return Models(w[order][by_hash], (by_hash + 2).astype(np.int32), counts, documents)


def _bigrams(body: bytes, ids: Known) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word before, word) of every prediction of the text, some at a time; none of a text without words."""
    last = EDGE
    some = False
    for part in words(body):
        if part:
            w = np.fromiter(map(ids.__getitem__, part), np.int64, len(part))
            yield np.concatenate([[last], w[:-1]]), w
            last, some = w[-1], True
    if some:
        yield np.array([last]), np.array([EDGE], np.int64)


def _head_losses(rows: DataFrame, models: Models, shared) -> np.ndarray:
    """2 x (head x head) losses of the bigrams of the most frequent words."""
    n = models.head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sums, wait, held = Known(shared.value.number), np.zeros((2, n * n), np.int64), [], 0

        def add() -> None:  # cells of rows that do not count for the target, and behind them those that do
            times = np.bincount(np.concatenate(wait), minlength=2 * n * n).reshape(2, -1)
            sums[0], sums[1] = sums[0] + times[1], sums[1] + times.sum(0)

        for batch in batches:
            for body, good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for h, w in _bigrams(body.as_py(), ids):
                    near = (h < n) & (w < n)
                    wait.append(h[near] * n + w[near] + good * n * n)
                    held += len(wait[-1])
                    if held >= FLUSH:
                        add()
                        wait, held = [], 0
        if wait:
            add()
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, sums[0][at], sums[1][at])], ["cell", "good", "every"])

    found = rows.where("counted").select("body", "good").mapInArrow(run, "cell long, good long, every long")
    found = found.groupBy("cell").agg(F.sum("good").alias("good"), F.sum("every").alias("every")).toArrow()  # (HEAD + 2)^2 rows at most
    pairs = np.zeros((2, n * n), np.int64)
    pairs[:, found.column("cell").to_numpy()] = found.column("good").to_numpy(), found.column("every").to_numpy()
    cells = np.arange(n * n)
    return models.losses(cells // n, cells % n, pairs).astype(np.int32)


def _pack(columns: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Rows of bytes: each column's numbers in so many bytes, the lowest first."""
    return np.concatenate([np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size] for x, size in columns], axis=1)


def _unpack(raw: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    out, lo = [], 0
    for size in sizes:
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :size] = raw[:, lo : lo + size]
        out.append(wide.view("<u8")[:, 0])
        lo += size
    return out


def _binary(packed: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One value for each stretch of rows that begins at ``starts``."""
    offsets = np.append(starts, len(packed)).astype(np.int64) * packed.shape[1]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))]).cast(pa.binary())


def _dealt_to(key: np.ndarray, groups: int) -> np.ndarray:
    mixed = key * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)) % np.uint64(groups)


#: Bytes of a document's place in its chunk with two marks, and of sums of losses.
_PLACE, _SUM = 3, 6
_OWN = np.dtype([("known", "?"), ("doc_id", "<i8"), ("size", "<i8"), ("loss0", "<i8"), ("loss1", "<i8")])


def score(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """``(doc_id, n_tokens, target_loss, background_loss, score)`` of every row's whole text.

    ``docs``: ``(doc_id, text, target[, counted])``; rows whose ``counted`` is false teach neither model
    and are scored by what the others taught; ``models`` are those of ``fit(docs)``.  A task that runs
    again must meet its rows in the same order, as rows of files or of a checkpoint come.  Losses are
    means over predictions in nats, score their difference; null and empty texts have no tokens and
    zeros.  Very long texts are cut into words a slice at a time.  Repeated rows and null ids each
    keep a row; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    models = models or fit(docs)
    shared = spark.sparkContext.broadcast(models)  # SHARE words at most
    rows = _rows(docs)
    head = spark.sparkContext.broadcast(_head_losses(rows, models, shared))  # 2 x (HEAD + 2)^2 numbers
    n, size = models.head, models.size
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(int(models.counts[1].sum()) / GROUP_TOKENS))
    key_bytes = math.ceil(math.log2(max(size * size, 2)) / 8)
    names, fields = ["deal", "chunk", "own", "data"], "deal long, chunk long, own boolean, data binary"

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, near_losses = Known(shared.value.number), head.value
        chunk = TaskContext.get().partitionId() << 32
        own, wait, held, since = [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, place = (np.concatenate(x) for x in zip(*wait, strict=True))
            to = _dealt_to(key, groups)
            order = np.lexsort((key, to))
            key, place, to = key[order], place[order], to[order]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1])
            packed = _pack([(key, key_bytes), (place, _PLACE)])
            for lo in range(0, len(starts), 1 << 14):
                some = starts[lo : lo + (1 << 14) + 1]
                end = some[-1] if len(some) > 1 << 14 else len(packed)
                some = some[: 1 << 14]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[some].astype(np.int64)), pa.array(np.full(len(some), chunk)), pa.array(np.zeros(len(some), bool)), _binary(packed[some[0] : end], some - some[0])], names
                )

        def close() -> pa.RecordBatch:
            data = np.array(own, _OWN).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([groups + chunk % groups]), pa.array([chunk]), pa.array([True]), pa.array([data], pa.binary())], names)

        for batch in batches:
            for doc_id, body, good, counted in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                tokens, sums = 0, np.zeros(2, np.int64)
                marks = np.uint64(len(own) << 2 | counted << 1 | good)
                for h, w in _bigrams(body.as_py(), ids):
                    near = (h < n) & (w < n)
                    sums += near_losses[:, h[near] * n + w[near]].sum(1, dtype=np.int64)
                    far = ~near
                    key = h[far].astype(np.uint64) * np.uint64(size) + w[far].astype(np.uint64)
                    wait.append((key, np.full(len(key), marks)))
                    tokens, held = tokens + len(h), held + len(key)
                    if held >= FLUSH:
                        yield from flush()
                        wait, since, held = [], since + held, 0
                own.append((doc_id is not None, doc_id or 0, max(0, tokens - 1), *sums))
                if since + held >= FLUSH or len(own) >= CHUNK_DOCS:
                    if held:
                        yield from flush()
                    yield close()
                    chunk, own, wait, held, since = chunk + 1, [], [], 0, 0
        if held:
            yield from flush()
        if own:
            yield close()

    def summed(table: pa.Table) -> pa.Table:
        """The losses of one group's bigrams, summed for each stretch of occurrences and document."""
        kinds, chunks, data = table.column("own").to_numpy(zero_copy_only=False), table.column("chunk").to_numpy(), table.column("data")
        if kinds.any():  # what is known of the documents goes on as it is
            return table.select(["chunk", "own", "data"])
        raw = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, key_bytes + _PLACE) for x in data]
        stretch = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
        key, place = _unpack(np.concatenate(raw), [key_bytes, _PLACE])
        pair, which = np.unique(key, return_inverse=True)
        good = np.bincount(which, place & np.uint64(1), len(pair))
        every = np.bincount(which, place >> np.uint64(1) & np.uint64(1), len(pair))
        loss = shared.value.losses((pair // np.uint64(size)).astype(np.int64), (pair % np.uint64(size)).astype(np.int64), np.stack([good, every]))
        at, whose = np.unique(stretch.astype(np.uint64) << np.uint64(22) | place >> np.uint64(2), return_inverse=True)
        sums = [np.bincount(whose, x[which].astype(np.float64), len(at)) for x in loss]  # below 2^53: exact
        number = (at >> np.uint64(22)).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1])
        packed = _pack([(at & np.uint64((1 << 22) - 1), _PLACE), *((s, _SUM) for s in sums)])
        return pa.table({"chunk": chunks[number[starts]], "own": np.zeros(len(starts), bool), "data": _binary(packed, starts)})

    def whole(table: pa.Table) -> pa.Table:
        """One chunk's documents with all their losses."""
        kinds, data = table.column("own").to_numpy(zero_copy_only=False), table.column("data")
        own = np.frombuffer(data[int(np.flatnonzero(kinds)[0])].as_buffer(), _OWN)
        sums = np.stack([own["loss0"], own["loss1"]]).astype(np.float64)
        for i in np.flatnonzero(~kinds):
            place, *losses = _unpack(np.frombuffer(data[int(i)].as_buffer(), np.uint8).reshape(-1, _PLACE + 2 * _SUM), [_PLACE, _SUM, _SUM])
            sums[:, place.astype(np.int64)] += np.stack(losses)  # a document once in each stretch
        mean = np.where(own["size"] > 0, sums / UNIT / (own["size"] + 1), 0.0)
        return pa.table({"doc_id": pa.array(own["doc_id"], mask=~own["known"]), "n_tokens": own["size"], "target_loss": mean[0], "background_loss": mean[1]})

    dealt = rows.mapInArrow(occurrences, fields)
    parts = dealt.groupBy("deal").applyInArrow(summed, "chunk long, own boolean, data binary")
    out = parts.groupBy("chunk").applyInArrow(whole, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def labelled_target(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``(doc_id, text, target)`` of every row: target where some label of its id is 1.

    Up to BROADCAST_IDS good ids go to the texts.  Beyond that both sides are dealt by id, and the
    result is checkpointed, so that its rows come in the same order whenever they are read.
    """
    good = labels.where((F.col(label) == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("__id")).distinct()
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = F.broadcast(good) if few else good.hint("shuffle_hash")
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("__id"), "left")
    out = joined.select("doc_id", "text", F.col("__id").isNotNull().alias("target"))
    return out if few else persist(out)
