"""SimHash near-duplicate groups by deletion-variant signatures.

A 64-bit fingerprint is cut into fewer segments than the usual pigeonhole would need: with
``k`` differing bits allowed and ``k // 2 + 1`` segments, one segment differs by one bit at most.
Every segment is indexed under each of its one-wildcard variants (the segment without one bit),
so two such segments share a variant and equality finds the pair; the popcount of the whole
fingerprints verifies it.

A variant whose wildcard stands in one half of the segment has the other half as it is.  So the
rows are dealt by that other half, twice for each segment, and a task makes the variants of what
it was dealt: the index is never written out.  Rows of equal variant are compared with one leader
first; only rows that this leaves in another group than the leader's are compared with the rest,
so a cloud of near copies costs one comparison a row.  Of the links a task finds it returns a
spanning forest.  Where more than BLOCK rows were dealt alike, they are split into blocks and the
pairs of blocks are dealt instead, so no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, persist, release, text_bytes
from .components import Forest, connected_components

SEED = 42
BITS = 64
#: 64-bit parts of the fingerprints of ``similar``, the words of their shingles, and the segments of a part.
WIDE_LANES, WIDE_WORDS, WIDE_PIECES = 4, 2, 3
#: Ids that are broadcast, at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Rows of equal half segment that are compared in one task, and rows dealt to one task on average, at most.
BLOCK, TASK_ROWS = 100_000, 500_000
#: Pairs compared at once.
PAIRS = 1 << 20
#: Texts of one cloud whose shingles are compared in one task with as many others, and their shingles.
CLOUD_TEXTS, CLOUD_SHINGLES = 256, 500_000


def hash_shingles(body: bytes, width: int) -> list[int]:
    """XXH64 of every shingle of ``width`` words, repeats included.

    ``bytes.lower`` and ``bytes.split`` know ASCII only: A-Z, and white space 0x20 and 0x09-0x0D.
    """
    words = body.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(joined, SEED)]
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    starts, ends = at[: len(words) - width + 1].tolist(), (at[width:] - 1).tolist()
    return [h(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)]


def fingerprint(body: bytes, width: int) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it; no words: 0."""
    hashes = hash_shingles(body, width)
    if not hashes:
        return 0
    ones = np.zeros(BITS, np.int64)
    values = np.array(hashes, np.uint64)
    for i in range(0, len(values), 1 << 14):
        part = values[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``(doc_id, f0)`` of every row: one 64-bit SimHash as a signed long.  Null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "f0"])

    return text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, f0 long")


def shingle_set(body: bytes, width: int) -> np.ndarray:
    """The distinct shingles' hashes, in ascending order."""
    return np.unique(np.array(hash_shingles(body, width), np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """WIDE_LANES x 64 bits over distinct hashes: each lane's are the hashes mixed once more than the last's."""
    if not len(hashes):
        return [0] * WIDE_LANES
    ones = np.zeros((WIDE_LANES, BITS), np.int64)
    for at in range(0, len(hashes), 1 << 14):
        values = hashes[at : at + (1 << 14)]
        for lane in range(WIDE_LANES):
            if lane:
                values = values + np.uint64(0x9E3779B97F4A7C15)
                values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                values ^= values >> np.uint64(31)
            ones[lane] += np.unpackbits(values.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()


def wide_fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """``(doc_id, text_hash, f0, ..., digest, size)`` of every row.  Null text is empty.

    ``digest`` is a hash of the set of shingles, ``size`` its number of shingles.
    """
    names = [*lanes(WIDE_LANES), "digest", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(2):
                body = x.as_py()
                own = shingle_set(body, width)
                rows.append([*wide_fingerprint(shingle_set(body, WIDE_WORDS)), xxhash.xxh64_intdigest(own.tobytes(), SEED), len(own)])
            cols = np.array(rows, np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c.copy()) for c in cols.T)], ["doc_id", "text_hash", *names])

    rows = text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id"), text_hash())
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "text_hash", *names)))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def lanes(n: int) -> list[str]:
    """Columns of the fingerprint's 64-bit parts."""
    return [f"f{i}" for i in range(n)]


def segments(pieces: int) -> list[tuple[int, int]]:
    """(first bit, width) of so many segments that cover 64 bits."""
    cuts = [BITS * i // pieces for i in range(pieces + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def halves(pieces: int, n: int) -> list[tuple[int, int, list[int]]]:
    """(lane, mask of the half that is dealt by, bits of the other half, each a wildcard in turn)."""
    out = []
    for lane in range(n):
        for a, w in segments(pieces):
            low, high = list(range(a, a + w // 2)), list(range(a + w // 2, a + w))
            out += [(lane, sum(1 << b for b in kept), free) for kept, free in ((low, high), (high, low))]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _dealt(nodes: DataFrame, pieces: int, n: int, block: int) -> DataFrame:
    """``nodes`` once for each half of a segment, with its number ``slot`` and ``deal``: rows of one
    deal have that half in common."""
    table = [F.struct(F.lit(i).alias("slot"), F.lit(lane).alias("lane"), F.lit(_signed(mask)).alias("mask")) for i, (lane, mask, _) in enumerate(halves(pieces, n))]
    part = F.col("f0")
    for lane in range(1, n):
        part = F.when(F.col("v.lane") == lane, F.col(f"f{lane}")).otherwise(part)
    rows = nodes.select("*", F.explode(F.array(*table)).alias("v"))
    rows = rows.withColumn("deal", F.xxhash64("v.slot", part.bitwiseAND(F.col("v.mask")))).withColumn("slot", F.col("v.slot").cast("int")).drop("v")
    large = persist(rows.groupBy("deal").count().where(F.col("count") > block).select("deal", F.ceil(F.col("count") / block).alias("blocks")))
    if large.isEmpty():
        return rows
    # at most one in ``block`` deals is large, so the table is small beside the rows; Spark broadcasts it or not by its size
    rows = rows.join(large, "deal", "left")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    each = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("other", F.explode(each))
    key = F.when(F.col("blocks").isNull(), F.col("deal")).otherwise(F.xxhash64("deal", F.least(own, "other"), F.greatest(own, "other")))
    return rows.withColumn("deal", key).drop("blocks", "other")


def _runs(key: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, most copies first, and where each run of two and more begins and ends."""
    order = np.lexsort((-copies, key))
    edge = np.flatnonzero(np.diff(key[order])) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
    long = ends - starts > 1
    return order, starts[long], ends[long]


def near_forest(deal: np.ndarray, slot: np.ndarray, copies: np.ndarray, fps: np.ndarray, node: np.ndarray, max_bits: int, pieces: int) -> list[tuple[int, int]]:
    """Links ``(row, row)`` that join all rows of one deal whose fingerprints ``fps`` (rows x lanes)
    share a variant and differ in ``max_bits`` or fewer: a forest over the nodes' rows."""
    ways = halves(pieces, fps.shape[1])
    most = max(len(free) for _, _, free in ways)
    lane = np.array([w[0] for w in ways])[slot]
    segment = np.array([w[1] | sum(1 << b for b in w[2]) for w in ways], np.uint64)
    own = fps[np.arange(len(fps)), lane] & segment[slot]
    first, place = np.unique(node, return_index=True, return_inverse=True)[1:]
    forest, found = Forest(len(first)), []

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fps[a] ^ fps[b]).sum(1) <= max_bits

    def keyed(j: int) -> tuple[np.ndarray, ...]:
        """Rows with a j-th wildcard, and the runs of them that share the variant."""
        wild = np.array([1 << w[2][j] if j < len(w[2]) else 0 for w in ways], np.uint64)
        at = np.flatnonzero(wild[slot] > 0)
        key = (own[at] & ~wild[slot[at]]) * np.uint64(0x9E3779B97F4A7C15) ^ deal[at].view(np.uint64)
        order, starts, ends = _runs((key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93), copies[at])
        return at[order], starts, ends

    for j in range(most):  # every row with its run's leader
        rows, starts, ends = keyed(j)
        leader, member = np.repeat(rows[starts], ends - starts - 1), [rows[s + 1 : e] for s, e in zip(starts, ends, strict=True)]
        member = np.concatenate([*member, rows[:0]])
        for lo in range(0, len(member), PAIRS):
            a, b = leader[lo : lo + PAIRS], member[lo : lo + PAIRS]
            ok = near(a, b)
            found += forest.link(place[a[ok]], place[b[ok]])
    label = forest.labels()
    for j in range(most):  # rows outside the leader's group with the whole run
        rows, starts, ends = keyed(j)
        lab = label[place[rows]]
        sizes = ends - starts
        inside = np.concatenate([*(np.arange(s, e) for s, e in zip(starts, ends, strict=True)), starts[:0]])
        run = np.repeat(np.arange(len(starts)), sizes)
        out = lab[inside] != lab[np.repeat(starts, sizes)]
        inside, run = inside[out], run[out]
        lo = 0
        upto = np.cumsum(sizes[run])
        while lo < len(run):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS)))
            k = sizes[run[lo:hi]]
            a = np.repeat(inside[lo:hi], k)
            b = np.repeat(starts[run[lo:hi]] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
            differ = lab[a] != lab[b]
            a, b = rows[a[differ]], rows[b[differ]]
            ok = near(a, b)
            found += forest.link(place[a[ok]], place[b[ok]])
            lo = hi
    return [(int(first[a]), int(first[b])) for a, b in found]


def groups(nodes: DataFrame, max_bits: int = 4, pieces: int | None = None, n: int = 1, block: int = BLOCK) -> DataFrame:
    """``(node, root)`` for every node: root is the same where a chain of links is.

    ``nodes``: ``(node, copies, f0, ...)``, one row for each distinct fingerprint, checkpointed;
    copies is its number of documents.  A link is ``max_bits`` differing bits or fewer, found
    where some segment differs by one at most: with ``max_bits // 2 + 1`` pieces (the default)
    that is every link.
    """
    pieces = pieces or max_bits // 2 + 1
    names = lanes(n)
    rows = _dealt(nodes.select("node", "copies", *names), pieces, n, block)
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, math.ceil(nodes.count() * len(halves(pieces, n)) / TASK_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            col = [table.column(i).to_numpy() for i in range(len(names) + 4)]
            fps = np.stack([c.view(np.uint64) for c in col[4:]], 1)
            pairs = near_forest(col[0], col[1], col[3], fps, col[2], max_bits, pieces)
            a, b = (np.array([p[i] for p in pairs], np.int64) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(col[2][a]), pa.array(col[2][b])], ["a", "b"])

        size, last = 0, None
        for batch in batches:
            lo, deal = 0, batch.column(0).to_numpy()
            # a new deal begins a new table once enough rows are held
            for cut in [*(np.flatnonzero(np.diff(deal)) + 1).tolist(), len(deal)]:
                if size >= TASK_ROWS and deal[lo] != last:
                    yield from links()
                    held, size = [], 0
                if size + cut - lo >= TASK_ROWS or cut == len(deal):
                    held.append(batch.slice(lo, cut - lo))
                    size, last, lo = size + cut - lo, deal[cut - 1], cut
        if size:
            yield from links()

    dealt = rows.select("deal", "slot", "node", "copies", *names).repartition(tasks, "deal").sortWithinPartitions("deal")
    edges = persist(dealt.mapInArrow(run, "a long, b long"))
    roots = connected_components(edges).withColumnRenamed("node", "__node")
    return nodes.join(roots, F.col("node") == F.col("__node"), "left").select("node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text, ...)``.

    Null and empty texts have fingerprint zero and link like any other; very long texts are taken
    whole.  Repeated rows each keep a row; an empty table gives none; other columns are ignored.
    ``component_id`` is the smallest doc_id reachable over links of at most ``max_bits``
    differing bits.
    """
    per_doc = persist(fingerprints(docs, width))
    folded = per_doc.groupBy("f0").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    nodes = persist(folded.withColumn("node", F.monotonically_increasing_id()))
    rooted = persist(groups(nodes.select("node", "copies", "f0"), max_bits)).join(nodes.drop("copies"), "node")
    least = persist(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))  # so that a large group's join can be split
    mapping = persist(rooted.select("root", "f0").join(least, "root").drop("root"))
    out = per_doc.join(mapping, "f0")
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def bits_at(similarity: float, bits: int = BITS * WIDE_LANES, errors: float = 3) -> int:
    """Differing bits of so many of texts of that Jaccard similarity, and so many standard errors on top.

    Two sets of similarity s meet at an angle with cosine 2s / (1 + s), and each bit differs with
    that angle's share of a half turn.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + errors * math.sqrt(bits * p * (1 - p)))


def similar_pairs(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the sets (sorted, distinct values) whose Jaccard similarity is that or more.

    Values are numbered and the sets become rows of zeros and ones, a stretch of values at a time;
    products of the rows count what two sets have in common, exactly.
    """
    size = np.array([len(s) for s in sets], np.float64)
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    shared = np.bincount(number, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    use = shared[number]
    number, owner = column[number[use]], owner[use]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    common = np.zeros((len(sets), len(sets)))
    step = 1 << 13
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(number, [lo, lo + step])
        rows = np.zeros((len(sets), step), np.float32)
        rows[owner[a:b], number[a:b] - lo] = 1
        common += rows @ rows.T  # at most ``step`` ones a product: exact in this type
    union = size[:, None] + size[None, :] - common
    alike = (union == 0) | (common / np.maximum(union, 1) >= similarity)
    return np.nonzero(np.triu(alike, 1))


def _cloud_links(docs: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """``(a, b)``: links that join the nodes of each cloud by their sets of shingles, exactly.

    ``nodes``: ``(node, root, first_id, digest, size)``; root is the cloud.  Each text's set goes to
    its cloud once.  A large cloud is split into blocks, and the pairs of blocks are compared, each
    in a task of its own.
    """
    clouds = nodes.groupBy("root").agg(F.count("*").alias("texts"), F.sum("size").alias("shingles")).where("texts > 1")
    # a few very long texts: no more blocks than texts, as each text goes to every block
    blocks = F.ceil(F.greatest(F.col("texts") / CLOUD_TEXTS, F.least(F.col("shingles") / CLOUD_SHINGLES, "texts"))).alias("blocks")
    clouds = persist(clouds.select("root", blocks))  # so that a large cloud's join can be split
    wanted = persist(nodes.join(clouds, "root").select("node", "root", "first_id", "digest", "blocks"))
    if wanted.count() <= BROADCAST_IDS:  # then the texts stay where they are
        wanted = F.broadcast(wanted)
    body = text_bytes(docs, F.col("doc_id").cast("long").alias("__id"))
    held = body.join(wanted, F.col("__id").eqNullSafe(F.col("first_id"))).select("root", "blocks", "node", "digest", "body")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (digest, body) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4), strict=True)):  # a row at a time: a text may be long
                own = shingle_set(body.as_py(), width)
                if np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).astype(np.int64) == digest:  # an id may have several texts
                    yield pa.RecordBatch.from_arrays([*(batch.column(c)[i : i + 1] for c in range(3)), pa.array([own.tobytes()], pa.binary())], ["root", "blocks", "node", "shingles"])

    sets = held.mapInArrow(shingles, "root long, blocks long, node long, shingles binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    sets = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sets = sets.select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        node, at = np.unique(table.column("node").to_numpy(), return_index=True)
        column = table.column("shingles")
        a, b = similar_pairs([np.frombuffer(column[int(i)].as_buffer(), np.uint64) for i in at], similarity)
        kept = Forest(len(node)).link(a, b)
        return pa.table({"a": pa.array([int(node[x]) for x, _ in kept], pa.int64()), "b": pa.array([int(node[y]) for _, y in kept], pa.int64())})

    return sets.groupBy("root", "x", "y").applyInArrow(compare, "a long, b long")


def _similar(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """``(doc_id, text_hash, head)`` of every row; head is the group's smallest ``(no_id, id, text_hash)``."""
    spark = docs.sparkSession
    per_doc = persist(wide_fingerprints(docs, width))
    own = ["digest", "size"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "text_hash")).alias("head")
    folded = per_doc.groupBy(*own).agg(F.count("*").alias("copies"), first, *(F.first(c).alias(c) for c in lanes(WIDE_LANES)))
    nodes = persist(folded.withColumn("node", F.monotonically_increasing_id()))
    clouds = persist(groups(nodes.select("node", "copies", *lanes(WIDE_LANES)), bits_at(similarity), WIDE_PIECES, WIDE_LANES))
    release(spark)  # the index's shuffle, before the next is written
    members = nodes.join(clouds, "node").select("node", "root", F.col("head.id").alias("first_id"), "digest", "size")
    roots = connected_components(persist(_cloud_links(docs, members, width, similarity)))
    release(spark)
    rooted = nodes.join(roots, "node", "left").select(*own, "head", F.coalesce("root", "node").alias("root"))
    rooted = persist(rooted)
    heads = persist(rooted.groupBy("root").agg(F.min("head").alias("head")))  # so that a large group's join can be split
    mapping = persist(rooted.select("root", *own).join(heads, "root").drop("root"))
    return per_doc.join(mapping, own).select("doc_id", "text_hash", "head")


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)`` of groups whose texts are similar by shingles of ``width`` words.

    Links are pairs whose sets of shingles have that Jaccard similarity.  Where to look is found by
    fingerprints of 256 bits over the sets of WIDE_WORDS-word shingles, of which an edit changes
    fewer: texts with a segment that differs by one bit at most, of twelve, and within three
    standard errors of the bits by which sets of that similarity differ, form clouds; inside a cloud
    every pair's similarity is counted.  Rows are treated as by ``near_duplicates``.
    """
    return _similar(docs, width, similarity).select("doc_id", F.col("head.id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the near copies: of each group the document with the smallest doc_id stays.

    Null ids come last, and between texts of one id the smaller hash of the text decides; of rows
    that repeat both, one stays.  Very long texts are compared whole.  An empty table gives no
    rows; all columns stay as they are.
    """
    out = persist(_similar(docs.select("doc_id", "text"), width, similarity))
    other = ~(F.col("doc_id").eqNullSafe(F.col("head.id")) & (F.col("text_hash") == F.col("head.text_hash")))
    own, key = fresh(docs, "__id"), fresh(docs, "__hash")
    names = [F.col("doc_id").alias(own), F.col("text_hash").alias(key)]
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (text_hash() == F.col(key))

    def less(rows: DataFrame, drop: DataFrame) -> DataFrame:
        """``rows`` without those of ``drop``, which is broadcast up to a checked size."""
        if drop.count() <= BROADCAST_IDS:  # then the texts stay where they are
            drop = F.broadcast(drop)
        return rows.join(drop, same, "left_anti")

    kept = less(docs, persist(out.where(other).select(*names).distinct()))
    twice = persist(out.where(~other).groupBy(*names).count().where("count > 1").drop("count"))
    if twice.isEmpty():
        return kept
    one = docs.join(twice, same, "left_semi").withColumn(key, text_hash())
    one = one.dropDuplicates(["doc_id", key]).select(*(F.col(f"`{c}`") for c in docs.columns))
    return less(kept, twice).unionByName(one)
