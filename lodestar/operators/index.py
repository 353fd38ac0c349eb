"""Index structures: trigram postings for pruning, shards by bytes, and a store on disk.

A store is a folder of immutable Parquet versions and a manifest that names the current ones.
Publishing writes a new version and then renames the manifest over the old one in one step, so
readers need no lock: they keep the versions they started with.  A version that a publication
replaces stays until the next one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.query import And, Atom, Node, Or, Query, parse, scoring_atoms
from ..schema import CORPUS
from .settled import settled

SHARD_BYTES = 10 * 1024 * 1024
GRAM = 3
#: Alternatives that an ``And`` makes, at most; a part that would make more is not asked for.
ALTERNATIVES = 64
#: Files that a scan is told by their numbers, at most; more are joined.
LISTED = 1000
#: Numbers that are sent to every executor for that join, at most; for more the files move.
SENT = 500_000
#: Code points that are turned into grams at once.
_CHARS = 1 << 21
#: Rows of counted grams that a task holds before it adds them up.
_COUNTED = 1 << 18
_BITS = 21


def shards(corpus: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """``(path, repo, bytes, shard)``: files in path order, cut where the running sum passes limits.

    The files are dealt by ranges of that order; a running sum over the ranges' totals (a row each)
    comes before the one inside each range, so no task orders all files or a whole folder.
    """
    size = F.octet_length(F.coalesce("content", F.lit(""))).cast("long")
    top = F.when(F.instr("path", "/") > 0, F.concat(F.substring_index("path", "/", 1), F.lit("/"))).otherwise(F.col("path"))
    order = ["__top", "path", "repo"]
    files = corpus.select("path", "repo", size.alias("bytes"), top.alias("__top")).repartitionByRange(*order)
    files = settled(files.withColumn("__range", F.spark_partition_id()))
    totals = files.groupBy("__range").agg(F.sum("bytes").alias("t"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = totals.select("__range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = files.withColumn("upto", F.sum("bytes").over(within)).join(base, "__range").withColumn("upto", F.col("upto") + F.col("base"))
    return summed.select("path", "repo", "bytes", F.floor((F.greatest("upto", F.lit(1)) - 1) / limit).cast("long").alias("shard"))


def grams_of(text: str) -> set[str]:
    text = text.lower()
    return {g for i in range(len(text) - GRAM + 1) if "\n" not in (g := text[i : i + GRAM])}


def gram_code(gram: str) -> int:
    """A gram as one number: its three code points."""
    code = 0
    for c in gram:
        code = code << _BITS | ord(c)
    return code


def gram_text(code: Column) -> Column:
    """The gram that a number stands for."""

    @F.pandas_udf("string")
    def text(codes):
        return codes.map(lambda x: "".join(chr(x >> _BITS * i & ((1 << _BITS) - 1)) for i in (2, 1, 0)))

    return text(code)


def file_number() -> Column:
    """A number for each file; should two files ever share one, both are looked at."""
    return F.xxhash64("path", "repo")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[str]]]:
    """Files by some _CHARS characters at a time: what comes after path and content in their rows, and their texts."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for path, content, *key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = f"{(content or '').lower()}\n{(path or '').lower()}\n"
            keys.append(tuple(key))
            texts.append(text)
            held += len(text)
            if held >= _CHARS:
                yield keys, texts
                keys, texts, held = [], [], 0
    if texts:
        yield keys, texts


def _distinct(texts: list[str], start: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams as numbers and the places of the texts that hold them, each pair once, by gram and then by place.

    Each text ends with a line's end.  A pair is sorted as one number, made of the places that its characters have among those that
    occur; texts of too many different characters for that come in parts.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < GRAM:
        return
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    bits, low = int(len(alphabet) - 1).bit_length(), int(len(texts) - 1).bit_length()
    if GRAM * bits + low > 63:
        half = len(texts) // 2
        yield from _distinct(texts[:half], start)
        yield from _distinct(texts[half:], start + half)
        return
    inside = points != 10
    here = np.flatnonzero(inside[:-2] & inside[1:-1] & inside[2:])
    if not len(here):
        return
    place = (np.cumsum(seen) - 1)[points]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    pair = ((place[here] << bits | place[here + 1]) << bits | place[here + 2]) << low | owner[here]
    pair.sort()
    pair = pair[np.append(True, pair[1:] != pair[:-1])]
    one = (1 << bits) - 1
    first, second, third = (alphabet[pair >> low + bits * i & one] for i in (2, 1, 0))
    yield first << 2 * _BITS | second << _BITS | third, (pair & (1 << low) - 1) + start


def postings(corpus: DataFrame) -> DataFrame:
    """``(gram, file)``: the distinct trigrams of each file's lines and path, in lower case, as numbers.

    They come in the order of their grams for each _CHARS characters of files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _blocks(batches):
            numbers = np.array([k for (k,) in keys], np.int64)
            for code, place in _distinct(texts):
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(numbers[place])], ["gram", "file"])

    number = F.col("file") if "file" in corpus.columns else file_number()  # a store has no empty ``repo``
    return corpus.select("path", "content", number.alias("file")).mapInArrow(run, "gram long, file long")


def gram_files(corpus: DataFrame) -> DataFrame:
    """``(gram, n_files, first_path)``: for each gram the number of files that hold it and the first of their paths.

    Tasks count the files they read, so what moves is a row for each of a task's grams.  Only rows
    that share a file with others are taken apart and meet by file and gram.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for keys, texts in _blocks(batches):
            order = sorted(range(len(keys)), key=lambda i: (keys[i][0] is None, keys[i][0] or ""))
            names = pa.array([keys[i][0] for i in order], pa.string())
            for code, place in _distinct([texts[i] for i in order]):
                at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                n = np.diff(np.append(at, len(code)))
                parts.append(pa.table([pa.array(code[at]), pa.array(n), names.take(pa.array(place[at]))], ["gram", "n_files", "first_path"]))
            if sum(p.num_rows for p in parts) >= _COUNTED:
                parts = [_summed(parts)]
                if parts[0].num_rows >= _COUNTED // 2:
                    yield from parts.pop().to_batches()
        if parts:
            yield from _summed(parts).to_batches()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _blocks(batches):
            paths, repos = (pa.array(c, pa.string()) for c in zip(*keys, strict=True))
            for code, place in _distinct(texts):
                at = pa.array(place)
                yield pa.RecordBatch.from_arrays([pa.array(code), paths.take(at), repos.take(at)], ["gram", "path", "repo"])

    files = corpus.select("path", "content", "path", "repo").toDF("path", "content", "name", "repo").withColumn("file", file_number())
    twice = files.groupBy("file").count().where("count > 1").select("file")
    once, shared, few = files, None, [r.file for r in twice.limit(LISTED + 1).collect()]
    if len(few) > LISTED:
        twice = settled(twice)
        once, shared = files.join(twice, "file", "left_anti"), files.join(twice, "file", "left_semi")
    elif few:
        once, shared = files.where(~F.col("file").isin(few)), files.where(F.col("file").isin(few))
    counts = once.select("path", "content", "name").mapInArrow(counted, "gram long, n_files long, first_path string")
    if shared is not None:
        rows = shared.select("path", "content", "name", "repo").mapInArrow(told, "gram long, path string, repo string").distinct()
        counts = counts.unionByName(rows.groupBy("gram").agg(F.count("*").alias("n_files"), F.min("path").alias("first_path")))
    return counts.groupBy("gram").agg(F.sum("n_files").alias("n_files"), F.min("first_path").alias("first_path"))


def _summed(parts: list[pa.Table]) -> pa.Table:
    """One row for each gram."""
    out = pa.concat_tables(parts).group_by("gram").aggregate([("n_files", "sum"), ("first_path", "min")])
    return out.rename_columns(["gram", "n_files", "first_path"]).combine_chunks()


def required(node: Node) -> list[set[str]]:
    """Sets of trigrams one of which any matching file holds in full; an empty set prunes nothing."""
    if isinstance(node, Atom) and node.kind in ("word", "content", "file") and not node.is_regex:
        return [grams_of(node.value)]
    if isinstance(node, And):
        sets: list[set[str]] = [set()]
        for p in node.parts:
            more = required(p)
            if len(sets) * len(more) <= max(ALTERNATIVES, len(sets), len(more)):
                sets = [a | b for a in sets for b in more]
        return sets
    if isinstance(node, Or):
        return [s for p in node.parts for s in required(p)]
    return [set()]


def wanted(query: Query) -> list[set[str]] | None:
    """Sets of trigrams: a file that holds none of them in full neither satisfies the query nor holds
    anything that scores.  None if every file may.

    Where the parts of an ``And`` would make more than ALTERNATIVES, the further ones are left to
    the query's own test, by which fewer grams are asked for, never more.
    """
    sets = required(query.root)
    for atom in scoring_atoms(query.root):
        sets = sets + required(atom)
    return None if any(not s for s in sets) else sets


def candidates(index: DataFrame, query: Query) -> DataFrame | None:
    """Numbers of the files that may match or count for a score, by the grams they hold; None if all may."""
    sets = wanted(query)
    if sets is None:
        return None
    coded = [sorted(map(gram_code, s)) for s in sets]
    every = sorted({g for s in coded for g in s})
    held = [F.count_if(F.col("gram").isin(s)).alias(f"n_{i}") for i, s in enumerate(coded)]
    found = index.where(F.col("gram").isin(every)).groupBy("file").agg(*held)
    keep = F.lit(False)
    for i, s in enumerate(coded):
        keep = keep | (F.col(f"n_{i}") >= len(s))
    return found.where(keep).select("file")


@dataclass
class Index:
    """Postings of a collection, the number of its files, and their length in characters."""

    postings: DataFrame
    files: int
    chars: int

    def narrowed(self, corpus: DataFrame, query: Query) -> DataFrame | None:
        """``corpus`` rows that the index cannot rule out; None if that is all of them.

        Few files are named to the scan, which then skips pages of a sorted store; more are joined,
        where they lie as long as their numbers can be sent.
        """
        keep = candidates(self.postings, query)
        if keep is None:
            return None
        keep = settled(keep)
        rows = corpus if "file" in corpus.columns else corpus.withColumn("file", file_number())
        few = [r.file for r in keep.limit(LISTED + 1).collect()]
        if len(few) <= LISTED:
            rows = rows.where(F.col("file").isin(few))
        else:
            rows = rows.join(F.broadcast(keep) if keep.count() <= SENT else keep, "file", "left_semi")
        return rows.select(*(F.col(f"`{c}`") for c in corpus.columns))


def pruned(corpus: DataFrame, index: DataFrame, text: str) -> DataFrame:
    """``corpus`` rows that the index cannot rule out; the query's own test comes after."""
    keep = Index(index, 0, 0).narrowed(corpus, parse(text))
    return corpus if keep is None else keep


@dataclass
class Manifest:
    state: str = ""
    head: str = ""
    committed: str = ""
    overlay: str = ""
    #: files and characters of each version named
    sizes: dict[str, list[int]] = field(default_factory=dict)
    #: versions that the last publication replaced
    retired: list[str] = field(default_factory=list)

    def versions(self) -> list[str]:
        return [n for n in (self.committed, self.overlay) if n]


class Store:
    """Versions and manifest under ``root``, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._sizes: dict[str, list[int]] = {}

    def _write_text(self, name: str, text: str) -> None:
        """A whole file, put in place of the old one in one step."""
        tmp, final = self._path(f"{self.root}/{name}.{uuid.uuid4().hex}.tmp"), self._path(f"{self.root}/{name}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._replace(tmp, final)

    def _replace(self, tmp, final) -> None:
        sc = self.spark.sparkContext
        fs = sc._jvm.org.apache.hadoop.fs
        how = sc._gateway.new_array(fs.Options.Rename, 1)
        how[0] = fs.Options.Rename.OVERWRITE
        fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration()).rename(tmp, final, how)

    def manifest(self) -> Manifest:
        """The current manifest; one that is missing or damaged reads as empty."""
        path = self._path(f"{self.root}/manifest.json")
        if not self._fs.exists(path):
            return Manifest()
        stream = self._fs.open(path)
        try:
            raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            return Manifest(**json.loads(raw))
        except (ValueError, TypeError, Py4JJavaError):  # the last: a checksum that does not fit
            return Manifest()
        finally:
            stream.close()

    def publish(self, manifest: Manifest) -> None:
        """Make these versions the current ones; those that were replaced before the last ones go."""
        old = self.manifest()
        current = manifest.versions()
        manifest.sizes = {n: size for n, size in ({**old.sizes, **self._sizes, **manifest.sizes}).items() if n in current}
        manifest.retired = [n for n in old.versions() if n not in current]
        self._write_text("manifest.json", json.dumps(vars(manifest)))
        for name in old.retired:
            if name not in current and name not in manifest.retired:
                for folder in (name, f"{name}-grams"):
                    self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def invalidate(self) -> None:
        """Forget state and head, which makes the next refresh build everything."""
        now = self.manifest()
        self.publish(Manifest(committed=now.committed, overlay=now.overlay))

    def exists(self) -> bool:
        return bool(self.manifest().committed or self.manifest().overlay)

    def write(self, rows: DataFrame, kind: str) -> str:
        """A new version of a relation with its postings; an empty overlay has none.

        Files lie in the order of their numbers, and the postings of each _CHARS characters in that of
        their grams, so that a scan for some of them skips the rest; postings stay with the part they
        came from, and no task sorts them.
        """
        if kind == "overlay" and rows.isEmpty():
            return ""
        name = f"{kind}-{uuid.uuid4().hex}"
        numbered = rows.select(*CORPUS.fieldNames()).withColumn("file", file_number())
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        numbered.repartitionByRange(parts, "file").sortWithinPartitions("repo", "file").write.partitionBy("repo").parquet(f"{self.root}/{name}")
        kept = self._files(name)
        postings(kept).write.parquet(f"{self.root}/{name}-grams")
        n, chars = kept.agg(F.count("*"), F.sum(F.length(F.coalesce("content", F.lit(""))))).first()
        self._sizes[name] = [n, chars or 0]
        return name

    def _files(self, name: str) -> DataFrame:
        schema = T.StructType([*CORPUS.fields, T.StructField("file", T.LongType(), False)])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").select(*CORPUS.fieldNames(), "file")

    def read(self, manifest: Manifest | None = None) -> DataFrame:
        """Both relations as they were published."""
        return self.numbered(manifest).drop("file")

    def numbered(self, manifest: Manifest | None = None) -> DataFrame:
        """Both relations with the files' numbers, which ``index`` knows them by."""
        now = manifest or self.manifest()
        frames = [self._files(n) for n in now.versions()]
        if not frames:
            return self.spark.createDataFrame([], CORPUS).withColumn("file", F.lit(0).cast("long"))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def index(self, manifest: Manifest | None = None) -> Index | None:
        """The index of both relations; None where a version has none."""
        now = manifest or self.manifest()
        names = now.versions()
        if not names or any(n not in now.sizes or not self._fs.exists(self._path(f"{self.root}/{n}-grams")) for n in names):
            return None
        grams = self.spark.read.schema("gram long, file long").parquet(*(f"{self.root}/{n}-grams" for n in names))
        return Index(grams, sum(now.sizes[n][0] for n in names), sum(now.sizes[n][1] for n in names))
