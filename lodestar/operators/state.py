"""Change detection: fingerprints of a working tree, and keeping a store up to date."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import os
import random
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import short_hash
from ..schema import COMMITTED, UNCOMMITTED
from ..sources import git
from ..sources.porcelain import RepoState
from .index import Manifest, Store
from .symbols import language_of

#: Part of every state hash: raise it when the index format changes.
FORMAT = "1"
LOCK_SECONDS = 60


def fingerprint(repo: str, state: RepoState) -> str:
    """The raw status, and for each changed file its name, times, size and inode; order counts."""
    out = [state.raw]
    for name in state.files:
        try:
            info = os.lstat(os.path.join(repo, name))
            out.append(f"\0{name}\0{info.st_mtime_ns}\0{info.st_size}\0{info.st_ino}\0")
        except OSError:
            out.append(f"\0{name}\0deleted\0")
    return "".join(out)


def fingerprints(states: DataFrame) -> DataFrame:
    """``(id, fingerprint)`` for ``states(id, raw, files array<struct<name, exists, mtime_ns, size, inode>>)``."""

    def one(f: Column) -> Column:
        nul = F.lit("\0")
        there = F.concat_ws("\0", f["mtime_ns"].cast("string"), f["size"].cast("string"), f["inode"].cast("string"))
        return F.concat(nul, f["name"], nul, F.when(f["exists"], there).otherwise("deleted"), nul)

    return states.select("id", F.concat("raw", F.array_join(F.transform("files", one), "")).alias("fingerprint"))


def state_hash(text: str) -> str:
    return hashlib.sha256(f"v{FORMAT}\0{text}".encode("utf-8", "surrogateescape")).hexdigest()[:16]


def state_hash_column(text: Column) -> Column:
    return short_hash(F.lit(f"v{FORMAT}\0"), text)


def plan_of(dirty: bool, head_moved: bool) -> tuple[bool, bool]:
    """(rebuild committed, rebuild overlay); a clean tree's overlay is emptied."""
    return head_moved, dirty


def plans(changes: DataFrame) -> DataFrame:
    """``changes(old_state, new_state, old_head, new_head, n_dirty)`` with what a refresh does."""
    moved = ~F.col("old_head").eqNullSafe(F.col("new_head"))
    fresh = F.col("old_state").eqNullSafe(F.col("new_state"))
    action = F.when(fresh, "none").when(moved & (F.col("n_dirty") > 0), "both").when(moved, "committed")
    return changes.withColumn("action", action.when(F.col("n_dirty") > 0, "overlay").otherwise("clean"))


@contextlib.contextmanager
def writer_lock(path: str, have_index: bool, seconds: float = LOCK_SECONDS) -> Iterator[bool]:
    """Whether the lock was got.  With an index there is no wait: the old one serves meanwhile."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        end, pause = time.monotonic() + seconds, 0.1
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except OSError:
                if have_index:
                    yield False
                    return
                if time.monotonic() > end:
                    raise TimeoutError("another process is still indexing") from None
                time.sleep(pause * random.uniform(0.5, 1))
                pause = min(2, pause * 2)
        try:
            yield True
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def _corpus(raw: DataFrame, repo: str, overlay: bool) -> DataFrame:
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode(F.col("content"), "ISO-8859-1"))
    files = raw.select("path", F.lit(repo).alias("repo"), F.lit(overlay).alias("is_overlay"), text.alias("content"))
    return files.select("path", "repo", "is_overlay", language_of(F.col("path"), F.col("content")).alias("lang"), "content")


def _parts(spark: SparkSession) -> str:
    """Tasks that read files: as many as the cluster runs at once."""
    return str(max(8, spark.sparkContext.defaultParallelism))


def committed_files(spark: SparkSession, repo: str) -> DataFrame:
    return _corpus(spark.read.format("git_committed").option("partitions", _parts(spark)).load(repo), COMMITTED, False)


def worktree_files(spark: SparkSession, repo: str, names: list[str]) -> DataFrame:
    reader = spark.read.format("git_worktree").option("partitions", _parts(spark)).option("names", "\0".join(names))
    return _corpus(reader.load(repo).dropDuplicates(["path"]), UNCOMMITTED, True)


def refresh(spark: SparkSession, repo: str, store: Store, lock_path: str, state: RepoState | None = None) -> str:
    """Bring the store up to the working tree; returns what was done (``none``, ``stale``, ...).

    The two relations are written side by side.  Files known to be changed are looked at again
    afterwards: if one moved meanwhile, or one of the two failed, the new versions serve but the
    state is not recorded, so the next call starts again.
    """
    state = state or git.repo_state(repo)
    now = state_hash(fingerprint(repo, state))
    if store.manifest().state == now:
        return "none"
    with writer_lock(lock_path, store.exists()) as got:
        if not got:
            return "stale"
        old = store.manifest()
        if old.state == now:  # another process was faster
            return "none"
        whole, part = plan_of(bool(state.files), old.head != state.head_sha or not old.committed)
        new = Manifest(committed=old.committed, overlay="")
        failed = None
        with ThreadPoolExecutor(2) as pool:
            jobs = {}
            if whole:
                jobs["committed"] = pool.submit(lambda: store.write(committed_files(spark, repo), "committed"))
            if part:
                jobs["overlay"] = pool.submit(lambda: store.write(worktree_files(spark, repo, state.files), "overlay"))
            for kind, job in jobs.items():
                try:
                    setattr(new, kind, job.result())
                except Exception as e:  # what the other wrote is kept
                    failed = e
                    setattr(new, kind, getattr(old, kind))
        if failed:
            store.publish(new)
            raise failed
        stable = state_hash(fingerprint(repo, state)) == now
        if stable:
            new.state, new.head = now, state.head_sha
        store.publish(new)
        return {(True, True): "both", (True, False): "committed", (False, True): "overlay"}.get((whole, part), "clean") + ("" if stable else ", changed meanwhile")
