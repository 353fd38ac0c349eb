"""Python data sources over git repositories: changed files, the working tree, the commit."""

from __future__ import annotations

import os
import stat
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..schema import DIRTY_FILE, RAW_FILE
from .porcelain import RepoState, parse_status

#: Larger files are not indexed; one of exactly this size is.
MAX_FILE_BYTES = 10 * 1024 * 1024
STATUS = ("status", "--porcelain=v2", "--branch", "--no-renames", "--no-ahead-behind", "-z")


def git(repo: str, *args: str, check: bool = True) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, check=check)
    return done.stdout


def resolve_repo(path: str) -> str:
    """Top folder of the repository that holds ``path``."""
    return os.fsdecode(git(path, "rev-parse", "--show-toplevel")).rstrip("\n")


def exclude_file(repo: str) -> str:
    """The file of patterns that this working tree ignores; linked trees share their repository's."""
    return os.path.join(repo, os.fsdecode(git(repo, "rev-parse", "--git-path", "info/exclude")).rstrip("\n"))


def exclude(repo: str, pattern: str) -> None:
    """Add a pattern to it, once."""
    path = exclude_file(repo)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a+") as f:
        f.seek(0)
        known = f.read()
        if pattern not in known.split("\n"):
            f.write(("" if known.endswith("\n") or not known else "\n") + pattern + "\n")


def repo_state(repo: str) -> RepoState:
    """Head and changed files from one atomic status call; an empty state if that fails."""
    try:
        return parse_status(os.fsdecode(git(repo, *STATUS)))
    except (OSError, subprocess.CalledProcessError):
        return RepoState()


def read_regular(repo: str, name: str) -> bytes | None:
    """Bytes of a regular file; None if it is missing, unreadable, too large or of another kind."""
    path = os.path.join(repo, name)
    try:
        info = os.lstat(path)
        if not stat.S_ISREG(info.st_mode) or info.st_size > MAX_FILE_BYTES:
            return None
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


class Slice(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def _slices(names: list[str], n: int) -> list[Slice]:
    n = max(1, min(n, len(names)))
    return [Slice(names[i::n]) for i in range(n)]


class _GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repo = options["path"]
        self.parts = int(options.get("partitions", "8"))
        self.names = options["names"].split("\0") if options.get("names") else None


class DirtyReader(_GitReader):
    def partitions(self) -> list[Slice]:
        return [Slice([])]

    def read(self, partition: Slice) -> Iterator[tuple]:
        state = repo_state(self.repo)
        for i, name in enumerate(state.files):
            yield state.head_sha, i, name


class WorktreeReader(_GitReader):
    """The named files (by default the changed ones), one row at a time, repeats as given."""

    def partitions(self) -> list[Slice]:
        return _slices(repo_state(self.repo).files if self.names is None else self.names, self.parts)

    def read(self, partition: Slice) -> Iterator[tuple]:
        for name in partition.names:
            content = read_regular(self.repo, name)
            if content is not None:
                yield name, content


class CommittedReader(_GitReader):
    """The regular files of HEAD, read from the object store; none if there is no commit."""

    def partitions(self) -> list[Slice]:
        try:
            listed = os.fsdecode(git(self.repo, "ls-tree", "-r", "-l", "-z", "HEAD"))
        except subprocess.CalledProcessError:
            return [Slice([])]
        names = []
        for entry in listed.split("\0")[:-1]:
            about, _, name = entry.partition("\t")
            mode, kind, _, size = about.split()
            if kind == "blob" and mode != "120000" and int(size) <= MAX_FILE_BYTES:
                names.append(name)
        return _slices(names, self.parts)

    def read(self, partition: Slice) -> Iterator[tuple]:
        if not partition.names:
            return
        with subprocess.Popen(["git", "-C", self.repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as child:
            for name in partition.names:
                if "\n" in name:  # the batch protocol is by lines
                    yield name, git(self.repo, "show", f"HEAD:{name}")
                    continue
                child.stdin.write(b"HEAD:" + os.fsencode(name) + b"\n")
                child.stdin.flush()
                head = child.stdout.readline().split()
                if len(head) != 3:
                    continue
                content = child.stdout.read(int(head[2]))
                child.stdout.read(1)
                yield name, content


class _GitSource(DataSource):
    made = _GitReader
    fields = RAW_FILE

    def schema(self) -> StructType:
        return self.fields

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.made(dict(self.options))


class GitDirty(_GitSource):
    made, fields = DirtyReader, DIRTY_FILE

    @classmethod
    def name(cls) -> str:
        return "git_dirty"


class GitWorktree(_GitSource):
    made = WorktreeReader

    @classmethod
    def name(cls) -> str:
        return "git_worktree"


class GitCommitted(_GitSource):
    made = CommittedReader

    @classmethod
    def name(cls) -> str:
        return "git_committed"


def register(spark) -> None:
    for source in (GitDirty, GitWorktree, GitCommitted):
        spark.dataSource.register(source)
