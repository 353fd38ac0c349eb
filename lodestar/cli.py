"""Command line: search the repository that holds the current folder.

Exit codes: 0 something matched, 1 nothing did, 2 an error.
"""

from __future__ import annotations

import argparse
import logging
import os
import signal
import sys
import threading

from pyspark.sql import SparkSession

from .operators.index import Store
from .operators.render import rendered
from .operators.search import search, within
from .operators.state import refresh
from .plans.query import QuerySyntaxError, parse
from .schema import DIRTY
from .sources import git

VERSION = "0.1"
CACHE = ".lodestar-cache"
log = logging.getLogger("lodestar")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("lodestar", description=__doc__)
    out.add_argument("query", nargs="?")
    out.add_argument("-n", "--limit", type=int, default=0, help="show at most so many files")
    out.add_argument("-m", "--max-matches", type=int, default=0, help="show at most so many lines of a file")
    out.add_argument("-v", "--verbose", action="store_true")
    out.add_argument("--version", action="store_true")
    return out


def session() -> SparkSession:
    return SparkSession.builder.appName("lodestar").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def run(spark: SparkSession, folder: str, text: str, limit: int = 0, max_matches: int = 0) -> str:
    """The rendered answer; empty if nothing matched or all that did is out of date."""
    parse(text)  # before any work
    git.register(spark)
    repo = git.resolve_repo(folder)
    cache = os.path.join(repo, CACHE)
    store = Store(spark, f"file://{cache}")
    try:
        git.exclude(repo, f"/{CACHE}/")
    except OSError as e:  # then the cache shows up as a change, and each search indexes again
        log.warning("the cache folder is not excluded: %s", e)
    state = git.repo_state(repo)
    try:
        log.info("index: %s", refresh(spark, repo, store, os.path.join(cache, "lock"), state))
    except Exception as e:  # what was indexed before still serves
        if not store.exists():
            raise
        log.warning("indexing failed: %s", e)
    dirty = spark.createDataFrame([(f,) for f in state.files], DIRTY)
    now = store.manifest()

    def answer() -> str:
        return rendered(search(store.numbered(now), text, dirty, limit, max_matches, index=store.index(now)))

    return within(spark, answer)


def stop_jobs(spark: SparkSession) -> None:
    """End on a signal: running jobs are cancelled first."""

    def stop(number: int, _) -> None:
        spark.sparkContext.cancelAllJobs()
        sys.exit(128 + number)

    for number in (signal.SIGINT, signal.SIGTERM):
        signal.signal(number, stop)


def main(args: list[str] | None = None) -> int:
    options = parser().parse_args(args)
    if options.version:
        print(VERSION)
        return 0
    if options.query is None:
        parser().print_usage(sys.stderr)
        return 2
    logging.basicConfig(level=logging.INFO if options.verbose else logging.ERROR)
    try:
        spark = session()
        if threading.current_thread() is threading.main_thread():
            stop_jobs(spark)
        out = run(spark, os.getcwd(), options.query, options.limit, options.max_matches)
    except QuerySyntaxError as e:
        print(f"query: {e}", file=sys.stderr)
        return 2
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if not out:
        return 1
    print(out, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
