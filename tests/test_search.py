import math
import re

import pytest
from pyspark.sql import functions as F

from lodestar.operators import index, render, search
from lodestar.operators.symbols import language_of, symbol_of
from lodestar.plans.query import QuerySyntaxError, parse
from lodestar.schema import CORPUS, DIRTY

FILES = [
    ("src/main.go", "committed", False, "Go", "package main\n\nfunc main() {\n\tprintln(1)\n}\n"),
    ("src/util.go", "committed", False, "Go", "package util\n// main helper\nfunc Helper() {}\ntype Thing struct{}\n"),
    ("lib/app.py", "committed", False, "Python", "class App:\n    async def handle(self):\n        return main\n"),
    ("lib/app.py", "uncommitted", True, "Python", "class App:\n    def other(self):\n        pass\n"),
    ("new main.txt", "uncommitted", True, None, ""),
    ("gone.go", "committed", False, "Go", "func main() {}"),
    ("nul.bin", "committed", False, None, None),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(FILES, CORPUS)


def paths(rows):
    return [(r.path, r.is_overlay) for r in rows.collect()]


@pytest.mark.parametrize(
    "text,want",
    [
        ("main", {"src/main.go", "src/util.go", "lib/app.py", "new main.txt", "gone.go"}),
        ("file:main", {"src/main.go", "new main.txt"}),
        ("content:main", {"src/main.go", "src/util.go", "lib/app.py", "gone.go"}),
        ("func main", {"src/main.go", "src/util.go", "gone.go"}),
        ('"func main"', {"src/main.go", "gone.go"}),
        ("lang:python", {"lib/app.py"}),
        ("-file:src -file:lib -lang:go", {"new main.txt", "nul.bin"}),
        ("(lang:go or lang:python) -main", {"lib/app.py"}),
        ("Helper", {"src/util.go"}),
        ("case:yes helper", {"src/util.go"}),
        ("sym:Helper or sym:App", {"src/util.go", "lib/app.py"}),
        ("sym:main", {"src/main.go", "gone.go"}),
        ("content:^func.*\\{$", {"src/main.go"}),
        ("regex:^package.(main|util)$", {"src/main.go", "src/util.go"}),
        ("qqq", set()),
    ],
)
def test_matching(corpus, text, want):
    assert {p for p, _ in paths(search.matched(corpus, parse(text)))} == want


def test_overlay_hides_stale_rows(spark, corpus):
    dirty = spark.createDataFrame([("lib/app.py",), ("gone.go",), ("new main.txt",)], DIRTY)
    assert sorted(paths(search.search(corpus, "main", dirty))) == [("new main.txt", True), ("src/main.go", False), ("src/util.go", False)]
    assert ("lib/app.py", True) in paths(search.search(corpus, "app", dirty))
    assert ("gone.go", False) in paths(search.search(corpus, "main"))
    assert search.has_match(search.search(corpus, "file:gone", dirty)) is False


def test_overlay_does_not_depend_on_order(spark, corpus):
    forwards = sorted(search.overlay(corpus).collect(), key=lambda r: r.path)
    backwards = sorted(search.overlay(spark.createDataFrame(FILES[::-1], CORPUS)).collect(), key=lambda r: r.path)
    assert forwards == backwards and len({r.path for r in forwards}) == len(forwards)
    same = spark.createDataFrame([("p", "committed", False, "Go", f"x{i}") for i in range(200)], CORPUS)
    assert search.overlay(same).count() == 1


def test_negation_keeps_files_without_content(corpus):
    assert ("nul.bin", False) in paths(search.matched(corpus, parse("-content:main")))


def test_repetitions_inside_repetitions_are_refused():
    for text in ("content:(a+)+b", "regex:(x*y|z+)*", "content:((ab)*c)+"):
        with pytest.raises(QuerySyntaxError):
            parse(text)
    for text in ("content:(ab)+c*", "regex:a+b+", "content:(a|b)*"):
        parse(text)


def test_a_search_reads_its_collection_once(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.createDataFrame(FILES, CORPUS).write.parquet(path)
    files = spark.read.schema(CORPUS).parquet(path)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    assert scans(search.matched(files, parse("func main"))) == 0  # worked out in the one job
    assert scans(render.blocks(search.search(files, "func main"))) == 0


def test_few_files_are_named_to_the_scan(spark, tmp_path):
    store = index.Store(spark, f"file://{tmp_path}/s")
    store.publish(index.Manifest(committed=store.write(spark.createDataFrame(FILES, CORPUS), "committed")))
    plan = store.index().narrowed(store.numbered(), parse("Helper"))._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^]]*In\(file|PushedFilters: \[[^]]*EqualTo\(file|PushedFilters: \[[^]]*file", plan)
    assert store.index().files == len(FILES)


def test_a_capped_search_of_shards(spark, corpus, monkeypatch):
    monkeypatch.setattr(search, "SHARD_CAP", 1)
    where = corpus.select("path", "repo", F.when(F.col("path").startswith("src"), 1).otherwise(2).alias("shard"))
    whole, cut = paths(search.search(corpus, "main")), paths(search.search(corpus, "main", capped=True, shards=where))
    assert [p for p, _ in cut if p.startswith("src")] == ["src/main.go"] and set(cut) < set(whole)


def test_scores(corpus):
    rows = {(r.path, r.repo): r for r in search.matched(corpus, parse("main")).collect()}
    n, avgdl = len(FILES), sum(len(f[4] or "") for f in FILES) / len(FILES)
    tf = {(f[0], f[1]): (f[4] or "").lower().count("main") + ("main" in f[0]) for f in FILES}
    df = sum(v > 0 for v in tf.values())
    for (path, repo), r in rows.items():
        dl = next(len(f[4] or "") for f in FILES if f[:2] == (path, repo))
        t = tf[path, repo]
        want = math.log(1 + (n - df + 0.5) / (df + 0.5)) * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * dl / avgdl))
        assert r.score == pytest.approx(want, abs=1e-6)


def test_limits_are_prefixes(corpus):
    whole = paths(search.search(corpus, "main"))
    for n in (-1, 0, 1, 2, 50):
        assert paths(search.search(corpus, "main", limit=n)) == (whole[:n] if n > 0 else whole)
    every = {r.path: r.line_matches for r in search.search(corpus, "main or func").collect()}
    for r in search.search(corpus, "main or func", max_matches=1).collect():
        assert r.line_matches == every[r.path][:1]


def test_lines_context_and_symbols(corpus):
    row = next(r for r in search.search(corpus, "main").collect() if r.path == "src/main.go")
    assert [(m.line_number, m.line, m.symbol_kind) for m in row.line_matches] == [(1, "package main", None), (3, "func main() {", "func")]
    assert row.line_matches[1].before == ["package main", ""] and row.line_matches[1].after == ["\tprintln(1)", "}"]
    for text in ("type:file main", "lang:go"):
        assert all([m.line_number for m in r.line_matches] == [0] for r in search.search(corpus, text).collect())


def test_a_capped_search_is_a_prefix(corpus, monkeypatch):
    monkeypatch.setattr(search, "MATCH_CAP", 3)
    assert paths(search.search(corpus, "main", capped=True)) == paths(search.search(corpus, "main"))[:2]


@pytest.mark.parametrize("text", ["main", "func main", "handle or Thing", "content:helper", "-main", "sym:App", "ma", "file:main.go", "(a or b) main"])
def test_pruning_loses_nothing(corpus, text):
    postings = index.postings(corpus)
    direct = paths(search.matched(corpus, parse(text)))
    kept = index.pruned(corpus, postings, text)
    assert set(direct) <= {(r.path, r.is_overlay) for r in kept.collect()}
    whole = index.Index(postings, len(FILES), sum(len(f[4] or "") for f in FILES))
    scores = lambda rows: {(r.path, r.is_overlay): r.score for r in rows.collect()}
    assert scores(search.matched(corpus, parse(text), whole)) == pytest.approx(scores(search.matched(corpus, parse(text))))


def test_a_search_has_its_time(spark, corpus):
    assert len(search.within(spark, search.search(corpus, "main").collect, 60)) == 5
    slow = spark.range(1, 400_000_000_000, numPartitions=4).selectExpr("sum(sqrt(id))")
    with pytest.raises(TimeoutError):
        search.within(spark, slow.collect, 1)


def test_postings(corpus):
    rows = index.postings(corpus).join(corpus.withColumn("file", index.file_number()), "file")
    got = {(r.gram, r.path, r.repo) for r in rows.select(index.gram_text(F.col("gram")).alias("gram"), "path", "repo").collect()}
    want = {
        (s[i : i + 3], f[0], f[1])
        for f in FILES for s in [*(f[4] or "").lower().split("\n"), f[0].lower()] for i in range(len(s) - 2)
    }
    assert got == want


def test_shards(corpus):
    rows = index.shards(corpus, 40).collect()
    total = 0
    for r in sorted(rows, key=lambda r: (r.path if "/" not in r.path else r.path.split("/")[0] + "/", r.path, r.repo)):
        total += r.bytes
        assert r.shard == (max(total, 1) - 1) // 40


def test_languages(spark):
    rows = spark.createDataFrame(
        [("a/b.go", ""), ("X.PY", None), ("sub/Makefile", ""), ("run", "#!/usr/bin/env python3\n"), ("run", "#!/bin/sh -e"), ("run", "# no"), ("x.tsx", "")],
        "path string, content string",
    )
    found = rows.select(language_of(F.col("path"), F.col("content")), language_of(F.col("path"))).collect()
    assert [r[0] for r in found] == ["Go", "Python", "Makefile", "Python", "Shell", None, "TypeScript"]
    assert [r[1] for r in found] == ["Go", "Python", "Makefile", None, None, None, "TypeScript"]


@pytest.mark.parametrize(
    "lang,line,kind,name",
    [
        ("C", "static int add_up(int a, int b)", "function", "add_up"), ("C", "    return add_up(a);", None, None), ("C", "#define LIMIT 3", "macro", "LIMIT"),
        ("C++", "void Tree::grow(int n) {", "function", "Tree::grow"), ("C++", "class Tree : public Plant {", "class", "Tree"),
        ("C#", "public sealed class Basket", "class", "Basket"), ("C#", "    private int Weigh(Fruit f)", "method", "Weigh"),
        ("TypeScript", "export interface Shape {", "interface", "Shape"), ("Ruby", "  def ripe?", "method", "ripe?"), ("PHP", "public function pick()", "function", "pick"),
        ("Kotlin", "data class Seed(val n: Int)", "class", "Seed"), ("Swift", "func water() {", "function", "water"), ("Scala", "case class Leaf(n: Int)", "class", "Leaf"),
        ("Shell", "tidy_up() {", "function", "tidy_up"), ("SQL", "CREATE TABLE plots (", "table", "plots"), ("Markdown", "## Sowing times", "section", "Sowing times"),
        ("Rust", "pub trait Grows {", "trait", "Grows"),
    ],
)
def test_symbols_of_languages(spark, lang, line, kind, name):
    row = spark.range(1).select(symbol_of(F.lit(line), F.lit(lang)).alias("s")).first()
    assert (row.s and (row.s.kind, row.s.name)) == (kind and (kind, name))


def test_top_n_is_planned_as_one(corpus):
    plan = search.ranked(search.matched(corpus, parse("main")), 3)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    assert not re.search(r"PythonUDF|ArrowEval|BatchEval", plan)
