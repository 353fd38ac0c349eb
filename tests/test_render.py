import pytest
from pyspark.sql import functions as F

from lodestar.functions.text import count_lines, right_align, skip_fields, split_lines, trim_space
from lodestar.operators import render
from lodestar.schema import FILE_MATCH


def match(n, line, before=(), after=(), kind=None):
    return {"line_number": n, "line": line, "before": list(before), "after": list(after), "kind": kind}


def test_split_and_count(spark):
    cases = {"": [], "\n": [""], "a": ["a"], "a\n": ["a"], "a\nb": ["a", "b"], "a\n\nb\n": ["a", "", "b"], "\n\n\n": ["", "", ""]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in rows.select("t", split_lines(F.col("t")).alias("l"), count_lines(F.col("t")).alias("n")).collect():
        assert r.l == cases[r.t] and r.n == len(r.l)


def test_scalars(spark):
    one = spark.range(1)
    row = one.select(
        right_align(F.lit(7), F.lit(3)).alias("a"), right_align(F.lit(1000), F.lit(2)).alias("b"), trim_space(F.lit("\t x \n")).alias("c"),
        skip_fields(F.lit("1 a b c d"), 2).alias("d"), skip_fields(F.lit("1 a"), 2).alias("e"), skip_fields(F.lit("? a b"), 1).alias("f"),
    ).first()
    assert tuple(row) == ("  7", "1000", "x", "b c d", "", "a b")


@pytest.mark.parametrize(
    "path,lang,overlaid,matches,text",
    [
        ("garden/plan.go", "Go", False, [match(5, "func dig() {\n")], "## garden/plan.go (Go)\n  5 func dig() {"),
        ("beds/rows.py", "Python", True, [match(10, "def sow():\n")], "## beds/rows.py (Python) [uncommitted]\n  10 def sow():"),
        ("r.go", "Go", False, [match(15, "func Weed() {", kind="function")], "## r.go (Go)\n  15 [function] func Weed() {"),
        ("bare.go", "Go", False, [], "## bare.go (Go)"),
        ("x", "", False, [match(0, None)], "## x (unknown)\n  0 "),
        ("a", "Go", False, [match(3, "m", ["1", "2"], ["4", "5"]), match(6, "n", ["4", "5"], ["7"])], "## a (Go)\n  1 1\n  2 2\n  3 m\n  4 4\n  5 5\n  6 n\n  7 7"),
        ("a", "Go", False, [match(3, "m", ["2"], ["4"]), match(9, "n", ["8"], ["10"])], "## a (Go)\n   2 2\n   3 m\n   4 4\n\n   8 8\n   9 n\n  10 10"),
        ("a", "Go", False, [match(2, "m", ["x", "y", "1"])], "## a (Go)\n  1 1\n  2 m"),
        ("a", "Go", False, [match(4, "m", (), ["n", "6"]), match(5, "n", ["m"], ["6"])], "## a (Go)\n  4 m\n  5 n\n  6 6"),
        ("p" * 1000, "Go", False, [match(1, "y" * 10_000 + " é\U0001f600")], "## " + "p" * 1000 + " (Go)\n  1 " + "y" * 10_000 + " é\U0001f600"),
    ],
)
def test_one_file(spark, path, lang, overlaid, matches, text):
    rows = [(path, "r", overlaid, lang, 1.0, [(m["line_number"], m["line"], m["before"], m["after"], m["kind"]) for m in matches])]
    assert render.rendered(spark.createDataFrame(rows, FILE_MATCH)) == text


@pytest.mark.parametrize("numbers,after,width", [([], 0, 1), ([0], 0, 1), ([9], 0, 1), ([9], 1, 2), ([99], 3, 3), ([2**31 - 10], 3, 10)])
def test_width(spark, numbers, after, width):
    matches = [(n, "x", [], ["y"] * after, None) for n in numbers]
    df = spark.createDataFrame([("p", "r", False, "Go", 1.0, matches)], FILE_MATCH)
    assert render.line_width(df).first().width == width


def test_two_files_and_gap_between(spark):
    rows = [("b", "r", False, "Go", 1.0, [(1, "x\n", [], [], None)]), ("a", "r", True, None, 1.0, [(1, "y", [], [], "k")])]
    assert render.rendered(spark.createDataFrame(rows, FILE_MATCH)) == "## a (unknown) [uncommitted]\n  1 [k] y\n\n## b (Go)\n  1 x"
    assert render.rendered(spark.createDataFrame([], FILE_MATCH)) == ""
