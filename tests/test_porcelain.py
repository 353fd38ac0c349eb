import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestar.sources.porcelain import NO_HEAD, parse_status, parse_statuses

ABOUT = "N... 100644 100644 100644 abc123 def456"
HEAD = "# branch.oid abc123\0"
CASES = [
    (HEAD + f"1 .M {ABOUT} src/main.go\0", "abc123", ["src/main.go"]),
    (HEAD + "? new_file.txt\0", "abc123", ["new_file.txt"]),
    (HEAD + "u UU N... 1 2 3 4 a b c conflict.go\0", "abc123", ["conflict.go"]),
    (HEAD + f"2 R. {ABOUT} R100 new.go\0? suspicious.go\0? real_untracked.go\0", "abc123", ["new.go", "real_untracked.go"]),
    (HEAD + f"2 R. {ABOUT} R100 a\x002 R. {ABOUT} R100 b\x002 R. {ABOUT} R100 c\0", "abc123", ["a", "c"]),
    ("", NO_HEAD, []),
    ("\0\0\0", NO_HEAD, []),
    ("# branch.oid (initial)\0? a\0", "(initial)", ["a"]),
    (HEAD + "? a\0? a\0? b\0", "abc123", ["a", "b"]),
    (HEAD + "? cut off", "abc123", []),
    (HEAD + "\0x\0!! ignored\0? ok\0", "abc123", ["ok"]),
    (HEAD + "? a b -> c\nd é\0", "abc123", ["a b -> c\nd é"]),
    (HEAD + "1 .M too few\0?\0", "abc123", []),
    (HEAD + "".join(f"? f{i}\0" for i in range(2000)), "abc123", [f"f{i}" for i in range(2000)]),
]


@pytest.mark.parametrize("raw,head,files", CASES)
def test_parse(raw, head, files):
    got = parse_status(raw)
    assert (got.head_sha, got.files, got.raw) == (head, files, raw)


def test_parse_many_at_once(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(99, None)], "id int, raw string")
    got = {r.id: (r.head_sha, r.files) for r in parse_statuses(rows).collect()}
    assert got == {i: (c[1], c[2]) for i, c in enumerate(CASES)} | {99: (NO_HEAD, [])}


@given(st.text(alphabet="#12u? .\0ab", max_size=60))
def test_any_status(raw):
    got = parse_status(raw)
    assert got.head_sha and all(got.files) and len(set(got.files)) == len(got.files)
