import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestar.plans.query import And, Atom, Const, Not, Or, QuerySyntaxError, expand, parse, scoring_atoms, simplify

A, B, C = (Atom("word", x) for x in "abc")


@pytest.mark.parametrize(
    "text,root",
    [
        ("a", A),
        ("a b", And((A, B))),
        ("a or b", Or((A, B))),
        ("a b or c", Or((And((A, B)), C))),
        ("a (b or c)", And((A, Or((B, C))))),
        ("-a", Not(A)),
        ("--a", A),
        ("-(a or b) c", And((Not(Or((A, B))), C))),
        ("((a))", A),
        ("a a", A),
        ('"a b"', Atom("word", "a b")),
        ("file:src/x.go", Atom("file", "src/x.go")),
        ("-file:test", Not(Atom("file", "test"))),
        ("lang:Go", Atom("lang", "Go")),
        ("sym:Foo", Atom("sym", "Foo", False, True)),
        ("sym:foo", Atom("sym", "foo")),
        ("content:x.*y", Atom("content", "x.*y", True)),
        ('content:"x y"', Atom("content", "x y")),
        ("regex:ab", Atom("regex", "ab", True)),
        ("regex:a(b|c)d", Atom("regex", "a(b|c)d", True)),
        ("Foo", Atom("word", "Foo", False, True)),
        ("case:no Foo", Atom("word", "Foo")),
        ("case:yes a", Atom("word", "a", False, True)),
        ("a case:yes", Atom("word", "a", False, True)),
        (r"\Ba", Atom("word", r"\Ba", True)),
        ("a[", Atom("word", "a[")),
        ("a-b", Atom("word", "a-b")),
        ("http://x", Atom("word", "http://x")),
        ("case:auto", Const(True)),
    ],
)
def test_trees(text, root):
    assert parse(text).root == root


def test_a_space_splits_fields_too():
    assert parse("content:async def.*handler").root == And((Atom("content", "async"), Atom("word", "def.*handler", True)))


def test_type_file():
    assert parse("type:file config").files_only and parse("type:file config").root == Atom("word", "config")


@pytest.mark.parametrize("text", ["", "  ", "(a", "a)", "()", "a or", "or a", '"a', "file:", "case:maybe", "type:dir", "regex:(", r"regex:(a)\1", "regex:(?=a)", "regex:a++", "-"[:1] + "()"])
def test_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


def test_rewrites():
    assert simplify(And((Const(True), A, And((B, A))))) == And((A, B))
    assert simplify(Or((Const(True), A))) == Const(True)
    assert simplify(Not(Not(A))) == A
    assert expand(A) == Or((Atom("content", "a"), Atom("file", "a")))
    assert scoring_atoms(parse("a -b file:c (a or sym:d)").root) == [A, Atom("sym", "d")]


@given(st.text(alphabet='ab ()-"or:fileconttype.*[\\', max_size=30))
def test_parsing_ends_in_a_tree_or_an_error(text):
    try:
        query = parse(text)
    except QuerySyntaxError:
        return
    assert simplify(query.root) == query.root
