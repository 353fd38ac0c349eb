"""From syntax trees to column expressions over ``CORPUS`` rows.

Nothing here moves rows: a file's truth is a filter over its own content and lines.  The columns
``lines`` (array of string) and, for ``sym:``, ``symbols`` (array of struct name, kind) must be
there if ``needs_lines`` or ``needs_symbols`` say so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import count_literal
from .query import And, Atom, Const, Node, Not, Or


def java_pattern(atom: Atom) -> str:
    """The dialect's flags: only a line feed ends a line; folding knows all of Unicode."""
    return ("(?d)" if atom.case_sensitive else "(?diu)") + atom.value


def test(text: Column, atom: Atom, lowered: Column | None = None) -> Column:
    """Whether ``text`` holds the atom's value; ``lowered`` may give the text in lower case."""
    if atom.is_regex:
        return text.rlike(java_pattern(atom))
    if atom.case_sensitive:
        return text.contains(atom.value)
    return (F.lower(text) if lowered is None else lowered).contains(atom.value.lower())


def _content(atom: Atom) -> Column:
    """A literal has no line end, so that a line holds it is that the content does."""
    if atom.is_regex:
        return F.exists("lines", lambda line: test(line, atom))
    return test(F.col("content"), atom)


def _path(atom: Atom) -> Column:
    return test(F.col("path"), atom)


def _lang(atom: Atom) -> Column:
    lang = F.coalesce("lang", F.lit(""))
    return lang.rlike("(?diu)^(?:" + atom.value + ")$") if atom.is_regex else F.lower(lang) == atom.value.lower()


def line_test(line: Column, symbol: Column | None, atom: Atom) -> Column:
    """Whether a line, with its symbol or null, is one that the atom asks for."""
    if atom.kind == "sym":
        return F.coalesce(test(symbol["name"], atom), F.lit(False))
    return test(line, atom)


def predicate(node: Node) -> Column:
    if isinstance(node, Const):
        return F.lit(node.value)
    if isinstance(node, Not):
        return ~predicate(node.part)
    if isinstance(node, And):
        return reduce(lambda a, b: a & b, map(predicate, node.parts))
    if isinstance(node, Or):
        return reduce(lambda a, b: a | b, map(predicate, node.parts))
    if node.kind in ("word", "regex"):
        return _path(node) | F.coalesce(_content(node), F.lit(False))
    if node.kind == "sym":
        return F.exists("symbols", lambda s: line_test(s, s, node))
    if node.kind == "content":  # a file without content holds nothing, and so satisfies the negation
        return F.coalesce(_content(node), F.lit(False))
    return {"file": _path, "lang": _lang}[node.kind](node)


def frequency(atom: Atom) -> Column:
    """Occurrences in a file: in its content, and one if its path holds a word."""
    if atom.kind == "sym":
        return F.size(F.filter("symbols", lambda s: line_test(s, s, atom))).cast("long")
    if atom.is_regex:
        pattern = F.lit(java_pattern(atom))
        found = F.aggregate("lines", F.lit(0).cast("long"), lambda n, line: n + F.regexp_count(line, pattern))
    elif atom.case_sensitive:
        found = count_literal(F.col("content"), atom.value)
    else:
        found = count_literal(F.lower("content"), atom.value.lower())
    return found if atom.kind == "content" else found + _path(atom).cast("long")


def _any(node: Node, test_) -> bool:
    if isinstance(node, And | Or):
        return any(_any(p, test_) for p in node.parts)
    if isinstance(node, Not):
        return _any(node.part, test_)
    return isinstance(node, Atom) and test_(node)


def needs_symbols(node: Node) -> bool:
    return _any(node, lambda a: a.kind == "sym")


def needs_lines(node: Node) -> bool:
    return _any(node, lambda a: a.is_regex and a.kind in ("word", "content", "regex"))


def needs_content(node: Node) -> bool:
    return _any(node, lambda a: a.kind in ("word", "content", "regex", "sym"))
