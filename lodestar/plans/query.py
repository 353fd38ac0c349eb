"""The query language: tokens, syntax tree and rewrites.

``word``        substring of content or path          ``content:re``  content only
``regex:re``    regular expression                    ``sym:name``    symbol definitions
``file:s``      path                                  ``lang:x``      language
``case:yes|no|auto``                                  ``type:file``   paths only
A space is AND, ``or`` is OR, ``-`` negates an atom or group, parentheses group, double quotes
keep spaces.  A value with regular-expression characters is one if it compiles, else literal;
in ``file:`` and ``lang:`` a dot alone does not make it one.
"""

from __future__ import annotations

import re
from re import _parser as _sre
from dataclasses import dataclass, replace

ATOMS = ("word", "content", "regex", "sym", "file", "lang")
META = set("\\.+*?()|[]{}^$")
#: Constructs outside linear-time engines: look-around, atomic groups, back-references, possessive.
UNSUPPORTED = re.compile(r"\(\?(?:[=!>]|<[=!]|P=)|\\[1-9]|\\k<|(?<!\\)[*+?}]\+")


class QuerySyntaxError(ValueError):
    """The query cannot be parsed."""


@dataclass(frozen=True)
class Atom:
    kind: str
    value: str
    is_regex: bool = False
    case_sensitive: bool = False


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Const:
    value: bool


Node = Atom | And | Or | Not | Const


@dataclass(frozen=True)
class Query:
    root: Node
    files_only: bool = False


def tokenize(text: str) -> list[tuple[str, str]]:
    """(kind, value): ``(``, ``)``, ``-`` and ``text``; the text of quoted parts is marked by NUL."""
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif c in "()":
            out.append((c, c))
            i += 1
        elif c == "-" and i + 1 < len(text) and not text[i + 1].isspace():
            out.append(("-", c))
            i += 1
        else:
            value, depth = "", 0
            while i < len(text):
                c = text[i]
                if c == '"':
                    end = text.find('"', i + 1)
                    if end < 0:
                        raise QuerySyntaxError("a quotation is not closed")
                    value += "\0" + text[i + 1 : end]
                    i = end + 1
                    continue
                if c == "\\" and i + 1 < len(text):
                    value += text[i : i + 2]
                    i += 2
                    continue
                if c.isspace() or (c == ")" and depth == 0):
                    break
                depth += (c == "(") - (c == ")")
                value += c
                i += 1
            out.append(("text", value))
    return out


def compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def _repeats_again(parsed, inside: bool = False) -> bool:
    """Whether an unbounded repetition stands inside another: such patterns may try a line in more
    ways than there is time for."""
    for op, value in parsed:
        repeat = op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT) and value[1] == _sre.MAXREPEAT
        if repeat and inside:
            return True
        for part in value if isinstance(value, tuple) else ():
            for branch in part if isinstance(part, list) else [part]:
                if isinstance(branch, _sre.SubPattern) and _repeats_again(branch, inside or repeat):
                    return True
    return False


def _check_regex(pattern: str) -> str:
    if UNSUPPORTED.search(pattern):
        raise QuerySyntaxError(f"look-around, back-references and possessive quantifiers are not supported: {pattern}")
    if not compiles(pattern):
        raise QuerySyntaxError(f"not a regular expression: {pattern}")
    if _repeats_again(_sre.parse(pattern)):
        raise QuerySyntaxError(f"a repetition inside a repetition is not supported: {pattern}")
    return pattern


def make_atom(kind: str, value: str, case: str) -> Atom:
    quoted = value.startswith("\0")
    value = value.replace("\0", "")
    if not value:
        raise QuerySyntaxError(f"{kind}: needs a value")
    special = set(value) & META
    if kind in ("file", "lang"):
        special -= {"."}
    is_regex = kind == "regex" or (bool(special) and compiles(value) and not (quoted and kind == "word"))
    if is_regex:
        _check_regex(value)
    letters = re.sub(r"\\.", "", value) if is_regex else value
    sensitive = case == "yes" or (case == "auto" and letters != letters.lower())
    return Atom(kind, value, is_regex, sensitive and kind != "lang")


class _Parser:
    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0
        self.case, self.files_only = "auto", False
        for kind, value in tokens:  # modes hold for the whole query, wherever they stand
            if kind == "text" and value.startswith("case:"):
                self.case = value[5:]
                if self.case not in ("yes", "no", "auto"):
                    raise QuerySyntaxError("case: is yes, no or auto")
            if kind == "text" and value.startswith("type:"):
                if value != "type:file":
                    raise QuerySyntaxError("type: is file")
                self.files_only = True

    def peek(self) -> tuple[str, str] | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def either(self) -> Node:
        parts = [self.both()]
        while self.peek() == ("text", "or"):
            self.at += 1
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self) -> Node:
        parts = []
        while (token := self.peek()) and token[0] != ")" and token != ("text", "or"):
            parts.append(self.one())
        if not parts:
            raise QuerySyntaxError("an operand is missing")
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def one(self) -> Node:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "-":
            token = self.peek()
            if token is None or token[0] not in ("(", "text", "-"):
                raise QuerySyntaxError("nothing to negate")
            return Not(self.one())
        if kind == "(":
            inner = self.either()
            if self.peek() != (")", ")"):
                raise QuerySyntaxError("a parenthesis is not closed")
            self.at += 1
            return inner
        field, colon, rest = value.partition(":")
        if colon and field in ("case", "type"):
            return Const(True)
        if colon and field in ATOMS[1:]:
            return make_atom(field, rest, self.case)
        return make_atom("word", value, self.case)


def simplify(node: Node) -> Node:
    """Flatten, drop constants and double negations, keep the order and one of equal parts."""
    if isinstance(node, Not):
        inner = simplify(node.part)
        if isinstance(inner, Not):
            return inner.part
        return Const(not inner.value) if isinstance(inner, Const) else Not(inner)
    if isinstance(node, And | Or):
        kind, stop = type(node), isinstance(node, Or)
        parts: list[Node] = []
        for p in map(simplify, node.parts):
            for q in p.parts if isinstance(p, kind) else (p,):
                if isinstance(q, Const):
                    if q.value == stop:
                        return Const(stop)
                elif q not in parts:
                    parts.append(q)
        if not parts:
            return Const(not stop)
        return parts[0] if len(parts) == 1 else kind(tuple(parts))
    return node


def expand(node: Node) -> Node:
    """A word, or ``regex:``, means content or path."""
    if isinstance(node, Not):
        return Not(expand(node.part))
    if isinstance(node, And | Or):
        return type(node)(tuple(map(expand, node.parts)))
    if isinstance(node, Atom) and node.kind in ("word", "regex"):
        return Or((replace(node, kind="content"), replace(node, kind="file")))
    return node


def parse(text: str) -> Query:
    """The simplified tree, before ``expand``; raises ``QuerySyntaxError``."""
    parser = _Parser(tokenize(text))
    if not parser.tokens:
        raise QuerySyntaxError("the query is empty")
    root = parser.either()
    if parser.peek() is not None:
        raise QuerySyntaxError("a parenthesis is not open")
    return Query(simplify(root), parser.files_only)


def scoring_atoms(node: Node) -> list[Atom]:
    """Distinct atoms that score, in order: those on content, unless negated."""
    if isinstance(node, Atom):
        return [node] if node.kind in ("word", "content", "regex", "sym") else []
    if isinstance(node, And | Or):
        return list(dict.fromkeys(a for p in node.parts for a in scoring_atoms(p)))
    return []
