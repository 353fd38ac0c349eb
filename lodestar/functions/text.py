"""Column functions on text, lines and matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT_LINES = 3


def split_lines(content: Column) -> Column:
    """Lines without their ends; an end at the very end of the text does not open another line."""
    parts = F.split(content, "\n", -1)
    last_is_empty = F.element_at(parts, -1) == ""
    return F.when(last_is_empty, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def count_lines(content: Column) -> Column:
    """Number of elements of ``split_lines``, without making them."""
    newlines = F.length(content) - F.length(F.translate(content, "\n", ""))
    return F.when(content == "", 0).otherwise(newlines + F.when(content.endswith("\n"), 0).otherwise(1)).cast("int")


def trim_space(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def right_align(number: Column, width: Column) -> Column:
    """Padded on the left to ``width``; longer numbers are not cut."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(width, F.length(digits)), " ")


def count_literal(text: Column, literal: str) -> Column:
    """Occurrences of a literal that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def before(lines: Column, number: Column, n: int = CONTEXT_LINES) -> Column:
    """Up to ``n`` lines before line ``number`` (from 1)."""
    first = F.greatest(number - n, F.lit(1))
    return F.slice(lines, first, F.greatest(number - first, F.lit(0)))


def after(lines: Column, number: Column, n: int = CONTEXT_LINES) -> Column:
    """Up to ``n`` lines after line ``number``."""
    return F.slice(lines, number + 1, F.lit(n))


def skip_fields(record: Column, fields: int) -> Column:
    """What follows the first ``fields`` fields, each ended by one space; empty if there are fewer."""
    parts = F.split(record, " ", fields + 1)
    return F.when(F.size(parts) > fields, F.element_at(parts, F.lit(fields + 1))).otherwise("")


def short_hash(*parts: Column) -> Column:
    """16 hex digits of a stable hash of the parts."""
    return F.substring(F.sha2(F.concat(*parts).cast("binary"), 256), 1, 16)
