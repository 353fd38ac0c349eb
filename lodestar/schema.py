"""Schemas of the engine's relations.  All are fixed; none is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

#: One file of a collection.  ``is_overlay`` marks uncommitted content.
CORPUS = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("repo", T.StringType(), False),
        T.StructField("is_overlay", T.BooleanType(), False),
        T.StructField("lang", T.StringType(), True),
        T.StructField("content", T.StringType(), True),
    ]
)

LINE_MATCH = T.StructType(
    [
        T.StructField("line_number", T.IntegerType(), False),
        T.StructField("line", T.StringType(), True),
        T.StructField("before", T.ArrayType(T.StringType()), True),
        T.StructField("after", T.ArrayType(T.StringType()), True),
        T.StructField("symbol_kind", T.StringType(), True),
    ]
)

#: One search result.
FILE_MATCH = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("repo", T.StringType(), False),
        T.StructField("is_overlay", T.BooleanType(), False),
        T.StructField("lang", T.StringType(), True),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("line_matches", T.ArrayType(LINE_MATCH), True),
    ]
)

DIRTY = T.StructType([T.StructField("path", T.StringType(), False)])

#: A changed file of a working tree, as the status source gives it.
DIRTY_FILE = T.StructType(
    [
        T.StructField("head_sha", T.StringType(), False),
        T.StructField("position", T.IntegerType(), False),
        T.StructField("path", T.StringType(), False),
    ]
)

#: A regular file read from a working tree.
RAW_FILE = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("content", T.BinaryType(), False)])

COMMITTED, UNCOMMITTED = "committed", "uncommitted"
UNKNOWN_LANGUAGE = "unknown"
