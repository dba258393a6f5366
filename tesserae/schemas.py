"""Schemas of the index tables.  No column is null: what is missing is the empty string.

``ordinal`` numbers the rows of a file in source order, calls before value references within a
function; with the file path it makes every listing's order a total one.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, False) for n, t in columns])


S, I, L = T.StringType(), T.IntegerType(), T.LongType()  # noqa: E741

FILES = _schema(("path", S), ("mtime", L), ("size", L), ("content", T.BinaryType()))
LISTING = _schema(("path", S), ("mtime", L), ("size", L))
SYMBOLS = _schema(("name", S), ("kind", S), ("pkg", S), ("recv", S), ("file", S), ("line", I), ("end_line", I), ("sig", S), ("ordinal", I))
NAME_GRAMS = _schema(("gram", S), ("name", S))
REFS = _schema(("sym", S), ("kind", S), ("file", S), ("line", I), ("in_symbol", S), ("ordinal", I))
IDENTS = _schema(("name", S), ("file", S), ("line", I), ("in_symbol", S), ("ordinal", I))
FILE_META = _schema(("file", S), ("mtime", L))
ERRORS = _schema(("file", S), ("mtime", L), ("error", S))
META = _schema(("file_count", L), ("indexed_at", T.TimestampType()))
LINES = _schema(("file", S), ("line", I), ("content", S))
#: A term's occurrences in a block of lines, and the (tf, len) pairs of lines that no other line of the block betters.
BLOCKS = _schema(
    ("term", S), ("block", L), ("best", T.ArrayType(T.StructType([T.StructField("tf", I), T.StructField("len", I)]))),
    ("hits", T.ArrayType(T.StructType([T.StructField("file", S), T.StructField("line", I), T.StructField("len", I), T.StructField("at", T.ArrayType(I))]))),
)
TERM_COUNTS = _schema(("term", S), ("df", L))
CORPUS = _schema(("lines", L), ("tokens", L))
FTS_META = _schema(("path", S), ("mtime", L), ("lines", I))
GONE_FILES = _schema(("path", S))
GONE_VALUES = _schema(("name", S))
EVENTS = _schema(("path", S), ("op", S), ("seq", L))
#: What one pass over a file yields: symbols, calls and identifiers, or an error, in one table.
SCANNED = _schema(("rec", S), ("name", S), ("kind", S), ("pkg", S), ("recv", S), ("file", S), ("line", I), ("end_line", I), ("sig", S), ("in_symbol", S), ("ordinal", I), ("mtime", L))
