"""From file contents to symbols and references.

One pass of the scanner over each file yields symbols, calls and all body identifiers in a single
table; which identifiers are references to known variables and constants is then a join, so the
global step needs no second parse.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.golang import scan
from tesserae.schemas import SCANNED

_NAMES = SCANNED.names
_KINDS = {"ordinal": pa.int32(), "line": pa.int32(), "end_line": pa.int32(), "mtime": pa.int64()}


#: Characters of a reason that are kept.
REASON = 300


def scanned_rows(path: str, mtime: int, content: bytes) -> list[tuple]:
    """The rows of one file; a file that cannot be scanned yields one row of kind ``error`` with the
    reason, and none that would count it as indexed."""
    try:
        found = scan(content)
    except Exception as e:  # one odd file must not stop an index: it is set apart, and counted
        return [("error", f"{type(e).__name__}: {e}"[:REASON], "", "", "", path, 0, 0, "", "", 0, mtime)]
    rows = [("file", "", "", "", "", path, 0, 0, "", "", 0, mtime)]
    for i, s in enumerate(found.symbols):
        rows.append(("symbol", s.name, s.kind, found.package, s.recv, path, s.line, s.end_line, s.sig, "", i, mtime))
    for i, u in enumerate(found.uses):
        rows.append(("call" if u.call else "ident", u.name, "", found.package, "", path, u.line, u.line, "", u.in_symbol, i, mtime))
    return rows


def scan_files(files: DataFrame) -> DataFrame:
    """``files`` (path, mtime, content) to the tagged table of ``SCANNED``: rows of kind file,
    symbol, call, ident and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, mtime, content in zip(*[batch.column(i) for i in range(3)], strict=True):
                rows += scanned_rows(path.as_py(), mtime.as_py(), content.as_py())
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return files.select("path", "mtime", "content").mapInArrow(run, SCANNED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS.get(n, pa.string())) for n, c in zip(_NAMES, columns, strict=True)], _NAMES)


def symbols_of(scanned: DataFrame) -> DataFrame:
    return scanned.where("rec = 'symbol'").select("name", "kind", "pkg", "recv", "file", "line", "end_line", "sig", "ordinal")


def idents_of(scanned: DataFrame) -> DataFrame:
    return scanned.where("rec = 'ident'").select("name", "file", "line", "in_symbol", "ordinal")


def files_of(scanned: DataFrame) -> DataFrame:
    return scanned.where("rec = 'file'").select("file", "mtime")


def errors_of(scanned: DataFrame) -> DataFrame:
    """file, mtime, error of the files that could not be scanned."""
    return scanned.where("rec = 'error'").select("file", "mtime", F.col("name").alias("error"))


def known_values(symbols: DataFrame) -> DataFrame:
    """name, kind of all variables and constants of all packages; of several declarations of a
    name the last in file order counts."""
    named = symbols.where(F.col("kind").isin("var", "const"))
    return named.groupBy("name").agg(F.max_by("kind", F.struct("file", "ordinal")).alias("kind"))


def merged_values(stored: DataFrame, own: DataFrame) -> DataFrame:
    """The union of two (name, kind) maps; where both have a name the second one's kind counts."""
    both = stored.select("name", "kind", F.lit(0).alias("p")).unionByName(own.select("name", "kind", F.lit(1).alias("p")))
    return both.groupBy("name").agg(F.max_by("kind", "p").alias("kind"))


def references(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """Calls, and identifiers that name a known variable or constant.  Calls are not identifiers,
    so none is counted twice.  ``known`` grows with the code: the join is left to the planner."""
    calls = scanned.where("rec = 'call'").select(F.col("name").alias("sym"), F.lit("call").alias("kind"), "file", "line", "in_symbol", "ordinal")
    names = idents_of(scanned).join(known.select("name", F.concat("kind", F.lit("_ref")).alias("ref")), "name")
    return calls.unionByName(names.select(F.col("name").alias("sym"), F.col("ref").alias("kind"), "file", "line", "in_symbol", "ordinal"))


def package_of(files: DataFrame) -> DataFrame:
    """path, pkg: the name in each file's package clause, empty where there is none."""

    @F.pandas_udf("string")
    def name(content: pd.Series) -> pd.Series:
        return content.map(lambda c: scan(c).package)

    return files.select("path", name("content").alias("pkg"))


def index_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, refs, scanned) of all files."""
    scanned = scan_files(files)
    symbols = symbols_of(scanned)
    return symbols, references(scanned, known_values(symbols)), scanned


