"""Source trees: lists and reads the files of a folder, in tasks.

A tree is listed by rounds: a table of folders, dealt out, gives their entries; the folders among
them that may be entered are the next round's table.  So there are as many rounds as the tree is
deep, the driver sees no file, and a folder's entries are one task's work.  Folders are read through
Arrow's file systems: a path with a scheme may lie in any store these reach, a plain path is local.
Reading deals the listed files to tasks by size.  Folders named in ``SKIPPED`` or starting with a dot
are not entered; the root always is; links to folders are not followed; a name that is not Unicode,
a folder that cannot be read and a file that is gone are passed over.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.globs import any_match, base_name
from tesserae.schemas import FILES, LISTING
from tesserae.workspace import written

#: Folders that are never entered, generated files, config files and their largest size.
SKIPPED = frozenset(("vendor", ".git", "node_modules", "testdata"))
GENERATED = ("_gen.go", ".pb.go", "_mock.go")
CONFIG_EXTENSIONS = ("yaml", "yml", "toml", "json", "env", "ini")
CONFIG_BYTES = 51200
#: Bytes of one partition.
PARTITION_BYTES = 32 << 20


def normal(path: str) -> str:
    """One spelling for each path: no ``./`` in front, no doubled separators."""
    return os.path.normpath(path)


def _entries(folder: str) -> list[tuple[str, bool, int, int]]:
    """(path, is a folder, time in ns, size) of what is in a folder; nothing if it cannot be read."""
    out = []
    if "://" not in folder:
        try:
            found = list(os.scandir(folder))
        except OSError:
            return []
        for e in found:
            try:
                e.path.encode()
                stat = e.stat()
                out.append((e.path, e.is_dir(follow_symlinks=False), stat.st_mtime_ns, stat.st_size))
            except (OSError, UnicodeEncodeError):
                continue
        # A link to a folder is neither a file nor entered.
        return [r for r in out if r[1] or not os.path.isdir(r[0])]
    fs, path = pafs.FileSystem.from_uri(folder)
    prefix = folder[: len(folder) - len(path)] if folder.endswith(path) else folder.split("://")[0] + "://"
    try:
        found = fs.get_file_info(pafs.FileSelector(path))
    except OSError:
        return []
    return [(prefix + i.path, i.type == pafs.FileType.Directory, i.mtime_ns or 0, i.size or 0) for i in found]


#: Folders that one task lists in a round, about.
FOLDERS = 64
ENTRIES = "path string, folder boolean, mtime_ns long, size long"


def entries_of(folders: DataFrame) -> DataFrame:
    """path, folder, mtime_ns, size of what is in some folders (a column ``path``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                if rows := _entries(folder):
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["path", "folder", "mtime_ns", "size"])

    return folders.select("path").mapInArrow(run, ENTRIES)


def tree_entries(spark: SparkSession, root: str, skipped: Sequence[str] = tuple(SKIPPED), dots: bool = False) -> DataFrame:
    """path, mtime_ns, size of all files under a folder.  Each round's entries are written once: the
    files of a round stay where they are, its folders are the next round."""
    name = F.regexp_extract("path", "([^/]*)/?$", 1)
    enter = ~name.isin(*skipped) if skipped else F.lit(True)
    enter = enter if dots else enter & ~name.startswith(".")
    folders = spark.createDataFrame([(root if "://" in root else normal(root),)], "path string")
    rounds = []
    n = 1
    while n:
        here = written(entries_of(folders.repartition(max(1, -(-n // FOLDERS))) if n > FOLDERS else folders.coalesce(1)), "tree-round")
        rounds.append(here.where("not folder"))
        folders = here.where(F.col("folder") & enter).select("path")
        n = folders.count()
    # Entries of the folder ``.`` have no prefix.
    return reduce(DataFrame.unionByName, rounds).select(F.regexp_replace("path", r"^\./", "").alias("path"), "mtime_ns", "size")


def listing(spark: SparkSession, root: str, suffixes: str = "", skipped: str | None = None, dots: str = "false") -> DataFrame:
    """path, mtime (seconds), size of the files under ``root``; nothing is read.  ``suffixes`` are the
    ends of lower-cased names to take, ``skipped`` the folders that are not entered."""
    off = tuple(SKIPPED) if skipped is None else tuple(x for x in skipped.split(",") if x)
    found = tree_entries(spark, root, off, dots == "true")
    if suffixes:
        found = found.where(reduce(lambda a, b: a | b, [F.lower("path").endswith(x) for x in suffixes.split(",")]))
    return found.select("path", F.floor(F.col("mtime_ns") / 1_000_000_000).cast("long").alias("mtime"), "size")


def files(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """path, mtime, size, content of the files under ``root``."""
    return contents_of(listing(spark, root, **options))


def some_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The given files, as far as they exist."""
    rows = []
    for p in paths:
        try:
            s = os.stat(p)
        except OSError:
            continue
        rows.append((normal(p), int(s.st_mtime), s.st_size))
    return contents_of(spark.createDataFrame(rows, LISTING)) if rows else spark.createDataFrame([], FILES)


def contents_of(listed: DataFrame) -> DataFrame:
    """path, mtime, size, content of listed files (path, mtime, size) that can still be read; tasks
    open these files alone, each about ``PARTITION_BYTES`` of them in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, mtime in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    data = _bytes(path)
                except OSError:
                    continue
                rows.append((path, mtime, len(data), data))
                held += len(data)
                if held > PARTITION_BYTES:
                    yield _contents(rows)
                    rows, held = [], 0
            if rows:
                yield _contents(rows)

    size = listed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).collect()[0]["bytes"]
    parts = max(1, -(-size // PARTITION_BYTES))
    dealt = listed.select("path", "mtime").repartition(parts, "path") if parts > 1 else listed.select("path", "mtime").coalesce(1)
    return dealt.mapInArrow(run, FILES)


def _bytes(path: str) -> bytes:
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(at) as f:
        return f.read()


def _contents(rows: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], FILES.names)


def is_symbol_source(path: Column) -> Column:
    """Files the symbol index takes: the suffix counts with its case."""
    return path.endswith(".go")


def is_search_source(path: Column, size: Column, config_files: bool = False) -> Column:
    """Files the batch search index takes: Go files that are not generated, and on request small
    config files."""
    ext = F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))
    generated = F.lit(False)
    for suffix in GENERATED:
        generated = generated | path.endswith(suffix)
    take = (ext == "go") & ~generated
    return take | (ext.isin(*CONFIG_EXTENSIONS) & (size <= CONFIG_BYTES)) if config_files else take


def is_configured(path: Column, size: Column, include: list[str], exclude_dirs: list[str], max_kb: int) -> Column:
    """Files that the configuration names: pattern, folders, size."""
    parents = F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/")
    outside = F.size(F.array_intersect(parents, F.array(*map(F.lit, exclude_dirs)))) == 0 if exclude_dirs else F.lit(True)
    return any_match(path, include) & outside & (size <= max_kb * 1024)


def oversize(files: DataFrame, pattern: str, max_kb: int, exclude_dirs: list[str]) -> DataFrame:
    """path, shown: files of a pattern that are larger than allowed, as ``path (12.3KB)``, halves to the
    even digit as C and Go print them; a folder is left out if it is the file's own parent."""
    parent = F.element_at(F.split(F.concat(F.lit("./"), F.col("path")), "/"), -2)
    big = files.where(any_match(F.col("path"), [pattern]) & (F.col("size") > max_kb * 1024))
    if exclude_dirs:
        big = big.where(~parent.isin(*exclude_dirs))
    return big.select("path", F.format_string("%s (%.1fKB)", "path", F.bround(F.col("size") / F.lit(1024.0), 1)).alias("shown"))
