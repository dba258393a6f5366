"""Versioned snapshots: folders of Parquet tables, and a log of which of them are current.

A version is a folder with all rows and a few layers above it, each with the new rows of some files
and the names of these files, whose rows below it are gone; so the change of a file writes that
file's rows.  ``log`` holds a numbered file for each version, the list of its folders, and the
highest number counts.  A writer writes its folder first and then creates the next number, which one
of several writers can do (a plain exclusive create of a small file); the others look again and put
their layer above what is there now.  What depends on the version below it is made again, or the
writer is told (``Conflict``) and starts over.

A reader takes a version once (``now``) and reads all tables of it.  Folders stay for ``retention``
after the last version that names them was replaced; folders that no version names may be those of a
writer at work and stay for ``ABANDONED``.  Tables are laid out for the lookups: symbols by kind and
name, references once by target and once by caller, posting blocks by term in segments of some blocks each.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import schemas
from tesserae.operators.lookups import name_grams
from tesserae.operators.maintenance import Delta, Index, with_files
from tesserae.plans.blocks import Layered, still_there
from tesserae.sources.folder import Folder

#: Sort columns of each table; row groups then hold ranges of them and can be passed over.
LAYOUT = {
    "symbols": ["name", "file", "ordinal"],
    "name_grams": ["gram", "name"],
    "refs": ["sym", "file", "ordinal"],
    "refs_by_caller": ["in_symbol", "file", "ordinal"],
    "idents": ["name", "file", "ordinal"],
    "files": ["file"],
    "errors": ["file"],
    "meta": [],
    "lines": ["file", "line"],
    "blocks": ["term", "block"],
    "term_counts": ["term"],
    "corpus": [],
    "fts_meta": ["path"],
    "gone_files": [],
    "gone_values": [],
}
#: Tables of which each task keeps the rows that it made and sorts them by itself.
SEGMENTED = {"blocks"}
#: How tables are written: a term of a segment is then in few pages, and others are passed over.
OPTIONS = {"blocks": {"parquet.page.row.count.limit": "1000", "compression": "zstd"}}
#: The column with the path, where it is not ``file``.
FILE_COLUMN = {"fts_meta": "path"}
#: Tables of numbers whose rows add up over the layers, by these columns; a layer has differences.
SUMMED = {"corpus": [], "term_counts": ["term"]}
#: Tables that may have rows too many: layers only add to them.
ADDED = {"name_grams"}
SCHEMAS = {"symbols": schemas.SYMBOLS, "name_grams": schemas.NAME_GRAMS, "refs": schemas.REFS, "refs_by_caller": schemas.REFS, "idents": schemas.IDENTS, "files": schemas.FILE_META, "errors": schemas.ERRORS, "meta": schemas.META, "lines": schemas.LINES, "blocks": schemas.BLOCKS, "term_counts": schemas.TERM_COUNTS, "corpus": schemas.CORPUS, "fts_meta": schemas.FTS_META, "gone_files": schemas.GONE_FILES, "gone_values": schemas.GONE_VALUES}
#: Layers of a version before they are written anew as one.
LAYERS = 8
#: Seconds for which a replaced version can still be read, and after which a folder without a version is nobody's.
RETENTION, ABANDONED = 600.0, 86_400.0
#: Versions between two looks for folders to delete.
SWEEP = 16
#: Seconds to wait for a log file that is there but not whole.
PATIENCE = 5.0

Tables = dict[str, DataFrame]


def laid_out(df: DataFrame, table: str) -> DataFrame:
    """The rows in the order in which the table is written."""
    keys = LAYOUT[table]
    if not keys:
        return df
    return (df if table in SEGMENTED else df.repartitionByRange(*keys[:2])).sortWithinPartitions(*keys)


class NoIndex(Exception):
    """There is no snapshot to read."""


class Conflict(Exception):
    """Another writer changed what this change was made from."""


@dataclass(frozen=True)
class View:
    """One version: the folders of its layers, the whole one first.  What later layers took away is one
    small table, joined once, however many layers there are."""

    spark: SparkSession
    root: str
    number: int
    names: tuple[str, ...]

    def layers(self) -> list[str]:
        return [os.path.join(self.root, x) for x in self.names]

    def layer(self, path: str, table: str) -> DataFrame:
        """The rows of one layer."""
        return self.spark.read.schema(SCHEMAS[table]).parquet(os.path.join(path, table))

    def read(self, table: str) -> DataFrame:
        """A table of this version.  Filters reach the files of every layer."""
        layers = self.layers()
        if not layers:
            raise NoIndex(f"no index in {self.root}")
        if table == "meta":
            return self.layer(layers[-1], table)
        df = self.layer(layers[0], table)
        if table in SUMMED:
            for path in layers[1:]:
                df = df.unionByName(self.layer(path, table))
            numbers = [c for c in df.columns if c not in SUMMED[table]]
            return df if len(layers) == 1 else df.groupBy(*SUMMED[table]).agg(*[F.sum(c).alias(c) for c in numbers])
        if table in ADDED:
            for path in layers[1:]:
                df = df.unionByName(self.layer(path, table))
            return df if len(layers) == 1 else df.distinct()
        if len(layers) == 1:
            return df
        every = self.tagged(table)
        rows = still_there(every, self.gone("gone_files", "path"), FILE_COLUMN.get(table, "file"))
        if table in ("refs", "refs_by_caller"):
            values = self.gone("gone_values", "name")
            rows = rows.join(values.withColumnRenamed("name", "sym"), "sym", "left").where((F.col("kind") == "call") | F.col("last").isNull() | (F.col("layer") >= F.col("last")))
        return rows.select(SCHEMAS[table].names)

    def tagged(self, table: str) -> DataFrame:
        """The rows of all layers, with the number of their ``layer``."""
        return reduce(DataFrame.unionByName, [self.layer(path, table).withColumn("layer", F.lit(i)) for i, path in enumerate(self.layers())])

    def gone(self, table: str, key: str) -> DataFrame:
        """What layers took away, and the ``last`` layer that did: rows below that one count no more."""
        above = [self.layer(path, table).withColumn("i", F.lit(i)) for i, path in enumerate(self.layers()) if i]
        return reduce(DataFrame.unionByName, above).groupBy(key).agg(F.max("i").alias("last"))

    def read_or_empty(self, table: str) -> DataFrame:
        return self.read(table) if self.names else self.spark.createDataFrame([], SCHEMAS[table])


class Store:
    """The snapshots of one kind (``symbols`` or ``search``) under a folder, which may lie in any
    store that Spark reads and writes."""

    def __init__(self, spark: SparkSession, root: str, retention: float = RETENTION) -> None:
        self.spark = spark
        self.root = root
        self.folder = Folder(spark, root)
        self.retention = retention

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.folder.names("log") if n.endswith(".json") and n[:-5].isdigit())

    def _entry(self, number: int) -> dict | None:
        """A version's log file; None while it is not whole."""
        try:
            return json.loads(self.folder.read(f"log/{number:020d}.json") or "")
        except ValueError:
            return None

    def now(self) -> View:
        """The current version."""
        for number in reversed(self._numbers()):
            if (entry := self._entry(number)) is not None:
                return View(self.spark, self.root, number, tuple(entry["layers"]))
        return View(self.spark, self.root, 0, ())

    def layers(self) -> list[str]:
        return self.now().layers()

    def current(self) -> str | None:
        """The folder written last."""
        return next(reversed(self.layers()), None)

    def read(self, table: str) -> DataFrame:
        return self.now().read(table)

    def read_or_empty(self, table: str) -> DataFrame:
        return self.now().read_or_empty(table)

    def _tables(self, tables: Tables, name: str | None = None) -> str:
        """Write tables into a folder of their own."""
        name = name or f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        for table, df in tables.items():
            laid_out(df.select(SCHEMAS[table].names), table).write.options(**OPTIONS.get(table, {})).mode("overwrite").parquet(os.path.join(self.root, name, table))
        return name

    def commit(self, make: Callable[[View], list[str]]) -> View:
        """Make ``make(current version)`` the folders of the next version.  Where another writer was
        first, both look again: ``make`` is asked once more."""
        waited = time.monotonic()
        while True:
            base = self.now()
            last = max(self._numbers(), default=0)
            if last > base.number and time.monotonic() - waited < PATIENCE:
                time.sleep(0.1)  # a log file that is being written
                continue
            layers = make(base)
            number = max(last, base.number) + 1
            if self.folder.create(f"log/{number:020d}.json", json.dumps({"layers": layers, "at": time.time()})):
                if number % SWEEP == 0 or not self.retention:
                    self.sweep()
                return View(self.spark, self.root, number, tuple(layers))
            waited = time.monotonic()

    def sweep(self) -> None:
        """Delete folders that nobody can be reading or writing, and the log files that name them."""
        now, numbers = time.time(), self._numbers()
        entries = {n: self._entry(n) for n in numbers}
        replaced = {n for n, later in zip(numbers, numbers[1:], strict=False) if entries[later] and entries[later]["at"] <= now - self.retention}
        held = {x for n in numbers if n not in replaced for x in (entries[n] or {"layers": []})["layers"]}
        known = {x for n in numbers for x in (entries[n] or {"layers": []})["layers"]}
        for name in self.folder.names():
            if name.startswith("v") and name not in held and (name in known or int(name[1:21]) / 1e9 <= now - ABANDONED):
                self.folder.delete(name)
        for n in replaced:
            self.folder.delete(f"log/{n:020d}.json")

    def write(self, tables: Tables, base: View | None = None) -> View:
        """Write all rows, as they were when ``base`` was current (by default: now).  Layers that came
        since stay above them; if another whole was written since, that is a ``Conflict``."""
        base = base or self.now()
        version = self._tables(tables)

        def make(now: View) -> list[str]:
            if now.names[:1] != base.names[:1]:
                raise Conflict(f"another writer wrote {self.root} as a whole")
            return [version, *now.names[len(base.names) :]]

        return self.commit(make)

    def append(self, tables: Tables, gone: DataFrame, turned: DataFrame | None = None, base: View | None = None, based: Callable[[View], Tables] | None = None, whole: Callable[[View], Tables] | None = None) -> View:
        """Add a layer: the new rows of files in ``gone`` (a column ``path``), whose old rows go, and
        new value references of names in ``turned``.

        ``based`` makes tables from the version that the layer comes to lie on, again for each
        version that is tried; with ``base`` the layer is right above that version only.  When there
        are ``LAYERS`` layers they are written anew as one, by ``whole`` if given."""
        none = self.spark.createDataFrame([], SCHEMAS["gone_values"])
        version = self._tables(tables | {"gone_files": gone.select("path").distinct(), "gone_values": none if turned is None else turned})

        def make(now: View) -> list[str]:
            if base is not None and now.number != base.number:
                raise Conflict(f"another writer changed {self.root}")
            if based is not None:
                self._tables(based(now), version)
            return [*now.names, version]

        view = self.commit(make)
        return self.compact(view, whole or (lambda v: {t: v.read(t) for t in tables})) if len(view.names) >= LAYERS else view

    def compact(self, view: View, whole: Callable[[View], Tables]) -> View:
        """The layers of a version written anew as one, below layers that came since; nothing if the
        version's layers were replaced meanwhile."""
        version = self._tables(whole(view))

        def make(now: View) -> list[str]:
            if now.names[: len(view.names)] != view.names:
                raise Conflict("replaced")
            return [version, *now.names[len(view.names) :]]

        try:
            return self.commit(make)
        except Conflict:
            self.folder.delete(version)
            return self.now()


def _meta(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("file_count"), F.current_timestamp().alias("indexed_at"))


def _symbol_tables(index: Index | Delta, meta: DataFrame) -> Tables:
    return {"symbols": index.symbols, "name_grams": name_grams(index.symbols), "refs": index.refs, "refs_by_caller": index.refs.where("in_symbol != ''"), "idents": index.idents, "files": index.files, "errors": index.errors, "meta": meta}


def write_index(store: Store, index: Index, base: View | None = None) -> View:
    """Write symbol tables whole; the number of files and the time are those of this snapshot."""
    return store.write(_symbol_tables(index, _meta(index.files)), base)


def write_delta(store: Store, changed: DataFrame, change: Delta, base: View | None = None) -> View:
    """Add the rows of a change to the snapshot ``base`` that it was made from (by default: the
    current one); a ``Conflict`` if that is no longer the current one."""
    base = base or store.now()
    files = with_files(base.read("files"), changed, change.files)
    return store.append(_symbol_tables(change, _meta(files)), changed, change.turned, base)


def read_lines(store: Store | View) -> Layered:
    """The line index of one version."""
    view = store.now() if isinstance(store, Store) else store
    layers = view.layers()
    if not layers:
        raise NoIndex(f"no index in {view.root}")
    return Layered([view.layer(x, "blocks") for x in layers], view.gone("gone_files", "path") if len(layers) > 1 else None, view.read("lines"), view.read("corpus"), view.read("term_counts"))


def read_index(store: Store | View) -> Index:
    """The symbol tables of one version."""
    view = store.now() if isinstance(store, Store) else store
    return Index(view.read("symbols"), view.read("refs"), view.read("idents"), view.read("files"), view.read("errors"))
