"""Keeping an index fresh: what changed, what depends on it, and the tables after it.

Tables are never changed in place: each operation returns the new table, built from an anti-join
and a union, for the snapshot to write.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.extract import errors_of, files_of, idents_of, known_values, references, scan_files, symbols_of
from tesserae.operators.lookups import files_referencing
from tesserae.workspace import written


def sync_plan(disk: DataFrame, stored: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """path, action: ``index``, ``unchanged`` or ``remove``, from (path, mtime) on disk and stored.

    A file is unchanged when its time is equal, not when it is older.  With ``roots`` only stored
    paths under one of them can be removed; others are not listed."""
    both = disk.select("path", F.col("mtime").alias("now")).join(stored.select("path", F.col("mtime").alias("was")), "path", "full_outer")
    action = F.when(F.col("now").isNull(), "remove").when(F.col("was") == F.col("now"), "unchanged").otherwise("index")
    plan = both.select("path", action.alias("action"))
    if roots:
        under = F.lit(False)
        for r in roots:
            under = under | (F.lit(True) if r in (".", "") else (F.col("path").startswith(r.rstrip("/") + "/") | (F.col("path") == r)))
        plan = plan.where((F.col("action") != "remove") | under)
    return plan


def sync_counts(plan: DataFrame) -> DataFrame:
    """indexed, unchanged, removed in one row."""
    return plan.agg(F.count_if(F.col("action") == "index").alias("indexed"), F.count_if(F.col("action") == "unchanged").alias("unchanged"), F.count_if(F.col("action") == "remove").alias("removed"))


def without_files(df: DataFrame, paths: DataFrame, column: str = "file") -> DataFrame:
    """Rows of other files than those in ``paths`` (a column ``path``); unknown paths change nothing."""
    return df.join(paths.select(F.col("path").alias(column)), column, "left_anti")


def with_files(df: DataFrame, paths: DataFrame, new: DataFrame, column: str = "file") -> DataFrame:
    """The rows of ``paths`` replaced by ``new``; a path that was not there is added."""
    return without_files(df, paths, column).select(df.columns).unionByName(new.select(df.columns))


@dataclass
class Index:
    """The symbol tables of one snapshot; ``errors`` are the files set apart, which are in no other."""

    symbols: DataFrame
    refs: DataFrame
    idents: DataFrame
    files: DataFrame
    errors: DataFrame


def build(files: DataFrame) -> Index:
    """A full index of (path, mtime, content)."""
    scanned = scan_files(files)
    symbols = symbols_of(scanned)
    return Index(symbols, references(scanned, known_values(symbols)), idents_of(scanned), files_of(scanned), errors_of(scanned))


def dependents(index: Index, changed: DataFrame) -> DataFrame:
    """path: other files that refer to a symbol of the changed files (a column ``path``)."""
    own = index.symbols.join(changed.select(F.col("path").alias("file")), "file", "left_semi").select("name").distinct()
    return files_referencing(index.refs, own).select(F.col("file").alias("path")).join(changed.select("path"), "path", "left_anti")


@dataclass
class Delta:
    """What a change adds: the rows of the changed files, and the value references that other files
    now have to names in ``turned``, whose kind as a value came, went or changed."""

    symbols: DataFrame
    refs: DataFrame
    idents: DataFrame
    files: DataFrame
    turned: DataFrame
    errors: DataFrame


def without_values(refs: DataFrame, names: DataFrame) -> DataFrame:
    """References but those to values of some names (a column ``name``)."""
    gone = names.select(F.col("name").alias("gone"))
    return refs.join(gone, (F.col("sym") == F.col("gone")) & (F.col("kind") != "call"), "left_anti")


def delta(index: Index, changed: DataFrame, contents: DataFrame) -> Delta:
    """The rows that a change adds, by reading what its files and names touch.

    ``changed`` has the paths that changed, were added or removed; ``contents`` the (path, mtime,
    content) of those that exist now.  Only names that the changed files declare as values, before
    or after, can turn, so only their references in other files are drawn anew."""
    scanned = written(scan_files(contents), "scanned-changes")
    own, mine = symbols_of(scanned), idents_of(scanned)
    is_value = F.col("kind").isin("var", "const")
    old = index.symbols.join(changed.select(F.col("path").alias("file")), "file", "left_semi")
    touched = old.where(is_value).select("name").unionByName(own.where(is_value).select("name")).distinct()
    now = with_files(index.symbols, changed, own)
    before = known_values(index.symbols.join(touched, "name", "left_semi"))
    after = known_values(now.join(touched, "name", "left_semi"))
    both = before.withColumnRenamed("kind", "was").join(after, "name", "full_outer")
    turned = written(both.where(~F.col("was").eqNullSafe(F.col("kind"))).select("name"), "turned-names")
    here = known_values(now.join(mine.select("name").distinct(), "name", "left_semi"))
    elsewhere = without_files(index.idents.join(turned, "name", "left_semi"), changed).join(after.select("name", F.concat("kind", F.lit("_ref")).alias("kind")), "name")
    refs = references(scanned, here).unionByName(elsewhere.select(F.col("name").alias("sym"), "kind", "file", "line", "in_symbol", "ordinal"))
    return Delta(own, refs, mine, files_of(scanned), turned, errors_of(scanned))


def apply_changes(index: Index, changed: DataFrame, contents: DataFrame) -> Index:
    """The index after a change: equal to a full build of all files."""
    d = delta(index, changed, contents)
    return Index(
        with_files(index.symbols, changed, d.symbols),
        without_values(without_files(index.refs, changed), d.turned).select(index.refs.columns).unionByName(d.refs.select(index.refs.columns)),
        with_files(index.idents, changed, d.idents),
        with_files(index.files, changed, d.files),
        with_files(index.errors, changed, d.errors),
    )


def last_events(events: DataFrame) -> DataFrame:
    """path, op: the last event of each path (the one with the highest ``seq``)."""
    return events.groupBy("path").agg(F.max_by("op", "seq").alias("op"))


def removals(ops: DataFrame) -> DataFrame:
    """path of those whose last event took the file away (removed or renamed)."""
    return ops.where(F.col("op").isin("remove", "rename")).select("path")
