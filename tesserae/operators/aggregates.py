"""Aggregations over the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symbols_by_name(symbols: DataFrame) -> DataFrame:
    """name, symbols: the declarations of each name in file order."""
    entry = F.struct("file", "ordinal", "kind", "pkg", "recv", "line", "end_line", "sig")
    return symbols.groupBy("name").agg(F.array_sort(F.collect_list(entry)).alias("symbols"))


def kind_names(symbols: DataFrame) -> DataFrame:
    return symbols.select("kind", "name").distinct()


def kind_counts(symbols: DataFrame) -> DataFrame:
    """kind, n_symbols, n_names."""
    return symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n_symbols"), F.countDistinct("name").alias("n_names"))


def refs_by_target(refs: DataFrame) -> DataFrame:
    """sym, n_refs, n_calls, n_files."""
    return refs.groupBy("sym").agg(F.count(F.lit(1)).alias("n_refs"), F.count_if(F.col("kind") == "call").alias("n_calls"), F.countDistinct("file").alias("n_files"))


def refs_by_caller(refs: DataFrame) -> DataFrame:
    """in_symbol, n_refs, n_targets; references outside a function count for none."""
    return refs.where("in_symbol != ''").groupBy("in_symbol").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("sym").alias("n_targets"))


def contributions(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """file, n_names, n_targets, n_callers: distinct names each file gives to the index."""
    a = symbols.groupBy("file").agg(F.countDistinct("name").alias("n_names"))
    b = refs.groupBy("file").agg(F.countDistinct("sym").alias("n_targets"), F.countDistinct(F.when(F.col("in_symbol") != "", F.col("in_symbol"))).alias("n_callers"))
    joined = a.join(b, "file", "full_outer")
    return joined.select("file", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_names", "n_targets", "n_callers")])


def index_counts(symbols: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """n_symbols, n_refs, n_files in one row."""
    tagged = symbols.select(F.lit("s").alias("t")).unionByName(refs.select(F.lit("r").alias("t"))).unionByName(files.select(F.lit("f").alias("t")))
    return tagged.agg(F.count_if(F.col("t") == "s").alias("n_symbols"), F.count_if(F.col("t") == "r").alias("n_refs"), F.count_if(F.col("t") == "f").alias("n_files"))


def search_stats(fts_meta: DataFrame) -> DataFrame:
    """files, lines: 0 for an empty index."""
    return fts_meta.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("lines"))


def last_indexed(fts_meta: DataFrame) -> DataFrame:
    """last_indexed: the time of the newest file, null for none or 0."""
    newest = fts_meta.agg(F.max("mtime").alias("m"))
    return newest.select(F.when(F.col("m") > 0, F.timestamp_seconds("m")).alias("last_indexed"))
