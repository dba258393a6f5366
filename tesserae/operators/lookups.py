"""The fixed lookups on symbols and references: filters that reach the Parquet scan.

Listings are ordered by name (bytes), then file, then place in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.extract import known_values

__all__ = ["calls_from", "file_symbol_names", "files_referencing", "find_symbol", "find_usages", "known_values", "list_symbols", "name_grams", "names_containing", "of_kind", "search_symbols", "search_symbols_by_grams"]


def of_kind(symbols: DataFrame, kind: str | None) -> DataFrame:
    """All symbols for an empty kind or ``all``; an unknown kind has none."""
    return symbols if not kind or kind == "all" else symbols.where(F.col("kind") == kind)


def in_listing_order(symbols: DataFrame) -> DataFrame:
    return symbols.orderBy("name", "file", "ordinal")


def find_symbol(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name).orderBy("file", "ordinal")


def find_usages(refs: DataFrame, name: str) -> DataFrame:
    """Calls and value references of a bare name."""
    return refs.where(F.col("sym") == name).orderBy("file", "ordinal")


def calls_from(refs: DataFrame, symbol: str) -> DataFrame:
    """What the body of ``Func`` or ``Recv.Method`` refers to, value references too."""
    return refs.where((F.col("in_symbol") == symbol) & (F.col("in_symbol") != "")).orderBy("file", "ordinal")


def list_symbols(symbols: DataFrame, kind: str | None = None) -> DataFrame:
    return in_listing_order(of_kind(symbols, kind))


def search_symbols(symbols: DataFrame, pattern: str, kind: str | None = None) -> DataFrame:
    """Names that contain the pattern, whatever the case; the pattern has no wildcards."""
    return in_listing_order(of_kind(symbols, kind).where(F.lower("name").contains(pattern.lower())))


#: The longest substrings of names that are stored, those of a pattern that are looked up, and the
#: names up to which a lookup lists them in its filter.
GRAM, LOOKED_UP, LISTED = 3, 10, 1000


def name_grams(symbols: DataFrame) -> DataFrame:
    """gram, name: each name by its distinct lower-case substrings of one to ``GRAM`` characters."""
    low = F.lower("name")

    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length(low) - (n - 1))
        return F.when(F.length(low) >= n, F.transform(places, lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    names = symbols.select("name").distinct()
    return names.select(F.explode(F.array_distinct(F.concat(*[of(n) for n in range(1, GRAM + 1)]))).alias("gram"), "name")


def names_containing(grams: DataFrame, pattern: str) -> DataFrame:
    """name: of the names in ``grams`` (gram, name) those that contain a pattern, whatever the case.

    A pattern of up to ``GRAM`` characters is a gram itself.  A longer one is looked up by some of its
    grams, a filter that reaches the files; names that have all of these are checked."""
    p = pattern.lower()
    wanted = sorted({p[i : i + GRAM] for i in range(max(1, len(p) - GRAM + 1))}, key=lambda g: (p.count(g), g))[:LOOKED_UP]
    found = grams.where(F.col("gram").isin(wanted))
    if len(p) <= GRAM:
        return found.select("name").distinct()
    held = found.groupBy("name").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(wanted))
    return held.where(F.lower("name").contains(p)).select("name")


def search_symbols_by_grams(symbols: DataFrame, grams: DataFrame, pattern: str, kind: str | None = None) -> DataFrame:
    """The same rows as ``search_symbols``, from the grams of the names: only names that can match are
    looked at.  ``grams`` may have names that no symbol has any more."""
    if not pattern:
        return search_symbols(symbols, pattern, kind)
    names = names_containing(grams, pattern)
    few = [r["name"] for r in names.limit(LISTED + 1).collect()]
    some = of_kind(symbols, kind)
    return in_listing_order(some.where(F.col("name").isin(few)) if len(few) <= LISTED else some.join(names, "name", "left_semi").select(*some.columns))


def file_symbol_names(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("file") == path).select("name").distinct()


def files_referencing(refs: DataFrame, names: DataFrame) -> DataFrame:
    """file: those that refer to any of the names (a column ``name``)."""
    return refs.join(names.select(F.col("name").alias("sym")), "sym", "left_semi").select("file").distinct()
