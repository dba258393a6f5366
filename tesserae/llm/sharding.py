"""Sharding by rendezvous hashing.

Every (key, shard) pair draws a pseudo-random number ``u`` in (0, 1) from the MD5 of its text;
a shard of weight ``w`` bids ``-ln(u) / w`` and the smallest bid takes the row.  Bids are
independent exponentials, so a shard wins with probability ``w / sum(w)``, and a new shard
changes only the rows on which it bids lowest: no row moves between old shards.

Everything is a map over key columns, but for the slot numbers.  Rows are dealt to
``16 ** slot_digits`` hash buckets within a shard, and inside their bucket to runs of one key and
size; rows are numbered inside their run, and shifted by the runs and buckets before it.  So no
task sorts a whole shard, nor all rows of a key that many rows have: a bucket is sorted by its runs
alone, and a run is the rows of one key whose texts are equally long.  Equal rows are one row with
a count until they get their slots.

Defined results: a null key counts as the key ``""``; a null text has size ``overhead`` and the
CRC of no bytes (0); rows with the same key go to the same shard and get slots of their own;
an empty table gives an empty result; other columns of the input are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the MD5 that make a draw: 13 digits are 52 bits, exact in a double.
DRAW_DIGITS = 13


def bids(key: Column, weights: Sequence[float]) -> Column:
    """Array of struct(bid, shard): one bid for each shard, lowest wins."""
    scale = float(16**DRAW_DIGITS)
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])

    def bid(s: Column) -> Column:
        digest = F.md5(F.concat(key, F.lit("|"), s["i"].cast("string")).cast("binary"))
        u = (F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double") + 0.5) / scale
        return F.struct((-F.ln(u) / s["w"]).alias("bid"), s["i"].alias("shard"))

    return F.transform(shards, bid)


def rendezvous(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard", grown_by: float | None = None) -> DataFrame:
    """``df`` with the shard of each row; with ``grown_by`` also ``grown_shard``, the shard it
    has when one more shard of that weight exists."""
    if not weights or min(weights) <= 0 or (grown_by is not None and grown_by <= 0):
        raise ValueError("every shard needs a positive weight")
    text_key = F.coalesce(F.col(key).cast("string"), F.lit(""))
    every = [*weights, *([grown_by] if grown_by is not None else [])]
    df = df.withColumn("__bids", bids(text_key, every))
    df = df.withColumn(out, F.array_min(F.slice("__bids", 1, len(weights)))["shard"])
    if grown_by is not None:
        df = df.withColumn("grown_shard", F.array_min("__bids")["shard"])
    return df.drop("__bids")


def slot_bucket(key: str, slot_digits: int) -> Column:
    return F.substring(F.md5(F.concat(F.lit("slot|"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")), 1, slot_digits)


def with_slots(counted: DataFrame, keys_only: DataFrame, key: str, length: str, ties: Sequence[str], slot_digits: int = 2) -> DataFrame:
    """Rows of ``counted`` (with ``shard``; ``__n`` says how many equal rows each stands for), each as
    often as it counts, and a gapless ``slot`` from 0 in each shard, ordered by (bucket, key, length,
    ties).  ``keys_only`` holds all rows with only key and shard: bucket sizes are counted from it, so
    that counting never reads texts."""
    sizes = keys_only.withColumn("__bucket", slot_bucket(key, slot_digits)).groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sizes.select("shard", "__bucket", F.coalesce(F.sum("__n").over(whole), F.lit(0)).alias("__start"))
    dealt = counted.withColumn("__bucket", slot_bucket(key, slot_digits))
    runs = dealt.groupBy("shard", "__bucket", F.col(key).alias("__key"), F.col(length).alias("__length")).agg(F.sum("__n").alias("__of_run"))
    earlier = Window.partitionBy("shard", "__bucket").orderBy(F.col("__key").asc_nulls_first(), "__length").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__of_run").over(earlier), F.lit(0))).join(buckets, ["shard", "__bucket"])
    runs = runs.select(F.col("shard").alias("__s"), F.col("__bucket").alias("__b"), "__key", "__length", (F.col("__start") + F.col("__before")).alias("__from"))
    inside = Window.partitionBy("shard", "__bucket", key, length).orderBy(*ties).rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("__at", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    same = (F.col("shard") == F.col("__s")) & (F.col("__bucket") == F.col("__b")) & F.col(key).eqNullSafe(F.col("__key")) & (F.col(length) == F.col("__length"))
    first = (F.col("__from") + F.col("__at")).cast("long")
    placed = numbered.join(runs, same).withColumn("__first", first).withColumn("slot", F.explode(F.sequence("__first", F.col("__first") + F.col("__n") - 1)))
    return placed.drop("__bucket", "__at", "__first", "__n", "__s", "__b", "__key", "__length", "__from")


def shard_documents(docs: DataFrame, n_shards: int = 40, weights: Sequence[float] | None = None, key: str = "doc_id", text: str = "text", overhead: int = 16, slot_digits: int = 2) -> DataFrame:
    """Shard, slot and next-size shard of every row of ``docs`` by the law ``key``.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    weights = list(weights) if weights is not None else [1.0] * n_shards
    if len(weights) != n_shards:
        raise ValueError("one weight for each shard")
    more = sum(weights) / n_shards
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    keys = docs.select(F.col(key).alias("doc_id"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("__n"))
    placed = rendezvous(counted.withColumn("law", F.lit("key")), "doc_id", weights, grown_by=more)
    slots = with_slots(placed, rendezvous(keys, "doc_id", weights), "doc_id", "size", ["text_crc32"], slot_digits)
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
