"""Mixing sources to target weights by temperature.

A source with the share ``p`` of all tokens gets the weight ``p ** a``, normalised.  The exponent
``a`` in [0, 1] is found by bisection: the smallest at which no source is read more than
``max_epochs`` times as often as the one read least, or the one at which the weights have a given
entropy.  The budget is the least at which every source is read once in full, so no row is lost
and small sources repeat; with ``budget_tokens`` it is that many tokens instead, and large
sources may be read in part.

Weights become budgets of whole tokens, and budgets become block permutations: rows are hashed
to ``16 ** block_digits`` blocks, each epoch of a source orders the blocks by a hash of
(seed, source, epoch, block) and the rows in a block by a hash of their own, and the last epoch
ends before the first row that its budget cannot hold.  That row is found from block sums and
one window inside each block, so no task ever holds a source, and the draw of a row depends only
on the row and on its source's end mark.

Only DataFrame functions are used.  The tables of sources and of blocks are small: a row per
source, and 16 ** block_digits rows per source at most.  All sources' totals meet in one array
for the bisection.

Defined results: a null source is a source of its own; a null or empty text has no tokens and is
drawn with its source's whole epochs (and with the last while the mark is not reached); sources
without tokens are read once; rows that are equal in doc_id and tokens share their draws; an
empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import scratch, text_or_empty, written

#: Words of a text: what stands between spaces and ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
STEPS = 50


def source_key(source: str = "source") -> Column:
    """The source as a join key, null apart from every string."""
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def hashed(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def weights_at(shares: Column, a: Column) -> Column:
    """Normalised weights of an array of shares at one exponent."""
    raised = F.transform(shares, lambda p: F.pow(p, a))
    total = F.aggregate(raised, F.lit(0.0), lambda x, y: x + y)
    return F.transform(raised, lambda x: x / total)


def entropy(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda x, w: x - w * F.ln(w))


def spread(shares: Column, a: Column) -> Column:
    """How many times as often as another the source read most is read."""
    reads = F.transform(shares, lambda p: F.pow(p, a - 1.0))
    return F.array_max(reads) / F.array_min(reads)


def bisected(shares: Column, max_epochs: float | None, target_entropy: float | None) -> Column:
    """The smallest exponent within the repetition limit, or the one of the target entropy."""

    def low_enough(a: Column) -> Column:
        if max_epochs is not None:
            return spread(shares, a) <= max_epochs
        return entropy(weights_at(shares, a)) <= F.lit(float(target_entropy))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        good = low_enough(mid)
        return F.struct(F.when(good, acc["lo"]).otherwise(mid).alias("lo"), F.when(good, mid).otherwise(acc["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step, lambda acc: acc["hi"])
    return F.round(F.when(low_enough(F.lit(0.0)), F.lit(0.0)).otherwise(found), 9)


def source_plan(totals: DataFrame, max_epochs: float | None, target_entropy: float | None, budget_tokens: int | None) -> DataFrame:
    """From (key, tokens): key, tokens, exponent, weight, budget, whole epochs and the rest."""
    some = totals.where("tokens > 0")
    everything = some.agg(F.array_sort(F.collect_list("tokens")).alias("each"), F.sum("tokens").alias("all"))
    shares = everything.where("all > 0").select("all", F.transform("each", lambda t: t / F.col("all")).alias("shares"))
    chosen = shares.select("all", "shares", bisected(F.col("shares"), max_epochs, target_entropy).alias("exponent"))
    scale = chosen.select("all", "exponent", F.aggregate(F.transform("shares", lambda p: F.pow(p, F.col("exponent"))), F.lit(0.0), lambda x, y: x + y).alias("norm"), F.array_max(F.transform("shares", lambda p: F.pow(p, 1.0 - F.col("exponent")))).alias("top"))
    # One row of four numbers, whatever the input.
    found = scale.collect()
    total, exponent, norm, top = (float(x) for x in found[0]) if found else (1.0, 0.0, 1.0, 1.0)
    weighted = some.withColumn("weight", F.pow(F.col("tokens") / F.lit(total), F.lit(exponent)) / F.lit(norm))
    whole = F.lit(float(budget_tokens)) if budget_tokens is not None else F.lit(total) * F.lit(top) * F.lit(norm)
    budget = weighted.withColumn("budget", F.round(whole * F.col("weight")).cast("long"))
    planned = budget.select("key", "tokens", F.lit(exponent).alias("exponent"), F.round("weight", 9).alias("weight"), "budget", F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("epochs"), (F.col("budget") % F.col("tokens")).alias("rest"))
    none = totals.where("tokens = 0").select("key", "tokens", F.lit(None).cast("double").alias("exponent"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"), F.lit(1).alias("epochs"), F.lit(0).cast("long").alias("rest"))
    return planned.unionByName(none)


def block_of(doc_id: Column, block_digits: int) -> Column:
    return F.substring(hashed(F.lit("row"), F.coalesce(doc_id.cast("string"), F.lit(""))), 1, block_digits)


def end_marks(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """For each source, the order key of the first row that the last epoch cannot hold."""
    part = plan.where("rest > 0").select("key", "epochs", "rest")
    sums = rows.groupBy("key", "block").agg(F.sum("n_tokens").alias("sum")).join(part, "key")
    ordered = sums.withColumn("at", hashed(F.lit(seed).cast("string"), F.col("key"), F.col("epochs").cast("string"), F.col("block")))
    before = Window.partitionBy("key").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, -1)
    run = ordered.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    edge = run.where("before <= rest and before + sum > rest").select("key", "block", "at", (F.col("rest") - F.col("before")).alias("room"))
    inside = Window.partitionBy("key", "block").orderBy("in_block", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.join(edge, ["key", "block"]).withColumn("used", F.sum("n_tokens").over(inside)).where("used > room")
    return last.groupBy("key").agg(F.min(F.struct("at", "in_block", "doc_id", "n_tokens")).alias("mark"))


def mix(docs: DataFrame, max_epochs: float | None = 2.0, target_entropy: float | None = None, budget_tokens: int | None = None, seed: int = 7, block_digits: int = 3, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with one row per draw and the columns ``mix_tokens``, ``mix_weight``,
    ``mix_epoch`` (from 0) and ``mix_order`` (the place in the epoch's permutation, as text)."""
    if (max_epochs is None) == (target_entropy is None):
        raise ValueError("give a repetition limit or a target entropy")
    mixed = docs.withColumn("__key", source_key(source)).withColumn("__block", block_of(F.col(key), block_digits)).withColumn("__in", hashed(F.lit("in"), F.lit(seed).cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")))).withColumn("mix_tokens", F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long"))
    with scratch(docs.sparkSession):
        rows = written(mixed.select(F.col("__key").alias("key"), F.col("__block").alias("block"), F.col("__in").alias("in_block"), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col("mix_tokens").alias("n_tokens")), "mix-rows")
        totals = rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens"))
        plan = written(source_plan(totals, max_epochs, target_entropy, budget_tokens), "mix-plan")
        marks = plan.join(end_marks(rows, plan, seed), "key", "left")
        # Written, so that its size is known before the join with the texts is planned.
        ends = written(marks.select(F.col("key").alias("__key"), F.col("weight").alias("mix_weight"), F.col("epochs").alias("__epochs"), F.col("rest").alias("__rest"), F.col("mark").alias("__mark")), "mix-ends", keep=True)
    drawn = mixed.drop("mix_weight").join(ends, "__key")
    own = F.struct(hashed(F.lit(seed).cast("string"), F.col("__key"), F.col("__epochs").cast("string"), F.col("__block")).alias("at"), F.col("__in").alias("in_block"), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col("mix_tokens").alias("n_tokens"))
    more = F.when((F.col("__rest") > 0) & (own < F.col("__mark")), 1).otherwise(0)
    epochs = F.when(F.col("__epochs") + more > 0, F.sequence(F.lit(0), F.col("__epochs") + more - 1)).otherwise(F.array().cast("array<int>"))
    out = drawn.withColumn("mix_epoch", F.explode(epochs))
    place = F.concat(F.substring(hashed(F.lit(seed).cast("string"), F.col("__key"), F.col("mix_epoch").cast("string"), F.col("__block")), 1, 16), F.substring("__in", 1, 16))
    return out.withColumn("mix_order", place).drop("__key", "__block", "__in", "__epochs", "__rest", "__mark")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """The draws without texts: doc_id, source, n_tokens, weight, epoch, mix_order."""
    return mix(docs, **options).select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"), F.col("mix_epoch").alias("epoch"), "mix_order")
