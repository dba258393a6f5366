"""Posting blocks: a term's occurrences in a block of lines as one row, and what its best line can score.

Lines are dealt to blocks of about ``BLOCK_LINES`` by a hash of file and stretch of the file, so all
terms of a line are in blocks of one number, neighbours stay together and a long file is many blocks.
A row has the occurrences, and the (tf, len) pairs of its lines that no other line betters in both;
so the largest score that a term can have in a block is known for any collection statistics without
looking at the occurrences.

What is shuffled is the text of the lines, once.  The task that cuts the lines of some blocks into
terms also writes the rows of these blocks, by term: a file is a segment of its own, of which a search
reads the pages of its terms.

A search for single terms reads these pairs first.  The blocks with the highest bounds are scored;
the k-th best score found is a threshold, and of the other blocks only those whose bound reaches it
are unpacked.  Searches with phrases, prefixes or NEAR unpack all blocks of their terms.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import tokens
from tesserae.plans.match import And, Near, Node, Not, Or, leaves

#: Lines of a block on average, and neighbouring lines of a file that stay in one.
BLOCK_LINES, STRETCH = 128, 32
#: Tokens whose postings one task groups or sorts, about.
PART_TOKENS = 250_000


def parts_of(n_tokens: int) -> int:
    """Partitions in which the postings of ``n_tokens`` tokens are grouped and sorted: a task holds
    about ``PART_TOKENS`` of them, however many there are."""
    return max(1, -(-n_tokens // PART_TOKENS))


def opening(toks: str) -> Column:
    """(term, i) of each distinct term of a line, ``i`` where it first stands in ``toks``, a column of
    (term, at) in order."""
    opens = F.filter(F.transform(toks, lambda t, i: F.struct(F.coalesce(F.get(toks, i - 1)["term"] != t["term"], F.lit(True)).alias("new"), i.alias("i"), t["term"].alias("term"))), lambda x: x["new"])
    return F.transform(opens, lambda x: F.struct(x["term"].alias("term"), x["i"].alias("i")))


def block_postings(lines: DataFrame, n_lines: int, n_tokens: int | None = None) -> DataFrame:
    """term, block, best, hits from (file, line, content) or (file, line, toks) of ``n_lines`` lines of
    ``n_tokens`` tokens.  Lines are dealt out by block once, as text where they are given so, to tasks
    of a bounded number of tokens where that number is given; the grouping keeps that partitioning.
    A line's places are grouped inside its array."""
    blocks = max(1, -(-n_lines // BLOCK_LINES))
    block = F.pmod(F.xxhash64("file", F.floor(F.col("line") / STRETCH)), F.lit(blocks)).alias("block")
    rows = lines.select(block, "file", "line", "toks" if "toks" in lines.columns else "content")
    dealt = rows.repartition("block") if n_tokens is None else rows.repartition(parts_of(n_tokens), "block")
    toks = F.col("toks") if "toks" in lines.columns else tokens(F.col("content"))
    ordered = dealt.select("block", "file", "line", F.sort_array(F.transform(toks, lambda t, i: F.struct(t.alias("term"), i.alias("at")))).alias("toks"))
    opened = ordered.select("block", "file", "line", F.col("toks.at").alias("places"), opening("toks").alias("opens"))
    each = opened.select("block", "file", "line", F.size("places").alias("len"), F.inline(F.transform("opens", lambda x, k: F.struct(x["term"].alias("term"), F.slice("places", x["i"] + 1, F.coalesce(F.get("opens", k + 1)["i"], F.size("places")) - x["i"]).alias("at")))))
    hits = each.groupBy("block", "term").agg(F.sort_array(F.collect_list(F.struct("file", "line", "len", "at"))).alias("hits"))
    # By length, then highest tf first: a pair counts if its tf is above that of all shorter lines.
    pairs = hits.select("block", "term", "hits", F.sort_array(F.transform("hits", lambda h: F.struct(h["len"].alias("len"), (-F.size(h["at"])).alias("less")))).alias("pairs"))
    none = F.array().cast("array<struct<tf:int,len:int>>")
    best = F.aggregate("pairs", none, lambda kept, p: F.when((F.size(kept) > 0) & (F.element_at(kept, -1)["tf"] >= -p["less"]), kept).otherwise(F.concat(kept, F.array(F.struct((-p["less"]).alias("tf"), p["len"].alias("len"))))))
    return pairs.select("term", "block", best.alias("best"), "hits")


def postings_of(blocks: DataFrame) -> DataFrame:
    """term, file, line, pos, n_tokens: the occurrences, unpacked."""
    return blocks.select("term", F.inline("hits")).select("term", "file", "line", F.col("len").alias("n_tokens"), F.explode("at").alias("pos"))


def still_there(rows: DataFrame, gone: DataFrame | None, column: str = "file") -> DataFrame:
    """Rows of files that no later layer replaced: ``rows`` have the number of their ``layer``, ``gone``
    the ``last`` layer that replaced a ``path``."""
    if gone is None:
        return rows.drop("layer")
    last = gone.withColumnRenamed("path", column)
    return rows.join(last, column, "left").where(F.col("last").isNull() | (F.col("layer") >= F.col("last"))).drop("last")


@dataclass(frozen=True)
class Layered:
    """The blocks of each layer of an index, the files that later layers replaced (path, and the number
    of the ``last`` layer that did), the lines, and numbers of lines, tokens and documents per term of
    all layers."""

    layers: list[DataFrame]
    gone: DataFrame | None
    lines: DataFrame
    corpus: DataFrame
    term_counts: DataFrame

    def postings(self) -> DataFrame:
        """term, file, line, pos, n_tokens of what is there now."""
        return self._unpacked(dict(enumerate(self.layers)))

    def _unpacked(self, blocks: dict[int, DataFrame]) -> DataFrame:
        parts = [postings_of(b).withColumn("layer", F.lit(i)) for i, b in blocks.items()]
        return still_there(reduce(DataFrame.unionByName, parts), self.gone).select("term", "file", "line", "n_tokens", "pos")

    def chosen(self, terms: list[str], pick: dict[int, list[int]]) -> DataFrame:
        """The postings of some terms in some blocks of each layer."""
        return self._unpacked({i: self.layers[i].where(F.col("term").isin(terms) & F.col("block").isin(ids)) for i, ids in pick.items()})

    def joined(self, terms: list[str], picked: DataFrame) -> DataFrame:
        """The same for many blocks (layer, block)."""
        return self._unpacked({i: b.where(F.col("term").isin(terms)).join(picked.where(F.col("layer") == i).select("block"), "block", "left_semi") for i, b in enumerate(self.layers)})


def single_terms(node: Node) -> list[str] | None:
    """The term of each leaf, if all leaves are single whole terms, anywhere in a line."""
    found = []
    for leaf in leaves(node):
        p = leaf.phrases[0]
        if len(leaf.phrases) > 1 or leaf.dead or len(p.terms) != 1 or p.prefix or p.initial:
            return None
        found.append(p.terms[0])
    return found


def block_bounds(index: Layered, node: Node, terms: list[str], gain: dict[str, Column]) -> DataFrame:
    """layer, block, bound: the most that a line of the block can score, for blocks that can hold a
    match.  ``gain`` is what a (tf, len) pair ``x`` of each term adds."""
    meta = [blocks.where(F.col("term").isin(terms)).select(F.lit(i).alias("layer"), "block", "term", F.explode("best").alias("x")) for i, blocks in enumerate(index.layers)]
    rows = reduce(DataFrame.unionByName, meta)
    tops = [F.max(F.when(F.col("term") == t, gain[t])).alias(f"b{i}") for i, t in enumerate(terms)]
    per_block = rows.groupBy("layer", "block").agg(*tops)
    number = {t: i for i, t in enumerate(terms)}

    def can(x: Node) -> Column:
        if isinstance(x, Near):
            return F.col(f"b{number[x.phrases[0].terms[0]]}").isNotNull()
        if isinstance(x, Not):
            return can(x.left)
        return reduce((lambda a, b: a & b) if isinstance(x, And) else (lambda a, b: a | b), [can(p) for p in x.parts])

    def most(x: Node) -> Column:
        if isinstance(x, Near):
            return F.coalesce(F.col(f"b{number[x.phrases[0].terms[0]]}"), F.lit(0.0))
        if isinstance(x, Not):
            return most(x.left)
        total = reduce(lambda a, b: a + b, [most(p) for p in x.parts])
        return F.when(can(x), total).otherwise(F.lit(0.0)) if isinstance(x, (And, Or)) else total

    return per_block.where(can(node)).select("layer", "block", most(node).alias("bound"))
