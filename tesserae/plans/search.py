"""Ranked line search: match trees over lines, as DataFrame plans.

A plan has two steps that both sources of hits share.  *Hits*: for each line, the array of
(term, position) of its tokens that some phrase of the query can use.  They come from the posting
blocks of a stored index (a filter on ``term`` that reaches the sorted Parquet files, then one
grouping by line; searches for single terms leave out blocks that hold no line good enough), or from
the lines themselves (an array filter, no shuffle).  *Ranking*: phrase
instances are counted inside the array, the boolean tree is an expression over these counts, and
BM25 (Robertson and Zaragoza; k1 = 1.2, b = 0.75) adds up the phrases of branches that hold.

``n`` of a phrase is the number of lines that hold it; an inverse document frequency that is not
positive counts as 1e-6.  A phrase scores on a line only if every AND and NOT around it holds
there; what stands right of NOT never scores.  In NEAR only instances close to all others count,
while ``n`` is that of the plain phrase.  Scores are negative, best first; ties go by file, line.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from tesserae.functions.snippet import snippet
from tesserae.functions.text import tokens
from tesserae.plans.blocks import Layered, block_bounds, block_postings, single_terms
from tesserae.plans.match import And, Near, Node, Not, Phrase, leaves, parse
from tesserae.workspace import scratch, written

Tables = dict[str, DataFrame]

#: The parameters of BM25, the least inverse document frequency, the most results.
K1, B, LEAST_IDF, MOST = 1.2, 0.75, 1e-6, 50


def limit_of(limit: int | None) -> int:
    return MOST if limit is None or limit <= 0 else limit


def phrases_of(node: Node) -> list[Phrase]:
    return [p for leaf in leaves(node) for p in leaf.phrases]


def wanted(node: Node, term: Column) -> Column:
    """Whether a term can take part in a phrase of the tree."""
    whole: set[str] = set()
    starts: set[str] = set()
    for p in phrases_of(node):
        if p.terms:
            whole.update(p.terms[:-1] if p.prefix else p.terms)
            if p.prefix:
                starts.add(p.terms[-1])
    tests = [term.startswith(s) for s in sorted(starts)]
    if whole:
        tests.append(term.isin(*sorted(whole)))
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def tokenized(lines: DataFrame) -> DataFrame:
    """file, line, content, toks."""
    return lines.select("file", "line", "content", tokens(F.col("content")).alias("toks"))


def marked_tokens(lines: DataFrame) -> DataFrame:
    """file, line, term, first: every token, and 1 for one of equal terms of a line, 0 for others, so
    that one grouping by term does for counts of lines and of occurrences."""
    ordered = tokenized(lines).select("file", "line", F.sort_array("toks").alias("toks"))
    marked = F.transform("toks", lambda t, i: F.struct(t.alias("term"), F.coalesce(F.get("toks", i - 1) != t, F.lit(True)).cast("int").alias("first")))
    return ordered.select("file", "line", F.inline(marked))


def term_stats(lines: DataFrame) -> DataFrame:
    """term, df (lines), cf (occurrences)."""
    return marked_tokens(lines).groupBy("term").agg(F.sum("first").alias("df"), F.count(F.lit(1)).alias("cf"))


def holds_wanted(node: Node, toks: str) -> Column:
    """Whether some of a line's terms can take part in a phrase of the tree."""
    if any(p.prefix for p in phrases_of(node)):
        return F.exists(toks, lambda t: wanted(node, t))
    whole = sorted({t for p in phrases_of(node) for t in p.terms})
    return F.arrays_overlap(toks, F.array(*map(F.lit, whole))) if whole else F.lit(False)


def hits_of_lines(lines: DataFrame, node: Node) -> DataFrame:
    """file, line, content, len, hits from the lines themselves."""
    toks = tokenized(lines)
    places = F.filter(F.sequence(F.lit(0), F.size("toks") - 1), lambda i: wanted(node, F.get("toks", i)))
    hits = F.transform(places, lambda i: F.struct(F.get("toks", i).alias("term"), i.alias("pos")))
    none = F.array().cast("array<struct<term:string,pos:int>>")
    return toks.select("file", "line", "content", F.size("toks").alias("len"), F.when(holds_wanted(node, "toks"), hits).otherwise(none).alias("hits"))


def hits_of_postings(posts: DataFrame, node: Node) -> DataFrame:
    """file, line, len, hits from stored postings: lines with a hit only."""
    some = posts.where(wanted(node, F.col("term")))
    return some.groupBy("file", "line").agg(F.first("n_tokens").alias("len"), F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("hits"))


def starts_of(p: Phrase, hits: Column) -> Column:
    """The positions at which a phrase starts in a line."""
    if not p.terms:
        return F.array().cast("array<int>")

    def places(k: int) -> Column:
        """Where the phrase would start for each place of its k-th term."""
        last = p.prefix and k == len(p.terms) - 1
        own = F.filter(hits, lambda h: h["term"].startswith(p.terms[k]) if last else h["term"] == p.terms[k])
        return F.transform(own, lambda h: h["pos"] - k)

    found = places(0)
    for k in range(1, len(p.terms)):
        found = F.array_intersect(found, places(k))
    return F.filter(found, lambda x: x == 0) if p.initial else found


#: The most places of an array that a window of NEAR can be asked to span.
WIDEST = 1 << 29


def near_counts(df: DataFrame, leaf: Near, columns: list[str], name: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with helping columns, and how many instances of each phrase of a NEAR lie in a window
    with one of every other: from the end of the earliest to the start of the latest there are at
    most ``distance`` terms.

    The instances of all phrases are put in order once.  What a window holds then stands next to
    its latest instance, at most ``span`` places away, so each instance looks at its vicinity."""
    sizes = [len(p.terms) for p in leaf.phrases]
    span = min(len(sizes) * (leaf.distance + max(sizes) + 1), WIDEST)

    def numbered(i: int, starts: str) -> Column:
        return F.transform(starts, lambda x: F.struct(x.alias("at"), F.lit(i).alias("p")))

    each = [numbered(i, c) for i, c in enumerate(columns)]
    none = F.array().cast("array<struct<at:int,p:int>>")
    all_there = reduce(lambda a, b: a & b, [F.size(c) > 0 for c in columns])
    df = df.withColumn(f"{name}_all", F.when(all_there, F.array_sort(F.concat(*each))).otherwise(none))

    def closes(x: Column, k: Column) -> Column:
        """Whether the window whose latest instance is ``x`` has one of every phrase."""
        behind = F.slice(f"{name}_all", F.greatest(k + 2 - span, F.lit(1)), span + len(sizes))

        def has(j: int) -> Column:
            return F.exists(behind, lambda y: (y["p"] == j) & (y["at"] <= x["at"]) & (y["at"] + sizes[j] >= x["at"] - leaf.distance))

        return reduce(lambda a, b: a & b, [has(j) for j in range(len(sizes))])

    df = df.withColumn(f"{name}_ends", F.transform(f"{name}_all", lambda x, k: F.struct(x["at"].alias("at"), x["p"].alias("p"), closes(x, k).alias("closes"))))

    def counted(i: int) -> Column:
        def inside(x: Column, k: Column) -> Column:
            ahead = F.slice(f"{name}_ends", F.greatest(k + 2 - len(sizes), F.lit(1)), span + len(sizes))
            return (x["p"] == i) & F.exists(ahead, lambda y: y["closes"] & (y["at"] >= x["at"]) & (y["at"] - leaf.distance <= x["at"] + sizes[i]))

        return F.size(F.filter(f"{name}_ends", inside))

    return df, [counted(i) for i in range(len(sizes))]


def evaluated(hits: DataFrame, node: Node) -> tuple[DataFrame, Column, dict[int, Column]]:
    """``hits`` with ``s0, s1 ...`` (starts of each phrase) and ``f0, f1 ...`` (instances that
    count), the condition of the tree, and for each phrase the condition under which it scores."""
    every = phrases_of(node)
    df = hits.select("*", *[starts_of(p, F.col("hits")).alias(f"s{i}") for i, p in enumerate(every)])
    counts: list[Column] = []
    at = 0
    spots: dict[int, tuple[int, int]] = {}
    for n, leaf in enumerate(leaves(node)):
        own = list(range(at, at + len(leaf.phrases)))
        spots[n] = (own[0], own[-1] + 1)
        at += len(leaf.phrases)
        found = [F.size(f"s{i}") for i in own]
        if len(own) > 1 and not leaf.dead:
            df, found = near_counts(df, leaf, [f"s{i}" for i in own], f"near{n}")
        counts += [F.lit(0).alias(f"f{i}") if leaf.dead else c.alias(f"f{i}") for i, c in zip(own, found, strict=True)]
    df = df.select("*", *counts)
    gate: dict[int, Column] = {}
    leaf_no = iter(range(len(spots)))

    def walk(x: Node, open_: Column, scores: bool) -> Column:
        if isinstance(x, Near):
            a, b = spots[next(leaf_no)]
            holds = reduce(lambda p, q: p & q, [F.col(f"f{i}") > 0 for i in range(a, b)])
            for i in range(a, b):
                gate[i] = (open_ & holds) if scores else F.lit(False)
            return holds
        if isinstance(x, Not):
            # The gate of the left side needs the right side's truth, so that is walked first on a copy.
            mine = _truth(x, spots, leaf_no_of[id(x)])
            left = walk(x.left, open_ & mine, scores)
            right = walk(x.right, F.lit(False), False)
            return left & ~right
        if isinstance(x, And):
            mine = _truth(x, spots, leaf_no_of[id(x)])
            return reduce(lambda p, q: p & q, [walk(p, open_ & mine, scores) for p in x.parts])
        return reduce(lambda p, q: p | q, [walk(p, open_, scores) for p in x.parts])

    leaf_no_of = _first_leaf(node)
    condition = walk(node, F.lit(True), True)
    return df, condition, gate


def _first_leaf(node: Node) -> dict[int, int]:
    """The number of the first leaf below each inner node."""
    out: dict[int, int] = {}

    def go(x: Node, at: int) -> int:
        out[id(x)] = at
        if isinstance(x, Near):
            return at + 1
        for p in (x.left, x.right) if isinstance(x, Not) else x.parts:
            at = go(p, at)
        return at

    go(node, 0)
    return out


def _truth(node: Node, spots: dict[int, tuple[int, int]], first: int) -> Column:
    at = first

    def go(x: Node) -> Column:
        nonlocal at
        if isinstance(x, Near):
            a, b = spots[at]
            at += 1
            return reduce(lambda p, q: p & q, [F.col(f"f{i}") > 0 for i in range(a, b)])
        if isinstance(x, Not):
            return go(x.left) & ~go(x.right)
        return reduce((lambda p, q: p & q) if isinstance(x, And) else (lambda p, q: p | q), [go(p) for p in x.parts])

    return go(node)


def idf(n_lines: int, n: int) -> float:
    value = math.log((n_lines - n + 0.5) / (n + 0.5))
    return value if value > 0 else LEAST_IDF


def gain(n_lines: int, n_tokens: int, n: int, f: Column, length: Column) -> Column:
    """What ``f`` instances of a phrase that ``n`` lines hold add to the score of a line."""
    f = f.cast("double")
    return F.lit(idf(n_lines, n)) * f * (K1 + 1) / (f + K1 * (F.lit(1 - B) + F.lit(B) * length / F.lit(max(n_tokens, 1) / max(n_lines, 1))))


def ranked(hits: DataFrame, node: Node, corpus: tuple[int, int] | None = None, counts: list[int] | None = None) -> DataFrame:
    """Matching lines of ``hits`` (file, line, content if there) with their score.

    ``corpus`` is (lines, tokens) of all lines; without it ``hits`` has all lines itself.  ``counts``
    are the numbers of lines that hold each phrase.  Where they are not known, one pass counts lines,
    tokens and phrases and writes what the score of a matching line needs; the counts are a row of
    numbers, and the score is an expression over the rows written."""
    df, condition, gate = evaluated(hits, node)
    every = range(len(phrases_of(node)))
    kept = [c for c in ("file", "line", "content") if c in hits.columns]
    columns = [*kept, "len", *[F.when(gate[i], F.col(f"f{i}")).otherwise(0).alias(f"f{i}") for i in every]]
    if corpus is None or counts is None:
        seen = Observation()
        held = [F.count_if(F.size(f"s{i}") > 0).alias(f"n{i}") for i in every]
        df = df.observe(seen, F.count(F.lit(1)).alias("lines"), F.sum("len").alias("tokens"), *held)
        matches = written(df.where(condition).select(*columns), "matches")
        total = seen.get
        corpus = corpus or (total.get("lines") or 0, total.get("tokens") or 0)
        counts = [total.get(f"n{i}") or 0 for i in every]
    else:
        matches = df.where(condition).select(*columns)
    score = F.lit(0.0)
    for i in every:
        score = score - gain(*corpus, counts[i], F.col(f"f{i}"), F.col("len"))
    return matches.select(*kept, score.alias("score"))


def in_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.round("score", 9), "file", "line")


def best_rows(matches: DataFrame, limit: int) -> list[Row]:
    """(file, line, score) of the best lines: as many rows as are shown."""
    return in_order(matches.select("file", "line", "score")).limit(limit).collect()


#: Files by name up to which a filter on the files goes before the lines are cut.
NAMED = 1000


def shown(lines: DataFrame, best: list[Row]) -> DataFrame:
    """file, line, content, score: contents of some lines, whose files alone are looked into."""
    top = lines.sparkSession.createDataFrame([tuple(r) for r in best], "file string, line int, score double")
    files = sorted({r["file"] for r in best})
    some = lines.where(F.col("file").isin(files)) if len(files) <= NAMED else lines
    return in_order(some.join(F.broadcast(top), ["file", "line"]).select("file", "line", "content", "score"))


def search_lines(lines: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """file, line, content, score of the best lines, without an index."""
    node = parse(query)
    with scratch(lines.sparkSession):
        best = best_rows(ranked(hits_of_lines(lines, node).drop("content"), node), limit_of(limit))
    return shown(lines, best)


def all_matches(lines: DataFrame, query: str) -> DataFrame:
    """file, line, score of every matching line."""
    node = parse(query)
    return ranked(hits_of_lines(lines, node).drop("content"), node)


def line_statistics(new: DataFrame, old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, tokens) in one row, and (term, df): of some lines, or what they are more than others."""
    signed = new.withColumn("sign", F.lit(1)) if old is None else new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
    toks = signed.select("sign", tokens(F.col("content")).alias("toks"))
    zero = F.lit(0).cast("long")
    corpus = toks.agg(F.coalesce(F.sum("sign"), zero).alias("lines"), F.coalesce(F.sum(F.col("sign") * F.size("toks")), zero).alias("tokens"))
    each = toks.select("sign", F.explode(F.array_distinct("toks")).alias("term"))
    return corpus, each.groupBy("term").agg(F.sum("sign").alias("df")).where("df != 0")


def line_index(lines: DataFrame) -> Tables:
    """The tables of an index of lines: blocks, corpus, term_counts."""
    corpus, counts = line_statistics(lines)
    n = corpus.collect()[0]
    return {"blocks": block_postings(lines, n["lines"], n["tokens"]), "corpus": corpus, "term_counts": counts}


#: Blocks whose numbers go into a filter; more are joined.
PICKED = 2000


def best_by_blocks(index: Layered, node: Node, terms: list[str], corpus: tuple[int, int], limit: int) -> tuple[list[Row], int]:
    """The best lines of a search for single terms, and how many blocks were unpacked."""
    distinct = sorted(set(terms))
    known = {r["term"]: r["df"] for r in index.term_counts.where(F.col("term").isin(distinct)).collect()}
    counts = [known.get(t, 0) for t in terms]
    gains = {t: gain(*corpus, known.get(t, 0), F.col("x.tf"), F.col("x.len")) for t in distinct}
    bounds = written(block_bounds(index, node, distinct, gains), "block-bounds")

    def lines_of(posts: DataFrame) -> DataFrame:
        return ranked(hits_of_postings(posts, node), node, corpus, counts)

    first = bounds.orderBy(F.col("bound").desc(), "layer", "block").limit(2 * limit).collect()
    if not first:
        return [], 0
    best = best_rows(lines_of(index.chosen(distinct, _by_layer(first))), limit)
    if len(first) < 2 * limit:
        return best, len(first)
    # A bound is the same sum in another order of its terms: a hair of rounding is allowed for.
    reach = -best[-1]["score"] - 1e-8 if len(best) == limit else 0.0
    done = F.array(*[F.struct(F.lit(r["layer"]).alias("layer"), F.lit(r["block"]).alias("block")) for r in first])
    rest = bounds.where((F.col("bound") >= reach) & ~F.array_contains(done, F.struct("layer", "block")))
    n = rest.count()
    if not n:
        return best, len(first)
    posts = index.chosen(distinct, _by_layer(rest.collect())) if n <= PICKED else index.joined(distinct, rest)
    more = best_rows(lines_of(posts), limit)
    return sorted([*best, *more], key=lambda r: (round(r["score"], 9), r["file"], r["line"]))[:limit], len(first) + n


def _by_layer(rows: list[Row]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for r in rows:
        out.setdefault(r["layer"], []).append(r["block"])
    return out


def search_index(index: Layered, query: str, limit: int | None = None) -> DataFrame:
    """file, line, content, score of the best lines, from a stored index.  Numbers of lines, tokens and
    documents per term are read, not counted; contents are fetched for the best lines only, and what
    is written on the way is gone when this returns."""
    node, k = parse(query), limit_of(limit)
    total = index.corpus.collect()[0]
    corpus = (total["lines"], total["tokens"])
    terms = single_terms(node)
    with scratch(index.lines.sparkSession):
        if terms:
            best, _ = best_by_blocks(index, node, terms, corpus, k)
        else:
            best = best_rows(ranked(hits_of_postings(index.postings(), node), node, corpus), k)
    return shown(index.lines, best)


def with_snippets(results: DataFrame, query: str) -> DataFrame:
    """``results`` and a column ``snippet``; made after the limit, for the few rows shown."""
    node = parse(query)

    @F.pandas_udf("string")
    def shown(content: pd.Series) -> pd.Series:
        return content.map(lambda c: snippet(c, node))

    return results.withColumn("snippet", shown("content"))
