"""Approximate nearest neighbours by inner product, with learned partitions.

Fit, on a bounded sample (``sample_rows`` rows by hash order at most): the exact neighbour graph of
the sample is cut into equal parts, as many as give ``part_rows`` rows to each (a sixteenth of the
sample at most), by recursive spectral bisection at the median, and a
small network learns the distribution of a vector's neighbours over the parts.  ``probes`` is the
least number of most probable parts that hold ``aim`` of the neighbours of held-out sample rows
(neighbours in the sample lie farther away than those among all rows, so the estimate is on the
safe side); where no number does, all parts are probed.

Every row is indexed: it belongs to its most probable part.  A query goes to its ``probes`` most
probable parts and is compared with every row there, in double precision.

Where the sample can tell no more parts apart and a part has far more than ``part_rows`` rows, a part
is parted again in the same way: a task fits its own graph and classifier on a bounded sample
(``node_rows``) of the part's rows, and rows and queries of the part are routed once more.  Levels
are added until parts have about ``part_rows`` rows, so what a query is compared with and how often
a row is copied grow with the number of levels, not with the table, where a sample shows the
neighbourhoods; without such structure most parts are probed at every level.  Each level moves every row once.

Work is dealt in cells (part, candidate block, query block).  Parts are cut into blocks by a hash
of the row, by their counted sizes, so that no cell holds more than about ``block_rows``
candidates and ``block_rows`` queries, however large a part or a group of equal vectors is; rows of
one vec_id (on further levels: of one vec_id and vector) are expected to be few, and share a block.  A cell
returns its nearest for each query; a last grouping by query merges them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do those of another length than most; a query never meets rows with its own vec_id;
equal scores go to the smaller vec_id; a null vec_id is no query and no candidate; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import hash_sample, written

BIG = 1 << 30

#: Neighbours of a sample row for which the probes of a further level are chosen, at least.
LEAST_NEAR = 4


@dataclass
class Router:
    """The classifier: two layers, part probabilities of vectors; and the number of probes."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def unit(x: np.ndarray) -> np.ndarray:
    """Directions, in single precision; the scale is taken out first so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest by inner product of each row of a sample."""
    out = []
    for at in range(0, len(x), 1024):
        near = x[at : at + 1024] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out.append(np.argpartition(-near, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def bisect(graph: np.ndarray, nodes: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of some nodes with few edges between: the second eigenvector, cut at its median."""
    place = np.full(len(graph), -1)
    place[nodes] = np.arange(len(nodes))
    to = place[graph[nodes]]
    rows, cols = np.nonzero(to >= 0)
    a, b = rows, to[rows, cols]
    degree = np.bincount(np.concatenate([a, b]), minlength=len(nodes)) + 1e-9
    x = rng.standard_normal(len(nodes))
    for _ in range(60):
        y = np.bincount(a, x[b], len(nodes)) + np.bincount(b, x[a], len(nodes))
        x = 0.5 * x + 0.5 * y / degree
        x -= (x * degree).sum() / degree.sum()
        x /= np.linalg.norm(x) + 1e-30
    order = np.argsort(x, kind="stable")
    half = len(nodes) // 2
    return nodes[order[:half]], nodes[order[half:]]


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each node; sizes differ by rounding only.  ``parts`` is a power of two."""
    groups = [np.arange(len(graph))]
    while len(groups) < parts:
        groups = [half for g in groups for half in bisect(graph, g, rng)]
    out = np.zeros(len(graph), np.int64)
    for i, g in enumerate(groups):
        out[g] = i
    return out


def fit(x: np.ndarray, parts: int, k: int, aim: float, hidden: int = 128, epochs: int = 40, seed: int = 3, near: int | None = None) -> Router:
    """Partition a sample and train the classifier on it.  The number of probes is chosen for the
    ``near`` nearest in the sample (default ``k``)."""
    rng = np.random.default_rng(seed)
    while parts > 1 and len(x) < 16 * parts:
        parts //= 2
    n, dim = x.shape
    if parts == 1:
        return Router(np.zeros((dim, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32), 1)
    x = x / np.abs(x).max()
    graph = neighbour_graph(x, min(k, n - 1))
    part = balanced_parts(graph, parts, rng)
    target = np.zeros((n, parts), np.float32)
    np.add.at(target, (np.arange(n)[:, None], part[graph]), 1.0 / graph.shape[1])
    target = 0.5 * target
    target[np.arange(n), part] += 0.5
    held = rng.permutation(n) < n // 5
    feed, goal = unit(x), target
    w = [rng.standard_normal((dim, hidden)) * np.sqrt(2 / dim), np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    w = [a.astype(np.float32) for a in w]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    train, step = np.flatnonzero(~held), 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            step += 1
            inner = np.maximum(feed[batch] @ w[0] + w[1], 0)
            z = inner @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - goal[batch]) / len(batch)
            back = (d @ w[2].T) * (inner > 0)
            for i, g in enumerate((feed[batch].T @ back, back.sum(axis=0), inner.T @ d, d.sum(axis=0))):
                g = g + (1e-4 * w[i] if i in (0, 2) else 0)
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = (w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    router = Router(*w, probes=parts)
    logits = router.logits(x)
    place = np.argsort(np.argsort(-logits, axis=1, kind="stable"), axis=1, kind="stable")
    home = logits.argmax(axis=1)
    sought = graph if near is None or near >= graph.shape[1] else neighbour_graph(x, near)
    rank = place[np.arange(n)[:, None], home[sought]][held]  # how far down its list a query must go for each neighbour
    for probes in range(1, parts + 1):
        if (rank < probes).mean() >= aim:
            router.probes = probes
            break
    return router


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, always summed in the same order."""
    return (a * b).sum(axis=1)


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of each query's k nearest in a block."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), step):
        q, ids = queries[at : at + step], query_ids[at : at + step]
        near = q @ rows.T
        near[ids[:, None] == row_ids[None, :]] = -np.inf
        if len(row_ids) > k:
            edge = np.partition(near, len(row_ids) - k, axis=1)[:, len(row_ids) - k]
            edge = edge - 1e-9 * (1 + np.abs(edge))  # rounding of the fast product must not lose a tie
        else:
            edge = np.full(len(q), -np.finfo(float).max)
        i, j = np.nonzero((near >= edge[:, None]) & (near > -np.inf))
        score = exact(q[i], rows[j])
        order = np.lexsort((row_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        take = place < k
        out.append((ids[i[take]], row_ids[j[take]], score[take]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def parts_for(rows: int, part_rows: int, most: int) -> int:
    """A power of two of parts of about ``part_rows`` rows: 32 at least, ``most`` at most."""
    return max(32, min(most, 1 << max(0, (max(1, rows) // part_rows).bit_length() - 1)))


def levels_below(rows: int, parts: int, part_rows: int, most: int) -> list[int]:
    """Into how many parts each further level cuts a part: powers of two, ``most`` at most."""
    out: list[int] = []
    while rows > 2 * parts * part_rows:
        out.append(min(most, 1 << ((rows // (parts * part_rows)).bit_length() - 1)))
        parts *= out[-1]
    return out


def targets(router: Router | None, base: np.ndarray, v: np.ndarray, asks: np.ndarray) -> pa.Array:
    """Where rows go, as lists: a candidate to its most probable part, a query to several."""
    if router is None:
        return pa.array([[int(b)] for b in base], pa.list_(pa.int64()))
    logits = router.logits(v)
    top = np.argsort(-logits, axis=1, kind="stable")[:, : router.probes]
    home = logits.argmax(axis=1)
    return pa.array([base[i] + top[i] if asks[i] else base[i : i + 1] + home[i] for i in range(len(base))], pa.list_(pa.int64()))


def first_level(rows: DataFrame, router: Router, every: int) -> DataFrame:
    """part, asks, vec_id, v: each row as a candidate, and as a query in the parts it is routed to."""
    kind = rows.schema["v"].dataType.simpleString()
    both = F.when(F.col("vec_id") % every == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                asks = batch.column(0).to_numpy(zero_copy_only=False)
                to = targets(shared.value, np.zeros(len(asks), np.int64), matrix(batch.column(2)), asks)
                yield pa.RecordBatch.from_arrays([to, *batch.columns], ["to", *batch.schema.names])

    routed = rows.select(F.explode(both).alias("asks"), "vec_id", "v").mapInArrow(route, f"to array<long>, asks boolean, vec_id long, v {kind}")
    return written(routed.select(F.explode("to").alias("part"), "asks", "vec_id", "v"), "ann-level")


def part_sizes(placed: DataFrame) -> DataFrame:
    """part, rows, queries: one row a part."""
    return written(placed.groupBy("part").agg(F.count_if(~F.col("asks")).alias("rows"), F.count_if("asks").alias("queries")), "ann-sizes")


def next_level(placed: DataFrame, parts: int, k: int, aim: float, node_rows: int, block_rows: int) -> DataFrame:
    """``placed`` with every part cut into ``parts`` by a classifier of its own.

    Classifiers are fitted by tasks on ``node_rows`` rows of a part at most, the first by hash, and
    travel to the blocks of their part.  A part whose every row hashes past the sample stays whole."""
    kind = placed.schema["v"].dataType.simpleString()
    sizes = part_sizes(placed)
    mixed = F.xxhash64("vec_id", "v")
    at = F.pmod(mixed, F.lit(BIG))
    near = placed.where(~F.col("asks")).join(sizes, "part").where(at < F.lit(1.25 * node_rows * BIG) / F.col("rows"))
    first = Window.partitionBy("part").orderBy("at", "vec_id")
    sample = near.select("part", "rows", "vec_id", "v", at.alias("at")).withColumn("place", F.row_number().over(first)).where(F.col("place") <= node_rows)

    def train(group: pa.Table) -> pa.Table:
        # Of the k nearest of all rows, the sample holds its share: the rest of its nearest lie farther off.
        share = group.num_rows / group.column("rows")[0].as_py()
        router = fit(matrix(group.column("v")), parts, k, aim, near=max(LEAST_NEAR, math.ceil(k * share)))
        return pa.table({"part": group.column("part").slice(0, 1).cast(pa.int64()), "router": pa.array([pickle.dumps(router)], pa.binary())})

    routers = written(sample.select("part", "rows", "v").groupBy("part").applyInArrow(train, "part long, router binary"), "ann-routers")
    cells = F.ceil((F.col("rows") + F.col("queries")) / block_rows)
    dealt = placed.join(sizes, "part").select("part", F.pmod(mixed, cells).alias("cell"), "asks", "vec_id", "v")
    theirs = routers.join(sizes, "part").select("part", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)).alias("cell"), "router")

    def route(cell: pa.Table, found: pa.Table) -> pa.Table:
        asks, v = cell.column("asks").to_numpy(), cell.column("v")
        router = pickle.loads(found.column("router")[0].as_py()) if found.num_rows else None
        base = cell.column("part").to_numpy() * parts
        to = targets(router, base, matrix(v), asks) if cell.num_rows else pa.array([], pa.list_(pa.int64()))
        return pa.table({"to": to, "asks": cell.column("asks"), "vec_id": cell.column("vec_id"), "v": v})

    routed = dealt.groupBy("part", "cell").cogroup(theirs.groupBy("part", "cell")).applyInArrow(route, f"to array<long>, asks boolean, vec_id long, v {kind}")
    return written(routed.select(F.explode("to").alias("part"), "asks", "vec_id", "v"), "ann-level")


def cells_of(placed: DataFrame, block_rows: int) -> DataFrame:
    """part, rb, qb, asks, vec_id, v: each block of a part's candidates beside each of its queries."""
    sizes = part_sizes(placed).where("queries > 0 and rows > 0")
    blocks = [F.ceil(F.col(c) / block_rows) for c in ("rows", "queries")]
    own = F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.when(F.col("asks"), blocks[1]).otherwise(blocks[0]))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("asks"), blocks[0]).otherwise(blocks[1]) - 1))
    each = placed.join(sizes, "part").select("part", "asks", "vec_id", "v", own.alias("own"), others.alias("other"))
    rb, qb = F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")), F.when(F.col("asks"), F.col("own")).otherwise(F.col("other"))
    return each.select("part", rb.alias("rb"), qb.alias("qb"), "asks", "vec_id", "v")


def dealt_by_levels(rows: DataFrame, router: Router, below: list[int], k: int, every: int, aim: float, node_rows: int, block_rows: int) -> DataFrame:
    """The cells of a table that is parted more than once."""
    placed = first_level(rows, router, every)
    for parts in below:
        placed = next_level(placed, parts, k, aim, node_rows, block_rows)
    return cells_of(placed, block_rows)


def compared(dealt: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of each cell, and of these the nearest of all."""

    def compare(cell: pa.Table) -> pa.Table:
        asks = cell.column("asks").to_numpy()
        ids, v = cell.column("vec_id").to_numpy(), matrix(cell.column("v"))
        q, r, s = nearest(v[asks], ids[asks], v[~asks], ids[~asks], k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(r, pa.int64()), "score": pa.array(s, pa.float64())})

    found = dealt.groupBy("part", "rb", "qb").applyInArrow(compare, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, k: int = 20, every: int = 20, parts: int | None = None, part_rows: int = 1024, sample_rows: int = 16384, aim: float = 0.96, block_rows: int = 4096, node_rows: int = 4096, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of every row whose id is divisible by ``every``, among all other rows:
    query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == sizes[0]["d"])
    parts = parts or parts_for(sizes[0]["n"], part_rows, sample_rows // 16)
    # A few dozen sample rows for each part are enough; never more than sample_rows.
    sample = hash_sample(rows, min(sample_rows, max(4096, 16 * parts)), "vec_id").toPandas()
    below = levels_below(sizes[0]["n"], parts, part_rows, node_rows // 16)
    aim = aim ** (1 / (1 + len(below)))  # what one level misses, the next cannot find
    router = fit(np.stack(sample["v"].to_numpy()).astype(np.float64), parts, k, aim)
    if below:
        return compared(dealt_by_levels(rows, router, below, k, every, aim, node_rows, block_rows), k)
    shared = spark.sparkContext.broadcast(router)
    hashed = rows.select("vec_id", "v", F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(BIG)).alias("h"))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = shared.value
        n = np.zeros((2, len(router.b2)), np.int64)
        for batch in batches:
            if batch.num_rows:
                logits = router.logits(matrix(batch.column(1)))
                n[0] += np.bincount(logits.argmax(axis=1), minlength=n.shape[1])
                asks = batch.column(0).to_numpy() % every == 0
                top = np.argsort(-logits[asks], axis=1, kind="stable")[:, : router.probes]
                n[1] += np.bincount(top.reshape(-1), minlength=n.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n.shape[1]), pa.int32()), pa.array(n[0]), pa.array(n[1])], ["part", "rows", "queries"])

    counts = hashed.mapInArrow(homes, "part int, rows long, queries long").groupBy("part").agg(F.sum("rows").alias("rows"), F.sum("queries").alias("queries")).collect()  # one row a part
    row_blocks = np.ones(len(counts), np.int64)
    query_blocks = np.ones(len(counts), np.int64)
    for c in counts:
        row_blocks[c["part"]] = max(1, -(-c["rows"] // block_rows))
        query_blocks[c["part"]] = max(1, -(-c["queries"] // block_rows))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = shared.value

        def out(batch: pa.RecordBatch, pick: np.ndarray, part: np.ndarray, rb: np.ndarray, qb: np.ndarray, asks: bool) -> Iterator[pa.RecordBatch]:
            """Copies of rows, a bounded number at a time."""
            for at in range(0, len(pick), 4096):
                own = slice(at, at + 4096)
                some = batch.take(pa.array(pick[own]))
                yield pa.RecordBatch.from_arrays([pa.array(part[own], pa.int32()), pa.array(rb[own], pa.int32()), pa.array(qb[own], pa.int32()), pa.array(np.full(some.num_rows, asks)), some.column(0), some.column(1)], ["part", "rb", "qb", "asks", "vec_id", "v"])

        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                ids, h = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                logits = router.logits(matrix(batch.column(1)))
                home = logits.argmax(axis=1)
                # A candidate block meets every query block of its part, and the other way round.
                times = query_blocks[home]
                pick = np.repeat(np.arange(len(ids)), times)
                qb = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
                yield from out(batch, pick, home[pick], h[pick] % row_blocks[home[pick]], qb, False)
                asking = np.flatnonzero(ids % every == 0)
                if len(asking):
                    top = np.argsort(-logits[asking], axis=1, kind="stable")[:, : router.probes]
                    who, part = np.repeat(asking, top.shape[1]), top.reshape(-1)
                    times = row_blocks[part]
                    pick, to = np.repeat(who, times), np.repeat(part, times)
                    rb = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
                    yield from out(batch, pick, to, rb, h[pick] % query_blocks[to], True)

    kind = rows.schema["v"].dataType.simpleString()
    dealt = hashed.mapInArrow(deal, f"part int, rb int, qb int, asks boolean, vec_id long, v {kind}")
    return compared(dealt, k)
