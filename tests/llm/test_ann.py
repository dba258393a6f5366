import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import ann
from tests.llm.helpers import rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, k, every):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (x * x[q]).sum(axis=1)
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[q]), key=lambda j: (-s[j], ids[j]))[:k]
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def search(spark, ids, x, **options):
    df = spark.createDataFrame([(int(i), [float(a) for a in v], 0) for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = {}
    for r in ann.search(df, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.mark.parametrize("block", [64, 4096])
def test_recall(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 1500)] + 0.6 * rng.normal(size=(1500, 24))).astype(np.float32).astype(float)
    ids = np.arange(1500)
    got, want = search(spark, ids, x, k=10, parts=8, block_rows=block), brute(ids, x, 10, 20)
    assert got.keys() == want.keys()
    hit = np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want])
    assert hit >= 0.9
    score = {(q, v): (x[q] * x[v]).sum() for q in got for v, _ in got[q]}
    assert all(math.isclose(s, score[q, v], rel_tol=1e-12) for q in got for v, s in got[q])


def test_ties_and_few(spark):
    ids, x = np.arange(30), np.ones((30, 4))
    got = search(spark, ids, x, k=5)
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for v, _ in got[20]] == [0, 1, 2, 3, 4]
    assert len(search(spark, ids[:3], x[:3], k=5)[0]) == 2


def test_left_out(spark):
    rows_ = [(0, [1.0, 0.0], 0), (1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (6, [1.0, 2.0, 3.0], 0), (7, [0.5, 0.5], 0), (None, [1.0, 1.0], 0), (20, [], 0), (40, [2.0, 1.0], None)]
    df = spark.createDataFrame(rows_, SCHEMA).withColumn("part", F.lit("x")).withColumn("v", F.lit("x"))
    got = rows(ann.search(df, k=3))
    assert [(r[0], r[1], r[2]) for r in got] == [(0, 1, 40), (0, 2, 7), (40, 1, 0), (40, 2, 7)]
    assert rows(ann.search(spark.createDataFrame([], SCHEMA))) == []


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_on_the_driver_tables(spark, sf, size):
    df = spark.read.parquet(f"{sf}/../{size}/embeddings.parquet")
    t = df.toPandas()
    want = brute(t["vec_id"].to_numpy(), np.stack(t["embedding"].to_numpy()).astype(float), 20, 20)
    got: dict[int, set[int]] = {q: set() for q in want}
    for r in ann.search(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = [len(got[q] & {v for v, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9


def test_parts_grow_with_the_rows():
    assert [ann.parts_for(n, 1024, 1024) for n in (0, 500, 40_000, 70_000, 1_000_000, 10**12)] == [32, 32, 32, 64, 512, 1024]


def test_levels_are_added_until_parts_are_small():
    assert [ann.levels_below(n, 1024, 1024, 256) for n in (10, 2_000_000, 2_200_000, 10**9, 10**12)] == [[], [], [2], [256, 2], [256, 256, 8]]


def clustered(n, dim=16):
    """Rows around centres that are as many as the rows need: about 40 a centre."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(n // 40, dim))
    return (centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, dim))).astype(np.float32).astype(float)


def unit_rows(n):
    x = clustered(n)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)


DEEP = {"parts": 8, "part_rows": 64, "sample_rows": 1024, "node_rows": 256, "block_rows": 256}


@pytest.mark.parametrize("n", [3000, 24000])
def test_recall_of_parted_parts(spark, n):
    """One level below, and two; equal scores are as good as each other."""
    x, ids = unit_rows(n), np.arange(n)
    assert len(ann.levels_below(n, 8, 64, 16)) == (1 if n == 3000 else 2)
    got, want = search(spark, ids, x, k=10, every=100, **DEEP), brute(ids, x, 10, 100)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want]) >= 0.9


def surface(n, dim=16, inner=3):
    """Directions that vary in ``inner`` ways only, however many there are."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, inner)) @ np.linalg.qr(rng.normal(size=(dim, inner)))[0].T
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)


def test_work_of_a_query_does_not_grow(spark):
    """Comparisons and copies for each query, over 24,000 rows and four times as many: both are parted
    twice more.  One level alone would compare four times as much."""
    met, copies = [], []
    for n in (24000, 96000):
        x = surface(n)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<float>")
        below = ann.levels_below(n, 8, 64, 16)
        assert len(below) == 2
        cells = ann.dealt_by_levels(df, ann.fit(x[:1024], 8, 10, 0.98), below, 10, 100, 0.98, 256, 256)
        sizes = cells.groupBy("part", "rb", "qb").agg(F.count_if("asks").alias("a"), F.count_if(~F.col("asks")).alias("r")).agg(F.sum(F.col("a") * F.col("r")), F.sum(F.col("a") + F.col("r"))).first()
        met.append(sizes[0] / (n / 100))
        copies.append(sizes[1] / (n / 100))
    assert met[1] < 1.5 * met[0] and copies[1] < 1.5 * copies[0], (met, copies)


def test_many_copies_in_a_parted_part(spark):
    """A third of the rows are one vector: cells stay bounded, ties go to the smaller id."""
    x, ids = unit_rows(3000), np.arange(3000)
    x[:1000] = x[0]
    got, want = search(spark, ids, x, k=5, every=500, **DEEP), brute(ids, x, 5, 500)
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5] == [v for v, _ in want[0]]
    assert [v for v, _ in got[500]] == [0, 1, 2, 3, 4]


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    graph = ann.neighbour_graph(rng.normal(size=(400, 8)), 6)
    assert set(np.bincount(ann.balanced_parts(graph, 8, rng))) == {50}
