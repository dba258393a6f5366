import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import toxicity as t
from tests.llm.helpers import TEXTS, clashing, documents, rows


def corpus(spark, n=600):
    rng = random.Random(4)
    data, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["zounder", "wretchy", "vilekin"])
        data.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, int(bad)))
    return documents(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus(spark)
    return docs, labels, t.train(docs, labels)


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    got = t.score_documents(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 60 and np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_odd_rows(spark, fitted):
    _, _, model = fitted
    got = rows(t.score_documents(clashing(documents(spark)), model))
    assert got == rows(t.score_documents(documents(spark), model)) and len(got) == len(TEXTS)
    assert len({r[2] for r in got if r[0] in (1, 2)}) == 1
    assert rows(t.score_documents(documents(spark, []), model)) == []
    kept = t.keep_clean(clashing(documents(spark)), model)
    assert kept.columns == clashing(documents(spark)).columns and kept.count() == len(TEXTS)


def test_rejects(fitted):
    docs, labels, model = fitted
    left = {r["doc_id"] for r in t.keep_clean(docs, model).collect()}
    bad = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert len(left & bad) < 0.05 * len(bad) and len(left) > 0.95 * (600 - len(bad))


def test_no_labels(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r[2] for r in rows(t.score_documents(docs, t.train(docs, none)))} == {0.0}
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert t.train(docs, odd).trees is None


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    for n in [1, 2, 5, 40] * 40 + [500]:
        x = rng.normal(size=n).round(1 if n < 500 else 9)
        at, value = t.isotonic(x, (rng.random(n) < 1 / (1 + np.exp(-3 * x))).astype(float))
        assert (np.diff(at) >= 0).all() and (np.diff(value) > 0).all()
    assert value[0] < 0.2 < 0.8 < value[-1]


def test_isotonic_is_the_best_rising_fit():
    """Against the fit by its closed form: the largest of the least means of runs around each row."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        x, y = np.sort(rng.normal(size=12)), rng.integers(0, 2, 12).astype(float)
        best = [max(min(y[a : b + 1].mean() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(t.isotonic(x, y)[1], np.unique(np.round(best, 12)))


def test_trees_against_a_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.random((300, 5))
    trees = t.fit_trees(x, (x[:, 1] + x[:, 3] > 1).astype(float), trees=12)
    for row, got in zip(x, trees.margin(x), strict=True):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        assert abs(total - got) < 1e-9


def test_lexicon_counts_every_labelled_row(spark):
    """Toxic words of rows that the trees' sample does not hold are still learned; nothing is cut."""
    docs, labels = corpus(spark)
    model = t.train(docs, labels, sample_rows=60)
    assert {"zounder$", "wretchy$", "vilekin$"} <= set(model.lexicon.weights)
    many = [(i, " ".join(f"bad{'abcdefgh'[k % 8]}{'abcdefgh'[k // 8 % 8]}{'abcdefgh'[k // 64]}x" for k in range(500)) if i % 4 == 0 else " ".join(["fine words only here"] * 400), "en", "a") for i in range(80)]
    found = t.train(documents(spark, many), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")).lexicon.weights
    assert sum(e.endswith("$") for e in found) == 500


def test_repeated_ids_do_not_outgrow_the_sample(spark):
    docs = documents(spark, [(i % 10, f"text {i} of many", "en", "a") for i in range(400)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(10)] * 3, "doc_id long, quality int, toxic int")
    model = t.train(docs, labels, sample_rows=8)
    assert model.trees is not None and 0 <= model.rate <= 1


def test_driver_labels(spark, sf):
    """Held-out labels of the driver's table are ranked well, and clean documents pass."""
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    got = t.score_documents(docs, t.train(docs, labels)).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    bad, good = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    auc = ((bad[:, None] > good[None, :]) + 0.5 * (bad[:, None] == good[None, :])).mean()
    assert auc > 0.9 and (got.predicted == got.toxic).mean() > 0.9


def test_held_out_labels_are_not_read(spark, fitted):
    docs, labels, model = fitted
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows(t.score_documents(docs, t.train(docs, turned))) == rows(t.score_documents(docs, model))
