import hashlib

import pytest

from tesserae.llm.common import tokenizer_file
from tests.llm.helpers import TEXTS, clashing, documents, rows
from tests.llm.test_jaccard import near_copies
from tests.llm.test_toxicity import corpus

pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")


def test_stages(spark, tmp_path):
    docs, labels = corpus(spark, 300)
    copies = near_copies(12, 80, 1, 6)
    both = docs.unionByName(spark.createDataFrame([(i, t, g, s, len(t)) for i, t, g, s in copies], docs.schema))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
    bad = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert len(bad & set(sizes[0])) <= 2
    assert len([i for i in sizes[1] if i >= 6000]) < 12 and min(i for i in sizes[0] if i >= 6000) in sizes[1]
    assert set(sizes[2]) == set(sizes[1])
    ids = tokenizers.Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    for r in docs.limit(20).collect():
        want = ids.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    again = sorted(tuple(r) for r in pipeline.run(spark, str(tmp_path)).collect())
    assert again == sorted(tuple(r) for r in docs.collect())


@pytest.fixture
def odd(spark, tmp_path):
    """A folder whose documents hold every odd case, and labels of both kinds."""
    docs, labels = corpus(spark, 120)
    moved = docs.withColumn("doc_id", docs.doc_id + 1000)
    moved.unionByName(documents(spark)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("doc_id", labels.doc_id + 1000).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_odd_rows_in_every_stage(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    want = {}
    for name, stage in pipeline.STAGES:
        plain, more = rows(stage(spark, docs, odd)), rows(stage(spark, clashing(docs), odd))
        assert plain == more, name
        want[name] = plain
    ids = lambda name: sorted(repr(r[0]) for r in want[name] if r[0] is None or r[0] < 1000)
    assert ids("toxicity") == sorted(repr(i) for i, *_ in TEXTS)
    # 1, 2, 3 and 14 are near copies, as are 8 and 9; the row 12 stands twice.
    assert ids("near_copies") == sorted(map(repr, [1, 4, 5, 6, 7, 8, 10, 11, 12, None]))
    assert set(ids("mixing")) == set(map(repr, [i for i, *_ in TEXTS]))
    assert sum(r[0] == 12 for r in want["mixing"]) >= 2 and {r[1] for r in want["bpe"] if r[0] in (4, 5, 10)} == {0}
    assert len(want["bpe"]) == docs.count()


def test_empty_tables_in_every_stage(spark, odd, tmp_path):
    docs = documents(spark, [])
    for _, stage in pipeline.STAGES:
        assert rows(stage(spark, docs, odd)) == []
    spark.read.parquet(f"{odd}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert len(rows(pipeline.STAGES[0][1](spark, documents(spark), f"{tmp_path}/none"))) == len(TEXTS)
