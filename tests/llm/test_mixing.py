import math
from collections import Counter, defaultdict

import pytest

from tesserae.llm import mixing
from tests.llm.helpers import TEXTS, clashing, documents, rows


def sources(spark, sizes):
    data = []
    for s, n in sizes.items():
        data += [(len(data) + k, "w " * (3 + k % 5), "en", s) for k in range(n)]
    return documents(spark, data)


def test_repetition_limit(spark):
    docs = sources(spark, {"big": 400, "mid": 100, "small": 40})
    out = mixing.mix(docs, max_epochs=2.0).select("doc_id", "source", "mix_tokens", "mix_epoch", "mix_weight").collect()
    per = Counter(r["doc_id"] for r in out)
    assert set(per) == {r["doc_id"] for r in docs.collect()}, "every row is read once at least"
    tokens = defaultdict(int)
    for r in out:
        tokens[r["source"]] += r["mix_tokens"]
    whole = defaultdict(int)
    for r in docs.collect():
        whole[r["source"]] += len(r["text"].split())
    epochs = {s: tokens[s] / whole[s] for s in whole}
    assert epochs["big"] == 1 and abs(epochs["small"] - 2) < 0.1 and 1 < epochs["mid"] < 2
    weight = {r["source"]: r["mix_weight"] for r in out}
    total = sum(tokens.values())
    assert all(abs(tokens[s] / total - weight[s]) < 0.02 for s in weight)
    assert max(r["mix_epoch"] for r in out) == 1


def test_entropy_target(spark):
    docs = sources(spark, {"big": 500, "small": 50})
    plan = mixing.source_plan(docs.groupBy(mixing.source_key().alias("key")).agg({"n_chars": "sum"}).withColumnRenamed("sum(n_chars)", "tokens"), None, 0.5, None).collect()
    w = [r["weight"] for r in plan]
    assert abs(sum(w) - 1) < 1e-6 and abs(-sum(x * math.log(x) for x in w) - 0.5) < 1e-4


def test_budget_is_kept(spark):
    docs = sources(spark, {"big": 300, "small": 30})
    whole = sum(len(r["text"].split()) for r in docs.collect())
    out = mixing.mix(docs, max_epochs=3.0, budget_tokens=whole).collect()
    used = sum(r["mix_tokens"] for r in out)
    assert whole - 20 <= used <= whole


def test_odd_rows(spark):
    plain = rows(mixing.mix_report(documents(spark)))
    assert rows(mixing.mix_report(clashing(documents(spark)))) == plain
    assert {r[0] for r in plain} == {i for i, _, _, _ in TEXTS}
    assert rows(mixing.mix_report(documents(spark, []))) == []
    kept = mixing.mix(clashing(documents(spark)))
    assert {"epochs", "rest", "mark"} <= set(kept.columns) and kept.where("rest != 'x'").count() == 0


def test_arguments(spark):
    with pytest.raises(ValueError):
        mixing.mix(documents(spark), max_epochs=2.0, target_entropy=1.0)
