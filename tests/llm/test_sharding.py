import zlib
from collections import Counter, defaultdict

import pytest

from tesserae.llm import sharding
from tests.llm.helpers import TEXTS, clashing, documents, rows


def test_rows_sizes_slots(spark):
    out = rows(sharding.shard_documents(documents(spark), 5))
    assert len(out) == len(TEXTS)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in TEXTS)
    assert Counter(r[:3] for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r[4]].append(r[5])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert all(r[6] in (r[4], 5) for r in out), "a new shard takes rows only into itself"


def test_one_key_of_many_rows(spark):
    """Slots of null keys and of one id follow (size, checksum), equal rows stand together, and the runs
    that a task sorts are small."""
    texts = [(None if i % 2 else 7, "x" * (i % 97) + str(i % 600), "en", "a") for i in range(4000)]
    out = rows(sharding.shard_documents(documents(spark, texts), 5))
    assert Counter(r[:3] for r in out) == Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t, _, _ in texts)
    for key in (None, 7):
        own = sorted((r for r in out if r[0] == key), key=lambda r: r[5])
        assert len({r[4] for r in own}) == 1 and [r[1:3] for r in own] == sorted(r[1:3] for r in own)
    for shard in {r[4] for r in out}:
        assert sorted(r[5] for r in out if r[4] == shard) == list(range(sum(r[4] == shard for r in out)))
    assert max(Counter((r[0], r[1]) for r in set(r[:3] for r in out)).values()) < 100


def test_extra_columns_and_empty(spark):
    assert rows(sharding.shard_documents(clashing(documents(spark)), 5)) == rows(sharding.shard_documents(documents(spark), 5))
    assert rows(sharding.shard_documents(documents(spark, []), 5)) == []


def test_few_move_and_weights(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    small = dict(rows(sharding.rendezvous(ids, "doc_id", [1.0] * 10).select("doc_id", "shard")))
    large = dict(rows(sharding.rendezvous(ids, "doc_id", [1.0] * 11).select("doc_id", "shard")))
    moved = [i for i in small if small[i] != large[i]]
    assert all(large[i] == 10 for i in moved) and 250 < len(moved) < 480
    heavy = Counter(r[1] for r in rows(sharding.rendezvous(ids, "doc_id", [1.0, 3.0]).select("doc_id", "shard")))
    assert 2800 < heavy[1] < 3200


def test_weights_are_checked(spark):
    with pytest.raises(ValueError):
        sharding.rendezvous(spark.range(1), "id", [1.0, 0.0])
