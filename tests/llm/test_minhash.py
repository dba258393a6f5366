import random

import numpy as np
import pytest

from tesserae.llm import jaccard
from tesserae.llm import minhash as m
from tests.llm.helpers import TEXTS, clashing, documents, rows
from tests.llm.test_jaccard import by_hand, near_copies


def with_kept(classes):
    return sorted(((i, n, c, i is not None and i == c) for i, n, c in classes), key=repr)


@pytest.mark.parametrize("k, num, den", [(2, 4, 5), (5, 4, 5), (3, 9, 10)])
def test_classes_by_hand(spark, k, num, den):
    data = TEXTS + near_copies(30, 60, 6, 1) + near_copies(20, 25, 3, 2)
    assert rows(m.minhash_classes(clashing(documents(spark, data)), k, num, den)) == with_kept(by_hand(data, k, num, den))


def test_members_that_no_star_links(spark):
    """Chains: neighbours are linked, hubs and most others are not."""
    words = [f"c{i}" for i in range(400)]
    chain = [(i, " ".join(words[5 * i : 5 * i + 80]), "en", "a") for i in range(60)]
    random.Random(3).shuffle(chain)
    data = chain + near_copies(70, 60, 9, 5) + [(9000 + i, t, "en", "a") for i, (_, t, _, _) in enumerate(chain[::7])]
    want = with_kept(by_hand(data, 2, 4, 5))
    assert len({c for _, _, c, _ in want}) > 3
    assert rows(m.minhash_classes(documents(spark, data), block=7, cell=3)) == want


def test_candidates_are_stars(spark):
    """A group of near copies has no more candidate edges than two a member and band, not all pairs,
    and ends as one class after the stars."""
    data = near_copies(150, 120, 1, 7)
    docs = documents(spark, data)
    signed = m.signed_sets(docs, 2, m.BANDS, m.WIDTH, "doc_id", "text").where("n > 0")
    reps = signed.dropDuplicates(["hi", "lo"]).withColumnRenamed("lo", "node")
    buckets = m.shared_buckets(reps, 4, 5)
    pairs = m.star_tasks(buckets, 4, 5, 64).where("side = 1").count()
    n = reps.count()
    assert n > 60 and pairs <= 2 * 12 * n < n * (n - 1) // 2 * m.BANDS
    assert len({c for _, _, c, _ in rows(m.minhash_classes(docs))}) == 1


@pytest.mark.parametrize("n", [1, 4, 30, 400, 4000])
def test_bins_agree_as_often_as_sets_are_alike(n):
    rng = np.random.default_rng(n)
    places = m.detours(m.BANDS * m.WIDTH)
    seen = []
    for _ in range(60):
        common, a, b = (rng.integers(0, 2**64, c, dtype=np.uint64) for c in (n, -(-n // 8), -(-n // 8)))
        x, y = (m.signature(np.unique(np.concatenate([common, s])), places) for s in (a, b))
        seen.append(np.mean(x == y))
    assert abs(np.mean(seen) - n / (n + 2 * -(-n // 8))) < 0.015


def test_empty_bins_take_the_first_full_bin_of_their_own_order():
    places = m.detours(24)
    assert all(sorted(row.tolist()) == list(range(24)) for row in places)
    hashes = np.sort(np.array([5 << 60, 9 << 60, 9 << 60 | 7, 15 << 60], np.uint64))
    got = m.signature(hashes, places)
    own = {int(h) * 24 >> 64: int(h) for h in reversed(hashes.tolist())}
    for i in range(24):
        assert got[i] == own[min(own, key=lambda b: places[i, b])] if i not in own else got[i] == own[i]


def test_deduplicated_keeps_one_of_each(spark):
    docs = documents(spark, TEXTS + near_copies(12, 60, 1, 8))
    left = m.deduplicated(clashing(docs), k=5)
    classes = m.minhash_classes(docs, k=5)
    assert sorted(r["doc_id"] for r in left.where("doc_id is not null").collect()) == sorted({r["doc_id"] for r in classes.where("kept").collect()})
    assert left.where("doc_id is null").count() == 1
    assert left.columns == clashing(docs).columns


def test_empty_table(spark):
    assert rows(m.minhash_classes(documents(spark, []))) == []
    assert rows(m.minhash_classes(documents(spark, [(1, None, None, None), (2, "", None, None)]))) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert m.deduplicated(documents(spark, [])).count() == 0


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        m.minhash_classes(documents(spark, []), num=6, den=5)
    with pytest.raises(ValueError):
        m.minhash_classes(documents(spark, []), bands=0)


def test_buckets_of_one_group_meet_once(spark):
    """Members outside the largest class meet the others of a group once, not in each of its buckets; every
    pair of a bucket but those of one class still stands in some cell."""
    n_sets, n_buckets = 60, 20
    # Each bucket lacks a set; 100 and 101 are in a bucket of their own with the last member.
    buckets = [(t, 0, x, 100, 0, 7, n_sets, n_buckets, 2 if x == 1 else 1) for t in range(1, n_buckets + 1) for x in range(n_sets) if x != t] + [(500, 0, x, 100, 0, 7, 3, 1, 1 if x < 100 else 500) for x in (n_sets - 1, 100, 101)]
    many = spark.createDataFrame(buckets, "token long, hi long, node long, n int, pos int, band int, k long, held long, first long")
    label = {x: 0 if x < 50 else x for x in [*range(n_sets), 100, 101]}
    labels = spark.createDataFrame([(0, x, (False, c, 0)) for x, c in label.items()], f"hi long, node long, label {jaccard.NODE}")
    cells: dict[str, tuple[list, list]] = {}
    tasks = jaccard.block_tasks(many, labels, block=16).collect()
    for r in tasks:
        cells.setdefault(r["c"], ([], []))[r["side"]].append(r["node"])
    met = {frozenset((x, y)) for left, right in cells.values() for x in left for y in right if x != y}
    members: dict[int, list] = {}
    for r in buckets:
        members.setdefault(r[0], []).append(r[2])
    wanted = {frozenset((x, y)) for own in members.values() for x in own for y in own if label[x] != label[y]}
    assert wanted <= met
    # One left block, four right blocks: 10 members in four cells, 60 in one, and the small bucket.
    assert len(tasks) <= 10 * 4 + 60 + 10
