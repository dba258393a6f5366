import random
from collections import defaultdict

import numpy as np
import pytest

from tesserae.llm import jaccard as j
from tests.llm.helpers import TEXTS, clashing, documents, rows


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({b" ".join(w)} if w else set())


def by_hand(data, k, num, den):
    sets = [shingles(t, k) for _, t, _, _ in data]
    up = list(range(len(data)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for x, (i, _, _, _) in enumerate(data):
        least[root(x)].append(i)
    name = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return sorted(((i, len(sets[x]), name[root(x)] if sets[x] else i) for x, (i, _, _, _) in enumerate(data)), key=repr)


def near_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append((1000 * seed + i, " ".join(w), "en", "a"))
    return out


@pytest.mark.parametrize("k, num, den", [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_classes_by_hand(spark, k, num, den):
    data = TEXTS + near_copies(30, 60, 6, 1) + near_copies(20, 25, 3, 2)
    got = rows(j.jaccard_classes(clashing(documents(spark, data)), k, num, den))
    assert got == by_hand(data, k, num, den)


def test_hot_tokens_and_blocks(spark):
    """Lists longer than ``hot`` are compared in blocks; the classes stay the same."""
    data = near_copies(60, 80, 7, 3) + near_copies(40, 40, 4, 4)
    want = by_hand(data, 3, 9, 10)
    assert rows(j.jaccard_classes(documents(spark, data), hot=2, cell=3, block=7)) == want
    assert rows(j.jaccard_classes(documents(spark, data), hot=1000)) == want


def nested(groups, seed):
    """Groups of sets of 100 to 105 words, the smaller inside the larger.  By hash a few words are
    in the first thirty-second of the counters, all others in the upper half."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        words: list[str] = []
        while len(words) < 105:
            w = f"n{rng.randrange(10**9)}"
            at = int(j.shingle_sets([w], 1)[0][0]) >> 44
            if at < 1 << 15 or at >= 1 << 19:
                words.append(w)
        out += [(10 * g + i, " ".join(words[: 100 + i]), "en", "a") for i in (0, 3, 5)]
    return out


def test_hot_tokens_on_both_sides_of_the_middle_rank(spark, monkeypatch):
    """Any order of tokens gives the same links; this one has tokens in both halves of the ranks."""
    monkeypatch.setattr(j, "frequencies", lambda rows: np.arange(1 << j.FREQUENCY_BITS, dtype=np.uint32))
    data = nested(40, 7)
    prefixes = j.prefix_rows(documents(spark, data), 1, 9, 10, j.frequencies(None), "text").toPandas()
    for _, one in prefixes.sort_values("pos").groupby("node"):
        assert one["token"].is_monotonic_increasing
    assert rows(j.jaccard_classes(documents(spark, data), 1, 9, 10, hot=1)) == by_hand(data, 1, 9, 10)


def cell_rows(spark, monkeypatch, data):
    """Rows of all cells of a join, and its result."""
    seen = []
    old = j.sifted
    monkeypatch.setattr(j, "sifted", lambda tasks, *a: seen.append(tasks.count()) or old(tasks, *a))
    got = rows(j.jaccard_classes(documents(spark, data), hot=8, cell=16, block=32))
    monkeypatch.undo()
    return sum(seen), got


def test_cells_grow_with_the_rows(spark, monkeypatch):
    """Twice the near copies, about twice the rows."""
    data = near_copies(800, 120, 2, 11)
    small, _ = cell_rows(spark, monkeypatch, data[:400])
    large, got = cell_rows(spark, monkeypatch, data)
    assert large < 2.6 * small
    assert len({c for _, _, c in got}) < 5


@pytest.mark.parametrize("crowd", [1, 20])
def test_crowded_tokens_are_counted_in_shares(spark, monkeypatch, crowd):
    """Tokens dealt by a salt give the same classes; copies of one text do not crowd a set."""
    monkeypatch.setattr(j, "CROWD", crowd)
    data = near_copies(60, 80, 7, 3) + near_copies(40, 40, 4, 4) + TEXTS + [(5000 + i, "a text that many rows hold " * 4, "en", "a") for i in range(50)]
    assert rows(j.jaccard_classes(documents(spark, data), hot=2, cell=3, block=7)) == by_hand(data, 3, 9, 10)


def test_groups_that_share_hot_tokens(spark):
    """Sets of many sizes and several classes under one token: those outside the largest class
    still meet all others."""
    rng = random.Random(3)
    shared = [f"s{rng.randrange(10**6)}" for _ in range(60)]
    data = []
    for g in range(12):
        own = [f"g{g}x{rng.randrange(10**6)}" for _ in range(3 * g)]
        for i in range(6):
            data.append((100 * g + i, " ".join(shared + own[: 3 * g - i % 2] + [f"t{i}"] * (i % 3)), "en", "a"))
    for num, den in ((9, 10), (4, 5)):
        assert rows(j.jaccard_classes(documents(spark, data), 2, num, den, hot=2, cell=3, block=4)) == by_hand(data, 2, num, den)


def test_an_id_at_the_upper_end(spark):
    top = 2**63 - 1
    data = [(top, "one text of some words", "en", "a"), (None, "one text of some words", "en", "a"), (None, "and another one", "en", "a")]
    assert rows(j.jaccard_classes(documents(spark, data))) == by_hand(data, 3, 9, 10)


def test_empty(spark):
    assert rows(j.jaccard_classes(documents(spark, []))) == []


def test_one_of_each(spark):
    data = TEXTS + near_copies(25, 60, 2, 5)
    classes = by_hand(data, 5, 4, 5)
    kept = j.one_of_each(clashing(documents(spark, data)))
    ids = [r["doc_id"] for r in kept.collect()]
    want = {c for _, n, c in classes if n} | {i for i, n, _ in classes if not n}
    assert len(ids) == len(set(ids)) and set(ids) == want
    assert kept.columns == clashing(documents(spark)).columns


def odd_ids():
    """Different texts without an id, near copies of other documents, and texts of one id."""
    near = near_copies(6, 60, 1, 8) + near_copies(6, 60, 1, 9)
    a, b, own, c, d = near[0][1], near[6][1], "a text of its own without any id", "first text under one id", "another that shares its number"
    unnamed = [(None, t, "en", "a") for t in (a + " x", b + " y", own, own + " but longer by many words than that", "", None, "", " ")]
    return near + unnamed + [(77, c, "en", "a"), (77, d, "en", "a"), (77, d, "en", "a"), (78, d + " z", "en", "a"), (79, "", "en", "a"), (79, "", "en", "b")]


@pytest.mark.parametrize("hot", [1, 32])
def test_texts_without_an_id_or_of_one_id_stay_apart(spark, hot):
    data = odd_ids()
    assert rows(j.jaccard_classes(documents(spark, data), 3, 4, 5, hot=hot)) == by_hand(data, 3, 4, 5)
    kept = rows(j.one_of_each(documents(spark, data), 3, 4, 5, hot=hot))
    texts = [t for i, t, *_ in kept if i is None]
    assert sorted(map(repr, texts)) == sorted(map(repr, [t for i, t, _, _ in data if i is None][2:]))
    assert sorted((i, t) for i, t, *_ in kept if i is not None) == sorted([(8000, data[0][1]), (9000, data[6][1]), (77, data[-6][1]), (77, data[-5][1]), (78, data[-3][1]), (79, "")])


def test_filters_lose_nothing():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(5, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 8))).astype(np.uint64)]))
        sizes = np.array([len(a), len(b)])
        true = len(np.intersect1d(a, b)) >= j.needed_overlap(len(a), len(b), 9, 10)
        ok = np.array([[min(sizes) >= j.needed_overlap(len(a), len(b), 9, 10)]])
        kept = j.suffix_filter(ok, np.array([0]), np.array([1]), sizes, [j.parity_bitmap(a), j.parity_bitmap(b)], 9, 10)
        assert kept[0, 0] or not true
        assert j.overlap(j.unsqueezed(j.squeezed(a)), j.unsqueezed(j.squeezed(b))) == len(np.intersect1d(a, b))
        assert j.block_overlaps([a], [b])[0, 0] == len(np.intersect1d(a, b))


def test_suffix_filter_passes_pairs_of_very_different_sizes():
    a = np.sort(np.random.default_rng(1).integers(0, 2**63, 130).astype(np.uint64))
    sizes = np.array([60, 130])
    kept = j.suffix_filter(np.array([[True]]), np.array([0]), np.array([1]), sizes, [j.parity_bitmap(a[:60]), j.parity_bitmap(a)], 2, 5)
    assert kept[0, 0] and 5 * 60 >= 2 * 130


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (50, 49)]
    got = dict(rows(j.components(spark.createDataFrame(edges, "a long, b long"))))
    assert all(got[i] == 0 for i in range(1, 41)) and got[102] == 100 and got[50] == 49 and 0 not in got
