import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import threshold_search as t
from tests.llm.helpers import TEXTS, clashing, documents, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return WORD.findall((text or "").translate(UPPER))


def by_hand(data, items, k):
    docs = [(i, Counter(terms(x))) for i, x, *_ in data if terms(x)]
    df = Counter(w for _, c in docs for w in c)
    n_docs, n_terms = len(docs), sum(c.total() for _, c in docs)
    out = []
    for item, text in sorted(set(items), key=repr):
        found = []
        for i, c in docs:
            m = 50 + 50 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def queries(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def invented(n, seed):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(200)]
    return [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(200)], k=rng.randint(1, 80))), "en", "a") for i in range(n)]


ITEMS = [(1, "the word3 is7 WORD3"), (2, "Grüße, 日本語 license"), (3, ""), (4, None), (5, "nothing-like-this"), (6, "t1 t2 t3 t4 t150 t199"), (7, "t5"), (1, "changed"), (6, "t1 t2 t3 t4 t150 t199"), (None, "one two")]


@pytest.mark.parametrize("k, chunk", [(50, 1 << 20), (3, 40), (1, 1)])
def test_ranks_by_hand(spark, k, chunk, monkeypatch):
    monkeypatch.setattr(t, "FIRST_ROUND", 2)
    data = TEXTS + invented(300, 1) + [(i + 7, x, g, s) for i, x, g, s in invented(40, 1)]
    got = t.ranked_documents(clashing(documents(spark, data)).repartition(3), queries(spark, ITEMS), k=k, chunk_rows=chunk)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == by_hand(data, [(i, x) for i, x in ITEMS if x is not None], k)


def test_blocks_of_queries(spark):
    data, items = invented(120, 2), [(i, f"t{i} t{2 * i} t{i + 90}") for i in range(40)]
    whole = rows(t.ranked_documents(documents(spark, data), queries(spark, items), k=5))
    assert rows(t.ranked_documents(documents(spark, data), queries(spark, items), k=5, block_bytes=100)) == whole == by_hand(data, items, 5)


def test_lists_are_read_until_the_threshold_falls(spark):
    """One document holds a whole query: the lists of its rare words end the search early."""
    rng = np.random.default_rng(5)
    n, words = 4000, 30
    terms_, doc = [], []
    for d in range(n):
        held = np.sort(rng.choice(words, 6, replace=False))
        terms_.append(np.arange(words) if d == 777 else held)
        doc.append(len(terms_[-1]))
    flat = np.concatenate(terms_)
    ends = np.concatenate([[0], np.cumsum(doc)])
    impact = rng.integers(1, 1000, len(flat))
    impact[ends[777] : ends[778]] = 900
    chunk = t.Chunk(list(range(n)), ends, flat, impact, words)
    wanted = np.ones(words, bool)
    best, read = chunk.search(np.arange(words), wanted, [], 1)
    assert best == [(900 * words, 777)]
    assert read < len(flat) / 2
    every = sorted(((int(impact[ends[d] : ends[d + 1]].sum()), d) for d in range(n)), key=lambda x: (-x[0], x[1]))
    assert chunk.search(np.arange(words), wanted, [], 40)[0] == every[:40]


def test_ties_at_the_last_rank(spark):
    """Documents of equal score: the smallest ids, whatever order the lists have."""
    data = [(900 - i, "same words here", "en", "a") for i in range(200)] + [(None, "same words here", "en", "a"), (5000, "other text", "en", "a")]
    got = rows(t.ranked_documents(documents(spark, data).repartition(5), queries(spark, [(1, "same here")]), k=7, chunk_rows=30))
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(701, 708))


def test_empty_tables(spark):
    none = queries(spark, [])
    assert rows(t.ranked_documents(documents(spark), none)) == []
    assert rows(t.ranked_documents(documents(spark, []), queries(spark, ITEMS))) == []
    assert rows(t.ranked_documents(documents(spark, [(1, None, None, None), (2, "--", None, None)]), queries(spark, ITEMS))) == []
    with pytest.raises(ValueError):
        t.ranked_documents(documents(spark), none, k=0)
