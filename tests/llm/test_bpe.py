import hashlib
import random

import pyarrow as pa
import pytest

from tesserae.llm import bpe_automaton as b
from tesserae.llm.common import tokenizer_file
from tests.llm.helpers import TEXTS, clashing, documents, rows

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return b.WordBpe(open(PATH, encoding="utf-8").read())


def test_random_words_like_the_library(library, own):
    rng = random.Random(1)
    for letters in ("etaoinshrdlu", "aabn<w/é", "xyz '!?.,0123"):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 16))) for _ in range(3000)]
        for w, e in zip(words, library.encode_batch(words, add_special_tokens=False), strict=True):
            assert own.encode(w) == e.ids, w


def test_odd_texts(library, own):
    texts = [t or "" for _, t, _, _ in TEXTS] + ["<|endoftext|>a<|startoftext|> b <|endoftext|", "ΑΣ ΑΣΑ İstanbul K é", "x²y ½ 😀😀", "aaaa" * 40, "\x85a\x1cb"]
    for (n, ids, back), e in zip(own.digests(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == " ".join(map(str, e.ids)) and n == len(e.ids)
        assert back == library.decode(e.ids, skip_special_tokens=False)


def test_automaton_by_hand():
    vocab = {"a": 0, "b": 1, "ab": 2, "aab": 3, "aa": 4}
    m = b.Automaton(vocab, [("a", "b"), ("a", "ab"), ("a", "a")])
    assert m.encode_word("aab") == [3] and m.encode_word("aaab") == [0, 3] and m.encode_word("aaaa") == [4, 4] and m.encode_word("aaa") == [4, 0]


def test_query(spark, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _, _ in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert rows(b.encode_digests(clashing(documents(spark)), PATH)) == sorted(want, key=repr)
    assert rows(b.encode_digests(documents(spark, []), PATH)) == []


def test_ids_keep_columns(spark, own):
    out = b.encode_ids(clashing(documents(spark)), PATH).select("doc_id", "text", "score", "ids").collect()
    assert all(r["ids"] == own.encode(r["text"]) and r["score"] == "x" for r in out)


def test_steps_are_small():
    """What a worker holds grows with the text of a step: five megabytes and five more are two steps."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a" * 5_000_000] * 3)], ["doc_id", "text"])
    assert [x.num_rows for x in b.parts_of(iter([batch]), 1)] == [1, 1, 1]


def test_a_task_leaves_little_behind(own, monkeypatch):
    """Workers live on between tasks and several of one executor may be idle: what they keep is bounded,
    and what was met first, the frequent pieces, is what stays."""
    monkeypatch.setattr(b, "STAYING", 5)
    words = [f"word{i}" for i in range(50)]
    text = " ".join(words * 2)
    before = list(own.digests([text]))
    assert len(own.known_pieces) >= 50
    own.settle()
    assert len(own.known_pieces) == 5 and len(own.automaton.arcs) <= 5
    assert list(own.digests([text])) == before


def test_steps_back_from_long_tokens():
    """The longest token at a place need not be the one BPE takes: the walk goes back and takes another way."""
    vocab = {x: i for i, x in enumerate(["a", "b", "c", "d", "bc", "ab", "cd", "bcd", "abc"])}
    m = b.Automaton(vocab, [("b", "c"), ("a", "b"), ("c", "d"), ("bc", "d"), ("a", "bc")])
    assert m.encode_word("abcd") == [vocab["a"], vocab["bcd"]]
    assert m.encode_word("abcabcd") == [vocab["abc"], vocab["a"], vocab["bcd"]]
    assert m.encode_word("abd") == [vocab["ab"], vocab["d"]]
    with pytest.raises(ValueError, match="no token sequence"):
        m.encode_word("ab?")
