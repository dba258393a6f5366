import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import token_files as f
from tesserae.llm.common import shared_path, tokenizer_file
from tests.llm.helpers import TEXTS, clashing, documents, rows

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_file("byte_bpe_50k.json")


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=200))
@settings(max_examples=60, deadline=None)
def test_code_round_trip(values):
    control, data = f.pack(np.array(values, np.uint32))
    assert len(control) == (len(values) + 3) // 4
    assert f.unpack(control, data, len(values)).tolist() == values


SPEC = open(PATH, encoding="utf-8").read()
ODD = ["a  b", "a \tb", " lead", "trail ", "a\n\nb c\n", "don't you'll a.b,c", "1,234.5 a1 .", "x ab. a1. a). ab.) é! 日本. x² ..", "one", "a\nb's 's\n's", "\n", " ", "\na b", "a b\n", "x\u200by \u200bz", "a\u180eb", "end<|endoftext|>of it", "don''t' it's'. '' word'\nword''s", "a\r\nb c", "Ġ ĠĠ aĠ\nĠb", "\x00 a\x00\nb"]


def same_as_library(own, texts):
    for x, ids in zip(texts, own.encode(pa.array(texts, pa.string())), strict=True):
        assert ids.tolist() == own.tokenizer.encode(x or "", add_special_tokens=False).ids, x


def test_pieces_like_the_library():
    own = f.PieceEncoder(SPEC)
    for _ in range(2):  # the second time from what is kept
        same_as_library(own, [t or "" for _, t, _, _ in TEXTS] + ODD)
    same_as_library(own, ["a b", None])
    assert len(own.encode(pa.array([], pa.string()))) == 0


@given(st.lists(st.text(st.sampled_from(list("abA é'sṬ1.,!%-\n  \t\u00a0Ġ中")), max_size=30), max_size=6))
@settings(max_examples=300, deadline=None)
def test_any_text_like_the_library(texts):
    same_as_library(f.ready(SPEC), texts)


def test_other_rules_are_not_cut():
    """A tokenizer with rules of its own gets whole texts."""
    spec = json.loads(SPEC)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}):
        own = f.PieceEncoder(json.dumps(spec | change))
        assert not own.cuttable
        same_as_library(own, ODD)


def test_words_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(f, "KNOWN_WORDS", 5)
    own = f.PieceEncoder(SPEC)
    for k in range(6):
        same_as_library(own, [" ".join(f"w{chr(97 + k)}{chr(97 + i)} w{chr(97 + k)}{chr(97 + i)}" for i in range(8))])
        assert len(own.known) <= 5 + 8


def test_files_hold_everything(spark):
    t = tokenizers.Tokenizer.from_file(PATH)
    path = shared_path(spark, "test-tokens")
    f.write_token_files(clashing(documents(spark)), path, PATH)
    got = sorted(f.read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    assert len(got) == len(order)
    for r, (i, text, _, _) in zip(got, order, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_many_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(f, "BLOCK_IDS", 50)
    got = sorted(rows(f.round_trip(documents(spark), PATH)), key=lambda r: r[1])
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    assert rows(f.round_trip(documents(spark, []), PATH)) == []


def test_one_id_of_many_rows_is_several_parts(spark, tmp_path):
    texts = [(None if i % 2 else 7, f"text {i} of many", "en", "a") for i in range(2000)]
    path = f"{tmp_path}/tokens"
    f.write_token_files(documents(spark, texts), path, PATH)
    parts = {r["part"]: r["n"] for r in spark.read.parquet(f"{path}/blocks").groupBy("part").agg({"n_docs": "sum"}).withColumnRenamed("sum(n_docs)", "n").collect()}
    assert sum(parts.values()) == 2000 and max(parts.values()) < 1000
    got = sorted(f.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 1000 + [7] * 1000
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
