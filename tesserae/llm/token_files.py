"""Token-id files: frequency-ranked ids in a byte-aligned code with separate control bytes.

Ids are replaced by their rank in the corpus (0 for the most frequent), so that most take one
byte.  A rank takes one to four bytes, little-endian; the lengths of four ranks stand in one
control byte, two bits each, lowest first.  A block keeps control bytes and data bytes apart,
and both directions are table look-ups in numpy: the control byte gives the length of its group
and the place of each of the 16 output bytes.

File format.  A folder of Parquet files is the container, so that files come and go through
Spark's committer and in any store that Spark reads:

* ``blocks``: part int, seq int, n_docs long, n_ids long, block binary.  Parts are ranges of
  ascending doc_id; blocks of a part are in the order of seq.
* ``ranks``: rank int, id int.

A block is ``b"TSB1"``, uint32 flags (bit 0: a doc_id is null), uint64 number of documents,
uint64 number of ids, the doc_ids (int64), their null flags (bytes, only with bit 0), their
lengths (uint32), the control bytes (a quarter of the number of ids, rounded up; missing ranks
of the last group count as 0), the data bytes.

Steps: encode every text once (a map) and keep the ids as compressed binaries in the shared
folder, with each task's counts of ids in a row beside them; add these counts; range-partition by
doc_id and a hash of the ids, sort, and pack into blocks.  Reading is a map over blocks; a document's start is its
place in its block plus the sums of the blocks and parts before.

Defined results: a null or empty text is the end id alone; null doc_ids come first; rows with
the same doc_id stand next to each other in the order of a hash of their ids; a text of any length lies in
one block; an empty table gives empty files and an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import drop_path, shared_path, shuffle_parts, tidied

MAGIC = b"TSB1"
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 20
#: The label of a space in byte-level vocabularies.
SPACE_LABEL = "\u0120"
#: ASCII punctuation that may stand behind a word, and words of letters up to U+024F (behind a line
#: feed or not).
TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
WORD = "^\\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"
#: Texts that are not cut: a space or line feed at an end or next to another, other white space, and
#: characters of no width, which some patterns take for white space.
UNCUT = "^[ \\n]|[ \\n]\\z|[ \\n][ \\n]|[\\t\\x0b-\\r\\x1c-\\x1f" + "".join(map(chr, (0x85, 0xA0, 0x1680, 0x180E, 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))) + "\u2000-\u200d]"
#: Words a worker keeps before it starts anew.
KNOWN_WORDS = 400_000

# For each control byte: the length of its four ranks, and for each of 16 output bytes the place
# of its data byte (0 and a zero mask where there is none).
_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
LENGTH = (_CODES + 1).sum(axis=1).astype(np.int64)
_FROM = np.cumsum(_CODES + 1, axis=1) - (_CODES + 1)
_BYTE = np.arange(4)
GATHER = np.where(_BYTE <= _CODES[:, :, None], _FROM[:, :, None] + _BYTE, 0).reshape(256, 16).astype(np.int32)
MASK = (_BYTE <= _CODES[:, :, None]).reshape(256, 16).astype(np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of an array of ranks."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    groups = np.zeros((-len(ranks) % 4 + len(ranks)) // 4 * 4, np.uint8)
    groups[: len(ranks)] = size
    control = (groups.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    width = size.astype(np.int32) + 1
    at = np.cumsum(width) - width
    data = np.empty(int(width.sum()), np.uint8)
    data[at] = ranks.astype(np.uint8)  # the lowest byte
    for byte in range(1, int(size.max(initial=0)) + 1):
        wide = np.flatnonzero(size >= byte)
        data[at[wide] + byte] = (ranks[wide] >> np.uint32(8 * byte)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again, by table look-up."""
    groups = np.frombuffer(control, np.uint8)
    source = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(16, np.uint8)])
    out = np.empty((len(groups), 16), np.uint8)
    done = 0
    for start in range(0, len(groups), 1 << 14):  # a stretch that stays in the cache
        some = groups[start : start + (1 << 14)]
        length = LENGTH[some]
        ends = np.cumsum(length)
        at = np.take(GATHER, some, axis=0)
        at += (ends - length).astype(np.int32)[:, None]
        part = out[start : start + len(some)]
        np.take(source[done : done + int(ends[-1]) + 16], at, out=part, mode="clip")
        part *= np.take(MASK, some, axis=0)
        done += int(ends[-1])
    return out.view("<u4").reshape(-1)[:n]


def make_block(doc_ids: list[int | None], ids: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    nulls = any(d is None for d in doc_ids)
    every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    control, data = pack(rank_of[every])
    head = [MAGIC, np.uint32(nulls).tobytes(), np.uint64(len(doc_ids)).tobytes(), np.uint64(len(every)).tobytes()]
    head.append(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    if nulls:
        head.append(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    return b"".join([*head, np.array([len(x) for x in ids], "<u4").tobytes(), control, data])


def read_block(block: bytes, id_of: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and all ids of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    nulls = int.from_bytes(block[4:8], "little") & 1
    n, total = int.from_bytes(block[8:16], "little"), int.from_bytes(block[16:24], "little")
    at = 24
    docs: list[int | None] = np.frombuffer(block, "<i8", n, at).tolist()
    at += 8 * n
    if nulls:
        docs = [None if gone else d for d, gone in zip(docs, np.frombuffer(block, np.uint8, n, at), strict=True)]
        at += n
    lengths = np.frombuffer(block, "<u4", n, at).astype(np.int64)
    at += 4 * n
    groups = (total + 3) // 4
    return docs, lengths, id_of[unpack(block[at : at + groups], block[at + groups :], total)]


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pick: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """The stretches ``pick`` of an array, one after another; done in steps that stay in the cache."""
    out = np.empty(int(lengths[pick].sum()), flat.dtype)
    done = 0
    for at in range(0, len(pick), step):
        some = pick[at : at + step]
        n = lengths[some]
        ends = np.cumsum(n)
        total = int(ends[-1])
        np.take(flat, np.repeat(starts[some] - (ends - n), n) + np.arange(total), out=out[done : done + total])
        done += total
    return out


class PieceEncoder:
    """A byte-level tokenizer of the tokenizers library, asked once for each distinct piece of a
    batch and not again for pieces that earlier batches held more than once.

    A text is cut before each space and line feed, where all of these stand alone between other
    characters than white space.  The tokenizer's own pattern cuts there too, so its ids of the
    pieces are its ids of the text; a word with ASCII punctuation behind it is cut once more.  A
    line feed is put before the text and its id dropped, so that the first piece is like others.
    Distinct pieces are asked for many at a time, joined by spaces; each starts where an id's
    label starts with a space.

    Texts that hold a special token or other white space are asked for as they are; so is every
    text if the tokenizer's file states other rules than these (a normaliser, a pre-tokenizer
    that is not the byte-level one, a space put before texts)."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(SPACE_LABEL) for i in range(size)])
        rules = json.loads(spec)
        split, model = rules.get("pre_tokenizer") or {}, rules.get("model") or {}
        self.cuttable = rules.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True) and model.get("type") == "BPE" and not model.get("dropout") and not any(c in s for s in self.special for c in " \n")
        self.known: dict[str, bytes] = {}

    def raw(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Which texts may be cut."""
        if not self.cuttable:
            return np.zeros(len(texts), bool)
        out = pc.not_equal(texts, "")
        for bad in (pc.match_substring_regex(texts, UNCUT), *(pc.match_substring(texts, s) for s in self.special)):
            out = pc.and_not(out, bad)
        return out.to_numpy(zero_copy_only=False)

    def asked(self, words: list[str], at_once: int = 4_000) -> list[bytes]:
        """The ids of pieces, each as it stands behind a space (or a line feed of its own)."""
        out: list[bytes] = []
        for at in range(0, len(words), at_once):
            some = words[at : at + at_once]
            got = self.raw(" " + " ".join(some))
            starts = np.flatnonzero(self.opens[got])
            if len(starts) != len(some):  # a label that cannot be told apart
                out += [self.raw(" " + w)[w[0] == "\n" :].tobytes() for w in some]
                continue
            ids, width = got.tobytes(), self.kind.itemsize
            ends = [*(starts[1:] * width).tolist(), len(ids)]
            # The space before a line feed was put there by the join.
            out += [ids[a + width * (w[0] == "\n") : b] for w, a, b in zip(some, (starts * width).tolist(), ends, strict=True)]
        return out

    def of_words(self, words: list[str], often: np.ndarray) -> list[bytes]:
        """The ids of distinct words; those that stand ``often`` are kept for later batches."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        out = [known.get(w) for w in words]
        new = [i for i, v in enumerate(out) if v is None]
        for i, v, keep in zip(new, self.asked([words[i] for i in new]), often[new].tolist(), strict=True):
            out[i] = v
            if keep:
                known[words[i]] = v
        return out

    def coded(self, pieces: pa.Array, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces one after another, and how many each has.  A word with
        punctuation behind it is the word and the punctuation."""
        bare = pc.utf8_rtrim(pieces, TAIL)
        cut = pc.and_(pc.match_substring_regex(bare, WORD), pc.not_equal(bare, pieces))
        words = pc.if_else(cut, bare, pieces).dictionary_encode()
        at = words.indices.to_numpy()
        first = self.of_words(words.dictionary.to_pylist(), np.bincount(at, times, len(words.dictionary)) > 1)
        tails = pc.replace_substring_regex(pieces.filter(cut), WORD[:-1], "").dictionary_encode()
        behind = [self.raw(t).tobytes() for t in tails.dictionary.to_pylist()]
        each = [*first, b"", *behind]
        lengths = np.fromiter(map(len, each), np.int64, len(each)) // self.kind.itemsize
        pick = np.empty((len(pieces), 2), np.int64)
        pick[:, 0], pick[:, 1] = at, len(first)
        pick[cut.to_numpy(zero_copy_only=False), 1] = tails.indices.to_numpy() + len(first) + 1
        flat = gathered(np.frombuffer(b"".join(each), self.kind), np.cumsum(lengths) - lengths, lengths, pick.reshape(-1))
        return flat, lengths[pick].sum(axis=1)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        plain = self.plain(texts)
        out: list[np.ndarray] = [np.zeros(0, self.kind)] * len(texts)
        for i in np.flatnonzero(~plain).tolist():
            out[i] = self.raw(texts[i].as_py())
        if not plain.any():
            return out
        marked = pc.replace_substring(texts.filter(pa.array(plain)), "\n", " \n")
        line = pa.scalar("\n", pa.large_string())
        split = pc.split_pattern(pc.binary_join_element_wise(line, marked, pa.scalar("", pa.large_string())), " ")
        distinct = split.flatten().dictionary_encode()
        code = distinct.indices.to_numpy()
        flat, lengths = self.coded(distinct.dictionary, np.bincount(code, minlength=len(distinct.dictionary)))
        ids = gathered(flat, np.cumsum(lengths) - lengths, lengths, code)
        ends = np.concatenate([[0], np.cumsum(lengths[code])])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        for i, a, b in zip(np.flatnonzero(plain).tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[i] = ids[a + 1 : b]
        return out


_READY: dict[int, PieceEncoder] = {}


def ready(spec: str) -> PieceEncoder:
    key = zlib.crc32(spec.encode())
    if key not in _READY:
        _READY.clear()
        _READY[key] = PieceEncoder(spec)
    return _READY[key]


def chunks(batch: pa.RecordBatch, chars: int = 32_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of so many characters (one text at least)."""
    at = 0
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    while at < batch.num_rows:
        to, total = at, 0
        while to < batch.num_rows and (to == at or total + sizes[to] <= chars):
            total += sizes[to]
            to += 1
        yield batch.slice(at, to - at)
        at = to


ENCODED = "doc_id long, n long, ids binary, counts binary"


def encoded(docs: DataFrame, spec: str, end_id: int, vocabulary: int, key: str, text: str) -> DataFrame:
    """The compressed ids of each row, end id included; and from each task a row of how often it
    has seen each id (``counts``, of which the other rows have none)."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    names = [c.split()[0] for c in ENCODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = ready(shared.value)
        end = np.array([end_id], t.kind).tobytes()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        counts, rows = np.zeros(vocabulary, np.int64), 0
        for batch in batches:
            for part in chunks(batch):
                ids = t.encode(part.column(1))
                counts += np.bincount(np.concatenate(ids), minlength=vocabulary)
                rows += len(ids)
                n = [len(x) + 1 for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array([squeeze(x.tobytes() + end) for x in ids], pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        counts[end_id] += rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([squeeze(counts.tobytes())], pa.binary())], names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidied(run), ENCODED)


def id_counts(rows: DataFrame, vocabulary: int, tasks: int = 16) -> np.ndarray:
    """How often each id occurs: ``tasks`` tasks add up the rows of all others, and their sums
    come to the driver, a number for each id of the vocabulary."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for v in batch.column(0):
                counts += np.frombuffer(open_(v.as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])

    sums = rows.where("counts is not null").select("counts").repartition(tasks).mapInArrow(tidied(add), "counts binary")
    return sum((np.frombuffer(r["counts"], np.int64) for r in sums.toLocalIterator()), np.zeros(vocabulary, np.int64))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write the folder ``path`` (``blocks`` and ``ranks``)."""
    spark = docs.sparkSession
    spec = open(tokenizer_path, encoding="utf-8").read()
    kind = ready(spec).kind
    vocabulary = max(ready(spec).tokenizer.get_vocab_size(), end_id + 1)
    kept = shared_path(spark, "ids")
    encoded(docs, spec, end_id, vocabulary, key, text).write.option("compression", "uncompressed").parquet(kept)
    rows = spark.read.schema(ENCODED).parquet(kept)
    counts = id_counts(rows, vocabulary)
    id_of = np.argsort(-counts, kind="stable").astype(np.int32)
    rank_of = np.empty(vocabulary, np.uint32)
    rank_of[id_of] = np.arange(vocabulary, dtype=np.uint32)
    ranks = spark.createDataFrame(pa.table({"rank": pa.array(range(vocabulary), pa.int32()), "id": pa.array(id_of)}))
    ranks.coalesce(1).write.parquet(f"{path}/ranks")

    shared = spark.sparkContext.broadcast(rank_of)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, docs_, ids = TaskContext.get().partitionId(), 0, 0, [], []
        open_ = zstandard.ZstdDecompressor().decompress

        def close() -> pa.RecordBatch:
            block = make_block(docs_, ids, shared.value)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs_)], pa.int64()), pa.array([held], pa.int64()), pa.array([block], pa.binary())], ["part", "seq", "n_docs", "n_ids", "block"])

        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1), strict=True):
                x = np.frombuffer(open_(value.as_py()), kind)
                if docs_ and held + len(x) > BLOCK_IDS:
                    yield close()
                    seq, held, docs_, ids = seq + 1, 0, [], []
                docs_.append(doc.as_py())
                ids.append(x)
                held += len(x)
        if docs_:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]  # an id of very many rows is several ranges
    dealt = rows.where("counts is null").select("doc_id", "ids").repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order, "ids")
    dealt.mapInArrow(tidied(blocks), "part int, seq int, n_docs long, n_ids long, block binary").write.option("compression", "zstd").parquet(f"{path}/blocks")
    drop_path(spark, kept)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    blocks = spark.read.schema("part int, seq int, n_docs long, n_ids long, block binary").parquet(f"{path}/blocks")
    table = spark.read.parquet(f"{path}/ranks").toPandas()  # a row for each token of the vocabulary
    id_of = np.empty(len(table), np.uint32)
    id_of[table["rank"].to_numpy()] = table["id"].to_numpy()
    shared = spark.sparkContext.broadcast(id_of)
    schema = T.StructType.fromDDL("part int, seq int, doc_id long, here long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs, lengths, ids = read_block(batch.column(2)[k].as_py(), shared.value)
                starts = np.cumsum(lengths) - lengths
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                n = len(docs)
                out = [pa.array(np.full(n, batch.column(0)[k].as_py(), np.int32)), pa.array(np.full(n, batch.column(1)[k].as_py(), np.int32)), pa.array(docs, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.array([ids[s : s + n].astype(np.int64) for s, n in zip(starts, lengths, strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, schema.names)

    docs = blocks.select("part", "seq", "block").mapInArrow(tidied(run), schema)
    # Parts are as many as the writing job had tasks; blocks are numbered inside their part.
    sizes = blocks.select("part", "seq", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("block_start")).join(parts, "part")
    out = docs.join(starts, ["part", "seq"])
    return out.select("doc_id", (F.col("part_start") + F.col("block_start") + F.col("here")).cast("long").alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_token_files(docs, path, tokenizer_path, end_id)
    return read_token_files(spark, path)
