"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that byte-pair encoding
yields.  It starts with one state that loops on every base symbol.  The merge ``u v -> uv``, in
order of priority, adds one gadget: the state that ``u`` leads to is copied without its ``v``
arc, ``u`` is redirected to the copy, and wherever ``u`` could be read, ``uv`` can now be read
too, leading to where ``u v`` led before.  All arcs of one token lead to one state, so the
automaton is kept as differences: a token's state is the state of its right half at the moment
of the merge, less the arcs that its own gadgets took away since.  An arc ``uv`` exists in a
state if the arc ``u`` did when the merge came; thus arcs are resolved through the chain of left
halves, and resolved arcs are kept in a transition table.

A correct sequence without its last token is the correct sequence of a shorter prefix.  So a
prefix is reached by one path of arcs at most, and a place from which the end was not reached is
never looked at again: a word is walked from left to right, longest arc first, with steps back.
Decoding emits the labels of the arcs.

Words come from the tokenizer's own rules: special tokens are cut out first, then canonical
composition, lower case, and the pre-split pattern.  Texts are cut at spaces and line feeds,
which never stand inside a word; each distinct piece of a few megabytes is encoded once, and pieces
that stand there more than once are kept, up to a bound, for the texts that follow.  Of these and of
the transition table a worker keeps a small part between tasks, as idle workers count too.

Defined results: a null or empty text has no tokens, and decodes to the empty text; equal texts
have equal results; very long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import tidied

#: Resolved arcs and pieces a worker keeps before it goes back to the first it met, which are the
#: frequent ones, and how many of these stay between tasks.
KNOWN_ARCS, KNOWN_PIECES, STAYING = 150_000, 100_000, 40_000
#: Letters by which the length of tokens is bounded.
LETTERS = 4
#: Bytes of text whose pieces are encoded together.
STEP_BYTES = 5_000_000


def first_met(known: dict, n: int) -> None:
    """Leave the ``n`` oldest entries in a dictionary."""
    for key in list(known)[n:]:
        del known[key]


def byte_symbols() -> list[str]:
    """The printable character of each byte: printable Latin-1 stands for itself, the other
    bytes get the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [""] * 256
    for b in own:
        out[b] = chr(b)
    more = 256
    for b in range(256):
        if not out[b]:
            out[b] = chr(more)
            more += 1
    return out


class Automaton:
    """States and arcs over the tokens of one merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.vocab = vocab
        self.suffix = suffix
        n = max(vocab.values(), default=-1) + 1
        self.labels = [""] * n
        for label, i in vocab.items():
            self.labels[i] = label
        self.left = [-1] * n
        self.right = [-1] * n
        self.born = [-1] * n  # the number of the merge that made the token; -1: a base symbol
        self.cut: list[dict[int, int]] = [{} for _ in range(n)]  # arcs that a token's own gadgets took away, and when
        self.arcs: dict[int, bool] = {}  # resolved transitions
        self.n = n
        for when, (a, b) in enumerate(merges):
            whole = a + (b if not suffix or not a.endswith(suffix) else "")
            u, v, uv = vocab.get(a), vocab.get(b), vocab.get(whole)
            if u is None or v is None or uv is None:
                raise ValueError(f"merge {a!r} {b!r} is not in the vocabulary")
            if self.born[uv] >= 0 or not self._arc(u, v):
                continue  # a second way to a known token, or one that no text can take
            self.left[uv], self.right[uv], self.born[uv] = u, v, when
            self.cut[u][v] = when
        self.arcs.clear()
        self.longest: dict[str, int] = {}  # the length of the longest token, by its first letters
        for label in vocab:
            bare = label.removesuffix(suffix) if suffix else label
            if len(bare) >= LETTERS:
                self.longest[bare[:LETTERS]] = max(len(bare), self.longest.get(bare[:LETTERS], 0))

    def _cut_at(self, state_of: int, token: int) -> int | None:
        """When the state after a token lost its arc for another token; None: it never did."""
        before = 1 << 60
        u = state_of
        while u >= 0:
            when = self.cut[u].get(token)
            if when is not None and when < before:
                return when
            if self.born[u] >= 0:
                before = min(before, self.born[u])
            u = self.right[u]
        return None

    def _arc(self, state_of: int, token: int) -> bool:
        limit = 1 << 60
        while token >= 0:
            lost = self._cut_at(state_of, token)
            if lost is not None and lost <= limit:
                return False
            limit = self.born[token]
            token = self.left[token]
        return True

    def has_arc(self, state_of: int, token: int) -> bool:
        """Whether ``token`` may follow the token ``state_of``."""
        key = state_of * self.n + token
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) > KNOWN_ARCS:
                first_met(self.arcs, STAYING)
            known = self.arcs[key] = self._arc(state_of, token)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one pre-split word, given in byte symbols."""
        n = len(word)
        if not n:
            return []
        vocab, suffix, has_arc = self.vocab, self.suffix, self.has_arc
        whole = vocab.get(word + suffix)
        if whole is not None and (self.born[whole] >= 0 or n == 1):
            return [whole]
        longest, get, arcs, size = self.longest, vocab.get, self.arcs, self.n
        out: list[int] = []  # the tokens up to ``start``, and where each begins
        begins: list[int] = []
        dead: set[int] = set()  # places that do not lead to the end
        start, before = 0, -1
        end = min(longest.get(word[:LETTERS], LETTERS - 1), n)
        while start < n:
            while end > start:
                if end not in dead:
                    token = get(word[start:] + suffix) if end == n else get(word[start:end])
                    if token is not None:
                        if before < 0:
                            break
                        known = arcs.get(before * size + token)
                        if has_arc(before, token) if known is None else known:
                            break
                end -= 1
            else:
                if not out:
                    raise ValueError(f"no token sequence for {word!r}")
                dead.add(start)
                out.pop()
                end, start = start - 1, begins.pop()
                before = out[-1] if out else -1
                continue
            out.append(token)
            begins.append(start)
            start, before = end, token
            end = start + longest.get(word[start : start + LETTERS], LETTERS - 1)
            if end > n:
                end = n
        return out


class WordBpe:
    """A tokenizer file of the kind: composition, lower case, pre-split words, BPE with word ends."""

    def __init__(self, spec: str) -> None:
        j = json.loads(spec)
        model = j["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        labels = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.labels = [labels.get(i, "") for i in range(max(labels) + 1)]
        split = next(p for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols = byte_symbols()
        self.known_words: dict[str, tuple[str, str]] = {}
        self.known_pieces: dict[str, tuple[str, str]] = {}

    def parts(self, piece: str) -> list[str | int]:
        """The words of a piece in byte symbols, and the ids of special tokens in it."""
        out: list[str | int] = []
        for part in self.cuts.split(piece) if self.cuts and "<|" in piece else [piece]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            part = "".join([c.lower() for c in part]) if "Σ" in part else part.lower()
            if part.isalpha() and part.isascii():  # the usual piece is one word of ASCII letters
                out.append(part)
                continue
            for word in self.words.findall(part):
                out.append("".join([self.symbols[b] for b in word.encode()]))
        return out

    def digest_piece(self, piece: str) -> tuple[str, str]:
        found = []
        for part in self.parts(piece):
            if isinstance(part, int):
                found.append((str(part), self.labels[part]))
                continue
            known = self.known_words.get(part)
            if known is None:
                ids = self.automaton.encode_word(part)
                known = " ".join(map(str, ids)), self.decode(ids)
                self.known_words[part] = known
            found.append(known)
        return found[0] if len(found) == 1 else (" ".join([a for a, _ in found]), " ".join([b for _, b in found]))

    def encode_piece(self, piece: str) -> list[int]:
        return [int(x) for x in self.digest_piece(piece)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one space between them."""
        return " ".join([self.labels[i] for i in ids])

    def of_pieces(self, pieces: list[str], often: np.ndarray) -> list[tuple[str, str]]:
        """The digests of distinct pieces; those that stand ``often`` are kept for later calls."""
        if len(self.known_pieces) > KNOWN_PIECES:
            first_met(self.known_pieces, STAYING)
        known = self.known_pieces
        out = [known.get(p) for p in pieces]
        for i, keep in [(i, often[i]) for i, v in enumerate(out) if v is None]:
            out[i] = self.digest_piece(pieces[i]) if pieces[i] else ("", "")
            if keep:
                known[pieces[i]] = out[i]
        self.known_words.clear()
        return out

    def settle(self) -> None:
        """Give up most of what was learned; for the end of a task."""
        first_met(self.known_pieces, STAYING)
        first_met(self.automaton.arcs, STAYING)
        # A dictionary shrinks when it is copied.
        self.known_pieces, self.automaton.arcs = dict(self.known_pieces), dict(self.automaton.arcs)

    def digests(self, texts: pa.Array | list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of tokens, the ids joined by one space, and the decoded text."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        column = pc.replace_substring(pc.fill_null(column, ""), "\n", " ")
        split = pc.split_pattern(column, " ")
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        del column, split
        code = coded.indices.to_numpy()
        found = self.of_pieces(coded.dictionary.to_pylist(), np.bincount(code, minlength=len(coded.dictionary)) > 1)
        ids, back = np.empty(len(found), object), np.empty(len(found), object)
        ids[:], back[:] = [a for a, _ in found], [b for _, b in found]
        some = np.array([bool(a) for a, _ in found], bool)[code]  # pieces without tokens fall away
        ends = np.concatenate([[0], np.cumsum(some)])[ends - ends[0]]
        code = code[some]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            joined = " ".join(ids[code[a:b]].tolist())
            yield (joined.count(" ") + 1 if joined else 0), joined, " ".join(back[code[a:b]].tolist())

    def digest(self, text: str | None) -> tuple[int, str, str]:
        return next(self.digests(pa.array([text], pa.string())))

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.digest(text)[1].split()]


def parts_of(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``STEP_BYTES`` of text, a row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            to, total = at, 0
            while to < batch.num_rows and (to == at or total + size[to] <= STEP_BYTES):
                total += size[to]
                to += 1
            yield batch.slice(at, to - at)
            at = to


_READY: dict[str, WordBpe] = {}


def ready(spec: str) -> WordBpe:
    """The tokenizer of a specification, compiled once in a worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _READY:
        _READY.clear()
        _READY[key] = WordBpe(spec)
    return _READY[key]


def encode_digests(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A map without shuffle; the tokenizer file is read by the driver and sent to the workers."""
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = ready(spec.value)
        for batch in parts_of(batches, 1):
            n, ids_sha, back_sha = [], [], []
            for count, ids, back in t.digests(batch.column(1)):
                n.append(count)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                back_sha.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        t.settle()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` and two columns more: the token ids and the decoded text of each row."""
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = ready(spec.value)
        for batch in parts_of(batches, at):
            found = list(t.digests(batch.column(at)))
            more = [pa.array([[int(x) for x in i.split()] for _, i, _ in found], pa.list_(pa.int32())), pa.array([b for _, _, b in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, ids, decoded])
        t.settle()

    return docs.mapInArrow(tidied(run), schema)
