"""N-gram Jaccard join: classes of documents whose shingle sets are alike.

Rare-first prefix filtering.  Shingle frequencies (hashed to ``2 ** FREQUENCY_BITS`` counters,
counted over all documents) give one order for all sets, rarest first.  Two sets whose Jaccard
index reaches the threshold share one of their first ``n - ceil(t * n) + 1`` shingles, so only
those are joined.  The order only decides how many candidates there are, never which links are
found.

1. Each text gives its set's size and 128-bit fingerprint (a map).  Documents with equal sets are
   one representative, the smallest (doc_id, hash of the text); they are never paired.
2. Each set gives its prefix rows (token, set, size, position), once a task; tokens that only one
   set holds fall away, as do rows too far back to be the first common token of a link.  Rows of
   tokens whose counter is large are dealt on by a salt before they are counted.
3. Tokens held by at most ``hot`` sets are joined with themselves under the length filter and the
   positional filter (at the first common token, what is left of the shorter set must suffice);
   pairs are made distinct.  Pairs of one set are cut into cells of ``cell`` partners.
4. The sets of a token held by more sets meet a few of their like (of about one size: the most
   central one, and one by hash), not each other.  What these links join is one class.
5. Sets of such a token outside its largest class then meet the token's other sets, in cells of
   two blocks of ``block`` sets of about one size; pairs of one class are passed over.  Tokens with
   one largest class are put together where that makes fewer pairs.
6. Cells are first sifted on bitmaps of a bit or two per shingle: length, positional and suffix
   filter (two sets differ in at least as many shingles as their parity bitmaps in bits).
   Members without a pair that passes fall away.
7. The texts of the sets that are left are read again, and each cell verifies its pairs by exact
   overlap.  A pair that shares several hot tokens is verified in the cell of the first one.  A
   cell returns the edges of a spanning forest of its links, never all links.
8. Components of these edges by alternating large and small stars; the tables between rounds are
   written to the shared folder.

No task holds a group of unbounded size.  A group of near copies costs rows in proportion to its
sets: each meets a few of its like, and only what they leave apart is compared further, at a row
for each block on the other side.

Defined results: null and empty texts and texts without words have an empty set, size 0, and are
linked with nothing; a text with fewer words than a shingle is one shingle, its whole sequence;
equal texts are linked; rows with the same doc_id and text count as one document (rows are kept);
different texts under one doc_id, or under none, are documents of their own, linked only by what
they hold; a null doc_id names no component unless all its members are null; an empty table gives
an empty result; texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import scratch, tidied, written

#: Counters of shingle frequencies.
FREQUENCY_BITS = 20
#: Counters in one row between tasks.
CHUNK = 1 << 14
NAMES = ["doc_id", "h", "n", "hi", "lo", "bits", "chunk", "counts"]
#: Rows of a token that one task is to count.
CROWD = 1 << 16
#: Texts hashed at a time.
STEP_CHARS = 4_000_000
#: Estimated bytes of a table up to which it is broadcast.
BROADCAST_BYTES = 64 << 20
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    ends = words.offsets.to_numpy()
    flat = words.flatten()
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)
    code = coded.indices.to_numpy().astype(np.int64)
    # White space at either end leaves an empty string there.
    real = np.array([bool(w) for w in names], bool)[code] if len(names) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(real)])
    ends = kept[ends - ends[0]] if len(ends) else ends
    h = hashes[code[real]] if len(names) else np.zeros(0, np.uint64)
    n = len(h)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        rolled = (rolled ^ (rolled >> np.uint64(29))) * M1 + h[j : j + len(rolled)]
    rolled = (rolled ^ (rolled >> np.uint64(32))) * M2
    rolled ^= rolled >> np.uint64(29)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def steps(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches of about ``STEP_CHARS`` bytes of text."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            to, total = at, 0
            while to < batch.num_rows and (to == at or total + size[to] <= STEP_CHARS):
                total += size[to]
                to += 1
            yield batch.slice(at, to - at)
            at = to


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def set_id(s: np.ndarray) -> tuple[int, int]:
    """The two halves of a set's fingerprint, as signed numbers."""
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(x - (1 << 64) if x >> 63 else x for x in (d >> 64, d & 0xFFFFFFFFFFFFFFFF))


def prefix_length(n: int, num: int, den: int) -> int:
    """Shingles of a set's prefix: n - ceil(num / den * n) + 1."""
    return n - -(-num * n // den) + 1


def needed_overlap(a: int | np.ndarray, b: int | np.ndarray, num: int, den: int) -> int | np.ndarray:
    """The least overlap at which sizes a and b reach the threshold: ceil(num (a + b) / (num + den))."""
    return -(-num * (a + b) // (num + den))


def parity_bits(n: int) -> int:
    """Bits of a set's bitmap: a power of two, no fewer than its shingles."""
    return max(64, 1 << (n - 1).bit_length())


def parity_bitmap(s: np.ndarray) -> bytes:
    """Bit i is the parity of the number of hashes in the i-th of equal ranges."""
    bits = parity_bits(len(s))
    at = (s >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, to: int) -> np.ndarray:
    """Bitmaps (rows of 0 and 1) of the same sets with fewer, wider ranges."""
    while bits.shape[1] > to:
        bits = bits[:, 0::2] ^ bits[:, 1::2]
    return bits


def suffix_filter(ok: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, maps: list[bytes], num: int, den: int) -> np.ndarray:
    """Pairs whose overlap can still suffice: two sets differ in at least as many hashes as their
    parity bitmaps in bits.  At thresholds from 1/2 on, pairs that passed the length filter have
    bitmaps of one width or of neighbouring ones; pairs of other widths pass unfiltered."""
    width = np.array([8 * len(m) for m in maps])
    wl, wr = width[left][:, None], width[right][None, :]
    out = (wl > 2 * wr) | (wr > 2 * wl)
    for w in np.unique(width):
        rows, cols = np.flatnonzero((width[left] == w) | (width[left] == 2 * w)), np.flatnonzero((width[right] == w) | (width[right] == 2 * w))
        if not len(rows) or not len(cols) or not ok[np.ix_(rows, cols)].any():
            continue
        mine = np.minimum(width[left[rows]][:, None], width[right[cols]][None, :]) == w
        a, b = bit_rows([maps[i] for i in left[rows]], w), bit_rows([maps[i] for i in right[cols]], w)
        differ = a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :] - 2 * (a @ b.T)
        total = sizes[left[rows]][:, None] + sizes[right[cols]][None, :]
        enough = (total - differ) // 2 >= needed_overlap(sizes[left[rows]][:, None], sizes[right[cols]][None, :], num, den)
        out[np.ix_(rows, cols)] |= enough & mine
    return ok & out


def bit_rows(maps: list[bytes], width: int) -> np.ndarray:
    rows = [folded(np.unpackbits(np.frombuffer(m, np.uint8))[None, :], width) for m in maps]
    return np.concatenate(rows).astype(np.float32)


def text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def node_of(key: Column, h: Column) -> Column:
    """What stands for a document in links: its id and the hash of its text, so that texts under
    one id, or under none, stay apart.  The least node of a component has its least id; those
    without an id come last."""
    return F.struct(key.isNull().alias("none"), F.coalesce(key.cast("long"), F.lit(0)).alias("id"), h.alias("h"))


def node_list(column: pa.ChunkedArray | pa.Array) -> list[tuple[bool, int, int]]:
    return [(r["none"], r["id"], r["h"]) for r in column.to_pylist()]


def node_array(nodes: list[tuple[bool, int, int]]) -> pa.Array:
    return pa.array([dict(zip(("none", "id", "h"), x, strict=True)) for x in nodes], ARROW_NODE)


def set_table(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """doc_id, h (hash of the text), n, hi, lo of every row; and rows of frequency counters (chunk, counts)."""
    schema = "doc_id long, h long, n long, hi long, lo long, bits binary, chunk int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << FREQUENCY_BITS, np.int64)
        for part in steps(batches, 1):
            sets = shingle_sets(texts_of(part.column(1)), k)
            if not sets:
                continue
            counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64), minlength=len(counts))
            ids = [set_id(s) for s in sets]
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in ids], pa.int64()), pa.array([b for _, b in ids], pa.int64()), pa.array([parity_bitmap(s) if len(s) else None for s in sets], pa.binary()), none.cast(pa.int32()), pa.nulls(len(sets), pa.binary())], NAMES)
        chunks = counts.astype("<i4").reshape(-1, CHUNK)
        none = pa.nulls(len(chunks)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.nulls(len(chunks), pa.binary()), pa.array(range(len(chunks)), pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary())], NAMES)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), text_hash(text).alias("h")).mapInArrow(tidied(run), schema)


def counter_totals(rows: DataFrame) -> np.ndarray:
    """The counters over all rows.  Tasks add up the chunks dealt to them one by one; a fixed
    number of counters comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0), batch.column(1), strict=True):
                c = chunk.as_py()
                sums[c] = sums.get(c, 0) + np.frombuffer(raw.as_py(), "<i4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["chunk", "counts"])

    chunks = rows.where("chunk is not null").select("chunk", "counts").repartition(16, "chunk")
    total = np.zeros(1 << FREQUENCY_BITS, np.int64)
    for r in chunks.mapInArrow(tidied(add), "chunk int, counts binary").toLocalIterator():
        total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    return total


def frequencies(total: np.ndarray) -> np.ndarray:
    """The rank of each counter, the least counted first."""
    rank = np.empty(len(total), np.uint32)
    rank[np.argsort(total, kind="stable")] = np.arange(len(total), dtype=np.uint32)
    return rank


def prefix_rows(docs: DataFrame, k: int, num: int, den: int, rank: np.ndarray, text: str, total: np.ndarray | None = None) -> DataFrame:
    """token, salt, hi, node (the halves of the set's fingerprint), n, pos of every distinct set of
    a task.  The salt is -1 but for tokens whose counter in ``total`` exceeds a crowd: theirs deals
    the sets to as many shares as there are crowds."""
    salts = np.zeros(len(rank), np.uint32) if total is None else (total // CROWD).astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast((rank, salts))
    down = np.uint64(FREQUENCY_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, shares = shared.value
        back = np.empty(len(order), np.int64)  # the counter of each rank
        back[order] = np.arange(len(order))
        seen: set[tuple[int, int]] = set()
        for part in steps(batches, 0):
            token, high, node, n, pos = [], [], [], [], []
            for s in shingle_sets(texts_of(part.column(0)), k):
                if not len(s):
                    continue
                hi, lo = set_id(s)
                if (hi, lo) in seen:
                    continue
                seen.add((hi, lo))
                p = prefix_length(len(s), num, den)
                # One key: the counter's rank above, the rest of the hash below it.
                at = order[(s >> np.uint64(64) - down).astype(np.int64)].astype(np.uint64) << np.uint64(64) - down | s & np.uint64((1 << 64 - FREQUENCY_BITS) - 1)
                least = np.sort(np.partition(at, p - 1)[:p]) if p < len(at) else np.sort(at)
                token.append(least)
                high.append(hi)
                node.append(lo)
                n.append(len(s))
                pos.append(p)
            if not token:
                continue
            sizes = np.array(pos)
            keys = np.concatenate(token)
            places = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            nodes = np.repeat(np.array(node, np.int64), sizes)
            share = shares[back[(keys >> np.uint64(64) - down).astype(np.int64)]].astype(np.int64)
            salt = np.where(share > 0, nodes % np.maximum(share, 1), -1)
            # The signed order of the tokens is the order of the prefixes: cells rely on it.
            signed = (keys ^ np.uint64(1 << 63)).view(np.int64)
            columns = [signed, salt.astype(np.int32), np.repeat(np.array(high, np.int64), sizes), nodes, np.repeat(np.array(n, np.int32), sizes), places.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "salt", "hi", "node", "n", "pos"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tidied(run), "token long, salt int, hi long, node long, n int, pos int")


def squeezed(s: np.ndarray) -> bytes:
    """A sorted set of 64-bit hashes by its upper 48 bits, six bytes each."""
    return (s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsqueezed(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1) << np.uint64(16)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum()) if len(b) else 0


def block_overlaps(a: list[np.ndarray], b: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Overlaps of all pairs of two lists of sets, by products of 0-1 matrices of the values they share."""
    ea, eb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(ea, eb)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(both):
        return out

    def places(every: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(both, every)
        at[at == len(both)] = 0
        ok = both[at] == every
        return owner[ok], at[ok]

    (oa, ca), (ob, cb) = places(ea, a), places(eb, b)
    for start in range(0, len(both), columns):
        width = min(columns, len(both) - start)
        ma, mb = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        ia, ib = (ca >= start) & (ca < start + width), (cb >= start) & (cb < start + width)
        ma[oa[ia], ca[ia] - start] = 1
        mb[ob[ib], cb[ib] - start] = 1
        out += ma @ mb.T
    return out


def forest(edges: list[tuple]) -> list[tuple]:
    """For each component of some edges, edges from its least node to all others."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
    return [(root(x), x) for x in list(up) if root(x) != x]


@dataclass
class Cell:
    """The members of a cell, whose pairs are those of side 0 with side 1.  In a cell of a token,
    ``label`` is the class that each member is known to be in, and ``main`` says whether it is the
    token's largest; elsewhere each member is its own class."""

    rep: list[tuple]
    side: np.ndarray
    sizes: np.ndarray
    token: int | None
    pos: np.ndarray
    tokens: list[list[int]]
    label: list[tuple]
    main: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Cell:
        return Cell(node_list(rows.column("rep")), rows.column("side").to_numpy(), rows.column("n").to_numpy(), rows.column("token")[0].as_py(), rows.column("pos").to_numpy(), rows.column("tokens").to_pylist(), node_list(rows.column("label")), rows.column("main").to_numpy())

    def possible(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, pairs that pass the length filter).  In a cell of a token the positional
        filter applies, and pairs that share an earlier hot token are another cell's."""
        left, right = np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1)
        a, b = self.sizes[left][:, None].astype(np.int64), self.sizes[right][None, :].astype(np.int64)
        need = needed_overlap(a, b, num, den)
        ok = np.minimum(a, b) >= need
        if self.token is None or not ok.any():
            return left, right, ok
        ok &= 1 + np.minimum(a - self.pos[left][:, None] - 1, b - self.pos[right][None, :] - 1) >= need
        # Sets outside the largest class stand on both sides: one order of a pair is enough.
        number = {x: i for i, x in enumerate(sorted(set(self.label)))}
        label = np.array([number[x] for x in self.label])
        ok &= label[left][:, None] != label[right][None, :]
        ok &= self.main[right][None, :] | (label[left][:, None] < label[right][None, :])
        before = sorted({t for ts in self.tokens for t in ts if t < self.token})
        if before and ok.any():
            column = {t: i for i, t in enumerate(before)}
            holds = np.zeros((len(self.rep), len(before)), np.float32)
            for i, ts in enumerate(self.tokens):
                for t in ts:
                    if t < self.token:
                        holds[i, column[t]] = 1
            ok &= holds[left] @ holds[right].T == 0
        return left, right, ok

    def hopeful(self, maps: list[bytes], num: int, den: int) -> np.ndarray:
        """Members with a pair that passes the suffix filter too."""
        left, right, ok = self.possible(num, den)
        if ok.any():
            ok = suffix_filter(ok, left, right, self.sizes.astype(np.int64), maps, num, den)
        return np.unique(np.concatenate([left[ok.any(axis=1)], right[ok.any(axis=0)]]))

    def links(self, sets: list[np.ndarray], num: int, den: int) -> list[tuple]:
        """The verified links, as pairs of classes."""
        left, right, ok = self.possible(num, den)
        i, j = np.nonzero(ok)
        need = needed_overlap(self.sizes[left[i]].astype(np.int64), self.sizes[right[j]].astype(np.int64), num, den)
        if len(i) > 4 * (len(left) + len(right)):
            rows, cols = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
            full = np.zeros(ok.shape)
            full[np.ix_(rows, cols)] = block_overlaps([sets[left[r]] for r in rows], [sets[right[c]] for c in cols])
            true = full[i, j] >= need
        else:
            true = np.array([overlap(sets[left[a]], sets[right[b]]) for a, b in zip(i, j, strict=True)]) >= need
        return [(min(x, y), max(x, y)) for x, y in ((self.label[left[a]], self.label[right[b]]) for a, b in zip(i[true], j[true], strict=True)) if x != y]


def can_link(nx: Column, ny: Column, px: Column, py: Column, num: int, den: int) -> Column:
    """The length filter and the positional filter for a first common token at px and py."""
    long_enough = F.least(nx, ny) * den >= F.greatest(nx, ny) * num
    return long_enough & ((1 + F.least(nx - px - 1, ny - py - 1)) * (num + den) >= num * (nx + ny))


def useful(rows: DataFrame, num: int, den: int) -> Column:
    """Rows that can be the first common token of a link, given ``least`` and ``most``, the sizes of
    the sets that hold the token in front.

    The shorter set of a link has its first common token within its first
    ``n - ceil(2t / (1 + t) n) + 1``; so a row further back needs a set of no more than its own
    size that holds the token so far in front."""
    return F.col("least").isNotNull() & (F.col("front") | ((F.col("least") <= F.col("n")) & (F.col("most") * den >= F.col("n") * num)))


def held_tokens(prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """token, hi, node, n, pos, k: rows of tokens that can be the first common token of a link; k
    sets hold it.

    A share of a token's rows is counted by a window; the shares of a crowded token, distinct by
    then, are counted together by groupings and joins, which hold no token in one task."""
    share = Window.partitionBy("token", "salt")
    front = (F.col("n") - F.col("pos")) * (num + den) >= 2 * num * F.col("n")
    own_size = F.when(F.col("front"), F.col("n"))
    several = (F.min("node").over(share) < F.max("node").over(share)) | (F.min("hi").over(share) < F.max("hi").over(share))
    seen = prefixes.withColumn("front", front).select("*", several.alias("several"), F.min(own_size).over(share).alias("least"), F.max(own_size).over(share).alias("most"))
    one_each = seen.where((F.col("salt") >= 0) | (F.col("several") & useful(seen, num, den))).dropDuplicates(["token", "salt", "hi", "node"])
    held = written(one_each.withColumn("k", F.count(F.lit(1)).over(share)).select("token", "salt", "hi", "node", "n", "pos", "front", "k"), "jaccard-held")
    calm = held.where("salt < 0 and k > 1").select("token", "hi", "node", "n", "pos", "k")
    crowd = held.where("salt >= 0").drop("k")
    bounds = crowd.groupBy("token").agg(F.min(own_size).alias("least"), F.max(own_size).alias("most"))
    some = crowd.join(bounds, "token")
    some = written(some.where(useful(some, num, den)).select("token", "hi", "node", "n", "pos"), "jaccard-crowds")
    sizes = some.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return calm.unionByName(some.join(sizes, "token"))


def side_tasks(rows: DataFrame, side: int, c: Column, token: Column | None = None, pos: Column | None = None, main: Column | None = None) -> DataFrame:
    """hi, node, c, side, token, pos, main: the part of a set in a cell."""
    none = F.lit(None).cast("long")
    return rows.select("hi", "node", c.alias("c"), F.lit(side).alias("side"), (none if token is None else token).alias("token"), (F.lit(0) if pos is None else pos).alias("pos"), (F.lit(False) if main is None else main).alias("main"))


def of_x(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hi", F.col("xh")).withColumn("node", F.col("x"))


def of_y(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hi", F.col("yh")).withColumn("node", F.col("y"))


def pair_tasks(pairs: DataFrame, letter: str, cell: int) -> DataFrame:
    """Cells of pairs (xh, x, yh, y): a set x with at most about ``cell`` partners each."""
    sizes = pairs.groupBy("xh", "x").agg(F.count(F.lit(1)).alias("m"))
    cut = pairs.join(sizes, ["xh", "x"]).withColumn("c", F.concat_ws(".", F.lit(letter), "xh", "x", F.pmod(F.xxhash64("yh", "y"), F.ceil(F.col("m") / cell))))
    return side_tasks(of_x(cut), 0, F.col("c")).distinct().unionByName(side_tasks(of_y(cut), 1, F.col("c")))


def few_tasks(held: DataFrame, num: int, den: int, hot: int, cell: int) -> DataFrame:
    """Cells of tokens that few sets hold: the join on the token, under the length and the
    positional filter."""
    few = held.where(F.col("k") <= hot)
    a = few.select("token", F.col("hi").alias("xh"), F.col("node").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"))
    b = few.select("token", F.col("hi").alias("yh"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"))
    less = (F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("xh") < F.col("yh")))
    pairs = a.join(b, "token").where(less & can_link(F.col("nx"), F.col("ny"), F.col("px"), F.col("py"), num, den)).select("xh", "x", "yh", "y").distinct()
    return pair_tasks(pairs, "p", cell)


def band(num: int, den: int) -> Column:
    """Sizes in classes of a little more than the threshold's ratio: linked sets are of one class or
    of neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / (math.log(max(den / num, 1 + 1e-6)) * (1 + 1e-6))).cast("int")


def pivot_tasks(many: DataFrame, num: int, den: int, cell: int) -> DataFrame:
    """Cells in which the sets of hot tokens meet two sets of their band and two of each beside it:
    the one that holds most hot tokens, behind the fewest others of its own, which is the text that
    others were copied from if it is there; and one by hash."""
    central = F.struct(F.col("held").alias("a"), (-F.col("behind")).alias("b"), F.xxhash64("hi", "node").alias("c"), "hi", "node", "n")
    hashed = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.xxhash64("hi", "node").alias("c"), "hi", "node", "n")
    found = F.explode(F.array_distinct(F.transform(F.array(F.max(central), F.min(hashed)), lambda p: F.struct(p["hi"].alias("xh"), p["node"].alias("x"), p["n"].alias("nx")))))
    pivots = written(many.groupBy("token", "band").agg(found.alias("p")).select("token", "band", "p.*"), "jaccard-pivots")
    near = F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band")
    members = many.select("token", near, F.col("hi").alias("yh"), F.col("node").alias("y"), F.col("n").alias("ny"))
    met = members.join(pivots, ["token", "band"]).where(~(F.col("x").eqNullSafe(F.col("y")) & F.col("xh").eqNullSafe(F.col("yh")))).where(F.least("nx", "ny") * den >= F.greatest("nx", "ny") * num)
    return pair_tasks(met.select("xh", "x", "yh", "y").distinct(), "v", cell)


def pooled(known: DataFrame, by_class: DataFrame) -> DataFrame:
    """token, hi, node, pos, band, first, label: ``known`` with the tokens put together whose largest
    class is the same, where their sets make fewer pairs as one pool than token by token.

    The sets of a large group share many tokens.  Compared under each of these, a set outside the
    largest class would meet the same others again and again.  A pool has every pair of its tokens,
    each once; no position is left in it, nor a first token."""
    of_token = by_class.where("classes > 1").select("token", F.col("top.label").alias("top"), "k", (F.col("k") - F.col("top.held")).alias("own"))
    one_by_one = of_token.groupBy("top").agg(F.sum(F.col("own") * F.col("k")).alias("pairs"), F.count(F.lit(1)).alias("tokens")).where("tokens > 1")
    each = known.select("token", "hi", "node", "label").join(of_token.select("token", "top"), "token").dropDuplicates(["top", "hi", "node"])
    at_once = each.groupBy("top").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("label") != F.col("top")).alias("own"))
    chosen = one_by_one.join(at_once, "top").where(F.col("own") * F.col("all") < F.col("pairs")).select("top", F.xxhash64(F.lit("pool"), "top").alias("pool"))
    pools = written(of_token.join(chosen, "top").select("token", "pool"), "jaccard-pools")
    columns = ["token", "hi", "node", "pos", "band", "first", "label"]
    members = known.join(pools, "token").withColumn("token", F.col("pool")).withColumn("first", F.col("pool")).withColumn("pos", F.lit(0))
    return known.join(pools, "token", "left_anti").select(*columns).unionByName(members.select(*columns).dropDuplicates(["token", "hi", "node"]))


def block_tasks(many: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Cells in which the sets of hot tokens that are not in their token's largest class meet the
    token's sets of their band and of those beside it, block by block; tokens that mostly have the
    same sets are one first.

    Sets of one first hot token are compared under that one; so the most frequent first token of a
    token's sets sets those apart (``head``) that need not meet each other here."""
    known = written(many.join(labels.select("hi", "node", "label"), ["hi", "node"]), "jaccard-labelled")

    def classes_of(rows: DataFrame) -> DataFrame:
        held = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("held"))
        return held.groupBy("token").agg(F.max(F.struct("held", "label")).alias("top"), F.sum("held").alias("k"), F.count(F.lit(1)).alias("classes"))

    known = written(pooled(known, written(classes_of(known), "jaccard-classes")), "jaccard-pooled")
    by_class = classes_of(known)
    by_first = known.groupBy("token", "first").agg(F.count(F.lit(1)).alias("held")).groupBy("token").agg(F.max(F.struct("held", "first")).alias("lead"))
    # Tokens of one class have nothing left to compare.
    tokens = by_class.where("classes > 1").join(by_first, "token").select("token", F.col("top.label").alias("top"), F.col("lead.first").alias("lead"))
    open_ = known.join(tokens, "token").withColumn("main", F.col("label") == F.col("top")).withColumn("head", (F.col("first") == F.col("lead")) & (F.col("lead") != F.col("token")))
    open_ = written(open_.select("token", "hi", "node", "pos", "band", "head", "main"), "jaccard-open")
    at = F.xxhash64("hi", "node")
    sizes = written(open_.groupBy("token", "band", "head").agg(F.ceil(F.count_if(~F.col("main")) / block).cast("int").alias("lefts"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("rights")), "jaccard-blocks")
    other = sizes.select("token", F.col("band").alias("band_2"), F.col("head").alias("head_2"), F.col("lefts").alias("lefts_2"), F.col("rights").alias("rights_2"))
    # A left block meets every right block of the bands around it, and the other way round.
    pairs = sizes.join(other, "token").where((F.abs(F.col("band") - F.col("band_2")) <= 1) & ~(F.col("head") & F.col("head_2")))
    met = open_.join(pairs, ["token", "band", "head"])

    def numbers(n: str) -> Column:
        return F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>")))

    def name(left: Column, right: Column, swapped: bool) -> Column:
        own, others = ["band", "head"], ["band_2", "head_2"]
        first, second = (others, own) if swapped else (own, others)
        return F.concat_ws(".", F.lit("t"), "token", *first, left, *second, right)

    left = met.where(~F.col("main")).withColumn("i", F.pmod(at, F.col("lefts"))).withColumn("j", numbers("rights_2"))
    right = met.withColumn("j", F.pmod(at, F.col("rights"))).withColumn("i", numbers("lefts_2"))
    lefts = side_tasks(left, 0, name(F.col("i"), F.col("j"), False), F.col("token"), F.col("pos"), F.col("main"))
    return lefts.unionByName(side_tasks(right, 1, name(F.col("i"), F.col("j"), True), F.col("token"), F.col("pos"), F.col("main")))


NODE, ARROW_NODE = "struct<none: boolean, id: long, h: long>", pa.struct([("none", pa.bool_()), ("id", pa.int64()), ("h", pa.int64())])
MEMBER = f"cell string, side int, token long, pos int, main boolean, rep {NODE}, n long, tokens array<long>, label {NODE}"


def sifted(tasks: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """rep, label, tasks, tokens: what is left of the cells once the filters have run on bitmaps,
    which are a small part of the sets.  ``tokens`` are the hot tokens that a set is compared under."""
    task = F.struct(F.col("c").alias("cell"), "side", "token", "pos", "main")
    each = tasks.groupBy("hi", "node").agg(F.collect_list(task).alias("tasks"), F.array_sort(F.collect_set("token")).alias("tokens"))
    each = each.join(labels.select("hi", "node", "rep", "n", "bits", "label"), ["hi", "node"]).select("rep", "n", "bits", "tokens", "label", F.explode("tasks").alias("t"))
    none = F.array().cast("array<bigint>")
    members = each.select("t.*", "rep", "n", F.when(F.col("t.token").isNull(), none).otherwise(F.col("tokens")).alias("tokens"), "label", "bits")

    def sift(rows: pa.Table) -> pa.Table:
        keep = Cell.of(rows).hopeful(rows.column("bits").to_pylist(), num, den)
        return rows.take(pa.array(keep)).drop_columns(["bits"])

    left = members.groupBy("cell").applyInArrow(sift, MEMBER)
    task = F.struct("cell", "side", "token", "pos", "main")
    return left.groupBy("rep").agg(F.collect_list(task).alias("tasks"), F.max_by("tokens", F.size("tokens")).alias("tokens"), F.min("label").alias("label"))


def texts_once(docs: DataFrame, sets: DataFrame, wanted: DataFrame, small: bool, key: str, text: str) -> DataFrame:
    """rep, text, label, tasks, tokens: one text for each set wanted.  Rows that repeat an id and
    its text are made one before anything is made of them."""
    texts = docs.select(node_of(F.col(key), text_hash(text)).alias("rep"), F.col(text).cast("string").alias("text"))
    names = wanted.select("rep")
    many = sets.select(F.col("node").alias("rep")).join(F.broadcast(names) if small else names, "rep", "left_semi").groupBy("rep").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("rep")
    many = written(many, "jaccard-repeated")
    if many.isEmpty():
        return texts.join(F.broadcast(wanted) if small else wanted, "rep")
    def of(names: DataFrame) -> DataFrame:
        return F.broadcast(names) if small else names

    once = texts.join(of(wanted.join(many, "rep", "left_anti")), "rep")
    again = texts.join(of(many), "rep", "left_semi").groupBy("rep").agg(F.min("text").alias("text")).join(of(wanted), "rep")
    return once.unionByName(again)


def verified_edges(docs: DataFrame, sets: DataFrame, labels: DataFrame, tasks: DataFrame, k: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """a, b: edges of spanning forests of the links in all cells, between the classes of ``labels``."""
    wanted = written(sifted(tasks, labels, num, den), "jaccard-wanted")
    # The texts stay where they are while the other side is small; beyond that both are shuffled.
    load = wanted.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("tasks")), F.lit(0)).alias("tasks"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens")).collect()[0]
    small = 96 * load["rows"] + 96 * load["tasks"] + 8 * load["tokens"] <= BROADCAST_BYTES
    got = texts_once(docs, sets, wanted, small, key, text).select("rep", "text", "tasks", "tokens", "label")
    names = ["cell", "side", "token", "pos", "main", "rep", "n", "tokens", "label", "set"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), ARROW_NODE, pa.int64(), pa.list_(pa.int64()), ARROW_NODE, pa.binary()]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for part in steps(batches, 1):
            rows: list[tuple] = []
            held = 0
            for rep, s, ts, tokens, label in zip(part.column(0).to_pylist(), shingle_sets(texts_of(part.column(1)), k), *[part.column(c).to_pylist() for c in (2, 3, 4)], strict=True):
                raw = squeezed(s)
                for t in ts:
                    rows.append((t["cell"], t["side"], t["token"], t["pos"], t["main"], rep, len(s), tokens if t["token"] is not None else [], label, raw))
                    held += len(raw)
                    if held > STEP_CHARS:
                        yield flush()
                        rows, held = [], 0
            if rows:
                yield flush()

    def compare(rows: pa.Table) -> pa.Table:
        sets = [unsqueezed(x) for x in rows.column("set").to_pylist()]
        edges = forest(Cell.of(rows).links(sets, num, den))
        return pa.table({"a": node_array([a for a, _ in edges]), "b": node_array([b for _, b in edges])})

    cells = got.mapInArrow(tidied(spread), f"{MEMBER}, set binary")
    return cells.groupBy("cell").applyInArrow(compare, f"a {NODE}, b {NODE}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, by alternating stars."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "jaccard-edges")
    before = None
    while True:
        # The least neighbours are written, so that both sides of each join are plain exchanges
        # and the rows of a node with very many edges can be split among tasks.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "jaccard-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "jaccard-large")
        below = written(large.groupBy("u").agg(F.min("v").alias("m")), "jaccard-below")
        small = large.join(below, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        edges = written(small, "jaccard-edges")
        # Stars no longer change when every node has one edge, to a node that has none.
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("nodes"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).collect()[0]
        if state == before or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def rooted(docs: DataFrame, k: int, num: int, den: int, key: str, text: str, hot: int, cell: int, block: int) -> DataFrame:
    """doc_id, n_shingles, node, root of every row: root is the least node of its class."""
    if not 0 < num <= den:
        raise ValueError("the threshold is a fraction in (0, 1]")
    rows = written(set_table(docs, k, key, text), "jaccard-sets")
    sets = rows.where("chunk is null").select("doc_id", node_of(F.col("doc_id"), F.col("h")).alias("node"), "n", "hi", "lo", "bits")
    some = sets.where("n > 0")
    with scratch(docs.sparkSession):
        reps = some.groupBy("hi", "lo").agg(F.min("node").alias("rep"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits"))
        reps = written(reps.withColumnRenamed("lo", "node").withColumn("label", F.col("rep")), "jaccard-reps")
        total = counter_totals(rows)
        held = held_tokens(prefix_rows(docs, k, num, den, frequencies(total), text, total), num, den)
        many = held.where(F.col("k") > hot).select("token", "hi", "node", "n", "pos", band(num, den).alias("band"))
        tokens = many.groupBy("hi", "node").agg(F.count(F.lit(1)).alias("held"), F.sum("pos").alias("behind"), F.min("token").alias("first"))
        many = written(many.join(tokens, ["hi", "node"]), "jaccard-many")
        tasks = few_tasks(held, num, den, hot, cell).unionByName(pivot_tasks(many, num, den, cell))
        roots = components(verified_edges(docs, some, reps, tasks, k, num, den, key, text))
        labels = written(reps.drop("label").join(roots.select(F.col("node").alias("rep"), F.col("root").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "jaccard-labels", keep=True)
        rest = written(block_tasks(many, labels, block), "jaccard-rest")
        if rest.isEmpty():
            named = labels
        else:
            above = components(verified_edges(docs, some, labels, rest, k, num, den, key, text))
            named = labels.join(above.select(F.col("node").alias("label"), "root"), "label", "left").withColumn("label", F.coalesce("root", "label"))
            named = written(named.select("hi", "node", "label"), "jaccard-roots", keep=True)
    linked = some.join(named.select("hi", F.col("node").alias("lo"), F.col("label").alias("root")), ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "node", "root")
    alone = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), "node", F.col("node").alias("root"))
    return linked.unionByName(alone)


def jaccard_classes(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10, key: str = "doc_id", text: str = "text", hot: int = 32, cell: int = 64, block: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Documents are linked when ``den * intersection >= num * union`` of their sets of k-word
    shingles; a component's id is its smallest doc_id."""
    classes = rooted(docs, k, num, den, key, text, hot, cell, block)
    return classes.select("doc_id", "n_shingles", F.when(~F.col("root.none"), F.col("root.id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text", hot: int = 32, cell: int = 64, block: int = 256) -> DataFrame:
    """One document of each class of near copies, that of the least doc_id.  Texts without words
    are in no class: those without an id are all kept, of others one for each id and text."""
    classes = rooted(docs, k, num, den, key, text, hot, cell, block)
    kept = written(classes.where(F.col("node") == F.col("root")).select(F.col("node").alias("__node")).distinct(), "jaccard-kept")
    free = F.col(key).isNull() & ~F.coalesce(F.col(text).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rest = docs.where(~free).withColumn("__node", node_of(F.col(key), text_hash(text)))
    return rest.join(kept, "__node", "left_semi").dropDuplicates(["__node"]).drop("__node").unionByName(docs.where(free))
