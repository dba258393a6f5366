"""MinHash near-dedup: classes of documents whose shingle sets are alike, found by banded buckets.

One-permutation hashing with optimal densification.  A set's shingles are hashed once; the hash's
range is cut into ``bands * width`` equal bins and each bin keeps its least hash.  An empty bin
takes the value of the first bin that is not empty in an order of all bins drawn for it alone, so
two sets agree in any bin with a chance equal to their Jaccard index, whatever their sizes, and
the empty bins of a small set are as independent as those of a large one.

1. Each text gives its set's size, 128-bit fingerprint, parity bitmap and ``bands`` bucket keys,
   each the hash of ``width`` bins (a map).  Documents with equal sets are one representative.
2. Buckets that only one set is in fall away.  In each other bucket two sets are hubs: the one
   that shares most buckets with others (the text that others were copied from, if it is there)
   and one by hash.  Candidate edges form stars around them, at most two a member of a bucket,
   so there are no more edges than rows in buckets; stars of one group over many bands are mostly
   the same edges.
3. Candidates are confirmed on full sets: length filter, parity bitmaps, then the exact overlap.
   Confirmed edges are joined to classes by alternating stars.
4. A star says nothing about two members that are not hubs.  In buckets that still hold several
   classes, members outside the bucket's largest class meet the others in blocks, under the same
   filters; pairs of one class are passed over.  The buckets of a large group mostly have the same
   members: they are put together first, so that these meet once, not once a bucket.  So a pair that shares a bucket is compared or
   joined already; none is lost to the shape of the stars.

A link of Jaccard index s is missed only where no band agrees: ``(1 - s ** width) ** bands``, which
is 7e-8 at s = 0.8 for the widths taken here (54 bands of 6) and falls fast above it.
The shuffles carry bucket keys of distinct sets, bitmaps of candidates and sets of those left.

Defined results: null and empty texts and texts without words have an empty set, size 0, and are
linked with nothing; a text with fewer words than a shingle is one shingle, its whole sequence;
equal texts are linked; rows with the same doc_id and text count as one document (rows are kept);
different texts under one doc_id, or under none, are documents of their own; a null doc_id names no
component unless all its members are null, and then none of them is kept by ``minhash_classes``;
an empty table gives an empty result; texts are read whole; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import jaccard
from tesserae.llm.common import scratch, tidied, written

#: Bands of a signature and bins of a band.
BANDS, WIDTH = 54, 6
#: Partners of a hub in one cell, and sets of one block of a bucket of several classes.
CELL, BLOCK = 64, 256
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def scrambled(x: np.ndarray) -> np.ndarray:
    """64-bit numbers mixed so that all bits count."""
    x = (x ^ (x >> np.uint64(30))) * STEP
    return (x ^ (x >> np.uint64(27))) * MIX


def detours(bins: int) -> np.ndarray:
    """For each bin (row) the place of every bin in an order of its own: a table of bins squared."""
    cells = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins)
    order = np.argsort(scrambled(scrambled(cells + MIX)), axis=1)
    places = np.empty((bins, bins), np.uint16 if bins < 1 << 16 else np.uint32)
    np.put_along_axis(places, order, np.arange(bins, dtype=places.dtype)[None, :], axis=1)
    return places


def signature(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The value of each bin for a sorted set of hashes that is not empty."""
    bins = len(places)
    mine = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(mine, prepend=-1))  # sorted: the first of a bin is its least
    held = mine[first]
    out = np.empty(bins, np.uint64)
    out[held] = hashes[first]
    if len(held) < bins:
        empty = np.setdiff1d(np.arange(bins), held, assume_unique=True)
        out[empty] = hashes[first[places[np.ix_(empty, held)].argmin(axis=1)]]
    return out


def bucket_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band."""
    parts = values.reshape(bands, -1)
    key = scrambled(np.arange(1, bands + 1, dtype=np.uint64) * MIX)
    for j in range(parts.shape[1]):
        key = scrambled(key ^ parts[:, j]) + MIX
    return scrambled(key).view(np.int64)


NAMES = ["doc_id", "h", "n", "hi", "lo", "bits", "keys"]


def signed_sets(docs: DataFrame, k: int, bands: int, width: int, key: str, text: str) -> DataFrame:
    """doc_id, h (hash of the text), n, hi, lo (the set's fingerprint), bits, keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = detours(bands * width)
        for part in jaccard.steps(batches, 1):
            sets = jaccard.shingle_sets(jaccard.texts_of(part.column(1)), k)
            ids = [jaccard.set_id(s) for s in sets]
            keys = [bucket_keys(signature(s, places), bands) if len(s) else np.zeros(0, np.int64) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in ids], pa.int64()), pa.array([b for _, b in ids], pa.int64()),
                 pa.array([jaccard.parity_bitmap(s) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], NAMES)

    given = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), jaccard.text_hash(text).alias("h"))
    return given.mapInArrow(tidied(run), "doc_id long, h long, n long, hi long, lo long, bits binary, keys array<long>")


def shared_buckets(reps: DataFrame, num: int, den: int) -> DataFrame:
    """token (a bucket's key), hi, node, n, pos, band, k (sets in the bucket), held and first (number
    and least key of the set's buckets), for buckets of several sets."""
    each = reps.select("hi", "node", "n", F.explode("keys").alias("token"))
    sizes = each.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = written(each.join(sizes, "token"), "minhash-shared")
    of_set = shared.groupBy("hi", "node").agg(F.count(F.lit(1)).alias("held"), F.min("token").alias("first"))
    return written(shared.join(of_set, ["hi", "node"]).select("token", "hi", "node", "n", F.lit(0).alias("pos"), jaccard.band(num, den).alias("band"), "k", "held", "first"), "minhash-buckets")


def star_tasks(buckets: DataFrame, num: int, den: int, cell: int) -> DataFrame:
    """Cells of candidate edges: in each bucket, stars around the set with most buckets and around
    one by hash."""
    by_hash = F.xxhash64("hi", "node")

    def spot(rank: Column) -> Column:
        return F.struct(rank.alias("rank"), by_hash.alias("at"), "hi", "node", "n")

    hubs = buckets.groupBy("token").agg(F.max(spot(F.col("held"))).alias("a"), F.min(spot(F.lit(0).cast("long"))).alias("b"))
    hubs = hubs.select("token", F.explode(F.array_distinct(F.transform(F.array("a", "b"), lambda p: F.struct(p["hi"].alias("xh"), p["node"].alias("x"), p["n"].alias("nx"))))).alias("p")).select("token", "p.*")
    hubs = written(hubs, "minhash-hubs")
    members = buckets.select("token", F.col("hi").alias("yh"), F.col("node").alias("y"), F.col("n").alias("ny"))
    other = (F.col("x") != F.col("y")) | (F.col("xh") != F.col("yh"))
    near = F.least("nx", "ny") * den >= F.greatest("nx", "ny") * num
    return jaccard.pair_tasks(members.join(hubs, "token").where(other & near).select("xh", "x", "yh", "y").distinct(), "s", cell)


def rooted(docs: DataFrame, k: int, num: int, den: int, key: str, text: str, bands: int, width: int, cell: int, block: int) -> DataFrame:
    """doc_id, n_shingles, node, root of every row: root is the least node of its class."""
    if not 0 < num <= den:
        raise ValueError("the threshold is a fraction in (0, 1]")
    if bands < 1 or width < 1:
        raise ValueError("a signature has a band of a bin at least")
    rows = written(signed_sets(docs, k, bands, width, key, text), "minhash-sets")
    sets = rows.select("doc_id", jaccard.node_of(F.col("doc_id"), F.col("h")).alias("node"), "n", "hi", "lo")
    some = sets.where("n > 0")
    with scratch(docs.sparkSession):
        reps = rows.where("n > 0").groupBy("hi", "lo").agg(F.min(jaccard.node_of(F.col("doc_id"), F.col("h"))).alias("rep"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits"), F.any_value("keys").alias("keys"))
        reps = written(reps.withColumnRenamed("lo", "node").withColumn("label", F.col("rep")), "minhash-reps")
        buckets = shared_buckets(reps, num, den)
        labels = reps.drop("keys")
        edges = jaccard.verified_edges(docs, some, labels, star_tasks(buckets, num, den, cell), k, num, den, key, text)
        roots = jaccard.components(edges)
        labels = labels.drop("label").join(roots.select(F.col("node").alias("rep"), F.col("root").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        labels = written(labels, "minhash-labels", keep=True)
        # A bucket of two sets is settled by its star.
        rest = written(jaccard.block_tasks(buckets.where("k > 2"), labels, block), "minhash-rest")
        named = labels.select("hi", "node", "label")
        if not rest.isEmpty():
            above = jaccard.components(jaccard.verified_edges(docs, some, labels, rest, k, num, den, key, text))
            named = named.join(above.select(F.col("node").alias("label"), "root"), "label", "left").select("hi", "node", F.coalesce("root", "label").alias("label"))
            named = written(named, "minhash-roots", keep=True)
    linked = some.join(named.select("hi", F.col("node").alias("lo"), F.col("label").alias("root")), ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "node", "root")
    alone = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), "node", F.col("node").alias("root"))
    return linked.unionByName(alone)


def minhash_classes(docs: DataFrame, k: int = 2, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text", bands: int = BANDS, width: int = WIDTH, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when ``den * intersection >= num * union`` of their sets of k-word
    shingles; a component's id is its smallest doc_id, whose rows are kept."""
    classes = rooted(docs, k, num, den, key, text, bands, width, cell, block)
    own = classes.select("doc_id", "n_shingles", F.when(~F.col("root.none"), F.col("root.id")).alias("component_id"))
    return own.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text", bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """One document of each class, that of the least doc_id, with all its columns.  A class without
    ids keeps the text of the least hash; texts without words are all kept, but for rows that repeat
    an id and text."""
    classes = rooted(docs, k, num, den, key, text, bands, width, CELL, BLOCK)
    kept = written(classes.where(F.col("node") == F.col("root")).select(F.col("node").alias("__node")).distinct(), "minhash-kept")
    marked = docs.withColumn("__node", jaccard.node_of(F.col(key), jaccard.text_hash(text)))
    return marked.join(kept, "__node", "left_semi").dropDuplicates(["__node"]).drop("__node")
