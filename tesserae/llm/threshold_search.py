"""Ranked lexical search by Fagin's threshold algorithm, exact over all documents.

1. The terms that queries use are taken in blocks of queries of about ``block_bytes`` of text, so
   what is sent to tasks has a fixed bound however many queries there are; a block is one pass.
2. One pass over the documents writes a forward index: for each document its number of terms, and
   which of the block's terms it holds how often.  Numbers of documents, terms and documents per
   term are sums over that index.
3. Each task takes the forward index of its documents a chunk at a time and turns it into lists of
   (impact, document), one a term, highest impact first.  A query reads its lists round-robin
   (sorted access); each document seen for the first time is scored whole by its row of the forward
   index (random access).  It stops when the threshold, the sum of the impacts at which its lists
   stand, falls strictly below the k-th best score so far, that of earlier chunks of the task
   included; documents that were not seen score no more than the threshold, so ties are not lost.
4. Each task returns at most k documents a query; the best of them are found in two steps, first
   within shares of the tasks' rows, then of each query.

Statistics are those of the whole table and scores are 64-bit integers, so a document's score does
not depend on the chunk it is in.  A task holds a chunk (``chunk_rows`` postings) and k results a
query of the block; nothing of the documents comes to the driver but one row of sums for each of
the block's terms.

Terms are the maximal runs of letters and digits of ASCII and of all characters outside of it; only
A-Z are lower-cased.  With N documents that hold a term, L terms in all, n terms in a document, df
documents with a term and tf its occurrences: weight ``floor(1000 ln((2N + 2) / (2 df + 1)))``,
``m = 50 + (50 n N) div L``, score the sum of ``weight * ((10^9 tf) div (1000 tf + 20 m))`` over the
query's distinct terms.

Defined results: null and empty texts have no terms, are in no result and count for no statistic;
a query without terms, or whose terms no document has, has no rows; scores of 0 are left out; equal
scores go by ascending doc_id, a null doc_id after all others; repeated rows are documents of their
own; queries that repeat an id and text are one, different texts under one id are ranked
separately; long texts are read whole; other columns play no part; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import tidied, written

#: UTF-8 bytes of query texts in a block, on average.
BLOCK_BYTES = 4 << 20
#: Postings of a chunk.
CHUNK_ROWS = 1 << 20
#: Entries that a list gives in a first round; later rounds double it.
FIRST_ROUND = 16
#: Shares of the tasks' results of a query.
SHARES = 32
#: Bytes of terms: ASCII letters and digits, and all bytes of other characters; others become spaces.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return [t for t in text.translate(TERM_BYTES).split(b" ") if t] if text else []


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """doc_id, n (terms), terms, counts: for each document with a term, those of the vocabulary by
    number, and how often it holds each."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, sizes, ends, terms, counts = [], [], [0], [], []
            for doc_id, body in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                words = terms_of(body.as_py())
                if not words:
                    continue
                held = sorted(Counter(map(known.get, words)).items(), key=lambda x: -1 if x[0] is None else x[0])
                held = held[1:] if held[0][0] is None else held
                ids.append(doc_id.as_py())
                sizes.append(len(words))
                terms += [t for t, _ in held]
                counts += [c for _, c in held]
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], ["doc_id", "n", "terms", "counts"])

    given = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(tidied(run), "doc_id long, n long, terms array<int>, counts array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, terms: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each posting adds to a score."""
    m = 50 + (50 * n * n_docs) // max(n_terms, 1)
    return weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Chunk:
    """Some documents: their rows of the forward index, and the same postings as impact-sorted lists."""

    def __init__(self, ids: list[int | None], ends: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_known: int) -> None:
        self.ids, self.starts, self.terms, self.impact = ids, ends, terms, impact
        doc = np.repeat(np.arange(len(ids)), np.diff(ends))
        order = np.lexsort((-impact, terms))
        self.list_doc, self.list_impact = doc[order], impact[order]
        self.bounds = np.searchsorted(terms[order], np.arange(n_known + 1))

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Random access: the whole scores of some documents, from their rows of the forward index."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[docs] - (ends - sizes), sizes)
        part = np.where(wanted[self.terms[at]], self.impact[at], 0)
        total = np.concatenate([[0], np.cumsum(part)])
        return total[ends] - total[ends - sizes]

    def search(self, query: np.ndarray, wanted: np.ndarray, best: list[tuple[int, int | None]], k: int) -> tuple[list[tuple[int, int | None]], int]:
        """The k best of ``best`` and this chunk's documents, as (score, id), and the postings read.
        ``wanted`` marks the terms of the query."""
        lists = [(a, b) for a, b in zip(self.bounds[query].tolist(), self.bounds[query + 1].tolist(), strict=True) if a < b and self.list_impact[a] > 0]
        seen = np.zeros(len(self.ids), bool)
        depth, size, read = 0, FIRST_ROUND, 0
        while lists:
            threshold = sum(int(self.list_impact[a + depth]) for a, _ in lists)
            if len(best) == k and threshold < best[-1][0]:
                break
            docs = np.unique(np.concatenate([self.list_doc[a + depth : min(b, a + depth + size)] for a, b in lists]))
            read += sum(min(b, a + depth + size) - a - depth for a, b in lists)
            docs = docs[~seen[docs]]
            seen[docs] = True
            score = self.scores(docs, wanted)
            floor = best[-1][0] if len(best) == k else 1
            good = np.flatnonzero(score >= max(floor, 1))
            if len(good):
                found = [(s, self.ids[d]) for s, d in zip(score[good].tolist(), docs[good].tolist(), strict=True)]
                best = sorted(best + found, key=lambda x: (-x[0], x[1] is None, x[1]))[:k]
            depth += size
            size *= 2
            lists = [(a, b) for a, b in lists if a + depth < b]
        return best, read


def chunks_of(batches: Iterator[pa.RecordBatch], chunk_rows: int) -> Iterator[pa.Table]:
    """The rows of some batches, about ``chunk_rows`` postings at a time."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            held.append(part)
            size += len(part.column(2).flatten())
            if size >= chunk_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def best_of_tasks(index: DataFrame, queries: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, chunk_rows: int) -> DataFrame:
    """query (its number), doc_id, score: the k best of each task's documents."""
    shared = index.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        asked = [np.array(q, np.int64) for q in queries]
        best: list[list[tuple[int, int | None]]] = [[] for _ in queries]
        wanted = np.zeros(len(weights), bool)
        for rows in chunks_of(batches, chunk_rows):
            lists = rows.column("terms").combine_chunks()
            terms, tf = lists.flatten().to_numpy(), rows.column("counts").combine_chunks().flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy().astype(np.int64))
            n = np.repeat(rows.column("n").to_numpy(), sizes)
            chunk = Chunk(rows.column("doc_id").to_pylist(), np.concatenate([[0], np.cumsum(sizes)]), terms, impacts(weights, terms, tf, n, n_docs, n_terms), len(weights))
            for i, q in enumerate(asked):
                wanted[q] = True
                best[i], _ = chunk.search(q, wanted, best[i], k)
                wanted[q] = False
        flat = [(i, d, s) for i, found in enumerate(best) for s, d in found]
        columns = list(zip(*flat, strict=True)) if flat else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "doc_id", "score"])

    return index.mapInArrow(tidied(run), "query long, doc_id long, score long")


def first_k(df: DataFrame, k: int, *groups: str) -> DataFrame:
    """``df`` with rank, the k best of each group."""
    order = Window.partitionBy(*groups).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, block: list[tuple], k: int, key: str, text: str, chunk_rows: int) -> DataFrame:
    """item_id, rank, doc_id, score for a block of queries (id, text)."""
    spark = docs.sparkSession
    known: dict[bytes, int] = {}
    queries = [sorted({known.setdefault(t, len(known)) for t in terms_of(body.encode())}) for _, body in block]
    index = written(forward_index(docs, known, key, text), "threshold-forward")
    totals = index.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).collect()[0]
    weights = np.zeros(len(known), np.int64)
    # One row for each of the block's terms.
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        weights[r["term"]] = weight(totals["docs"], r["df"])
    best = best_of_tasks(index, queries, weights, totals["docs"], totals["terms"], k, chunk_rows)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))
    some = first_k(best.withColumn("share", share), k, "query", "share").drop("rank", "share")
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "query long, item_id long")
    return first_k(some, k, "query").join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of highest score for each query."""
    if k < 1:
        raise ValueError("k is at least 1")
    asked = items.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).collect()[0]["bytes"]
    blocks = max(1, -(-size // block_bytes))
    out = None
    for b in range(blocks):
        # About ``block_bytes`` of queries; their order is fixed so that reruns are equal.
        block = sorted((tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        found = search_block(docs, block, k, key, text, chunk_rows)
        out = found if out is None else out.unionByName(found)
    return out
