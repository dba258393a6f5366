"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: whole words and word beginnings that toxic training texts use ``lift``
times as often as clean ones, in ``share`` of the toxic texts at least and more often than chance
would have it (``sure``).  A text becomes a dozen
rates: lexicon hits by word and by weight, the densest window, hits near second-person words,
capitals, exclamation and question marks, symbols, words with digits or symbols inside letters
and hits among them once those are read as letters, repeated words, length.  Boosted trees of
logistic loss are fitted on most of the sampled training rows, and a monotone step function from
their margin to the label's rate on the rest, which neither trees nor lexicon have seen.

Training rows: labelled rows whose ``crc32(id as text) mod 5`` is not 0.  The lexicon is counted
over all of them (but for the calibration's) by the workers: toxic texts first, then the uses of
their frequent entries in clean texts.  Trees and calibration are fitted on the ``sample_rows``
ids first by hash (a bound on what the driver fits; 8,000 by default).  Id, language and source
never enter a feature.  Scoring is a map without shuffle over all whole texts.

Defined results: a null or empty text has all rates 0 and is scored like any other; equal texts
get equal scores; without labelled rows of both kinds every score is the rate of toxic labels
(0 without labels); of several labels of one id the highest counts; of several texts under one
labelled id all are counted for the lexicon and the least is sampled; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import hash_sample, scratch, tidied, written

WORDS = re.compile(r"[^\W\d_]+")
#: Letters with digits or symbols between them.
MASKED = re.compile(r"[^\W\d_]+(?:[0-9@$!*#+|]+[^\W\d_]+)+")
#: Digits and symbols that are written for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "*": "", "#": ""})
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Words on either side that count as near, and the width of the density window.
NEAR, WINDOW = 5, 50
#: Lengths of word beginnings that may enter the lexicon.
STEMS = (4, 5, 6, 7)
#: Estimated bytes of labelled ids up to which they are broadcast, and of one id and its label.
BROADCAST_BYTES, ID_BYTES = 64 << 20, 40
FEATURES = ("hits", "weighted", "log_hits", "distinct", "window", "second_person", "capitals", "exclaims", "questions", "symbols", "digits", "masked", "masked_hits", "repeats", "log_words")


def entries_of(word: str) -> list[str]:
    """Lexicon entries that a word can match: its beginnings, and itself closed by ``$``."""
    return [*(word[:k] for k in STEMS if len(word) >= k), f"{word}$"]


@dataclass
class Lexicon:
    """Entries and their weights; ``openings`` are first letters by which most words are passed over."""

    weights: dict[str, float]
    openings: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        self.openings = frozenset(e.rstrip("$")[: STEMS[0]] for e in self.weights)

    def weight(self, word: str) -> float:
        return max((self.weights.get(e, 0.0) for e in entries_of(word)), default=0.0)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of one whole text."""
    if not text:
        return [0.0] * len(FEATURES)
    at = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    chars = len(text)
    capitals, digits = int(at[65:91].sum()), int(at[48:58].sum())
    symbols = int(at[33:48].sum() + at[58:65].sum() + at[91:97].sum() + at[123:127].sum()) - int(at[44] + at[46] + at[33] + at[63])
    lower = text.lower()
    words = WORDS.findall(lower)
    n = len(words)
    hits = weighted = window = second = masked_hits = 0.0
    found: set[str] = set()
    masked = 0
    k = STEMS[0]
    opened = {w[:k] for w in words} & lexicon.openings
    if opened:
        places, weights = [], []
        known: dict[str, float] = {}
        for i, w in enumerate(words):
            if w[:k] in opened:
                value = known.get(w)
                if value is None:
                    value = known[w] = lexicon.weight(w)
                if value > 0:
                    places.append(i)
                    weights.append(value)
                    found.add(w)
        if places:
            hits, weighted = len(places), sum(weights)
            p = np.array(places)
            window = float((np.searchsorted(p, p + WINDOW) - np.arange(len(p))).max())
            second = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i in places)
    if digits or symbols or at[33]:
        inner = MASKED.findall(lower)
        masked = len(inner)
        masked_hits = sum(lexicon.weight(w.translate(LEET)) > 0 for w in inner)
    some = max(1, n)
    return [hits / some, weighted / some, float(np.log1p(hits)), len(found) / some, window / min(some, WINDOW), second / some, capitals / chars, int(at[33]) / chars, int(at[63]) / chars, symbols / chars, digits / chars, masked / some, masked_hits / some, 1 - len(set(words)) / some, float(np.log1p(n))]


@dataclass
class Trees:
    """Boosted trees: arrays of (feature, threshold, left, right, value), trees one after another."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 5, l2: float = 1.0) -> Trees:
    """Newton boosting of logistic loss over binned features."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    for j in range(m):  # quantiles of mostly equal values: cut the others by themselves
        rest = x[:, j][x[:, j] > np.median(x[:, j])]
        if len(cuts[j]) < bins // 2 and len(rest):
            cuts[j] = np.unique(np.concatenate([cuts[j], np.quantile(rest, np.linspace(0, 1, bins // 2))]))
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
    size = max(len(c) for c in cuts) + 1
    prior = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(prior / (1 - prior)))
    margin = np.full(n, base)
    nodes: list[list[float]] = []
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, 0, 0, 0.0])
        level = [(roots[-1], np.arange(n))]
        for at in range(depth + 1):
            below = []
            for node, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                nodes[node][2] = nodes[node][3] = node  # a leaf leads to itself
                nodes[node][4] = float(-rate * gs / (hs + l2))
                best = (1e-6, -1, -1)
                if at < depth and len(rows) >= 2 * least:
                    for j in range(m):
                        c = code[rows, j]
                        cg, ch, cn = (np.cumsum(np.bincount(c, v, size))[:-1] for v in (g[rows], h[rows], None))
                        gain = cg**2 / (ch + l2) + (gs - cg) ** 2 / (hs - ch + l2) - gs**2 / (hs + l2)
                        gain[(cn < least) | (len(rows) - cn < least)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0] and k < len(cuts[j]):
                            best = (float(gain[k]), j, k)
                if best[1] < 0:
                    margin[rows] += nodes[node][4]
                    continue
                _, j, k = best
                goes = code[rows, j] <= k
                nodes[node][:4] = [j, float(cuts[j][k]), len(nodes), len(nodes) + 1]
                nodes.append([0, 0.0, 0, 0, 0.0])
                nodes.append([0, 0.0, 0, 0, 0.0])
                below += [(int(nodes[node][2]), rows[goes]), (int(nodes[node][3]), rows[~goes])]
            level = below
    a = np.array(nodes)
    return Trees(base, a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots), depth)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block means over sorted margins, as points to interpolate between.
    The means rise from block to block."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for s, t in zip(margin[order], y[order], strict=True):
        blocks.append([t, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, n2, s2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2] + s2]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    steps: tuple[np.ndarray, np.ndarray] | None
    rate: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.rate)
        margin = self.trees.margin(x)
        raw = 1 / (1 + np.exp(-margin))
        # A little of the margin itself keeps the order inside a step.
        return np.clip(0.98 * np.interp(margin, *self.steps) + 0.02 * raw, 0.0, 1.0)


def labelled(labels: DataFrame, key: str, label: str) -> DataFrame:
    """key, y of the labelled ids outside the held-out fifth."""
    ok = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0)
    return ok.groupBy(F.col(key).cast("long").alias("id")).agg(F.max(label).cast("double").alias("y"))


def texts_of(docs: DataFrame, ids: DataFrame, rows: int, key: str, text: str) -> DataFrame:
    """id, text and the columns of ``ids`` (``rows`` rows), which goes to the texts while it is small."""
    small = rows * ID_BYTES <= BROADCAST_BYTES
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids) if small else ids, "id")


def summed(rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], names: tuple[str, ...]) -> DataFrame:
    """Counts by entry that tasks have made, added up."""
    schema = "entry string, " + ", ".join(f"{n} long" for n in names)
    return rows.select("text").mapInArrow(tidied(count), schema).groupBy("entry").agg(*[F.sum(n).alias(n) for n in names])


def toxic_entries(rows: DataFrame) -> DataFrame:
    """entry, docs, used over toxic texts; the empty entry counts texts and words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, docs = Counter(), Counter()
        for batch in batches:
            for text in batch.column(0):
                words = Counter(WORDS.findall((text.as_py() or "").lower()))
                seen = Counter({"": sum(words.values())})
                for w, n in words.items():
                    for e in entries_of(w):
                        seen[e] += n
                used.update(seen)
                docs.update(seen.keys())
        names = list(used)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([docs[e] for e in names], pa.int64()), pa.array([used[e] for e in names], pa.int64())], ["entry", "docs", "used"])

    return summed(rows, count, ("docs", "used"))


def clean_uses(rows: DataFrame, wanted: frozenset[str]) -> DataFrame:
    """entry, used over clean texts, for some entries; the empty entry counts words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        openings = frozenset(e.rstrip("$")[: STEMS[0]] for e in wanted)
        words: Counter = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0):
                found = WORDS.findall((text.as_py() or "").lower())
                total += len(found)
                words.update([w for w in found if w[: STEMS[0]] in openings])
        used: Counter = Counter()
        for w, n in words.items():
            for e in entries_of(w):
                if e in wanted:
                    used[e] += n
        names = ["", *used]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total, *used.values()], pa.int64())], ["entry", "used"])

    return summed(rows, count, ("used",))


def learn_lexicon(toxic: DataFrame, clean: DataFrame, share: float, lift: float, sure: float) -> Lexicon:
    """Entries that toxic texts use ``lift`` times as often as clean ones, found in ``share`` of
    the toxic texts at least (and in three), if that is ``sure`` standard deviations more use than
    entries without a side would have in toxic texts.  What comes to the driver is limited by ``share``: so
    many entries at most as a toxic text holds on average, divided by ``share``."""
    counted = written(toxic_entries(toxic), "toxicity-entries")
    total = counted.where("entry = ''").select("docs", "used").collect()
    if not total or not total[0]["used"]:
        return Lexicon({})
    found = counted.where(F.col("entry") != "").where(F.col("docs") >= max(3, int(share * total[0]["docs"]))).collect()
    uses = {r["entry"]: r["used"] for r in clean_uses(clean, frozenset(r["entry"] for r in found)).collect()}
    words1, words0 = total[0]["used"], max(1, uses.get("", 0))
    weights = {}
    for r in sorted(found, key=lambda r: r["entry"]):
        toxic_use, clean_use = r["used"], uses.get(r["entry"], 0)
        raised = toxic_use / (clean_use + 0.5) * words0 / words1
        expected = (toxic_use + clean_use) * words1 / (words1 + words0)
        if raised >= lift and toxic_use - expected >= sure * expected**0.5:
            weights[r["entry"]] = float(np.log(raised))
    return Lexicon(weights)


def train(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """Lexicon, trees and calibration from the labelled rows outside the held-out fifth; options
    are those of ``fitted``."""
    with scratch(docs.sparkSession):
        return fitted(docs, labels, **options)


def fitted(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, share: float = 0.015, lift: float = 8.0, sure: float = 5.0, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """``sample_rows`` labelled ids are taken for the trees and their calibration; the lexicon is
    counted over all labelled rows but those of the calibration."""
    ids = written(labelled(labels, key, label), "toxicity-ids")
    n_ids = ids.count()
    side = F.when(F.pmod(F.xxhash64(F.col("id"), F.lit(5)), F.lit(10)) < 3, 1).otherwise(0)
    picked = written(hash_sample(ids, sample_rows, "id").withColumn("apart", side), "toxicity-picked")
    # One text for an id, the least, so that there are no more rows than ids picked.
    rows = written(texts_of(docs, picked, sample_rows, key, text).groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("apart").alias("apart")), "toxicity-rows")
    sizes = {(r["apart"], r["y"] > 0.5): r["n"] for r in rows.groupBy("apart", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, toxic = sum(sizes.values()), sum(k for (_, y), k in sizes.items() if y)
    if not toxic or toxic == n:
        return Model(Lexicon({}), None, None, 0.0 if not n else toxic / n)
    # Too few rows to hold some apart: the same rows serve both.
    split = all(sizes.get((a, y), 0) for a in (0, 1) for y in (False, True))
    counted = ids.join(F.broadcast(picked.where("apart = 1").select("id")), "id", "left_anti") if split else ids
    every = texts_of(docs, counted, n_ids, key, text)
    lexicon = learn_lexicon(every.where("y > 0.5"), every.where("y <= 0.5"), share, lift, sure)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(v.as_py(), lexicon) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "apart"])

    got = rows.select("text", "y", "apart").mapInArrow(tidied(dense), "x array<double>, y double, apart int").toPandas()  # sample_rows rows of 15 numbers
    x, y, apart = np.stack(got["x"].to_numpy()), (got["y"].to_numpy() > 0.5).astype(float), got["apart"].to_numpy() == 1
    order = np.lexsort((*x.T, y, apart))  # the order of rows must not depend on tasks
    x, y, apart = x[order], y[order], apart[order] if split else np.zeros(len(y), bool)
    trees = fit_trees(x[~apart], y[~apart])
    held = apart if split else ~apart
    return Model(lexicon, trees, isotonic(trees.margin(x[held]), y[held]), float(y.mean()))


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = np.array([features(v.as_py(), m.lexicon) for v in batch.column(2)]).reshape(-1, len(FEATURES))
            s = m.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.select(F.col(key).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = np.array([features(v.as_py(), m.lexicon) for v in batch.column(at)]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(m.score(x) < 0.5))

    return docs.mapInArrow(tidied(run), docs.schema)
