"""Main text of web pages by nearest-URL page differencing.

A page is read into lines: the text of one block each, with character references decoded and
white space made single.  A line is *main* (inside an article or main element), *boiler* (inside
a menu, header, footer, sidebar, form, script, notice, advert or reader comment, told by element,
role, class or id) or *other*.  Pages are sorted by host and URL path; a page is compared with
the neighbour of its host whose path shares the longer beginning, the lines of both are aligned
by their longest common subsequence, and shared lines are deleted.  What an article element
holds is its page's own, so shared lines are deleted outside of it: in pages without one they
decide, and lines of pages with one that stand outside are left out.  Equal pages that follow each
other are one page in this; pages whose every line is shared are compared with the other neighbour,
and keep their lines if that says no more.

Sorting and neighbours need no task that holds a host: rows are dealt to buckets of about equal
bytes between quantiles of (host, path, id), taken from a bounded sample of keys that only decides
how evenly rows are dealt; the first and last row of each bucket are also sent to the bucket next
to it, and each task is dealt the same number of buckets.

Defined results: a null page is empty, a null URL is the empty path of the empty host; empty
pages and pages of boilerplate give the empty text; a single page of a host has nothing shared;
repeated rows give repeated results; long pages are read whole; an empty table gives an empty
result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import hash_sample, shuffle_parts, tidied

MAIN, OTHER, BOILER = 0, 1, 2
#: Elements whose text is never shown or never main text.
NO_TEXT = frozenset("script style noscript template svg math iframe object canvas head title select textarea button audio video".split())
BOILER_TAGS = frozenset("nav header footer aside form dialog menu".split())
MAIN_TAGS = frozenset("article main".split())
RAW_TAGS = frozenset("script style noscript template svg iframe textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var del ins label".split())
#: Parts of class and id names, and roles, that mark boilerplate.
HINTS = frozenset("ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice alert newsletter subscribe subscription signup popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead related recommended share sharing social toolbar pagination pager login search".split())
#: Marks that undo an article or main element too: other hints on it tell of its layout.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
COMMENTS = frozenset("comment comments disqus respond replies reply".split())
#: Elements of a head; any other one opens the body.
HEAD_TAGS = frozenset("head html title base link meta style script noscript template".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(class|id|role|hidden|aria-label)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def hinted(attributes: str, hints: frozenset[str] = HINTS) -> int:
    """0: no mark of boilerplate; 1: a mark; 2: a mark of reader comments."""
    found = 0
    for m in NAMES.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            found = max(found, int(value.strip() in ROLES))
        elif name == "hidden" and not value:
            found = max(found, 1)
        elif name in ("class", "id"):
            parts = set(re.split(r"[^a-z]+", value))
            found = max(found, 2 if parts & COMMENTS else int(bool(parts & hints)))
    return found


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of the blocks of a page that have text, in page order."""
    out: list[tuple[str, int]] = []
    page = page or ""
    held: list[str] = []
    kind = OTHER
    # (tag, kind outside it, weak): weak marks may be undone by a main element inside
    stack: list[tuple[str, int, bool]] = []
    open_: dict[str, int] = {}
    weak = False

    def close_line() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, kind))

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            held.append(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), m[3] or ""
        if tag == "br":
            held.append(" ")
            continue
        if tag not in INLINE:
            close_line()
        if closing:
            if open_.get(tag):
                while stack:
                    name, before, was_weak = stack.pop()
                    open_[name] -= 1
                    if before != kind:
                        close_line()
                    kind, weak = before, was_weak
                    if name == tag:
                        break
            continue
        if not closing and open_.get("head") and stack[-1][0] == "head" and tag not in HEAD_TAGS:
            close_line()
            _, kind, weak = stack.pop()
            open_["head"] -= 1
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        new, new_weak = kind, weak
        hint = hinted(attributes, ADVERTS if tag in MAIN_TAGS else HINTS) if attributes and tag not in ("html", "body") else 0
        if tag in NO_TEXT or tag in BOILER_TAGS:
            new, new_weak = BOILER, tag in BOILER_TAGS and tag not in ("aside", "dialog")
        elif hint:
            new, new_weak = BOILER, hint == 1 and tag not in MAIN_TAGS
        elif tag in MAIN_TAGS and (kind != BOILER or weak):
            new, new_weak = MAIN, False
        if kind == BOILER and new == BOILER:
            new_weak = weak and new_weak
        if new != kind:
            close_line()
        stack.append((tag, kind, weak))
        open_[tag] = open_.get(tag, 0) + 1
        kind, weak = new, new_weak
    close_line()
    return out


def shared_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of ``a`` lie on a longest common subsequence of both: rows of the table are
    kept as bits of whole numbers, and walked back."""
    shared = [False] * len(a)
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        shared[head] = True
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        shared[len(a) - 1 - tail] = True
        tail += 1
    mid, other = a[head : len(a) - tail], b[head : len(b) - tail]
    where: dict[str, int] = {}
    for j, line in enumerate(other):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(other)) - 1
    bits, rows = full, []
    for line in mid:
        hit = bits & where.get(line, 0)
        bits = ((bits + hit) | (bits - hit)) & full
        rows.append(bits)
    i, j = len(mid), len(other)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            shared[head + i] = True
            j -= 1
    return shared


def main_text(lines: list[tuple[str, int]], neighbours: list[list[str]]) -> str:
    """The text of a page, given the lines of its neighbours, nearest first."""
    if any(kind == MAIN for _, kind in lines):
        return " ".join(text for text, kind in lines if kind == MAIN)
    own = [i for i, (_, kind) in enumerate(lines) if kind == OTHER]
    texts = [text for text, _ in lines]
    for other in neighbours:
        shared = shared_lines(texts, other)
        if not all(shared[i] for i in own):
            own = [i for i in own if not shared[i]]
            break
    return " ".join(texts[i] for i in own)


URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)")


def host_and_path(url: str | None) -> tuple[str, str]:
    m = URL.match(url or "")
    host = (m[1] or "").rpartition("@")[2].lower() if m else ""
    return host, (m[2] if m else "").rstrip("/")


def common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def page_rows(pages: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """k (host, path and id as one sort key), page_id, url, host, path, lines, kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                rows = []
                for i, u, h in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                    host, path = host_and_path(u)
                    lines = lines_of(h)
                    # Lines that can never be kept are needed for the alignment only.
                    rows.append((sort_key(host, path, i), i, u, host, path, [t for t, _ in lines], [k for _, k in lines]))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32())), strict=True)], ["k", "page_id", "url", "host", "path", "lines", "kinds"])

    return pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(text).cast("string")).mapInArrow(tidied(run), "k string, page_id long, url string, host string, path string, lines array<string>, kinds array<int>")


def sort_key(host: str, path: str, page_id: int | None) -> str:
    return f"{host}\x01{path}\x01{0 if page_id is None else page_id + (1 << 63):020d}"


def edges(keys: DataFrame) -> dict[str, list[int]]:
    """For keys (k, h: a hash of the page, b: bucket) the buckets that rows are also sent to: each
    bucket gets the nearest row before it, and the nearest behind it, that differs from its own
    first, or last, page.  A few rows a bucket come here."""
    first, last = F.min(F.struct("k", "h")).alias("first"), F.max(F.struct("k", "h")).alias("last")
    ends = {r["b"]: r for r in keys.groupBy("b").agg(first, last).collect()}
    if len(ends) < 2:
        return {}
    known = keys.sparkSession.createDataFrame([(b, r["first"]["h"], r["last"]["h"]) for b, r in ends.items()], "b int, first_h long, last_h long")
    turns = keys.join(F.broadcast(known), "b").groupBy("b").agg(F.min(F.when(F.col("h") != F.col("first_h"), F.struct("k", "h"))).alias("next"), F.max(F.when(F.col("h") != F.col("last_h"), F.struct("k", "h"))).alias("before")).collect()
    inside = {r["b"]: r for r in turns}
    order = sorted(ends)
    sent: dict[str, list[int]] = {}
    for row, end, turn in ((order, "first", "next"), (order[::-1], "last", "before")):
        # Walking towards the bucket: the nearest row so far, and the nearest that differs from it.
        near = other = None
        for b in reversed(row):
            edge = ends[b]["last" if end == "first" else "first"]
            found = next((x for x in (near, other) if x is not None and x["h"] != edge["h"]), None)
            if found is not None:
                sent.setdefault(found["k"], []).append(b)
            if inside[b][turn] is not None:
                other = inside[b][turn]
            elif near is not None and near["h"] != ends[b][end]["h"]:
                other = near
            near = ends[b][end]
    return sent


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", sample_keys: int = 20_000) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    parts = shuffle_parts(spark)

    @F.pandas_udf("string")
    def key_of(u: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series([sort_key(*host_and_path(a), None if b is None else int(b)) for a, b in zip(u, i, strict=True)], dtype=object)

    keys = pages.select(key_of(F.col(url).cast("string"), F.col(key).cast("long").cast("string")).alias("k"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).alias("size"), F.xxhash64(F.col(text).cast("string")).alias("h"))
    # Buckets of about equal bytes, a few for each task.
    seen = sorted((r["k"], r["size"] + 64) for r in hash_sample(keys, sample_keys, "k").collect())
    n = min(4 * parts, len(seen))
    upto = list(accumulate(size for _, size in seen))
    bounds = sorted({seen[bisect_left(upto, i * upto[-1] / n)][0] for i in range(1, n)}) if n else []

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series([bisect_left(bounds, x) for x in k])

    sent = edges(keys.select("k", "h", bucket("k").alias("b")))
    rows = page_rows(pages, key, url, text).withColumn("b", bucket("k"))
    # Two rows a bucket at most: as many as eight times the tasks.
    to = spark.createDataFrame(list(sent.items()), "k string, to array<int>")
    own = F.array(F.struct(F.col("b").alias("bucket"), F.lit(0).alias("carried")))
    more = F.transform("to", lambda b: F.struct(b.alias("bucket"), F.lit(1).alias("carried")))
    rows = rows.join(F.broadcast(to), "k", "left").withColumn("d", F.explode(F.when(F.col("to").isNotNull(), F.concat(own, more)).otherwise(own)))
    dealt = rows.select("d.bucket", "d.carried", "k", "page_id", "url", "host", "path", "lines", "kinds")
    # Neighbouring buckets go to one task, the same number to each.
    dealt = dealt.repartitionById(parts, F.floor(F.col("bucket") * parts / (len(bounds) + 1)).cast("int")).sortWithinPartitions("bucket", "k", "carried")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Equal pages that follow each other are a run, compared once with the pages around it.
        before: dict | None = None
        row: dict | None = None
        same: list[tuple[int | None, str | None]] = []
        out: list[tuple] = []

        def settle(after: dict | None) -> None:
            if row is None or not same:
                return
            near = [r for r in (after, before) if r is not None and r["bucket"] == row["bucket"] and r["host"] == row["host"]]
            near.sort(key=lambda r: -common(r["path"], row["path"]))
            found = main_text(list(zip(row["lines"], row["kinds"], strict=True)), [r["lines"] for r in near])
            out.extend((i, u, found, len(found)) for i, u in same)
            same.clear()

        def flush(most: int = 1024) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(out), most):
                cols = list(zip(*out[at : at + most], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "text", "n_chars"])
            out.clear()

        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                for after in whole.slice(start, 1024).to_pylist():
                    if row is None or any(after[c] != row[c] for c in ("bucket", "host", "lines", "kinds")):
                        settle(after)
                        before, row = row, after
                    if not after["carried"]:
                        same.append((after["page_id"], after["url"]))
                yield from flush()
        settle(None)
        yield from flush()

    return dealt.mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long")
