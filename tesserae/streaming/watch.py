"""File changes as a stream.

A stream of ticks (its offsets are numbers) looks at the tree: each tick lists the watched files by
tasks into a table of its own number and compares it with the table of the tick before, by a join.
So new folders need no subscription, offsets do not grow with the tree, and a tick that is run again
after a failure finds its listing and patterns and sees the same changes.  The events of a tick go to
``foreachBatch``, which adds a layer with the changed files' rows to both indexes.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.config import Config, FtsConfig
from tesserae.functions.globs import any_match
from tesserae.operators.maintenance import delta, last_events
from tesserae.plans.blocks import block_postings
from tesserae.plans.search import line_index, line_statistics
from tesserae.sources.folder import Folder
from tesserae.sources.lines import line_counts, lines
from tesserae.sources.snapshot import Conflict, Store, View, read_index, write_delta
from tesserae.sources.tree import some_files, tree_entries
from tesserae.workspace import scratch, written

#: Milliseconds between two looks at the tree.
TICK_MS = 500


def debounced(events: DataFrame, tick_ms: int = TICK_MS) -> DataFrame:
    """tick, path, op: the last event of each path in each tick, from path, op, seq, ms."""
    ticks = events.withColumn("tick", F.floor(F.col("ms") / tick_ms).cast("long"))
    return ticks.groupBy("tick", "path").agg(F.max_by("op", "seq").alias("op"))


def debounced_stream(events: DataFrame, tick_ms: int = TICK_MS, lateness_ms: int = 10 * TICK_MS) -> DataFrame:
    """tick, path, op: the same over a stream of path, op, seq, ms, each row once.

    A tick is told when events ``lateness_ms`` younger than its end have come; until then late events
    count, in whatever order, and repeated ones make no difference.  Later ones are dropped, so the
    state holds the ticks of that span alone."""
    timed = events.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", f"{lateness_ms} milliseconds")
    ticks = timed.groupBy(F.window("at", f"{tick_ms} milliseconds").alias("w"), "path").agg(F.max_by("op", "seq").alias("op"))
    return ticks.select(F.floor(F.unix_millis("w.start") / tick_ms).cast("long").alias("tick"), "path", "op")


def relevant(events: DataFrame, config: Config) -> DataFrame:
    """Events of Go files and of files that the configuration names."""
    return events.where(F.col("path").endswith(".go") | any_match(F.col("path"), config.fts.include))


#: Listings that stay behind the newest.
KEPT = 2


def changes(before: DataFrame, now: DataFrame, number: int) -> DataFrame:
    """path, op, seq: what two listings (path, mtime_ns) tell apart."""
    both = before.select("path", F.col("mtime_ns").alias("was")).join(now.select("path", F.col("mtime_ns").alias("is")), "path", "full_outer")
    op = F.when(F.col("was").isNull(), "create").when(F.col("is").isNull(), "remove").when(F.col("was") != F.col("is"), "write")
    return both.select("path", op.alias("op"), F.lit(number).cast("long").alias("seq")).where("op is not null")


class Watch:
    """Looks at a tree: the listings of its ticks lie in ``folder``."""

    def __init__(self, spark: SparkSession, root: str, config: Config, folder: str, first: str = "now", config_path: str = "") -> None:
        self.spark, self.root, self.config, self.path, self.first, self.config_path = spark, root, config, folder, first, config_path
        self.folder = Folder(spark, folder)

    def include(self, number: int) -> list[str]:
        """The patterns of a tick: those of the configuration when it first ran."""
        now = Config.load(self.config_path) if self.config_path else self.config
        self.folder.create(f"{number}.json", json.dumps(now.fts.include))
        return json.loads(self.folder.read(f"{number}.json") or "[]")

    def listing(self, number: int) -> DataFrame:
        """The listing of a tick, made once."""
        path = f"{self.path}/{number}"
        if "_SUCCESS" not in self.folder.names(str(number)):
            found = tree_entries(self.spark, self.root, self.config.fts.exclude_dirs, dots=True)
            found.select("path", "mtime_ns").write.mode("overwrite").parquet(path)
        return self.spark.read.schema("path string, mtime_ns long").parquet(path)

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in self.folder.names() if n.isdigit())

    def events(self, number: int) -> DataFrame:
        """path, op, seq of the changes since the last tick before this one, of Go files and of files
        that the patterns name.  The first tick reports nothing, or with ``first='empty'`` all files."""
        include = self.include(number)
        now = self.listing(number)
        earlier = [n for n in self.numbers() if n < number]
        before = self.listing(earlier[-1]) if earlier else now.limit(0) if self.first == "empty" else now
        return relevant(changes(before, now, number), Config(FtsConfig(include, [], 0)))

    def tick(self, number: int, apply: Callable[[DataFrame], None]) -> None:
        """Apply the changes of a tick; older listings go afterwards."""
        with scratch(self.spark):
            events = written(self.events(number), "watch-events")
            if not events.isEmpty():
                apply(events)
        for n in self.numbers():
            if n < number - KEPT:
                self.folder.delete(str(n))
                self.folder.delete(f"{n}.json")


def start(watch: Watch, apply: Callable[[DataFrame], None], checkpoint: str, tick_ms: int = TICK_MS) -> StreamingQuery:
    """Run ``apply`` on the changes of each tick that has any."""
    ticks = watch.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: watch.tick(n, apply)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{tick_ms} milliseconds").start()


def apply_batch(symbols: Store, search: Store, config: Config, events: DataFrame) -> None:
    """One micro-batch of events into new snapshots: the symbol index for Go files, the line
    search for files the configuration names at this moment."""
    spark = events.sparkSession
    ops = last_events(relevant(events, config))
    rows = ops.collect()  # the files that changed within one tick
    if not rows:
        return
    gone = {r["path"] for r in rows if r["op"] in ("remove", "rename")}
    there = [r["path"] for r in rows if r["path"] not in gone]
    paths = spark.createDataFrame([(r["path"],) for r in rows], "path string")
    with scratch(spark):
        contents = some_files(spark, there)
        if any(r["path"].endswith(".go") for r in rows):
            write_symbols(symbols, paths.where(F.col("path").endswith(".go")), contents.where(F.col("path").endswith(".go")))
        named = [r["path"] for r in rows if config.matches_fts(r["path"])]
        if named:
            write_search(search, spark.createDataFrame([(p,) for p in named], "path string"), contents.where(F.col("path").isin(named) & (F.col("size") <= config.fts.max_file_size_kb * 1024)))


#: Tries of a change that another writer was faster than.
TRIES = 10


def write_symbols(symbols: Store, changed: DataFrame, contents: DataFrame) -> None:
    """Add a change to the symbol index.  What a change adds depends on the index below it, so it is
    worked out again where another writer changed that meanwhile."""
    for left in reversed(range(TRIES)):
        base = symbols.now()
        try:
            write_delta(symbols, changed, delta(read_index(base), changed, contents), base)
            return
        except Conflict:
            if not left:
                raise


def write_search(search: Store, changed: DataFrame, contents: DataFrame) -> None:
    """Replace the lines of ``changed`` by those of ``contents``: a layer with these files' rows, and
    by how much they change the numbers of lines, tokens and documents per term."""
    with scratch(contents.sparkSession):
        text = written(contents.withColumn("text", F.col("content").cast("string")).select("path", "mtime", "text"), "changed-texts")
        new = lines(text, "path", "text")
        meta = line_counts(text, "path", "text").withColumnRenamed("file", "path").join(text.select("path", "mtime"), "path")

        def statistics(base: View) -> dict[str, DataFrame]:
            old = base.read_or_empty("lines").join(changed.select(F.col("path").alias("file")), "file", "left_semi")
            corpus, counts = line_statistics(new, old)
            return {"corpus": corpus, "term_counts": counts}

        def whole(view: View) -> dict[str, DataFrame]:
            ls = view.read("lines")
            return {"lines": ls, "fts_meta": view.read("fts_meta")} | line_index(ls)

        search.append({"lines": new, "blocks": block_postings(new, new.count()), "fts_meta": meta}, changed, based=statistics, whole=whole)
