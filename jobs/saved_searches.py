"""Run saved searches over tables of texts and write what they find, ranked, partitioned by search.

The configuration lists searches: a name, a table, a match text and a limit (0: every matching line).
Each table is read once: its lines are cut into terms, and lines that hold a term of some search are
kept with these terms' places.  A search then works on the kept lines alone; its scores take the
number and length of all lines, counted on the way.  The output, written by ``partitionBy``, is
replaced whole: it holds what the configuration names, whatever it named before, so a rerun gives
the same result and leaves no rows of searches that were dropped or no longer match.

Output: search, source (the table), rank (0 without a limit), file, line, content, score (6 places).
Files are named by the columns of ``keys`` joined by a slash; rows that lack a key are left out; null
texts and blank lines have no lines.  ``work`` holds the kept lines of the last run; one run at a
time may use it.  Two searches of one name, and a table or match text that cannot
be read, are errors before anything is written.

    python -m jobs.saved_searches --input FOLDER --output FOLDER --work FOLDER
"""

from __future__ import annotations

import logging
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from jobs.options import options
from tesserae.plans.match import Node, Or, parse
from tesserae.plans.search import hits_of_lines, limit_of, ranked
from tesserae.sources.lines import dealt, lines
from tesserae.workspace import scratch

LOG = logging.getLogger("jobs.saved_searches")
#: The columns that name a file of each table.
KEYS = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"]}
SCHEMA = "source string, rank int, file string, line int, content string, score double, search string"


def text_lines(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """file, line, content of a table's texts."""
    rows = spark.read.parquet(path)
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    given = dealt(rows.select(*keys, F.col("text").cast("string").alias("text")))
    return lines(given.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).select(name.alias("file"), "text"), "file", "text")


def kept_lines(ls: DataFrame, nodes: list[Node], path: str) -> tuple[DataFrame, tuple[int, int]]:
    """The lines that hold a term of some search, written to ``path`` with their hits, and the
    number of lines and of terms of all."""
    seen = Observation()
    each = hits_of_lines(ls, nodes[0] if len(nodes) == 1 else Or(tuple(nodes)))
    # The number of a kept line tells lines of one name apart.
    each = each.withColumn("number", F.monotonically_increasing_id())
    each.observe(seen, F.count(F.lit(1)).alias("lines"), F.sum("len").alias("terms")).where(F.size("hits") > 0).write.mode("overwrite").parquet(path)
    counts = seen.get
    return ls.sparkSession.read.schema(each.schema).parquet(path), (counts.get("lines") or 0, counts.get("terms") or 0)


def found(hits: DataFrame, corpus: tuple[int, int], search: dict[str, Any], node: Node) -> DataFrame:
    """What one search finds, in the columns of the output."""
    order = [F.round("score", 9), F.col("file"), F.col("line")]
    if search["limit"]:
        # A limited search has few rows; their order is that of one small window.  Its matches carry
        # the numbers of lines, and contents are fetched for the best.
        scored = ranked(hits.withColumn("content", F.col("number")), node, corpus).select("file", "line", F.col("content").alias("number"), "score")
        best = scored.orderBy(*order).limit(limit_of(search["limit"])).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
        numbered = hits.select("number", "content").join(F.broadcast(best), "number")
    else:
        numbered = ranked(hits, node, corpus).select("file", "line", "content", "score").withColumn("rank", F.lit(0))
    return numbered.select(F.lit(search["table"]).alias("source"), "rank", "file", "line", "content", F.round("score", 6).alias("score"), F.lit(search["name"]).alias("search"))


def run(spark: SparkSession, input: str, output: str, work: str, searches: list[dict[str, Any]], keys: dict[str, list[str]] | None = None) -> int:
    """Run all searches over the tables ``input``/<table>.parquet; the number of rows written."""
    keys = KEYS | (keys or {})
    names = [s["name"] for s in searches]
    if len(set(names)) < len(names):
        raise ValueError("two searches have one name")
    if unknown := {s["table"] for s in searches} - keys.keys():
        raise ValueError(f"no keys for {', '.join(sorted(unknown))}")
    nodes = {s["name"]: parse(s["query"]) for s in searches}
    parts: list[DataFrame] = []
    with scratch(spark):
        for table in sorted({s["table"] for s in searches}):
            own = [s for s in searches if s["table"] == table]
            hits, corpus = kept_lines(text_lines(spark, f"{input}/{table}.parquet", keys[table]), [nodes[s["name"]] for s in own], f"{work}/{table}")
            LOG.info("%s: read %d lines of %d terms for %d searches", table, *corpus, len(own))
            parts += [found(hits, corpus, s, nodes[s["name"]]) for s in own]
        empty = spark.createDataFrame([], SCHEMA)
        reduce(DataFrame.unionByName, parts, empty).write.mode("overwrite").partitionBy("search").parquet(output)
    rows = results(spark, output).count()
    LOG.info("wrote %d rows of %d searches to %s", rows, len(searches), output)
    return rows


def results(spark: SparkSession, output: str) -> DataFrame:
    """The output read back."""
    return spark.read.schema(SCHEMA).parquet(output).select("search", "source", "rank", "file", "line", "content", "score")


def main() -> None:
    from tesserae.session import session

    o = options(__doc__.splitlines()[0], "saved_searches.json", input=None, output=None, work=None, searches=None, keys={})
    spark = session("saved-searches")
    try:
        run(spark, o["input"], o["output"], o["work"], o["searches"], o["keys"])
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
