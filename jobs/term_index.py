"""Keep a term index of a growing table of texts: each run takes the files that are new.

A file stream with availableNow reads Parquet files that the checkpoint does not know yet, in batches
of ``files_per_batch`` files.  A batch is indexed and written as one partition ``batch=<number>`` of
two tables, by dynamic partition overwrite; the checkpoint gives a batch that was cut off the same
number and files again, so it is replaced by itself:

* ``terms``: batch, part, term, doc_id, tf, n_lines, first_line; in ranges of parts and terms, sorted
  by term, so that a lookup reads one part and few row groups.
* ``documents``: batch, doc_id, n_lines, n_tokens.

A document that comes again is indexed again; ``current`` takes each document as its latest batch
has it.  So a null text takes a document out.  Rows without an id are left out, and counted in the
log; rows of one id in one batch count as one text each with lines of their own numbering; blank
lines have no terms.  An empty or unchanged input adds nothing.

    python -m jobs.term_index --input FOLDER --output FOLDER --checkpoint FOLDER
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.options import options
from tesserae.functions.text import tokens
from tesserae.plans.search import marked_tokens
from tesserae.sources.lines import dealt, line_array, lines

LOG = logging.getLogger("jobs.term_index")
TERMS = "batch long, part int, term string, doc_id string, tf long, n_lines long, first_line int"
DOCUMENTS = "batch long, doc_id string, n_lines int, n_tokens int"


def part_of(term: str | Column, parts: int) -> Column:
    """The part that a term is in."""
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def terms_of(docs: DataFrame, parts: int) -> DataFrame:
    """part, term, doc_id, tf, n_lines, first_line of texts (doc_id, text)."""
    each = marked_tokens(lines(docs, "doc_id", "text"))
    found = each.groupBy(F.col("file").alias("doc_id"), "term").agg(F.count(F.lit(1)).alias("tf"), F.sum("first").alias("n_lines"), F.min("line").alias("first_line"))
    return found.select(part_of("term", parts).alias("part"), "term", "doc_id", "tf", "n_lines", "first_line")


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (blank ones too), n_tokens of texts."""
    text = F.coalesce("text", F.lit(""))
    return docs.groupBy("doc_id").agg(F.sum(F.size(line_array(text))).cast("int").alias("n_lines"), F.sum(F.size(tokens(text))).cast("int").alias("n_tokens"))


def write_batch(rows: DataFrame, batch: int, output: str, parts: int) -> None:
    """Index one batch and replace its partition of both tables; documents come last, so that
    ``current`` sees a batch when it is whole."""
    given = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs, mark = dealt(given).where("doc_id is not null"), F.lit(batch).cast("long").alias("batch")
    placed = terms_of(docs, parts).select(mark, "*").repartitionByRange("part", "term", "doc_id").sortWithinPartitions("part", "term", "doc_id")
    for name, of_batch, by in (("terms", placed, ["batch", "part"]), ("documents", sizes_of(docs).select(mark, "*"), ["batch"])):
        of_batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{output}/{name}")
    # These counts read footers, and the ids alone.
    added = [table(rows.sparkSession, output, name).where(F.col("batch") == batch).count() for name in ("terms", "documents")]
    LOG.info("batch %d: read %d rows, %d of them without an id; wrote %d terms of %d documents to %s", batch, given.count(), given.where("doc_id is null").count(), *added, output)


def run(spark: SparkSession, input: str, output: str, checkpoint: str, parts: int = 16, files_per_batch: int = 256) -> int:
    """Index what is new in ``input`` (a folder of Parquet files with doc_id and text, or a pattern of
    such folders and files); the number of batches."""
    schema = spark.read.parquet(input).select("doc_id", "text").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(input)
    stream = rows.writeStream.foreachBatch(lambda df, n: write_batch(df, n, output, parts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    done = sum(1 for p in stream.recentProgress if p["numInputRows"])
    LOG.info("%s: %d new batches from %s", output, done, input)
    return done


def table(spark: SparkSession, output: str, name: str) -> DataFrame:
    """``terms`` or ``documents`` with the rows of all batches."""
    schema = {"terms": TERMS, "documents": DOCUMENTS}[name]
    return spark.read.schema(schema).parquet(f"{output}/{name}").select([c.split()[0] for c in schema.split(", ")])


def latest(spark: SparkSession, output: str, terms: DataFrame) -> DataFrame:
    """term, doc_id, tf, n_lines, first_line: of some rows of ``terms`` those of each document's
    latest batch.  What is joined are the rows that a later batch replaced, not all documents."""
    each = table(spark, output, "documents").groupBy("doc_id").agg(F.collect_set("batch").alias("batches"))
    replaced = each.where(F.size("batches") > 1).select("doc_id", F.explode(F.array_except("batches", F.array(F.array_max("batches")))).alias("batch"))
    return terms.join(replaced, ["doc_id", "batch"], "left_anti").select("term", "doc_id", "tf", "n_lines", "first_line")


def current(spark: SparkSession, output: str) -> DataFrame:
    """term, doc_id, tf, n_lines, first_line: each document as its latest batch has it."""
    return latest(spark, output, table(spark, output, "terms"))


def lookup(spark: SparkSession, output: str, term: str, parts: int = 16) -> DataFrame:
    """doc_id, tf, n_lines, first_line of the documents that hold a term, most frequent first; reads
    the folders of the term's part."""
    of_term = table(spark, output, "terms").where((F.col("part") == part_of(F.lit(term), parts)) & (F.col("term") == term))
    return latest(spark, output, of_term).drop("term").orderBy(F.col("tf").desc(), "doc_id")


def main() -> None:
    from tesserae.session import session

    o = options(__doc__.splitlines()[0], "term_index.json", input=None, output=None, checkpoint=None, parts=16, files_per_batch=256)
    spark = session("term-index")
    try:
        run(spark, o["input"], o["output"], o["checkpoint"], o["parts"], o["files_per_batch"])
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
