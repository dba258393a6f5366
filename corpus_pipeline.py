"""A training-data pipeline over ``documents``: reject toxic texts, keep one document of each
class of near copies, mix sources by temperature, encode with BPE.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the
columns of ``documents`` (others that ``docs`` may have are left out); the last returns the token
digests of each row.  An empty table goes through all stages and gives an empty result.  Texts are
read whole at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import bpe_automaton, jaccard, mixing, toxicity
from tesserae.llm.common import shared_path, table, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below 0.5; the model is fitted on labelled rows of ``docs``.

    Null and empty texts are scored like others; equal texts share their fate; rows without an id
    are scored and never learned from; without labels of both kinds every row scores the rate of
    toxic labels (0 without labels).  The order of rows and repeated rows make no difference."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class: five-word shingles, similarity 0.8.

    Null and empty texts and texts of white space are in no class: without an id all are kept, of
    others one for each id and text.  Of rows with the same id and text one is kept; different texts
    under one id, or under none, are documents of their own.  A class none of whose members has an
    id keeps one of them, the least by a hash of its text."""
    return jaccard.one_of_each(docs.select(*COLUMNS), k=5, num=4, den=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once at least; rows of small sources again, until no source is read more than
    twice as often as another.

    A null source is a source of its own.  Texts without words are drawn with their source's whole
    epochs; a source without words is read once.  Repeated rows are drawn alike."""
    return mixing.mix(docs.select(*COLUMNS), max_epochs=2.0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row.

    A null or empty text has no tokens; a null id stays null; repeated rows give repeated results."""
    return bpe_automaton.encode_digests(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_copies", one_of_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A learned model takes part, so SQL cannot express the rows; see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
