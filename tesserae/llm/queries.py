"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import ann, bpe_automaton, fingerprints, jaccard, licenses, minhash, mixing, pages, sharding, threshold_search, token_files, toxicity
from tesserae.llm.common import table, tokenizer_file
from tesserae.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=40)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"), max_epochs=2.0)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_classes(table(spark, sf_dir, "documents"), k=2, num=4, den=5)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_sharding": op2_sharding,
    "op3_html": op3_html,
    "op4_toxicity": op4_toxicity,
    "op5_fingerprints": op5_fingerprints,
    "op6_licenses": op6_licenses,
    "op7_bpe": op7_bpe,
    "op8_token_files": op8_token_files,
    "op9_ann": op9_ann,
    "op10_mixing": op10_mixing,
    "op11_minhash": op11_minhash,
    "op12_search": op12_search,
}
