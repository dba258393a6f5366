"""Small inputs that hold every odd case: nulls, empty and long texts, ties, repeated rows, extra
columns whose names clash with names inside the operators."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
BASE = " ".join(f"word{i % 97} is{i % 13}" for i in range(120))
LONG = " ".join(f"long{i} text{i % 7}" for i in range(9000))
TEXTS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, BASE + " changed", "en", "a"),
    (4, "", "en", "b"),
    (5, None, "de", "b"),
    (6, "one", None, None),
    (7, "one two", "en", None),
    (8, LONG, "en", "c"),
    (9, LONG + " more words", "en", "a"),
    (10, " \t\n ", "en", "a"),
    (11, "Licensed under the Apache License, Version 2.0. Grüße 日本語 <|endoftext|>", "de", "c"),
    (12, "don't  stop here\r\nnow.\tReleased under the MIT License.", "fr", "c"),
    (12, "don't  stop here\r\nnow.\tReleased under the MIT License.", "fr", "c"),
    (None, "no id here at all", "en", "a"),
    (14, BASE.upper(), "en", "d"),
]
CLASHES = ("shard", "slot", "bucket", "epochs", "rest", "mark", "key", "block", "token", "node", "rep", "n", "k", "c", "text_crc32", "size", "id", "score", "mix_weight", "mix_epoch", "lo", "hi", "y", "u", "v")


def documents(spark, rows=None):
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], SCHEMA)


def clashing(df):
    """The same rows with extra columns."""
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
