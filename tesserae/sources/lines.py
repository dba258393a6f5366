"""Lines of texts: numbered from 1, blank ones left out, white space kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import is_blank


def line_array(text: Column) -> Column:
    """All lines, without line ends; what follows a last line feed is no line."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def lines(df: DataFrame, file: str | Column, text: str | Column) -> DataFrame:
    """file, line, content of the lines that are not blank."""
    file = F.col(file) if isinstance(file, str) else file
    text = F.col(text) if isinstance(text, str) else text
    each = df.select(file.cast("string").alias("file"), F.posexplode(line_array(F.coalesce(text.cast("string"), F.lit("")))).alias("at", "raw"))
    return each.select("file", (F.col("at") + 1).alias("line"), F.when(F.contains("raw", F.lit("\r")), F.regexp_replace("raw", "\r$", "")).otherwise(F.col("raw")).alias("content")).where(~is_blank(F.col("content")))


#: Texts of one task.
TEXTS = 1000


def dealt(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` in tasks of about ``TEXTS`` rows, however few row groups their files have.  Rows of one id
    are dealt on by their texts.  The count reads footers."""
    n = -(-rows.count() // TEXTS)
    return rows.repartition(n, *[c for c in rows.columns if c != text], F.xxhash64(text)) if n > 1 else rows


def line_counts(df: DataFrame, file: str, text: str) -> DataFrame:
    """file, lines: all lines of each text, blank ones too."""
    return df.select(F.col(file).cast("string").alias("file"), F.size(line_array(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("lines"))
