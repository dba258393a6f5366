"""The jobs as registered queries: each runs twice into one new folder, as a rerun would, and the
output is what stands there after the second run."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import saved_searches, term_index
from tesserae import oracle
from tesserae.workspace import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job1-term-index")
    for _ in range(2):
        # A pattern, as the table may be one file, which a stream does not take for a folder.
        term_index.run(spark, f"{sf_dir}/documents.parquet*", f"{at}/index", f"{at}/checkpoint")
    return term_index.current(spark, f"{at}/index")


def configured(name: str) -> dict:
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), name), encoding="utf-8") as f:
        return json.load(f)


def job2_saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job2-saved-searches")
    config = configured("saved_searches.json")
    for _ in range(2):
        saved_searches.run(spark, sf_dir, f"{at}/results", f"{at}/work", config["searches"], config["keys"])
    return saved_searches.results(spark, f"{at}/results")


def _search_sql(name: str, source: str, search: str, content: bool = True, rank: bool = True) -> str:
    """The ranked rows of a search of ``oracle`` as rows of the job."""
    number = "row_number() OVER (ORDER BY round(score, 9), file, line)::INT" if rank else "0::INT"
    inner = search.replace("round(score, 6) AS score", "score, content").replace("FROM scored", "FROM scored JOIN lines USING (file, line)")
    return f"SELECT '{name}' AS search, '{source}' AS source, {number} AS rank, file, line, content, round(score, 6) AS score FROM ({inner})"


_P = oracle.phrase
_TALK = oracle.ranked({"p": _P("p", ["the"]), "q": _P("q", ["of"])}, "p IS NOT NULL AND q IS NULL", {"q": "FALSE"}).replace("SELECT doc_id::VARCHAR AS file", "SELECT conv_id || '/' || turn AS file").replace("FROM documents", "FROM conversations")
JOB2 = "\nUNION ALL\n".join([
    _search_sql("common-word", "documents", oracle.ranked({"p": _P("p", ["that"])}, "p IS NOT NULL")),
    _search_sql("phrase", "documents", oracle.ranked({"p": _P("p", ["of", "the"])}, "p IS NOT NULL")),
    _search_sql("licences", "documents", oracle.ranked({"p": _P("p", ["license"]), "q": _P("q", ["licensed"])}, "p IS NOT NULL OR q IS NOT NULL", limit=None), rank=False),
    _search_sql("talk", "conversations", _TALK),
])

QUERIES = {"job1_term_index": job1_term_index, "job2_saved_searches": job2_saved_searches}
SQL = {
    "job1_term_index": f"WITH {oracle.TOKENS} SELECT term, file AS doc_id, count(*) AS tf, count(DISTINCT line) AS n_lines, min(line) AS first_line FROM t GROUP BY term, file",
    "job2_saved_searches": JOB2,
}
