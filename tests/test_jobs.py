import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import registered, saved_searches, term_index
from tesserae.plans.match import QuerySyntaxError

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def texts(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(path)


def by_hand(docs):
    """(term, doc_id, tf, n_lines, first_line) of ASCII texts."""
    out = []
    for i, text in docs.items():
        found: dict[str, list[int]] = {}
        for n, line in enumerate((text or "").split("\n"), 1):
            for w in "".join(c if c.isalnum() else " " for c in line.lower()).split():
                found.setdefault(w, []).append(n)
        out += [(w, str(i), len(at), len(set(at)), at[0]) for w, at in found.items()]
    return sorted(out)


def state(spark, at):
    return sorted(tuple(r) for r in term_index.current(spark, f"{at}/index").collect())


def files_of(path):
    return sorted(os.path.join(d, x) for d, _, names in os.walk(path) for x in names if x.endswith(".parquet"))


def index(spark, at, **more):
    return term_index.run(spark, f"{at}/in", f"{at}/index", f"{at}/checkpoint", parts=4, **more)


def test_index_over_growing_input(spark, tmp_path):
    """Two runs over input that grows: the second reads the new file alone; a document that comes
    again, or goes, replaces itself; a third run over the same input changes nothing."""
    at = str(tmp_path)
    first = {1: "Alpha beta\nalpha", 2: "gone soon\n\nbeta beta", 3: None}
    texts(spark, [(i, t, "en") for i, t in first.items()] + [(None, "nameless words", "en")], f"{at}/in")
    assert index(spark, at) == 1
    assert state(spark, at) == by_hand(first)
    old = files_of(f"{at}/index")
    second = {1: "Alpha changed", 2: None, 4: "new\nbeta"}
    texts(spark, [(i, t, "de") for i, t in second.items()], f"{at}/in")
    assert index(spark, at) == 1
    assert set(old) <= set(files_of(f"{at}/index"))
    assert state(spark, at) == by_hand(first | second)
    newest = files_of(f"{at}/index")
    assert index(spark, at) == 0 and files_of(f"{at}/index") == newest
    assert [tuple(r) for r in term_index.lookup(spark, f"{at}/index", "beta", 4).collect()] == [("4", 1, 1, 2)]
    assert sorted(tuple(r)[1:] for r in term_index.table(spark, f"{at}/index", "documents").collect())[-1] == ("4", 2, 2)


def test_a_batch_cut_off_is_replaced_by_itself(spark, tmp_path, monkeypatch):
    """A run fails after the terms of a batch are written; the next one writes them again, once."""
    at = str(tmp_path)
    docs = {i: f"word{i} shared\nshared" for i in range(20)}
    for i in range(4):
        texts(spark, [(d, t, "en") for d, t in docs.items() if d % 4 == i], f"{at}/in")
    sizes = term_index.sizes_of
    calls = []

    def failing(rows):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return sizes(rows)

    monkeypatch.setattr(term_index, "sizes_of", failing)
    with pytest.raises(Exception, match="lost"):
        index(spark, at, files_per_batch=2)
    monkeypatch.undo()
    index(spark, at, files_per_batch=2)
    assert state(spark, at) == by_hand(docs)
    assert term_index.table(spark, f"{at}/index", "terms").count() == len(by_hand(docs))


def test_index_of_equal_ids_and_odd_columns(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([(1, "a b", 1, "x"), (1, "a c", 2, "x"), (2, "", 3, "x")], "doc_id long, text string, batch int, term string").write.parquet(f"{at}/in")
    index(spark, at)
    assert state(spark, at) == [("a", "1", 2, 2, 1), ("b", "1", 1, 1, 1), ("c", "1", 1, 1, 1)]


def test_empty_input(spark, tmp_path):
    at = str(tmp_path)
    texts(spark, [], f"{at}/in")
    index(spark, at)
    assert state(spark, at) == []


SEARCHES = [
    {"name": "one", "table": "documents", "query": "needle", "limit": 2},
    {"name": "all", "table": "documents", "query": "needle OR hay*", "limit": 0},
    {"name": "none", "table": "talk", "query": "needle", "limit": 5},
]


def tables(spark, at):
    spark.createDataFrame([(1, "needle one\nhay\n\nneedle needle"), (2, "haystack needle three four"), (3, None), (None, "needle nameless")], "doc_id long, text string").write.mode("overwrite").parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 2, "hay"), (1, None, "needle")], "conv_id long, turn long, text string").write.mode("overwrite").parquet(f"{at}/talk.parquet")


def search(spark, at, searches):
    saved_searches.run(spark, at, f"{at}/results", f"{at}/work", searches, {"talk": ["conv_id", "turn"]})
    return sorted(tuple(r)[:-1] for r in saved_searches.results(spark, f"{at}/results").collect())


def test_saved_searches_and_reruns(spark, tmp_path):
    at = str(tmp_path)
    tables(spark, at)
    got = search(spark, at, SEARCHES)
    assert got == [
        ("all", "documents", 0, "1", 1, "needle one"), ("all", "documents", 0, "1", 2, "hay"), ("all", "documents", 0, "1", 4, "needle needle"), ("all", "documents", 0, "2", 1, "haystack needle three four"),
        ("one", "documents", 1, "1", 4, "needle needle"), ("one", "documents", 2, "1", 1, "needle one"),
    ]
    assert search(spark, at, SEARCHES) == got
    assert sorted(os.listdir(f"{at}/results"))[-2:] == ["search=all", "search=one"]
    # A search that was dropped, or finds nothing any more, leaves no rows.
    spark.createDataFrame([(7, "other")], "doc_id long, text string").write.mode("overwrite").parquet(f"{at}/documents.parquet")
    assert search(spark, at, SEARCHES[:1]) == []
    tables(spark, at)
    assert {r[0] for r in search(spark, at, SEARCHES[:1])} == {"one"}


def test_saved_searches_fail_before_writing(spark, tmp_path):
    at = str(tmp_path)
    tables(spark, at)
    before = search(spark, at, SEARCHES)
    for bad, error in (([SEARCHES[0]] * 2, ValueError), ([SEARCHES[0] | {"table": "unknown"}], ValueError), ([SEARCHES[0] | {"query": "a AND"}], QuerySyntaxError)):
        with pytest.raises(error):
            search(spark, at, bad)
    assert sorted(tuple(r)[:-1] for r in saved_searches.results(spark, f"{at}/results").collect()) == before


def test_no_searches_and_empty_tables(spark, tmp_path):
    at = str(tmp_path)
    tables(spark, at)
    assert search(spark, at, []) == []
    for name, schema in (("documents", "doc_id long, text string"), ("talk", "conv_id long, turn long, text string")):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{at}/{name}.parquet")
    assert search(spark, at, SEARCHES) == []


def test_command_lines(spark, sf, tmp_path):
    """Both jobs from the shell, with a configuration file and arguments over it."""
    at = str(tmp_path)
    os.makedirs(f"{at}/in")
    shutil.copy(f"{sf}/documents.parquet", f"{at}/in/first.parquet")
    with open(f"{at}/index.json", "w") as f:
        json.dump({"input": f"{at}/nowhere", "output": f"{at}/index", "checkpoint": f"{at}/checkpoint", "parts": 2}, f)
    for args in (["term_index", "--config", f"{at}/index.json", "--input", f"{at}/in"], ["saved_searches", "--input", sf, "--output", f"{at}/found", "--work", f"{at}/work"]):
        done = subprocess.run([sys.executable, "-m", f"jobs.{args[0]}", *args[1:]], cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"BENCH_CPUS": "2"})
        assert done.returncode == 0, done.stderr[-2000:]
        assert "read" in done.stderr and "wrote" in done.stderr
    assert term_index.current(spark, f"{at}/index").count() > 1000
    assert saved_searches.results(spark, f"{at}/found").count() > 0
    assert subprocess.run([sys.executable, "-m", "jobs.term_index"], cwd=ROOT, capture_output=True, text=True, timeout=100).returncode == 2


def test_registered_jobs_keep_the_session(spark, sf):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.sources.partitionOverwriteMode")}
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, job in registered.QUERIES.items():
        df = job(spark, sf)
        columns = sorted(df.columns)
        got = sorted(repr(tuple(r)) for r in df.select(columns).collect())
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({registered.SQL[name]})").fetchall()
        assert got == sorted(map(repr, want)) and got, name
    assert before == {k: spark.conf.get(k) for k in before}


def test_texts_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    """A file of one row group is one task's; its texts are dealt on, those of one id too."""
    from tesserae.sources import lines

    monkeypatch.setattr(lines, "TEXTS", 10)
    texts(spark, [(7, f"text {i}", "en") for i in range(100)], f"{tmp_path}/documents.parquet")
    cut = saved_searches.text_lines(spark, f"{tmp_path}/documents.parquet", ["doc_id"])
    own = [r["count"] for r in cut.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(own) == 100 and len(own) > 5 and max(own) < 40
