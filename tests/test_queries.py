"""Every registered query against its SQL, over the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tesserae import queries
from tesserae.operators import extract
from tesserae.oracle import SQL
from tesserae.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cells(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    want = db.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert cells(df.columns, got) == cells(columns, want.fetchall()) and got


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables are not here")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_go_files_are_scanned_by_bounded_tasks(spark, sf, monkeypatch):
    whole = sorted(tuple(r) for r in queries.go_files(spark, sf).collect())
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(queries, "PART_CALLS", n // 9)
    files = queries.go_files(spark, sf)
    # More rows are more tasks, whatever the session's number of shuffle partitions; the scan has no wider ones.
    assert files.rdd.getNumPartitions() == 10 == extract.scan_files(files).rdd.getNumPartitions()
    assert sorted(tuple(r) for r in files.collect()) == whole
