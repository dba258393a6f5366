import math
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from tesserae.functions.snippet import snippet
from tesserae.functions.text import terms_of, tokens
from tesserae.plans import blocks, search
from tesserae.plans.blocks import Layered, block_postings
from tesserae.plans.match import QuerySyntaxError, parse
from tesserae.sources.lines import lines
from tesserae.sources.snapshot import Store, laid_out, read_lines
from tesserae.workspace import scratch, shared_dir

EXTRA = ["func parse_config(path string) error {", "// TODO: parse config not found", "GetUser getUserName GETX", "Café naïve Straße", "a b c d e f g h i j k l m n o p q r needle s t u v w x y z needle end", "x²y don't ½ Ł"]
QUERIES = ["that", "parse_config", '"not found"', "get*", "cafe", "needle", "the of", '"of the"', 'to OR "of the"', "that NOT the", "NEAR(the of, 1)", "NEAR(the of in)", "NEAR(\"of the\" in, 3)", "NEAR(the the of, 2)", "NEAR(th* \"of the\" to, 40)", "^the", "th*", '"of th"*', '(to AND the) OR "of the"', "in + the", "the the", "content:that", "file:that OR with", "(that OR with) NOT (the AND of)", '"" OR that', "missingword"]
BAD = ["NOT found", "a.go", "()", "", "foo-bar", '"foo', "*", "a AND", "(a", "a)", "zz:a", "NEAR(a b, x)", "a + ", "^", "a AND NOT b", "(a) b", "a,b"]


@pytest.fixture(scope="module")
def corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("f"), "text")
    extra = spark.createDataFrame([(f"x{i}", t) for i, t in enumerate(EXTRA)], "f string, text string")
    found = lines(docs.unionByName(extra), "f", "text").cache()
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE fts USING fts5(content, file UNINDEXED, line UNINDEXED, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search in this library")
    db.executemany("INSERT INTO fts VALUES (?, ?, ?)", [(r["content"], r["file"], r["line"]) for r in found.collect()])
    return found, db


@pytest.mark.parametrize("query", QUERIES)
def test_like_the_standard_library(corpus, query):
    found, db = corpus
    want = {(f, int(n)): (s, t) for f, n, s, t in db.execute("SELECT file, line, rank, snippet(fts, 0, '>>>', '<<<', '...', 12) FROM fts WHERE fts MATCH ?", (query,))}
    got = {(r["file"], r["line"]): r["score"] for r in search.all_matches(found, query).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k][0], rel_tol=1e-9, abs_tol=1e-12) for k in got)
    node = parse(query)
    text = {(r["file"], r["line"]): r["content"] for r in found.collect()}
    assert {k: snippet(text[k], node) for k in want} == {k: t for k, (_, t) in want.items()}


@pytest.mark.parametrize("query", BAD)
def test_errors_like_the_standard_library(corpus, query):
    _, db = corpus
    with pytest.raises(sqlite3.OperationalError) as theirs:
        db.execute("SELECT rowid FROM fts WHERE fts MATCH ?", (query,)).fetchall()
    with pytest.raises(QuerySyntaxError) as ours:
        parse(query)
    assert str(ours.value) == str(theirs.value)
    assert ours.value.friendly.startswith("invalid search query") == ("fts5" in str(theirs.value))


def indexed(found):
    tables = {k: v.cache() for k, v in search.line_index(found).items()}
    return Layered([tables["blocks"]], None, found, tables["corpus"], tables["term_counts"])


@pytest.fixture(scope="module")
def index(corpus):
    """Blocks of few lines, so that small limits leave most of them out."""
    patch = pytest.MonkeyPatch()
    patch.setattr(blocks, "BLOCK_LINES", 16)
    patch.setattr(blocks, "STRETCH", 4)
    made = indexed(corpus[0])
    made.layers[0].count()
    patch.undo()
    return made


def rows_of(df):
    return [(r["file"], r["line"], round(r["score"], 9)) for r in df.collect()]


@pytest.mark.parametrize("query", ["that", "that OR with", "the AND of", "the of in", "that NOT the", "(to AND the) OR that", "(to AND the) OR (of NOT in)", "the OR the", "missingword OR that", "missingword", "missingword AND that", '(to AND the) OR "of the"', "th*", "^the", "NEAR(the of, 1)", "file:that OR with"])
@pytest.mark.parametrize("limit", [1, 4, 20, 1000])
def test_index_and_scan_agree(corpus, index, query, limit):
    assert rows_of(search.search_index(index, query, limit)) == rows_of(search.search_lines(corpus[0], query, limit))


@pytest.mark.parametrize("picked", [0, 2000])
def test_blocks_that_cannot_matter_are_left_out(index, monkeypatch, picked):
    """Counted: a search for two terms unpacks under a fifth of the blocks of the common one, whether
    the blocks after the first are named or joined."""
    monkeypatch.setattr(search, "PICKED", picked)
    total = index.corpus.collect()[0]
    rows = index.layers[0]
    for query in ("the OR needle", "the AND of", "the"):
        node = parse(query)
        with scratch(rows.sparkSession):
            best, read = search.best_by_blocks(index, node, blocks.single_terms(node), (total["lines"], total["tokens"]), 3)
        assert len(best) == 3 and read < rows.where("term = 'the'").count() / (5 if query != "the AND of" else 1)


def test_bounds_are_reached(index):
    """The (tf, len) pairs of a block are those of its lines that no other line betters."""
    for r in index.layers[0].where("term in ('the', 'that', 'needle', 'of')").collect():
        lines_ = {(len(h["at"]), h["len"]) for h in r["hits"]}
        want = {(f, n) for f, n in lines_ if not any((g >= f and m <= n and (g, m) != (f, n)) for g, m in lines_)}
        assert {tuple(x) for x in r["best"]} == want


def test_a_long_file_is_many_blocks(spark):
    one = spark.range(20_000).selectExpr("'f' AS file", "cast(id AS int) AS line", "concat('same ', id) AS content")
    sizes = [len(r["hits"]) for r in search.line_index(one)["blocks"].where("term = 'same'").collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 8 * blocks.BLOCK_LINES


def test_blocks_are_made_by_bounded_tasks(spark, sf, monkeypatch):
    found = lines(spark.read.parquet(f"{sf}/documents.parquet").limit(20), "doc_id", "text")
    whole = sorted(map(tuple, search.line_index(found)["blocks"].collect()))
    n = search.line_statistics(found)[0].collect()[0]["tokens"]
    monkeypatch.setattr("tesserae.plans.blocks.PART_TOKENS", n // 10)
    blocks = search.line_index(found)["blocks"]
    # More tokens are more tasks, whatever the session's number of shuffle partitions.
    assert blocks.rdd.getNumPartitions() >= 10 and sorted(map(tuple, blocks.collect())) == whole


def test_blocks_shuffle_the_text_once(spark, sf, monkeypatch):
    """No array of terms and no row of a block is shuffled: the text of the lines alone."""
    monkeypatch.setattr("tesserae.plans.blocks.PART_TOKENS", 2000)
    found = lines(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    plan = laid_out(search.line_index(found)["blocks"], "blocks")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 == plan.count("Exchange hashpartitioning(block")
    assert "array" not in plan.split("Exchange ")[1].split("Project ")[1].split("\n")[0] and "split(" in plan.split("Exchange ")[0]


def test_segments_are_searched_as_one_index(spark, corpus, tmp_path, monkeypatch):
    """Each file is sorted by term and has blocks of its own."""
    monkeypatch.setattr("tesserae.plans.blocks.PART_TOKENS", 2000)
    store = Store(spark, f"file:{tmp_path}/s")
    store.write({"lines": corpus[0]} | search.line_index(corpus[0]))
    files = spark.read.parquet(f"{store.current()}/blocks").inputFiles()
    rows = [[(r["term"], r["block"]) for r in spark.read.parquet(f).select("term", "block").collect()] for f in files]
    numbers = [{b for _, b in r} for r in rows]
    assert len(files) > 3 and all(r == sorted(r) for r in rows) and sum(map(len, numbers)) == len(set.union(*numbers))
    for query in ("the OR needle", "that NOT the", '(to AND the) OR "of the"'):
        assert rows_of(search.search_index(read_lines(store), query, 20)) == rows_of(search.search_lines(corpus[0], query, 20))


def test_block_places(spark):
    toks = spark.createDataFrame([("a", 1, ["x", "y", "x"]), ("a", 2, []), ("b", 1, ["x"])], "file string, line int, toks array<string>")
    rows = {r["term"]: r for r in block_postings(toks, 3).collect()}
    assert [tuple(h) for h in rows["x"]["hits"]] == [("a", 1, 3, [0, 2]), ("b", 1, 1, [0])] and [tuple(h) for h in rows["y"]["hits"]] == [("a", 1, 3, [1])]
    assert [tuple(b) for b in rows["x"]["best"]] == [(1, 1), (2, 3)] and set(rows) == {"x", "y"}


def test_searches_leave_no_tables(spark, corpus, index):
    """The shared folder holds no more after twenty searches than before."""
    at = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    for query in ("that", "the AND of", '"of the"', "th*", "NEAR(the of)") * 2:
        search.search_index(index, query, 5).collect()
        search.search_lines(corpus[0], query, 5).collect()
    assert set(os.listdir(at)) == before


def test_empty_table(spark):
    none = spark.createDataFrame([], "file string, line int, content string")
    assert search.search_lines(none, "NEAR(a b) OR c").collect() == []
    assert search.search_index(indexed(none), "c").collect() == search.search_index(indexed(none), '"c d"').collect() == []
    assert search.term_stats(none).collect() == []


def test_limits():
    assert [search.limit_of(x) for x in (None, 0, -1, 7)] == [50, 50, 50, 7]


def test_tokens_in_both_languages(spark):
    texts = [*EXTRA, "", "  ", "ÀÉÎõü ßẞ İı", "snake_case camelCase 1,5", "日本語 テスト"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tokens(F.col("t")).alias("x")).collect():
        if "İ" not in r["t"]:
            assert r["x"] == terms_of(r["t"]), r["t"]


def test_lines(spark):
    df = spark.createDataFrame([("a", "one\r\n\n \t\n two\n"), ("b", ""), ("c", None), ("d", "x\n\ny")], "f string, text string")
    got = [tuple(r) for r in lines(df, "f", "text").orderBy("file", "line").collect()]
    assert got == [("a", 1, "one"), ("a", 4, " two"), ("d", 1, "x"), ("d", 3, "y")]


@pytest.mark.parametrize("content, query, shown", [
    ("func parse_config(path string) error {", "parse config", "func >>>parse<<<_>>>config<<<(path string) error {"),
    ("// TODO: parse config not found", '"not found"', "// TODO: parse config >>>not found<<<"),
    ("Café naïve", "cafe", ">>>Café<<< naïve"),
    ("a b c d e f g h i j k l m n o p q r needle s t u v w x y z needle end", "needle", "...r >>>needle<<< s t u v w x y z >>>needle<<< end"),
])
def test_snippets(content, query, shown):
    assert snippet(content, parse(query)) == shown


def test_plan_reads_one_term(spark, corpus, tmp_path):
    found, _ = corpus
    search.line_index(found)["blocks"].repartitionByRange(4, "term", "block").sortWithinPartitions("term", "block").write.parquet(f"{tmp_path}/p")
    hits = search.hits_of_postings(blocks.postings_of(spark.read.parquet(f"{tmp_path}/p")), parse("that"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,that)" in plan.split("PushedFilters: [")[1].split("]")[0]
