import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.api import Engine
from tesserae.config import Config
from tesserae.functions.globs import any_match, matches
from tesserae.operators import aggregates, extract, lookups
from tesserae.operators import maintenance as m
from tesserae.schemas import FILES
from tesserae.sources import snapshot, tree
from tesserae.sources.snapshot import NoIndex, Store, read_index, write_index


def sources(spark, files):
    return spark.createDataFrame([(p, 1, len(t), bytearray(t.encode())) for p, t in files.items()], FILES)


def names(df):
    return sorted(r["name"] for r in df.collect())


def tables(i):
    key = lambda rows: sorted(tuple(r) for r in rows)
    return key(i.symbols.collect()), key(i.refs.collect()), key(i.idents.collect()), key(i.files.collect())


def changed(spark, i, new, removed=()):
    paths = spark.createDataFrame([(p,) for p in [*new, *removed]], "path string")
    return m.apply_changes(i, paths, sources(spark, new))


A, B = "package p\nfunc Old() {}\nfunc Keep() {}\n", "package q\nfunc Other() { Old() }\n"


def test_rename(spark):
    i = changed(spark, m.build(sources(spark, {"a.go": A, "b.go": B})), {"a.go": A.replace("Old", "New")})
    assert names(i.symbols) == ["Keep", "New", "Other"]


def test_drop_symbol(spark):
    i = changed(spark, m.build(sources(spark, {"a.go": A})), {"a.go": "package p\nfunc Keep() {}\n"})
    assert names(lookups.find_symbol(i.symbols, "Old")) == [] and names(lookups.list_symbols(i.symbols, "func")) == ["Keep"]


def test_shared_name(spark):
    i = m.build(sources(spark, {"a.go": "package a\nfunc Same() {}\n", "b.go": "package b\nfunc Same() {}\n"}))
    left = lookups.find_symbol(changed(spark, i, {"a.go": "package a\n"}).symbols, "Same").collect()
    assert [(r["pkg"], r["file"]) for r in left] == [("b", "b.go")]


def test_remove_file(spark):
    i = m.build(sources(spark, {"a.go": "package a\nvar V = 1\nfunc F() { V++ }\n", "b.go": "package b\nfunc G() {}\n"}))
    assert [r["kind"] for r in lookups.find_usages(i.refs, "V").collect()] == ["var_ref"]
    i = changed(spark, i, {}, ["a.go", "unknown.go"])
    assert names(i.symbols) == ["G"] and i.refs.count() == 0


def test_refs_updated(spark):
    i = m.build(sources(spark, {"a.go": "package a\nfunc Callee() {}\nfunc Caller() { Callee() }\n"}))
    assert lookups.calls_from(i.refs, "Caller").count() == 1
    i = changed(spark, i, {"a.go": "package a\nfunc Callee() {}\nfunc Caller() { }\n"})
    assert lookups.find_usages(i.refs, "Callee").count() == 0 and lookups.calls_from(i.refs, "Caller").count() == 0


def test_add_file(spark):
    i = changed(spark, m.build(sources(spark, {"a.go": A})), {"c.go": "package c\nfunc C() {}\n"})
    assert names(i.symbols) == ["C", "Keep", "Old"]


def test_dependents(spark):
    i = m.build(sources(spark, {"lib.go": "package l\nfunc Lib() { Lib() }\n", "c1.go": "package c\nfunc A() { Lib() }\n", "c2.go": "package c\nfunc B() { x.Lib() }\n", "u.go": "package u\nfunc U() {}\n"}))
    got = m.dependents(i, spark.createDataFrame([("lib.go",)], "path string"))
    assert sorted(r["path"] for r in got.collect()) == ["c1.go", "c2.go"]


def test_new_value_reaches_other_files(spark):
    i = m.build(sources(spark, {"a.go": "package a\n", "b.go": "package b\nfunc F() { return Limit }\n"}))
    i = changed(spark, i, {"a.go": "package a\nconst Limit = 1\n"})
    assert [(r["file"], r["kind"]) for r in lookups.find_usages(i.refs, "Limit").collect()] == [("b.go", "const_ref")]


BODIES = ["package p\nvar V = 1\nfunc F() { V++; G() }\n", "package p\nconst V = 2\nfunc G() { F() }\n", "package q\nfunc F() { V = 1 }\n", "package q\n", "broken {{{"]


@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from([*BODIES, None])), min_size=1, max_size=4))
@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
def test_changes_equal_a_full_build(spark, edits):
    state = {"a.go": BODIES[0], "b.go": BODIES[2]}
    i = m.build(sources(spark, state))
    for name, body in edits:
        path = f"{name}.go"
        if body is None:
            state.pop(path, None)
            i = changed(spark, i, {}, [path])
        else:
            state[path] = body
            i = changed(spark, i, {path: body})
    assert tables(i) == tables(m.build(sources(spark, state)))


def test_lookups(spark):
    s = spark.createDataFrame([("GetUser", "func"), ("getX", "method"), ("100%_sure", "const"), ("Zed", "struct")], "name string, kind string").withColumn("file", F.lit("f")).withColumn("ordinal", F.lit(0))
    assert names(lookups.search_symbols(s, "GET")) == ["GetUser", "getX"] and names(lookups.search_symbols(s, "%_")) == ["100%_sure"]
    assert names(lookups.search_symbols(s, "", "struct")) == ["Zed"] and names(lookups.list_symbols(s, "nokind")) == []
    assert [r["name"] for r in lookups.list_symbols(s, "all").collect()] == ["100%_sure", "GetUser", "Zed", "getX"]


def test_search_by_grams(spark, tmp_path, monkeypatch):
    """Patterns of one, two, three and more characters find what a scan of all names finds."""
    words = ["GetUser", "getUserName", "user", "U", "us", "Größe", "aaaa", "abcabcabd", "x_1%", "Get", "Serge", "", "ÜBER"]
    s = spark.createDataFrame([(w, ("func", "type")[i % 2], f"f{i}", 0) for i, w in enumerate(words * 2)], "name string, kind string, file string, ordinal int")
    grams = lookups.name_grams(s).unionByName(spark.createDataFrame([("use", "user of old"), ("r o", "user of old"), ("ser", "user of old")], "gram string, name string")).cache()
    for listed in (1000, 0):
        monkeypatch.setattr(lookups, "LISTED", listed)
        for pattern in ("", "u", "US", "ser", "user", "GETUSER", "aaaa", "aaaaa", "abcabd", "ße", "%", "über", "none", "a longer pattern than all the names"):
            for kind in ("", "type"):
                got, want = (sorted(tuple(r) for r in df.collect()) for df in (lookups.search_symbols_by_grams(s, grams, pattern, kind), lookups.search_symbols(s, pattern, kind)))
                assert got == want, (pattern, kind)
    grams.repartitionByRange(3, "gram", "name").sortWithinPartitions("gram", "name").write.parquet(f"{tmp_path}/g")
    plan = lookups.names_containing(spark.read.parquet(f"{tmp_path}/g"), "GetUserName")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [" in plan.split("PushedFilters")[1]


def test_known_values_last_wins(spark):
    s = extract.symbols_of(extract.scan_files(sources(spark, {"b.go": "package b\nconst X = 1\n", "a.go": "package a\nvar X = 1\n"})))
    assert [tuple(r) for r in extract.known_values(s).collect()] == [("X", "const")]


def test_sync_plan(spark):
    disk = spark.createDataFrame([("r/a", 1), ("r/b", 2), ("r/new", 3)], "path string, mtime long")
    stored = spark.createDataFrame([("r/a", 1), ("r/b", 9), ("r/gone", 1), ("s/else", 1)], "path string, mtime long")
    plan = dict(tuple(r) for r in m.sync_plan(disk, stored, ["r"]).collect())
    assert plan == {"r/a": "unchanged", "r/b": "index", "r/new": "index", "r/gone": "remove"}
    assert tuple(m.sync_counts(m.sync_plan(disk, stored)).collect()[0]) == (2, 1, 2)


def test_last_events(spark):
    e = spark.createDataFrame([("a", "write", 1), ("a", "remove", 2), ("b", "remove", 3), ("b", "create", 4)], "path string, op string, seq long")
    assert sorted(tuple(r) for r in m.last_events(e).collect()) == [("a", "remove"), ("b", "create")]
    assert [r["path"] for r in m.removals(m.last_events(e)).collect()] == ["a"]


def test_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path), retention=0)
    with pytest.raises(NoIndex):
        store.read("symbols")
    for k in range(4):
        write_index(store, m.build(sources(spark, {"a.go": f"package a\nfunc F{k}() {{}}\n"})))
        assert names(store.read("symbols")) == [f"F{k}"] and store.read("meta").collect()[0]["file_count"] == 1
    # Nobody may read a replaced version of this store: one is left.
    assert len([d for d in os.listdir(tmp_path) if d.startswith("v")]) == 1
    assert tables(read_index(store))[0][0][0] == "F3"
    plan = lookups.find_symbol(store.read("symbols"), "F3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,F3)" in plan


def test_layers_equal_a_full_build(spark, tmp_path, monkeypatch):
    """Changes written as layers, until they are written anew as one, read like a full build."""
    monkeypatch.setattr(snapshot, "LAYERS", 3)
    store = Store(spark, str(tmp_path))
    state = {"a.go": BODIES[0], "b.go": BODIES[2], "c.go": "package c\nfunc H() { F(V, W) }\n"}
    write_index(store, m.build(sources(spark, state)))
    for path, body in [("a.go", BODIES[1]), ("b.go", None), ("d.go", "package d\nvar W = V\n"), ("a.go", "package a\n"), ("a.go", BODIES[0])]:
        state = {p: t for p, t in (state | {path: body}).items() if t is not None}
        changed_ = spark.createDataFrame([(path,)], "path string")
        d = m.delta(read_index(store), changed_, sources(spark, {path: body}) if body else sources(spark, state).limit(0))
        assert {r["file"] for r in d.symbols.collect()} <= {path} >= {r["file"] for r in d.idents.collect()}
        snapshot.write_delta(store, changed_, d)
        assert tables(read_index(store)) == tables(m.build(sources(spark, state)))
        assert store.read("meta").collect()[0]["file_count"] == len(state)
        callers = sorted(tuple(r) for r in store.read("refs_by_caller").collect())
        assert callers == sorted(tuple(r) for r in store.read("refs").where("in_symbol != ''").collect())
        assert len(store.layers()) < 3


def test_a_file_that_cannot_be_scanned_is_set_apart(spark, tmp_path):
    """It is counted as an error, not as indexed, until a change can be scanned."""
    odd = spark.createDataFrame([("a.go", 1, 9, bytearray(b"package a\nfunc A() {}\n")), ("odd.go", 2, 0, None)], "path string, mtime long, size long, content binary")
    store = Store(spark, str(tmp_path))
    write_index(store, m.build(odd))
    assert [(r["file"], r["mtime"]) for r in store.read("errors").collect()] == [("odd.go", 2)] and store.read("errors").collect()[0]["error"]
    assert [r["file"] for r in store.read("files").collect()] == ["a.go"] and store.read("meta").collect()[0]["file_count"] == 1
    plan = m.sync_plan(odd.select("path", "mtime"), store.read("files").withColumnRenamed("file", "path"))
    assert tuple(m.sync_counts(plan).collect()[0]) == (1, 1, 0)
    again = spark.createDataFrame([("odd.go",)], "path string")
    snapshot.write_delta(store, again, m.delta(read_index(store), again, sources(spark, {"odd.go": "package a\nfunc B() {}\n"})))
    assert store.read("errors").count() == 0 and names(store.read("symbols")) == ["A", "B"] and store.read("meta").collect()[0]["file_count"] == 2
    engine = Engine(spark, str(tmp_path), str(tmp_path))
    engine.symbols = store
    write_index(store, m.build(odd))
    assert engine.stats()["failed"] == 1 and "failed:  1 (odd.go)" in engine.call("get_stats", {})


def test_tree(spark, tmp_path):
    for p in ("a.go", ".dot.go", "_u.go", "B.GO", "x_gen.go", "x.pb.go", "x_test.go", "c.yaml", "big.json", ".hid/h.go", "_und/u.go", "vendor/v.go", "testdata/t.go", "sub/deep/d.go", "n.txt"):
        os.makedirs(os.path.dirname(tmp_path / p), exist_ok=True)
        (tmp_path / p).write_text("x" * (60000 if p == "big.json" else 3))
    root = str(tmp_path)
    rel = lambda df: sorted(os.path.relpath(r["path"], root) for r in df.collect())
    files = tree.files(spark, root)
    assert rel(files.where(tree.is_symbol_source(F.col("path")))) == [".dot.go", "_u.go", "_und/u.go", "a.go", "sub/deep/d.go", "x.pb.go", "x_gen.go", "x_test.go"]
    rule = tree.is_search_source(F.col("path"), F.col("size"))
    assert rel(files.where(rule)) == [".dot.go", "B.GO", "_u.go", "_und/u.go", "a.go", "sub/deep/d.go", "x_test.go"]
    assert "c.yaml" in rel(files.where(tree.is_search_source(F.col("path"), F.col("size"), True))) and "big.json" not in rel(files.where(tree.is_search_source(F.col("path"), F.col("size"), True)))
    assert [r["shown"].rsplit("/", 1)[1] for r in tree.oversize(tree.listing(spark, root), "*.json", 50, []).collect()] == ["big.json (58.6KB)"]
    assert rel(tree.some_files(spark, [f"{root}/a.go", f"{root}/none.go"])) == ["a.go"]


def test_oversize_halves_to_even(spark):
    sizes = [2304, 2816, 3328, 2355, 2356, 1 << 40]
    big = spark.createDataFrame([(f"a/{n}.en", n) for n in sizes], "path string, size long")
    want = [f"a/{n}.en ({n / 1024:.1f}KB)" for n in sizes]
    assert want[:2] == ["a/2304.en (2.2KB)", "a/2816.en (2.8KB)"] and [r["shown"] for r in tree.oversize(big, "*.en", 2, []).collect()] == want


@pytest.mark.parametrize("pattern, name, yes", [("*.go", "a.go", True), ("*.go", "a.gox", False), ("?.go", "ab.go", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("a\\*", "a*", True), ("[", "[", False), ("*.GO", "a.go", False), ("a[]]", "a]", False), ("*", ".x", True)])
def test_globs(spark, pattern, name, yes):
    assert matches(pattern, name) == yes
    assert spark.createDataFrame([(f"d/{name}",)], "p string").where(any_match(F.col("p"), [pattern])).count() == int(yes)


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    assert Config.load(path) == Config() and Config().matches_fts("x/y.go")
    c = Config()
    c.fts.include.append("*.md")
    c.save(path)
    assert Config.load(path) == c
    (tmp_path / "c.json").write_text("{}")
    assert Config.load(path).fts.include == [] and Config.load(path).fts.max_file_size_kb == 0


def test_empty_aggregates(spark):
    none = spark.createDataFrame([], "path string, mtime long, lines int")
    assert tuple(aggregates.search_stats(none).collect()[0]) == (0, 0) and aggregates.last_indexed(none).collect()[0][0] is None
