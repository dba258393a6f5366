import io
import json
import os
import random
import time

import pytest

from tesserae import api, cli
from tesserae.config import Config
from tesserae.streaming import watch
from tesserae.workspace import shared_dir


@pytest.fixture
def engine(spark, tmp_path):
    (tmp_path / "a.go").write_text("package a\n\nconst Limit = 3\n\ntype T struct{}\n\n// Run it; not found\nfunc (t *T) Run() error {\n\tHelp(Limit)\n\treturn nil\n}\n")
    (tmp_path / "b.go").write_text("package a\n\nfunc Help(n int) {}\n")
    os.makedirs(tmp_path / ".tesserae")
    e = api.Engine(spark, str(tmp_path))
    return e


def test_no_index(engine):
    assert engine.call("find_symbol", {"name": "x"}).startswith("error: no index")


def test_tools(engine, tmp_path):
    assert engine.call("rebuild_index", {}) == "Symbol index rebuilt: 2 files | 4 symbols | 2 refs"
    assert engine.call("update_fts", {}) == "FTS updated: 2 indexed, 0 unchanged, 0 removed"
    assert engine.call("update_fts", {}) == "FTS updated: 0 indexed, 2 unchanged, 0 removed"
    p = str(tmp_path)
    assert engine.call("find_symbol", {"name": "Run"}) == f"[method] (T) Run\n  file: {p}/a.go:8\n  pkg:  a\n  sig:  func (T) Run() error\n\n"
    assert engine.call("find_usages", {"name": "Help"}) == f"Usages of 'Help' (1):\n  {p}/a.go:9  ← T.Run\n"
    assert engine.call("calls_from", {"symbol": "T.Run"}) == f"Calls inside 'T.Run' (2):\n  Help()  at {p}/a.go:9\n  Limit()  at {p}/a.go:9\n"
    assert engine.call("search_symbols", {"pattern": "li", "kind": "const"}) == f"Found 1 symbol(s) matching 'li':\n\n[const    ] Limit  {p}/a.go:3\n             sig: const Limit = 3\n"
    assert engine.call("full_text_search", {"query": '"not found"'}) == f'Found 1 result(s) for "\\"not found\\"":\n\n{p}/a.go:7\n  // Run it; >>>not found<<<\n\n'
    assert engine.call("full_text_search", {"query": "a.go"}).startswith("error: invalid search query")
    assert engine.call("full_text_search", {"query": "zzz"}) == "No results for: zzz"
    for tool, arg in (("find_symbol", "name"), ("find_usages", "name"), ("search_symbols", "pattern"), ("calls_from", "symbol"), ("full_text_search", "query")):
        assert engine.call(tool, {}) == f"error: {arg} is required"
    assert "symbols: 4" in engine.call("get_stats", {})


def test_update_config(engine, tmp_path):
    (tmp_path / "big.md").write_text("x" * 60 * 1024)
    said = engine.call("update_config", {"addFTSPattern": "*.md"})
    assert "limit of 50KB" in said and "big.md (60.0KB)" in said and "*.md is a search pattern now" in said
    assert "pattern already" in engine.call("update_config", {"addFTSPattern": "*.md"})
    assert "Refused" in engine.call("update_config", {"addFTSPattern": "*"})
    assert "no search pattern any more" in engine.call("update_config", {"removeFTSPattern": "*.md"}) and "was no search pattern" in engine.call("update_config", {"removeFTSPattern": "*.md"})
    assert "by hand" in engine.call("update_config", {"maxFileSizeKB": 501}) and json.loads(engine.call("get_config", {}))["fts"]["maxFileSizeKB"] == 501


def test_json_rpc(engine):
    lines = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "ping"}, {"id": 3, "method": "tools/list"}, {"id": 4, "method": "tools/call", "params": {"name": "none"}}, {"id": 5, "method": "tools/call", "params": 3}, {"id": 6, "method": "other"}, {"id": 7, "method": "tools/call", "params": {"name": "get_config"}}]
    source = io.BytesIO(b"not json\n\n" + "".join(json.dumps(x) + "\n" for x in lines).encode())
    sink = io.StringIO()
    cli.serve(engine, source, sink, follow=False)
    got = {x["id"]: x for x in map(json.loads, sink.getvalue().splitlines())}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7} and len(got[3]["result"]["tools"]) == 10
    assert [got[k]["error"]["code"] for k in (4, 5, 6)] == [-32601, -32600, -32601]
    assert got[1]["result"]["protocolVersion"] == "2024-11-05" and "include" in got[7]["result"]["content"][0]["text"]


def test_commands(engine, tmp_path):
    run = cli.commands(engine)
    assert run["index"]() == "symbols: 4 | refs: 2 | files: 2\nfts: 2 indexed, 0 unchanged, 0 removed"
    assert run["list"]("struct") == f"[struct   ] T\t{tmp_path}/a.go:5" and run["list"]("none") == 'No symbols (kind="none")'
    assert run["stats"]().startswith("files: 2 | indexed: ") and run["fts-update"]() == "fts-update: 0 indexed, 2 unchanged, 0 removed"
    assert run["find"]("nothing") == "No symbol found: nothing" and "Help" in run["search"]("help")
    os.remove(tmp_path / "b.go")
    assert run["fts-update"]() == "fts-update: 0 indexed, 1 unchanged, 1 removed"
    engine.index_file(str(tmp_path / "a.go"))
    engine.remove_file(str(tmp_path / "a.go"))
    assert run["fts"]("package") == "No results for: package"


def test_init(tmp_path, monkeypatch, capsys):
    (tmp_path / ".gitignore").write_text("x")
    assert len(cli.init(str(tmp_path))) == 2 and cli.init(str(tmp_path)) == []
    assert (tmp_path / ".gitignore").read_text() == "x\n.tesserae/\n"
    monkeypatch.chdir(tmp_path)
    assert cli.main([]) == 1 and cli.main(["nothing"]) == 1 and cli.main(["find"]) == 1
    capsys.readouterr()


def wait_for(there, seconds=90):
    end = time.time() + seconds
    while time.time() < end and not there():
        time.sleep(0.3)


def test_watching(engine, tmp_path):
    engine.rebuild()
    engine.sync_search()
    config = engine.config()
    seen = []

    def apply(events):
        seen.extend(r["path"] for r in events.collect())
        watch.apply_batch(engine.symbols, engine.search, config, events)

    looks = watch.Watch(engine.spark, str(tmp_path), config, str(tmp_path / ".tesserae" / "listings"))
    q = watch.start(looks, apply, str(tmp_path / ".tesserae" / "watch"))
    try:
        wait_for(lambda: len(looks.numbers()) > 1)
        os.makedirs(tmp_path / "sub")
        (tmp_path / "sub" / "c.go").write_text("package c\nfunc Fresh() { Help(1) }\n")
        (tmp_path / "note.txt").write_text("ignored")
        os.remove(tmp_path / "b.go")
        wait_for(lambda: len(engine.find_symbol("Fresh").collect()) and not engine.find_symbol("Help").collect() and engine.full_text("fresh").collect())
        # Offsets are numbers, whatever the tree holds; few listings stay.
        assert len(str(q.lastProgress["sources"][0]["endOffset"])) < 80
        assert len(looks.numbers()) <= watch.KEPT + 2
    finally:
        q.stop()
    assert sorted(os.path.basename(p) for p in seen) == ["b.go", "c.go"]
    assert [r["file"] for r in engine.find_usages("Help").orderBy("file").collect()] == [f"{tmp_path}/a.go", f"{tmp_path}/sub/c.go"]
    assert [r["line"] for r in engine.full_text("fresh").collect()] == [2]


def test_a_pattern_added_while_watching(engine, tmp_path):
    engine.rebuild()
    engine.sync_search()
    engine.config().save(engine.config_path)
    looks = watch.Watch(engine.spark, str(tmp_path), engine.config(), str(tmp_path / ".tesserae" / "listings"), config_path=engine.config_path)
    q = watch.start(looks, lambda df: watch.apply_batch(engine.symbols, engine.search, engine.config(), df), str(tmp_path / ".tesserae" / "watch"))
    try:
        wait_for(lambda: looks.numbers())
        engine.call("update_config", {"addFTSPattern": "*.md"})
        at = looks.numbers()[-1]
        wait_for(lambda: looks.numbers()[-1] > at + 1)
        (tmp_path / "note.md").write_text("freshly noted\n")
        wait_for(lambda: engine.full_text("noted").collect())
    finally:
        q.stop()
    assert [r["line"] for r in engine.full_text("noted").collect()] == [1]


def test_a_long_line_is_one_bad_request(engine, monkeypatch, capsys):
    monkeypatch.setattr(cli, "MOST_BYTES", 64)
    ping = json.dumps({"id": 1, "method": "ping"})
    sink = io.StringIO()
    cli.serve(engine, io.BytesIO(f"{' ' * 200}{ping}\n{ping}\n{'x' * 63}\n{'y' * 64}\n{ping}\n".encode()), sink, follow=False)
    assert [json.loads(x)["id"] for x in sink.getvalue().splitlines()] == [1, 1]
    assert capsys.readouterr().err.count("request too long") == 2


def test_only_changed_files_are_read_and_written(engine, tmp_path, monkeypatch):
    for i in range(5):
        (tmp_path / f"x{i}.go").write_text(f"package x\n// line of {i}\n")
    assert engine.sync_search() == (7, 0, 0)
    os.utime(tmp_path / "x1.go", (1, 1))
    os.chmod(tmp_path / "x1.go", 0o644)
    assert engine.sync_search() == (1, 6, 0)
    top = engine.search.current()
    layer = lambda t: engine.spark.read.parquet(f"{top}/{t}")
    assert {r["file"] for r in layer("lines").collect()} == {f"{tmp_path}/x1.go"} == {h["file"] for r in layer("blocks").collect() for h in r["hits"]}
    assert layer("gone_files").count() == 1 and engine.search.read("fts_meta").count() == 7
    assert [r["file"] for r in engine.full_text('"of 1"').collect()] == [f"{tmp_path}/x1.go"]


def test_a_tick_run_again_sees_the_same(spark, tmp_path):
    """Listing and patterns of a tick are made once; the events of ticks are those of a walk."""
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    (root / "a.go").write_text("a")
    (root / "x.md").write_text("x")
    config = Config()
    looks = watch.Watch(spark, str(root), config, str(tmp_path / "listings"), first="empty")
    get = lambda n: sorted((os.path.basename(r["path"]), r["op"]) for r in looks.events(n).collect())
    assert get(0) == [("a.go", "create")]
    (root / "sub" / "b.go").write_text("b")
    os.remove(root / "a.go")
    (root / "x.md").write_text("changed")
    assert get(1) == [("a.go", "remove"), ("b.go", "create")]
    (root / "c.go").write_text("c")
    config.fts.include.append("*.md")
    assert get(1) == [("a.go", "remove"), ("b.go", "create")]
    again = watch.Watch(spark, str(root), config, str(tmp_path / "listings"))
    os.utime(root / "x.md", ns=(1, 1))
    assert sorted((os.path.basename(r["path"]), r["op"]) for r in again.events(2).collect()) == [("c.go", "create"), ("x.md", "write")]
    seen = []
    for n in range(3, 9):
        again.tick(n, lambda df: seen.append(df.count()))
    assert seen == [] and again.numbers() == [6, 7, 8]


def test_the_index_section_survives_a_save(engine):
    with open(engine.config_path, "w") as f:
        json.dump({"fts": {"include": ["*.go"]}, "index": {"include": ["pkg/*"]}}, f)
    engine.call("update_config", {"maxFileSizeKB": 70})
    with open(engine.config_path) as f:
        assert json.load(f)["index"] == {"include": ["pkg/*"]}


def test_requests_and_ticks_leave_no_tables(engine, tmp_path):
    """Twenty requests and five changes: the shared folder holds what it held."""
    engine.rebuild()
    engine.sync_search()
    at = shared_dir(engine.spark).removeprefix("file:")
    before = set(os.listdir(at))
    for i in range(5):
        (tmp_path / "a.go").write_text(f"package a\n\nfunc Run{i}() {{}}\n// not found {i}\n")
        events = engine.spark.createDataFrame([(str(tmp_path / "a.go"), "write", i)], "path string, op string, seq long")
        watch.apply_batch(engine.symbols, engine.search, engine.config(), events)
        for query in ("run*", '"not found"', "package OR found", f"{i}"):
            assert "a.go" in engine.call("full_text_search", {"query": query})
    assert set(os.listdir(at)) == before


def test_debounce(spark):
    e = spark.createDataFrame([("a", "create", 1, 10), ("a", "write", 2, 499), ("a", "remove", 3, 500), ("b", "write", 4, 20)], "path string, op string, seq long, ms long")
    assert sorted(tuple(r) for r in watch.debounced(e).collect()) == [(0, "a", "write"), (0, "b", "write"), (1, "a", "remove")]


def test_debounce_in_a_stream(spark, tmp_path):
    """Events that come late, twice and out of order: each tick of a path is told once, as a batch over
    all events tells it; what comes after its span is dropped."""
    rng = random.Random(4)
    rows = [(f"p{rng.randrange(5)}", rng.choice(["create", "write", "remove"]), i, 100 * i + rng.randrange(1500)) for i in range(240)]
    rows += rng.sample(rows, 40)
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[3] // 4000)  # late by four seconds at most
    schema = "path string, op string, seq long, ms long"
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"

    def run(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = watch.debounced_stream(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(sink).awaitTermination()

    for part in (rows[:90], rows[90:200], rows[200:]):
        run(part)
    run([("end", "write", 1000, 200_000)])
    run([("p0", "create", 1001, 5)])  # far too late
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    assert got == sorted(tuple(r) for r in watch.debounced(spark.createDataFrame(rows, schema)).collect()) and len(got) > 50
