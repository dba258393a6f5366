"""Several writers and slow readers of one store."""

import json
import os
import random
import subprocess
import sys
import time

import pytest

from tesserae.operators import maintenance as m
from tesserae.plans import search
from tesserae.schemas import FILES
from tesserae.sources import snapshot
from tesserae.sources.folder import Folder
from tesserae.sources.snapshot import Conflict, Store, read_index, read_lines, write_delta, write_index
from tesserae.streaming.watch import write_search, write_symbols

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def sources(spark, files):
    return spark.createDataFrame([(p, 1, len(t), bytearray(t.encode())) for p, t in files.items()], FILES)


def paths(spark, names):
    return spark.createDataFrame([(p,) for p in names], "path string")


def put(spark, store, files, gone=()):
    write_search(store, paths(spark, [*files, *gone]), sources(spark, files))


def names(df):
    return sorted(r["name"] for r in df.collect())


def counted(view):
    """Lines, tokens and documents per term: as the store keeps them, and counted from its lines."""
    corpus, counts = search.line_statistics(view.read("lines"))
    kept = (view.read("corpus").collect(), sorted(map(tuple, view.read("term_counts").where("df != 0").collect())))
    return kept, (corpus.collect(), sorted(map(tuple, counts.collect())))


WRITER = """
import sys, time
sys.path.insert(0, {root!r})
from tesserae.session import session
from tests.test_store import put, sources
from tesserae.sources.snapshot import Store
spark = session("writer", cores="2", **{{"spark.sql.shuffle.partitions": "2", "spark.driver.memory": "1g", "spark.checkpoint.dir": {at!r} + "/scratch"}})
store = Store(spark, {at!r} + "/search")
me = sys.argv[1]
open({at!r} + "/ready" + me, "w").close()
import os
while not all(os.path.exists({at!r} + "/ready" + x) for x in "ab"):
    time.sleep(0.1)
for i in range(5):
    put(spark, store, {{f"{{me}}{{i}}.txt": f"line of {{me}}\\nshared word{{i}}\\n"}}, [f"{{me}}{{i - 1}}.txt"] if i == 3 else [])
print(store.now().number)
"""


def test_two_processes_write_while_one_reads_slowly(spark, tmp_path):
    """No layer is lost, no file that a reader holds goes, and the statistics add up."""
    at = str(tmp_path)
    store = Store(spark, f"{at}/search")
    put(spark, store, {"old.txt": "old words\nshared once\n"})
    held = store.now()
    slow = held.read("lines")
    code = WRITER.format(root=ROOT, at=at)
    running = [subprocess.Popen([sys.executable, "-c", code, x], stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, env=os.environ | {"PYTHONPATH": ROOT}) for x in "ab"]
    for p in running:
        out, err = p.communicate(timeout=400)
        assert p.returncode == 0, err[-3000:]
    want = {"old.txt", *[f"{x}{i}.txt" for x in "ab" for i in (0, 1, 3, 4)]}
    now = store.now()
    assert now.number >= 11 and {r["file"] for r in now.read("lines").collect()} == want == {r["path"] for r in now.read("fts_meta").collect()}
    kept, again = counted(now)
    assert kept == again
    assert sorted(r["content"] for r in slow.collect()) == ["old words", "shared once"]
    assert {r["file"] for r in search.search_index(read_lines(store), "shared").collect()} == want
    assert not [n for n in os.listdir(f"{at}/search/log") if not n.endswith(".json")]


def test_a_layer_that_comes_between_is_kept(spark, tmp_path, monkeypatch):
    """A change of another writer lands while this one writes its own: both are there, and what
    depends on the version below was made again."""
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    put(spark, store, {"a": "alpha beta\n", "b": "beta\n"})
    make = Store._tables
    done = []

    def slowly(self, tables, name=None):
        version = make(self, tables, name)
        if self is store and not done:
            done.append(1)
            put(spark, other, {"a": "alpha gamma\n", "c": "gamma\n"})
        return version

    monkeypatch.setattr(Store, "_tables", slowly)
    put(spark, store, {"a": "beta delta\n"})
    view = store.now()
    assert len(view.names) == 3 and sorted(r["content"] for r in view.read("lines").collect()) == ["beta", "beta delta", "gamma"]
    kept, again = counted(view)
    assert kept == again


def test_a_symbol_change_is_made_again_on_a_conflict(spark, tmp_path, monkeypatch):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    state = {"a.go": "package a\nfunc F() { G(Limit) }\n", "b.go": "package a\nfunc G() {}\n"}
    write_index(store, m.build(sources(spark, state)))
    base = store.now()
    change = {"b.go": "package a\nconst Limit = 3\n"}
    late = m.delta(read_index(base), paths(spark, change), sources(spark, change))
    write_symbols(other, paths(spark, ["c.go"]), sources(spark, {"c.go": "package c\nfunc H() { _ = Limit }\n"}))
    with pytest.raises(Conflict):
        write_delta(store, paths(spark, change), late, base)
    write_symbols(store, paths(spark, change), sources(spark, change))
    state |= change | {"c.go": "package c\nfunc H() { _ = Limit }\n"}
    whole = m.build(sources(spark, state))
    now = read_index(store)
    for got, want in ((now.symbols, whole.symbols), (now.refs, whole.refs), (now.idents, whole.idents)):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_a_rebuild_keeps_layers_that_came_meanwhile(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    write_index(store, m.build(sources(spark, {"a.go": "package a\nfunc A() {}\n"})))
    base = store.now()
    rebuilt = m.build(sources(spark, {"a.go": "package a\nfunc A2() {}\n"}))
    write_symbols(store, paths(spark, ["b.go"]), sources(spark, {"b.go": "package b\nfunc B() {}\n"}))
    write_index(store, rebuilt, base)
    assert names(store.read("symbols")) == ["A2", "B"]
    with pytest.raises(Conflict):  # a whole version came since
        write_index(store, rebuilt, base)
    assert names(store.read("symbols")) == ["A2", "B"]


def test_compaction_meets_another_writer(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for i in range(3):
        put(spark, store, {f"f{i}": f"text {i}\n"})
    view = store.now()
    put(spark, store, {"f0": "changed\n"})
    whole = lambda v: {"lines": v.read("lines"), "fts_meta": v.read("fts_meta")} | search.line_index(v.read("lines"))
    after = store.compact(view, whole)
    assert len(after.names) == 2 and sorted(r["content"] for r in after.read("lines").collect()) == ["changed", "text 1", "text 2"]
    assert store.compact(view, whole) == store.now()
    kept, again = counted(store.now())
    assert kept == again


def test_versions_stay_as_long_as_they_may_be_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "LAYERS", 2)
    store = Store(spark, str(tmp_path), retention=3600)
    put(spark, store, {"a": "one\n"})
    first = store.now()
    for i in range(3):
        put(spark, store, {"a": f"again {i}\n"})
    working = Folder(spark, f"{tmp_path}/v{time.time_ns():020d}-unfinished")
    working.create("x", "")
    store.sweep()
    assert first.read("lines").collect()[0]["content"] == "one"
    store.retention = 0
    store.sweep()
    left = [d for d in os.listdir(tmp_path) if d.startswith("v")]
    assert set(left) == {*store.now().names, os.path.basename(working.path)}
    assert store.read("lines").collect()[0]["content"] == "again 2"
    assert len(os.listdir(f"{tmp_path}/log")) == 1


def test_a_log_file_that_is_not_whole(spark, tmp_path, monkeypatch):
    """A writer that died while it created its number: readers take the one before, writers the one after."""
    monkeypatch.setattr(snapshot, "PATIENCE", 0.3)
    store = Store(spark, str(tmp_path))
    put(spark, store, {"a": "one\n"})
    Folder(spark, str(tmp_path)).create(f"log/{store.now().number + 1:020d}.json", '{"lay')
    assert store.read("lines").count() == 1
    put(spark, store, {"b": "two\n"})
    assert store.now().number == 3 and store.read("lines").count() == 2


def test_create_is_exclusive(spark, tmp_path):
    folder = Folder(spark, f"{tmp_path}/new")
    assert folder.names() == [] and folder.read("x") is None
    assert folder.create("d/x", "ä1") and not folder.create("d/x", "2")
    assert folder.read("d/x") == "ä1" and folder.names("d") == ["x"]
    folder.delete("d")
    assert folder.names("d") == []


def test_statistics_equal_a_count_after_edits(spark, tmp_path, monkeypatch):
    """Random edits, through compactions: lines, tokens and documents per term as counted anew, and
    searches by blocks over all layers as over the lines."""
    monkeypatch.setattr(snapshot, "LAYERS", 4)
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "unique%d"]
    store, state = Store(spark, str(tmp_path)), {}
    for step in range(7):
        files = {f"f{rng.randrange(6)}": "\n".join(" ".join(rng.choice(words).replace("%d", str(rng.randrange(9))) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 5))) for _ in range(3)}
        gone = [f for f in rng.sample([f"f{i}" for i in range(6)], 2) if f not in files]
        put(spark, store, files, gone)
        state = {f: t for f, t in (state | files).items() if f not in gone}
        kept, again = counted(store.now())
        assert kept == again, step
    lines = store.read("lines")
    assert {r["file"] for r in lines.collect()} == {f for f, t in state.items() if t.strip()}
    for query in ("alpha OR beta", "alpha AND gamma", '"alpha beta"', "delta NOT beta"):
        got, want = (sorted((r["file"], r["line"], round(r["score"], 9)) for r in df.collect()) for df in (search.search_index(read_lines(store), query, 3), search.search_lines(lines, query, 3)))
        assert got == want, query


def test_a_lookup_on_many_layers_is_one_join(spark, tmp_path):
    """Whatever the number of layers, what they took away is joined once, and filters reach each of them."""
    store = Store(spark, str(tmp_path))
    write_index(store, m.build(sources(spark, {f"f{i}.go": f"package a\nfunc F{i}() {{}}\n" for i in range(3)})))
    for i in range(6):
        write_symbols(store, paths(spark, [f"f{i % 3}.go"]), sources(spark, {f"f{i % 3}.go": f"package a\nfunc G{i}() {{ F1() }}\n"}))
    view = store.now()
    assert len(view.names) == 7 and names(view.read("symbols")) == ["G3", "G4", "G5"]
    plan = view.read("symbols").where("name = 'G3'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    physical = view.read("symbols").where("name = 'G3'")._jdf.queryExecution().executedPlan().toString()
    assert physical.count("EqualTo(name,G3)") >= 7
    assert view.read("refs").where("sym = 'F1'")._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert sorted(r["in_symbol"] for r in view.read("refs").where("sym = 'F1'").collect()) == ["G3", "G4", "G5"]


def test_log_holds_names_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    put(spark, store, {"a": "one\n"})
    entry = json.loads(Folder(spark, str(tmp_path)).read(f"log/{1:020d}.json"))
    assert entry["layers"] == list(store.now().names)
