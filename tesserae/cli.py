"""Command line: ``python -m tesserae.cli <command>``."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable
from typing import IO, Any

from tesserae.api import CLI_LIMIT, Engine
from tesserae.config import FOLDER, Config
from tesserae.plans import render
from tesserae.session import session
from tesserae.sources.snapshot import NoIndex
from tesserae.streaming import watch

USAGE = """tesserae <command>

  init                     make the index folder here (once)
  index [dir]              build both indexes
  find <name>              where a symbol is defined
  usages <name>            where a name is used
  search <pattern> [kind]  symbols whose name contains the pattern
  list [kind]              symbols of a kind
  calls-from <Sym.Method>  what a function refers to
  fts <query>              search lines
  fts-update [dir]         bring the line search up to date
  stats                    numbers of the index
  serve                    JSON-RPC on standard input and output, with a file watcher"""
#: Fixed value: the longest request line.
MOST_BYTES = 4 << 20


def init(folder: str = ".") -> list[str]:
    """Make the index folder, a default configuration if there is none, and a .gitignore entry."""
    said = []
    os.makedirs(os.path.join(folder, FOLDER), exist_ok=True)
    path = os.path.join(folder, FOLDER, "config.json")
    if not os.path.exists(path):
        Config().save(path)
        said.append(f"Created {FOLDER}/config.json")
    ignore, entry = os.path.join(folder, ".gitignore"), f"{FOLDER}/"
    old = open(ignore, encoding="utf-8").read() if os.path.exists(ignore) else ""
    if entry not in (line.strip() for line in old.splitlines()):
        with open(ignore, "a", encoding="utf-8") as f:
            f.write(("\n" if old and not old.endswith("\n") else "") + entry + "\n")
        said.append(f"Added {entry} to .gitignore")
    return said


def serve(engine: Engine, source: IO[bytes], sink: IO[str], follow: bool = True) -> None:
    """Answer requests line by line; lines that are no JSON are passed over."""
    running = None
    if follow and engine.symbols.current():
        looks = watch.Watch(engine.spark, engine.root, engine.config(), os.path.join(engine.folder, "listings"), config_path=engine.config_path)
        # The configuration is read anew for each batch: a pattern added meanwhile counts.
        running = watch.start(looks, lambda df: watch.apply_batch(engine.symbols, engine.search, engine.config(), df), os.path.join(engine.folder, "watch"))
    try:
        while line := source.readline(MOST_BYTES):
            if len(line) == MOST_BYTES and not line.endswith(b"\n"):
                # A line that is too long is one unreadable request, not several.
                while line and not line.endswith(b"\n"):
                    line = source.readline(MOST_BYTES)
                print("request too long", file=sys.stderr)
                continue
            try:
                request = json.loads(line)
            except ValueError:
                if line.strip():
                    print("cannot read request", file=sys.stderr)
                continue
            answer = engine.handle(request) if isinstance(request, dict) else None
            if answer is not None:
                print(json.dumps(answer, ensure_ascii=False), file=sink, flush=True)
    finally:
        if running is not None:
            running.stop()


def _rows(engine: Engine, df: Any, line: Any) -> list[str]:
    return engine._lines(df, line)


def commands(engine: Engine) -> dict[str, Callable[..., str]]:
    def index(directory: str | None = None) -> str:
        n_files, n_symbols, n_refs = engine.rebuild(directory)
        indexed, unchanged, removed = engine.sync_search(directory)
        return f"symbols: {n_symbols} | refs: {n_refs} | files: {n_files}\nfts: {indexed} indexed, {unchanged} unchanged, {removed} removed"

    def find(name: str) -> str:
        return engine.tool_find_symbol(name).rstrip("\n")

    def usages(name: str) -> str:
        return engine.tool_find_usages(name).rstrip("\n")

    def search(pattern: str, kind: str = "") -> str:
        found = _rows(engine, engine.search_symbols(pattern, kind), render.symbol_text())
        return f"Found {len(found)} symbol(s) matching '{pattern}':\n" + "\n".join(found) if found else f"No symbols matching: {pattern}"

    def list_(kind: str = "") -> str:
        found = _rows(engine, engine.list_symbols(kind), render.list_line())
        return "\n".join(found) if found else f"No symbols (kind={json.dumps(kind)})"

    def calls_from(symbol: str) -> str:
        return engine.tool_calls_from(symbol).rstrip("\n")

    def fts(query: str) -> str:
        return engine.shown_matches(query, CLI_LIMIT).rstrip("\n")

    def fts_update(directory: str | None = None) -> str:
        indexed, unchanged, removed = engine.sync_search(directory)
        return f"fts-update: {indexed} indexed, {unchanged} unchanged, {removed} removed"

    def stats() -> str:
        s = engine.stats()
        return f"files: {s['files']} | indexed: {s['indexed_at']:%Y-%m-%d %H:%M:%S}"

    return {"index": index, "find": find, "usages": usages, "search": search, "list": list_, "calls-from": calls_from, "fts": fts, "fts-update": fts_update, "stats": stats}


def main(argv: list[str]) -> int:
    if not argv:
        print(USAGE)
        return 1
    name, rest = argv[0], argv[1:]
    if name == "init":
        print("\n".join(init()))
        return 0
    if not os.path.isdir(FOLDER):
        print("error: no index folder here — run: init", file=sys.stderr)
        return 1
    if name != "serve" and name not in commands(Engine.__new__(Engine)):
        print(USAGE)
        return 1
    if name in ("find", "usages", "search", "calls-from", "fts") and not rest:
        print(f"usage: {name} <argument>", file=sys.stderr)
        return 1
    engine = Engine(session("tesserae-cli"))
    if name == "serve":
        serve(engine, sys.stdin.buffer, sys.stdout)
        return 0
    try:
        print(commands(engine)[name](*rest))
    except NoIndex:
        print("error: no index found — run: index [dir]", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
