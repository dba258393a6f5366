"""DuckDB SQL of the engine's queries, over the same Parquet tables.

Search scores are worked out from unnested tokens; the Go corpus is derived from the relational
columns, without any source text.
"""

from __future__ import annotations

SPLIT = r"[^\p{L}\p{N}\p{Co}]+"

LINES = r"""
raw AS (SELECT doc_id::VARCHAR AS file, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
cut AS (SELECT file, CASE WHEN ls[-1] = '' THEN ls[:len(ls) - 1] ELSE ls END AS ls FROM raw),
each_line AS (SELECT file, unnest(range(1, len(ls) + 1))::INT AS line, regexp_replace(unnest(ls), '\r$', '') AS content FROM cut),
lines AS (SELECT * FROM each_line WHERE regexp_matches(content, '[^\s\x0B\p{Z}]'))
"""

TOKENS = f"""{LINES},
toks AS (SELECT file, line, list_filter(regexp_split_to_array(strip_accents(lower(content)), '{SPLIT}'), lambda x: x <> '') AS ts FROM lines),
t AS (SELECT file, line, unnest(ts) AS term, unnest(range(len(ts)))::INT AS pos FROM toks),
c AS (SELECT count(*) AS n, sum(len(ts)) / count(*) AS avg FROM toks),
l AS (SELECT file, line, len(ts) AS len FROM toks)
"""


def phrase(name: str, terms: list[str], prefix: bool = False, initial: bool = False) -> str:
    """A table of (file, line, f) of a phrase, and one of its starts."""
    tests = [f"a{k}.term = '{x}'" for k, x in enumerate(terms)]
    if prefix:
        tests[-1] = f"starts_with(a{len(terms) - 1}.term, '{terms[-1]}')"
    joins = "".join(f" JOIN t a{k} ON a{k}.file = a0.file AND a{k}.line = a0.line AND a{k}.pos = a0.pos + {k}" for k in range(1, len(terms)))
    if initial:
        tests.append("a0.pos = 0")
    return f"{name}s AS (SELECT a0.file, a0.line, a0.pos FROM t a0{joins} WHERE {' AND '.join(tests)}),\n{name} AS (SELECT file, line, count(*) AS f FROM {name}s GROUP BY file, line)"


def ranked(phrases: dict[str, str], where: str, gates: dict[str, str] | None = None, limit: int | None = 50, counted: dict[str, str] | None = None) -> str:
    """A search: phrase tables, the condition and each phrase's gate over flags like ``p IS NOT NULL``."""
    names = list(phrases)
    counted = counted or {}
    flags = ", ".join(f"{counted.get(p, p)}.f AS {p}" for p in names)
    joins = "".join(f" LEFT JOIN {counted.get(p, p)} ON {counted.get(p, p)}.file = l.file AND {counted.get(p, p)}.line = l.line" for p in names)
    idf = ", ".join(f"(SELECT CASE WHEN x <= 0 THEN 1e-6 ELSE x END FROM (SELECT ln((c.n - k + 0.5) / (k + 0.5)) AS x FROM c, (SELECT count(*) AS k FROM {p}))) AS i_{p}" for p in names)
    parts = " + ".join(f"CASE WHEN {(gates or {}).get(p, p)} THEN i_{p} * coalesce({p}, 0) * 2.2 / (coalesce({p}, 0) + 1.2 * (0.25 + 0.75 * len / (SELECT avg FROM c))) ELSE 0 END" for p in names)
    for p in names:
        parts = parts.replace(f"WHEN {p} THEN", f"WHEN {p} IS NOT NULL THEN")
    tail = f"ORDER BY round(score, 9), file, line LIMIT {limit}" if limit else ""
    return f"""WITH {TOKENS},
{', '.join(phrases.values())},
flagged AS (SELECT l.file, l.line, l.len, {flags} FROM l{joins}),
idfs AS (SELECT {idf}),
scored AS (SELECT file, line, -({parts}) AS score FROM flagged, idfs WHERE {where})
SELECT file, line, round(score, 6) AS score FROM scored {tail}"""


_P = phrase
_NESTED = ({"p": _P("p", ["to"]), "q": _P("q", ["the"]), "r": _P("r", ["of", "the"])}, "(p IS NOT NULL AND q IS NOT NULL) OR r IS NOT NULL", {"p": "(p IS NOT NULL AND q IS NOT NULL)", "q": "(p IS NOT NULL AND q IS NOT NULL)", "r": "r IS NOT NULL"})
_NEAR_COUNT = """pn AS (SELECT file, line, count(*) AS f FROM ps WHERE EXISTS (SELECT 1 FROM qs WHERE qs.file = ps.file AND qs.line = ps.line AND (CASE WHEN qs.pos > ps.pos THEN qs.pos - ps.pos - 1 ELSE ps.pos - qs.pos - 1 END) <= 1) GROUP BY file, line),
qn AS (SELECT file, line, count(*) AS f FROM qs WHERE EXISTS (SELECT 1 FROM ps WHERE ps.file = qs.file AND ps.line = qs.line AND (CASE WHEN qs.pos > ps.pos THEN qs.pos - ps.pos - 1 ELSE ps.pos - qs.pos - 1 END) <= 1) GROUP BY file, line)"""

SEARCH = {
    "fts_term": ranked({"p": _P("p", ["that"])}, "p IS NOT NULL"),
    "fts_and": ranked({"p": _P("p", ["that"]), "q": _P("q", ["was"])}, "p IS NOT NULL AND q IS NOT NULL"),
    "fts_or": ranked({"p": _P("p", ["threat"]), "q": _P("q", ["que"])}, "p IS NOT NULL OR q IS NOT NULL"),
    "fts_not": ranked({"p": _P("p", ["that"]), "q": _P("q", ["the"])}, "p IS NOT NULL AND q IS NULL", {"q": "FALSE"}),
    "fts_prefix": ranked({"p": _P("p", ["thes"], prefix=True)}, "p IS NOT NULL"),
    "fts_phrase": ranked({"p": _P("p", ["of", "the"])}, "p IS NOT NULL"),
    "fts_plus": ranked({"p": _P("p", ["in", "the"])}, "p IS NOT NULL"),
    "fts_near": ranked({"p": _P("p", ["the"]), "q": _P("q", ["of"]) + ",\n" + _NEAR_COUNT}, "p IS NOT NULL AND q IS NOT NULL", counted={"p": "pn", "q": "qn"}),
    "fts_initial": ranked({"p": _P("p", ["the"], initial=True)}, "p IS NOT NULL"),
    "fts_nested": ranked(*_NESTED),
    "fts_column": ranked({"p": _P("p", ["with"]), "r": _P("r", ["and"])}, "r IS NOT NULL", {"p": "FALSE", "r": "r IS NOT NULL"}),
    "fts_all_matches": ranked(*_NESTED, limit=None),
    "fts_index_term": ranked({"p": _P("p", ["that"])}, "p IS NOT NULL"),
    "fts_index_nested": ranked(*_NESTED),
}
SEARCH |= {f"fts_index_{x}": SEARCH[f"fts_{x}"] for x in ("and", "or", "not")}

_T, _GAP = r"[\p{L}\p{N}\p{Co}]+", r"[^\p{L}\p{N}\p{Co}]+"
_CUT = f"'^([^\\p{{L}}\\p{{N}}\\p{{Co}}]*)({_T})((?:{_GAP}{_T}){{0,11}})(.*)$', ['before', 'first', 'more', 'rest'], 's'"
SNIPPETS = f"""WITH {LINES},
best AS (SELECT file, line FROM ({SEARCH['fts_initial']})),
m AS (SELECT file, line, regexp_extract(content, {_CUT}) AS m FROM best JOIN lines USING (file, line))
SELECT file, line, m.before || '>>>' || m.first || '<<<' || m.more || CASE WHEN regexp_matches(m.rest, '{_T}') THEN '...' ELSE m.rest END AS snippet FROM m"""

#: Snippets of lines that hold a phrase of two words, windows anywhere: the window of twelve tokens with
#: most instances (1000 for the first), put around them or at the start of their sentence.
WINDOWS = f"""WITH {LINES},
best AS (SELECT file, line FROM ({SEARCH['fts_phrase']})),
tk AS (SELECT file, line, regexp_extract_all(content, '{_T}') AS tk, regexp_split_to_array(content, '{_T}') AS gp FROM best JOIN lines USING (file, line)),
ts AS (SELECT *, len(tk) AS n, list_transform(tk, lambda x: strip_accents(lower(x))) AS ts FROM tk),
fd AS (SELECT *, list_filter(range(n - 1), lambda i: ts[i + 1] = 'of' AND ts[i + 2] = 'the') AS found, list_filter(range(n), lambda k: k = 0 OR regexp_matches(gp[k + 1], '[.:][ \\t\\n\\r]+$')) AS opens FROM ts),
each_i AS (SELECT file, line, n, found, unnest(found) AS i, opens FROM fd),
own AS (SELECT *, list_filter(found, lambda j: j >= i AND j < i + 12) AS held, list_max(list_filter(opens, lambda k: k <= i)) AS s FROM each_i),
cand AS (
  SELECT file, line, i, 0 AS which, 1000 + len(held) - 1 AS score, greatest(0, least(i - greatest(0, 12 - (list_max(held) + 2 - i)) // 2, n - 12)) AS start FROM own
  UNION ALL
  SELECT file, line, i, 1, CASE WHEN len(within) > 0 THEN 1000 + len(within) - 1 ELSE 0 END + CASE WHEN s = 0 THEN 120 ELSE 100 END, s
  FROM (SELECT *, list_filter(found, lambda j: j >= s AND j < s + 12) AS within FROM own) WHERE n > 12 AND s < i),
won AS (SELECT file, line, first(start ORDER BY score DESC, i, which) AS start FROM cand GROUP BY file, line),
piece AS (SELECT *, least(n, start + 12) AS stop FROM fd JOIN won USING (file, line))
SELECT file, line, CASE WHEN start > 0 THEN '...' ELSE gp[1] END || list_aggregate(list_transform(range(start, stop), lambda k:
         CASE WHEN list_contains(found, k) THEN '>>>' ELSE '' END || tk[k + 1]
         || CASE WHEN (k > start AND list_contains(found, k - 1)) OR (k = stop - 1 AND list_contains(found, k)) THEN '<<<' ELSE '' END
         || CASE WHEN k < stop - 1 THEN gp[k + 2] ELSE '' END), 'string_agg', '')
       || CASE WHEN stop < n THEN '...' ELSE gp[n + 1] END AS snippet FROM piece"""

GO = """
sup AS (SELECT s_suppkey AS s, s_nationkey AS n, 'n' || s_nationkey || '/s' || s_suppkey || '.go' AS file FROM supplier),
sp AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
np AS (SELECT sup.s, sup.n, sup.file, count(sp.p)::INT AS c FROM sup LEFT JOIN sp ON sp.s = sup.s GROUP BY ALL),
symbols AS (
  SELECT 'K' || s AS name, 'const' AS kind, 'n' || n AS pkg, '' AS recv, file, 3 AS line, 3 AS end_line, 'const K' || s || ' = ' || s AS sig FROM np
  UNION ALL SELECT 'S' || s, 'struct', 'n' || n, '', file, 5, 5, '' FROM np
  UNION ALL SELECT 'Run', 'method', 'n' || n, 'S' || s, file, 7, 7 + c + 2, 'func (S' || s || ') Run()' FROM np),
refs AS (
  SELECT 'P' || p AS sym, 'call' AS kind, file, (7 + row_number() OVER (PARTITION BY sp.s ORDER BY p))::INT AS line, 'S' || sp.s || '.Run' AS in_symbol FROM sp JOIN np ON np.s = sp.s
  UNION ALL SELECT 'K' || s, 'const_ref', file, 8 + c, 'S' || s || '.Run' FROM np)
"""

SHAPES = """
k AS (SELECT s_suppkey::VARCHAR AS k, s_nationkey % 4 AS pad, 'shapes/f' || s_suppkey || '.go' AS file FROM supplier),
sym(name, kind, recv, line, end_line, sig) AS (VALUES
  ('A@', 'const', '', 6, 6, 'const A@ = 1'), ('B@', 'const', '', 7, 7, 'const B@ = 2, 3'),
  ('V@', 'var', '', 10, 10, 'var V@ int'), ('W@', 'var', '', 13, 13, 'var W@ = A@'),
  ('I@', 'interface', '', 17, 19, ''), ('M@', 'type', '', 21, 21, ''), ('G@', 'struct', '', 24, 24, ''),
  ('F@', 'func', '', 26, 32, 'func F@(a int, b string) (int, error)'), ('H@', 'func', '', 34, 34, 'func H@(n int)'),
  ('Get', 'method', '', 36, 36, 'func Get() T'), ('Set', 'method', 'G@[T]', 38, 38, 'func (G@[T]) Set(x T)'),
  ('Run', 'method', 'M@', 40, 44, 'func (M@) Run()')),
ref(sym, kind, line, in_symbol) AS (VALUES
  ('Println', 'call', 27, 'F@'), ('H@', 'call', 28, 'F@'), ('f', 'call', 29, 'F@'), ('len', 'call', 31, 'F@'),
  ('A@', 'const_ref', 27, 'F@'), ('W@', 'var_ref', 28, 'F@'), ('V@', 'var_ref', 30, 'F@'), ('B@', 'const_ref', 30, 'F@'),
  ('F@', 'call', 38, 'G@[T].Set'), ('F@', 'call', 38, 'G@[T].Set'), ('V@', 'var_ref', 38, 'G@[T].Set'),
  ('H@', 'call', 42, 'M@.Run'), ('A@', 'const_ref', 42, 'M@.Run'))
"""

LISTING = "f AS (SELECT source || '/' || doc_id || '.' || lang AS path, strlen(coalesce(text, ''))::BIGINT AS size, n_chars AS mtime FROM documents)"
META = r"meta AS (SELECT cut.file AS path, len(ls) AS lines, n_chars AS mtime FROM cut JOIN documents ON doc_id::VARCHAR = cut.file)"
MANIFESTS = """
disk AS (SELECT doc_id::VARCHAR AS path, n_chars % 2 AS mtime FROM documents),
stored AS (SELECT event_id::VARCHAR AS path, user_id % 2 AS mtime FROM events),
plan AS (SELECT coalesce(disk.path, stored.path) AS path, CASE WHEN disk.path IS NULL THEN 'remove' WHEN disk.mtime = stored.mtime THEN 'unchanged' ELSE 'index' END AS action
         FROM disk FULL OUTER JOIN stored ON disk.path = stored.path)
"""

SQL: dict[str, str] = SEARCH | {
    "fts_snippet": WINDOWS,
    "fts_snippet_opening": SNIPPETS,
    "lines_scan": f"WITH {LINES} SELECT file, line, content FROM lines",
    "files_scan": f"WITH {GO} SELECT file AS path, 'n' || n AS pkg, 9 + c AS lines, (length('package n' || n) + 2 + length('const K' || s || ' = ' || s) + 2 + length('type S' || s || ' struct{{}}') + 2 + length('func (s *S' || s || ') Run() {{') + 1 + coalesce((SELECT sum(length('P' || p) + 4) FROM sp WHERE sp.s = np.s), 0) + length('_ = K' || s) + 2 + 2)::BIGINT AS size FROM np",
    "source_filters": f"WITH {LISTING}, r AS (SELECT regexp_replace(regexp_replace(path, '\\.en$', '.json'), '\\.de$', '_gen.go') AS path, size FROM f) SELECT path, (path LIKE '%.json' AND size <= 51200) AS batch, ((path LIKE '%.json' OR regexp_matches(path, '/[0-4][0-9]*\\.fr$')) AND split_part(path, '/', 1) NOT IN ('src1', 'src2') AND size <= 4096) AS configured FROM r",
    "oversize_files": f"WITH {LISTING} SELECT path, path || ' (' || printf('%.1f', size / 1024.0) || 'KB)' AS shown FROM f WHERE regexp_matches(path, '\\.e[ns]$') AND size > 2048 AND split_part(path, '/', 1) NOT IN ('src3', 'vendor')",
    "glob_filter": f"WITH {LISTING} SELECT path FROM f WHERE regexp_matches(path, '/[0-9][0-5][0-9]*\\.fr$') OR regexp_matches(path, '[9]\\.de$')",
    "sym_list": f"WITH {GO} SELECT * FROM symbols",
    "sym_list_kind": f"WITH {GO} SELECT * FROM symbols WHERE kind = 'struct'",
    "sym_find": f"WITH {GO} SELECT * FROM symbols WHERE name = 'Run'",
    "sym_search": f"WITH {GO} SELECT * FROM symbols WHERE kind = 'const' AND contains(lower(name), 'k1')",
    "sym_search_grams": f"WITH {GO} SELECT * FROM symbols WHERE contains(lower(name), 'k1')",
    "name_grams": f"WITH {GO}, n AS (SELECT DISTINCT name FROM symbols), g AS (SELECT DISTINCT name, substr(lower(name), i::INT, k::INT) AS gram FROM n, range(1, 4) a(k), range(1, 64) b(i) WHERE i + k - 1 <= length(name)) SELECT gram, count(*) AS n_names FROM g GROUP BY gram",
    "shape_symbols": f"WITH {SHAPES} SELECT replace(name, '@', k) AS name, kind, 'shapes' AS pkg, replace(recv, '@', k) AS recv, file, (line + pad)::INT AS line, (end_line + pad)::INT AS end_line, replace(sig, '@', k) AS sig FROM sym, k",
    "shape_refs": f"WITH {SHAPES} SELECT replace(sym, '@', k) AS sym, kind, file, (line + pad)::INT AS line, replace(in_symbol, '@', k) AS in_symbol FROM ref, k",
    "refs_all": f"WITH {GO} SELECT * FROM refs",
    "ref_usages": f"WITH {GO} SELECT * FROM refs WHERE sym = 'P10'",
    "ref_calls_from": f"WITH {GO} SELECT * FROM refs WHERE in_symbol = 'S3.Run'",
    "ref_values": f"WITH {GO} SELECT * FROM refs WHERE kind = 'const_ref'",
    "known_values": f"WITH {GO} SELECT name, kind FROM symbols WHERE kind = 'const'",
    "merged_values": f"WITH {GO} SELECT name, CASE WHEN regexp_matches(name, '[147]$') THEN 'var' ELSE kind END AS kind FROM symbols WHERE kind = 'const'",
    "file_names": f"WITH {GO} SELECT DISTINCT name FROM symbols WHERE file = (SELECT arg_min(file, s) FROM sup)",
    "dependent_files": f"WITH {GO} SELECT DISTINCT file FROM refs WHERE sym IN (SELECT 'P' || p_partkey FROM part WHERE p_size = 7)",
    "symbols_by_name": f"WITH {GO} SELECT name, count(*)::INT AS n, min(file) AS first_file, max(file) AS last_file FROM symbols GROUP BY name",
    "sym_kind_names": f"WITH {GO} SELECT DISTINCT kind, name FROM symbols",
    "sym_kind_counts": f"WITH {GO} SELECT kind, count(*) AS n_symbols, count(DISTINCT name) AS n_names FROM symbols GROUP BY kind",
    "refs_by_target": f"WITH {GO} SELECT sym, count(*) AS n_refs, count(*) FILTER (kind = 'call') AS n_calls, count(DISTINCT file) AS n_files FROM refs GROUP BY sym",
    "refs_by_caller": f"WITH {GO} SELECT in_symbol, count(*) AS n_refs, count(DISTINCT sym) AS n_targets FROM refs WHERE in_symbol <> '' GROUP BY in_symbol",
    "contributions": f"WITH {GO} SELECT file, 3::BIGINT AS n_names, (c + 1)::BIGINT AS n_targets, 1::BIGINT AS n_callers FROM np",
    "index_counts": f"WITH {GO} SELECT (SELECT count(*) FROM symbols) AS n_symbols, (SELECT count(*) FROM refs) AS n_refs, (SELECT count(*) FROM sup) AS n_files",
    "term_stats": f"WITH {TOKENS} SELECT term, count(DISTINCT (file, line)) AS df, count(*) AS cf FROM t GROUP BY term",
    "index_term_counts": f"WITH {TOKENS} SELECT term, count(DISTINCT (file, line)) AS df FROM t GROUP BY term",
    "block_best": f"WITH {TOKENS}, k AS (SELECT term, file, line, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, max(tf) AS bound_tf, max(tf) AS tf FROM k GROUP BY term",
    "line_lengths": f"WITH {TOKENS} SELECT file, line, len::INT AS n_tokens FROM l",
    "fts_stats": f"WITH {LINES}, {META} SELECT count(*) AS files, coalesce(sum(lines), 0)::BIGINT AS lines FROM meta",
    "fts_last_indexed": f"WITH {LINES}, {META} SELECT strftime(make_timestamp(max(mtime) * 1000000), '%Y-%m-%d %H:%M:%S') AS last_indexed FROM meta",
    "sync_plan": f"WITH {MANIFESTS} SELECT path, action FROM plan",
    "sync_counts": f"WITH {MANIFESTS} SELECT count(*) FILTER (action = 'index') AS indexed, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action = 'remove') AS removed FROM plan",
    "fts_replace": f"WITH {LINES} SELECT file, line, content FROM lines WHERE file NOT IN (SELECT doc_id::VARCHAR FROM labels WHERE toxic = 1 OR quality = 0) UNION ALL SELECT doc_id::VARCHAR, 1, 'rewritten ' || doc_id FROM labels WHERE toxic = 1 AND quality = 1",
    "remove_files": f"WITH {GO} SELECT file, 3::BIGINT AS n_names, (c + 1)::BIGINT AS n_targets, 1::BIGINT AS n_callers FROM np WHERE n <> 1",
    "update_files": f"WITH {GO} SELECT CASE WHEN pkg = 'n2' AND kind = 'method' THEN 'Exec' ELSE name END AS name, kind, pkg, recv, file, line, end_line, CASE WHEN pkg = 'n2' THEN replace(sig, 'Run', 'Exec') ELSE sig END AS sig FROM symbols",
    "cascade_refs": f"WITH {GO} SELECT kind, CASE WHEN file LIKE 'n2/%' THEN replace(in_symbol, 'Run', 'Exec') ELSE in_symbol END AS in_symbol, count(*) AS n FROM refs GROUP BY ALL",
    "cascade_dependents": f"WITH {GO} SELECT DISTINCT file AS path FROM refs WHERE sym IN (SELECT 'P' || p_partkey FROM part WHERE p_brand LIKE '%1')",
    "debounce_last_op": "SELECT (epoch_us(ts) // 1000 // 500)::BIGINT AS tick, user_id::VARCHAR AS path, arg_max(event_type, event_id) AS op FROM events GROUP BY ALL",
    "render_list": f"WITH {GO} SELECT '[' || rpad(kind, 9, ' ') || '] ' || CASE WHEN recv <> '' THEN recv || '.' ELSE '' END || name || chr(9) || file || ':' || line AS shown FROM symbols",
    "render_usages": f"WITH {GO} SELECT '  ' || file || ':' || line || '  ← ' || in_symbol AS shown FROM refs WHERE sym = 'P10'",
    "render_calls": f"WITH {GO} SELECT '  ' || sym || '()  at ' || file || ':' || line AS shown FROM refs WHERE in_symbol = 'S3.Run'",
    "render_symbols": f"WITH {GO} SELECT '[method] (' || recv || ') ' || name || chr(10) || '  file: ' || file || ':' || line || chr(10) || '  pkg:  ' || pkg || chr(10) || '  sig:  ' || sig || chr(10) AS shown FROM symbols WHERE name = 'Run'",
}
