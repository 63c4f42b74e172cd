"""Check SQL: for every query an independent statement that an embedded SQL engine runs on the same tables.

``CTES`` holds named building blocks; ``sql`` collects the ones a statement names, in order of need.
Patterns are used here in their RE2 form.
"""

from __future__ import annotations

import re

from codequarry.functions import fixed
from codequarry.functions.text import WHITE_SPACE
from codequarry.operators import marts, rules
from codequarry.plans import standins
from codequarry.plans.codebase import TABLES

CTES: dict[str, str] = {}
CHECKS: dict[str, str] = {}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(xs) -> str:
    return "(" + ", ".join(lit(x) for x in xs) + ")"


def arr(xs) -> str:
    return "[" + ", ".join(lit(x) for x in xs) + "]"


def strip(e: str) -> str:
    return f"trim({e}, {lit(WHITE_SPACE)})"


def has(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, {lit(pattern)})"


def cap(e: str, pattern: str, g: int = 1) -> str:
    return f"regexp_extract({e}, {lit(pattern)}, {g})"


def base(e: str) -> str:
    return f"regexp_extract({e}, '[^/]*$')"


def ext(e: str) -> str:
    return f"CASE WHEN contains({base(e)}, '.') THEN lower(regexp_extract({base(e)}, '[^.]*$')) ELSE '' END"


def cut(e: str, n: int, tail: str = "") -> str:
    keep = f"list_max(list_filter(range(0, {n} + 1), lambda k: strlen(substr({e}, 1, k)) <= {n}))"
    return f"CASE WHEN strlen({e}) <= {n} THEN {e} ELSE substr({e}, 1, {keep}) || {lit(tail)} END"


def snip(e: str) -> str:
    return cut(strip(e), 100, "…")


def count_of(e: str, ch: str) -> str:
    return f"(length({e}) - length(replace({e}, {lit(ch)}, '')))"


def last3(e: str) -> str:
    return f"array_to_string(list_slice(string_split({e}, '/'), -3, -1), '/')"


def pairs(table: dict[str, str], a: str, b: str) -> str:
    rows = ", ".join(f"({lit(k)}, {lit(v)})" for k, v in table.items())
    return f"(VALUES {rows}) AS d({a}, {b})"


for _name in standins.VIEWS:
    _deps, _text = standins.view_sql(_name, "duckdb")
    for _t in TABLES:
        _text = _text.replace("{" + _t + "}", _t)
    CTES[_name] = _text

W = "PARTITION BY repo, path ORDER BY line_no"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

# --- extraction ----------------------------------------------------------------------------------
CTES["lines"] = f"SELECT repo, path, line_no, text, {strip('text')} AS t, {ext('path')} AS ext FROM code_lines"
CTES["go_marks"] = (
    "SELECT *, starts_with(t, 'import (') AS opens, t = ')' AS closes, "
    f"coalesce(last_value(CASE WHEN starts_with(t, 'import (') THEN true WHEN t = ')' THEN false END IGNORE NULLS) OVER ({W} {BEFORE}), false) AS inside "
    "FROM lines WHERE ext = 'go'"
)
CTES["go_lines"] = (
    f"SELECT *, CASE WHEN opens THEN '' WHEN inside THEN CASE WHEN closes THEN '' ELSE {cap('t', fixed.GO_IMPORT_QUOTED)} END "
    f"ELSE {cap('t', fixed.GO_IMPORT_SINGLE)} END AS imported, "
    f"opens OR inside OR {has('t', fixed.GO_IMPORT_SINGLE)} AS consumed FROM go_marks"
)
CTES["packages"] = (
    f"SELECT repo, path, arg_min({strip('substr(t, 9)')}, line_no) AS package FROM lines WHERE ext = 'go' AND starts_with(t, 'package ') GROUP BY repo, path "
    f"UNION ALL SELECT repo, path, arg_max({cap('t', fixed.PROTO_PACKAGE)}, line_no) FROM lines WHERE ext = 'proto' AND {has('t', fixed.PROTO_PACKAGE)} GROUP BY repo, path"
)
CTES["imported"] = (
    "SELECT repo, path, line_no, imported AS import FROM go_lines WHERE imported <> '' UNION ALL "
    f"SELECT repo, path, line_no, {cap('t', fixed.PROTO_IMPORT)} FROM lines WHERE ext = 'proto' AND {has('t', fixed.PROTO_IMPORT)}"
)
_proto = " UNION ALL ".join(
    f"SELECT repo, path, line_no, {i} AS kind_ord, {cap('t', p)} AS name, {lit(k)} AS kind FROM lines WHERE ext = 'proto' AND {has('t', p)}"
    for i, (k, p) in enumerate(fixed.PROTO_KINDS.items())
)
CTES["proto_decls"] = _proto
CTES["decls"] = (
    f"SELECT repo, path, line_no, 0 AS kind_ord, {cap('t', fixed.GO_TYPE, 1)} AS name, {cap('t', fixed.GO_TYPE, 2)} AS kind FROM go_lines WHERE NOT consumed AND {has('t', fixed.GO_TYPE)} UNION ALL "
    f"SELECT repo, path, line_no, 0, {cap('t', fixed.GO_FUNC, 1)}, 'func' FROM go_lines WHERE NOT consumed AND {has('t', fixed.GO_FUNC)} UNION ALL SELECT * FROM proto_decls"
)
CTES["comment_runs"] = (
    f"SELECT *, starts_with(t, '//') AS is_comment, {has('t', fixed.GO_TYPE)} AS is_type, "
    f"coalesce(sum(CASE WHEN starts_with(t, '//') THEN 0 ELSE 1 END) OVER ({W} {BEFORE}), 0) AS run FROM go_lines WHERE NOT consumed AND t <> ''"
)
CTES["descriptions"] = (
    "SELECT repo, path, arg_min(description, type_line) AS description FROM (SELECT c.repo, c.path, y.line_no AS type_line, "
    f"string_agg({cap('c.t', fixed.GO_COMMENT)}, ' ' ORDER BY c.line_no) AS description FROM comment_runs c JOIN comment_runs y "
    "ON c.repo = y.repo AND c.path = y.path AND c.run = y.run AND c.is_comment AND y.is_type GROUP BY ALL) x WHERE description <> '' GROUP BY repo, path"
)
CTES["todos"] = (
    "SELECT repo, path, count(*) FILTER (WHERE todo) AS todo_count, count(*) FILTER (WHERE fixme) AS fixme_count FROM ("
    "SELECT repo, path, contains(t, '// TODO') OR contains(t, '//TODO') AS todo, contains(t, '// FIXME') OR contains(t, '//FIXME') AS fixme FROM go_lines WHERE NOT consumed "
    "UNION ALL SELECT repo, path, contains(t, '// TODO'), contains(t, '// FIXME') FROM lines WHERE ext = 'proto') x WHERE todo OR fixme GROUP BY repo, path"
)
CTES["balance"] = (
    f"SELECT *, {count_of('t', '{')} - {count_of('t', '}')} AS delta, sum({count_of('t', '{')} - {count_of('t', '}')}) OVER ({W}) AS after FROM go_lines WHERE NOT consumed"
)
CTES["func_ends"] = (
    f"SELECT s.repo, s.path, s.line_no, {cap('s.t', fixed.GO_FUNC)} AS name, min(e.line_no) AS end_line FROM balance s LEFT JOIN balance e ON s.repo = e.repo AND s.path = e.path "
    f"AND e.line_no >= s.line_no AND contains(e.t, '}}') AND e.after <= s.after - s.delta WHERE {has('s.t', fixed.GO_FUNC)} GROUP BY ALL"
)
CTES["extents"] = (
    "SELECT repo, path, name, line_no AS start_line, end_line, end_line - line_no + 1 AS line_count FROM ("
    f"SELECT *, max(coalesce(end_line, 1000000000)) OVER ({W} {BEFORE}) AS covered FROM func_ends) x WHERE end_line IS NOT NULL AND (covered IS NULL OR covered < line_no)"
)
CTES["longest"] = "SELECT repo, path, name, start_line, line_count FROM extents QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY line_count DESC, start_line) = 1"
CTES["files"] = f"SELECT repo, path, repo || '/' || path AS id, service, {ext('path')} AS file_type FROM code_files"
CTES["line_counts"] = "SELECT repo, path, count(*) AS line_count FROM lines GROUP BY repo, path"
CTES["sizes"] = (
    "SELECT f.id, f.service, f.file_type, coalesce(c.line_count, 0) AS line_count, coalesce(todo_count, 0) AS todo_count, coalesce(fixme_count, 0) AS fixme_count "
    "FROM files f LEFT JOIN line_counts c USING (repo, path) LEFT JOIN todos USING (repo, path)"
)
CTES["fdecls"] = "SELECT f.id, f.service, d.line_no * 4 + d.kind_ord AS pos, d.name, d.kind FROM decls d JOIN files f USING (repo, path)"
CTES["fimports"] = "SELECT f.id, f.service, i.import FROM imported i JOIN files f USING (repo, path)"
CTES["idlines"] = "SELECT repo || '/' || path AS id, line_no, text FROM code_lines"

B = "CAST({} AS BIGINT) AS {}"


def big(*cols: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)


CHECKS["extract_package"] = "SELECT * FROM packages"
CHECKS["extract_imports"] = f"SELECT repo, path, {big('line_no')}, import FROM imported"
CHECKS["extract_types"] = f"SELECT repo, path, {big('line_no')}, name, kind FROM decls WHERE kind IN ('struct', 'interface')"
CHECKS["extract_funcs"] = f"SELECT repo, path, {big('line_no')}, name FROM decls WHERE kind = 'func'"
CHECKS["extract_description"] = "SELECT * FROM descriptions"
CHECKS["todo_counts"] = "SELECT * FROM todos"
CHECKS["function_extents"] = f"SELECT repo, path, name, {big('start_line', 'end_line', 'line_count')} FROM extents"
CHECKS["longest_function_per_file"] = f"SELECT repo, path, name, {big('start_line', 'line_count')} FROM longest"
CHECKS["big_functions"] = f"SELECT repo, path, name, {big('start_line', 'line_count')} FROM extents WHERE line_count >= 25"
CHECKS["extract_proto"] = f"SELECT repo, path, {big('line_no', 'kind_ord')}, name, kind FROM proto_decls"
CTES["parsed"] = (
    "SELECT f.repo, f.path, f.id, f.service, f.file_type, coalesce(c.line_count, 0) AS line_count, coalesce(p.package, '') AS package, "
    "coalesce(d.description, '') AS description, coalesce(todo_count, 0) AS todo_count, coalesce(fixme_count, 0) AS fixme_count, "
    "coalesce(i.imports, '') AS imports, coalesce(x.declarations, '') AS declarations, coalesce(x.n, 0) AS n, coalesce(x.listed, '') AS listed, l.name AS longest_name, l.line_count AS longest_lines, coalesce(b.bigs, '') AS big_functions "
    "FROM files f LEFT JOIN line_counts c USING (repo, path) LEFT JOIN packages p USING (repo, path) LEFT JOIN descriptions d USING (repo, path) LEFT JOIN todos USING (repo, path) "
    "LEFT JOIN (SELECT repo, path, string_agg(import, ',' ORDER BY line_no, import) AS imports FROM imported GROUP BY repo, path) i USING (repo, path) "
    "LEFT JOIN (SELECT repo, path, count(*) AS n, string_agg(kind || ' ' || name, ',' ORDER BY line_no, kind_ord) AS declarations, string_agg(kind || ' ' || name, ', ' ORDER BY line_no, kind_ord) AS listed FROM decls GROUP BY repo, path) x USING (repo, path) "
    "LEFT JOIN longest l USING (repo, path) "
    "LEFT JOIN (SELECT repo, path, string_agg(name || ' ' || line_count, ',' ORDER BY start_line) AS bigs FROM extents WHERE line_count >= 25 GROUP BY repo, path) b USING (repo, path)"
)
CHECKS["parsed_files"] = (
    f"SELECT repo, path, service, file_type, {big('line_count')}, package, description, {big('todo_count', 'fixme_count')}, imports, declarations, longest_name, {big('longest_lines')}, big_functions FROM parsed"
)
CHECKS["explode_lines"] = (
    "SELECT 'scan' AS flavour, repo, path, CAST(i AS BIGINT) AS line_no, regexp_replace(l[i], '\\r$', '') AS text FROM (SELECT lang AS repo, CAST(doc_id AS VARCHAR) AS path, string_split(text || chr(13) || chr(10) || 'last', chr(10)) AS l FROM documents) d, unnest(range(1, len(l) + 1)) AS u(i) "
    "UNION ALL SELECT 'split', repo, path, CAST(i AS BIGINT), l[i] FROM (SELECT lang AS repo, CAST(doc_id AS VARCHAR) AS path, string_split(text || chr(13) || chr(10) || 'last' || chr(10), chr(10)) AS l FROM documents) d, unnest(range(1, len(l) + 1)) AS u(i)"
)

# --- sources ---------------------------------------------------------------------------------------
CTES["listed"] = f"SELECT path, line_count, string_split(path, '/') AS p, {base('path')} AS name, {ext('path')} AS ext FROM listing"
_visible = f"len(list_filter(p[:-2], lambda d: starts_with(d, '.') OR list_contains({arr(fixed.EXCLUDED_DIRS)}, d))) = 0"
CTES["kept"] = f"SELECT * FROM listed WHERE {_visible}"
CTES["sources"] = "SELECT * FROM kept WHERE ext IN ('go', 'proto')"
CTES["tree"] = (
    "SELECT path, false AS is_dir FROM listed UNION ALL SELECT DISTINCT array_to_string(p[:i], '/'), true FROM listed, unnest(range(1, len(p))) AS u(i)"
)
CTES["treep"] = f"SELECT path, is_dir, string_split(path, '/') AS p, {base('path')} AS name FROM tree"
CTES["marked"] = (
    f"SELECT DISTINCT array_to_string(p[:-2], '/') AS path FROM treep WHERE len(p) > 1 AND (name IN {lits((*fixed.SERVICE_MARKERS, '.git'))} OR ends_with(name, '.csproj'))"
)
_cont = lits(fixed.CONTAINER_DIRS)
CTES["services"] = (
    "SELECT path FROM (SELECT path, string_split(path, '/') AS p FROM marked) m WHERE "
    f"len(list_filter(p, lambda d: starts_with(d, '.') OR list_contains({arr(fixed.EXCLUDED_DIRS)}, d))) = 0 AND (len(p) = 1 OR (p[1] NOT IN (SELECT path FROM marked) AND "
    f"((len(p) = 2 AND lower(p[1]) IN {_cont}) OR (len(p) = 3 AND lower(p[1]) NOT IN {_cont} AND lower(p[2]) IN {_cont}))))"
)


def _after(names) -> str:
    hit = f"list_filter(range(1, len(p)), lambda i: p[i] IN {lits(names)})"
    return f"p[list_min({hit}) + 1]"


CTES["assigned"] = (
    f"SELECT s.path, coalesce({base('v.path')}, CASE WHEN len(p) < 2 THEN 'root' WHEN p[1] IN (SELECT p[1] FROM treep WHERE len(p) = 2 AND name IN {lits(fixed.REPO_DIR_MARKERS)}) THEN p[1] "
    f"ELSE coalesce({_after(('cmd',))}, {_after(('services', 'service', 'apps', 'microservices', 'svc'))}, {_after(('proto', 'api', 'pkg'))}, {_after(('internal',))}, p[1]) END) AS service "
    "FROM sources s LEFT JOIN services v ON starts_with(s.path, v.path || '/') OR s.path = v.path"
)
_langs = {k: v for k, v in fixed.LANGUAGES.items()}
CTES["foreign_rows"] = (
    f"SELECT v.path AS service_path, {base('v.path')} AS name, k.path, k.p, k.line_count, d.lang FROM kept k JOIN {pairs(_langs, 'e', 'lang')} ON k.ext = d.e JOIN services v ON starts_with(k.path, v.path || '/')"
)
CTES["foreigns"] = (
    "SELECT name, arg_min(lang, p) AS language, service_path, CAST(sum(line_count) AS BIGINT) AS line_count, count(*) AS file_count FROM foreign_rows "
    "WHERE name NOT IN (SELECT service FROM assigned) GROUP BY name, service_path HAVING count(*) >= 2"
)
CHECKS["scan_source_files"] = "SELECT path FROM sources"
CHECKS["prune_dirs"] = "SELECT path FROM kept"
CHECKS["scan_manifests"] = f"SELECT path FROM listed WHERE name IN {lits(fixed.MANIFEST_NAMES)} AND (len(p) = 1 OR (len(p) = 2 AND NOT starts_with(path, '.')))"
CHECKS["directory_tree"] = "SELECT * FROM tree"
CHECKS["root_subdirs"] = f"SELECT path AS name FROM treep WHERE is_dir AND len(p) = 1 AND NOT starts_with(path, '.') AND path NOT IN {lits(fixed.EXCLUDED_DIRS)}"
CHECKS["list_repos"] = (
    "SELECT path, min(priority) AS priority FROM (SELECT array_to_string(p[:-2], '/') AS path, CAST(CASE WHEN len(p) = 1 THEN 0 WHEN len(p) = 2 AND NOT starts_with(path, '.') "
    f"AND p[1] NOT IN {lits(fixed.EXCLUDED_DIRS)} THEN 1 WHEN array_to_string(p[:-2], '/') IN (SELECT path FROM services) THEN 2 END AS BIGINT) AS priority FROM treep WHERE name = '.git') x WHERE priority IS NOT NULL GROUP BY path"
)
CHECKS["service_dirs"] = "SELECT path FROM marked"
CHECKS["discover_services"] = "SELECT path FROM services"
CHECKS["services_root"] = (
    "SELECT coalesce((SELECT string_split(path, '/')[1] AS r FROM services WHERE contains(path, '/') GROUP BY r HAVING count(*) >= 2 ORDER BY count(*) DESC, r LIMIT 1), '') AS services_root"
)
CHECKS["assign_service"] = "SELECT path, service FROM assigned"
CHECKS["files_by_service"] = "SELECT service, count(*) AS file_count, min(path) AS first_path, max(path) AS last_path FROM assigned GROUP BY service"
CHECKS["foreign_services"] = "SELECT name, language, service_path, line_count, file_count FROM foreigns"
CTES["touches"] = "SELECT f.repo, f.hash, f.path, f.added, c.repo_ord, c.author, c.ts, c.subject, c.log_seq FROM commit_files f JOIN commits c USING (repo, hash)"
CHECKS["ingest_commit_log"] = "SELECT repo, author, ts, subject, path FROM touches"
CHECKS["ingest_commits"] = (
    f"SELECT c.repo, c.hash, concat_ws(',', parent1, parent2) AS parents, author, {big('ts')}, string_split({strip('message')}, chr(10))[1] AS subject, {strip('message')} AS message, "
    "row_number() OVER (PARTITION BY c.repo ORDER BY c.log_seq) AS log_seq, coalesce(p.paths, '') AS paths FROM commits c "
    "LEFT JOIN (SELECT repo, hash, string_agg(path, ',' ORDER BY path) AS paths FROM commit_files GROUP BY repo, hash) p ON p.repo = c.repo AND p.hash = c.hash"
)
CHECKS["ingest_heads"] = (
    f"SELECT repo, name, {big('ts')}, md5(repo || '/' || name) AS tip, name = min(name) OVER (PARTITION BY repo) AS is_head FROM branches"
)
CHECKS["ingest_numstat"] = "SELECT author, path, CAST(sum(added) AS BIGINT) AS added FROM touches WHERE added IS NOT NULL GROUP BY author, path"
CHECKS["ingest_blame"] = f"SELECT repo, path, {big('line_no')}, 'by-' || ltrim(blame_hash, '0') AS author FROM code_lines"
CHECKS["ingest_refs"] = "SELECT repo, 'branch' AS kind, name, ts FROM branches UNION ALL SELECT repo, 'tag', tag, CAST(0 AS BIGINT) FROM tags"

# --- technologies ------------------------------------------------------------------------------------
CTES["import_tech"] = f"SELECT DISTINCT i.service, d.tech AS technology FROM fimports i JOIN {pairs(fixed.IMPORT_TECH, 'k', 'tech')} ON starts_with(i.import, d.k)"
CTES["gomod_tech"] = f"SELECT DISTINCT d.tech AS technology FROM manifest_lines m JOIN {pairs(fixed.GOMOD_TECH, 'k', 'tech')} ON starts_with({strip('m.text')}, d.k) WHERE {base('m.path')} = 'go.mod'"
CTES["make_tech"] = f"SELECT DISTINCT d.tech AS technology FROM manifest_lines m JOIN {pairs(fixed.MAKEFILE_TECH, 'k', 'tech')} ON contains(lower(m.text), d.k) WHERE {base('m.path')} = 'Makefile'"
_indent = "length(regexp_extract(text, '^[\\t ]*')) + length(replace(regexp_extract(text, '^[\\t ]*'), ' ', ''))"
CTES["compose_all"] = f"SELECT path, line_no, {strip('text')} AS t, {_indent} AS ind FROM manifest_lines WHERE {base('path')} IN {lits(fixed.COMPOSE_NAMES)}"
CTES["compose"] = (
    "SELECT * FROM (SELECT *, last_value(CASE WHEN t = 'services:' THEN ind END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) AS b FROM compose_all) x "
    "WHERE b IS NOT NULL AND t <> 'services:' AND t <> '' AND NOT starts_with(t, '#')"
)
CTES["image_tech"] = (
    "SELECT DISTINCT arg_max(d.tech, length(d.k)) AS technology FROM (SELECT path, line_no, lower(trim(" + strip("regexp_replace(t, '^image:', '')") + f", '\"''')) AS img FROM compose WHERE contains(t, 'image:')) c "
    f"JOIN {pairs(fixed.IMAGE_TECH, 'k', 'tech')} ON contains(c.img, d.k) GROUP BY c.path, c.line_no"
)
_hint_rows = " UNION ALL ".join(
    f"SELECT {lit(t)} AS technology FROM compose WHERE " + " OR ".join([f"contains(upper(t), {lit(w)})" for w in ws] + [f"contains(t, {lit(p)})"])
    for t, (ws, p) in fixed.COMPOSE_HINTS.items()
)
CTES["hint_tech"] = f"SELECT DISTINCT technology FROM ({_hint_rows}) h"
CTES["manifest_tech"] = "SELECT * FROM gomod_tech UNION SELECT * FROM make_tech UNION SELECT * FROM image_tech UNION SELECT * FROM hint_tech"
_pair = "(VALUES ('gRPC'), ('Protocol Buffers')) AS g(technology)"
CTES["techs"] = (
    f"SELECT * FROM manifest_tech UNION SELECT 'Go' UNION SELECT technology FROM import_tech UNION SELECT g.technology FROM files, {_pair} WHERE file_type = 'proto' UNION SELECT language FROM foreigns"
)
CTES["service_tech"] = f"SELECT service, technology FROM import_tech WHERE service <> '' UNION SELECT f.service, g.technology FROM files f, {_pair} WHERE f.file_type = 'proto' AND f.service <> ''"
for _q, _c in (("tech_from_imports", "import_tech"), ("tech_from_gomod", "gomod_tech"), ("tech_from_makefile", "make_tech"),
               ("tech_from_images", "image_tech"), ("tech_from_env_ports", "hint_tech"), ("manifest_technologies", "manifest_tech"),
               ("technology_list", "techs"), ("service_technologies", "service_tech")):
    CHECKS[_q] = f"SELECT * FROM {_c}"
CHECKS["compose_services"] = "SELECT DISTINCT regexp_replace(t, ':$', '') AS service FROM compose WHERE ind = b + 2 AND ends_with(t, ':')"
_low = "lower(id)"
_layer = (
    f"CASE WHEN ends_with(lower(id), '_test.go') OR list_has_any(string_split(lower(id), '/'), {arr(fixed.TEST_DIRS)}) THEN 'Tests' WHEN file_type = 'proto' THEN 'API / Routes' "
    + " ".join(
        f"WHEN {base(_low)} IN {lits(n)} OR list_has_any(string_split(lower(id), '/'), {arr(d)}) THEN {lit(layer)}"
        for layer, d, n in fixed.LAYER_RULES
    )
    + " ELSE 'Other' END"
)
CTES["layers"] = f"SELECT id, file_type, {_layer} AS layer FROM files"
_comp = ", ".join(f"({i}, {lit(a)}, {lit(b)}, {lit(c)})" for i, (a, b, c) in enumerate(fixed.COMPONENTS))
CTES["counts3"] = "SELECT (SELECT count(*) FROM decls WHERE kind = 'service') AS s, (SELECT count(*) FROM decls WHERE kind = 'rpc') AS r, (SELECT count(*) FROM layers WHERE layer = 'Tests') AS n"
CHECKS["components"] = (
    "SELECT CAST(o AS BIGINT) AS component_ord, c AS component, CASE WHEN t = 'gRPC' THEN 'gRPC' || CASE WHEN s > 0 THEN ' · ' || s || ' services' ELSE '' END || CASE WHEN r > 0 THEN ' · ' || r || ' RPCs' ELSE '' END "
    f"WHEN t = 'Testify' AND n > 0 THEN 'Testify · ' || n || ' test files' ELSE b END AS summary FROM counts3, (VALUES {_comp}) AS k(o, t, c, b) WHERE t IN (SELECT technology FROM techs)"
)

# --- graph ---------------------------------------------------------------------------------------------
CTES["fids"] = "SELECT f.id, f.service, f.file_type, coalesce(p.package, '') AS package FROM files f LEFT JOIN packages p USING (repo, path)"
CTES["names"] = (
    "SELECT name, arg_max(id, ord) AS id FROM (SELECT regexp_replace(" + base("id") + ", '\\.[^.]*$', '') AS name, id, list_append(string_split(id, '/'), '0') AS ord FROM fids "
    "UNION ALL SELECT package, id, list_append(string_split(id, '/'), '1') FROM fids WHERE package <> '') x GROUP BY name"
)
CTES["imp_edges"] = f"SELECT DISTINCT i.id AS src, n.id AS dst FROM fimports i JOIN names n ON n.name = {base('i.import')} WHERE i.id <> n.id"
CTES["words"] = "SELECT DISTINCT id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word FROM idlines"
CTES["ref_decls"] = (
    "SELECT CASE WHEN service = '' THEN '__root__' ELSE service END AS service, name, id, row_number() OVER (PARTITION BY service ORDER BY string_split(id, '/'), pos) AS n "
    "FROM fdecls WHERE kind IN ('struct', 'interface', 'message', 'service') AND strlen(name) >= 3"
)
_ref = (
    "SELECT DISTINCT f.id AS src, d.id AS dst FROM words w JOIN fids f USING (id) JOIN ref_decls d ON d.name = w.word AND d.service = CASE WHEN f.service = '' THEN '__root__' ELSE f.service END WHERE f.id <> d.id"
)
CTES["ref_edges"] = _ref
CTES["edges"] = "SELECT * FROM imp_edges UNION SELECT * FROM ref_edges"
CTES["degree"] = "SELECT f.id, (SELECT count(*) FROM edges e WHERE e.src = f.id) AS out_degree, (SELECT count(*) FROM edges e WHERE e.dst = f.id) AS in_degree FROM fids f"
CHECKS["vertices"] = "SELECT id FROM files"
CHECKS["name_map"] = "SELECT name, id FROM names"
CHECKS["import_edges"] = "SELECT * FROM imp_edges"
CHECKS["type_ref_edges"] = "SELECT * FROM ref_edges"
CHECKS["type_ref_words"] = (
    "SELECT lang AS grp, word, count(*) AS mentions FROM (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word FROM documents) d "
    "WHERE length(word) >= 3 AND word IN (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) FROM benchmark) GROUP BY lang, word"
)
CHECKS["edges"] = "SELECT * FROM edges"
CHECKS["degrees"] = "SELECT * FROM degree"
CHECKS["page_link_degrees"] = (
    "SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT DISTINCT '/p' || page_id AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS dst FROM pages) l, "
    "LATERAL (SELECT src AS id, 1 AS o, 0 AS i UNION ALL SELECT dst, 0, 1) e GROUP BY id"
)
_ROUNDS = 100
CTES["out_links"] = "SELECT src, dst, count(*) OVER (PARTITION BY src) AS out_degree FROM edges"
CTES["nv"] = "SELECT count(*) AS n FROM fids"
CTES["rank0"] = "SELECT id, 1.0::DOUBLE / n AS score FROM fids, nv"
for _i in range(1, _ROUNDS + 1):
    CTES[f"rank{_i}"] = (
        f"SELECT v.id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(g.got, 0) AS score FROM fids v CROSS JOIN nv LEFT JOIN "
        f"(SELECT dst, sum(r.score / out_degree) AS got FROM out_links JOIN rank{_i - 1} r ON r.id = src GROUP BY dst) g ON g.dst = v.id"
    )
_hot = f"SELECT id, score FROM rank{_ROUNDS} ORDER BY round(score, 12) DESC, id LIMIT 30"
CTES["hot"] = _hot
CHECKS["pagerank"] = f"SELECT id, round(score, 9) AS score FROM rank{_ROUNDS}"
CHECKS["top_hotspots"] = "SELECT id, round(score, 9) AS score FROM hot"
CTES["hot10"] = (
    f"SELECT h.id, h.score, CASE WHEN f.service = '' THEN 'root' ELSE f.service END AS service, f.line_count, (SELECT count(*) FROM fdecls d WHERE d.id = h.id) AS declaration_count "
    f"FROM (SELECT * FROM hot WHERE {base('id')} <> 'module.go' ORDER BY round(score, 12) DESC, id LIMIT 10) h JOIN sizes f USING (id)"
)
_rel = (
    "CASE WHEN contains(id, '/' || service || '/') THEN substr(id, instr(id, '/' || service || '/') + length(service) + 2) "
    f"WHEN len(string_split(id, '/')) > 3 THEN {last3('id')} ELSE {base('id')} END"
)
CHECKS["hot_zones"] = (
    "SELECT id, regexp_extract(rel, '^(.*/)', 1) AS display_dir, regexp_extract(rel, '[^/]*$') AS display_file, round(score, 9) AS score, "
    f"{big('line_count', 'declaration_count')}, service FROM (SELECT *, {_rel} AS rel FROM hot10) x"
)
CTES["node_pool"] = (
    "SELECT service, id AS file, 0 AS slot, pos, name, kind FROM fdecls WHERE kind IN ('struct', 'interface', 'message', 'service', 'enum') AND strlen(name) >= 3 UNION ALL "
    "SELECT service, file, slot, pos, name, 'func' FROM (SELECT service, id AS file, 0 AS slot, pos, name FROM fdecls WHERE kind = 'func' AND strlen(name) >= 3 UNION ALL "
    "SELECT f.service, f.id, 1, e.start_line * 4, e.name FROM extents e JOIN files f USING (repo, path) WHERE e.line_count >= 25) b "
    "QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY slot, pos) = 1"
)
CTES["nodes"] = (
    f"SELECT service, file || '::' || name AS id, file, name, kind, greatest(coalesce(d.score, 0), 0.001::DOUBLE) AS score FROM node_pool p LEFT JOIN rank{_ROUNDS} d ON d.id = p.file"
)
CTES["node_refs"] = (
    "SELECT DISTINCT s.service, s.id AS src, g.id AS dst, s.kind AS src_kind, g.kind AS dst_kind, g.score AS dst_score FROM nodes s JOIN nodes g ON g.service = s.service AND g.file <> s.file AND g.name <> s.name AND strlen(g.name) > 4 "
    "JOIN words w ON w.id = s.file AND w.word = g.name"
)
CTES["node_pairs"] = (
    "SELECT DISTINCT s.service, s.id AS src, g.id AS dst, g.score AS dst_score FROM nodes s JOIN nodes g ON g.file = s.file AND g.name <> s.name "
    "WHERE s.file IN (SELECT file FROM nodes GROUP BY file HAVING count(*) BETWEEN 2 AND 20)"
)
CTES["node_msgs"] = (
    "SELECT DISTINCT s.service, s.id AS src, g.id AS dst, g.score AS dst_score FROM nodes s JOIN nodes g ON g.service = s.service AND g.kind = 'message' AND strlen(g.name) > 4 "
    "JOIN words w ON w.id = s.file AND w.word = g.name WHERE s.kind = 'service'"
)
CTES["node_links"] = (
    "SELECT service, src, dst, max(dst_score) AS dst_score FROM (SELECT service, src, dst, dst_score FROM node_refs UNION ALL SELECT * FROM node_pairs UNION ALL SELECT * FROM node_msgs) x GROUP BY service, src, dst"
)
CTES["capped"] = (
    "SELECT service, src, dst FROM (SELECT l.service, l.src, l.dst, row_number() OVER (PARTITION BY l.service ORDER BY l.src, l.dst) AS m, q.quota FROM "
    "(SELECT * FROM node_links QUALIFY row_number() OVER (PARTITION BY service, src ORDER BY round(dst_score, 12) DESC, dst) <= 5) l "
    "JOIN (SELECT service, greatest(10, 3 * count(*)) AS quota FROM nodes GROUP BY service) q ON q.service = l.service) x WHERE m <= quota"
)
CHECKS["decl_nodes"] = "SELECT service, id, name, kind, CAST(round(score, 6) AS DOUBLE) AS score FROM nodes"
CHECKS["decl_ref_edges"] = "SELECT DISTINCT service, src, dst FROM (SELECT DISTINCT service, src, dst, src_kind, dst_kind, dst_score FROM node_refs) x"
CHECKS["colocation_edges"] = "SELECT service, src, dst FROM node_pairs"
CHECKS["colocation_groups"] = (
    "SELECT s.service, s.file, s.id, count(DISTINCT g.id) AS n_links FROM nodes s LEFT JOIN nodes g ON g.service = s.service AND g.file = s.file AND g.name <> s.name GROUP BY s.service, s.file, s.id"
)
CHECKS["service_message_edges"] = "SELECT service, src, dst FROM node_msgs"
CHECKS["func_call_edges"] = "SELECT service, src, dst FROM node_refs WHERE src_kind = 'func' AND dst_kind = 'func'"
CHECKS["cap_out_edges"] = "SELECT service, src, dst FROM capped"
CHECKS["drop_orphans"] = "SELECT service, id, kind FROM nodes WHERE (service, id) IN (SELECT (service, src) FROM capped UNION SELECT (service, dst) FROM capped)"
CTES["summaries"] = (
    "SELECT f.service, f.files, f.total_lines, coalesce(d.declarations, 0) AS declarations, "
    + ", ".join(f"coalesce(d.{n}, 0) AS {n}" for n in marts.KINDS)
    + " FROM (SELECT CASE WHEN service = '' THEN 'root' ELSE service END AS service, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS total_lines FROM sizes GROUP BY 1) f "
    "LEFT JOIN (SELECT CASE WHEN service = '' THEN 'root' ELSE service END AS service, count(*) AS declarations, "
    + ", ".join(f"count(*) FILTER (WHERE kind = {lit(k)}) AS {n}" for n, k in marts.KINDS.items())
    + " FROM fdecls GROUP BY 1) d USING (service)"
)
CTES["arch_used"] = "SELECT service, technology FROM service_tech WHERE service IN (SELECT service FROM summaries)"
CHECKS["architecture_graph"] = (
    "SELECT 'node' AS part, 'ms:' || service AS id, service AS label, 'microservice' AS kind, CAST(round(total_lines / 1000.0, 6) AS DOUBLE) AS score, '' AS target FROM summaries UNION ALL "
    "SELECT 'node', 'ms:' || name, name, 'foreign', CAST(round(line_count / 1000.0, 6) AS DOUBLE), '' FROM foreigns UNION ALL "
    "SELECT 'node', 'tech:' || technology, technology, 'technology', CAST(3 AS DOUBLE), '' FROM techs WHERE technology <> 'Go' AND technology IN (SELECT technology FROM arch_used UNION SELECT language FROM foreigns) UNION ALL "
    "SELECT 'link', 'ms:' || service, '', '', CAST(0 AS DOUBLE), 'tech:' || technology FROM arch_used WHERE technology <> 'Go' UNION ALL "
    "SELECT 'link', 'ms:' || name, '', '', CAST(0 AS DOUBLE), 'tech:' || language FROM foreigns"
)

# --- history -------------------------------------------------------------------------------------------
CTES["author_totals"] = "SELECT author, count(*) AS total_commits, min(ts) AS first_commit, max(ts) AS last_commit FROM commits WHERE ts > 0 GROUP BY author"
CTES["file_tops"] = (
    "SELECT repo, path, author, n FROM (SELECT repo, path, author, row_number() OVER (PARTITION BY repo, path ORDER BY count(*) DESC, author) AS n FROM touches GROUP BY repo, path, author) x WHERE n <= 3"
)
CTES["tops"] = "SELECT repo, path, string_agg(author, ',' ORDER BY n) AS top_authors FROM file_tops GROUP BY repo, path"
CTES["recent"] = (
    "SELECT repo, path, string_agg(subject, '|' ORDER BY n) AS recent_messages FROM (SELECT repo, path, subject, row_number() OVER (PARTITION BY repo, path ORDER BY log_seq, hash) AS n FROM touches) x WHERE n <= 5 GROUP BY repo, path"
)
CTES["fstats"] = "SELECT repo, path, count(*) AS change_count, max(ts) AS last_modified, min(ts) AS first_commit_date FROM touches GROUP BY repo, path"
CHECKS["latest_commits"] = f"SELECT repo, hash, {big('log_seq')} FROM commits"
CHECKS["author_stats"] = "SELECT * FROM author_totals"
CHECKS["write_marts"] = "SELECT *, '2024-01-01' AS run_date FROM author_totals"
CHECKS["file_stats"] = "SELECT * FROM fstats"
CHECKS["top_authors_per_file"] = "SELECT * FROM tops"
CHECKS["recent_messages"] = "SELECT * FROM recent"
CHECKS["enrich_files"] = (
    "SELECT f.id, f.service, s.change_count, s.last_modified, s.first_commit_date, t.top_authors, r.recent_messages FROM files f LEFT JOIN fstats s USING (repo, path) LEFT JOIN tops t USING (repo, path) LEFT JOIN recent r USING (repo, path)"
)
CTES["modified"] = "SELECT t.author, f.service, count(*) AS files_modified FROM files f JOIN file_tops t USING (repo, path) WHERE t.author IN (SELECT author FROM author_totals) GROUP BY t.author, f.service"
CHECKS["author_files_modified"] = "SELECT * FROM modified"
CTES["locs"] = "SELECT author, CAST(sum(added) AS BIGINT) AS loc_added FROM touches WHERE added IS NOT NULL AND author IN (SELECT author FROM author_totals) GROUP BY author"
CHECKS["author_loc"] = "SELECT * FROM locs"
CTES["churned"] = "SELECT repo || '/' || path AS path, count(*) AS change_count FROM touches GROUP BY 1 ORDER BY change_count DESC, path LIMIT 50"
CHECKS["churn"] = "SELECT c.path, c.change_count, t.top_authors FROM churned c JOIN tops t ON t.repo || '/' || t.path = c.path"
CHECKS["churn_display"] = f"SELECT path, CASE WHEN len(string_split(path, '/')) > 4 THEN '…/' || {last3('path')} ELSE path END AS display_path, change_count FROM churned"
CTES["tagset"] = f"SELECT DISTINCT tag, {has('tag', fixed.SEMVER)} AS sem FROM tags WHERE tag <> ''"
CTES["tagstat"] = "SELECT count(*) AS total_tags, count(*) FILTER (WHERE sem) AS semver_tags FROM tagset"
_num = "coalesce(TRY_CAST(CASE WHEN regexp_matches(regexp_extract({0}, '^[-+]*([^-+]*)', 1), '^[0-9]+$') THEN regexp_extract({0}, '^[-+]*([^-+]*)', 1) END AS BIGINT), 0)"
_bare = "regexp_replace(tag, '^v', '')"
CTES["lastver"] = (
    "SELECT coalesce((SELECT tag FROM tagset WHERE sem ORDER BY "
    + _num.format(f"string_split({_bare}, '.')[1]") + " DESC, " + _num.format(f"string_split({_bare}, '.')[2]") + " DESC, "
    + _num.format(f"array_to_string(string_split({_bare}, '.')[3:], '.')") + " DESC, tag LIMIT 1), '') AS latest_semver"
)
CHECKS["tag_stats"] = "SELECT * FROM tagstat"
CHECKS["latest_semver"] = "SELECT * FROM lastver"
CTES["classified"] = (
    f"SELECT hash, repo_ord, log_seq, subject, CASE WHEN {has('subject', fixed.CONVENTIONAL)} THEN {cap('subject', fixed.CONVENTIONAL)} WHEN {has('subject', fixed.TICKET)} THEN 'ticket' END AS commit_type FROM commits"
)
CHECKS["classify_commits"] = "SELECT hash, commit_type FROM classified"
CTES["cstats"] = "SELECT count(*) AS total, count(commit_type) AS typed FROM classified"
CHECKS["commit_stats"] = "SELECT * FROM cstats"
CHECKS["commit_type_counts"] = "SELECT commit_type, count(*) AS commits FROM classified WHERE commit_type IS NOT NULL GROUP BY commit_type"
CHECKS["nonstandard_samples"] = f"SELECT {big('repo_ord', 'log_seq')}, hash, subject FROM classified WHERE commit_type IS NULL ORDER BY repo_ord, log_seq LIMIT 5"
CHECKS["semantic_standards"] = (
    "SELECT total_tags, semver_tags, CAST(semver_tags * 100 // total_tags AS BIGINT) AS semver_pct, latest_semver, total, typed, CAST(typed * 100 // total AS BIGINT) AS conventional_pct FROM tagstat, lastver, cstats"
)
_repos = ", ".join(f"({lit(r)}, {o})" for r, o in standins.BLAME_REPOS)
CHECKS["line_authors"] = (
    f"SELECT path, {big('line_no')}, author FROM (SELECT c.path, c.line_no, c.author, o, min(o) OVER (PARTITION BY path) AS first_o FROM blame_claims c JOIN (VALUES {_repos}) AS r(repo, o) USING (repo) WHERE starts_with(path, repo)) x WHERE o = first_o"
)
CTES["mains"] = (
    "SELECT repo, CASE WHEN bool_or(name = 'main') THEN 'main' WHEN bool_or(name = 'master') THEN 'master' ELSE 'HEAD' END AS main_branch, max(CASE WHEN name IN ('main', 'master', 'HEAD') THEN tip END) AS tip FROM branches LEFT JOIN tips USING (repo) GROUP BY repo"
)
CTES["inventory"] = "SELECT name, repo, ts, CAST(len(string_split(name, '/')) AS BIGINT) AS depth FROM branches QUALIFY row_number() OVER (PARTITION BY name ORDER BY repo_ord) = 1"
CTES["stale"] = (
    f"SELECT name, ts AS last_activity, CAST(({standins.NOW} - ts) // 86400 AS BIGINT) AS days_inactive FROM inventory WHERE name NOT IN {lits(fixed.NEVER_STALE)} AND ts > 0 AND ts < {standins.NOW} - 30 * 86400 ORDER BY days_inactive DESC, name LIMIT 20"
)
CHECKS["default_branch"] = "SELECT * FROM mains"
CHECKS["branch_inventory"] = "SELECT * FROM inventory"
CHECKS["stale_branches"] = "SELECT * FROM stale"
CTES["parents"] = "SELECT repo, hash, parent1 AS parent FROM commits WHERE parent1 IS NOT NULL UNION ALL SELECT repo, hash, parent2 FROM commits WHERE parent2 IS NOT NULL"
CTES["on_main"] = "SELECT repo, tip AS hash FROM mains UNION SELECT p.repo, p.parent FROM on_main m JOIN parents p ON p.repo = m.repo AND p.hash = m.hash"
CTES["mcommits"] = "SELECT c.* FROM commits c JOIN on_main USING (repo, hash)"
CTES["merges"] = "SELECT repo, hash AS merge, ts AS merge_ts, parent1, parent2 FROM mcommits WHERE parent2 IS NOT NULL AND ts > 0"
CTES["old_side"] = "SELECT repo, merge, parent1 AS hash FROM merges UNION SELECT p.repo, o.merge, p.parent FROM old_side o JOIN parents p ON p.repo = o.repo AND p.hash = o.hash"
CTES["new_side"] = "SELECT repo, merge, parent2 AS hash FROM merges UNION SELECT p.repo, o.merge, p.parent FROM new_side o JOIN parents p ON p.repo = o.repo AND p.hash = o.hash"
CTES["ranges"] = "SELECT r.repo, r.merge, r.hash, c.ts FROM (SELECT * FROM new_side EXCEPT SELECT * FROM old_side) r JOIN commits c USING (repo, hash)"
CTES["spans"] = "SELECT m.merge_ts, min(r.ts) AS lo, max(r.ts) AS hi FROM ranges r JOIN merges m USING (repo, merge) GROUP BY r.repo, r.merge, m.merge_ts"


def _mean(e: str, below: int, name: str) -> str:
    return f"round(coalesce(avg({e}) FILTER (WHERE {e} >= 0 AND {e} < {below}), 0), 6) AS {name}"


CTES["durations"] = (
    f"SELECT {_mean('((hi - lo) / 86400)', 365, 'avg_lifetime_days')}, {_mean('((merge_ts - lo) / 86400)', 730, 'avg_merge_days')}, {_mean('((merge_ts - hi) / 3600)', 8760, 'avg_delay_hours')} FROM spans"
)
CTES["rollbacks"] = (
    "SELECT count(*) FILTER (WHERE contains(lower(message), 'revert') OR contains(lower(message), 'rollback')) AS rollbacks, count(*) AS main_commits, "
    "CAST(round(100.0 * count(*) FILTER (WHERE contains(lower(message), 'revert') OR contains(lower(message), 'rollback')) / count(*), 1) AS DOUBLE) AS rollback_pct FROM mcommits"
)
CTES["peak"] = (
    "SELECT dayname(to_timestamp(ts) AT TIME ZONE 'UTC') AS peak_day, count(*) AS commits FROM commits WHERE ts > 0 "
    "GROUP BY 1, dayofweek(to_timestamp(ts) AT TIME ZONE 'UTC') ORDER BY count(*) DESC, dayofweek(to_timestamp(ts) AT TIME ZONE 'UTC') LIMIT 1"
)
CHECKS["merge_commit_ranges"] = "SELECT * FROM ranges"
CHECKS["branch_durations"] = "SELECT * FROM durations"
CHECKS["rollback_rate"] = "SELECT * FROM rollbacks"
CHECKS["peak_commit_day"] = "SELECT * FROM peak"
CHECKS["main_commit_count"] = "SELECT count(*) AS main_commits FROM on_main"
CHECKS["branch_health"] = (
    "SELECT (SELECT count(*) FROM inventory) AS total_branches, (SELECT max(depth) FROM inventory) AS max_depth, (SELECT count(*) FROM stale) AS stale_branches, d.*, r.*, p.peak_day FROM durations d, rollbacks r, peak p"
)

# --- rules ---------------------------------------------------------------------------------------------
CTES["rlines"] = (
    f"SELECT repo, path, line_no, text, {strip('text')} AS t, ends_with(path, '_test.go') AS is_test, {count_of('text', '{')} AS op, {count_of('text', '}')} AS cl "
    f"FROM code_lines WHERE {ext('path')} <> 'proto' AND NOT ends_with(path, '.pb.go')"
)
_note = "starts_with(t, '//')"
_x = "text"
_words = " OR ".join(f"contains(lower({cap(_x, fixed.SECRET, 2)}), {lit(w)})" for w in fixed.SECRET_SKIP_WORDS)
_SINGLE = {
    "rule_hardcoded_secret": f"NOT is_test AND NOT {_note} AND {has(_x, fixed.SECRET)} AND NOT ({_words})",
    "rule_sql_injection": f"{has(_x, fixed.SQL_CONCAT)} OR {has(_x, fixed.SQL_SPRINTF)}",
    "rule_math_rand": "NOT is_test AND contains(text, '\"math/rand\"')",
    "rule_panic": f"NOT is_test AND NOT ends_with(path, 'main.go') AND NOT {_note} AND {has(_x, fixed.PANIC_CALL)}",
    "rule_type_assert": f"NOT contains(text, ', ok') AND NOT contains(text, ',ok') AND NOT contains(text, '.(type)') AND {has(_x, fixed.TYPE_ASSERT)}",
    "rule_error_not_wrapped": has(_x, fixed.ERROR_NOT_WRAPPED),
    "rule_sleep_sync": f"NOT is_test AND {has(_x, fixed.TIME_SLEEP)}",
    "rule_big_channel": f"TRY_CAST({cap(_x, fixed.CHANNEL_BUFFER)} AS BIGINT) > 1",
    "rule_sleep_in_tests": f"is_test AND {has(_x, fixed.TIME_SLEEP)}",
    "rule_naked_return": has(_x, fixed.NAKED_RETURN),
    "rule_ptr_interface": f"NOT {_note} AND contains(text, '*interface{{')",
    "rule_package_underscore": has(_x, fixed.PACKAGE_UNDERSCORE),
    "rule_init_func": f"NOT is_test AND {has(_x, fixed.INIT_FUNC)}",
    "rule_sprintf_int": has(_x, fixed.SPRINTF_INT),
    "rule_ignored_errors": f"NOT (instr(text, '//') > 0 AND instr(text, '_ =') > 0 AND instr(text, '//') < instr(text, '_ =')) AND {has(_x, fixed.IGNORED_ERROR)}",
    "rule_unchecked_close": has(_x, fixed.DEFER_CLOSE),
}
_HITS = {k: f"SELECT repo, path, line_no, line_no AS trigger_line, text FROM rlines WHERE {c}" for k, c in _SINGLE.items()}
for _k in rules.FIRST_PER_FILE:
    _HITS[_k] += " QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY line_no) = 1"


def _next(a: str, b: str) -> str:
    return f"ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING"


_HITS["rule_unclosed_body"] = (
    f"SELECT repo, path, line_no, line_no AS trigger_line, text FROM (SELECT *, bool_or({has(_x, fixed.BODY_CLOSE)}) OVER ({W} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS closed FROM rlines) x "
    f"WHERE contains(text, ':=') AND {has(_x, fixed.HTTP_CALL)} AND NOT closed"
)
_HITS["rule_loop_var_goroutine"] = (
    "SELECT g.repo, g.path, g.line_no, f.line_no AS trigger_line, g.text FROM (SELECT r.repo, r.path, r.line_no, min(g.line_no) AS go_line FROM rlines r JOIN rlines g ON g.repo = r.repo AND g.path = r.path AND g.line_no > r.line_no AND g.line_no < r.line_no + 20 "
    f"WHERE {has('r.text', fixed.FOR_RANGE)} AND {has('g.text', fixed.GO_FUNC_START)} GROUP BY ALL) f JOIN rlines g ON g.repo = f.repo AND g.path = f.path AND g.line_no = f.go_line "
    f"WHERE NOT EXISTS (SELECT 1 FROM rlines k WHERE k.repo = g.repo AND k.path = g.path AND k.line_no >= g.line_no AND k.line_no < g.line_no + 10 AND {has('k.text', fixed.ASSIGN_WORDS)} "
    f"AND len(string_split(k.text, ':=')) = 2 AND {strip('string_split(k.text, chr(58) || chr(61))[1]')} = {strip('string_split(k.text, chr(58) || chr(61))[2]')})"
)
CTES["mutex_marks"] = f"SELECT *, {cap('t', fixed.STRUCT_START)} AS struct_name, max(CASE WHEN {has('t', fixed.STRUCT_START)} THEN line_no END) OVER ({W}) AS block FROM rlines"
CTES["mutex_depth"] = "SELECT *, 1 + sum(CASE WHEN line_no = block THEN 0 ELSE op - cl END) OVER (PARTITION BY repo, path, block ORDER BY line_no) AS depth FROM mutex_marks WHERE block IS NOT NULL"
CTES["mutex_live"] = f"SELECT *, coalesce(min(depth) OVER (PARTITION BY repo, path, block ORDER BY line_no {BEFORE}), 1) > 0 AS live FROM mutex_depth"
CTES["mutex_types"] = f"SELECT DISTINCT m.repo, m.path, s.struct_name FROM mutex_live m JOIN mutex_marks s ON s.repo = m.repo AND s.path = m.path AND s.line_no = m.block WHERE m.live AND m.line_no <> m.block AND {has('m.text', fixed.MUTEX_FIELD)}"
_HITS["rule_copy_mutex"] = (
    "SELECT DISTINCT r.repo, r.path, r.line_no, r.line_no AS trigger_line, r.text FROM rlines r JOIN mutex_types m USING (repo, path) WHERE contains(r.text, 'func ') "
    "AND regexp_matches(r.text, '[^*\\w]' || m.struct_name || '[\\s,)]') AND NOT regexp_matches(r.text, '\\*' || m.struct_name || '\\b')"
)
_FORL = has(_x, fixed.FOR_LINE)


def _loop(up: str, down: str, target: str) -> str:
    return (
        "SELECT repo, path, line_no, line_no AS trigger_line, text FROM (SELECT *, s - step - least(0, coalesce(min(s) OVER (" + W + " " + BEFORE + "), 0)) + up AS depth FROM ("
        f"SELECT *, sum(up - down) OVER ({W}) AS s, up - down AS step FROM (SELECT *, {up} AS up, {down} AS down FROM rlines WHERE NOT {_note}) a) b) c WHERE depth > 0 AND {target}"
    )


_HITS["rule_defer_in_loop"] = _loop(f"CASE WHEN {_FORL} AND op > cl THEN 1 ELSE 0 END", "CASE WHEN cl > op THEN 1 ELSE 0 END", has(_x, fixed.DEFER_LINE))
_HITS["rule_bytes_in_loop"] = _loop(f"CASE WHEN {_FORL} THEN 1 ELSE 0 END", "greatest(cl - op, 0)", "contains(text, '[]byte(')")
CTES["fb_marks"] = f"SELECT *, max(CASE WHEN contains(text, 'func ') AND op > cl THEN line_no END) OVER ({W}) AS block FROM rlines"
CTES["fb_depth"] = "SELECT *, 1 + sum(CASE WHEN line_no = block THEN 0 ELSE op - cl END) OVER (PARTITION BY repo, path, block ORDER BY line_no) AS depth FROM fb_marks WHERE block IS NOT NULL"
CTES["fb_live"] = f"SELECT *, coalesce(min(depth) OVER (PARTITION BY repo, path, block ORDER BY line_no {BEFORE}), 1) > 0 AS live FROM fb_depth"
for _k, _lack in (("rule_rows_err", "contains(text, 'rows.Err()')"), ("rule_rows_close", has(_x, fixed.ROWS_CLOSE))):
    _HITS[_k] = (
        f"SELECT r.repo, r.path, r.line_no, r.line_no AS trigger_line, r.text FROM rlines r JOIN (SELECT repo, path, block FROM fb_live WHERE live AND line_no <> block GROUP BY repo, path, block "
        f"HAVING bool_or(contains(text, '.Next()')) AND NOT bool_or({_lack})) b ON b.repo = r.repo AND b.path = r.path AND b.block = r.line_no"
    )
_HITS["rule_slice_prealloc"] = (
    "SELECT repo, path, line_no, line_no AS trigger_line, text FROM (SELECT *, min(CASE WHEN " + _FORL + f" THEN line_no END) OVER ({W} {_next('1', '29')}) AS ff, max(CASE WHEN {has(_x, fixed.APPEND_CALL)} THEN line_no END) OVER ({W} {_next('1', '29')}) AS la FROM rlines) x "
    f"WHERE ({has(_x, fixed.MAKE_EMPTY_SLICE)} OR {has(_x, fixed.VAR_SLICE)}) AND ff <= la"
)
_ind4 = "length(regexp_extract(text, '^[\\t ]*')) + 3 * length(replace(regexp_extract(text, '^[\\t ]*'), ' ', ''))"
CTES["ind_lines"] = f"SELECT repo, path, line_no, text, {_ind4} AS ind, {has(_x, fixed.ERR_DECLARED)} AS decl FROM rlines WHERE t <> '' AND NOT {_note}"
CTES["err_lines"] = f"SELECT repo, path, line_no, {_ind4} AS ind FROM rlines WHERE {has(_x, fixed.ERR_DECLARED)}"
_HITS["rule_err_shadowing"] = (
    "SELECT i.repo, i.path, i.line_no, x.line_no AS trigger_line, i.text FROM (SELECT e.repo, e.path, e.line_no, min(CASE WHEN j.ind <= e.ind THEN j.line_no END) AS stop, min(CASE WHEN j.ind > e.ind AND j.decl THEN j.line_no END) AS again "
    "FROM err_lines e JOIN ind_lines j ON j.repo = e.repo AND j.path = e.path AND j.line_no > e.line_no AND j.line_no < e.line_no + 30 GROUP BY ALL) x JOIN ind_lines i ON i.repo = x.repo AND i.path = x.path AND i.line_no = x.again WHERE stop IS NULL OR again < stop"
)
_HITS["rule_test_error_check"] = (
    f"SELECT repo, path, line_no, line_no AS trigger_line, text FROM (SELECT *, coalesce(bool_or({has(_x, fixed.TEST_ERR_CHECK)}) OVER ({W} {_next('1', '3')}), false) AS checked FROM rlines) x WHERE is_test AND {has(_x, fixed.ERR_DECLARED)} AND NOT checked"
)
for _r in rules.RULES:
    CTES[f"hits_{_r.key}"] = _HITS[_r.key]
    CHECKS[_r.key] = f"SELECT repo, path, {big('line_no', 'trigger_line')}, {snip('text')} AS snippet FROM hits_{_r.key}"
CTES["all_hits"] = " UNION ALL ".join(f"SELECT {lit(k)} AS rule, repo, path, line_no, trigger_line, text FROM hits_{k}" for k in rules.ACTIVE)
_abs = "repo || '/' || path"
CHECKS["run_rules"] = f"SELECT rule, {last3(_abs)} AS display_path, {big('line_no')}, {snip('text')} AS snippet FROM all_hits"
CHECKS["violation_authors"] = (
    f"SELECT c.rule, c.repo, c.path, CAST(c.line_no AS BIGINT) AS line_no, l.author FROM all_hits c JOIN code_lines l USING (repo, path, line_no)"
)
_reg = ", ".join(f"({i}, {lit(r.key)}, {lit(r.priority)})" for i, r in enumerate(rules.RULES) if not r.dormant)
CHECKS["rule_summary"] = f"SELECT CAST(o AS BIGINT) AS rule_ord, k.rule, priority, (SELECT count(*) FROM all_hits c WHERE c.rule = k.rule) AS violations, (SELECT count(*) FROM all_hits c WHERE c.rule = k.rule) = 0 AS passed FROM (VALUES {_reg}) AS k(o, rule, priority)"

# --- report tables -------------------------------------------------------------------------------------
CHECKS["totals"] = (
    "SELECT s.*, d.*, (SELECT count(*) FROM summaries) + (SELECT count(*) FROM foreigns) AS service_count FROM (SELECT CAST(sum(line_count) AS BIGINT) AS total_lines, count(*) FILTER (WHERE file_type = 'go') AS go_files, "
    "count(*) FILTER (WHERE file_type = 'proto') AS proto_files, CAST(sum(todo_count) AS BIGINT) AS todos, CAST(sum(fixme_count) AS BIGINT) AS fixmes FROM sizes) s, (SELECT "
    + ", ".join(f"count(*) FILTER (WHERE kind = {lit(k)}) AS {n}" for n, k in marts.KINDS.items())
    + ", count(*) AS declarations FROM fdecls) d"
)
CHECKS["service_summary"] = "SELECT * FROM summaries"
CHECKS["service_order"] = (
    "SELECT *, row_number() OVER (ORDER BY is_gateway DESC, is_proto DESC, total_lines DESC, service) AS place FROM (SELECT service, total_lines, contains(lower(service), 'gateway') OR contains(lower(service), 'api-gw') OR lower(service) = 'api' AS is_gateway, "
    "lower(service) IN ('proto', 'protobuf', 'protos') OR starts_with(lower(service), 'proto-') OR ends_with(lower(service), '-proto') AS is_proto FROM summaries) x"
)
CHECKS["foreign_language_lines"] = "SELECT language, CAST(sum(line_count) AS BIGINT) AS lines FROM foreigns GROUP BY language"
CHECKS["layer_of_file"] = "SELECT id, layer FROM layers"
CHECKS["layer_rollup"] = (
    f"SELECT list_position({arr(fixed.LAYER_DISPLAY_ORDER)}, layer)::BIGINT AS layer_ord, layer, files, lines, CAST(greatest(lines * 100 // greatest(max(lines) OVER (), 1), 4) AS BIGINT) AS pct "
    "FROM (SELECT layer, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines FROM layers JOIN sizes USING (id) GROUP BY layer) x"
)
CHECKS["service_penetration"] = (
    "SELECT n.service AS target, count(DISTINCT i.service) AS dependents, string_agg(DISTINCT i.service, ',' ORDER BY i.service) AS importers FROM fimports i JOIN summaries n ON n.service <> i.service AND contains(lower(i.import), lower(n.service)) "
    "WHERE i.service <> '' GROUP BY n.service ORDER BY dependents DESC, target LIMIT 20"
)
CHECKS["todo_density"] = (
    "SELECT * FROM (SELECT CASE WHEN service = '' THEN 'root' ELSE service END AS service, CAST(sum(todo_count) AS BIGINT) AS todos, CAST(sum(fixme_count) AS BIGINT) AS fixmes, CAST(sum(todo_count) + sum(fixme_count) AS BIGINT) AS total FROM sizes GROUP BY 1) x WHERE total > 0"
)
CHECKS["longest_functions"] = f"SELECT repo || '/' || path AS id, name, {big('line_count')} FROM longest ORDER BY line_count DESC, id LIMIT 20"
CHECKS["file_inventory"] = (
    f"SELECT CASE WHEN service = '' THEN 'root' ELSE service END AS service, id, {base('id')} AS file_name, {big('line_count')}, CAST(n AS BIGINT) AS declaration_count, listed AS declaration_list, {cut('description', 120)} AS description, description AS whole_description, "
    f"CASE WHEN file_type = 'proto' THEN 'proto' ELSE '' END AS type_tag FROM parsed WHERE {base('id')} <> 'module.go'"
)
CTES["team_pick"] = (
    "SELECT a.author, CAST(coalesce(m.files_modified, 0) AS BIGINT) AS files_modified, a.total_commits, a.first_commit, a.last_commit FROM author_totals a LEFT JOIN (SELECT author, sum(files_modified) AS files_modified FROM modified GROUP BY author) m USING (author) ORDER BY 2 DESC, a.author LIMIT 30"
)
CHECKS["team_map"] = (
    "SELECT p.author, p.files_modified, p.total_commits, CASE WHEN coalesce(l.loc_added, 0) > 0 THEN CAST(l.loc_added // p.total_commits AS BIGINT) END AS loc_per_commit, strftime(to_timestamp(first_commit) AT TIME ZONE 'UTC', '%Y-%m-%d') AS first_date, "
    "strftime(to_timestamp(last_commit) AT TIME ZONE 'UTC', '%Y-%m-%d') AS last_date, coalesce(s.top_services, '') AS top_services FROM team_pick p LEFT JOIN locs l USING (author) LEFT JOIN (SELECT author, string_agg(service, ',' ORDER BY n) AS top_services FROM "
    "(SELECT author, service, row_number() OVER (PARTITION BY author ORDER BY files_modified DESC, service) AS n FROM modified WHERE service <> '') x WHERE n <= 3 GROUP BY author) s USING (author)"
)
CHECKS["service_grid"] = "SELECT service, '' AS language, total_lines AS lines, false AS is_foreign FROM summaries UNION ALL SELECT name, language, line_count, true FROM foreigns"

# the tables of a FROM list (name, optional alias, more after commas) and of joins
_FROM = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]\w*(?:\s+[a-z_]\w*)?(?:,\s*[a-z_]\w*(?:\s+[a-z_]\w*)?)*)")
_RECURSIVE = ("on_main", "old_side", "new_side")


def _all_marts() -> str:
    from codequarry.plans.queries import MARTS

    return " UNION ALL ".join(f"SELECT '{n}' AS mart, '2024-01-01' AS run_date, count(*) AS rows FROM ({CHECKS[n]}) x GROUP BY ALL" for n in MARTS)


CHECKS["write_all_marts"] = _all_marts()


def sql(name: str) -> str:
    """The full statement of a check: the building blocks it needs, then its body."""
    order: list[str] = []

    def need(text: str, self_name: str | None) -> None:
        for names in _FROM.findall(re.sub(r"'(?:[^']|'')*'", " ", text)):
            for word in re.findall(r"\w+", names):
                if word in CTES and word not in order and word != self_name:
                    need(CTES[word], word)
                    if word not in order:
                        order.append(word)

    need(CHECKS[name], None)
    if not order:
        return CHECKS[name]
    kind = "WITH RECURSIVE " if any(w in _RECURSIVE for w in order) else "WITH "

    def mode(w: str) -> str:
        return "" if w in _RECURSIVE else "MATERIALIZED "

    return kind + ", ".join(f"{w} AS {mode(w)}({CTES[w]})" for w in order) + " " + CHECKS[name]
