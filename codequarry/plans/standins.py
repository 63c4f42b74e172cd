"""Views that give the driver's tables the shape of source code and commit history.

One SQL text per view, used by Spark and, as a common table expression, by the check SQL. Only integer
arithmetic, CASE and string concatenation are used, so both engines agree. Every view grows with its
table: a source file takes the rows of 25 consecutive orders, so the number of files grows and their
length does not; repositories are few, and one service holds a third of all files.
"""

from __future__ import annotations

from codequarry.functions import fixed

NOW = 1_700_000_000


def _div(a: str, b: int) -> str:
    return f"CAST(floor(({a}) / {b}) AS BIGINT)"


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _case(selector: str, options: list[str], weights: dict[int, int] | None = None) -> str:
    arms = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options[:-1]))
    return f"CASE {selector} {arms} ELSE {options[-1]} END"


def _service(k: str) -> str:
    return (
        f"CASE WHEN {k} % 31 = 5 THEN '' WHEN {k} % 3 = 0 THEN 'core-gateway' WHEN {k} % 7 = 1 THEN 'proto' "
        f"ELSE 'svc' || {_s(f'{k} % 7')} END"
    )


def _path(k: str) -> str:
    n = _s(k)
    kinds = [
        f"'/proto/m' || {n} || '.proto'",
        f"'/pkg' || {_s(f'{k} % 5')} || '/f' || {n} || '_test.go'",
        f"'/cmd/x' || {n} || '/main.go'",
        f"'/api/x' || {n} || '.pb.go'",
        f"'/handlers/h' || {n} || '.go'",
        f"'/models/f' || {n} || '.go'",
        f"'/repository/f' || {n} || '.go'",
        f"'/config/f' || {n} || '.go'",
        f"'/auth/f' || {n} || '.go'",
        f"'/worker-a/f' || {n} || '.go'",
        f"'/util/f' || {n} || '.go'",
        f"'/x' || {n} || '/module.go'",
    ]
    top = f"CASE WHEN {k} % 3 = 0 THEN 'core-gateway' WHEN {k} % 7 = 1 THEN 'proto' ELSE 'svc' || {_s(f'{k} % 7')} END"
    return f"({top}) || ({_case(f'{k} % 12', kinds)})"


def _q(literal: str) -> str:
    return "'" + literal.replace("'", "''") + "'"


_T = "chr(9) || "
_P = _s("l_partkey")

_GO_TEMPLATES = [
    f"'func Handle' || {_P} || '(w http.ResponseWriter) {{'",
    "'}'",
    "'}'",
    "'}'",
    "'}'",
    f"'func (s *Svc' || {_P} || ') Run' || {_s('l_suppkey')} || '() error {{'",
    _T + _q("for i := 0; i < 10; i++ {"),
    _T + _q("for _, v := range items {"),
    _T + _T + _q("defer f.Close()"),
    _T + _q("defer rows.Close()"),
    _T + _q("go func() {"),
    _T + _T + _q("v := v"),
    _T + _q('password := "hunter2secret"'),
    _T + _q('apiKey = "example-key-123"'),
    _T + _q('db.Query("SELECT " + name)'),
    _T + _q('db.Exec(fmt.Sprintf("DELETE %s", t))'),
    _T + _q('"math/rand"'),
    _T + _q('panic("boom")'),
    _q("// panic(x) is bad"),
    _T + _q("x := y.(string)"),
    _T + _q("x, ok := y.(string)"),
    _T + _q("resp, err := http.Get(url)"),
    _T + _q("defer resp.Body.Close()"),
    f"'type Svc' || {_P} || ' struct {{'",
    _T + _q("mu sync.Mutex"),
    f"'func use' || {_s('l_suppkey')} || '(s Svc' || {_P} || ', n int) {{'",
    f"'func ptr' || {_s('l_suppkey')} || '(s *Svc' || {_P} || ') {{'",
    f"'type Iface' || {_P} || ' interface {{'",
    _T + _q("return errors.New(err.Error())"),
    _T + _q("for rows.Next() {"),
    _T + _q("if err := rows.Err(); err != nil {"),
    _T + _q("time.Sleep(10)"),
    _T + _q("c := make(chan int, 100)"),
    _T + _q("c := make(chan int, 1)"),
    _T + _q("return"),
    _T + _q("return // done"),
    _T + _q("var p *interface{}"),
    _T + _q("var out []string"),
    _T + _q("res := make([]int, 0)"),
    _T + _T + _q("out = append(out, v)"),
    _q("func init() {"),
    _T + _q('s := fmt.Sprintf("%d", n)'),
    _T + _T + _q("b := []byte(s)"),
    _T + _q("_ = doIt()"),
    _T + _q("// _ = skipped()"),
    _T + _q("data, err := load()"),
    _T + _T + _q("_, err := inner()"),
    _T + _q("if err != nil {"),
    _q("// TODO: fix this"),
    _q("//FIXME later"),
    f"'// Svc' || {_P} || ' does things'",
    "''",
    f"{_T}'x := Svc' || {_P} || '{{}}'",
    f"{_T}'Handle' || {_P} || '(w)'",
    _q('import "os"'),
    _q("package other_pkg"),
    _T + _q("return nil"),
    f"'type Lock' || {_s('l_suppkey % 3')} || ' struct {{'",
    f"'func take(l Lock' || {_s('l_linenumber % 3')} || ', n int) {{'",
    f"'func lend(l *Lock' || {_s('l_linenumber % 3')} || ') {{'",
    f"'func Body' || {_P} || '()'",
    _q("  spaced := 1"),
    f"{_T}'secret := \"naïve façade ' || {_P} || ' ' || repeat('éà', 30) || '\"'",
    _T + _q("return") + " || chr(13)",
    _T + _q("}"),
    _T + _q("}"),
    _T + _T + _q("}"),
    _q("} else {"),
    _q("//"),
    _q(")"),
    _T + _q("sync.RWMutex"),
    f"{_T}'rows.Close()'",
]

_PROTO_TEMPLATES = [
    _q('syntax = "proto3";'),
    f"'package pb' || {_s('l_suppkey % 9')} || '.v1;'",
    f"'import \"common/types' || {_s('l_suppkey % 9')} || '.proto\";'",
    f"'message Req' || {_P} || ' {{'",
    f"'service Api' || {_P} || ' {{'",
    f"'  rpc Do' || {_s('l_suppkey')} || '(Req' || {_P} || ') returns (Resp' || {_P} || ');'",
    f"'enum Kind' || {_P} || ' {{'",
    "'}'",
    _q("// TODO: x"),
    _q("//TODO y"),
    f"'  Req' || {_P} || ' req = 1;'",
    "''",
    _q("// FIXME: z"),
    f"'message Note' || {_s('l_suppkey')} || ' {{ message Inner' || {_P} || ' {{'",
]

_IMPORT_KEYS = [_q(k) for k in fixed.IMPORT_TECH]
_HEAD_GO = [
    f"CASE WHEN f % 11 = 0 THEN 'package my_pkg' ELSE '  package pkg' || {_s('f % 50')} END",
    _q("import ("),
    _T + "'\"' || " + f"({_case(f'(l_partkey + l_suppkey) % {len(_IMPORT_KEYS)}', _IMPORT_KEYS)}) || '/sub\"'",
    _T + f"'\"example.com/org/svc' || {_s('l_suppkey % 7')} || '/f' || {_s('f + l_linenumber - 3')} || '\"'",
    _T + f"'\"example.com/Core-Gateway/pkg' || {_s('l_partkey % 60')} || '\"'",
    f"CASE WHEN f % 17 = 3 THEN {_T} '\"fmt\"' ELSE ')' END",
]

_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"

_LINE_TEXT = (
    f"CASE WHEN f % 12 = 0 THEN {_case(f'(l_partkey * 7 + l_linenumber * 13 + l_suppkey * 3) % {len(_PROTO_TEMPLATES)}', _PROTO_TEMPLATES)} "
    + " ".join(f"WHEN line_no = {i + 1} THEN {h}" for i, h in enumerate(_HEAD_GO))
    + f" ELSE {_case(f'(l_partkey * 7 + l_linenumber * 13 + l_suppkey * 3) % {len(_GO_TEMPLATES)}', _GO_TEMPLATES)} END"
)

_COMPOSE = [
    _q("services:"), _q("  web:"), _q("    image: postgres:15"), _q('    image: "redis:7"'), _q("  # note:"),
    _q("    ports:"), _q('      - "5432:5432"'), _q("  queue:"), _q("    environment:"), _q("      PGHOST: db"),
    _q("volumes:"), f"'  data' || {_s('l_suppkey % 9')} || ':'", _T + _q("web2:"), "''",
    _q("    image: my/mongo-express"), _q("      KAFKA_PORT: 9092"), _q("  services:"), _q("    inner:"),
    _q("    image: opensearchproject/opensearch"), _q("- image: nginx"),
]
_GOMOD = [
    *[f"{_T}{_q(k)} || ' v1.' || {_s('l_linenumber')}" for k in fixed.GOMOD_TECH],
    _q("require github.com/lib/pq v1"), _q("module example.com/x"), _q("go 1.22"),
]
_MAKE = [
    _q("build:"), _T + _q("go build ./..."), _T + _q("Docker build ."), _T + _q("kubectl apply -f k8s"),
    _T + _q("protoc --go_out=. x.proto"), _T + _q("psql -c q.sql"), _T + _q("helm upgrade"),
    _T + _q("PROTOC-GEN-GRPC"), "''", _T + _q("golang-migrate up"), _T + _q("echo redis"),
]


def _listing() -> str:
    k = "o_orderkey"
    l1 = _case(f"{_div(k, 320)} % 9", [f"'svc' || {_s(f'{k} % 13')}", "'services'", "'platform'", "'vendor'", "'.hidden'",
                                      "'Cmd'", "'tools'", "''", f"'app' || {_s(f'{k} % 5')}"])
    l2 = _case(f"{_div(k, 64)} % 5", ["''", f"'payment' || {_s(f'{k} % 4')}", "'src'", "'internal'", "'proto'"])
    l3 = _case(f"{_div(k, 16)} % 4", ["''", f"'order' || {_s(f'{k} % 3')}", "'api'", "'test'"])
    n = _s(k)
    name = _case(f"{k} % 16", ["'Dockerfile'", "'go.mod'", "'package.json'", "'App.csproj'", f"'f' || {n} || '.go'",
                               f"'m' || {n} || '.proto'", f"'x' || {n} || '.py'", f"'y' || {n} || '.java'", "'README'",
                               f"'A' || {n} || '.GO'", "'.env.go'", "'docker-compose.yml'", "'Makefile'", "'.git'",
                               f"'z' || {n} || '.rs'", f"'w' || {n} || '.ts'"])
    quiet = "l1 IN ('services', 'platform', 'Cmd', 'tools') AND l2 = '' AND l3 = ''"
    idle = "l2 = 'internal' AND l3 = ''"
    plain = f"CASE WHEN ({quiet}) OR ({idle}) THEN 'notes' || {n} || '.txt' ELSE name END"

    def part(c: str) -> str:
        return f"CASE WHEN {c} = '' THEN '' ELSE {c} || '/' END"

    inner = f"SELECT {k}, {l1} AS l1, {l2} AS l2, {l3} AS l3, {name} AS name FROM {{orders}}"
    return (
        f"SELECT path, max(n) AS line_count FROM (SELECT {part('l1')} || {part('l2')} || {part('l3')} || {plain} AS path, "
        f"{k} % 200 AS n FROM ({inner}) a) b GROUP BY path"
    )


_POS = _div("o_orderkey", 3)
_J = f"({_POS} % 10)"
_BLOCK = _div(_POS, 10)
LONG, LONG_EVERY = 1000, 4000


def _parent_cols() -> tuple[str, str]:
    """First and second parent as positions, -1 for none; see ``commits``."""
    long = f"({_POS} % {LONG_EVERY})"  # a branch of LONG commits, now and then, and the place of its merge
    in_long = f"{long} >= {LONG} AND {long} < {2 * LONG}"
    first = (
        f"CASE WHEN {_POS} = 0 THEN -1 WHEN {in_long} THEN {_POS} - 1 WHEN {long} = {2 * LONG} THEN {_POS} - {LONG + 1} WHEN {_J} = 2 AND {_BLOCK} % 4 = 3 THEN {_POS} - 12 WHEN {_J} = 2 THEN {_POS} - 2 "
        f"WHEN {_J} = 5 THEN {_POS} - 4 WHEN {_J} = 8 AND {_BLOCK} % 7 = 6 THEN {_POS} - 2 ELSE {_POS} - 1 END"
    )
    second = f"CASE WHEN {in_long} THEN -1 WHEN {long} = {2 * LONG + 9} THEN {_POS} - 10 WHEN {_J} = 9 THEN {_POS} - 5 WHEN {_J} = 4 AND {_BLOCK} % 5 = 4 THEN {_POS} - 3 ELSE -1 END"
    return first, second


def _subject() -> str:
    n = _s("o_orderkey")
    return _case(
        "o_orderkey % 8",
        [
            f"'fix: bug ' || {n}", f"'feat(core)!: add ' || {n}", f"'PROJ-' || {n} || ' work'", f"'Revert change ' || {n}",
            f"'plain words ' || {n}", f"'docs(x): page ' || {n}", f"'closes #' || {n}", f"'style : odd ' || {n}",
        ],
    )


def _tag() -> str:
    k = "p_partkey"
    return _case(
        f"{k} % 6",
        [
            f"'v' || {_s('p_size')} || '.' || {_s(f'{k} % 10')} || '.' || {_s(f'{k} % 7')}",
            f"{_s('p_size')} || '.' || {_s(f'{k} % 10')} || '.' || {_s(f'{k} % 97')} || '-rc' || {_s(f'{k} % 3')}",
            f"'release-' || {_s(f'{k} % 300')}",
            f"'v' || {_s('p_size')} || '.' || {_s(f'{k} % 10')} || '.' || {_s(f'{k} % 5')} || '.9'",
            f"'v' || {_s('p_size')} || '.' || {_s(f'{k} % 10')} || '.' || {_s(f'{k} % 5')} || 'rc1'",
            f"'v' || {_s('p_size')} || '.x'",
        ],
    )


def _branch() -> str:
    k = "c_custkey"
    return (
        f"CASE WHEN {k} < 3 THEN CASE WHEN {k} % 3 = 2 THEN 'master' ELSE 'main' END WHEN {k} < 6 THEN 'develop' "
        f"WHEN {k} < 9 THEN 'HEAD' WHEN {k} % 4 = 0 THEN 'feature/' || lower(c_mktsegment) || '/b' || {_s(f'{k} % 700')} "
        f"WHEN {k} % 4 = 1 THEN 'fix/b' || {_s(f'{k} % 700')} ELSE 'b' || {_s(f'{k} % 700')} END"
    )


def _author(k: str, n: int = 40) -> str:
    return f"CASE WHEN {k} % 3 = 0 THEN 'lead' ELSE 'dev' || {_s(f'{k} % {n}')} END"


_FIRST, _SECOND = _parent_cols()
_HASH = "lpad({}, 40, '0')"


def _key_of(pos: str) -> str:
    return f"{pos} * 3 + o_orderkey % 3"


# name -> (views it reads, SQL over {table} placeholders and view names)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "code_src": (
        (),
        f"SELECT {_div('l_orderkey', 25)} AS f, row_number() OVER (PARTITION BY {_div('l_orderkey', 25)} ORDER BY {_ORDER}) AS line_no, "
        "l_partkey, l_suppkey, l_linenumber FROM {lineitem}",
    ),
    "code_lines": (
        ("code_src",),
        f"SELECT '/org/r' || {_s('f % 3')} AS repo, {_path('f')} AS path, CAST(line_no AS INT) AS line_no, {_LINE_TEXT} AS text, "
        f"{_author('l_suppkey')} AS author, {_HASH.format(_s('l_suppkey % 120'))} AS blame_hash FROM code_src",
    ),
    "code_files": (
        (),
        f"SELECT '/org/r' || {_s('f % 3')} AS repo, {_path('f')} AS path, {_service('f')} AS service "
        f"FROM (SELECT DISTINCT {_div('l_orderkey', 25)} AS f FROM {{lineitem}}) s",
    ),
    "manifest_lines": (
        ("code_src",),
        "SELECT 'd' || CAST(f AS STRING) || '/' || CASE f % 3 WHEN 0 THEN 'docker-compose.yml' WHEN 1 THEN 'go.mod' ELSE 'Makefile' END AS path, "
        "CAST(line_no AS INT) AS line_no, CASE f % 3 "
        f"WHEN 0 THEN {_case(f'(l_partkey + l_suppkey * 3) % {len(_COMPOSE)}', _COMPOSE)} "
        f"WHEN 1 THEN {_case(f'(l_partkey + l_suppkey * 3) % {len(_GOMOD)}', _GOMOD)} "
        f"ELSE {_case(f'(l_partkey + l_suppkey * 3) % {len(_MAKE)}', _MAKE)} END AS text FROM code_src",
    ),
    "listing": ((), _listing()),
    # three repositories of interleaved keys; blocks of ten: 0,1,5..8 on main, 2..4 a branch, 9 its merge;
    # some branches start a block earlier, some merge main first, some commits hang off main, some branches are long
    "commits": (
        (),
        f"SELECT '/org/r' || {_s('o_orderkey % 3')} AS repo, CAST(o_orderkey % 3 AS INT) AS repo_ord, "
        f"{_HASH.format(_s('o_orderkey'))} AS hash, {_author('o_custkey')} AS author, "
        "{epoch:o_orderdate} + o_orderkey * 7919 % 86400 AS ts, "
        f"{_subject()} AS subject, {_subject()} || CASE WHEN o_orderkey % 50 = 1 THEN chr(10) || 'Rollback of x' ELSE '' END AS message, "
        "CAST(1000000000000 - o_orderkey AS BIGINT) AS log_seq, "
        f"CASE WHEN {_FIRST} < 0 THEN NULL ELSE {_HASH.format(_s(_key_of(f'({_FIRST})')))} END AS parent1, "
        f"CASE WHEN {_SECOND} < 0 THEN NULL ELSE {_HASH.format(_s(_key_of(f'({_SECOND})')))} END AS parent2 "
        "FROM {orders}",
    ),
    "commit_files": (
        (),
        "SELECT repo, hash, path, max(added) AS added FROM ("
        f"SELECT '/org/r' || {_s('l_orderkey % 3')} AS repo, {_HASH.format(_s('l_orderkey'))} AS hash, "
        f"CASE WHEN l_suppkey % 3 = 0 THEN 'go.mod' ELSE {_path('l_partkey')} END AS path, "
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS INT) END AS added FROM {lineitem}) t GROUP BY repo, hash, path",
    ),
    "branches": (
        (),
        f"SELECT '/org/r' || {_s('c_custkey % 3')} AS repo, CAST(c_custkey % 3 AS INT) AS repo_ord, {_branch()} AS name, "
        f"CAST({NOW} - (c_custkey * 86413) % 31536000 AS BIGINT) AS ts{{place}} FROM {{customer}}",
    ),
    "tips": ((), f"SELECT '/org/r' || {_s('o_orderkey % 3')} AS repo, {_HASH.format(_s('max(o_orderkey)'))} AS tip FROM {{orders}} GROUP BY o_orderkey % 3"),
    "tags": (
        (),
        f"SELECT '/org/r' || {_s('p_partkey % 3')} AS repo, CAST(p_partkey % 3 AS INT) AS repo_ord, {_tag()} AS tag FROM {{part}}",
    ),
    "blame_claims": (
        ("code_src",),
        "SELECT CASE (l_suppkey + f) % 4 WHEN 0 THEN '/org/a' WHEN 1 THEN '/org/a2' ELSE '/org/b' END AS repo, "
        f"CASE f % 3 WHEN 0 THEN '/org/a2/f' WHEN 1 THEN '/org/b/f' ELSE '/org/a/f' END || {_s('f')} || '.go' AS path, "
        f"CAST(line_no AS INT) AS line_no, {_author('l_partkey')} AS author FROM code_src",
    ),
}
BLAME_REPOS = (("/org/b", 0), ("/org/a", 1), ("/org/a2", 2))

#: A branch's place in its listing: as rows are stored. The check SQL has no such column; its engine takes rows of equal order as stored.
_PLACE = {"spark": ", struct(_metadata.file_path, _metadata.row_index) AS place", "duckdb": ""}
_EPOCH = {"spark": "unix_timestamp({})", "duckdb": "CAST(epoch({}) AS BIGINT)"}


def view_sql(name: str, engine: str) -> tuple[tuple[str, ...], str]:
    deps, sql = VIEWS[name]
    return deps, sql.replace("{epoch:o_orderdate}", _EPOCH[engine].format("o_orderdate")).replace("{place}", _PLACE[engine])
