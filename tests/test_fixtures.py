"""Small cases with known results."""

import pytest
from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.functions.scan import grid_join
from codequarry.operators import declgraph as dg
from codequarry.operators import extract, graph, marts, services, technology
from codequarry.sources import files as src
from helpers import LINES_SCHEMA

GO = """package myservice

import (
\t"fmt"
\t"net/http"
)

// Keeper stores things
type Keeper struct {
\tname string
}

type Reader interface {
\tRead() string
}

func NewKeeper() *Keeper {
\treturn &Keeper{}
}

func (k *Keeper) Name() string {
\treturn k.name
}
"""
PROTO = """syntax = "proto3";
package shop.v1;

message Req { string id = 1; }
message Resp { string id = 1; }
service Shop {
  rpc Get(Req) returns (Resp);
  rpc Put(Req) returns (Resp);
}
enum Kind { A = 0; }
"""


def parse(spark, contents: dict[str, str]):
    files = spark.createDataFrame([("r", p, c, "svc") for p, c in contents.items()], "repo string, path string, content string, service string")
    lines = extract.explode_lines(files)
    return {r["path"]: r for r in extract.parsed_files(files.drop("content"), lines).collect()}


def test_go_proto_and_dispatch(spark):
    big = "package a\nfunc Long() {\n" + "\tx()\n" * 28 + "}\nfunc Short() {\n\ty()\n}\n"
    todo = "package a\n// TODO: one\n// FIXME: two\n// TODO: three\n"
    rows = parse(spark, {"a.go": GO, "s.proto": PROTO, "big.go": big, "todo.go": todo, "n.txt": "x", "empty.go": ""})
    go = rows["a.go"]
    kinds = [d["kind"] for d in go["declarations"]]
    assert (go["package"], go["imports"], go["description"]) == ("myservice", ["fmt", "net/http"], "Keeper stores things")
    assert (kinds.count("struct"), kinds.count("interface"), kinds.count("func")) == (1, 1, 2)
    assert go["file_type"] == "go" and rows["s.proto"]["file_type"] == "proto"
    kinds = [d["kind"] for d in rows["s.proto"]["declarations"]]
    assert [kinds.count(k) for k in ("message", "service", "rpc", "enum")] == [2, 1, 2, 1]
    assert rows["s.proto"]["package"] == "shop.v1"
    assert rows["big.go"]["longest_function"]["name"] == "Long"
    assert [f["name"] for f in rows["big.go"]["big_functions"]] == ["Long"]
    assert (rows["todo.go"]["todo_count"], rows["todo.go"]["fixme_count"]) == (2, 1)
    assert rows["empty.go"]["line_count"] == 0
    assert "n.txt" not in rows


def test_line_flavours(spark):
    df = spark.createDataFrame([("r", "a", "x\r\ny\n"), ("r", "b", ""), ("r", "c", "a\nb\nc")], "repo string, path string, content string")

    def read(flavour):
        rows = sorted(extract.explode_lines(df, flavour).collect(), key=lambda r: (r["path"], r["line_no"]))
        return [(r["path"], r["text"]) for r in rows]

    assert read("scan") == [("a", "x"), ("a", "y"), ("c", "a"), ("c", "b"), ("c", "c")]
    assert read("split") == [("a", "x\r"), ("a", "y"), ("a", ""), ("b", ""), ("c", "a"), ("c", "b"), ("c", "c")]


def test_service_tree(spark):
    paths = [
        "user-service/main.go", "user-service/Dockerfile", "api-gateway/go.mod", "api-gateway/Dockerfile",
        "src/payment-service/main.go", "src/payment-service/go.mod", "src/not-a-service/readme.md", "lib/x/services/deep/App.csproj",
        "vendor/dep/go.mod", ".git/HEAD", "src/payment-service/.git/HEAD",
    ]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    tree = src.directory_tree(files)
    found = services.discover_services(tree)
    assert {r["path"] for r in found.collect()} == {"user-service", "api-gateway", "src/payment-service"}
    assert services.services_root(found).first()[0] == ""
    repos = {r["path"]: r["priority"] for r in src.list_repos(tree, found).collect()}
    assert repos == {"": 0, "src/payment-service": 2}
    under = spark.createDataFrame([(f"src/{n}", ["src", n]) for n in "abc"], "path string, discovery_ord array<string>")
    assert services.services_root(under).first()[0] == "src"


def test_service_of_path(spark):
    paths = [
        ("api-gateway/main.go", "api-gateway"), ("api-gateway/internal/h.go", "api-gateway"), ("user-service/a.go", "user-service"),
        ("src/payment/p.go", "payment"), ("main.go", "root"), ("x/cmd/tool/a.go", "tool"), ("x/cmd", "x"), ("x/apps/shop/a.go", "shop"),
        ("x/pkg/util/a.go", "util"), ("x/internal/db/a.go", "db"), ("plain/a.go", "plain"), ("marked/cmd/tool/a.go", "marked"),
    ]
    files = spark.createDataFrame([(p,) for p, _ in paths], "path string")
    dirs = spark.createDataFrame(
        [(d, d.split("/")) for d in ("api-gateway", "user-service", "src/payment")], "path string, discovery_ord array<string>"
    )
    tree = spark.createDataFrame([("marked/docker-compose.yml", False)], "path string, is_dir boolean")
    got = {r["path"]: r["service"] for r in services.assign_service(files, dirs, tree).collect()}
    assert got == dict(paths)


def test_prune(spark):
    paths = {"a.go": True, ".hidden.go": True, "a/.x/b.go": False, "vendor/c.go": False, "a/B.GO": True, "a/b.py": False, "go": False}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"] for r in src.scan_source_files(df).collect()} == {p for p, keep in paths.items() if keep}


def test_degrees_and_pagerank(spark):
    vertex = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    edge = graph.edges(vertex, spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("a", "z")], "src string, dst string"))
    assert [tuple(r) for r in edge.collect()] == [("a", "b")]
    deg = {r["id"]: (r["out_degree"], r["in_degree"]) for r in graph.degrees(vertex, edge).collect()}
    assert deg == {"a": (1, 0), "b": (0, 1), "c": (0, 0), "d": (0, 0)}

    cycle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "b")], "src string, dst string")
    plain = {r["id"]: r["score"] for r in graph.pagerank(vertex, cycle, iterations=12).collect()}
    salted = {r["id"]: r["score"] for r in graph.pagerank(vertex, cycle, iterations=12, block_rows=2, pack_links=1).collect()}
    score = dict.fromkeys("abcd", 0.25)
    for _ in range(12):
        score = {v: 0.15 / 4 + 0.85 * sum(score[s] for s, d in (("a", "b"), ("b", "c"), ("c", "a"), ("d", "b")) if d == v) for v in score}
    assert plain == pytest.approx(score) and salted == pytest.approx(score)
    assert plain["b"] > plain["d"] > 0

    star = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "b")], "src string, dst string")
    top = graph.top_hotspots(graph.pagerank(vertex, star, iterations=6), 2).collect()
    assert top[0]["id"] == "b" and top[0]["score"] > top[1]["score"]


def test_pagerank_hub_is_salted(spark):
    """One source holds a third of all edges; its edges are split and the sum stays exact."""
    pairs = [("hub", f"n{i}") for i in range(30)] + [(f"n{i}", f"n{(i * 7 + 1) % 30}") for i in range(30)] + [(f"n{i}", "hub") for i in range(30)]
    ids = ["hub"] + [f"n{i}" for i in range(30)]
    vertex = spark.createDataFrame([(x,) for x in ids], "id string")
    edge = spark.createDataFrame(pairs, "src string, dst string").distinct()
    got = {r["id"]: r["score"] for r in graph.pagerank(vertex, edge, iterations=5, block_rows=3, pack_links=4).collect()}
    links = set(pairs)
    out = {v: sum(s == v for s, _ in links) for v in ids}
    score = dict.fromkeys(ids, 1 / 31)
    for _ in range(5):
        score = {v: 0.15 / 31 + 0.85 * sum(score[s] / out[s] for s, d in links if d == v) for v in ids}
    assert got == pytest.approx(score)


@pytest.mark.parametrize(
    "source,name,found",
    [("var x Foo", "Foo", True), ("FooBar", "Foo", False), ("BarFoo", "Foo", False), ("Foo", "Foo", True), ("(Foo)", "Foo", True),
     ("_Foo", "Foo", False), ("Foo1", "Foo", False), ("*Foo,", "Foo", True), ("", "Foo", False), ("a.Foo{}", "Foo", True),
     ("éFoo", "Foo", True), ("FooFoo Foo", "Foo", True), ("foo", "Foo", False)],
)
def test_whole_word(spark, source, name, found):
    row = spark.range(1).select(
        text.has_word(F.lit(source), name).alias("a"), F.array_contains(text.words(F.lit(source)), name).alias("b")
    ).first()
    assert row["a"] == row["b"] == found


def test_line_counts(spark):
    rows = [("r", "a.py", "x\ny\nz"), ("r", "b.py", "x\ny\r\nz\n"), ("r", "empty.py", ""), ("r", "gone.py", None), ("r", "nl.py", "\n\n")]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    got = {r["path"]: r["line_count"] for r in extract.line_counts(files).collect()}
    assert got == {"a.py": 3, "b.py": 3, "empty.py": 0, "gone.py": 0, "nl.py": 2}
    lines = extract.explode_lines(files.where("content is not null")).groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in lines} == {k: v for k, v in got.items() if v}


def test_scalars(spark):
    def one(col):
        return spark.range(1).select(col.alias("v")).first()["v"]

    lit = F.lit
    assert one(text.dir_of(lit("a/b/c.go"))) == "a/b/" and one(text.file_name(lit("a/b/c.go"))) == "c.go"
    assert one(text.dir_of(lit("c.go"))) == ""
    assert one(text.short_path(lit("/w/src/pay/in/x.go"), lit("pay"))) == "in/x.go"
    assert one(text.short_path(lit("/w/a/b/c.go"), lit("pay"))) == "a/b/c.go"
    assert one(text.short_path(lit("a/b.go"), lit("pay"))) == "b.go"
    assert one(text.churn_display(lit("/a/b/c/d.go"))) == "…/b/c/d.go" and one(text.churn_display(lit("a/b.go"))) == "a/b.go"
    assert one(text.file_stem(lit("a/b.x.go"))) == "b.x"
    assert one(text.cut_bytes(lit("é" * 60), 101, "…")) == "é" * 50 + "…" and one(text.cut_bytes(lit("x" * 101), 100)) == "x" * 100
    assert one(text.strip(lit("\t a \r"))) == "a"
    assert one(text.indent(lit("\t  x\t"), 4)) == 6
    for name, gate, proto in (("api", 1, 0), ("My-Gateway", 1, 0), ("x-API-GW", 1, 0), ("apis", 0, 0), ("proto", 0, 1),
                              ("proto-a", 0, 1), ("a-Proto", 0, 1), ("protox", 0, 0)):
        assert one(text.is_gateway(lit(name))) == bool(gate) and one(text.is_proto_service(lit(name))) == bool(proto)
    for imp, tech in (("github.com/lib/pq", "PostgreSQL"), ("google.golang.org/grpc/codes", "gRPC"), ("github.com/redis/go-redis/v9", "Redis"),
                      ("github.com/gin-gonic/gin", "Gin"), ("go.uber.org/zap", "Zap Logger"), ("fmt", None)):
        assert one(technology.import_technology(lit(imp))) == tech
    assert one(technology.image_technology(lit("my/postgresql:9"))) == "PostgreSQL"


def test_service_summary_and_penetration(spark):
    files = spark.createDataFrame([("a", "s", 100), ("b", "s", 50), ("c", "", 7)], "id string, service string, line_count int")
    decls = spark.createDataFrame([("a", "s", i, f"n{i}", k) for i, k in enumerate(("struct", "interface", "func", "func", "message", "service"))],
                                  "id string, service string, pos int, name string, kind string")
    rows = {r["service"]: r for r in marts.service_summary(files, decls).collect()}
    s = rows["s"]
    assert (s["total_lines"], s["declarations"], s["structs"], s["interfaces"], s["funcs"], s["messages"], s["services"]) == (150, 6, 1, 1, 2, 1, 1)
    assert rows["root"]["declarations"] == 0
    imports = spark.createDataFrame([("a", "x", "org/S/pkg"), ("b", "y", "org/s"), ("c", "s", "org/s"), ("d", "", "org/s")],
                                    "id string, service string, import string")
    got = {r["target"]: list(r["importers"]) for r in marts.service_penetration(files.where("service <> ''"), imports).collect()}
    assert got == {"s": ["x", "y"]}


def test_substring_join_equals_search(spark):
    texts = ["github.com/acme/auth-api/v1", "authz", "a", "", None, "banana", "x/auth/auth", "api", "abcabd"]
    needles = [("AUTH", "auth"), ("Auth", "auth"), ("a", "a"), ("an", "an"), ("none", "zzzz"), ("", ""), (None, None), ("api", "api"), ("abd", "abd"), ("bcab", "bcab")]
    left = spark.createDataFrame([(t,) for t in texts], "import string")
    right = spark.createDataFrame(needles, "target string, needle string")
    got = sorted((r["import"], r["target"]) for r in marts.substring_join(left, "import", right, "needle").collect())
    assert got == sorted((t, name) for t in texts if t for name, n in needles if n and n in t)


def test_substring_join_spreads_what_it_cuts(spark):
    left = spark.createDataFrame([(f"example.com/org/svc{n}/auth",) for n in range(2000)], "import string").distinct()
    right = spark.createDataFrame([("AUTH", "auth")], "target string, needle string")
    pairs = marts.substring_join(left, "import", right, "needle")
    used = pairs.select(F.spark_partition_id()).distinct().count()
    assert pairs.count() == 2000 and used >= 8  # one task before, as the uncut texts are small


def below_grouping(df):
    """The plan under its deepest aggregate."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return "\n".join(plan[max(i for i, step in enumerate(plan) if "Aggregate [" in step) + 1 :])


def test_dictionaries_are_searched_once_per_value(spark):
    rows = [("a/go.mod", 1, "  github.com/lib/pq v1"), ("a/Makefile", 1, "Docker build ."), ("a/compose.yml", 1, "services:"), ("a/compose.yml", 2, " image: redis:7")]
    lines = spark.createDataFrame(rows, "path string, line_no int, text string")
    imports = spark.createDataFrame([("s", "github.com/lib/pq/x")], "service string, import string")
    jobs = [technology.tech_from_gomod(lines), technology.tech_from_makefile(lines), technology.tech_from_images(lines, None), technology.tech_from_imports(imports)]
    for job in jobs:
        assert job.count() == 1 and "lambda" not in below_grouping(job)


def test_compose(spark):
    body = ["version: 3", "services:", "  web:", "    image: 'postgres:15'", "    #  x:", "  cache:", "    ports: 6379", "volumes:", "  data:"]
    lines = spark.createDataFrame([("d/compose.yml", i + 1, t) for i, t in enumerate(body)], "path string, line_no int, text string")
    for chunk in (None, 3):
        assert {r[0] for r in technology.compose_services(lines, chunk).collect()} == {"web", "cache", "data"}
        assert {r[0] for r in technology.tech_from_images(lines, chunk).collect()} == {"PostgreSQL"}
        assert {r[0] for r in technology.tech_from_env_ports(lines, chunk).collect()} == {"PostgreSQL", "Redis"}


def test_lines_schema_matches(spark):
    assert spark.createDataFrame([], LINES_SCHEMA).columns == ["repo", "path", "line_no", "text"]


def test_colocation_as_membership(spark):
    """Files of any size: counts are those of the pairs, which a bound leaves out for large files."""
    kinds = ("func", "struct", "enum")
    nodes = [("s", f"f{f}::n{i}", f"f{f}", f"n{i}", kinds[(i + f) % 3], 0.5) for f, n in enumerate((1, 2, 20, 21, 70)) for i in range(n)]
    nodes += [("s", "f1::n0", "f1", "n0", "struct", 0.5), ("t", "g::n0", "g", "n0", "func", 0.1)]
    df = spark.createDataFrame(nodes, "service string, id string, file string, name string, kind string, score double")
    want = {(s, f, i): len({b for t, b, g, m, _, _ in nodes if (t, g) == (s, f) and m != name}) for s, i, f, name, _, _ in nodes}
    rows = dg.colocation_groups(df).collect()
    assert {(r["service"], r["file"], r["id"]): r["n_links"] for r in rows} == want and len(rows) == len(want)
    pairs = dg.colocation_edges(df, most=None).select("service", "src", "dst").distinct()
    counts = {r["src"]: r["count"] for r in pairs.groupBy("src").count().collect()}
    assert counts == {i: n for (_, _, i), n in want.items() if n}
    assert {r["src"].split(":")[0] for r in dg.colocation_edges(df).collect()} == {"f1", "f2"}


def test_classes_of_frequent_words(spark):
    """Words that many files mention and declare stay in classes; links, degrees and scores equal those of the pairs."""
    files, lines, decls = [], [], []
    for i in range(40):
        service = ("", "a", "b")[i % 3]
        own = [f"Hot{j}" for j in range(3) if (i + j) % (j + 2) == 0] + [f"Rare{i // 4}"] * (i % 5 == 0)
        used = own + [f"Hot{j}" for j in range(3) if i % (j + 3) == 1] + [f"Rare{(i + 3) // 4}"]
        files.append((f"f{i}", service))
        decls += [(f"f{i}", service, name, "struct") for name in own]
        lines += [(f"f{i}", n, f"x {word} y") for n, word in enumerate(used)]
    imports = spark.createDataFrame([(f"f{i}", f"f{(i * 7 + 3) % 40}") for i in range(40)], "src string, dst string")
    of = dict(files)
    wanted = {(f, d) for f, _, t in lines for d, s, name, _ in decls if s == of[f] and f != d and name in t.split()}
    given = (
        spark.createDataFrame(files, "id string, service string"),
        spark.createDataFrame(lines, "id string, line_no int, text string"),
        spark.createDataFrame(decls, "id string, service string, name string, kind string"),
    )
    vertex = given[0].select("id")
    for bound in (0, 1000):
        refs = graph.ref_links(*given, pairs_per_mention=bound)
        assert (refs.joined.count() > 0) == (bound < 1000)
        pairs = [tuple(r) for r in refs.pairs().select("src", "dst").collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == wanted
        whole = graph.link_graph(vertex, refs, imports)
        every = wanted | {tuple(r) for r in imports.collect() if r["src"] != r["dst"]}
        pairs = [tuple(r) for r in whole.pairs().select("src", "dst").collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == every
        degree = {r["id"]: (r["out_degree"], r["in_degree"]) for r in graph.degrees(vertex, whole).collect()}
        assert degree == {v: (sum(s == v for s, _ in every), sum(d == v for _, d in every)) for v in of}
        if bound == 0:
            score = dict.fromkeys(of, 1 / 40)
            for _ in range(5):
                score = {v: 0.15 / 40 + 0.85 * sum(score[s] / degree[s][0] for s, d in every if d == v) for v in of}
            got = {r["id"]: r["score"] for r in graph.pagerank(vertex, whole, iterations=5, block_rows=7, pack_links=9).collect()}
            assert got == pytest.approx(score)


def test_declaration_references(spark):
    """References equal brute force, each once, with repeated declarations and words of more pairs than a cell has rows."""
    kinds = ("func", "struct", "service", "message")
    nodes = [(("s", "t")[i % 2], f"f{i}::{n}", f"f{i}", n, kinds[(i + k) % 4], 0.5) for i in range(24) for k, n in enumerate(("Shared", f"Own{i // 4}xx", "abc", "Shared"))]
    lines = [(f"f{i}", 1, f"Shared Own{(i + 5) // 4}xx abc" if i % 3 else "Shared") for i in range(24)]
    df = spark.createDataFrame(nodes, "service string, id string, file string, name string, kind string, score double")
    text_lines = spark.createDataFrame(lines, "id string, line_no int, text string")
    words = {f: set(t.split()) for f, _, t in lines}

    def found(elsewhere, src_kinds, dst_kinds):
        return {
            (a[0], a[1], b[1], a[4], b[4], b[5]) for a in nodes for b in nodes
            if a[0] == b[0] and a[4] in src_kinds and b[4] in dst_kinds and len(b[3]) > 4 and b[3] in words[a[2]] and not (elsewhere and (a[2] == b[2] or a[3] == b[3]))
        }

    cases = ((dg.decl_ref_edges, found(True, kinds, kinds)), (dg.func_call_edges, found(True, ("func",), ("func",))), (dg.service_message_edges, found(False, ("service",), ("message",))))
    for job, want in cases:
        got = [tuple(r) for r in job(df, text_lines).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    left = spark.range(50).selectExpr("'k' AS k", "id AS l")
    cells = grid_join(left, left.withColumnRenamed("l", "r"), ["k"], "l", "r", cell_rows=8)
    assert cells.count() == cells.distinct().count() == 2500


def shuffled_rows(df) -> int:
    """Rows that the exchanges of a plan wrote, after it ran."""
    df.collect()

    def walk(node) -> int:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        metric = node.metrics().get("shuffleRecordsWritten")
        children = node.children()
        return (metric.get().value() if metric.isDefined() else 0) + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_large_keys_are_shuffled_once(spark):
    """A key of many cells goes to disk once, not once per row or column of its grid; rows of small keys are still there."""
    n = 1500
    left = spark.range(n).selectExpr("if(id < 9, 'few', 'k') AS k", "id AS l")
    right = spark.range(n + 300).selectExpr("if(id < 7, 'few', 'k') AS k", "id AS r", "id % 3 AS x")
    cells = grid_join(left, right, ["k"], "l", "r", cell_rows=64)
    assert cells.columns == ["k", "l", "r", "x"]
    rows = cells.selectExpr("count(*)", "count_if(k = 'few')", "sum(l * 7919 + r)", "sum(x)", "count(DISTINCT l * 10000 + r)")
    pairs = [("few", a, b) for a in range(9) for b in range(7)] + [("k", a, b) for a in range(9, n) for b in range(7, n + 300)]
    want = (len(pairs), 63, sum(a * 7919 + b for _, a, b in pairs), sum(b % 3 for _, _, b in pairs), len(pairs))
    assert tuple(rows.first()) == want
    assert n <= shuffled_rows(cells.groupBy().count()) < 3 * (2 * n + 300)


def test_words_sorted_out_before_the_shuffle(spark, monkeypatch):
    """Words that begin like none of those sought don't go to disk; none that is sought is lost, whatever the beginnings."""
    rows = [(f"f{i % 5}", i, f"Abc{i} éàüx Zed ab{i} other{i} _q") for i in range(40)]
    lines = spark.createDataFrame(rows, "id string, line_no int, text string")
    sought = spark.createDataFrame([("Abc7",), ("éàüx",), ("Zed",), ("ab",), ("gone",)], "word string")
    want = {tuple(r) for r in graph.file_words(lines, 2).join(sought, "word", "left_semi").select("id", "word").collect()}
    few = graph.file_words(lines, 2, sought)
    assert {tuple(r) for r in few.join(sought, "word", "left_semi").select("id", "word").collect()} == want and len(want) >= 6
    assert 2 * shuffled_rows(few) < shuffled_rows(graph.file_words(lines, 2))
    assert graph.file_words(lines, 2, sought.limit(0)).count() == 0
    monkeypatch.setattr(graph, "BEGINNINGS", 2)
    assert graph.file_words(lines, 2, sought).count() == graph.file_words(lines, 2).count()
