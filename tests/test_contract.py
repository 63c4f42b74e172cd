"""Patterns agree with RE2, and queries agree with their check SQL on the smallest tables."""

import os
import random
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_module  # noqa: E402
from codequarry.functions import fixed, text  # noqa: E402
from codequarry.plans import codebase  # noqa: E402
from codequarry.plans.codebase import TABLES  # noqa: E402
from codequarry.plans.queries import QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
PATTERNS = {k: v for k, v in vars(fixed).items() if isinstance(v, str) and k.isupper() and any(c in v for c in "\\^[(")}
LIGHT = (
    "list_repos", "ingest_commits", "ingest_heads", "assign_service", "foreign_services", "explode_lines", "parsed_files", "run_rules", "rule_summary", "compose_services",
    "edges", "type_ref_words", "churn", "team_map", "latest_semver", "branch_inventory", "line_authors", "service_penetration", "layer_rollup",
)


def test_patterns_match_re2(spark):
    rng = random.Random(11)
    bits = [
        "for ", "range", " := ", "x", "é", "\x0b", "\r", "\t", "(", ")", "{", "}", "func ", "init", "panic(", '"', "password", "=", "abcdefgh", ".Query(",
        "+", "err", ", ", "return", "//", "make(", "chan int", "3", "[]", "append(", "type T struct", "sync.Mutex", "import ", "package a_b;", "go ", "v1.2.3",
        "feat", "(a)", "!:", ": ", "#1", "AB-2", "http.Get(", "rows.", "Close()", "_ = ", "defer ", "time.Sleep", "fmt.Sprintf", '("%d",', "0",
    ]
    lines = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string").coalesce(4)
    found = df.select("i", *[text.matches(F.col("s"), p).alias(k) for k, p in PATTERNS.items()]).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(lines)))
    quoted = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
    sql = "SELECT i, " + ", ".join(f"regexp_matches(s, '{p}') AS {k}" for k, p in quoted.items()) + " FROM t ORDER BY i"
    want = con.execute(sql).fetchall()
    got = [tuple(r) for r in sorted(found, key=lambda r: r["i"])]
    assert got == want
    assert sum(v for row in want for v in row[1:]) > 500


def test_every_query_has_a_check():
    assert set(QUERIES) <= set(entry_module.oracle_sql())
    assert set(QUERIES) <= set(entry_module.queries())
    assert len(QUERIES) > 120


def test_entry(spark):
    assert entry_module.entry(spark).limit(3).count() == 3


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", LIGHT)
def test_query_equals_check(spark, con, name):
    df = entry_module.queries()[name](spark, DATA)
    result = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = result.fetchall()
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["colocation_edges", "colocation_groups", "decl_ref_edges", "service_message_edges", "func_call_edges"])
def test_unranked_links_need_no_pagerank(spark, con, name, monkeypatch):
    def refuse(*_):
        raise AssertionError("PageRank for links that nobody ranks")

    monkeypatch.setattr(codebase, "_written", {k: v for k, v in codebase._written.items() if k[2] not in ("nodes", "scores")})
    monkeypatch.setattr(codebase.graph, "pagerank", refuse)
    test_query_equals_check(spark, con, name)


def test_views_run_as_methods_the_jvm_compiles(spark, monkeypatch):
    """A view is written under the limit, which holds for that job only."""
    key, seen = "spark.sql.codegen.hugeMethodLimit", []
    plain = spark.conf.get(key)
    write = codebase.store.setting

    def watched(session, name, value):
        seen.append((name, value))
        return write(session, name, value)

    monkeypatch.setattr(codebase, "_written", {})
    monkeypatch.setattr(codebase.store, "setting", watched)
    rows = codebase.Codebase(spark, DATA).view("code_lines")
    assert seen == [(key, 8000)] and spark.conf.get(key) == plain
    with write(spark, key, 8000):
        assert spark.conf.get(key) == "8000"
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, codebase.Codebase(spark, DATA)._view("code_lines").collect()))
