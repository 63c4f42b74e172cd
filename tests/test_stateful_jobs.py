"""Stateful jobs: written-out cases, properties of what they find, and equal results for whole files and tiny chunks."""

import pytest
from pyspark.sql import functions as F

from codequarry.functions import fixed, scan
from codequarry.operators import extract, rules
from codequarry.plans.queries import QUERIES
from codequarry.sources import history_text as ht
from helpers import LINES_SCHEMA, as_rows, balance, random_files, rx

FILES = random_files(260, 90, seed=7)
STATEFUL = (
    "rule_unclosed_body", "rule_loop_var_goroutine", "rule_slice_prealloc", "rule_test_error_check", "rule_err_shadowing",
    "rule_defer_in_loop", "rule_bytes_in_loop", "rule_rows_err", "rule_rows_close", "rule_copy_mutex",
)

#: rule, file, lines, reported lines
CASES = [
    ("rule_defer_in_loop", "a.go", ["for _, f := range fs {", "\tdefer f.Close()", "}", "defer g()"], [2]),
    ("rule_defer_in_loop", "a.go", ["func A() {", "\tdefer f.Close()", "}"], []),
    ("rule_defer_in_loop", "a.go", ["for {", "\tfor {", "\t\tx()", "\t}", "\tdefer g()", "}", "defer h()"], [5]),
    ("rule_bytes_in_loop", "a.go", ["b := []byte(s)", "for x {", "\tb := []byte(s)", "}", "b := []byte(s)"], [3]),
    ("rule_rows_err", "a.go", ["func A() {", "\tfor rows.Next() {", "\t}", "}", "func B() {", "\tfor rows.Next() {", "\t}", "\trows.Err()", "}"], [1]),
    ("rule_rows_close", "a.go", ["func A() {", "\tfor rows.Next() {", "\t}", "\tdefer rows.Close()", "}", "func B() {", "\tfor rows.Next() {", "\t}", "}"], [6]),
    ("rule_copy_mutex", "a.go", ["type L struct {", "\tmu sync.Mutex", "}", "type S struct {", "\tn int", "}", "func a(x L, n int) {", "func b(x *L) {", "func c(s S) {", "func (l L) d() {"], [7, 10]),
    ("rule_copy_mutex", "a.go", ["func a(x L, n int) {", "}", "type L struct {", "\tsync.RWMutex", "}"], [1]),
    ("rule_loop_var_goroutine", "a.go", ["for _, v := range vs {", "\tgo func() {", "\t\tuse(v)", "\t}()", "}"], [2]),
    ("rule_loop_var_goroutine", "a.go", ["for _, v := range vs {", "\tgo func() {", "\t\tv := v", "\t}()", "}"], []),
    ("rule_err_shadowing", "a.go", ["err := f()", "\tx()", "\terr := g()"], [3]),
    ("rule_err_shadowing", "a.go", ["\terr := f()", "err := g()"], []),
]


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines") / "t")
    spark.createDataFrame(as_rows(FILES), LINES_SCHEMA).coalesce(4).write.parquet(path)
    return spark.read.parquet(path)


def hits(df, keys, chunk=None):
    got = {k: set() for k in keys}
    for r in rules.all_hits(df, keys, chunk).collect():
        got[r["rule"]].add((r["path"], r["line_no"], r["trigger_line"]))
    return got


def test_written_cases(spark):
    files = {f"c{n}/{path}": text for n, (_, path, text, _) in enumerate(CASES)}
    got = hits(spark.createDataFrame(as_rows(files), LINES_SCHEMA), STATEFUL)
    for n, (rule, path, _, want) in enumerate(CASES):
        assert sorted(no for p, no, _ in got[rule] if p == f"c{n}/{path}") == want, (n, rule)


def exchanges(df):
    """Shuffles by hash of a plan that doesn't wait for statistics."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")
    return plan.count("Exchange hashpartitioning")


def test_files_are_dealt_by_their_lines(lines, monkeypatch):
    monkeypatch.setattr(scan, "TASK_ROWS", 100)
    parts = -(-lines.count() // 100)
    assert parts > 8
    assert extract.go_lines(lines).rdd.getNumPartitions() == parts  # 4 before, whatever the number of lines
    want = sorted(map(repr, extract.extract_description(lines, 13).collect()))
    assert sorted(map(repr, extract.extract_description(lines).collect())) == want


def test_description_shuffles_no_text(lines):
    rows = extract.go_lines(lines, None, None, {"is_type": F.col("trimmed").startswith("type")})
    assert "trimmed" not in rows.columns and {"is_type", "consumed"} <= set(rows.columns)
    assert exchanges(extract.extract_description(lines, None)) == 2  # one for the runs, one (read again) for the comments


def test_blame_is_shuffled_once(spark):
    assert exchanges(QUERIES["ingest_blame"](spark, "/root/testdata/sf0.001")) == 1  # 4 before


def test_blame_headers_of_every_length(spark):
    short, long = "a" * 40, "b" * 40
    text = [f"{short} 1 1", "author A", "\tx", f"  {long}  7\t2 1", "author B " + "y" * 60, "summary " + "z" * 60, "\t" + "c" * 40 + " 3 9", "\tlast"]
    dump = spark.createDataFrame([("r", "p", n, t) for n, t in enumerate(text, 1)], "repo string, path string, seq bigint, text string")
    for chunk in (None, 3):
        got = {r["line_no"]: r["author"] for r in ht.ingest_blame(dump, chunk).collect()}
        assert got == {1: "A", 2: "B " + "y" * 60}  # the last header's commit has no author


def test_chunks_do_not_change_what_is_found(lines):
    whole, cut = hits(lines, STATEFUL), hits(lines, STATEFUL, 31)
    assert whole == cut and all(whole.values())
    jobs = (extract.function_extents, extract.extract_imports, extract.extract_description)
    for job in jobs:
        a, b = (sorted(map(repr, job(lines, c).collect())) for c in (None, 13))
        assert a == b and a


def test_look_ahead_rules_hold_by_distance(lines):
    """A hit exists if and only if the stated lines do, within the stated distances."""
    near = {
        "rule_unclosed_body": lambda p, t, i: ":=" in t[i] and rx(fixed.HTTP_CALL, t[i]) and not any(rx(fixed.BODY_CLOSE, x) for x in t[i : i + 6]),
        "rule_test_error_check": lambda p, t, i: p.endswith("_test.go") and rx(fixed.ERR_DECLARED, t[i]) and not any(rx(fixed.TEST_ERR_CHECK, x) for x in t[i + 1 : i + 4]),
    }
    got = hits(lines, tuple(near))
    for rule, holds in near.items():
        assert got[rule] == {(p, i + 1, i + 1) for p, t in FILES.items() for i in range(len(t)) if holds(p, t, i)}


def test_function_extents_close_at_their_level(lines):
    spans = {}
    for r in extract.function_extents(lines).collect():
        assert r["line_count"] == r["end_line"] - r["start_line"] + 1
        spans.setdefault(r["path"], []).append((r["start_line"] - 1, r["end_line"] - 1, r["name"]))
    assert len(spans) > 20
    for path, text in FILES.items():
        if any("import (" in t for t in text):  # lines of import blocks are no code
            continue
        level, own = balance(text), sorted(spans.get(path, []))
        for a, b, name in own:
            before = level[a - 1] if a else 0
            assert rx(fixed.GO_FUNC, text[a].strip())[1] == name
            ends = [k for k in range(a, len(text)) if "}" in text[k] and level[k] <= before]
            assert ends[0] == b  # the first closing brace at or below the level before it
        assert all(x[1] < y[0] for x, y in zip(own, own[1:], strict=False))


SOURCE = """// TODO: one
package shop

import (
	"fmt"
	"net/http"
)

// Cart holds
// the items.
type Cart struct {
	n int //FIXME later
}

// other
type Seller interface {
}

func (c *Cart) Add(n int) {
	if n > 0 {
		c.n += n
	}
}

func Long() {
""" + "\tx()\n" * 30 + "}\n"


def test_parsed_file(spark):
    rows = [("r", "a.go", i + 1, t) for i, t in enumerate(SOURCE.split("\n")[:-1])]
    files = spark.createDataFrame([("r", "a.go", "svc"), ("r", "none.go", "svc")], "repo string, path string, service string")
    got = {r["path"]: r for r in extract.parsed_files(files, spark.createDataFrame(rows, LINES_SCHEMA)).collect()}
    r = got["a.go"]
    assert r["line_count"] == len(rows) and r["package"] == "shop"
    assert list(r["imports"]) == ["fmt", "net/http"]
    assert [(d["name"], d["kind"]) for d in r["declarations"]] == [("Cart", "struct"), ("Seller", "interface"), ("Add", "func"), ("Long", "func")]
    assert (r["todo_count"], r["fixme_count"], r["description"]) == (1, 1, "Cart holds the items.")
    assert (r["longest_function"]["name"], r["longest_function"]["line_count"]) == ("Long", 32)
    assert [(f["name"], f["line_count"]) for f in r["big_functions"]] == [("Long", 32)]
    assert got["none.go"]["line_count"] == 0


def test_description_is_the_first_run_with_a_text(spark):
    texts = {
        "one.go": "//\ntype A struct {\n// second\n// run\ntype B struct {\n// third\ntype C struct {",
        "two.go": "//\n//\ntype A struct {\n// later\ntype B struct {",
        "none.go": "// a function's\nfunc F() {\n}\ntype A struct {\n// last",
    }
    rows = [("r", path, i + 1, t) for path, text in texts.items() for i, t in enumerate(text.split("\n"))]
    df = spark.createDataFrame(rows, LINES_SCHEMA)
    for chunk in (None, 2):
        assert {r["path"]: r["description"] for r in extract.extract_description(df, chunk).collect()} == {"one.go": "second run", "two.go": " "}


def test_one_hot_file_spans_many_chunks(spark):
    """A single file holds nearly all rows; chunks find what the whole file's windows find."""
    hot = {"d/hot.go": ["func Z() {", "\tx()", "}"] * 70 + [t for k in range(40) for f in random_files(3, 40, seed=k).values() for t in f if "import (" not in t]}
    df = spark.createDataFrame(as_rows(hot), LINES_SCHEMA)
    a, b = (sorted(map(repr, extract.function_extents(df, c).collect())) for c in (None, 64))
    assert a == b and a
    keys = ("rule_defer_in_loop", "rule_rows_close", "rule_loop_var_goroutine")
    assert hits(df, keys, 64) == hits(df, keys)


def test_cap_and_summary(spark, lines):
    found = rules.all_hits(lines)
    capped = rules.cap_hits(found, 10).collect()
    everything = found.collect()
    for rule in rules.ACTIVE:
        mine = sorted((r for r in everything if r["rule"] == rule),
                      key=lambda r: (f"{r['repo']}/{r['path']}".split("/"), r["trigger_line"], r["line_no"]))
        kept = sorted((r for r in capped if r["rule"] == rule), key=lambda r: r["position"])
        assert [(r["path"], r["line_no"]) for r in kept] == [(r["path"], r["line_no"]) for r in mine[:10]]
    summary = {r["rule"]: r for r in rules.rule_summary(rules.run_rules(lines)).collect()}
    assert len(summary) == 22
    assert all(summary[k]["violations"] == sum(r["rule"] == k for r in everything) for k in summary)
    assert all(summary[k]["passed"] == (summary[k]["violations"] == 0) for k in summary)
    with pytest.raises(ValueError):
        rules.all_hits(lines, ("no_such_rule",))
