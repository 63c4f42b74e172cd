"""Code rules: a registry of violations over lines, capped reports, line authors, summary.

Input ``lines``: repo, path, line_no (1-based), text in *split* flavour. Every rule yields
``hit_columns``: rule, repo, path, line_no (reported line), trigger_line, snippet.

Plans: all single-line rules are one projection over one scan; all bounded look-ahead rules share one
(file, chunk) window; the stateful rules use prefix scans over lines that carry braces or a match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import fixed, text
from codequarry.functions.scan import AUTO, fit_chunks, look_ahead, running
from codequarry.operators.extract import FILE

HIGH, MEDIUM, LOW = "HIGH", "MEDIUM", "LOW"
LOOK_AHEAD_REACH = 30
HIT = ["rule", *FILE, "line_no", "trigger_line", "snippet"]


@dataclass(frozen=True)
class Rule:
    """One registered rule. ``key`` is the value of the ``rule`` column of its hits."""

    key: str
    name: str
    priority: str
    description: str
    dormant: bool = False


# --- fixed values: rule titles and their order ---------------------------------------------------
RULES = (
    Rule("rule_hardcoded_secret", "Hardcoded Secrets", HIGH, "a credential literal in source"),
    Rule("rule_sql_injection", "SQL Injection via String Concatenation", HIGH, "query text built from values"),
    Rule("rule_math_rand", "math/rand Used (Use crypto/rand for Secrets)", HIGH, "predictable random numbers"),
    Rule("rule_panic", "panic() in Business Logic", HIGH, "panic outside start-up code"),
    Rule("rule_type_assert", "Type Assertion Without ok", HIGH, "one-value type assertion"),
    Rule("rule_unclosed_body", "Unclosed HTTP Response Body", HIGH, "response body never closed"),
    Rule("rule_loop_var_goroutine", "Loop Variable Captured in Goroutine", HIGH, "goroutine reads a loop variable"),
    Rule("rule_copy_mutex", "Copying sync.Mutex", HIGH, "lock-holding struct passed by value"),
    Rule("rule_error_not_wrapped", "Error Not Wrapped With %w", MEDIUM, "error chain cut"),
    Rule("rule_defer_in_loop", "defer Inside a Loop", MEDIUM, "deferred calls pile up in a loop"),
    Rule("rule_rows_err", "SQL Rows — Missing rows.Err() Check", MEDIUM, "iteration error not read"),
    Rule("rule_rows_close", "SQL Rows — rows.Close() Not Called", MEDIUM, "rows never closed"),
    Rule("rule_sleep_sync", "time.Sleep for Goroutine Synchronization", MEDIUM, "sleep instead of a signal"),
    Rule("rule_big_channel", "Large Channel Buffer", LOW, "channel buffer above one"),
    Rule("rule_sleep_in_tests", "time.Sleep in Tests", LOW, "test that sleeps"),
    Rule("rule_naked_return", "Naked Returns", LOW, "return without values"),
    Rule("rule_ptr_interface", "Pointer to Interface", LOW, "pointer to an interface value"),
    Rule("rule_slice_prealloc", "Missing Slice Pre-allocation", LOW, "slice grown in a loop without capacity"),
    Rule("rule_package_underscore", "Package Name Contains Underscore", LOW, "package name with underscore"),
    Rule("rule_init_func", "init() Function", LOW, "implicit package initialisation"),
    Rule("rule_sprintf_int", "fmt.Sprintf for Integer → String", LOW, "formatted print of one integer"),
    Rule("rule_bytes_in_loop", "[]byte Conversion in Loop", LOW, "byte conversion repeated in a loop"),
    Rule("rule_ignored_errors", "Ignored Errors", MEDIUM, "result assigned to blank", dormant=True),
    Rule("rule_err_shadowing", "Error Shadowing", MEDIUM, "err declared again in an inner block", dormant=True),
    Rule("rule_unchecked_close", "Unchecked Close", LOW, "deferred close without error check", dormant=True),
    Rule("rule_test_error_check", "Test Error Not Checked", MEDIUM, "test ignores err", dormant=True),
)
ACTIVE = tuple(r.key for r in RULES if not r.dormant)


def rule_lines(lines: DataFrame) -> DataFrame:
    """Lines the rules look at: no proto files, no generated ``.pb.go`` files."""
    path = F.col("path")
    return lines.where((text.extension(path) != "proto") & ~path.endswith(".pb.go"))


def _line() -> Column:
    return F.col("text")


def _is_test() -> Column:
    return F.col("path").endswith("_test.go")


def _is_comment() -> Column:
    return text.strip(_line()).startswith("//")


def _has(pattern: str) -> Column:
    return text.matches(_line(), pattern)


def _single_line_conditions() -> dict[str, Column]:
    """Conditions over one line; a cheap literal test goes before each pattern."""
    line = _line()
    secret = F.lower(text.capture(line, fixed.SECRET, 2))
    skip_word = F.exists(
        F.array(*[F.lit(w) for w in fixed.SECRET_SKIP_WORDS]), lambda w: F.contains(secret, w)
    )
    blank_at, comment_at = F.instr(line, "_ ="), F.instr(line, "//")
    commented_out = (comment_at > 0) & (blank_at > 0) & (comment_at < blank_at)
    buffer = text.capture(line, fixed.CHANNEL_BUFFER).try_cast("bigint")
    return {
        "rule_hardcoded_secret": ~_is_test() & line.contains('"') & (secret != "") & ~skip_word & ~_is_comment(),
        "rule_sql_injection": line.contains("(") & (_has(fixed.SQL_CONCAT) | _has(fixed.SQL_SPRINTF)),
        "rule_math_rand": ~_is_test() & line.contains('"math/rand"'),
        "rule_panic": line.contains("panic(")
        & ~_is_test()
        & ~F.col("path").endswith("main.go")
        & _has(fixed.PANIC_CALL)
        & ~_is_comment(),
        "rule_type_assert": line.contains(".(")
        & ~(line.contains(", ok") | line.contains(",ok") | line.contains(".(type)"))
        & _has(fixed.TYPE_ASSERT),
        "rule_error_not_wrapped": line.contains("errors.New(") & _has(fixed.ERROR_NOT_WRAPPED),
        "rule_sleep_sync": ~_is_test() & line.contains("time.Sleep") & _has(fixed.TIME_SLEEP),
        "rule_big_channel": line.contains("make(") & (buffer > 1),
        "rule_sleep_in_tests": _is_test() & line.contains("time.Sleep") & _has(fixed.TIME_SLEEP),
        "rule_naked_return": line.contains("return") & _has(fixed.NAKED_RETURN),
        "rule_ptr_interface": line.contains("*interface{") & ~_is_comment(),
        "rule_package_underscore": line.startswith("package") & _has(fixed.PACKAGE_UNDERSCORE),
        "rule_init_func": ~_is_test() & line.contains("init") & _has(fixed.INIT_FUNC),
        "rule_sprintf_int": line.contains("fmt.Sprintf") & _has(fixed.SPRINTF_INT),
        "rule_ignored_errors": line.contains("_") & ~commented_out & _has(fixed.IGNORED_ERROR),
        "rule_unchecked_close": line.contains("defer") & _has(fixed.DEFER_CLOSE),
    }


FIRST_PER_FILE = ("rule_math_rand", "rule_package_underscore")
SINGLE_LINE = (
    "rule_hardcoded_secret", "rule_sql_injection", "rule_math_rand", "rule_panic", "rule_type_assert",
    "rule_error_not_wrapped", "rule_sleep_sync", "rule_big_channel", "rule_sleep_in_tests", "rule_naked_return",
    "rule_ptr_interface", "rule_package_underscore", "rule_init_func", "rule_sprintf_int", "rule_ignored_errors",
    "rule_unchecked_close",
)


def single_line_hits(lines: DataFrame, keys: tuple[str, ...] = SINGLE_LINE) -> DataFrame:
    """Hits of all named single-line rules from one pass over the lines."""
    conditions = _single_line_conditions()
    fired = F.array_compact(F.array(*[F.when(conditions[k], F.lit(k)) for k in keys]))
    hits = (
        rule_lines(lines)
        .select(*FILE, "line_no", "text", F.explode(fired).alias("rule"))
        .select("rule", *FILE, "line_no", F.col("line_no").alias("trigger_line"), text.snippet(_line()).alias("snippet"))
    )
    first = [k for k in keys if k in FIRST_PER_FILE]
    if not first:
        return hits
    # only the first line per file counts for these rules: a partial aggregate before the shuffle
    once = (
        hits.where(F.col("rule").isin(first))
        .groupBy("rule", *FILE)
        .agg(F.min(F.struct("line_no", "trigger_line", "snippet")).alias("h"))
        .select("rule", *FILE, "h.*")
    )
    if len(first) == len(keys):
        return once
    return hits.where(~F.col("rule").isin(first)).unionByName(once)


LOOK_AHEAD = (
    "rule_unclosed_body",
    "rule_loop_var_goroutine",
    "rule_slice_prealloc",
    "rule_err_shadowing",
    "rule_test_error_check",
)


def look_ahead_hits(lines: DataFrame, keys: tuple[str, ...] = LOOK_AHEAD, chunk_rows: int | None = AUTO) -> DataFrame:
    """Hits of the rules that look at most 30 lines ahead; one shuffle and one sort for all of them.

    Frames are ranges over line_no, so lines no named rule looks at are dropped first, and the text
    itself is replaced by flags (plus the snippet of lines that may be reported) before the shuffle.
    """
    chunk_rows = fit_chunks(lines, "line_no", chunk_rows)
    line, at = _line(), F.col("line_no")
    flags: dict[str, Column] = {}
    report: list[Column] = []
    if "rule_unclosed_body" in keys:
        flags["http_call"] = line.contains(":=") & _has(fixed.HTTP_CALL)
        flags["body_close"] = line.contains("defer") & _has(fixed.BODY_CLOSE)
        report.append(F.col("http_call"))
    if "rule_loop_var_goroutine" in keys:
        halves = F.split(line, ":=", 2)
        flags["for_range"] = line.contains("range") & _has(fixed.FOR_RANGE)
        flags["go_func"] = line.contains("go") & _has(fixed.GO_FUNC_START)
        flags["self_assign"] = (
            line.contains(":=")
            & _has(fixed.ASSIGN_WORDS)
            & (F.size(F.split(line, ":=")) == 2)
            & (text.strip(halves[0]) == text.strip(F.element_at(halves, -1)))
        )
        report.append(F.col("go_func"))
    if "rule_slice_prealloc" in keys:
        flags["empty_slice"] = (line.contains("make(") & _has(fixed.MAKE_EMPTY_SLICE)) | (
            line.contains("var") & _has(fixed.VAR_SLICE)
        )
        flags["for_line"] = line.contains("for") & _has(fixed.FOR_LINE)
        flags["append_call"] = line.contains("append(") & _has(fixed.APPEND_CALL)
        report.append(F.col("empty_slice"))
    if "rule_test_error_check" in keys:
        flags["test_err"] = _is_test() & line.contains("err") & _has(fixed.ERR_DECLARED)
        flags["err_check"] = _is_test() & _has(fixed.TEST_ERR_CHECK)
        report.append(F.col("test_err"))
    if "rule_err_shadowing" in keys:
        flags["err_decl"] = line.contains("err") & _has(fixed.ERR_DECLARED)
        flags["live"] = (text.strip(line) != "") & ~_is_comment()
        report.append(F.col("err_decl"))

    rows = rule_lines(lines).select(*FILE, "line_no", "text", *[c.alias(n) for n, c in flags.items()])
    rows = rows.where(F.exists(F.array(*[F.col(n) for n in flags]), lambda b: b))
    keep = [*FILE, "line_no", *flags]
    if "rule_err_shadowing" in keys:
        rows = rows.withColumn("indent", text.indent(line, 4))
        keep.append("indent")
    wanted = report[0]
    for c in report[1:]:
        wanted = wanted | c
    rows = rows.select(*keep, F.when(wanted, text.snippet(line)).alias("snippet"))

    def build(df: DataFrame, w) -> DataFrame:
        found = []

        def within(lo: int, hi: int):
            return w.rangeBetween(lo, hi)

        here = F.struct(at.alias("line_no"), at.alias("trigger_line"), F.col("snippet"))
        if "rule_unclosed_body" in keys:
            closed = F.coalesce(F.max("body_close").over(within(0, 5)), F.lit(False))
            df = df.withColumn("h_body", F.when(F.col("http_call") & ~closed, here))
            found.append(("rule_unclosed_body", "h_body"))
        if "rule_loop_var_goroutine" in keys:
            df = df.withColumn("captured", ~F.max("self_assign").over(within(0, 9)))
            launch = F.when(F.col("go_func"), F.struct("line_no", "captured", "snippet"))
            df = df.withColumn("launch", F.min(launch).over(within(1, 19)))
            hit = F.struct(F.col("launch.line_no"), at.alias("trigger_line"), F.col("launch.snippet"))
            df = df.withColumn("h_loop", F.when(F.col("for_range") & F.col("launch.captured"), hit))
            found.append(("rule_loop_var_goroutine", "h_loop"))
        if "rule_slice_prealloc" in keys:
            first_for = F.min(F.when(F.col("for_line"), at)).over(within(1, 29))
            last_append = F.max(F.when(F.col("append_call"), at)).over(within(1, 29))
            df = df.withColumn("_ff", first_for).withColumn("_la", last_append)
            df = df.withColumn("h_slice", F.when(F.col("empty_slice") & (F.col("_ff") <= F.col("_la")), here))
            found.append(("rule_slice_prealloc", "h_slice"))
        if "rule_test_error_check" in keys:
            checked = F.coalesce(F.max("err_check").over(within(1, 3)), F.lit(False))
            df = df.withColumn("h_test", F.when(F.col("test_err") & ~checked, here))
            found.append(("rule_test_error_check", "h_test"))
        if "rule_err_shadowing" in keys:
            # at most 29 small entries per row
            ahead = F.collect_list(
                F.when(F.col("live"), F.struct("line_no", "indent", "err_decl", "snippet"))
            ).over(within(1, 29))
            df = df.withColumn("_ahead", F.when(F.col("err_decl"), ahead))
            outer = F.col("indent")
            stop = F.array_min(
                F.transform(F.filter("_ahead", lambda r: r["indent"] <= outer), lambda r: r["line_no"])
            )
            again = F.array_min(
                F.transform(
                    F.filter("_ahead", lambda r: r["err_decl"] & (r["indent"] > outer)),
                    lambda r: F.struct(r["line_no"], r["snippet"]),
                )
            )
            df = df.withColumn("_stop", stop).withColumn("_again", again)
            hit = F.struct(
                F.col("_again.line_no").alias("line_no"), at.alias("trigger_line"), F.col("_again.snippet").alias("snippet")
            )
            clear = F.col("_again").isNotNull() & (
                F.col("_stop").isNull() | (F.col("_again.line_no") < F.col("_stop"))
            )
            df = df.withColumn("h_shadow", F.when(clear, hit))
            found.append(("rule_err_shadowing", "h_shadow"))
        hits = F.array(
            *[
                F.struct(
                    F.lit(k).alias("rule"),
                    F.col(f"{c}.line_no").alias("line_no"),
                    F.col(f"{c}.trigger_line").alias("trigger_line"),
                    F.col(f"{c}.snippet").alias("snippet"),
                )
                for k, c in found
            ]
        )
        extra = [c for c in ("_home", "_chunk") if c in df.columns]
        return df.select(*FILE, *extra, F.filter(hits, lambda h: h["line_no"].isNotNull()).alias("hits"))

    out = look_ahead(rows, FILE, "line_no", LOOK_AHEAD_REACH, build, chunk_rows)
    return out.select(*FILE, F.inline("hits")).select(*HIT)


LOOP_RULES = ("rule_defer_in_loop", "rule_bytes_in_loop")


def loop_depth_hits(lines: DataFrame, key: str, chunk_rows: int | None = AUTO) -> DataFrame:
    """Matches on lines whose loop depth is positive.

    The depth is a counter with floor 0: with S the running sum of steps and m its running minimum,
    the counter is S - min(0, m). Comment lines take no part.
    """
    chunk_rows = fit_chunks(lines, "line_no", chunk_rows)
    line = _line()
    opens, closes = text.count_char(line, "{"), text.count_char(line, "}")
    is_for = line.contains("for") & _has(fixed.FOR_LINE)
    if key == "rule_defer_in_loop":
        up = F.when(is_for & (opens > closes), 1).otherwise(0)
        down = F.when(closes > opens, 1).otherwise(0)
        target = line.contains("defer") & _has(fixed.DEFER_LINE)
    else:
        up = F.when(is_for, 1).otherwise(0)
        down = F.greatest(closes - opens, F.lit(0))
        target = line.contains("[]byte(")
    rows = (
        rule_lines(lines)
        .where(line.contains("{") | line.contains("}") | line.contains("defer") | line.contains("[]byte("))
        .where(~_is_comment())
        .select(
            *FILE,
            "line_no",
            up.alias("up"),
            down.alias("down"),
            target.alias("target"),
            F.when(target, text.snippet(line)).alias("snippet"),
        )
        .where("up > 0 OR down > 0 OR target")
    )
    step = F.col("up") - F.col("down")
    rows = running(rows, FILE, "line_no", {"total": ("sum", step.cast("bigint"), True)}, chunk_rows)
    rows = running(rows, FILE, "line_no", {"low": ("min", F.col("total"), False)}, chunk_rows)
    earlier = F.col("total") - step
    depth = earlier - F.least(F.lit(0), F.coalesce("low", F.lit(0))) + F.col("up")
    return rows.where(F.col("target") & (depth > 0)).select(
        F.lit(key).alias("rule"), *FILE, "line_no", F.col("line_no").alias("trigger_line"), "snippet"
    )


def _blocks(rows: DataFrame, chunk_rows: int | None, carry: list[str]) -> DataFrame:
    """Lines that belong to a brace block: adds ``block`` (its start line).

    Needs ``is_start`` and ``delta`` (brace balance of the line). A block opens at depth 1 and holds
    the later lines up to the next start, as long as the depth before the line is still positive.
    """
    step = F.when(F.col("is_start"), 0).otherwise(F.col("delta")).cast("bigint")
    start = F.when(F.col("is_start"), F.col("line_no"))
    rows = running(
        rows, FILE, "line_no", {"total": ("sum", step, True), "block": ("max", start, True)}, chunk_rows
    ).where("block IS NOT NULL")
    # the balance at the block's start and the lowest balance before this line, both within the block
    in_block = [*FILE, "block"]
    at_start = F.when(F.col("is_start"), F.col("total"))
    rows = running(
        rows,
        in_block,
        "line_no",
        {"base": ("max", at_start, True), "low": ("min", F.col("total"), False)},
        chunk_rows,
    )
    live = F.col("is_start") | (1 + F.col("low") - F.col("base") > 0)
    return rows.where(live).select(*FILE, "line_no", "block", "is_start", *carry)


def rows_block_hits(
    lines: DataFrame, keys: tuple[str, ...] = ("rule_rows_err", "rule_rows_close"), chunk_rows: int | None = AUTO
) -> DataFrame:
    """Functions that iterate rows without the error check / the close call; both rules share the plan."""
    chunk_rows = fit_chunks(lines, "line_no", chunk_rows)
    line = _line()
    delta = text.count_char(line, "{") - text.count_char(line, "}")
    is_start = line.contains("func ") & (delta > 0)
    rows = (
        rule_lines(lines)
        .select(
            *FILE,
            "line_no",
            is_start.alias("is_start"),
            delta.alias("delta"),
            line.contains(".Next()").alias("has_next"),
            line.contains("rows.Err()").alias("has_err"),
            _has(fixed.ROWS_CLOSE).alias("has_close"),
            F.when(is_start, text.snippet(line)).alias("snippet"),
        )
        .where("is_start OR delta <> 0 OR has_next OR has_err OR has_close")
    )
    rows = _blocks(rows, chunk_rows, ["has_next", "has_err", "has_close", "snippet"])
    body = ~F.col("is_start")
    blocks = rows.groupBy(*FILE, "block").agg(
        F.bool_or(body & F.col("has_next")).alias("has_next"),
        F.bool_or(body & F.col("has_err")).alias("has_err"),
        F.bool_or(body & F.col("has_close")).alias("has_close"),
        F.max("snippet").alias("snippet"),
    )
    lacks = {"rule_rows_err": ~F.col("has_err"), "rule_rows_close": ~F.col("has_close")}
    fired = F.array_compact(F.array(*[F.when(lacks[k], F.lit(k)) for k in keys]))
    return (
        blocks.where("has_next")
        .select(F.explode(fired).alias("rule"), *FILE, F.col("block").alias("line_no"), "snippet")
        .select("rule", *FILE, "line_no", F.col("line_no").alias("trigger_line"), "snippet")
    )


def copy_mutex_hits(lines: DataFrame, chunk_rows: int | None = AUTO) -> DataFrame:
    """Function lines that take a lock-holding struct of the same file by value.

    The type names in value position on a function line are its words between a character other than
    ``*`` or a word character and a space, comma or closing bracket; those join the struct names by
    (file, word) instead of testing every name on every line.
    """
    chunk_rows = fit_chunks(lines, "line_no", chunk_rows)
    line = _line()
    trimmed = text.strip(line)
    delta = text.count_char(line, "{") - text.count_char(line, "}")
    name = text.capture(trimmed, fixed.STRUCT_START)
    rows = (
        rule_lines(lines)
        .select(
            *FILE,
            "line_no",
            name.alias("type_name"),
            (name != "").alias("is_start"),
            delta.alias("delta"),
            (line.contains("sync.") & _has(fixed.MUTEX_FIELD)).alias("has_mutex"),
        )
        .where("is_start OR delta <> 0 OR has_mutex")
    )
    blocks = _blocks(rows, chunk_rows, ["type_name", "has_mutex"])
    types = (
        blocks.groupBy(*FILE, "block")
        .agg(
            F.max(F.when(F.col("is_start"), F.col("type_name"))).alias("word"),
            F.bool_or(~F.col("is_start") & F.col("has_mutex")).alias("locked"),
        )
        .where("locked")
        .select(*FILE, "word")
        .distinct()
    )
    by_value = F.regexp_extract_all(line, F.lit(r"(?<=[^*A-Za-z0-9_])([A-Za-z0-9_]+)(?=[\t\n\f\r ,)])"), F.lit(1))
    by_pointer = F.regexp_extract_all(line, F.lit(r"\*([A-Za-z0-9_]+)"), F.lit(1))
    taken = (
        rule_lines(lines)
        .where(line.contains("func "))
        .select(*FILE, "line_no", text.snippet(line).alias("snippet"), F.explode(F.array_except(by_value, by_pointer)).alias("word"))
    )
    return (
        taken.join(types, [*FILE, "word"], "left_semi")
        .select(F.lit("rule_copy_mutex").alias("rule"), *FILE, "line_no", F.col("line_no").alias("trigger_line"), "snippet")
        .distinct()
    )


def all_hits(lines: DataFrame, keys: tuple[str, ...] = ACTIVE, chunk_rows: int | None = AUTO) -> DataFrame:
    """Every hit of the named rules, uncapped."""
    unknown = set(keys) - {r.key for r in RULES}
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    if set(keys) - set(SINGLE_LINE):
        chunk_rows = fit_chunks(lines, "line_no", chunk_rows)
    plans: list[DataFrame] = []
    single = tuple(k for k in keys if k in SINGLE_LINE)
    ahead = tuple(k for k in keys if k in LOOK_AHEAD)
    blocks = tuple(k for k in keys if k in ("rule_rows_err", "rule_rows_close"))
    if single:
        plans.append(single_line_hits(lines, single))
    if ahead:
        plans.append(look_ahead_hits(lines, ahead, chunk_rows))
    if blocks:
        plans.append(rows_block_hits(lines, blocks, chunk_rows))
    plans += [loop_depth_hits(lines, k, chunk_rows) for k in keys if k in LOOP_RULES]
    if "rule_copy_mutex" in keys:
        plans.append(copy_mutex_hits(lines, chunk_rows))
    out = plans[0]
    for p in plans[1:]:
        out = out.unionByName(p)
    return out


def cap_hits(hits: DataFrame, cap: int) -> DataFrame:
    """First ``cap`` hits per rule in file order, then line order of the trigger, with their ``position``: for a viewer.

    For a ``cap`` of up to 1,000 (Spark's limit for it) the rank filter also limits every input partition
    before the shuffle, so the few rule partitions receive only small inputs however many hits there are.
    """
    file_order = F.split(text.abs_path(F.col("repo"), F.col("path")), "/")
    per_rule = Window.partitionBy("rule").orderBy(file_order, "trigger_line", "line_no")
    return hits.withColumn("position", F.row_number().over(per_rule)).where(F.col("position") <= cap)


def run_rules(
    lines: DataFrame, keys: tuple[str, ...] = ACTIVE, cap: int | None = None, chunk_rows: int | None = AUTO
) -> DataFrame:
    """All violations with the three-part display path; with ``cap``, the first of each rule only, numbered."""
    hits = all_hits(lines, keys, chunk_rows)
    hits = hits if cap is None else cap_hits(hits, cap)
    return hits.withColumn("display_path", text.last_parts(text.abs_path(F.col("repo"), F.col("path"))))


def violation_authors(violations: DataFrame, line_authors: DataFrame) -> DataFrame:
    """Add the line's author ('' when unknown); ``line_authors``: repo, path, line_no, author."""
    return violations.join(line_authors, [*FILE, "line_no"], "left").withColumn(
        "author", F.coalesce("author", F.lit(""))
    )


def rule_registry(spark, include_dormant: bool = False) -> DataFrame:
    rows = [(i, r.key, r.name, r.priority, r.description) for i, r in enumerate(RULES) if include_dormant or not r.dormant]
    return spark.createDataFrame(rows, "rule_ord int, rule string, name string, priority string, description string")


def rule_summary(violations: DataFrame, include_dormant: bool = False) -> DataFrame:
    """Each rule with its number of violations and whether it passed."""
    counts = violations.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
    rules = rule_registry(violations.sparkSession, include_dormant)
    # at most one row per rule on either side
    return rules.join(counts, "rule", "left").select(
        "rule_ord",
        "rule",
        "name",
        "priority",
        F.coalesce("violations", F.lit(0)).alias("violations"),
        F.col("violations").isNull().alias("passed"),
    )
