"""Text -> rows: lines, imports, declarations, comments, function extents, per-file summary.

Input ``lines``: repo, path, line_no (1-based), text in *scan* flavour (see ``explode_lines``).
State over the lines of a file comes from ``scan.running``, so a file may be of any length; rows that
carry no information for a job are dropped before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import fixed, text
from codequarry.functions.scan import AUTO, dealt, fit_chunks, running
from codequarry.sources.store import settle

FILE = ["repo", "path"]


def explode_lines(files: DataFrame, flavour: str = "scan") -> DataFrame:
    """files(repo, path, content) -> one row per line.

    ``scan`` drops a last empty element and one trailing carriage return per line; ``split`` keeps both.
    """
    pieces = F.split(F.col("content"), "\n")
    if flavour == "scan":
        ends_empty = F.col("content").endswith("\n") | (F.col("content") == "")
        pieces = F.when(ends_empty, F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    rows = files.select(*FILE, F.posexplode(pieces).alias("_at", "text"))
    value = F.regexp_replace("text", r"\r\z", "") if flavour == "scan" else F.col("text")
    return rows.select(*FILE, (F.col("_at") + 1).alias("line_no"), value.alias("text"))


def line_counts(files: DataFrame) -> DataFrame:
    """files(repo, path, content), in any language -> line_count per file; 0 for empty and unreadable (null) ones.

    The lines' number is taken from the text in place, without a row per line.
    """
    breaks = F.regexp_count("content", F.lit("\n"))
    last = (F.col("content") != "") & ~F.col("content").endswith("\n")
    return files.select(*FILE, F.coalesce(breaks + last.cast("int"), F.lit(0)).cast("bigint").alias("line_count"))


def _is_go(path: Column) -> Column:
    return text.extension(path) == "go"


def _is_proto(path: Column) -> Column:
    return text.extension(path) == "proto"


def go_lines(
    lines: DataFrame, keep: Column | None = None, chunk_rows: int | None = AUTO, carry: dict[str, Column] | None = None
) -> DataFrame:
    """Go lines with ``trimmed``, ``consumed`` (taken by an import) and ``imported`` (path or '').

    ``keep`` names the lines the caller needs (over ``trimmed``); other lines are dropped before the
    shuffle unless they open or close an import block. ``carry``: columns over ``trimmed`` that take its place
    before the shuffle. Files that fit into a task are dealt over tasks by the number of lines.
    """
    chunk_rows = fit_chunks(lines, "line_no", chunk_rows)
    count = lines.count() if chunk_rows is None else 0
    t = F.col("trimmed")
    opens, closes = t.startswith("import ("), t == ")"
    rows = lines.where(_is_go(F.col("path"))).withColumn("trimmed", text.strip(F.col("text"))).drop("text")
    if keep is not None:
        rows = rows.where(keep | opens | closes)
    # an odd mark opens, an even one closes; the greatest earlier mark is the state
    mark = F.when(opens, F.col("line_no") * 2 + 1).when(closes, F.col("line_no") * 2)
    single = F.when(t.startswith("import"), text.capture(t, fixed.GO_IMPORT_SINGLE)).otherwise("")
    quoted = F.when(t.startswith('"'), text.capture(t, fixed.GO_IMPORT_QUOTED)).otherwise("")
    kept = [t] if carry is None else [value.alias(name) for name, value in carry.items()]
    rows = rows.select(*FILE, "line_no", *kept, mark.alias("_at"), single.alias("_single"), quoted.alias("_quoted"))
    if chunk_rows is None:
        rows = dealt(rows, FILE, count)
    rows = running(rows, FILE, "line_no", {"_mark": ("max", F.col("_at"), False)}, chunk_rows)
    inside = F.coalesce(F.col("_mark") % 2 == 1, F.lit(False))
    opens, closes = (F.coalesce(F.col("_at") % 2 == odd, F.lit(False)) for odd in (1, 0))
    single, quoted = F.col("_single"), F.col("_quoted")
    imported = F.when(opens, "").when(inside, F.when(closes, "").otherwise(quoted)).otherwise(single)
    return rows.withColumn("imported", imported).withColumn(
        "consumed", opens | inside | (~inside & (single != ""))
    ).drop("_mark", "_at", "_single", "_quoted")


def extract_package(lines: DataFrame) -> DataFrame:
    """Package per file: Go takes the first ``package`` line, proto the last."""
    t = text.strip(F.col("text"))
    rows = lines.where(F.col("text").contains("package")).select(
        *FILE,
        "line_no",
        F.when(_is_go(F.col("path")) & t.startswith("package "), text.strip(F.substring(t, 9, 1 << 30)))
        .when(_is_proto(F.col("path")), F.nullif(text.capture(t, fixed.PROTO_PACKAGE), F.lit("")))
        .alias("package"),
    ).where("package IS NOT NULL")
    pick = F.when(_is_go(F.col("path")), F.min_by("package", "line_no")).otherwise(F.max_by("package", "line_no"))
    return rows.groupBy(*FILE).agg(pick.alias("package"))


def extract_imports(lines: DataFrame, chunk_rows: int | None = AUTO) -> DataFrame:
    """Import paths of Go and proto files with their line."""
    t = F.col("trimmed")
    go = go_lines(lines, t.startswith('"') | t.startswith("import"), chunk_rows).where("imported <> ''")
    proto = (
        lines.where(_is_proto(F.col("path")) & F.col("text").contains("import"))
        .withColumn("imported", text.capture(text.strip(F.col("text")), fixed.PROTO_IMPORT))
        .where("imported <> ''")
    )
    cols = [*FILE, "line_no", F.col("imported").alias("import")]
    return go.select(*cols).unionByName(proto.select(*cols))


def _go_declarations(lines: DataFrame, chunk_rows: int | None) -> DataFrame:
    t = F.col("trimmed")
    rows = go_lines(lines, t.startswith("type") | t.startswith("func"), chunk_rows).where("NOT consumed")
    type_name, type_kind = text.capture(t, fixed.GO_TYPE, 1), text.capture(t, fixed.GO_TYPE, 2)
    func_name = text.capture(t, fixed.GO_FUNC, 1)
    return rows.select(
        *FILE,
        "line_no",
        F.lit(0).alias("kind_ord"),
        F.when(type_name != "", type_name).otherwise(func_name).alias("name"),
        F.when(type_name != "", type_kind).otherwise("func").alias("kind"),
    ).where("name <> ''")


def extract_types(lines: DataFrame, chunk_rows: int | None = AUTO) -> DataFrame:
    """Struct and interface declarations."""
    return _go_declarations(lines, chunk_rows).where("kind <> 'func'").drop("kind_ord")


def extract_funcs(lines: DataFrame, chunk_rows: int | None = AUTO) -> DataFrame:
    """Function and method declarations."""
    return _go_declarations(lines, chunk_rows).where("kind = 'func'").drop("kind_ord")


def extract_proto(lines: DataFrame) -> DataFrame:
    """Messages, services, rpcs and enums, ordered by line and then in that order."""
    t = text.strip(F.col("text"))
    found = F.array(
        *[
            F.struct(F.lit(i).alias("kind_ord"), text.capture(t, p).alias("name"), F.lit(k).alias("kind"))
            for i, (k, p) in enumerate(fixed.PROTO_KINDS.items())
        ]
    )
    return (
        lines.where(_is_proto(F.col("path")))
        .select(*FILE, "line_no", F.inline(F.filter(found, lambda d: d["name"] != "")))
        .select(*FILE, "line_no", "kind_ord", "name", "kind")
    )


def declarations(lines: DataFrame, chunk_rows: int | None = AUTO) -> DataFrame:
    """All declarations: repo, path, line_no, kind_ord, name, kind."""
    return _go_declarations(lines, chunk_rows).unionByName(extract_proto(lines))


def extract_description(lines: DataFrame, chunk_rows: int | None = AUTO) -> DataFrame:
    """Comment text in front of the first type that has any.

    A comment run ends at a line that is neither blank nor a comment. Runs are numbered by counting
    such lines, which carry no text. The first run of a file that ends in a type and has a text is found from counts
    and lengths; only that run's comments are gathered.
    """
    chunk_rows = fit_chunks(lines, "line_no", chunk_rows)
    t = F.col("trimmed")
    carry = {
        "comment": F.when(t.startswith("//"), text.capture(t, fixed.GO_COMMENT)),
        "is_type": t.startswith("type") & (text.capture(t, fixed.GO_TYPE) != ""),
    }
    rows = go_lines(lines, t != "", chunk_rows, carry).where("NOT consumed").select(*FILE, "line_no", *carry)
    resets = F.when(F.col("comment").isNull(), 1).otherwise(0)
    rows = running(rows, FILE, "line_no", {"run": ("sum", resets, False)}, chunk_rows)
    rows = settle(rows.where("comment IS NOT NULL OR is_type"), "comments")  # other lines only end runs; read twice
    if chunk_rows is None:
        rows = dealt(rows, FILE, rows.count())
    run_key = [*FILE, "run"]
    # numbers only per run; two comments make a text even if both are empty, as a space parts them
    runs = rows.groupBy(*run_key).agg(
        F.min(F.when(F.col("is_type"), F.col("line_no"))).alias("type_line"),
        F.count("comment").alias("comments"),
        F.max(F.length("comment")).alias("longest"),
    )
    runs = runs.where("type_line IS NOT NULL AND (comments > 1 OR longest > 0)")
    first = runs.groupBy(*FILE).agg(F.min_by("run", "type_line").alias("run"))
    comments = rows.where("comment IS NOT NULL AND NOT is_type")  # no comment is a type
    chosen = comments.join(first, run_key).groupBy(*FILE)
    chosen = chosen.agg(F.array_sort(F.collect_list(F.struct("line_no", "comment"))).alias("run_comments"))
    return chosen.select(*FILE, F.array_join(F.col("run_comments.comment"), " ").alias("description"))


def todo_counts(lines: DataFrame, chunk_rows: int | None = AUTO) -> DataFrame:
    """Lines with a TODO / FIXME comment per file (files without any are absent)."""

    def has(word: str) -> Column:
        return F.col("trimmed").contains(f"// {word}") | F.col("trimmed").contains(f"//{word}")

    go = go_lines(lines, has("TODO") | has("FIXME"), chunk_rows).where("NOT consumed")
    go = go.select(*FILE, has("TODO").alias("todo"), has("FIXME").alias("fixme"))
    proto = lines.where(_is_proto(F.col("path"))).select(
        *FILE, F.col("text").contains("// TODO").alias("todo"), F.col("text").contains("// FIXME").alias("fixme")
    )
    return (
        go.unionByName(proto)
        .where("todo OR fixme")
        .groupBy(*FILE)
        .agg(F.count_if("todo").alias("todo_count"), F.count_if("fixme").alias("fixme_count"))
    )


def function_extents(lines: DataFrame, chunk_rows: int | None = AUTO) -> DataFrame:
    """Functions with start line, end line and length; unterminated and swallowed ones are absent.

    With S the running brace balance, a function starting at s ends at the first line e >= s that has
    a closing brace and S(e) <= S(s-1). Between s and e the balance never falls below S(s-1), so e is
    also the first closing line whose levels S(e)..S(e-1) include S(s-1): an ordered lookup per
    (file, level) instead of a range join. Extents are nested or disjoint, so the outermost ones are
    those not covered by the greatest earlier end.
    """
    chunk_rows = fit_chunks(lines, "line_no", chunk_rows)
    t = F.col("trimmed")
    is_func = t.startswith("func")
    rows = go_lines(lines, is_func | t.contains("{") | t.contains("}"), chunk_rows).where("NOT consumed")
    opens, closes = text.count_char(t, "{"), text.count_char(t, "}")
    rows = rows.select(
        *FILE,
        "line_no",
        text.capture(t, fixed.GO_FUNC).alias("name"),
        (opens - closes).alias("delta"),
        (closes > 0).alias("has_close"),
    ).where("name <> '' OR delta <> 0 OR has_close")
    rows = running(rows, FILE, "line_no", {"after": ("sum", F.col("delta").cast("bigint"), True)}, chunk_rows)
    before = F.col("after") - F.col("delta")

    starts = rows.where("name <> ''").select(
        *FILE, "line_no", before.alias("level"), "name", F.lit(None).cast("int").alias("closing")
    )
    # a net-opening line with a closing brace reaches only its own level S(e) <= S(e-1) when delta <= 0
    closers = rows.where("has_close AND delta <= 0").select(
        *FILE,
        "line_no",
        F.explode(F.sequence(F.col("after"), before)).alias("level"),
        F.lit("").alias("name"),
        F.col("line_no").cast("int").alias("closing"),
    )
    paired = running(
        starts.unionByName(closers),
        [*FILE, "level"],
        "line_no",
        {"end_line": ("min", F.col("closing"), True)},
        chunk_rows,
        reverse=True,
        tie=["name"],  # a closing row ('' ) sorts before the start on the same line
    ).where("name <> ''")
    never = F.lit(2_147_483_647)
    spans = running(
        paired.select(*FILE, "line_no", "name", F.coalesce("end_line", never).alias("end_line")),
        FILE,
        "line_no",
        {"covered": ("max", F.col("end_line"), False)},
        chunk_rows,
    )
    return spans.where(
        (F.col("end_line") < never) & (F.col("covered").isNull() | (F.col("covered") < F.col("line_no")))
    ).select(
        *FILE,
        "name",
        F.col("line_no").alias("start_line"),
        "end_line",
        (F.col("end_line") - F.col("line_no") + 1).alias("line_count"),
    )


def longest_function_per_file(extents: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("name", "start_line", "line_count"), F.struct("line_count", -F.col("start_line")))
    return extents.groupBy(*FILE).agg(best.alias("f")).select(*FILE, "f.name", "f.start_line", "f.line_count")


def big_functions(extents: DataFrame, min_lines: int = fixed.BIG_FUNCTION_LINES) -> DataFrame:
    return extents.where(F.col("line_count") >= min_lines)


def parsed_files(files: DataFrame, lines: DataFrame, chunk_rows: int | None = AUTO, extents: DataFrame | None = None) -> DataFrame:
    """One row per Go / proto file: counters, package, description, nested declaration and import lists.

    ``files``: repo, path, service. One classified pass over the lines feeds a single aggregate per
    file; only the description and the function extents add passes of their own. ``extents``: ``function_extents(lines)``,
    if they are at hand.
    """
    chunk_rows = fit_chunks(lines, "line_no", chunk_rows)
    ext = text.extension(F.col("path"))
    base = files.where(ext.isin(*fixed.SOURCE_EXTENSIONS)).select(*FILE, "service", ext.alias("file_type"))

    t = F.col("trimmed")
    type_name, func_name = text.capture(t, fixed.GO_TYPE, 1), text.capture(t, fixed.GO_FUNC, 1)

    def has(word: str) -> Column:
        return t.contains(f"// {word}") | t.contains(f"//{word}")

    carry = {
        "package": F.when(t.startswith("package "), text.strip(F.substring(t, 9, 1 << 30))),
        "_type": F.when(t.startswith("type"), type_name).otherwise(""),
        "_kind": F.when(t.startswith("type"), text.capture(t, fixed.GO_TYPE, 2)),
        "_func": F.when(t.startswith("func"), func_name).otherwise(""),
        "todo": has("TODO"),
        "fixme": has("FIXME"),
    }
    is_type, own = F.col("_type") != "", ~F.col("consumed")
    one = F.struct(
        F.lit(0).alias("kind_ord"),
        F.when(is_type, F.col("_type")).otherwise(F.col("_func")).alias("name"),
        F.when(is_type, F.col("_kind")).otherwise("func").alias("kind"),
    )
    no_decl = F.array().cast("array<struct<kind_ord:int,name:string,kind:string>>")
    declared = F.when(own & (one["name"] != ""), F.array(one)).otherwise(no_decl)
    go = go_lines(lines, None, chunk_rows, carry).select(
        *FILE, "line_no", "package", "imported", declared.alias("declared"),
        (own & F.col("todo")).alias("todo"), (own & F.col("fixme")).alias("fixme"),
    )
    found = F.array(
        *[
            F.struct(F.lit(i).alias("kind_ord"), text.capture(t, p).alias("name"), F.lit(k).alias("kind"))
            for i, (k, p) in enumerate(fixed.PROTO_KINDS.items())
        ]
    )
    proto = (
        lines.where(_is_proto(F.col("path")))
        .select(*FILE, "line_no", text.strip(F.col("text")).alias("trimmed"))
        .select(
            *FILE, "line_no", F.nullif(text.capture(t, fixed.PROTO_PACKAGE), F.lit("")).alias("package"),
            text.capture(t, fixed.PROTO_IMPORT).alias("imported"),
            F.filter(found, lambda d: d["name"] != "").alias("declared"),
            t.contains("// TODO").alias("todo"), t.contains("// FIXME").alias("fixme"),
        )
    )
    at = F.col("line_no")
    has_package = F.col("package").isNotNull()
    per_file = go.unionByName(proto).groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.min(F.when(has_package, F.struct(at, F.col("package")))).alias("first_package"),
        F.max(F.when(has_package, F.struct(at, F.col("package")))).alias("last_package"),
        F.count_if("todo").alias("todo_count"),
        F.count_if("fixme").alias("fixme_count"),
        F.array_sort(F.collect_list(F.when(F.col("imported") != "", F.struct(at, F.col("imported"))))).alias("imports"),
        F.array_sort(F.collect_list(F.when(F.size("declared") > 0, F.struct(at, F.col("declared"))))).alias("declarations"),
    )
    extents = function_extents(lines, chunk_rows) if extents is None else extents
    functions = extents.groupBy(*FILE).agg(
        F.max_by(F.struct("name", "line_count"), F.struct("line_count", -F.col("start_line"))).alias("longest_function"),
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.when(F.col("line_count") >= fixed.BIG_FUNCTION_LINES, F.struct("start_line", "name", "line_count"))
                )
            ),
            lambda f: F.struct(f["name"].alias("name"), f["line_count"].alias("line_count")),
        ).alias("big_functions"),
    )
    out = base
    for side in (per_file, functions, extract_description(lines, chunk_rows)):
        out = out.join(side, FILE, "left")
    zero, none = F.lit(0), F.lit("")
    package = F.when(F.col("file_type") == "go", F.col("first_package.package")).otherwise(F.col("last_package.package"))
    pairs = F.flatten(F.col("declarations.declared"))
    return out.select(
        *FILE,
        "service",
        "file_type",
        F.coalesce("line_count", zero).alias("line_count"),
        F.coalesce(package, none).alias("package"),
        F.coalesce("description", none).alias("description"),
        F.coalesce("todo_count", zero).alias("todo_count"),
        F.coalesce("fixme_count", zero).alias("fixme_count"),
        F.coalesce(F.col("imports.imported"), F.array().cast("array<string>")).alias("imports"),
        F.coalesce(
            F.transform(pairs, lambda d: F.struct(d["name"].alias("name"), d["kind"].alias("kind"))),
            F.array().cast("array<struct<name:string,kind:string>>"),
        ).alias("declarations"),
        "longest_function",
        F.coalesce("big_functions", F.array().cast("array<struct<name:string,line_count:int>>")).alias("big_functions"),
    )
