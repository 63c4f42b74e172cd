"""Report tables. ``files``: id (absolute path), service, file_type, line_count, todo_count, fixme_count,
description, ...; ``declarations``: id, service, pos, name, kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import fixed, text
from codequarry.functions.scan import task_count
from codequarry.sources.store import settle

KINDS = {
    "structs": "struct",
    "interfaces": "interface",
    "funcs": "func",
    "messages": "message",
    "services": "service",
    "rpcs": "rpc",
    "enums": "enum",
}


def _service(col: str = "service") -> Column:
    return F.when(F.coalesce(F.col(col), F.lit("")) == "", "root").otherwise(F.col(col))


def _kind_counts() -> list[Column]:
    return [F.count_if(F.col("kind") == k).alias(n) for n, k in KINDS.items()]


def totals(files: DataFrame, declarations: DataFrame, foreign: DataFrame) -> DataFrame:
    """One row of global counters; three one-row aggregates side by side."""
    f = files.agg(
        F.coalesce(F.sum("line_count"), F.lit(0)).cast("bigint").alias("total_lines"),
        F.count_if(F.col("file_type") == "go").alias("go_files"),
        F.count_if(F.col("file_type") == "proto").alias("proto_files"),
        F.coalesce(F.sum("todo_count"), F.lit(0)).cast("bigint").alias("todos"),
        F.coalesce(F.sum("fixme_count"), F.lit(0)).cast("bigint").alias("fixmes"),
        F.count_distinct(_service()).alias("own_services"),
    )
    d = declarations.agg(*_kind_counts(), F.count(F.lit(1)).alias("declarations"))
    x = foreign.agg(F.count(F.lit(1)).alias("foreign_services"))
    return (
        f.crossJoin(d)
        .crossJoin(x)
        .withColumn("service_count", F.col("own_services") + F.col("foreign_services"))
        .drop("own_services", "foreign_services")
    )


def service_summary(files: DataFrame, declarations: DataFrame) -> DataFrame:
    per_file = files.groupBy(_service().alias("service")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("line_count").cast("bigint").alias("total_lines")
    )
    per_decl = declarations.groupBy(_service().alias("service")).agg(F.count(F.lit(1)).alias("declarations"), *_kind_counts())
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("declarations", *KINDS)]
    return per_file.join(per_decl, "service", "left").select("service", "files", "total_lines", *zeros)


def service_order(summary: DataFrame) -> DataFrame:
    """Gateways first, then proto services, then by lines, equal sizes by name: the order as ``place`` (from 1), with its keys.

    ``summary`` has one row per service, so its ranking fits one task.
    """
    s = F.col("service")
    keyed = summary.select("service", "total_lines", text.is_gateway(s).alias("is_gateway"), text.is_proto_service(s).alias("is_proto"))
    order = Window.orderBy(F.desc("is_gateway"), F.desc("is_proto"), F.desc("total_lines"), "service")
    return keyed.withColumn("place", F.row_number().over(order))


def foreign_language_lines(foreign: DataFrame) -> DataFrame:
    return foreign.groupBy("language").agg(F.sum("line_count").cast("bigint").alias("lines"))


def layer_of(path: Column, file_type: Column) -> Column:
    """Layer of a file: the first match of the ordered layer list over its lower-cased path."""
    low = F.lower(path)
    name = text.file_name(low)
    p = text.parts(low)

    def any_part(names: tuple[str, ...]) -> Column:
        return F.arrays_overlap(p, F.array(*[F.lit(n) for n in names]))

    out = F.when(name.endswith("_test.go") | any_part(fixed.TEST_DIRS), fixed.LAYER_TESTS).when(
        file_type == "proto", fixed.LAYER_API
    )
    for layer, dirs, names in fixed.LAYER_RULES:
        out = out.when(name.isin(*names) | any_part(dirs), layer)
    return out.otherwise(fixed.LAYER_OTHER)


def layer_of_file(files: DataFrame) -> DataFrame:
    return files.withColumn("layer", layer_of(F.col("id"), F.col("file_type")))


def layer_rollup(files: DataFrame) -> DataFrame:
    """Files, lines and bar width per layer, with the display position."""
    sums = layer_of_file(files).groupBy("layer").agg(
        F.count(F.lit(1)).alias("files"), F.sum("line_count").cast("bigint").alias("lines")
    )
    most = F.greatest(F.max("lines").over(Window.partitionBy(F.lit(1))), F.lit(1))  # at most 11 rows
    order = F.array_position(F.array(*[F.lit(x) for x in fixed.LAYER_DISPLAY_ORDER]), F.col("layer"))
    pct = F.greatest(F.floor(F.col("lines") * 100 / most), F.lit(4)).cast("bigint")
    return sums.select(order.alias("layer_ord"), "layer", "files", "lines", pct.alias("pct"))


def service_penetration(files: DataFrame, imports: DataFrame, n: int = 20) -> DataFrame:
    """Services named in other services' import paths, by number of importing services.

    A name may occur anywhere in an import, so the test is a substring join over distinct imports.
    """
    names = files.select(_service().alias("target")).distinct().select("target", F.lower("target").alias("needle"))
    pairs = imports.where("service <> ''").select("service", F.lower("import").alias("import")).distinct()
    texts = pairs.select("import").distinct()
    found = substring_join(texts, "import", names, "needle").select("import", "target")
    hits = pairs.join(found, "import").where("service <> target").select("target", "service").distinct()
    best = hits.groupBy("target").agg(F.count(F.lit(1)).alias("dependents")).orderBy(F.desc("dependents"), "target").limit(n)
    # only the n reported services collect their importers; those are service names, once each
    lists = hits.join(F.broadcast(best), "target").groupBy("target", "dependents").agg(F.sort_array(F.collect_list("service")).alias("importers"))
    return lists.select("target", "dependents", "importers")


ANCHOR = 3


def _pieces(src: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(src) - n + 1), lambda i: F.substring(src, i, n))


def substring_join(left: DataFrame, text_col: str, right: DataFrame, needle_col: str) -> DataFrame:
    """Pairs where the needle occurs in the text, as an equality join.

    Each needle is looked up by one piece of ``ANCHOR`` characters (all of it if shorter), the one that fewest needles
    have. Texts meet the needles whose piece they hold, and only those are searched for the whole needle, so what a text
    emits doesn't grow with the number of needle lengths; only pieces as long as some needle's are made. Texts are dealt over
    ``task_count`` tasks before they are cut, as they are small and their pieces are not. Null texts and null or empty needles
    pair with nothing.
    """
    needles = right.select(needle_col).where(F.length(needle_col) > 0).distinct()
    parts = needles.select(needle_col, F.explode(F.array_distinct(_pieces(F.col(needle_col), F.least(F.length(needle_col), F.lit(ANCHOR))))).alias("_anchor"))
    held = parts.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_held"))
    anchors = parts.join(held, "_anchor").groupBy(needle_col).agg(F.min_by("_anchor", F.struct("_held", "_anchor")).alias("_anchor"))
    anchors = settle(right.join(anchors, needle_col), "anchors")  # their size decides how texts meet them
    sizes = anchors.agg(F.collect_set(F.length("_anchor")).alias("_sizes"))  # one row, ANCHOR numbers at most
    src = F.col(text_col)
    by_hash = F.xxhash64(*left.columns)  # by the columns, Spark would take a shuffle before this one for it, and put its partitions together
    spread = left.repartition(task_count(left.sparkSession), by_hash).crossJoin(F.broadcast(sizes))
    grams = F.flatten(F.transform(F.filter("_sizes", lambda n: n <= F.length(src)), lambda n: _pieces(src, n)))
    met = spread.withColumn("_anchor", F.explode(F.array_distinct(grams))).drop("_sizes").join(anchors, "_anchor").drop("_anchor")
    return met.where(F.contains(src, F.col(needle_col)))


def todo_density(files: DataFrame) -> DataFrame:
    sums = files.groupBy(_service().alias("service")).agg(
        F.sum("todo_count").cast("bigint").alias("todos"), F.sum("fixme_count").cast("bigint").alias("fixmes")
    )
    return sums.withColumn("total", F.col("todos") + F.col("fixmes")).where("total > 0")


def longest_functions(per_file: DataFrame, n: int = 20) -> DataFrame:
    """Longest among the per-file longest functions: (id, name, line_count)."""
    return per_file.select("id", "name", "line_count").orderBy(F.desc("line_count"), "id").limit(n)


def file_inventory(files: DataFrame) -> DataFrame:
    """Files of a service with declaration list and description (for display, and whole), without ``module.go``.

    ``files`` has ``declarations`` as a nested array. ``position`` is not stored: consumers sort by
    (service, line_count desc, id), which needs no per-service task.
    """
    shown = F.array_join(F.transform("declarations", lambda d: F.concat_ws(" ", d["kind"], d["name"])), ", ")
    return files.where(text.file_name(F.col("id")) != "module.go").select(
        _service().alias("service"),
        "id",
        text.file_name(F.col("id")).alias("file_name"),
        "line_count",
        F.size("declarations").alias("declaration_count"),
        shown.alias("declaration_list"),
        text.cut_bytes(F.col("description"), 120).alias("description"),
        F.col("description").alias("whole_description"),
        F.when(F.col("file_type") == "proto", "proto").otherwise("").alias("type_tag"),
    )


def team_map(authors: DataFrame, modified: DataFrame, loc: DataFrame, n: int = 30, top_services: int = 3) -> DataFrame:
    """Authors by number of files where they are a top author, with commits, lines per commit and services.

    ``modified``: author, service, files_modified. The cut to n authors comes before the service lists.
    """
    total = modified.groupBy("author").agg(F.sum("files_modified").cast("bigint").alias("files_modified"))
    best = (
        authors.join(total, "author", "left")
        .withColumn("files_modified", F.coalesce("files_modified", F.lit(0)))
        .orderBy(F.desc("files_modified"), "author")
        .limit(n)
    )
    order = Window.partitionBy("author").orderBy(F.desc("files_modified"), "service")
    named = modified.where("service <> ''").join(F.broadcast(best.select("author")), "author", "left_semi")
    ranked = named.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top_services)
    lists = ranked.groupBy("author").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "service"))), lambda r: r["service"]).alias("top_services")
    )
    per_commit = F.when(
        (F.col("total_commits") > 0) & (F.coalesce("loc_added", F.lit(0)) > 0),
        F.floor(F.col("loc_added") / F.col("total_commits")).cast("bigint"),
    )
    day = lambda c: F.when(F.col(c) > 0, F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd"))
    return (
        best.join(loc, "author", "left")
        .join(lists, "author", "left")
        .select(
            "author",
            "files_modified",
            "total_commits",
            per_commit.alias("loc_per_commit"),
            day("first_commit").alias("first_date"),
            day("last_commit").alias("last_date"),
            F.coalesce("top_services", F.array().cast("array<string>")).alias("top_services"),
        )
    )


def churn_display(churn: DataFrame) -> DataFrame:
    return churn.withColumn("display_path", text.churn_display(F.col("path")))


def semantic_standards(tags: DataFrame, latest: DataFrame, commits: DataFrame) -> DataFrame:
    """Shares of version tags and structured messages in whole percent; every input has one row."""

    def pct(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.floor(F.col(part) * 100 / F.col(whole))).otherwise(0).cast("bigint")

    return (
        tags.crossJoin(latest)
        .crossJoin(commits)
        .select(
            "total_tags",
            "semver_tags",
            pct("semver_tags", "total_tags").alias("semver_pct"),
            "latest_semver",
            "total",
            "typed",
            pct("typed", "total").alias("conventional_pct"),
        )
    )


def branch_health(inventory: DataFrame, stale: DataFrame, durations: DataFrame, rollback: DataFrame, peak: DataFrame) -> DataFrame:
    """All branch metrics in one row; no row without branches."""
    inv = inventory.agg(F.count(F.lit(1)).alias("total_branches"), F.max("depth").alias("max_depth")).where("total_branches > 0")
    late = stale.agg(F.count(F.lit(1)).alias("stale_branches"))
    return (
        inv.crossJoin(late).crossJoin(durations).crossJoin(rollback)
        .crossJoin(peak.agg(F.max("peak_day").alias("peak_day")))
    )


def service_grid(summary: DataFrame, foreign: DataFrame) -> DataFrame:
    """Own services, then foreign ones, with size."""
    own = summary.select("service", F.lit("").alias("language"), F.col("total_lines").cast("bigint").alias("lines"), F.lit(False).alias("is_foreign"))
    other = foreign.select(F.col("name").alias("service"), "language", F.col("line_count").cast("bigint").alias("lines"), F.lit(True).alias("is_foreign"))
    return own.unionByName(other)
