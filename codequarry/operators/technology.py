"""Technology detection: dictionary lookups over imports and manifest lines.

Dictionaries are fixed and small (at most 45 entries), so they are constant arrays inside a projection:
no join at all, and nothing that grows with the data is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import fixed, text
from codequarry.functions.scan import AUTO, fit_chunks, running


def _entries(table: dict[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("tech")) for k, v in table.items()])


def _longest_hit(table: dict[str, str], hit) -> Column:
    """Technology of the longest matching key (then the greatest key), null when none matches."""
    found = F.filter(_entries(table), lambda e: hit(e["key"]))
    best = F.array_max(F.transform(found, lambda e: F.struct(F.length(e["key"]).alias("n"), e["key"].alias("key"), e["tech"].alias("tech"))))
    return best["tech"]


def import_technology(imported: Column) -> Column:
    return _longest_hit(fixed.IMPORT_TECH, lambda k: F.startswith(imported, k))


def image_technology(low: Column) -> Column:
    """Technology of a lower-cased image name."""
    return _longest_hit(fixed.IMAGE_TECH, lambda k: F.contains(low, k))


def _once(rows: DataFrame, value: Column, *keys: str) -> DataFrame:
    """Distinct keys and ``value``, with their number, so that a dictionary is searched once per value and not once per row."""
    return rows.groupBy(*keys, value.alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def _found(found: Column) -> Column:
    """What ``found`` says of a value of ``_once``. It depends on the number of rows, or Spark would test it on all rows before grouping them."""
    return F.when(F.col("rows") > 0, found)


def _looked_up(once: DataFrame, found: Column, *keys: str) -> DataFrame:
    return once.select(*keys, _found(found).alias("technology")).where("technology IS NOT NULL").distinct()


def tech_from_imports(imports: DataFrame) -> DataFrame:
    """Distinct (service, technology) of imports(service, import); equal imports are looked up once."""
    return _looked_up(_once(imports, F.col("import"), "service"), import_technology(F.col("value")), "service")


def _name(path: Column) -> Column:
    return text.file_name(path)


def tech_from_gomod(lines: DataFrame) -> DataFrame:
    """Distinct technologies of go.mod lines(path, text); equal lines are looked up once."""
    once = _once(lines.where(_name(F.col("path")) == "go.mod"), text.strip(F.col("text")))
    return _looked_up(once, _longest_hit(fixed.GOMOD_TECH, lambda k: F.startswith(F.col("value"), k)))


def tech_from_makefile(lines: DataFrame) -> DataFrame:
    """Distinct technologies of Makefile lines (no keyword spans a line end); equal lines are looked up once."""
    once = _once(lines.where(_name(F.col("path")) == "Makefile"), F.lower(F.col("text")))
    found = F.transform(
        F.filter(_entries(fixed.MAKEFILE_TECH), lambda e: F.contains(F.col("value"), e["key"])), lambda e: e["tech"]
    )
    return once.select(F.explode(_found(found)).alias("technology")).distinct()


def compose_lines(lines: DataFrame, chunk_rows: int | None = AUTO, keep: Column | None = None) -> DataFrame:
    """Compose lines below a ``services:`` line, with their own and that line's indentation.

    ``keep`` names the lines the caller needs (over ``trimmed``); other lines are dropped before the shuffle.
    """
    chunk_rows = fit_chunks(lines, "line_no", chunk_rows)
    t = F.col("trimmed")
    rows = lines.where(_name(F.col("path")).isin(*fixed.COMPOSE_NAMES)).select(
        "path", "line_no", text.strip(F.col("text")).alias("trimmed"), text.indent(F.col("text"), 2).alias("indent")
    ).where((t != "") & ~t.startswith("#"))
    if keep is not None:
        rows = rows.where(keep | (t == "services:"))
    heads = F.when(t == "services:", F.struct("line_no", "indent"))
    rows = running(rows, ["path"], "line_no", {"_head": ("max", heads, False)}, chunk_rows)
    return rows.where(F.col("_head").isNotNull() & (t != "services:")).select(
        "path", "line_no", "trimmed", "indent", F.col("_head.indent").alias("base")
    )


def compose_services(lines: DataFrame, chunk_rows: int | None = AUTO) -> DataFrame:
    """Distinct service names: keys one level (two columns) below ``services:``; the block never closes."""
    rows = compose_lines(lines, chunk_rows).where((F.col("indent") == F.col("base") + 2) & F.col("trimmed").endswith(":"))
    return rows.select(F.regexp_replace("trimmed", r":\z", "").alias("service")).distinct()


def _is_image() -> Column:
    return F.col("trimmed").contains("image:")


def _hints(line: Column) -> list[Column]:
    """The technologies that a compose line's ports and variables hint at, null for those it doesn't."""
    up = F.upper(line)
    hints = []
    for tech, (words, port) in fixed.COMPOSE_HINTS.items():
        hit = line.contains(port)
        for w in words:
            hit = hit | up.contains(w)
        hints.append(F.when(hit, F.lit(tech)))
    return hints


def _has_hint() -> Column:
    return F.coalesce(*_hints(F.col("trimmed"))).isNotNull()


def _images(rows: DataFrame) -> DataFrame:
    image = F.btrim(text.strip(F.regexp_replace(F.col("trimmed"), r"\Aimage:", "")), F.lit("\"'"))
    return _looked_up(_once(rows.where(_is_image()), F.lower(image)), image_technology(F.col("value")))


def _env_ports(rows: DataFrame) -> DataFrame:
    found = F.array_compact(F.array(*_hints(F.col("value"))))
    return _once(rows, F.col("trimmed")).select(F.explode(_found(found)).alias("technology")).distinct()


def tech_from_images(lines: DataFrame, chunk_rows: int | None = AUTO) -> DataFrame:
    return _images(compose_lines(lines, chunk_rows, _is_image()))


def tech_from_env_ports(lines: DataFrame, chunk_rows: int | None = AUTO) -> DataFrame:
    return _env_ports(compose_lines(lines, chunk_rows, _has_hint()))


def manifest_technologies(lines: DataFrame, chunk_rows: int | None = AUTO) -> DataFrame:
    """Distinct technologies of all manifests; compose files are measured and shuffled once for images and hints."""
    composed = compose_lines(lines, chunk_rows, _is_image() | _has_hint())
    return (
        tech_from_gomod(lines)
        .unionByName(tech_from_makefile(lines))
        .unionByName(_images(composed))
        .unionByName(_env_ports(composed))
        .distinct()
    )


def service_technologies(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Distinct (service, technology): from imports, plus both gRPC entries for services with proto files.

    ``files``: service, file_type; files without a service are skipped.
    """
    named = F.col("service") != ""
    proto = (
        files.where(named & (F.col("file_type") == "proto"))
        .select("service")
        .distinct()
        .select("service", F.explode(F.array(F.lit("gRPC"), F.lit("Protocol Buffers"))).alias("technology"))
    )
    return tech_from_imports(imports.where(named)).unionByName(proto).distinct()


def technology_list(manifest: DataFrame, files: DataFrame, imports: DataFrame, foreign: DataFrame) -> DataFrame:
    """All technologies: manifests, Go, imports, gRPC pair if any proto file, foreign languages."""
    any_import = _looked_up(_once(imports, F.col("import")), import_technology(F.col("value")))
    proto = (
        files.where("file_type = 'proto'")
        .select("file_type")
        .distinct()
        .select(F.explode(F.array(F.lit("gRPC"), F.lit("Protocol Buffers"))).alias("technology"))
    )
    go = manifest.sparkSession.range(1).select(F.lit("Go").alias("technology"))
    return (
        manifest.unionByName(go)
        .unionByName(any_import)
        .unionByName(proto)
        .unionByName(foreign.select(F.col("language").alias("technology")))
        .distinct()
    )


def components(technologies: DataFrame, totals: DataFrame) -> DataFrame:
    """Known components among the technologies, in report order.

    ``totals``: one row with services, rpcs, test_files; it is cross-joined as that single row.
    """
    spark = technologies.sparkSession
    known = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(fixed.COMPONENTS)], "component_ord int, technology string, component string, base string"
    )
    dot = " · "
    grpc = F.concat(
        F.lit("gRPC"),
        F.when(F.col("services") > 0, F.concat(F.lit(dot), F.col("services").cast("string"), F.lit(" services"))).otherwise(""),
        F.when(F.col("rpcs") > 0, F.concat(F.lit(dot), F.col("rpcs").cast("string"), F.lit(" RPCs"))).otherwise(""),
    )
    testify = F.concat(
        F.lit("Testify"),
        F.when(F.col("test_files") > 0, F.concat(F.lit(dot), F.col("test_files").cast("string"), F.lit(" test files"))).otherwise(""),
    )
    summary = (
        F.when(F.col("technology") == "gRPC", grpc).when(F.col("technology") == "Testify", testify).otherwise(F.col("base"))
    )
    one = totals.agg(F.max("services").alias("services"), F.max("rpcs").alias("rpcs"), F.max("test_files").alias("test_files"))
    return (
        known.join(technologies.select("technology").distinct(), "technology", "left_semi")
        .crossJoin(one)
        .select("component_ord", "component", summary.alias("summary"))
    )
