"""Service inference over a directory listing; paths are relative to the analysed root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import fixed, text


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")


def service_dirs(tree: DataFrame) -> DataFrame:
    """Directories that hold a service marker or a ``.git`` entry."""
    name = text.file_name(F.col("path"))
    marked = name.isin(*fixed.SERVICE_MARKERS, ".git") | name.endswith(fixed.SERVICE_MARKER_SUFFIX)
    return tree.where(marked).select(_parent(F.col("path")).alias("path")).where("path <> ''").distinct()


def discover_services(tree: DataFrame, excluded=fixed.EXCLUDED_DIRS) -> DataFrame:
    """Service directories found at level 1, in level-1 containers, or in level-2 containers.

    A level-1 service ends the descent, so no discovered directory lies inside another. Yields path
    and ``discovery_ord`` (the path parts: directory reading order).
    """
    marked = service_dirs(tree)
    p = F.split(F.col("path"), "/")
    depth = F.size(p)
    hidden = F.exists(p, lambda d: d.startswith(".") | d.isin(*excluded))

    def container(d: Column) -> Column:
        return F.lower(d).isin(*fixed.CONTAINER_DIRS)

    reach = (
        (depth == 1)
        | ((depth == 2) & container(p[0]))
        | ((depth == 3) & ~container(p[0]) & container(F.get(p, F.lit(1))))
    )
    candidates = marked.where(~hidden & reach).withColumn("top", p[0])
    level1 = candidates.where("instr(path, '/') = 0").select(F.col("path").alias("top"))
    nested = candidates.where("instr(path, '/') > 0").join(level1, "top", "left_anti")
    found = candidates.where("instr(path, '/') = 0").select("path").unionByName(nested.select("path"))
    return found.select("path", F.split(F.col("path"), "/").alias("discovery_ord"))


def services_root(services: DataFrame) -> DataFrame:
    """Most common first part among services at depth two or more, if at least two share it, else ''."""
    counted = (
        services.where("instr(path, '/') > 0")
        .groupBy(F.substring_index("path", "/", 1).alias("root"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n >= 2")
    )
    return counted.agg(F.min_by("root", F.struct(-F.col("n"), F.col("root"))).alias("r")).select(
        F.coalesce("r", F.lit("")).alias("services_root")
    )


def _after_first(p: Column, names: tuple[str, ...]) -> Column:
    """The part after the first part that is one of ``names`` and not the last part, else null."""
    at = F.array_min(
        F.array_compact(F.array(*[F.nullif(F.array_position(F.slice(p, 1, F.size(p) - 1), n), F.lit(0)) for n in names]))
    )
    return F.get(p, at.cast("int"))


def assign_service(files: DataFrame, services: DataFrame, tree: DataFrame) -> DataFrame:
    """Add ``service`` to files: first discovered directory above the path, else the naming cascade.

    A file has at most three ancestors that can be services (depth 1 to 3), so this is one equality
    join per depth; Spark broadcasts the service list only while it is small.
    """
    p = F.split(F.col("path"), "/")
    out = files
    for d in (1, 2, 3):
        side = services.where(F.size("discovery_ord") == d).select(
            F.col("path").alias(f"_key{d}"), F.struct("discovery_ord", text.file_name(F.col("path")).alias("name")).alias(f"_hit{d}")
        )
        key = F.when(F.size(p) >= d, F.array_join(F.slice(p, 1, d), "/"))
        out = out.withColumn(f"_key{d}", key).join(side, f"_key{d}", "left")
    marked_top = (
        tree.where(F.size(F.split(F.col("path"), "/")) == 2)
        .where(text.file_name(F.col("path")).isin(*fixed.REPO_DIR_MARKERS))
        .select(F.substring_index("path", "/", 1).alias("_key1"))
        .distinct()
        .withColumn("_marked", F.lit(True))
    )
    out = out.join(marked_top, "_key1", "left")
    found = F.least("_hit1", "_hit2", "_hit3")  # lowest discovery order; nulls are skipped
    cascade = F.coalesce(
        F.when(F.size(p) < 2, F.lit("root")),
        F.when(F.col("_marked"), p[0]),
        _after_first(p, ("cmd",)),
        _after_first(p, ("services", "service", "apps", "microservices", "svc")),
        _after_first(p, ("proto", "api", "pkg")),
        _after_first(p, ("internal",)),
        p[0],
    )
    return out.withColumn("service", F.coalesce(found["name"], cascade)).drop(
        "_marked", *[f"_{k}{d}" for k in ("key", "hit") for d in (1, 2, 3)]
    )


def files_by_service(files: DataFrame) -> DataFrame:
    """Number of files and first / last path per service; the long form stays the data model."""
    return files.groupBy("service").agg(
        F.count(F.lit(1)).alias("file_count"), F.min("path").alias("first_path"), F.max("path").alias("last_path")
    )


def foreign_services(files: DataFrame, services: DataFrame, source_files: DataFrame) -> DataFrame:
    """Services written in other languages.

    ``files``: path, line_count of every non-pruned file; ``source_files``: service of Go / proto files.
    The language is that of the first file in walk order.
    """
    langs = F.create_map(*[F.lit(x) for kv in fixed.LANGUAGES.items() for x in kv])
    ext = text.extension(F.col("path"))
    p = F.split(F.col("path"), "/")
    above = F.array(*[F.when(F.size(p) > d, F.array_join(F.slice(p, 1, d), "/")) for d in (1, 2, 3)])
    foreign = files.where(ext.isin(*fixed.LANGUAGES)).select(
        "path", "line_count", langs[ext].alias("language"), F.explode(F.array_compact(above)).alias("service_path")
    )
    per_dir = (
        foreign.join(services.select(F.col("path").alias("service_path")), "service_path")
        .groupBy("service_path")
        .agg(
            F.count(F.lit(1)).alias("file_count"),
            F.sum("line_count").alias("line_count"),
            F.min_by("language", F.split(F.col("path"), "/")).alias("language"),
        )
        .where("file_count >= 2")
        .withColumn("name", text.file_name(F.col("service_path")))
    )
    taken = source_files.select(F.col("service").alias("name")).distinct()
    return per_dir.join(taken, "name", "left_anti").select("name", "language", "service_path", "line_count", "file_count")
