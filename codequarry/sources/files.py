"""File listings: source files, directory tree, manifests, repositories."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import fixed, text


def read_tree_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Read a folder of repositories: path (relative to ``root``), length, content (binary)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/") + "/"
    rel = F.element_at(F.split(F.col("path"), prefix, 2), -1)
    out = files.select(rel.alias("path"), "length", "content")
    return out if max_bytes is None else out.where(F.col("length") <= max_bytes)


def _dirs(path: Column) -> Column:
    p = F.split(path, "/")
    return F.slice(p, 1, F.size(p) - 1)


def prune_dirs(files: DataFrame, excluded: Iterable[str] = fixed.EXCLUDED_DIRS) -> DataFrame:
    """Drop paths below a hidden or excluded directory; hidden files stay."""
    names = F.array(*[F.lit(e) for e in excluded])
    return files.where(~F.exists(_dirs(F.col("path")), lambda d: d.startswith(".") | F.array_contains(names, d)))


def scan_source_files(
    files: DataFrame,
    extensions: Iterable[str] = fixed.SOURCE_EXTENSIONS,
    excluded: Iterable[str] = fixed.EXCLUDED_DIRS,
) -> DataFrame:
    """Source files by lower-cased extension, outside pruned directories."""
    return prune_dirs(files.where(text.extension(F.col("path")).isin(*extensions)), excluded)


def scan_manifests(files: DataFrame) -> DataFrame:
    """Compose files, go.mod and Makefile in the root and its non-hidden direct children."""
    p = F.col("path")
    depth = F.size(text.parts(p))
    visible = (depth == 1) | ((depth == 2) & ~p.startswith("."))
    return files.where(text.file_name(p).isin(*fixed.MANIFEST_NAMES) & visible)


def directory_tree(files: DataFrame) -> DataFrame:
    """All entries of a listing: files plus every ancestor directory, each once (path, is_dir)."""
    p = F.split(F.col("path"), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, 1, i), "/"))
    above = files.where(F.size(p) > 1).select(F.explode(ups).alias("path")).distinct()
    return (
        files.select("path")
        .distinct()
        .select("path", F.lit(False).alias("is_dir"))
        .unionByName(above.select("path", F.lit(True).alias("is_dir")))
    )


def root_subdirs(tree: DataFrame, excluded: Iterable[str] = fixed.EXCLUDED_DIRS) -> DataFrame:
    """Names of visible first-level directories."""
    name = F.col("path")
    return (
        tree.where("is_dir AND instr(path, '/') = 0")
        .where(~name.startswith(".") & ~name.isin(*excluded))
        .select(name.alias("name"))
        .distinct()
    )


def list_repos(tree: DataFrame, services: DataFrame, excluded: Iterable[str] = fixed.EXCLUDED_DIRS) -> DataFrame:
    """Directories that own a ``.git`` entry: the root ('' path), then visible first-level ones, then services.

    ``priority`` orders the three groups; within a group the order is that of the path parts.
    """
    owns = tree.where(text.file_name(F.col("path")) == ".git").select(
        F.regexp_replace(F.col("path"), r"/?\.git\z", "").alias("path")
    )
    top = owns.where("path = ''").select("path", F.lit(0).alias("priority"))
    level1 = owns.where("path <> '' AND instr(path, '/') = 0").where(
        ~F.col("path").startswith(".") & ~F.col("path").isin(*excluded)
    ).select("path", F.lit(1).alias("priority"))
    nested = owns.join(services.select("path"), "path", "left_semi").select("path", F.lit(2).alias("priority"))
    return top.unionByName(level1).unionByName(nested).groupBy("path").agg(F.min("priority").alias("priority"))
