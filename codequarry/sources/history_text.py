"""Exported version-control text -> rows. Each reader has a text parser that works on any text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.functions.scan import AUTO, fit_chunks, place_in_group, running

COMMIT_MARK = "__COMMIT__\n"
AUTHOR_MARK = "__AUTHOR__\n"
#: A log export whose records can't be confused with their content: record, field and message ends are control characters.
#: ``git log --topo-order --name-only --format='%x1e%H%x1f%P%x1f%an%x1f%at%x1f%B%x1d'``
RECORD_MARK = "\x1e"
#: A blame header has a commit of 40 digits and at least two more fields.
HEADER_CHARS = 44


def read_blocks(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """Split a log dump into blocks at ``mark`` while reading; the file stays splittable."""
    return spark.read.option("lineSep", mark).text(path).where("value <> ''").withColumnRenamed("value", "block")


def read_exports(spark: SparkSession, folder: str, mark: str) -> DataFrame:
    """Exports of several repositories, ``folder/repo=<name>/<files>``, in one job: repo, block, ``seq``.

    Files are split by bytes, so one large export is read by several tasks. ``seq`` is the place (from 1) of a block in its
    repository's export; of several files of a repository the one that comes first by name is read first. Empty blocks drop out.
    """
    rows = spark.read.schema("value string, repo string").option("lineSep", mark).text(folder).where("value <> ''")
    rows = rows.select(
        "repo", F.col("value").alias("block"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    return place_in_group(rows, "repo", ["_file", "_start", "_at"], "seq").select("repo", "block", "seq")


def write_exports(rows: DataFrame, order: str, folder: str, mark: str) -> str:
    """Write ``repo, block`` in the given order within each repository as ``read_exports`` reads them; the folder."""
    placed = rows.repartitionByRange("repo", order).sortWithinPartitions("repo", order)
    placed.select("repo", "block").write.partitionBy("repo").option("lineSep", mark).text(folder)
    return folder


def ingest_commit_log(blocks: DataFrame) -> DataFrame:
    """``block`` = author, epoch seconds, subject, then one touched path per line.

    Yields the other columns of ``blocks`` plus author, ts, subject, path (one row per touched path).
    """
    keys = [c for c in blocks.columns if c != "block"]
    rows = blocks.select(*keys, F.split("block", "\n").alias("_l")).where(F.size("_l") >= 3)
    return (
        rows.select(
            *keys,
            F.col("_l")[0].alias("author"),
            F.coalesce(text.strip(F.col("_l")[1]).try_cast("double"), F.lit(0.0)).alias("ts"),
            F.col("_l")[2].alias("subject"),
            F.explode(F.slice("_l", 4, 1 << 30)).alias("_p"),
        )
        .withColumn("path", text.strip(F.col("_p")))
        .where("path <> ''")
        .drop("_p")
    )


def ingest_commits(blocks: DataFrame) -> DataFrame:
    """``block`` = one record of the ``RECORD_MARK`` export, ``seq`` its place in the log: the commits table.

    Yields the other columns of ``blocks`` plus hash, parents, author, ts, subject (the message's first line),
    message, log_seq and ``paths``, the touched files (none for a commit that touches none). Records without
    all five fields are no commits and drop out; a time that is no number is 0.
    """
    keys = [c for c in blocks.columns if c not in ("block", "seq")]
    cell = F.split("block", "\x1f", 5)
    rows = blocks.where(F.size(cell) == 5).select(*keys, F.col("seq").alias("log_seq"), cell.alias("_c"))
    rest = F.split(F.get("_c", F.lit(4)), "\x1d", 2)
    message = text.strip(F.get(rest, F.lit(0)))
    paths = F.filter(F.transform(F.split(F.coalesce(F.get(rest, F.lit(1)), F.lit("")), "\n"), text.strip), lambda x: x != "")
    return rows.select(
        *keys,
        text.strip(F.get("_c", F.lit(0))).alias("hash"),
        F.filter(F.split(F.get("_c", F.lit(1)), " "), lambda x: x != "").alias("parents"),
        F.get("_c", F.lit(2)).alias("author"),
        F.coalesce(text.strip(F.get("_c", F.lit(3))).try_cast("bigint"), F.lit(0)).alias("ts"),
        F.get(F.split(message, "\n", 2), F.lit(0)).alias("subject"),
        message.alias("message"),
        "log_seq",
        paths.alias("paths"),
    )


def commit_paths(commits: DataFrame) -> DataFrame:
    """repo, hash, path: one row per touched file of ``ingest_commits``."""
    return commits.select("repo", "hash", F.explode("paths").alias("path"))


def ingest_heads(lines: DataFrame) -> DataFrame:
    """``mark<TAB>name<TAB>epoch<TAB>hash`` lines: name, ts, tip, is_head; the other columns are kept.

    ``git for-each-ref refs/heads --format='%(HEAD)%09%(refname:short)%09%(committerdate:unix)%09%(objectname)'``;
    the mark is ``*`` for the branch that HEAD points to, whatever its name.
    """
    keys = [c for c in lines.columns if c != "text"]
    cell = F.split("text", "\t", 4)
    rows = lines.where(F.size(cell) == 4).select(
        *keys,
        text.strip(F.get(cell, F.lit(1))).alias("name"),
        F.coalesce(text.strip(F.get(cell, F.lit(2))).try_cast("bigint"), F.lit(0)).alias("ts"),
        text.strip(F.get(cell, F.lit(3))).alias("tip"),
        (text.strip(F.get(cell, F.lit(0))) == "*").alias("is_head"),
    )
    return rows.where("name <> '' AND tip <> ''")


def ingest_numstat(blocks: DataFrame) -> DataFrame:
    """``block`` = author line, then ``added deleted path`` lines; binary files have no number and drop out."""
    keys = [c for c in blocks.columns if c != "block"]
    lines = F.filter(F.split("block", "\n"), lambda x: text.strip(x) != "")
    rows = blocks.select(*keys, lines.alias("_l")).where(F.size("_l") > 1)
    rows = rows.select(
        *keys,
        text.strip(F.col("_l")[0]).alias("author"),
        F.explode(F.slice("_l", 2, 1 << 30)).alias("_s"),
    )
    fields = F.split(text.strip(F.col("_s")), r"[\s\x85\xa0]+", 3)
    return (
        rows.where(F.size(fields) >= 2)
        .select(*keys, "author", fields[0].try_cast("int").alias("added"), F.element_at(fields, -1).alias("path"))
        .where(F.col("added").isNotNull())
    )


def ingest_blame(dump: DataFrame, chunk_rows: int | None = AUTO) -> DataFrame:
    """Porcelain blame lines (repo, path, seq, text) -> author per (repo, path, line_no).

    A header names a commit and a line; the author's name follows only at a commit's first header. The
    header in force is carried over the file; authors then join by (file, commit). A line of code that
    looks like a header counts as one.
    """
    chunk_rows = fit_chunks(dump, "seq", chunk_rows)
    # only a line of a header's least length is parted, and once; what is no header, author or code says nothing below
    long_enough = F.length("text") >= HEADER_CHARS
    names_author, is_tabbed = F.col("text").startswith("author "), F.col("text").startswith("\t")
    parted = F.when(long_enough, F.split(text.strip(F.col("text")), r"[\s\x85\xa0]+", 4))
    rows = dump.where(names_author | is_tabbed | long_enough).select("repo", "path", "seq", "text", parted.alias("_f"))
    header = F.coalesce((F.size("_f") >= 3) & F.col("_f")[0].rlike(r"\A[0-9a-fA-F]{40}\z"), F.lit(False))
    rows = rows.select(
        "repo",
        "path",
        "seq",
        F.when(header, F.col("_f")[0]).alias("commit"),
        F.when(header, F.get("_f", F.lit(2)).try_cast("int")).alias("line_no"),
        F.when(names_author, F.substring("text", 8, 1 << 30)).alias("author"),
        F.when(is_tabbed & ~header, True).alias("is_code"),
    )
    # the running maximum of (seq, value) is the latest value
    at = F.col("seq")
    rows = running(
        rows,
        ["repo", "path"],
        "seq",
        {
            "_c": ("max", F.when(F.col("commit").isNotNull(), F.struct(at, F.col("commit"))), True),
            "_n": ("max", F.when(F.col("line_no").isNotNull(), F.struct(at, F.col("line_no"))), True),
        },
        chunk_rows,
    )
    file = ["repo", "path"]
    rows = rows.select(*file, "seq", F.col("_c.commit").alias("commit"), F.col("_n.line_no").alias("line_no"), "author", "is_code")
    # a commit's author as known at a line: the latest author line of that commit at or before it
    rows = running(
        rows.where("author IS NOT NULL OR is_code"),
        [*file, "commit"],
        "seq",
        {"_a": ("max", F.when(F.col("author").isNotNull(), F.struct(at, F.col("author"))), True)},
        chunk_rows,
    )
    return (
        rows.where("_a IS NOT NULL AND line_no > 0")
        .groupBy(*file, "line_no")
        .agg(F.max_by("_a.author", "seq").alias("author"))
    )


def ingest_branches(lines: DataFrame) -> DataFrame:
    """``name<TAB>epoch`` lines; the other columns (repo, repo_ord) are kept."""
    keys = [c for c in lines.columns if c != "text"]
    cells = F.split(text.strip(F.col("text")), "\t", 2)
    return (
        lines.where(F.size(cells) == 2)
        .select(
            *keys,
            text.strip(cells[0]).alias("name"),
            F.coalesce(text.strip(cells[1]).try_cast("bigint"), F.lit(0)).alias("ts"),
        )
        .where("name <> ''")
    )


def ingest_tags(lines: DataFrame) -> DataFrame:
    """One tag per line; the other columns are kept."""
    keys = [c for c in lines.columns if c != "text"]
    return lines.select(*keys, text.strip(F.col("text")).alias("tag")).where("tag <> ''")


def line_authors(blame: DataFrame, repos: DataFrame, files: DataFrame) -> DataFrame:
    """Author per line of an absolute path: from the first repository whose path prefixes the file's.

    ``blame``: repo, path (absolute), line_no, author; ``repos``: repo, repo_ord; ``files``: path.
    The prefix test is plain text, so ``/a/r`` also claims ``/a/r2``. Only repositories with blame rows
    for the file count, so the candidates are the blame rows themselves, not files times repositories.
    """
    held = blame.join(files.select("path").distinct(), "path", "left_semi").where("startswith(path, repo)")
    ranked = held.join(repos, "repo")
    first = ranked.groupBy("path").agg(F.min("repo_ord").alias("repo_ord"))
    return ranked.join(first, ["path", "repo_ord"], "left_semi").select("path", "line_no", "author")
