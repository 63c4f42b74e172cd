"""Commit-history aggregates.

``commits``: repo, repo_ord, hash, author, ts (epoch seconds), subject, message, log_seq (position in
the log, newest first), parents. ``commit_files``: repo, hash, path, added (null for binary files).
``touches`` = commit_files joined to their commit (``file_touches``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import fixed, text


def latest_commits(commits: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest ``limit`` commits per repository in log order (None, the default, keeps all).

    Up to a limit of 1,000 the rank filter also limits each input partition before the shuffle, so that one
    large repository does not collect in one task.
    """
    if limit is None:
        return commits
    newest = Window.partitionBy("repo").orderBy("log_seq")
    return commits.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit).drop("_n")


def author_stats(commits: DataFrame) -> DataFrame:
    """Commits, first and last time per author name over all repositories."""
    return commits.where("ts > 0").groupBy("author").agg(
        F.count(F.lit(1)).alias("total_commits"), F.min("ts").alias("first_commit"), F.max("ts").alias("last_commit")
    )


def file_touches(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """One row per touched path with its commit's author, time, subject and log position."""
    side = commits.select("repo", "hash", "author", "ts", "subject", "log_seq")
    return commit_files.select("repo", "hash", "path").join(side, ["repo", "hash"])


def file_authors(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Touches by author: repo, path, author, n (their number) and the lines added, null if no file carries a number."""
    rows = commit_files.join(commits.select("repo", "hash", "author"), ["repo", "hash"])
    return rows.groupBy("repo", "path", "author").agg(F.count(F.lit(1)).alias("n"), F.sum("added").cast("bigint").alias("added"))


def _times(touches: DataFrame) -> Column:
    """The number of touches: of rows, or of those counted in ``n`` (``file_authors``)."""
    return F.sum("n") if "n" in touches.columns else F.count(F.lit(1))


def file_stats(touches: DataFrame) -> DataFrame:
    return touches.groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("change_count"),
        F.greatest(F.max("ts"), F.lit(0)).alias("last_modified"),
        F.coalesce(F.min(F.when(F.col("ts") > 0, F.col("ts"))), F.lit(0)).alias("first_commit_date"),
    )


def top_authors(touches: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """The n most frequent authors per key as an ordered array; equal counts go by name. ``touches`` may be counted."""
    counts = touches.groupBy(*keys, "author").agg(_times(touches).alias("c"))
    order = Window.partitionBy(*keys).orderBy(F.desc("c"), "author")
    best = counts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    ranked = F.array_sort(F.collect_list(F.struct("_n", "author")))
    return best.groupBy(*keys).agg(F.transform(ranked, lambda r: r["author"]).alias("top_authors"))


def top_authors_per_file(touches: DataFrame, n: int = 3) -> DataFrame:
    return top_authors(touches, ["repo", "path"], n)


def recent_messages(touches: DataFrame, n: int = 5) -> DataFrame:
    """First n subjects per file in log order, repeats kept; rank filters limit each input partition."""
    order = Window.partitionBy("repo", "path").orderBy("log_seq", "hash")
    first = touches.select("repo", "path", "log_seq", "hash", "subject").withColumn("_n", F.row_number().over(order))
    ranked = F.array_sort(F.collect_list(F.struct("_n", "subject")))
    return (
        first.where(F.col("_n") <= n)
        .groupBy("repo", "path")
        .agg(F.transform(ranked, lambda r: r["subject"]).alias("recent_messages"))
    )


def file_history(touches: DataFrame) -> DataFrame:
    """File statistics, top authors and recent messages per (repo, path)."""
    keys = ["repo", "path"]
    return file_stats(touches).join(top_authors_per_file(touches), keys).join(recent_messages(touches), keys)


def enrich_files(files: DataFrame, history: DataFrame, repos: DataFrame) -> DataFrame:
    """Parsed files with the history of their absolute path.

    ``files``: id (absolute path), ...; ``history``: repo, path, ...; ``repos``: repo, repo_ord. When two
    repositories yield one absolute path, the later repository wins.
    """
    side = history.join(repos, "repo").withColumn("id", text.abs_path(F.col("repo"), F.col("path"))).drop("path", "repo")
    names = [c for c in side.columns if c not in ("id", "repo_ord")]
    last = side.groupBy("id").agg(F.max_by(F.struct(*names), "repo_ord").alias("h")).select("id", "h.*")
    return files.join(last, "id", "left")


def author_files_modified(enriched: DataFrame, authors: DataFrame) -> DataFrame:
    """Files where an author is among the top authors: per (author, service); service '' is files without one.

    ``enriched``: id, service, top_authors; ``authors`` restricts to known authors.
    """
    rows = enriched.select("service", F.explode("top_authors").alias("author"))
    counts = rows.groupBy("author", "service").agg(F.count(F.lit(1)).alias("files_modified"))
    return counts.join(authors.select("author"), "author", "left_semi")


def author_loc(numstat: DataFrame, authors: DataFrame) -> DataFrame:
    """Added lines per known author (binary files carry no number)."""
    sums = numstat.where("added IS NOT NULL").groupBy("author").agg(F.sum("added").cast("bigint").alias("loc_added"))
    return sums.join(authors.select("author"), "author", "left_semi")


def churn(touches: DataFrame, top_n: int) -> DataFrame:
    """Most changed absolute paths with their three top authors; authors are ranked only for those paths. ``touches`` may be counted."""
    counted = [c for c in ("n",) if c in touches.columns]
    rows = touches.select(text.abs_path(F.col("repo"), F.col("path")).alias("path"), "author", *counted)
    best = rows.groupBy("path").agg(_times(rows).alias("change_count"))
    best = best.orderBy(F.desc("change_count"), "path").limit(top_n)
    # ``best`` has at most top_n rows; a small report size makes it a safe broadcast
    side = F.broadcast(best) if top_n <= 10_000 else best
    return top_authors(rows.join(side.select("path"), "path", "left_semi"), ["path"]).join(side, "path").select(
        "path", "change_count", "top_authors"
    )


def distinct_tags(tags: DataFrame) -> DataFrame:
    return tags.where("tag <> ''").select("tag").distinct()


def _is_semver(tag: Column) -> Column:
    return text.matches(tag, fixed.SEMVER)


def tag_stats(tags: DataFrame) -> DataFrame:
    return distinct_tags(tags).agg(
        F.count(F.lit(1)).alias("total_tags"), F.count_if(_is_semver(F.col("tag"))).alias("semver_tags")
    )


def latest_semver(tags: DataFrame) -> DataFrame:
    """Greatest version tag by its three numbers; equal versions go by tag name."""
    t = F.col("tag")
    numbers = [text.semver_number(t, i) for i in range(3)]
    rows = tags.where(_is_semver(t)).select("tag", F.struct(*[(-x).alias(f"n{i}") for i, x in enumerate(numbers)], t.alias("t")).alias("k"))
    return rows.agg(F.coalesce(F.min_by("tag", "k"), F.lit("")).alias("latest_semver"))


def classify_commits(commits: DataFrame) -> DataFrame:
    """Each distinct hash with its message type: a conventional type, ``ticket``, or null."""
    first = commits.groupBy("hash").agg(F.min(F.struct("repo_ord", "log_seq", "subject")).alias("c")).select("hash", "c.*")
    s = F.col("subject")
    kind = F.coalesce(
        F.nullif(text.capture(s, fixed.CONVENTIONAL), F.lit("")), F.when(text.matches(s, fixed.TICKET), "ticket")
    )
    return first.withColumn("commit_type", kind)


def commit_stats(classified: DataFrame) -> DataFrame:
    return classified.agg(F.count(F.lit(1)).alias("total"), F.count("commit_type").alias("typed"))


def commit_type_counts(classified: DataFrame) -> DataFrame:
    return classified.where("commit_type IS NOT NULL").groupBy("commit_type").agg(F.count(F.lit(1)).alias("commits"))


def nonstandard_samples(classified: DataFrame, n: int = 5) -> DataFrame:
    """First unclassified subjects in repository and log order."""
    return (
        classified.where("commit_type IS NULL")
        .select("repo_ord", "log_seq", "hash", "subject")
        .orderBy("repo_ord", "log_seq", "hash")
        .limit(n)
    )
