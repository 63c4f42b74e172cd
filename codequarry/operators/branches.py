"""Branch metrics: inventory, stale branches, merges, reachability, rollback rate, peak day.

``branches``: repo, repo_ord, name, ts, tip (hash), and if it is known, place in the listing. ``commits`` as in ``history``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import fixed
from codequarry.operators.chains import ChainIndex, chain_index, merge_intervals, reached, within
from codequarry.sources.store import settle


def default_branch(branches: DataFrame) -> DataFrame:
    """``main``, else ``master``, else HEAD per repository, with its tip.

    HEAD is the row of that name or, as branch listings don't have one, the row marked ``is_head``.
    """
    head = F.col("name") == "HEAD"
    head = head | F.col("is_head") if "is_head" in branches.columns else head
    rank = F.when(F.col("name") == "main", 0).when(F.col("name") == "master", 1).when(head, 2)
    known = branches.withColumn("_r", rank)
    return known.groupBy("repo").agg(
        F.coalesce(F.min_by(F.when(F.col("_r") < 2, F.col("name")), "_r"), F.lit("HEAD")).alias("main_branch"),
        F.min_by("tip", "_r").alias("tip"),
    )


def branch_inventory(branches: DataFrame) -> DataFrame:
    """Branches once per name (first repository wins, in it the first by ``place``, else the newest) with their nesting depth."""
    order = F.struct("repo_ord", "place") if "place" in branches.columns else F.struct("repo_ord", -F.col("ts"))
    first = branches.groupBy("name").agg(F.min_by(F.struct("repo", "ts"), order).alias("b"))
    return first.select("name", "b.repo", "b.ts", F.size(F.split("name", "/")).alias("depth"))


def stale_branches(inventory: DataFrame, now: int, stale_days: int = 30, n: int = 20) -> DataFrame:
    """Longest inactive branches beyond the threshold (0 or less means 30 days)."""
    days = stale_days if stale_days > 0 else 30
    late = inventory.where(~F.col("name").isin(*fixed.NEVER_STALE) & (F.col("ts") > 0) & (F.col("ts") < now - days * 86_400))
    idle = F.floor((F.lit(now) - F.col("ts")) / 86_400).cast("bigint")
    return late.select("name", F.col("ts").alias("last_activity"), idle.alias("days_inactive")).orderBy(
        F.desc("days_inactive"), "name"
    ).limit(n)


def parent_edges(commits: DataFrame) -> DataFrame:
    """(repo, hash, parent, pos) with pos 0 for the first parent."""
    return commits.select("repo", "hash", F.posexplode("parents").alias("pos", "parent"))


def reachable_numbers(commits: DataFrame, tips: DataFrame, index: ChainIndex | None = None) -> DataFrame:
    """Numbers (repo, log_seq) of the commits reachable from ``tips`` (repo, hash), tips included.

    ``index``: ``chains.chain_index(commits)``, if it is at hand. Tips are written first: if they are few, commits aren't shuffled to find them.
    """
    index = index or chain_index(commits)
    ends = settle(tips.select("repo", "hash").distinct(), "tips")
    ends = settle(commits.join(ends, ["hash", "repo"]).select("repo", F.col("log_seq").alias("seq")), "tip-numbers")
    return within(reached(ends, index).withColumnRenamed("tail", "high"), index.places, "low", "high").select("repo", F.col("seq").alias("log_seq"))


def of_numbers(commits: DataFrame, numbers: DataFrame) -> DataFrame:
    """The commits of these numbers. What is needed of ``commits`` should be chosen before: the rest is shuffled with it."""
    return commits.join(numbers, ["log_seq", "repo"], "left_semi")


def reachable(commits: DataFrame, tips: DataFrame, index: ChainIndex | None = None) -> DataFrame:
    """Commits (repo, hash) reachable from ``tips`` (repo, hash), tips included."""
    return of_numbers(commits, reachable_numbers(commits, tips, index)).select("repo", "hash")


def main_numbers(commits: DataFrame, branches: DataFrame, index: ChainIndex | None = None) -> DataFrame:
    """Numbers (repo, log_seq) of the commits reachable from each repository's default branch."""
    tips = default_branch(branches).select("repo", F.col("tip").alias("hash"))
    return reachable_numbers(commits, tips, index)


def main_commits(commits: DataFrame, branches: DataFrame, index: ChainIndex | None = None) -> DataFrame:
    """Commits reachable from each repository's default branch."""
    return of_numbers(commits, main_numbers(commits, branches, index))


def main_commit_count(on_main: DataFrame) -> DataFrame:
    return on_main.agg(F.count(F.lit(1)).alias("main_commits"))


def newest_merges(on_main: DataFrame, n: int | None = None) -> DataFrame:
    """Merge commits, or the newest ``n`` of each repository: merge, merge_ts, first and second parent."""
    found = on_main.where(F.size("parents") >= 2)
    if n is not None:
        newest = Window.partitionBy("repo").orderBy("log_seq")
        found = found.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n)
    return found.where("ts > 0").select(
        "repo",
        F.col("hash").alias("merge"),
        F.col("ts").alias("merge_ts"),
        F.col("parents")[0].alias("first_parent"),
        F.col("parents")[1].alias("second_parent"),
    )


def merge_commit_ranges(commits: DataFrame, merges: DataFrame, index: ChainIndex | None = None) -> DataFrame:
    """Commits reachable from a merge's second parent but not from its first: (repo, merge, hash, ts).

    ``log_seq`` must list children before parents (a topological log). ``index``: ``chains.chain_index(commits)``.
    """
    index = index or chain_index(commits)
    return within(merge_intervals(merges, index), index.members, "low", "high").select("repo", "merge", "hash", "ts")


def branch_durations(ranges: DataFrame, merges: DataFrame) -> DataFrame:
    """Average branch lifetime and time to merge (days) and integration delay (hours); 0 without any."""
    ends = ranges.where("ts > 0").groupBy("repo", "merge").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    rows = ends.join(merges.select("repo", "merge", "merge_ts"), ["repo", "merge"])
    life = (F.col("hi") - F.col("lo")) / 86_400
    merge = (F.col("merge_ts") - F.col("lo")) / 86_400
    delay = (F.col("merge_ts") - F.col("hi")) / 3_600

    def mean(v, below):
        return F.coalesce(F.avg(F.when((v >= 0) & (v < below), v)), F.lit(0.0))

    return rows.agg(
        mean(life, 365).alias("avg_lifetime_days"),
        mean(merge, 730).alias("avg_merge_days"),
        mean(delay, 8_760).alias("avg_delay_hours"),
    )


def rollback_rate(commits: DataFrame, main: DataFrame) -> DataFrame:
    """Main commits whose message speaks of a revert or rollback, and their share in percent.

    ``main``: ``main_numbers`` of all ``commits``. Messages are read where they lie; what is shuffled are numbers of those that say so.
    """
    low = F.lower(F.col("message"))
    said = commits.where(low.contains("revert") | low.contains("rollback")).select("repo", "log_seq")
    hits = of_numbers(said, main).agg(F.count(F.lit(1)).alias("rollbacks"))
    counts = hits.crossJoin(main.agg(F.count(F.lit(1)).alias("main_commits")))
    rate = F.when(F.col("main_commits") > 0, F.round(F.col("rollbacks") * 100.0 / F.col("main_commits"), 1))
    return counts.withColumn("rollback_pct", rate)


def peak_commit_day(commits: DataFrame) -> DataFrame:
    """UTC weekday with most commits; equal counts go Sunday first. One aggregate, combined before its shuffle."""
    day = F.pmod(F.floor(F.col("ts") / 86_400) + 4, F.lit(7)).cast("int")
    counts = commits.where("ts > 0").groupBy(day.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(w) for w in fixed.WEEKDAYS])
    best = counts.agg(F.min(F.struct(-F.col("n"), F.col("d"))).alias("b"))
    return best.select(F.get(names, F.col("b.d")).alias("peak_day"), F.abs(F.col("b")["col1"]).alias("commits"))
