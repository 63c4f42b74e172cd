"""A commit graph as chains: reachability by intervals instead of walks over single commits.

First parents form a forest. A chain is a path in it: a commit belongs to the chain of the newest commit from which
first parents lead to it. ``log_seq`` lists children before parents, so along a chain it only grows, and it serves
as a commit's generation number: if any commit of a chain is reached, so are all later ones of that chain. What is
reachable from somewhere is therefore one number per chain, the least ``log_seq`` reached, and the parents that lie
in other chains (``links``) are the only steps to follow.

Tables: ``edges`` (repo, seq, nth, up, chain, to_chain), a commit's parents by number; ``tails`` (repo, chain, tail), with a chain
named by its least seq, ``tail`` being the largest; ``links`` (repo, chain, seq, to_chain, to_seq, to_tail); ``members`` (repo,
hash, ts, seq, chain). ``seq`` is a commit's ``log_seq``, unique in its repository. Hashes are looked up once, for ``edges``. Look-ups
join by a number first: rows are sorted by the first column's prefix, and those of one repository have the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.sources.store import settle

BLOCK_ROWS = 65_536
BUCKET = 1024
FIRST_SPAN, SPAN_GROWTH = 4096, 8


class ChainIndex(NamedTuple):
    """``members`` is read for merges only; a plan that nobody wrote will do for what else is reached."""

    edges: DataFrame
    tails: DataFrame
    links: DataFrame
    members: DataFrame

    @property
    def places(self) -> DataFrame:
        return places(self.edges)


def _roots(up: np.ndarray) -> np.ndarray:
    """Where each place ends if ``up`` is followed; places that point to themselves are ends."""
    while True:
        further = up[up]
        if (further == up).all():
            return up
        up = further


class _Block:
    """Edges of a block in (repo, seq, nth) order and its commits, one for each edge of ``nth`` 0."""

    def __init__(self, rows: pd.DataFrame):
        code, self.repos = pd.factorize(rows["repo"])
        order = np.lexsort((rows["nth"].to_numpy(), rows["seq"].to_numpy(), code))
        self.rows = rows.take(order).reset_index(drop=True)
        code = code[order]
        first = self.rows["nth"].to_numpy() == 0
        self.commit = np.cumsum(first) - 1  # of each edge
        self.seq = self.rows["seq"].to_numpy()[first]
        self._numbers = np.unique(self.seq)
        self._keys = code[first] * len(self._numbers) + np.searchsorted(self._numbers, self.seq)
        self.target = self.find(code, self.rows["up"].to_numpy())  # of each edge
        own = np.arange(len(self.seq))
        self.up = np.where(self.target[first] < 0, own, self.target[first])  # a commit whose first parent isn't here points to itself

    def find(self, code: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Places of the commits (repo by its code, seq), -1 for those of other blocks."""
        number = np.minimum(np.searchsorted(self._numbers, seq), len(self._numbers) - 1)
        key = code * len(self._numbers) + number
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._numbers[number] == seq) & (self._keys[at] == key), at, -1)


def _block_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a partition, each with the number at which first parents leave it and the least that leaves there."""
    found = [rows for rows in batches if len(rows)]
    if not found:
        return
    block = _Block(pd.concat(found, ignore_index=True))
    end = _roots(block.up)
    least = block.seq.copy()
    np.minimum.at(least, end, block.seq)  # of all that end alike
    yield block.rows.assign(end=block.seq[end][block.commit], least=least[end][block.commit])


def _local_chains(rows: pd.DataFrame, coming: pd.DataFrame) -> pd.DataFrame:
    """The least number that flows down first parents to each commit, from itself, the block's and what comes in.

    Each edge gets its commit's and, if it's in the block, its parent's.
    """
    block = _Block(rows)
    up, least = block.up, block.seq.copy()
    if len(coming):
        np.minimum.at(least, block.find(block.repos.get_indexer(coming["repo"]), coming["seq"].to_numpy()), coming["coming"].to_numpy())
    while True:
        moving = up != np.arange(len(up))
        np.minimum.at(least, up[moving], least[moving].copy())
        further = up[up]
        if (further == up).all():
            break
        up = further
    to = pd.arrays.IntegerArray(least[block.target], block.target < 0)
    return block.rows[["repo", "seq", "nth", "up"]].assign(chain=least[block.commit], to_chain=to)


def parent_numbers(commits: DataFrame) -> DataFrame:
    """``repo, seq, nth, up``: the known parents of each commit by number, from ``nth`` 0; a commit without a first points to itself there."""
    known = commits.select(F.xxhash64("repo", "hash").alias("_at"), "repo", "hash", F.col("log_seq").alias("up"))
    wanted = commits.select("repo", F.col("log_seq").alias("seq"), F.posexplode_outer("parents").alias("nth", "hash"))
    at = F.xxhash64("repo", F.coalesce("hash", F.col("seq").cast("string")))  # those without parents are spread, too
    found = wanted.withColumn("_at", at).join(known, ["_at", "repo", "hash"], "left")
    nth = F.coalesce("nth", F.lit(0))
    return found.where((nth == 0) | F.col("up").isNotNull()).select("repo", "seq", nth.alias("nth"), F.coalesce("up", "seq").alias("up"))


def chain_edges(commits: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``repo, seq, nth, up, chain, to_chain`` of all commits' parents; ``to_chain`` is null if the parent is in another block.

    Edges are range-partitioned by (repo, log_seq) into blocks of about ``block_rows`` commits. In each block, first parents are
    followed at once; what leaves a block is one row per line of development that crosses its border. The least number
    of each line is passed on over these few rows, by joining them with themselves a number of times that is the logarithm of
    the number of blocks, and a second pass in the blocks gives every commit its chain. The few rows are written before they
    are joined to all commits, so that Spark knows their size.
    """
    blocks = max(1, -(-commits.count() // block_rows))
    numbered = settle(parent_numbers(commits), "chain-parents")
    placed = numbered.repartitionByRange(blocks, "repo", "seq").withColumn("part", F.spark_partition_id())
    ends = settle(placed.mapInPandas(_block_ends, "repo string, seq long, nth int, up long, part int, end long, least long"), "chain-ends")
    leaving = settle(ends.where("nth = 0 AND seq = end AND up <> seq").select("repo", "seq", "up", "least"), "chain-leaving")
    above = ends.where("nth = 0").select("repo", F.col("seq").alias("up"), F.col("end").alias("next"), F.col("part").alias("up_part"))
    lines = settle(leaving.join(above, ["up", "repo"]).select("repo", "seq", "up", "up_part", "next", "least"), "chain-lines")
    step = lines.select("repo", "seq", "next", "least")
    while not step.where("next is not null").isEmpty():
        given = step.where("next is not null").groupBy("repo", F.col("next").alias("seq")).agg(F.min("least").alias("given"))
        further = step.select("repo", F.col("seq").alias("next"), F.col("next").alias("after"))
        grown = step.join(given, ["seq", "repo"], "left").join(further, ["next", "repo"], "left")
        step = settle(grown.select("repo", "seq", F.col("after").alias("next"), F.least("least", "given").alias("least")), "chain-step")
    coming = lines.select("repo", "seq", "up", "up_part").join(step.select("repo", "seq", "least"), ["seq", "repo"])
    coming = coming.groupBy(F.col("up_part").alias("part"), "repo", F.col("up").alias("seq")).agg(F.min("least").alias("coming"))
    both = ends.select("part", "repo", "seq", "nth", "up").groupBy("part").cogroup(coming.groupBy("part"))
    return both.applyInPandas(_local_chains, "repo string, seq long, nth int, up long, chain long, to_chain long")


def places(edges: DataFrame) -> DataFrame:
    """``repo, seq, chain`` of all commits."""
    return edges.where("nth = 0").select("repo", "seq", "chain")


def chain_tails(edges: DataFrame) -> DataFrame:
    return places(edges).groupBy("repo", "chain").agg(F.max("seq").alias("tail"))


def chain_links(edges: DataFrame, tails: DataFrame) -> DataFrame:
    """Parents that lie in another chain than their child: ``repo, chain, seq, to_chain, to_seq, to_tail``."""
    known = edges.select("repo", "chain", "seq", F.col("up").alias("to_seq"), "to_chain")
    far = settle(known.where("to_chain IS NULL").drop("to_chain"), "chain-far")
    to = places(edges).select("repo", F.col("seq").alias("to_seq"), F.col("chain").alias("to_chain"))
    links = known.unionByName(far.join(to, ["to_seq", "repo"])).where("chain <> to_chain")
    ends = tails.select("repo", F.col("chain").alias("to_chain"), F.col("tail").alias("to_tail"))
    return links.join(ends, ["to_chain", "repo"]).select("repo", "chain", "seq", "to_chain", "to_seq", "to_tail")


def named(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo, hash, ts, seq, chain`` of all commits."""
    return commits.select("repo", "hash", "ts", F.col("log_seq").alias("seq")).join(places(edges), ["seq", "repo"]).select("repo", "hash", "ts", "seq", "chain")


def chain_members(commits: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``repo, hash, ts, seq, chain, tail`` of all commits."""
    edges = settle(chain_edges(commits, block_rows), "chain-edges")
    return named(commits, edges).join(chain_tails(edges), ["chain", "repo"]).select("repo", "hash", "ts", "seq", "chain", "tail")


def chain_index(commits: DataFrame, block_rows: int = BLOCK_ROWS) -> ChainIndex:
    edges = settle(chain_edges(commits, block_rows), "chain-edges")
    tails = settle(chain_tails(edges), "chain-tails")
    return ChainIndex(edges, tails, settle(chain_links(edges, tails), "chain-links"), named(commits, edges))


def within(intervals: DataFrame, rows: DataFrame, low: str, high: str) -> DataFrame:
    """Rows (repo, chain, seq, ...) joined to the intervals (repo, chain, ``low``, ``high``) that hold their seq.

    An equality join by stretches of ``BUCKET`` numbers, so that a long interval of a long chain is spread over tasks.
    """
    stretch = F.explode(F.sequence(F.floor(F.col(low) / BUCKET), F.floor(F.col(high) / BUCKET)))
    wanted = intervals.where(F.col(low) <= F.col(high)).withColumn("_stretch", stretch)
    kept = rows.withColumn("_stretch", F.floor(F.col("seq") / BUCKET))
    return wanted.join(kept, ["repo", "chain", "_stretch"]).where(F.col("seq").between(F.col(low), F.col(high))).drop("_stretch")


def reached(tips: DataFrame, index: ChainIndex) -> DataFrame:
    """What is reachable from ``tips`` (repo, seq), tips included: ``repo, chain, low, tail``, one row per chain.

    A round follows the links of what the round before reached anew; their number is that of changes between chains.
    """
    coming = index.places.join(tips.select("repo", "seq"), ["seq", "repo"]).groupBy("repo", "chain").agg(F.min("seq").alias("coming"))
    coming = coming.join(index.tails.withColumnRenamed("tail", "tail_"), ["chain", "repo"])
    state = None
    while True:
        if state is None:
            both = coming.select("*", F.lit(None).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("tail"))
        else:
            both = state.select("repo", "chain", "low", "tail").join(coming, ["chain", "repo"], "full")
        low, tail = F.least("low", "coming"), F.coalesce("tail", "tail_")
        fresh = F.coalesce(F.col("coming") < F.col("low"), F.col("low").isNull())
        last = F.when(fresh, F.coalesce(F.col("low") - 1, tail))
        state = settle(both.select("repo", "chain", low.alias("low"), tail.alias("tail"), last.alias("last")), "chain-reach")
        if state.where("last is not null").isEmpty():
            return state.select("repo", "chain", "low", "tail")
        steps = within(state.where("last is not null").select("repo", "chain", "low", "last"), index.links, "low", "last")
        coming = steps.groupBy("repo", F.col("to_chain").alias("chain")).agg(F.min("to_seq").alias("coming"), F.first("to_tail").alias("tail_"))


#: A merge in the walk: its place in the log, a number, as rows are shuffled, sorted and written by it in every round.
_KEYS = ["repo", "start"]


def _advance(both: DataFrame) -> DataFrame:
    """One round's bookkeeping of ``merge_intervals``: what to follow next, by merge and chain."""
    per = Window.partitionBy(*_KEYS)
    top = F.lit(np.iinfo(np.int64).max)

    def stretch(first: Column, last: Column, when: Column):
        good = when & (first <= last)
        return F.when(good, first), F.when(good, last)

    rows = both.select(
        *_KEYS, "chain", F.coalesce("tail", "tail_").alias("tail"), "old", "side", "old_", "side_",
        F.max("horizon").over(per).alias("horizon"),
    )
    low_old, low_side = F.least("old", "old_"), F.least("side", "side_")
    rows = rows.withColumn("now_old", low_old).withColumn("now_side", low_side)
    bar = F.coalesce(F.col("now_old") - 1, top)
    a, b = stretch(F.col("old_"), F.least(F.coalesce(F.col("old") - 1, top), "tail", "horizon"), F.coalesce(F.col("old_") < F.col("old"), F.col("old_").isNotNull()))
    c, d = stretch(F.col("side_"), F.least(F.coalesce(F.col("side") - 1, top), "tail", "horizon", bar), F.coalesce(F.col("side_") < F.col("side"), F.col("side_").isNotNull()))
    rows = rows.select("*", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), F.least("tail", bar).alias("end"))
    rows = rows.withColumn("busy", F.max(F.col("a").isNotNull() | F.col("c").isNotNull()).over(per))
    rows = rows.withColumn("open", F.max(F.when(F.col("now_side") <= F.col("end"), F.col("end"))).over(per))
    rows = rows.withColumn("finished", ~F.col("busy") & (F.coalesce("open", F.lit(-1)) <= F.col("horizon")))
    span = F.greatest((F.col("horizon") - F.col("start")) * SPAN_GROWTH, F.lit(FIRST_SPAN))
    rows = rows.withColumn("then", F.when(F.col("busy") | F.col("finished"), F.col("horizon")).otherwise(F.least("open", F.col("start") + span)))
    grow = F.col("then") > F.col("horizon")
    e, f = stretch(F.greatest("now_old", F.col("horizon") + 1), F.least("tail", "then"), grow & F.col("now_old").isNotNull())
    g, h = stretch(F.greatest("now_side", F.col("horizon") + 1), F.least("end", "then"), grow & F.col("now_side").isNotNull())
    return rows.select(
        *_KEYS, "chain", "tail", F.col("now_old").alias("old"), F.col("now_side").alias("side"), F.col("then").alias("horizon"), "end", "finished",
        F.when(grow, e).otherwise(F.col("a")).alias("a"), F.when(grow, f).otherwise(F.col("b")).alias("b"),
        F.when(grow, g).otherwise(F.col("c")).alias("c"), F.when(grow, h).otherwise(F.col("d")).alias("d"),
    )


def merge_intervals(merges: DataFrame, index: ChainIndex) -> DataFrame:
    """What each merge's second parent reaches and its first doesn't: ``repo, merge, chain, low, high``.

    Both parents' reach is extended together, for all merges at once, in one row per merge and chain. Links are
    followed up to a horizon in the log that starts at the merge. Up to there, a chain's old numbers (reached
    from the first parent) and side numbers (from the second) are final, as paths only go forward in the log. If side
    commits that aren't old remain behind the horizon, it moves, by growing steps, at most to the last of them. So the walk ends
    near the merge's base, and a round passes whole stretches of chains, however many commits they have.
    """
    start = merges.join(index.members.select("repo", F.col("hash").alias("merge"), F.col("seq").alias("start")), ["merge", "repo"])
    ends = F.explode(F.array(F.struct(F.col("first_parent").alias("hash"), F.lit(True).alias("is_old")), F.struct(F.col("second_parent").alias("hash"), F.lit(False).alias("is_old"))))
    found = start.select(*_KEYS, ends.alias("e")).select(*_KEYS, "e.*").join(index.members.drop("ts"), ["hash", "repo"]).join(index.tails, ["chain", "repo"])

    def least(df: DataFrame, seq: str, tail: str) -> DataFrame:
        is_old = F.col("is_old")
        return df.groupBy(*_KEYS, "chain").agg(
            F.min(F.when(is_old, F.col(seq))).alias("old_"), F.min(F.when(~is_old, F.col(seq))).alias("side_"), F.first(tail).alias("tail_")
        )

    null = F.lit(None).cast("bigint")
    fresh = least(found, "seq", "tail")
    both = fresh.select("*", F.col("start").alias("horizon"), null.alias("tail"), null.alias("old"), null.alias("side"))
    parts: list[DataFrame] = []
    while True:
        state = settle(_advance(both), "merge-walk")
        done = state.where("finished AND side IS NOT NULL AND side <= end")
        parts.append(done.select(*_KEYS, "chain", F.col("side").alias("low"), F.col("end").alias("high")))
        left = state.where("NOT finished")
        if left.isEmpty():
            break
        todo = F.explode(F.array(F.struct(F.lit(True).alias("is_old"), F.col("a").alias("low"), F.col("b").alias("high")), F.struct(F.lit(False).alias("is_old"), F.col("c").alias("low"), F.col("d").alias("high"))))
        todo = left.select(*_KEYS, "chain", todo.alias("e")).select(*_KEYS, "chain", "e.*").where("low is not null")
        steps = within(todo, index.links, "low", "high").select(*_KEYS, "is_old", F.col("to_chain").alias("chain"), "to_seq", "to_tail")
        kept = left.select(*_KEYS, "chain", "tail", "old", "side", "horizon")
        both = kept.join(least(steps, "to_seq", "to_tail"), [*_KEYS, "chain"], "full")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(start.select(*_KEYS, "merge").distinct(), _KEYS).select("repo", "merge", "chain", "low", "high")
