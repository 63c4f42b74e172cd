"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Targets: sources in code-point order, null last, get the weights 5, 2, 1 in turn and share all tokens by
weight; no target passes three times its source's tokens, the excess going to the others by weight.

The mix consists of blocks of ``block_words`` tokens. They are given to sources by highest quotients
target / (2k - 1), in that order; the sequence of blocks is cut into ``shards`` runs of equal length, so
that every shard has an integer quota for each source and follows the targets by itself. A source that has all blocks it
can fill gets the rest of its target as a short block after the last shard, so that sources of a few words are mixed too. A source's
documents, in a seeded order, form an endless stream of tokens; the source's blocks are cut from it in
turn, from a seeded start, so that a document is repeated only after all others of its source.

All of it is DataFrame code. The apportionment handles the table of sources (one row each); documents are
ordered by global prefix sums, so a source with a third of all rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.prefix import prefix_sums
from codequarry.sources.store import settle

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 16
SHARDS = 8
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def seeded(column: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size`` to those plus ``nth`` (from 0), ``weight`` and ``target``.

    The sources whose target is cut are those with the smallest size to weight ratios. In that order, the
    first source that can take its share of what the cut ones leave over fixes the share for all after it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "nth")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("nth", F.row_number().over(by_name) - 1)
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", choice).withColumn("most", F.col("source_size") * most)
    ranked = ranked.withColumn("ratio", F.col("most").cast("double") / F.col("weight"))
    everything = Window.partitionBy()
    filled = ranked.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))).alias("_left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_weights"),
        F.row_number().over(by_ratio).alias("_place"),
    ).withColumn("_share", F.col("_left").cast("double") / F.col("_weights"))
    fits = F.when(F.col("_share") <= F.col("ratio"), F.struct("_place", "_share"))
    filled = filled.withColumn("_share", F.min(fits).over(everything)["_share"])
    target = F.least(F.col("most").cast("double"), F.col("_share") * F.col("weight"))
    return filled.select("source", "source_size", "nth", "weight", target.alias("target"))


def apportion(sources: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, most: int = MOST) -> DataFrame:
    """``nth, source_size, target`` to ``nth, shard, quota``: blocks by highest quotients, ties to the earlier source.

    Giving out all blocks one by one would need a row for each. Rounding target / block size gives all but
    at most two per source of them; only the seats next to that rounding are ranked. A source can't have
    more whole blocks than ``most`` times its tokens.
    """
    everything = Window.partitionBy()
    base = sources.select("nth", "target", F.floor(F.col("source_size") * most / block_words).alias("_fit"))
    base = base.withColumn("_all", F.sum("target").over(everything)).withColumn("_n", F.count(F.lit(1)).over(everything))
    blocks = F.floor(F.col("_all") / block_words + 0.5)
    base = base.where("_all > 0").withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    base = base.withColumn("_house", F.floor(blocks * F.col("shard") / shards))
    first = F.least(F.col("_fit"), F.floor(F.col("target") / F.col("_all") * F.col("_house") + 0.5))
    base = base.withColumn("_seats", first)
    base = base.withColumn("_more", F.col("_house") - F.sum("_seats").over(Window.partitionBy("shard")))
    reach = F.ceil(F.col("target") / F.col("_all") * F.col("_n") * 4).cast("int") + 3
    up = F.sequence(F.col("_seats") + 1, F.col("_seats") + reach)
    down = F.sequence(F.greatest(F.col("_seats") - reach + 1, F.lit(1)), F.col("_seats"))
    near = F.when(F.col("_more") > 0, up).when((F.col("_more") < 0) & (F.col("_seats") > 0), down)
    seats = base.select("nth", "target", "shard", "_more", "_fit", F.explode(near).alias("_k")).where("_k <= _fit")
    quotient = F.col("target") / (F.col("_k") * 2 - 1)
    rising = Window.partitionBy("shard").orderBy(quotient.desc(), F.col("nth"), F.col("_k"))
    falling = Window.partitionBy("shard").orderBy(quotient.asc(), F.col("nth").desc(), F.col("_k").desc())
    change = F.when((F.col("_more") > 0) & (F.col("_up") <= F.col("_more")), 1).when((F.col("_more") < 0) & (F.col("_down") <= -F.col("_more")), -1)
    moved = seats.withColumn("_up", F.row_number().over(rising)).withColumn("_down", F.row_number().over(falling))
    moved = moved.groupBy("nth", "shard").agg(F.sum(change).alias("_change"))
    total = base.join(moved, ["nth", "shard"], "left").withColumn("_total", F.col("_seats") + F.coalesce("_change", F.lit(0)))
    earlier = F.lag("_total", 1, 0).over(Window.partitionBy("nth").orderBy("shard"))
    return total.select("nth", "shard", (F.col("_total") - earlier).alias("quota"))


def _plan(docs: DataFrame, block_words: int, shards: int, seed: str) -> DataFrame:
    """One row per document: its size, its place in its source's stream and what the mix takes of that stream."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"))
    rows = settle(rows, "mix-sizes")
    sources = settle(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-sources")
    quotas = apportion(sources, block_words, shards).groupBy("nth").agg(F.sum("quota").alias("_blocks"))
    # a source with all blocks that it can fill gets what is left of its target as a short last block
    full = F.col("_blocks") >= F.floor(F.col("source_size") * MOST / block_words)
    blocks = F.coalesce("_blocks", F.lit(0)) * block_words
    words = F.when(full, F.greatest(blocks, F.floor(F.col("target")).cast("bigint"))).otherwise(blocks)
    start = F.coalesce(F.sum("source_size").over(Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turn = F.conv(F.substring(seeded(F.col("source"), seed), 1, 8), 16, 10).cast("bigint")
    sources = sources.join(quotas, "nth", "left").select(
        "*",
        words.alias("_words"),
        start.alias("_start"),
        F.when(F.col("source_size") > 0, turn % F.col("source_size")).otherwise(0).alias("_turn"),
    )
    sources = settle(sources.withColumnRenamed("source", "_source"), "mix-quotas")
    placed = rows.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = [F.col("nth"), seeded(F.col("doc_id"), seed), F.col("doc_id"), F.col("size"), F.col("_text")]
    placed = prefix_sums(placed, order, {"_at": F.col("size")})
    return placed.withColumn("_at", F.col("_at") - F.col("_start"))


def _rounds() -> tuple[Column, Column]:
    """Whole turns of a source's stream that the mix takes, and the words beyond them."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("_words") / F.col("source_size"))).otherwise(0)
    return whole, F.col("_words") - whole * F.col("source_size")


def mix_words(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``doc_id, source, text`` to ``doc_id, size, source_size, target, taken``, one row per input row.

    ``taken`` counts the words that the mix takes from the document, repeats included; it never exceeds
    three times the size, and a source's sum is its quota of blocks (and its short block). Null or empty texts have size 0 and
    nothing taken; a null source is a source of its own, the last; an empty table gives an empty one.
    Repeated rows are separate documents. The same table and seed give the same rows.
    """
    rows = _plan(docs, block_words, shards, seed)
    whole, rest = _rounds()
    end = F.col("_at") + F.col("size")
    until = F.col("_turn") + rest
    straight = F.greatest(F.lit(0), F.least(end, until) - F.greatest(F.col("_at"), F.col("_turn")))
    wrapped = F.greatest(F.lit(0), F.least(end, until - F.col("source_size")) - F.col("_at"))
    taken = (whole * F.col("size") + straight + wrapped).cast("bigint")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Whole documents for the mix: all columns of ``docs``, a row for each time that a block of its source begins its text.

    A document is taken each time that its first word is among its source's taken words, so a source comes
    within two documents of its quota. Documents without words add nothing to a mix and are not taken.
    Repeated rows (same doc_id and text) are taken equally often, as often as the first of them.
    """
    rows = _plan(docs, block_words, shards, seed)
    whole, rest = _rounds()
    into = F.pmod(F.col("_at") - F.col("_turn"), F.greatest(F.col("source_size"), F.lit(1)))
    times = F.when(F.col("size") > 0, whole + (into < rest).cast("bigint")).otherwise(0)
    times = rows.select("doc_id", "_text", "_at", "source", times.alias("_times"))
    # settled, as the same rows must be seen by all tasks; one row per document and text
    times = times.groupBy("doc_id", "source", "_text").agg(F.min_by("_times", "_at").alias("_times")).where("_times > 0")
    keyed = docs.select(F.struct("*").alias("_row"))
    same = [F.col("_row.doc_id").eqNullSafe(F.col("doc_id")), F.col("_row.source").eqNullSafe(F.col("source")), F.xxhash64("_row.text") == F.col("_text")]
    taken = keyed.join(times, same[0] & same[1] & same[2])
    copies = taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy"))
    return copies.select("_row.*")


def query(spark, folder: str) -> DataFrame:
    return mix_words(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text"))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
summed AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM summed),
weighed AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][(nth % {len(WEIGHTS)} + 1)::INT] AS weight, source_size * {MOST} AS most FROM ranked),
filled AS (
  SELECT *, most::DOUBLE / weight AS ratio,
    ROW_NUMBER() OVER (ORDER BY most::DOUBLE / weight, nth) AS place,
    ((SELECT SUM(source_size) FROM weighed)
      - COALESCE(SUM(most) OVER (ORDER BY most::DOUBLE / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / ((SELECT SUM(weight) FROM weighed)
      - COALESCE(SUM(weight) OVER (ORDER BY most::DOUBLE / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share
  FROM weighed),
aimed AS (
  SELECT source, source_size, nth,
    LEAST(most::DOUBLE, (SELECT MIN_BY(share, place) FROM filled WHERE share <= ratio) * weight) AS target
  FROM filled),
houses AS (SELECT floor(floor((SELECT SUM(target) FROM aimed) / {BLOCK_WORDS} + 0.5) * s / {SHARDS}) AS house, s FROM range(1, {SHARDS} + 1) r(s)),
whole AS (
  SELECT nth, source_size, target, house,
    LEAST(floor(source_size * {MOST} / {BLOCK_WORDS}::DOUBLE), floor(target / (SELECT SUM(target) FROM aimed) * house + 0.5)) AS seats,
    floor(source_size * {MOST} / {BLOCK_WORDS}::DOUBLE) AS fit
  FROM aimed, houses WHERE s = {SHARDS}),
short AS (SELECT MAX(house) - SUM(seats) AS more FROM whole),
raised AS (
  SELECT nth, k, ROW_NUMBER() OVER (ORDER BY target / (2 * k - 1) DESC, nth, k) AS place
  FROM (SELECT nth, target, fit, unnest(range(seats::BIGINT + 1, seats::BIGINT + 400)) AS k FROM whole) WHERE k <= fit),
lowered AS (
  SELECT nth, k, ROW_NUMBER() OVER (ORDER BY target / (2 * k - 1), nth DESC, k DESC) AS place
  FROM (SELECT nth, target, unnest(range(GREATEST(seats::BIGINT - 400, 1), seats::BIGINT + 1)) AS k FROM whole)),
quotas AS (
  SELECT w.nth, w.fit, w.seats
    + (SELECT COUNT(*) FROM raised r WHERE r.nth = w.nth AND r.place <= (SELECT more FROM short))
    - (SELECT COUNT(*) FROM lowered l WHERE l.nth = w.nth AND l.place <= -(SELECT more FROM short)) AS blocks
  FROM whole w),
streams AS (
  SELECT a.*, CASE WHEN q.blocks >= q.fit THEN GREATEST(q.blocks::BIGINT * {BLOCK_WORDS}, floor(a.target)::BIGINT) ELSE COALESCE(q.blocks, 0)::BIGINT * {BLOCK_WORDS} END AS words,
    CASE WHEN source_size > 0 THEN ('0x' || substr(md5('{SEED}:' || COALESCE(source, '')), 1, 8))::BIGINT % source_size ELSE 0 END AS turn
  FROM aimed a LEFT JOIN quotas q ON q.nth = a.nth),
placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.turn,
    CASE WHEN s.source_size > 0 THEN s.words // s.source_size ELSE 0 END AS rounds, s.words,
    (SUM(d.size) OVER (PARTITION BY s.nth ORDER BY md5('{SEED}:' || COALESCE(d.doc_id::VARCHAR, '')), d.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - d.size AS pos
  FROM sized d JOIN streams s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
  (rounds * size
    + GREATEST(0, LEAST(pos + size, turn + words - rounds * source_size) - GREATEST(pos, turn))
    + GREATEST(0, LEAST(pos + size, turn + words - rounds * source_size - source_size) - pos))::BIGINT AS taken
FROM placed
"""
