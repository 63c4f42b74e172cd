"""Ordered computations over one key's rows, split where one key has too many of them.

``Window.partitionBy(key)`` puts a key's rows into one task. That is right while keys are bounded (a
source file rarely has more than some thousand lines) and all windows of a job then share one shuffle.
A file may also hold a large share of all rows; ``fit_chunks`` measures the longest one, and if it is
over the limit both helpers partition by (key, chunk of the order column) instead:

* ``running``: prefix aggregates. Each chunk is scanned on its own, one summary row per chunk is scanned
  over the key, and the carried value joins back.
* ``look_ahead``: bounded forward frames. The first ``reach`` rows of a chunk are repeated at the end of
  the previous one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.sources.store import settle

CHUNK_ROWS = 65_536
TASK_ROWS = 500_000
#: Cells of ``grid_join`` that a task works through, the most tasks of a join, and the packed rows of a cell's side.
TASK_CELLS, MOST_TASKS, PACKS = 4, 1 << 16, 4
AUTO = -1


def fit_chunks(df: DataFrame, order: str, chunk_rows: int | None = AUTO) -> int | None:
    """Resolve a chunk size: ``AUTO`` measures the largest ``order`` value (one narrow aggregate) and
    returns None, meaning plain windows, while it stays within ``CHUNK_ROWS``."""
    if chunk_rows != AUTO:
        return chunk_rows
    longest = df.agg(F.max(order)).first()[0]
    return None if longest is None or longest <= CHUNK_ROWS else CHUNK_ROWS


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` partitioned by ``keys`` into tasks of about ``TASK_ROWS`` of its ``rows``.

    Left to itself, Spark puts partitions together by their compressed bytes, and so many rows of code fit into those that
    a task's sorts and windows take gigabytes. Windows and groups by ``keys`` and more need no further shuffle.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def _fold(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    if kind == "min":
        return F.least(a, b)  # least / greatest skip nulls
    return F.greatest(a, b)


_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    aggs: dict[str, tuple[str, Column, bool]],
    chunk_rows: int | None = None,
    reverse: bool = False,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add prefix aggregates ``{name: (kind, expr, inclusive)}`` over ``keys`` in ``order``.

    ``kind`` is sum, min or max over scalar values; ``inclusive`` says whether the current row takes
    part. ``order`` is a non-negative integer column; ``tie`` breaks ties in it.
    """
    first = F.col(order).desc() if reverse else F.col(order).asc()
    if chunk_rows is None:
        whole = Window.partitionBy(*keys).orderBy(first, *tie)
        ends = {name: 0 if inclusive else -1 for name, (_, _, inclusive) in aggs.items()}
        columns = []
        for name, (kind, expr, _) in aggs.items():
            value = _AGG[kind](expr).over(whole.rowsBetween(Window.unboundedPreceding, ends[name]))
            columns.append((F.coalesce(value, F.lit(0)) if kind == "sum" else value).alias(name))
        return df.select("*", *columns)
    cid = "_chunk"
    chunk = F.floor(F.col(order) / chunk_rows).cast("bigint")
    work = df.withColumn(cid, -chunk if reverse else chunk)
    for name, (_, expr, _) in aggs.items():
        work = work.withColumn(f"_in_{name}", expr)
    group = [*keys, cid]
    work = settle(work, "chunks")  # read twice below

    local = Window.partitionBy(*group).orderBy(first, *tie)
    out = work
    for name, (kind, _, inclusive) in aggs.items():
        frame = local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        out = out.withColumn(f"_loc_{name}", _AGG[kind](f"_in_{name}").over(frame))

    summary = work.groupBy(*group).agg(*[_AGG[k](f"_in_{n}").alias(f"_in_{n}") for n, (k, _, _) in aggs.items()])
    before = Window.partitionBy(*keys).orderBy(cid).rowsBetween(Window.unboundedPreceding, -1)
    rank = Window.partitionBy(*keys).orderBy(cid)
    carry = summary.select(
        *group,
        F.row_number().over(rank).alias("_nth"),
        *[_AGG[k](f"_in_{n}").over(before).alias(f"_carry_{n}") for n, (k, _, _) in aggs.items()],
    ).where("_nth > 1")

    out = out.join(carry, group, "left")
    for name, (kind, _, _) in aggs.items():
        out = out.withColumn(name, _fold(kind, F.col(f"_carry_{name}"), F.col(f"_loc_{name}")))
    drop = [cid, "_nth"] + [f"_{p}_{n}" for n in aggs for p in ("in", "loc", "carry")]
    return out.drop(*drop)


def look_ahead(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    reach: int,
    build,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Apply ``build(df, window)`` with forward frames of at most ``reach`` in ``order``.

    ``window`` is partitioned and ordered; ``build`` adds ``rangeBetween`` frames, so rows that carry
    no information may be filtered out beforehand.
    """
    if chunk_rows is None:
        return build(df, Window.partitionBy(*keys).orderBy(order))
    if reach >= chunk_rows:
        raise ValueError("reach must be smaller than a chunk")
    home = F.floor(F.col(order) / chunk_rows).cast("bigint")
    seen = F.when((F.col(order) % chunk_rows < reach) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    work = df.withColumn("_home", home).withColumn("_chunk", F.explode(seen))
    window = Window.partitionBy(*keys, "_chunk").orderBy(order)
    return build(work, window).where("_chunk = _home")


def place_in_group(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Add the place (from 1) of each row in its group's order, for groups of any size.

    Rows are range-partitioned by group and order; a row's place is its place in its partition plus the rows of its group
    in earlier partitions. Only one row per partition and group goes through a window of the whole group. Rows that tie
    get their places in no fixed order.
    """
    placed = settle(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "places")
    count = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_before"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = count.select(group, "_part", F.coalesce(F.sum("_before").over(earlier), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order))
    out = placed.withColumn("_here", here).join(before, [group, "_part"])
    return out.withColumn(name, F.col("_before") + F.col("_here")).drop("_part", "_here", "_before")


def task_count(spark: SparkSession) -> int:
    """Partitions for few or small rows that become many or large ones: as a given number, Spark doesn't put them together."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def grid_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, cell_rows: int = 1024) -> DataFrame:
    """Inner join whose pairs per key may be many more than the rows; what it writes to disk is in proportion to the rows.

    Keys of up to ``cell_rows`` rows on both sides are joined as usual. Of larger ones the right rows are packed, some hundred to
    a row by a hash of their id, and both sides dealt over partitions by their ids. Every partition of one side then meets every
    one of the other (``shuffle_replicate_nl``): they are written once and read as often as needed, where rows repeated along a
    grid of cells would be written with the square of the key's rows. A task holds a partition of packed rows and streams the rest.
    The numbers of partitions are given, so that they aren't put together by the size of their (small) input.
    """
    keys, spark = list(keys), left.sparkSession
    n = F.count(F.lit(1))
    size = left.groupBy(*keys).agg(n.alias("_rows")).join(right.groupBy(*keys).agg(n.alias("_cols")), keys)
    wide = settle(size.where((F.col("_rows") > cell_rows) | (F.col("_cols") > cell_rows)), "wide-keys")
    pairs = wide.agg(F.sum(F.col("_rows").cast("double") * F.col("_cols"))).first()[0]
    parts = task_count(spark)

    def usual(side: DataFrame) -> DataFrame:
        return (side if pairs is None else side.join(wide.select(*keys), keys, "left_anti")).repartition(parts, *keys)

    found = usual(left).join(usual(right), keys)
    if pairs is None:
        return found
    tasks = min(max(parts, pairs / (TASK_CELLS * cell_rows**2)), MOST_TASKS)
    across = math.ceil(math.sqrt(tasks) / 2)  # fewer of the packed side, so the other, which is read once for each, is read less often
    own = [c for c in right.columns if c not in keys]
    block = F.pmod(F.xxhash64(right_id), F.ceil(F.col("_cols") / (cell_rows / PACKS))).alias("_block")
    packed = right.join(wide, keys).select(*keys, block, F.struct(*own).alias("_pack"))
    packed = packed.groupBy(*keys, "_block").agg(F.collect_list("_pack").alias("_pack")).repartition(across, *keys, "_block").drop("_block")
    rows = left.join(wide.select(*keys), keys, "left_semi").repartition(math.ceil(tasks / across), F.xxhash64(left_id))
    met = rows.join(packed.hint("shuffle_replicate_nl"), keys)
    return found.unionByName(met.select(*left.columns, F.inline("_pack")))
