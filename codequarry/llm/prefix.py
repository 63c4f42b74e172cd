"""Prefix sums over a global order, from per-partition totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.sources.store import settle


def prefix_sums(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Add for each name in ``values`` the sum of its expression over all rows before this one in ``order``.

    Rows are range-partitioned by the order and written with their partition's number, so that a key
    holding a third of the rows is split like any other stretch of the order. The totals of partitions
    (one row each, so at most as many as there are shuffle partitions) are summed in sequence and sent
    to every task; each partition then only needs a running sum of its own. Rows that tie in ``order``
    get their places in no fixed order: the order should name all columns that matter. Nulls in a
    value count as 0; an empty table gives an empty table.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    marks = [f"_v_{name}" for name in values]
    work = df.select("*", *[o.alias(k) for o, k in zip(order, keys, strict=True)])
    work = work.select("*", *[F.coalesce(v, F.lit(0)).cast("bigint").alias(m) for v, m in zip(values.values(), marks, strict=True)])
    placed = settle(work.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "prefix")
    totals = placed.groupBy("_part").agg(*[F.sum(m).alias(f"_before{m}") for m in marks])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", *[F.coalesce(F.sum(f"_before{m}").over(earlier), F.lit(0)).alias(f"_before{m}") for m in marks])
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_local{m}") for m in marks])
    out = local.join(F.broadcast(before), "_part")
    for name, m in zip(values, marks, strict=True):
        out = out.withColumn(name, F.col(f"_before{m}") + F.col(f"_local{m}"))
    return out.drop("_part", *keys, *marks, *[f"{p}{m}" for m in marks for p in ("_before", "_local")])
