"""Bounded samples of labelled documents, to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.sources.store import settle


def in_fold(doc_id, parts: int, fold: int):
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == fold, F.lit(False))


def lowest(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the least values of the hash ``key``.

    Each task would send its best ``rows``; a bar on the hash, set from the row count, leaves about twice as many as
    are wanted in all, however many tasks there are. (Fewer than ``rows`` stay below it with a chance that is nil.)
    """
    place = F.pmod(key, F.lit(1 << 40))
    bar = min(1.0, (2.0 * rows + 100) / max(df.count(), 1))
    return df.withColumn("_place", place).where(F.col("_place") < int(bar * (1 << 40))).orderBy("_place").limit(rows).drop("_place")


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, fold: int, rows: int) -> DataFrame:
    """``text, label, half``: at most ``rows`` labelled documents outside the fold, by the order of a hash of their id.

    Written once, as it is read several times. The ids and labels that are sent to every task are at most
    ``rows``. Rows without id or label are left out; a document labelled twice counts as labelled 1 if
    either says so; documents that share an id all count. ``half`` (0 or 1) splits the sample for cross-fitting.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~in_fold(F.col("doc_id"), parts, fold))
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("_label"))
    picked = lowest(known, F.xxhash64(F.lit("sample"), "doc_id"), rows)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")
    return settle(found.select("text", F.col("_label").alias("label"), half.alias("half")), "labelled")
