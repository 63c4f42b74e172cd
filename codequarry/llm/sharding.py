"""Sharding by global byte-size prefix sums.

Rows are put into one order, equal texts next to each other. Totals of partitions give every row the bytes
before it, and the order is cut where these pass equal targets, so shards are contiguous and near equal.

Equal texts stay together where that leaves the sizes near equal. A text that repeats so often that it would
move a cut by more than ``SLACK`` of a shard is placed first: whole, into the shard with the least bytes, if it
fits there, else cut like single rows. There are at most 2 * shards / SLACK such texts, as each has that part
of all bytes or of all rows; so they may pass through the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.prefix import prefix_sums
from codequarry.sources.store import settle

SHARDS = 16
SLACK = 0.02


def _place(heavy: list, total: int, shards: int) -> tuple[dict[str, int], list[float]]:
    """Shards of the texts that are placed whole, and the room that is left in each shard. The largest go first."""
    load = [(0, s) for s in range(shards)]
    home: dict[str, int] = {}
    for row in sorted(heavy, key=lambda r: (-r["_bytes"], r["_text"])):
        used, shard = load[0]
        if used + row["_bytes"] <= total / shards:
            home[row["_text"]] = shard
            heapq.heapreplace(load, (used + row["_bytes"], shard))
    room = [0.0] * shards
    for used, shard in load:
        room[shard] = total / shards - used
    return home, room


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """``doc_id, text`` to ``doc_id, size, text_crc32, shard, slot``, one row per input row.

    ``size`` is the text's UTF-8 bytes plus 1; null and empty texts have size 1 and CRC 0 and count as the
    same text. ``slot`` counts from 0 within the shard without gaps. Repeated rows are separate rows with
    slots of their own (which of them has which is open, as they are alike). An empty table gives none.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("_text"))
    base = settle(base, "shard-sizes")
    groups = base.groupBy("_text").agg(F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_bytes"))
    rows, total = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    part = slack / shards
    heavy = groups.where((F.col("_rows") > 1) & ((F.col("_bytes") > part * total) | (F.col("_rows") > part * rows))).collect()
    home, room = _place(heavy, total, shards)
    ends = [sum(room[: s + 1]) for s in range(shards)]

    marks = base.sparkSession.createDataFrame([(r["_text"], home.get(r["_text"], -1)) for r in heavy], "_text string, _home int")
    marked = base.join(F.broadcast(marks), "_text", "left")
    whole = marked.where("_home >= 0").withColumn("shard", F.col("_home"))
    # rows of texts that are cut are ordered one by one, those of other texts as one stretch
    loose = marked.where("_home is null or _home < 0").withColumn("_alone", F.when(F.col("_home") < 0, F.col("doc_id")))
    cut = prefix_sums(loose, [F.col("_text"), F.col("_alone")], {"_at": F.col("size")})
    stretch = cut.where("_home is null").groupBy("_text").agg(F.min("_at").alias("_first"), F.sum("size").alias("_bytes"))
    cut = cut.join(stretch, "_text", "left")
    middle = F.coalesce(F.col("_first"), F.col("_at")) + F.coalesce(F.col("_bytes"), F.col("size")) / 2
    shard = sum(((middle >= F.lit(e)).cast("int") for e in ends[:-1]), F.lit(0))
    columns = ["doc_id", "size", "text_crc32", "_text", "shard"]
    done = whole.select(*columns).unionByName(cut.withColumn("shard", shard).select(*columns))
    done = settle(done, "shards")
    starts = [0] * (shards + 1)
    for row in done.groupBy("shard").count().collect():  # at most one row per shard
        starts[row["shard"] + 1] = row["count"]
    for s in range(shards):
        starts[s + 1] += starts[s]
    slots = prefix_sums(done, [F.col("shard"), F.col("_text"), F.col("doc_id")], {"_at": F.lit(1)})
    first = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in starts]), F.col("shard") + 1)
    return slots.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_at") - first).alias("slot"))


def query(spark, folder: str) -> DataFrame:
    placed = shard_by_bytes(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
