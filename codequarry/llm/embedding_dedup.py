"""Embedding near-dedup by sorted projection passes.

Vectors that are equal and share a label are one class, represented by the smallest id. In each pass every
representative gets a code of ``BITS`` signs of random projections of its difference from the mean of its label, so
that the signs part a crowd of vectors that all point one way; representatives are ordered by (label, code) and each
is compared in double precision with the ``WINDOW`` ones before it, across the borders of partitions too. Neighbours share long beginnings of their codes,
so they meet in some pass even if others part them. Pairs found in any pass are united into components. Rounds of
``PASSES`` passes with new projections go on, over all rows, until a round unites nothing that was apart.

The links of a vector are then counted exactly within its component: its members are dealt into tiles, and each pair
of tiles is compared as two matrices, so no pair is written out and no task holds more than two tiles. Only a
pair that no chain of found links joins can be missed; recall is measured in the tests and stated in the README.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.components import components
from codequarry.sources.store import discard, settle

COSINE = 0.98
PASSES = 12
BITS = 48
WINDOW = 100
BORDER_ROWS = 8192
TILE = 2048
SEED = 23


def unit(lists: pa.Array) -> list[np.ndarray | None]:
    """Vectors of length 1 in double precision; None for null, empty, zero or non-finite ones and for those that hold nulls."""
    out: list[np.ndarray | None] = []
    flat = lists.flatten()
    holes = flat.null_count > 0
    values = flat.to_numpy(zero_copy_only=False).astype(float)
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
    at = 0
    for n in sizes:
        v = values[at : at + n]
        bad = n == 0 or (holes and flat.slice(at, n).null_count > 0) or not np.isfinite(v).all()
        at += n
        top = 0.0 if bad else float(np.abs(v).max())
        if top == 0.0:
            out.append(None)
        else:
            v = v / top
            out.append(v / np.sqrt(v @ v))
    return out


def codes(vectors: np.ndarray, turn: int = 0) -> np.ndarray:
    """For each vector a code for each pass of a round (same for all vectors of a dimension)."""
    planes = np.random.default_rng([SEED, turn]).normal(size=(PASSES * BITS, vectors.shape[1]))
    bits = (vectors @ planes.T > 0).reshape(len(vectors), PASSES, BITS)
    return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = unit(batch.column(1))
        raw = [None if v is None else v.tobytes() for v in vectors]
        digests = [None if r is None else hashlib.md5(r).digest() for r in raw]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(raw, pa.binary()), pa.array(digests, pa.binary())],
            ["vec_id", "label", "unit", "digest"],
        )


def _matrix(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw)).reshape(len(raw), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``group, unit`` to the sum of each batch's vectors of a group, a row for each dimension."""
    for batch in batches:
        for group, rows in batch.to_pandas().groupby("group", sort=False):
            total = _matrix(rows["unit"].to_numpy()).sum(0)
            columns = [pa.array([group] * len(total)), pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), len(rows)))]
            yield pa.RecordBatch.from_arrays(columns, ["group", "at", "total", "n"])


def means(classes: DataFrame) -> DataFrame:
    """``group, mean``: the mean vector of each group, rounded so that it does not depend on the order of sums."""
    summed = classes.select("group", "unit").mapInArrow(_sums, "group string, at bigint, total double, n bigint")
    each = summed.groupBy("group", "at").agg(F.round(F.sum("total") / F.sum("n"), 9).alias("mean"))
    each = each.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("at", "mean"))).alias("mean"))
    return each.select("group", F.transform("mean", lambda x: x["mean"]).alias("mean"))


def _coded(turn: int):
    """Rows ``group, node, unit, mean`` to one with a code for each pass of the round."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            mean = batch.column(3)
            flat, sizes = mean.flatten().to_numpy(), pa.compute.list_value_length(mean).to_numpy()
            begin = np.cumsum(sizes) - sizes
            signs: list = [None] * len(raw)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                off = _matrix([raw[i] for i in at]) - flat[begin[at][:, None] + np.arange(n)]
                for i, code in zip(at, codes(off, turn), strict=True):
                    signs[i] = code
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(signs, pa.list_(pa.int64()))], ["group", "node", "unit", "codes"])

    return coded


def linked(classes: DataFrame) -> DataFrame:
    """``group, node, unit`` to ``node, component`` of all that have a link: rounds of passes until one unites nothing new."""
    rows = settle(classes.select("group", "node", "unit").join(means(classes), "group"), "vector-centres")
    reached, apart, turn = None, -1, 0
    while True:
        passes = rows.select("group", "node", "unit", "mean").mapInArrow(_coded(turn), "group string, node bigint, unit binary, codes array<bigint>")
        passes = passes.select("node", "unit", F.posexplode("codes").alias("pass", "code"), "group").withColumn("group", F.concat_ws(":", "pass", "group"))
        walked = walk(passes)
        found = walked.where("part is null").select("a", "b").unionByName(across(walked)).distinct()
        before = reached
        if before is not None:
            found = found.unionByName(before.select(F.col("node").alias("a"), F.col("component").alias("b")))
        reached = settle(components(found), "vector-components")
        for table in (walked, before):
            if table is not None:
                discard(table)
        united = reached.where("node <> component").count()  # each union makes one node more that is not the least of its component
        if united == apart or united == 0:
            return reached
        apart, turn = united, turn + 1


def walk(passes: DataFrame) -> DataFrame:
    """Rows ``group, code, node, unit`` in order, each compared with those before it in its partition: links ``a, b``, and
    the first and last ``WINDOW`` rows of each partition (``part`` not null) with their place ``at`` in it, for ``across``."""
    ordered = passes.repartitionByRange("group", "code", "node").sortWithinPartitions("group", "code", "node")
    ordered = ordered.select("group", "node", "unit", F.spark_partition_id().alias("part"))
    return settle(ordered.mapInArrow(_windows, "a bigint, b bigint, part int, at bigint, group string, node bigint, unit binary"), "vector-links")


def across(walked: DataFrame) -> DataFrame:
    """Links ``a, b`` between rows of different partitions, at most ``WINDOW`` places apart in the whole order.

    The rows at borders get their place in the whole order from the sizes of the partitions (one row each, summed in one task) and
    are cut into blocks that share ``WINDOW`` places, so partitions of any size, also of less than a window, are bridged.
    """
    rows = walked.where("part is not null")
    sizes = rows.groupBy("part").agg((F.max("at") + 1).alias("n"))  # the last row of a partition is among them
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    block = F.floor(F.col("at") / BORDER_ROWS)
    shared = F.col("at") % BORDER_ROWS >= BORDER_ROWS - WINDOW
    placed = rows.join(F.broadcast(starts), "part").select((F.col("start") + F.col("at")).alias("at"), "group", "node", "unit")
    placed = placed.select(F.explode(F.when(shared, F.array(block, block + 1)).otherwise(F.array(block))).alias("block"), "at", "group", "node", "unit")
    return placed.groupBy("block").applyInPandas(_border_links, "a bigint, b bigint")


class _Found:
    """A spanning forest of the links seen so far."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def compare(self, rows: pd.DataFrame, known: int = 0) -> None:
        """Each row but the first ``known`` with those of its group up to ``WINDOW`` places (``at``) before it."""
        group, at = rows["group"].to_numpy(), rows["at"].to_numpy()
        edge = np.flatnonzero(group[1:] != group[:-1]) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(rows)], strict=True):
            ids, vectors = rows["node"].to_numpy()[a:b], _matrix(rows["unit"].to_numpy()[a:b])
            for lo in range(max(0, known - a), b - a, 256):
                hi, first = min(lo + 256, b - a), max(0, lo - WINDOW)
                near = vectors[lo:hi] @ vectors[first:hi].T >= COSINE
                distance = at[a + lo : a + hi, None] - at[a + first : a + hi]
                for i, j in zip(*np.nonzero(near & (distance > 0) & (distance <= WINDOW)), strict=True):
                    x, y = self.root(int(ids[lo + i])), self.root(int(ids[first + j]))
                    if x != y:
                        self.parent[max(x, y)] = min(x, y)

    def take(self) -> list[tuple[int, int]]:
        links = [(x, self.root(x)) for x in list(self.parent) if self.root(x) != x]
        self.parent.clear()
        return links


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of rows that come in order, as a spanning forest, then the rows at both ends."""
    tail: pd.DataFrame | None = None
    found, seen = _Found(), 0
    for batch in batches:
        rows = batch.to_pandas()
        rows["at"] = np.arange(seen, seen + len(rows))
        if seen < WINDOW and len(rows):
            yield _ends(rows[rows["at"] < WINDOW])
        seen += len(rows)
        known = 0 if tail is None else len(tail)
        rows = rows if tail is None else pd.concat([tail, rows], ignore_index=True)
        found.compare(rows, known)
        tail = rows.iloc[-WINDOW:]
        if len(found.parent) > 200_000:
            yield _links(found.take())
    if tail is not None:
        yield _ends(tail[tail["at"] >= WINDOW])
    yield _links(found.take())


_END = {"part": pa.int32(), "at": pa.int64(), "group": pa.string(), "node": pa.int64(), "unit": pa.binary()}


def _ends(rows: pd.DataFrame) -> pa.RecordBatch:
    none = pa.nulls(len(rows), pa.int64())
    columns = [pa.array(rows[c].to_numpy(), kind) for c, kind in _END.items()]
    return pa.RecordBatch.from_arrays([none, none, *columns], ["a", "b", *_END])


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = [pa.array([link[i] for link in links], pa.int64()) for i in (0, 1)]
    nulls = [pa.nulls(len(links), kind) for kind in _END.values()]
    return pa.RecordBatch.from_arrays([*columns, *nulls], ["a", "b", *_END])


def _border_links(rows: pd.DataFrame) -> pd.DataFrame:
    found = _Found()
    found.compare(rows.sort_values("at", ignore_index=True))
    return pd.DataFrame(found.take(), columns=["a", "b"], dtype="int64")


def _tiles(pairs: pd.DataFrame) -> pd.DataFrame:
    """Links between the two tiles of each component in the group (or within one tile), weighted by the copies of the other side."""
    nodes, counts = [], []
    for _, rows in pairs.groupby("component", sort=False):
        side = rows["side"].to_numpy()
        ids, times, vectors = rows["node"].to_numpy(), rows["times"].to_numpy(), _matrix(rows["unit"].to_numpy())
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        if len(right) == 0:
            near = vectors @ vectors.T >= COSINE
            np.fill_diagonal(near, False)
            nodes.append(ids)
            counts.append(near @ times)
        else:
            near = vectors[left] @ vectors[right].T >= COSINE
            nodes += [ids[left], ids[right]]
            counts += [near @ times[right], near.T @ times[left]]
    return pd.DataFrame({"node": np.concatenate(nodes), "links": np.concatenate(counts)})


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, label`` to ``vec_id, n_links, component_id, kept``, one row per input row.

    Links have equal non-null labels, equal dimension and a cosine of at least ``COSINE``. Vectors that are null,
    empty, zero or hold null or non-finite components, and rows with a null label or id, have no links and are
    kept. Rows that share an id and differ in vector or label are classes of one node: the node's links are
    those of all its rows.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    read = settle(rows.mapInArrow(_read, "vec_id bigint, label string, unit binary, digest binary"), "vectors")
    valid = read.where("vec_id is not null and label is not null and unit is not null").withColumn("group", F.concat_ws(":", F.octet_length("unit"), "label"))
    classes = valid.groupBy("group", "digest").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("times"), F.first("unit").alias("unit"))
    classes = settle(classes, "vector-classes")

    reached = linked(classes)

    members = classes.join(reached, "node").select("component", "group", "digest", "node", "times", "unit")
    deals = -(-reached.count() // (2 * TILE)) or 1  # groups of about two tiles' rows, however many there are
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    dealt = members.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("node", "digest"), F.col("tiles")).cast("int"))
    # each tile meets itself and all others once; components of one tile share groups by a hash
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    dealt = dealt.select("*", other).select(
        F.when(F.col("tiles") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(deals))).alias("deal"),
        F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
        (F.col("tile") > F.col("other")).cast("int").alias("side"),
        F.concat_ws("/", "component", "group").alias("component"), "node", "times", "unit",
    )
    counted = dealt.groupBy("deal", "low", "high").applyInPandas(_tiles, "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))
    own = valid.select("vec_id", "group", "digest").join(classes.select("group", "digest", "node", "times"), ["group", "digest"])
    own = own.join(counted, "node", "left").join(reached, "node", "left")
    joined = own.select("vec_id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    alone = read.where("vec_id is null or label is null or unit is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label"))
