"""MinHash near-duplicate detection with circulant signatures and exact verification.

A shingle is hashed to a place on a circle of 2^20 (the first permutation); coordinate k of a signature is the
least value of the second permutation, shifted by k, over a text's places. So the coordinates of one shingle are a
contiguous stretch of one table, and a signature is the minimum of such stretches: two permutations serve for
all coordinates.

Signatures are cut into bands. With 40 bands of 5, a pair at similarity 0.8 shares no band once in 7 million
times, one at 0.85 once in 10^10. Texts with the same shingle set are one class and represented by the smallest id.

All representatives that share a band are compared on full shingle sets, unless they are connected already:
in three rounds, members are compared with centres of their buckets, and components are found anew after each. The
first round reads four bands only: near copies share most of their bands, so nearly all are connected by then, and
the later rounds, over all bands, don't pair them with the same centre once per band. In a
bucket of up to 32 all members are centres; a larger one has one centre in the first two rounds and four in the third,
those with most links, such as the text that others were copied from. What is then not in one component is a
large bucket with texts that lie apart: its members are dealt into tiles of bounded size, and each pair of tiles is
compared as two matrices. No pairs are written out, and no pair that shares a band and could join two groups is left
out. A bucket whose members all lie apart costs the square of its size in arithmetic, spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import wordscan
from codequarry.llm.components import components
from codequarry.sources.store import settle

WORDS = 5
BANDS, ROWS = 40, 5
CIRCLE = 20
SMALL = 32
ROUNDS = ((4, 1), (BANDS, 1), (BANDS, 4))  # bands read and centres of a large bucket
TILE_ROWS, TILE_SHINGLES = 1500, 300_000
_STEP = 512


def circle(seed: int = 5) -> np.ndarray:
    """Row i holds the second permutation's values from place i on, one for each coordinate (a view, not a copy)."""
    k = BANDS * ROWS
    table = np.random.default_rng(seed).permutation(1 << CIRCLE).astype(np.uint32)
    table = np.concatenate([table, table[:k]])
    return np.lib.stride_tricks.as_strided(table, (1 << CIRCLE, k), (4, 4), writeable=False)


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles of ``WORDS`` words (of all its words if fewer)."""
    words = wordscan.scan(texts, ~wordscan.SPACE)
    (h,) = words.hashes()
    per = words.per_doc()
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    run = np.zeros(len(h), np.uint64)
    for i in range(WORDS):
        run = wordscan.mix(run * np.uint64(0x9FB21C651E98DF25) + padded[i : i + len(h)] + np.uint64(i + 1))
    out = []
    for a, b in zip(per[:-1].tolist(), per[1:].tolist(), strict=True):
        if b - a >= WORDS:
            own = np.sort(run[a : b - WORDS + 1])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        elif b > a:
            value = np.array([b - a], np.uint64)
            for i in range(a, b):
                value = wordscan.mix(value * np.uint64(0xD6E8FEB86659FD93) + h[i : i + 1])
            out.append(value)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def bands(own: np.ndarray, stretches: np.ndarray) -> np.ndarray:
    """Band hashes of one shingle set."""
    places = (wordscan.mix(own + np.uint64(17)) >> np.uint64(64 - CIRCLE)).astype(np.int64)
    least = stretches[places[:_STEP]].min(axis=0)
    for lo in range(_STEP, len(places), _STEP):
        np.minimum(least, stretches[places[lo : lo + _STEP]].min(axis=0), out=least)
    value = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        value = wordscan.mix(value * np.uint64(0x9FB21C651E98DF25) + row + np.uint64(1))
    return value


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stretches = circle()
    for batch in batches:
        texts = wordscan.as_bytes(batch.column(1))
        for lo, hi in wordscan.slices(texts):
            sets = shingles(texts.slice(lo, hi - lo))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            signed = [bands(s, stretches).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(signed, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "bands"],
            )
    wordscan.give_back()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = wordscan.as_bytes(batch.column(1))
        for lo, hi in wordscan.slices(texts):
            sets = shingles(texts.slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "own"]
            )
    wordscan.give_back()


def near_duplicates(docs: DataFrame, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n_shingles, component_id, kept``, one row per input row.

    Documents whose shingle sets have a Jaccard similarity of at least ``similarity`` are linked;
    ``component_id`` is the smallest id that links lead to. Texts without words (null, empty, white space)
    have 0 shingles and are linked with nothing, so they are kept. Rows that share an id are one node: links
    of any of them count; a row with a null id is a node by itself with null ``component_id``, and kept.
    """
    part, whole = similarity.numerator, similarity.denominator
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    wordscan.small_batches(rows.sparkSession)
    signed = settle(rows.mapInArrow(_signed, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"), "signed")
    named = signed.where("doc_id is not null and digest is not null")
    classes = named.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r"), F.count(F.lit(1)).alias("times"))
    classes = settle(classes.select("digest", F.col("r.doc_id").alias("node"), F.col("r.n_shingles").alias("n"), "r.bands", "times"), "classes")
    own = named.join(classes.select("digest", "node"), "digest").select("doc_id", "node")
    several = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_last")).where("a <> _last")
    found = settle(own.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "links")

    entries = classes.select("node", "n", F.posexplode("bands").alias("band", "value"))
    shared = entries.groupBy("band", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "value")
    active = settle(entries.join(shared, ["band", "value"]), "buckets")
    # texts of the candidates only; their sets are read by every round
    wanted = active.select(F.col("node").alias("doc_id")).distinct()
    near = rows.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "node bigint, own array<bigint>")
    near = settle(near.where(F.size("own") > 0), "shingles")
    common = F.size(F.array_intersect("own_a", "own_b"))
    union = F.size("own_a") + F.size("own_b") - common

    reached = _reached(found)
    for first_bands, centres in ROUNDS:
        placed = _unsettled(active.where(F.col("band") < first_bands), reached)
        slot = F.when(F.col("c") <= SMALL, F.col("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(centres)))
        placed = settle(placed.withColumn("slot", slot), "buckets")
        best = F.max_by(F.struct("node", "n", "component"), F.struct("degree", -F.col("node")))
        middle = placed.groupBy("band", "value", "slot").agg(best.alias("m"))
        middle = middle.select("band", "value", F.col("m.node").alias("a"), F.col("m.n").alias("na"), F.col("m.component").alias("ca"))
        pairs = placed.join(middle, ["band", "value"]).where("node <> a and component <> ca")
        pairs = pairs.where((F.col("n") * whole >= F.col("na") * part) & (F.col("na") * whole >= F.col("n") * part))
        pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        links = pairs.join(near.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a")
        links = links.join(near.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b")
        links = settle(links.where(common * whole >= union * part).select("a", "b"), "links")
        found = found.unionByName(links)
        reached = _reached(found)
        rest = placed.where(F.col("c") > SMALL).select("node", "n", "band", "value")  # small buckets are done
        active = rest.unionByName(active.where(F.col("band") >= first_bands).select(*rest.columns))

    left = _unsettled(active, reached).select("band", "value", "node", "component", F.greatest(F.ceil(F.col("c") / TILE_ROWS), F.ceil(F.col("total") / TILE_SHINGLES)).cast("int").alias("tiles"))
    left = left.join(near, "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    left = left.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    left = left.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return _tile_links(rows, part, whole)

    last = left.groupBy("band", "value", "low", "high").applyInPandas(compare, "a bigint, b bigint").distinct()
    reached = _reached(found.unionByName(settle(last, "links")))
    homes = classes.select("digest", "node").join(reached, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(homes, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _unsettled(active: DataFrame, reached: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with their component and number of links."""
    placed = active.join(reached, "node", "left").select("band", "value", "node", "n", F.coalesce("component", "node").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree"))
    split = placed.groupBy("band", "value").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("total"))
    return placed.join(split.where("_lo <> _hi").select("band", "value", "c", "total"), ["band", "value"])


def _tile_links(rows: pd.DataFrame, part: int, whole: int) -> pd.DataFrame:
    """Links that join components, between the two tiles of a bucket in ``rows`` (or within one tile).

    Sizes of all intersections come from products of membership matrices, some columns at a time; a shingle of
    one member only adds nothing and is left out.
    """
    nodes, homes = rows["node"].to_numpy(), rows["component"].to_numpy()
    sizes = np.array([len(x) for x in rows["own"]])
    owner = np.repeat(np.arange(len(rows)), sizes)
    _, column, times = np.unique(np.concatenate(rows["own"].to_numpy()), return_inverse=True, return_counts=True)
    kept = times[column] > 1
    owner, column = owner[kept], (np.cumsum(times > 1) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    first = rows["tile"].to_numpy() == rows["low"].to_numpy()
    one = bool((rows["low"] == rows["high"]).all())
    i, j = np.flatnonzero(first), np.flatnonzero(first if one else ~first)
    common = np.zeros((len(i), len(j)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
        a, b = np.searchsorted(column, [lo, lo + 1024])
        members = np.zeros((len(rows), 1024), np.float32)
        members[owner[a:b], column[a:b] - lo] = 1
        common += members[i] @ members[j].T
    union = sizes[i][:, None] + sizes[j] - common
    near = (common * whole >= union * part) & (homes[i][:, None] != homes[j])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for x, y in zip(*np.nonzero(near), strict=True):
        p, q = root(int(homes[i[x]])), root(int(homes[j[y]]))
        if p != q:
            parent[p] = q
            found.append((int(nodes[i[x]]), int(nodes[j[y]])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _reached(found: DataFrame) -> DataFrame:
    """``node, component, degree`` of all nodes that have links."""
    degrees = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return settle(components(found).join(degrees, "node"), "reached")


def without_near_duplicates(docs: DataFrame, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """All columns of the documents that are kept: of each group the one with the smallest id.

    Rows with equal ids are one document here: if it is kept, all of them stay.
    """
    judged = near_duplicates(docs.select("doc_id", "text"), similarity).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    packed = docs.select(F.struct("*").alias("_row"))
    return packed.join(judged, F.col("_row.doc_id") == F.col("_gone"), "left_anti").select("_row.*")


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, Fraction(85, 100))
