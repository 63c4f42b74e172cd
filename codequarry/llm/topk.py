"""Exact top-k search by inner product: sorted lists, read in sequence, with no random access to scores.

Vectors and queries are dealt into blocks by a hash of their id, and each block of queries meets each block of
vectors. There, every dimension has its list of the vectors in order of component. A query reads its lists one after the
other, those first that can move scores most (its component times the list's range), each from the end that the
component favours. What is read of a vector's score is its partial sum; the rest lies between

* lower: the partial sum plus the least that each unread list holds, and
* upper: the partial sum plus the most that each unread list holds; for the list that is being read, the entry reached.

A vector whose upper bound is below the k-th best lower bound can't be among the k best: it is dropped, and its entries in
the other lists are passed over. Reading ends when all lists are read for the vectors that are left, whose partial sums are
then their scores. Each block's k best meet the other blocks' in one aggregation per query, and the k best of all are exact.

All numbers are integers: components are floor(256 x), so bounds and scores carry no rounding. Vectors with a component of
``WIDE`` or more, whose products would pass the range of 64 bits, are scored one by one in unbounded integers; a score
that no long holds comes out as the nearest long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.sources.store import settle

BEST = 5
SCALE = 256
EVERY = 50
ROWS = 8192  # vectors of a block, about
QUERIES = 4096  # queries of a block, about
WIDE = 1 << 28  # products of such components, summed over 64 dimensions, would pass 2^62
TEST_EVERY = 4  # lists between two tests of all bounds while many vectors are left
LONG = (1 << 63) - 1


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Integer vectors as bytes (double precision holds them exactly), with their dimension; null if any component, or its multiple, isn't finite."""
    for batch in batches:
        lists, out, sizes = batch.column(1), [], []
        flat = lists.flatten()
        holes = flat.null_count > 0
        with np.errstate(over="ignore", invalid="ignore"):
            values = np.floor(SCALE * flat.to_numpy(zero_copy_only=False).astype(float))
        at = 0
        for n in pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy():
            v = values[at : at + n]
            good = n > 0 and not (holes and flat.slice(at, n).null_count) and np.isfinite(v).all()
            out.append(v.tobytes() if good else None)
            sizes.append(int(n))
            at += n
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "size", "vector"])


class Lists:
    """A block of vectors with its sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.n, self.size = ids[order], *vectors.shape
        columns = np.ascontiguousarray(vectors[order].T.astype(np.int64))
        self.places = np.argsort(columns, axis=1, kind="stable")  # by rising component
        self.values = np.take_along_axis(columns, self.places, axis=1)
        self.read = 0  # entries
        self.left: list[tuple[float, float]] = []  # of the last query: share of the lists read, share of the vectors left

    def best(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(vector, score) of the k best of this block for a query, vectors with the id ``own`` left out; ties to the smaller id."""
        query = query.astype(np.int64)
        low, high = self.values[:, 0], self.values[:, -1]
        top, bottom = np.where(query > 0, query * high, query * low), np.where(query > 0, query * low, query * high)
        order = np.argsort(bottom - top, kind="stable")
        most, least = top.sum(), bottom.sum()  # of the unread lists
        partial, alive = np.zeros(self.n, np.int64), self.ids != own
        left = int(alive.sum())
        self.left = []
        for nth, d in enumerate(order):
            entries, values = (self.places[d], self.values[d]) if query[d] <= 0 else (self.places[d][::-1], self.values[d][::-1])
            if left < self.n:
                open_ = alive[entries]
                entries, values = entries[open_], values[open_]
            most, least = most - top[d], least - bottom[d]
            half = len(entries) // 2
            partial[entries[:half]] += query[d] * values[:half]
            self.read += half
            rest, more = entries[half:], query[d] * values[half:]
            if left > k and (nth % TEST_EVERY == TEST_EVERY - 1 or left * TEST_EVERY < self.n):
                # the rest of this list holds at most its next entry and at least its last
                lower = np.concatenate([partial[entries[:half]], partial[rest] + more[-1]]) + least
                upper = np.concatenate([partial[entries[:half]], partial[rest] + more[0]]) + most
                out = upper < np.partition(lower, left - k)[left - k]
                alive[entries[out]] = False
                left -= int(out.sum())
                open_ = alive[rest]
                rest, more = rest[open_], more[open_]
            partial[rest] += more
            self.read += len(rest)
            self.left.append(((nth + 1) / self.size, left / self.n))
        found = np.flatnonzero(alive)
        # ids are in order, so a stable order by falling score keeps ties
        found = found[np.argsort(-partial[found], kind="stable")[:k]]
        return [(int(self.ids[i]), int(partial[i])) for i in found]


def _exactly(own: int, query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best in unbounded integers, each vector by itself."""
    whole = [int(x) for x in query]
    scores = ((max(-LONG - 1, min(LONG, sum(a * int(b) for a, b in zip(whole, v, strict=True)))), int(i)) for i, v in zip(ids, vectors, strict=True) if i != own)
    return [(i, s) for s, i in heapq.nsmallest(k, scores, key=lambda x: (-x[0], x[1]))]


def _search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    found: list[tuple[int, int, int]] = []
    if len(left) and len(right):
        ids, vectors = right["vec_id"].to_numpy(), np.frombuffer(b"".join(right["vector"])).reshape(len(right), -1)
        limit = WIDE / max(1.0, np.sqrt(vectors.shape[1] / 64))
        wide = (np.abs(vectors) >= limit).any(axis=1)
        lists = Lists(ids[~wide], vectors[~wide]) if not wide.all() else None
        for own, raw in zip(left["vec_id"].to_numpy(), left["vector"], strict=True):
            query = np.frombuffer(raw)
            if lists is None or (np.abs(query) >= limit).any():
                best = _exactly(own, query, ids, vectors, BEST)
            else:
                best = lists.best(own, query, BEST) + (_exactly(own, query, ids[wide], vectors[wide], BEST) if wide.any() else [])
            found += [(int(own), i, s) for i, s in best]
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")


def top_k(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """``vec_id, embedding`` to ``query_id, rank, vec_id, score``: the ``BEST`` highest scores of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``, candidates all rows with another id. Vectors that are
    null, empty or hold null or non-finite components (or finite ones whose multiple isn't), and rows with a null id, take no part; vectors of another
    dimension than the query's are no candidates for it. Rows alike in id and vector count once; if an id has
    several vectors, each is a query and a candidate, and the id's best results come out, each id at most once.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    rows = rows.mapInArrow(_whole, "vec_id bigint, size int, vector binary").where("vector is not null")
    rows = settle(rows.dropDuplicates(["vec_id", "vector"]), "integer-vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    sizes = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q"))
    blocks = sizes.select("size", F.ceil(F.col("n") / ROWS).cast("int").alias("row_blocks"), F.ceil(F.col("q") / QUERIES).cast("int").alias("query_blocks")).where("query_blocks > 0")

    def dealt(df: DataFrame, own: str, other: str, seed: str) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(seed), "vec_id", "vector"), F.col(f"{own}_blocks")).cast("int")
        spread = df.join(blocks, "size").withColumn(own, block)
        spread = spread.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
        return spread.select(*[F.col(c).alias(c) for c in ("size", "query", "row", "vec_id", "vector")])

    keys = ["size", "query", "row"]
    left, right = dealt(asked, "query", "row", "q"), dealt(rows, "row", "query", "r")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search, "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST).select("query_id", "rank", "vec_id", "score")


def query(spark, folder: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = f"""
WITH whole AS (
  SELECT vec_id, [floor({SCALE} * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0),
ranked AS (
  SELECT query_id, (ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= {BEST}
"""
