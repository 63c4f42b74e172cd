"""Centroid clustering (Lloyd's rounds in integers) with PCA-rotated filtering.

Vectors are turned into integers once and stored with the leading coordinates of their position in the basis of
principal components (as many as cover ``SHARE`` of the variance) and with the norm of the other coordinates (the
residual norm). For a vector x and a centroid c with leading coordinates p and residual norms r,

    |x - c|^2 >= |p(x) - p(c)|^2 + (r(x) - r(c))^2,

so centroids whose bound exceeds the least distance found so far can't be nearest. Centroids are looked at by rising
bound; those that survive are compared by exact integer distance. The basis comes from the second moments of all
vectors; it decides how much is filtered, never the result.

A round is one pass over the stored table. Each task sends one row per centroid (a count and 64 sums); these are added
by Spark, and one sum per centroid and component comes to the driver. Members of one centroid are summed wherever they lie, so a centroid
that holds a third of all rows costs no more than others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.sources.store import settle

CENTROIDS = 8
ROUNDS = 10
SIZE = 64
SCALE = 1024
SEED = "3"
SHARE = 0.8  # of the variance, covered by the leading coordinates
LIMIT = 1 << 27  # squared distances of SIZE such components fit a long
MERGE = 64  # rows of partial second moments that reach the driver
_SLACK = 1e-9  # far above the rounding of rotated coordinates


def _whole(size: int, scale: int):
    """Rows to integer vectors of 32-bit components; ``near`` says whether distances to them fit a long."""

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            right = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(lists), size), False)
            batch = batch.filter(right)
            flat = batch.column(1).flatten()
            values = np.floor(scale * pa.compute.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)).reshape(-1, size)
            finite = np.isfinite(batch.column(1).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, size)).all(axis=1)
            near = finite & (np.abs(values) < LIMIT).all(axis=1)
            vectors = np.where(near[:, None], values, 0).astype(np.int32)
            raw = [v.tobytes() for v in vectors]
            columns = [batch.column(0), pa.array(near), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "near", "vector"]).filter(pa.array(finite))

    return turned


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Rows of equal-sized binary values as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _moments(size: int):
    """A task's count, sums and sums of products of (floating) vectors, as one row."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            x = _matrix(batch.column(0), np.int32, size).astype(float)
            n, first, second = n + len(x), first + x.sum(axis=0), second + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.append(first, second).tobytes()], pa.binary())], ["n", "sums"])

    return summed


def principal_axes(vectors: DataFrame, size: int, share: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and principal axes (columns, by falling variance) of a table of binary integer vectors, and how many cover ``share``."""
    parts = vectors.select("vector").mapInArrow(_moments(size), "n long, sums binary")

    def merged(rows):
        total = np.sum([np.frombuffer(s) for s in rows["sums"]], axis=0)
        return rows.iloc[:1].assign(n=rows["n"].sum(), sums=total.tobytes())[["n", "sums"]]

    parts = parts.withColumn("_to", F.pmod(F.xxhash64("sums"), F.lit(MERGE))).groupBy("_to").applyInPandas(merged, "n long, sums binary")
    rows = parts.collect()
    n = sum(r["n"] for r in rows)
    if not n:
        return np.zeros(size), np.eye(size), size
    total = np.sum([np.frombuffer(r["sums"]) for r in rows], axis=0)
    mean = total[:size] / n
    variance, axes = np.linalg.eigh(total[size:].reshape(size, size) / n - np.outer(mean, mean))
    covered = np.cumsum(np.maximum(variance[::-1], 0))
    return mean, np.ascontiguousarray(axes[:, ::-1]), int(np.searchsorted(covered, share * covered[-1])) + 1


def rotate(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates and the norm of the others."""
    turned = (x - mean) @ axes
    return turned[:, :leading], np.sqrt(np.square(turned[:, leading:]).sum(axis=1))


class Nearest:
    """Exact nearest centroids of integer vectors, filtered by rotated bounds."""

    def __init__(self, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int):
        self.centroids = centroids.astype(np.int64)
        self.lead, self.rest = rotate(self.centroids.astype(float), mean, axes, leading)
        self.checked = 0

    def bounds(self, lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Lower bounds of squared distances (rows by centroids), rounded down."""
        square = np.square(lead[:, None, :] - self.lead[None]).sum(axis=2) + np.square(rest[:, None] - self.rest)
        length = np.square(lead).sum(axis=1) + np.square(rest)
        far = np.square(self.lead).sum(axis=1) + np.square(self.rest)
        return square - _SLACK * (length[:, None] + far + 1)

    def __call__(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid numbers (ties: the smaller) and squared distances."""
        bound = self.bounds(lead, rest)
        order = np.argsort(bound, axis=1, kind="stable")
        best = np.full(len(x), np.iinfo(np.int64).max)
        at = np.full(len(x), len(self.centroids))
        for place in range(order.shape[1]):
            candidate = order[:, place]
            rows = np.flatnonzero(bound[np.arange(len(x)), candidate] <= best)
            if not len(rows):
                break  # bounds rise from place to place
            which = candidate[rows]
            distance = np.square(x[rows].astype(np.int64) - self.centroids[which]).sum(axis=1)
            self.checked += len(rows)
            better = (distance < best[rows]) | ((distance == best[rows]) & (which < at[rows]))
            best[rows[better]], at[rows[better]] = distance[better], which[better]
        return at, best


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = SEED, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """``vec_id, embedding`` to (``vec_id, cluster, distance, n_checked``, ``cluster, n, centroid, n_checked``).

    Components become ``floor(scale * x)``. The first centroids are the ``k`` vectors with the least sha256 of
    ``seed:vec_id`` (fewer vectors: fewer centroids; an id that repeats gives its vectors in the order of their bytes).
    Each of ``rounds`` rounds assigns all vectors and sets every centroid that has members to their floored mean.
    ``n_checked`` counts the integer distances that the filter left to compute, in the last assignment.

    Vectors that are null, of another size, or hold null or non-finite components are left out. Every other row comes
    out, repeated rows too; rows without an id are assigned but start no centroid. A vector with a component of
    ``LIMIT`` (131,072 before scaling) or more has distances that no long holds: it moves no centroid and comes out
    with null cluster and distance. An empty table gives empty tables.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    whole = settle(rows.mapInArrow(_whole(size, scale), "vec_id bigint, near boolean, vector binary"), "integer-vectors")
    near = whole.where("near")
    first = near.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "vector").limit(k)
    centroids = np.array([np.frombuffer(r["vector"], np.int32) for r in first.select("vector").collect()], np.int64).reshape(-1, size)
    mean, axes, leading = principal_axes(near, size, share)

    def rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotate(_matrix(batch.column(1), np.int32, size).astype(float), mean, axes, leading)
            columns = [*batch.columns, pa.array([v.tobytes() for v in lead], pa.binary()), pa.array(rest)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "lead", "rest"])

    stored = settle(near.select("vec_id", "vector").mapInArrow(rotated, "vec_id bigint, vector binary, lead binary, rest double"), "rotated-vectors")

    def nearest(batch: pa.RecordBatch, finder: Nearest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = _matrix(batch.column("vector"), np.int32, size)
        return x, *finder(x, _matrix(batch.column("lead"), float, leading), batch.column("rest").to_numpy())

    def partial(now: np.ndarray):
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder, n, sums = Nearest(now, mean, axes, leading), np.zeros(len(now), np.int64), np.zeros((len(now), size), np.int64)
            for batch in batches:
                x, at, _ = nearest(batch, finder)
                n += np.bincount(at, minlength=len(now))
                for c in np.unique(at):
                    sums[c] += x[at == c].sum(axis=0, dtype=np.int64)
            some = np.flatnonzero(n)
            if len(some):
                columns = [pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

        return summed

    if len(centroids):
        for _ in range(rounds):
            parts = stored.select("vector", "lead", "rest").mapInArrow(partial(centroids), "cluster int, n long, sums array<long>")
            each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
            for r in each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect():  # k * size rows
                centroids[r["cluster"], r["at"]] = int(r["s"]) // r["n"]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Nearest(centroids, mean, axes, leading)
        for batch in batches:
            if not len(centroids):  # no vector has an id
                empty = [batch.column("vec_id"), pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.int64()), pa.nulls(len(batch), pa.int64())]
                yield pa.RecordBatch.from_arrays(empty, ["vec_id", "cluster", "distance", "n_checked"])
                continue
            finder.checked = 0
            _, at, distance = nearest(batch, finder)
            checked = np.zeros(len(batch), np.int64)
            checked[:1] = finder.checked
            columns = [batch.column("vec_id"), pa.array(at, pa.int32()), pa.array(distance), pa.array(checked)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "n_checked"])

    schema = "vec_id bigint, cluster int, distance bigint, n_checked bigint"
    members = stored.mapInArrow(assigned, schema)
    far = whole.where("not near").select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("bigint").alias("distance"), F.lit(0).cast("bigint").alias("n_checked"))
    made = spark.createDataFrame([(i, [int(v) for v in c]) for i, c in enumerate(centroids)], "cluster int, centroid array<long>")
    return members.unionByName(far), made


def query(spark, folder: str) -> DataFrame:
    """The contract's digests: inertias are sums of distances, null where a long doesn't hold them (or without a cluster)."""
    members, made = clusters(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))
    members = settle(members.drop("n_checked"), "clusters")
    inertia = members.where("cluster is not null").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    total = sum(int(r["s"]) for r in inertia)
    fits = lambda v: v if v < 1 << 63 else None
    sums = {r["cluster"]: fits(int(r["s"])) for r in inertia}
    shown = [(r["cluster"], sums.get(r["cluster"]), fits(total), hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest()) for r in made.collect()]
    facts = spark.createDataFrame(shown, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return members.join(F.broadcast(facts), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _check_sql() -> str:
    """The contract, round by round, over integer lists."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings WHERE len(embedding) = {SIZE} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS cluster, v AS c FROM (SELECT v, sha256('{SEED}:' || vec_id) AS h FROM kept ORDER BY h LIMIT {CENTROIDS}))",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"d{i} AS (SELECT r, cluster, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v, c)])::BIGINT AS distance FROM kept, c{i})")
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{i} GROUP BY r)")
        if i < ROUNDS:
            steps.append(f"s{i} AS (SELECT cluster, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM kept JOIN a{i} USING (r)) GROUP BY cluster, j)")
            steps.append(f"m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{i} GROUP BY cluster)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN a{ROUNDS} USING (r) JOIN c{ROUNDS} USING (cluster)
"""


ORACLE = _check_sql()
