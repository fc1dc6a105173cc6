"""Centroid clustering in whole numbers, with an n-simplex projection that spares most exact distances.

Vectors are scaled to integers, so sums, means and squared distances are exact and every run gives the same clusters. A few pivots
are chosen among ``SAMPLE`` vectors. Each vector's distances to the pivots are taken once and kept as apex coordinates: the apex of
the simplex whose base are the pivots, and its height above that base. Centroids are projected alike. For two apexes the Euclidean
distance is a lower bound of the true distance, and the one with the second height mirrored is an upper bound. In a round only
centroids whose lower bound does not exceed the smallest upper bound are compared exactly, over all components; where one is left
there is nothing to compare. Bounds are widened by more than rounding can move them, so no nearest centroid is lost.

A round is one pass over the stored vectors; a task emits one sum per centroid, and what reaches the driver is ``k`` centroids.

Edge cases: vectors that are null, of another length, or with null or non-finite components are left out; a null vec_id hashes like
an empty one; equal hashes (repeated rows) go by components; with fewer than ``k`` vectors each is a centroid; an empty table gives
no rows; components beyond ``LIMIT`` after scaling, whose squares leave 64 bits, are an error. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import stored

COMPONENTS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
PIVOTS = 16
#: Vectors that pivots are chosen from.
SAMPLE = 64
#: Largest component after scaling: 64 squared differences of twice this stay within 64 bits.
LIMIT = 1 << 27
#: Share of the distances to the first pivot by which bounds are widened; rounding moves them by far less.
SLACK = 1e-5
#: Rows whose bounds are in hand at a time.
STEP = 4096


@dataclass
class Base:
    """Pivots, and the triangular factor that turns distances to them into coordinates."""

    pivots: np.ndarray  # pivots x components, int64
    factor: np.ndarray  # (pivots - 1) squared, lower triangular
    own: np.ndarray  # squared distance of each pivot to the first


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of two integer arrays."""
    out = np.empty((len(x), len(y)), dtype=np.int64)
    for j, c in enumerate(y):
        d = x - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def base_simplex(sample: np.ndarray, pivots: int = PIVOTS) -> Base:
    """Pivots far from the span of those before them, from distances alone; fewer where the sample spans less."""
    chosen = [0]
    d = squared(sample, sample).astype(np.float64)
    gram = (d[0][:, None] + d[0][None, :] - d) / 2  # products of differences to the first pivot
    height, rows = np.diag(gram).copy(), np.zeros((len(sample), 0))
    least = 1e-6 * height.max(initial=0.0)
    while len(chosen) < pivots:
        best = int(np.argmax(height))
        if height[best] <= max(least, 0.5):
            break
        column = (gram[:, best] - rows @ rows[best]) / np.sqrt(height[best])
        rows = np.column_stack([rows, column])
        height = np.maximum(height - column**2, 0.0)
        chosen.append(best)
        height[best] = 0.0
    return Base(sample[chosen], np.tril(rows[chosen[1:]]), d[0][chosen])


def apexes(base: Base, x: np.ndarray) -> np.ndarray:
    """Coordinates in the span of the pivots, the height above it, and the distance to the first pivot."""
    d = squared(x, base.pivots).astype(np.float64)
    b = (d[:, :1] + base.own[None, 1:] - d[:, 1:]) / 2
    n = len(base.factor)
    y = np.zeros((len(x), n))
    for i in range(n):  # forward substitution for all rows at once
        y[:, i] = (b[:, i] - y[:, :i] @ base.factor[i, :i]) / base.factor[i, i]
    height = np.sqrt(np.maximum(d[:, 0] - np.einsum("ij,ij->i", y, y), 0.0))
    return np.column_stack([y, height, np.sqrt(d[:, 0])])


def bounds(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances between the rows of two apex arrays, widened against rounding."""
    low, high = np.empty((len(one), len(other))), np.empty((len(one), len(other)))
    for j, c in enumerate(other):
        flat = one[:, :-2] - c[:-2]
        along = np.einsum("ij,ij->i", flat, flat)
        wide = SLACK * (one[:, -1] + c[-1] + 1.0)
        low[:, j] = np.sqrt(along + (one[:, -2] - c[-2]) ** 2) - wide
        high[:, j] = np.sqrt(along + (one[:, -2] + c[-2]) ** 2) + wide
    return low, high


def nearest(x: np.ndarray, apex: np.ndarray, centroids: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row, the smaller one of a tie."""
    low, high = bounds(apex, centre)
    maybe = low <= high.min(axis=1)[:, None]
    out = maybe.argmax(axis=1)
    open_ = np.flatnonzero(maybe.sum(axis=1) > 1)
    best = np.full(len(open_), np.iinfo(np.int64).max)
    for j, c in enumerate(centroids):
        rows = np.flatnonzero(maybe[open_, j])
        d = x[open_[rows]] - c
        d = np.einsum("ij,ij->i", d, d)
        closer = d < best[rows]
        best[rows[closer]] = d[closer]
        out[open_[rows[closer]]] = j
    return out


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, STEP):
            part = batch.slice(k, STEP)
            yield part, _matrix(part.column(1), width, np.int64)


def scaled(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and whole-number components ``q`` of the vectors that can be clustered."""
    x = F.col("embedding").cast("array<double>")
    sound = F.coalesce((F.size(x) == components) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.lit(False))  # false for NaN, which sorts above infinity
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v))
    fits = F.forall(whole, lambda v: v.between(-LIMIT, LIMIT))
    q = F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component leaves +-{LIMIT} after scaling"))).cast("array<int>")
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, components: int = COMPONENTS, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that can be clustered."""
    spark = vectors.sparkSession
    rows = scaled(vectors, components, scale)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = rows.orderBy(F.sha2(name, 256), "q").limit(max(k, SAMPLE)).select("q").collect()  # a fixed number of rows
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out)
    sample = np.array([r["q"] for r in first], dtype=np.int64)
    base, centroids = base_simplex(sample[:SAMPLE], pivots), sample[:k]
    width = len(base.pivots) + 1

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _parts(batches, components):
            apex = apexes(base, x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, apex.size + 1, width, dtype=np.int32)), pa.array(apex.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["vec_id", "q", "apex"])

    cached = stored(rows.mapInArrow(projected, "vec_id long, q array<int>, apex array<double>"), "apexes")

    def summed(now: np.ndarray) -> DataFrame:
        centre = apexes(base, now)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(now), dtype=np.int64), np.zeros((len(now), components), dtype=np.int64)
            for part, x in _parts(batches, components):
                near = nearest(x, _matrix(part.column(2), width, np.float64), now, centre)
                n += np.bincount(near, minlength=len(now))
                for j in np.unique(near).tolist():
                    total[j] += x[near == j].sum(axis=0)
            has = np.flatnonzero(n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(has) * components + 1, components, dtype=np.int32)), pa.array(total[has].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(n[has]), lists], names=["cluster", "n", "total"])

        parts = cached.mapInArrow(run, "cluster int, n long, total array<long>")
        exact = lambda c: F.sum(c.cast("decimal(38,0)"))
        return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[exact(F.col("total")[i]) for i in range(components)]).alias("total"))

    for _ in range(rounds):
        after = centroids.copy()
        for r in summed(centroids).collect():  # k rows
            after[r["cluster"]] = [int(s) // r["n"] for s in r["total"]]
        settled = (after == centroids).all()
        centroids = after
        if settled:  # later rounds would give the same
            break
    centre = apexes(base, centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _parts(batches, components):
            near = nearest(x, _matrix(part.column(2), width, np.float64), centroids, centre)
            d = x - centroids[near]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(near.astype(np.int32)), pa.array(np.einsum("ij,ij->i", d, d))], names=["vec_id", "cluster", "distance"])

    found = stored(cached.mapInArrow(assigned, "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(j, d, sum(inertia.values()), digest[j]) for j, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows are broadcast
