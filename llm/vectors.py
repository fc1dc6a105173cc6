"""Near-duplicate vectors: int8 tile products with error bounds, full precision only where a pair may reach the threshold.

Identical vectors of a label are one representative with a count. Representatives of a label are dealt into blocks of about
``BLOCK`` rows by a hash; a task gets two blocks and multiplies their int8 forms (exact integer sums). For unit vectors u, w with
quantisation errors e, f (Euclidean) the product differs from the cosine by at most e + f + e*f, so a pair is recomputed in double
precision only if product + bound reaches the threshold; no pair above it can be missed. A task returns link counts and a star
per connected part, never its pairs.

Edge cases: a vector that is null, empty, zero, or has null or non-finite components, and one with a null label or vec_id, links
with nothing and stays; vectors of different lengths are not compared; repeated rows count as further vectors. An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import components, stars, stored

THRESHOLD = 0.93
BLOCK = 1024
#: Pairs recomputed at a time.
STEP = 1 << 15
_FOUND = "a long, b long, links long"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 values (as float32, whose products of up to 1000 components are exact), scales and error norms of unit rows."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None])
    error = np.linalg.norm(x - q * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return q.astype(np.int8), scale, error


def links(xa: np.ndarray, xb: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with a cosine of at least ``threshold``; for one block with itself each pair once."""
    na, nb = np.linalg.norm(xa, axis=1), np.linalg.norm(xb, axis=1)
    qa, sa, ea = quantised(xa / na[:, None])
    qb, sb, eb = (qa, sa, ea) if same else quantised(xb / nb[:, None])
    kind = np.float32 if xa.shape[1] * 127 * 127 < 1 << 24 else np.float64
    most = (qa.astype(kind) @ qb.astype(kind).T) * (sa[:, None] * sb[None, :]) + (ea[:, None] + eb[None, :] + ea[:, None] * eb[None, :])
    maybe = most >= threshold
    if same:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    keep = np.zeros(len(i), dtype=bool)
    for k in range(0, len(i), STEP):
        a, b = i[k : k + STEP], j[k : k + STEP]
        keep[k : k + STEP] = np.einsum("ij,ij->i", xa[a], xb[b]) / (na[a] * nb[b]) >= threshold
    return i[keep], j[keep]


def _tile(table: pa.Table, threshold: float) -> pa.Table:
    rep, n, block = (table.column(c).to_numpy() for c in ("rep", "n", "block"))
    x = np.stack(table.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large components leave the doubles
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    p, q = links(x[a], x[b], threshold, i == j) if len(a) and len(b) else (np.zeros(0, int), np.zeros(0, int))
    p, q = a[p], b[q]
    count = np.bincount(p, n[q], len(rep)) + np.bincount(q, n[p], len(rep))
    has = np.flatnonzero(count)
    s, t = stars(len(rep), p, q)
    none = np.full(len(has), -1)
    left, right = np.concatenate([rep[has], rep[s]]), np.concatenate([none, rep[t]])
    number = np.concatenate([count[has], np.zeros(len(s))]).astype(np.int64)
    edge = np.concatenate([np.zeros(len(has), bool), np.ones(len(s), bool)])
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right.astype(np.int64), mask=~edge), "links": pa.array(number, mask=edge)})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector; ``vectors`` has vec_id, embedding, label."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select("vec_id", "label", F.when(F.coalesce(sound, F.lit(False)), F.col("embedding")).alias("embedding"))
    reps = rows.where("embedding is not null").groupBy("label", "embedding").agg(F.min("vec_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = stored(reps.withColumn("dim", F.size("embedding")), "vectors")
    sizes = reps.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    dealt = reps.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "embedding")
    found = stored(tiles.groupBy("label", "dim", "i", "j").applyInArrow(lambda t: _tile(t, threshold), _FOUND), "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "rep")
    out = rows.join(reps.drop("dim"), ["label", "embedding"], "left").select("vec_id", "rep", "n").join(counts, "rep", "left").join(parts, "rep", "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
                      component.cast("long").alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
