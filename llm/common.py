"""Helpers that several operators share: stored intermediates, gapless ranks, connected components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotline.session import scratch_path

#: Words as every contract here defines them.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, so a lost executor costs one read, not a rerun."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, last: Sequence[str] = ()) -> DataFrame:
    """Add a gapless rank from 0 within each group, without ever having one group in one task.

    Rows of a group are dealt into buckets by a hash of the order columns; buckets are counted (pre-aggregated before the
    shuffle), their offsets summed per group (one row per bucket), and only rows of one bucket are sorted together. The rank
    follows (bucket, order, last), where ``last`` only settles ties. Group and order columns must not be null; ``df`` is read
    twice, so it should be stored.
    """
    n = 2 * partitions(df.sparkSession)
    cut = f"__{name}_bucket"
    keys = [*group, cut]
    dealt = df.withColumn(cut, F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *last)) - 1
    return (
        dealt.withColumn("__in", inner.cast("long")).join(offsets, keys, "inner")
        .withColumn(name, F.col("__in") + F.col("__before")).drop("__in", "__before", cut)
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that occurs in ``edges`` (a long, b long); the component is its smallest id.

    Contraction: each vertex hooks to its smallest neighbour (or itself), edges are rewritten to the labels, loops and
    repeats vanish. At least half of the vertices that still have edges go each round. Only edges are shuffled; a vertex
    with many neighbours is pre-aggregated by ``min``, and both sides of every join are stored tables, so that adaptive
    execution can split a hot key.
    """
    left = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("to")), "hooks")
        maps.append(hook)
        step = left.join(hook.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a").join(
            hook.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
        left = stored(step.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct(), "edges")
    if not maps:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    out = maps[0].select("id", F.col("to").alias("component"))
    for hook in maps[1:]:
        nxt = hook.select(F.col("id").alias("component"), F.col("to").alias("__to"))
        out = out.join(nxt, "component", "left").select("id", F.coalesce("__to", "component").alias("component"))
    return out


def lower_ascii(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stars(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links (i, j) among ``n`` places: each place that is not the first of its connected part, and that first place."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new[label]]
        if (new == label).all():
            break
        label = new
    s = np.flatnonzero(label != np.arange(n))
    return s, label[s]
