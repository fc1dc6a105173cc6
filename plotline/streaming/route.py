"""Incremental route-and-append: new rows only, one sink per route, restartable.

Below the target lie the rows (``batch=.../route=...``), the ids seen (``_seen/slot=.../bucket=.../batch=...``) and one line of
counts a batch (``_progress/batch=...``). A batch is named by its checkpoint and its number, and each of its three folders is
replaced when it is written again, so a replay changes nothing. Rows in the sink are never read: a batch looks only at ids of
its own buckets, and with an expiry only at recent ones, so its cost does not grow with the sink.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Buckets of ids, and seconds of the time slots that expire as a whole.
BUCKETS, SLOT = 64, 3600
ROUTES = ("kept", "challenge", "rejected", "selected")


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows already below a path; none before the first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def first_rows(rows: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in ``order``, reduced in the tasks, so that a key with many rows is no burden."""
    whole = F.struct(*rows.columns)
    best = F.min_by(whole, F.struct(*order, F.xxhash64(*rows.columns)) if order else F.xxhash64(*rows.columns))
    return rows.groupBy(F.col(key).alias("_key")).agg(best.alias("_row")).select("_row.*")


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def route_stream(spark: SparkSession, source: DataFrame, route: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "id",
                 order: Sequence[str | Column] = (), expiry: int | None = None, routes: Sequence[str] = ROUTES):
    """Run all waiting input through ``route`` (adds a ``route`` column) and append it, partitioned by batch and route.

    Of rows that share a key the first one stays: that of the earliest batch, and within a batch the first in ``order``. With
    ``expiry`` a key counts as new again after so many seconds. Counts of the rows written come from the write itself.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def replace(rows: DataFrame, path: str, by: Sequence[str]) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    def append(batch: DataFrame, epoch: int) -> None:
        session, name, slot = batch.sparkSession, f"{run}-{epoch}", int(time.time()) // SLOT
        rows = first_rows(route(batch), key, order).withColumn("_bucket", _bucket(key)).persist()
        try:
            buckets = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most BUCKETS numbers
            if not buckets:
                return
            kind = dict(rows.dtypes)[key]
            seen = written(session, f"{target}/_seen", f"`{key}` {kind}, slot long, bucket int, batch string")
            seen = seen.filter(F.col("bucket").isin(buckets) & (F.col("batch") != name))
            if expiry is not None:
                seen = seen.filter(F.col("slot") >= slot - -(-expiry // SLOT))
            fresh = rows.join(seen.select(F.col(key).alias("_seen")), F.col(key).eqNullSafe(F.col("_seen")), "left_anti").withColumn("batch", F.lit(name))
            counted = Observation(f"routed-{name}")
            parts = [F.count_if(F.col("route") == r).alias(r) for r in routes]
            observed = fresh.drop("_bucket").observe(counted, F.count(F.lit(1)).alias("_all"), *parts)
            replace(observed, target, ("batch", "route"))
            got = counted.get
            replace(fresh.select(key, F.lit(slot).alias("slot"), F.col("_bucket").alias("bucket"), "batch"), f"{target}/_seen", ("slot", "bucket", "batch"))
            counts = [(r, got[r]) for r in routes] + [("other", got["_all"] - sum(got[r] for r in routes))]
            replace(session.createDataFrame([(r, n, name) for r, n in counts if n], "route string, n long, batch string").coalesce(1), f"{target}/_progress", ("batch",))
        finally:
            rows.unpersist()

    return (
        source.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def progress(spark: SparkSession, target: str, total: int | None = None) -> DataFrame:
    """Rows per route and, against the number of keys in all, rows still waiting; read from the counts, not from the sink."""
    done = written(spark, f"{target}/_progress", "route string, n long, batch string")
    routed = done.groupBy("route").agg(F.sum("n").alias("n"))
    if total is None:
        return routed
    waiting = done.agg((F.lit(total) - F.coalesce(F.sum("n"), F.lit(0))).alias("n")).select(F.lit("remaining").alias("route"), "n")
    return routed.unionByName(waiting)
