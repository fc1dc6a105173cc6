"""Reports: score summaries, top values, failure reasons, stage funnel, route and split counts, source tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions import domains as D
from plotline.functions import labels as L
from plotline.operators.ordering import exact_median


def score_summary(rows: DataFrame, value: str = "expectedness") -> DataFrame:
    low, high = D.EXPECTEDNESS_RANGE
    median = exact_median(rows.select(value), value)
    v = F.col(value)
    return rows.agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(v).alias("mean"),
        F.lit(median).cast("double").alias("median"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count_if(v > high).alias("above"),
        F.count_if(v.between(low, high)).alias("between"),
        F.count_if(v < low).alias("below"),
        F.count_if(v.isNull()).alias("nulls"),
    )


def score_by_label(rows: DataFrame, value: str = "expectedness", labels: str = "reasoning_type") -> DataFrame:
    listed = F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, F.col(labels)).otherwise(F.array(F.lit("unknown")))
    return rows.select(F.explode(listed).alias("label"), value).groupBy("label").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col(value).isNull()).alias("nulls"), F.avg(value).alias("mean"))


def top_values(rows: DataFrame, paths: Mapping[str, Column], n: int = 8) -> DataFrame:
    """Most frequent values of each path (array of strings per path); ties by value."""
    tagged = rows.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("path"), values.alias("vals")) for name, values in paths.items()
    ])).alias("p"))
    counted = (
        tagged.select("p.path", F.explode("p.vals").alias("value"))
        .withColumn("value", F.coalesce("value", F.lit("None")))
        .groupBy("path", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    best = Window.partitionBy("path").orderBy(F.desc("n"), "value")
    return counted.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= n).drop("_r")


def failure_reasons(rows: DataFrame, reasons: str = "failure_reasons") -> DataFrame:
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def stage_funnel(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per stage; an empty stage counts 0."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in stages.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def scaling_table(gains: DataFrame, labels: Mapping[str, str], excluded: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Gain rows under display names, without excluded sources, in display order then by k."""
    rank = F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(x) for i, name in enumerate(order) for x in (name, i)]), F.col("label")), F.lit(99))
    named = gains.withColumn("label", L.display_source(F.col("source"), dict(labels)))
    return named.filter(~F.col("label").isin(*excluded)).withColumn("label_rank", rank).orderBy("label_rank", "k")
