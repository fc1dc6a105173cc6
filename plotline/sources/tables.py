"""Sequence store, text-source files, routed and split sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.functions import text as X
from plotline.operators.matching import unpivot_sources
from plotline.operators.release import private_rows, public_rows


def write_sequences(ordered: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store clips in sequence order.

    Range partitioning on (movie, pos) keeps a sequence in neighbouring files and cuts a very long one over several;
    min/max statistics then let a reader of one movie skip all other files. A folder per movie would not scale.
    """
    ordered.repartitionByRange("movie", "pos").sortWithinPartitions("movie", "pos").write.mode(mode).parquet(path)


def read_sequences(spark: SparkSession, path: str, movie: str | None = None) -> DataFrame:
    """Stored clips; the movie filter reaches the scan."""
    rows = spark.read.parquet(path)
    return rows if movie is None else rows.filter(F.col("movie") == movie)


def read_text_sources(spark: SparkSession, path: str, sources: Sequence[str]) -> DataFrame:
    """Wide CSV (movie, start, end, ground_truth and one column per source) as long rows with numeric times."""
    wide = spark.read.csv(path, header=True, quote='"', escape='"', encoding="UTF-8")
    wide = wide.toDF(*[c.lstrip("﻿") for c in wide.columns])
    place = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = wide.select(
        F.col("start").cast("double").alias("r_start"), F.col("end").cast("double").alias("r_end"),
        X.sequence_key(F.col("movie")).alias("key"), X.strip(F.coalesce("ground_truth", F.lit(""))).alias("ground_truth"),
        place.alias("ord"), *[F.col(f"`{s}`") for s in sources if s in wide.columns])
    return unpivot_sources(rows, ["ord", "key", "r_start", "r_end", "ground_truth"], sources)


def write_routed(rows: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per route."""
    rows.write.mode(mode).partitionBy("route").json(path)


def write_splits(examples: DataFrame, split: Column, path: str, mode: str = "errorifexists") -> None:
    """Raw, public and private rows, each with one folder per split."""
    named = examples.withColumn("_split", split)
    named.withColumn("part", F.col("_split")).drop("_split").write.mode(mode).partitionBy("part").json(f"{path}/raw")
    for name, project in (("public", public_rows), ("private", private_rows)):
        project(named, F.col("_split")).write.mode(mode).partitionBy("split").json(f"{path}/{name}")
