"""Sequence operators: look-ahead blocks, last-k prior context, gaps, strictly-prior filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions import domains as D
from plotline.functions import scalars as S
from plotline.operators.ordering import longest_group, neighbour_columns, positions

CLIP_FIELDS = ("clip_id", "sequence_index", "timestamp_start", "timestamp_end", "text")


def clip_order() -> list[Column]:
    """Start time (unparsable last), row number in the file, clip id."""
    return [S.safe_double(F.col("timestamp_start")).asc_nulls_last(), F.col("sequence_index"), F.col("clip_id")]


def order_clips(clips: DataFrame, longest: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Add the dense 0-based position ``pos`` of each clip in its movie."""
    return positions(clips, ["movie"], clip_order(), "pos", longest, hot_rows)


def clip_struct(fields=CLIP_FIELDS) -> Column:
    return F.struct(*[F.col(f) for f in fields])


def joined_text(clips: Column) -> Column:
    return F.array_join(F.transform(clips, lambda c: c["text"]), " ")


def search_blocks(ordered: DataFrame, width: int = 3, min_chars: int = D.MIN_BLOCK_CHARS, prefix: str = "seq",
                  max_blocks: int | None = None, longest: int | None = None, hot_rows: int | None = None,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """One block per start position with up to ``width`` clips ahead; blocks of too little text are dropped."""
    if width < 1:
        raise ValueError("width must be >= 1")
    if longest is None:
        longest = longest_group(ordered, ["movie"])
    framed = neighbour_columns(
        ordered, ["movie"], "pos",
        {"clips": lambda w: F.collect_list(clip_struct()).over(w.rowsBetween(0, width - 1))},
        before=0, after=width - 1, longest=longest, hot_rows=hot_rows,
    )
    end = F.col("pos") + F.size("clips") - 1
    blocks = framed.filter(F.length(F.trim(joined_text(F.col("clips")))) >= min_chars).select(
        F.concat_ws("::", F.lit(prefix), "movie", F.lit("block"),
                    F.format_string("%05d_%05d", F.col("pos"), end), F.lit(f"w{width}")).alias("block_id"),
        "movie",
        *keep,
        F.col("pos").alias("block_start"),
        end.alias("block_end"),
        F.lit(width).alias("max_window_clips"),
        "clips",
    )
    return blocks if max_blocks is None else blocks.orderBy("movie", "block_start").limit(max_blocks)


def prior_context(ordered: DataFrame, k: int = 8, out: str = "prior", fields=CLIP_FIELDS, longest: int | None = None,
                  hot_rows: int | None = None) -> DataFrame:
    """Up to ``k`` clips right before each clip, oldest first."""
    if k < 0:
        raise ValueError("k must be non-negative")
    if k == 0:
        return ordered.withColumn(out, F.slice(F.array(clip_struct(fields)), 1, 0))
    if longest is None:
        longest = longest_group(ordered, ["movie"])
    return neighbour_columns(
        ordered, ["movie"], "pos",
        {out: lambda w: F.collect_list(clip_struct(fields)).over(w.rowsBetween(-k, -1))},
        before=k, after=0, longest=longest, hot_rows=hot_rows,
    )


def contexts_of(examples: DataFrame, ordered: DataFrame, k: int = 8, longest: int | None = None,
                hot_rows: int | None = None) -> DataFrame:
    """Add ``prior`` to examples that name their target by sequence number or, where that is null, by clip id.

    The frame counts by sequence number, not by time: it holds the ``k`` clips with the largest numbers below the target's. Where
    a number or an id occurs twice in a movie, its first clip counts. Joins are on (movie, clip), never on the movie alone. A
    target that is not in its sequence makes the job fail.
    """
    by_number = positions(ordered.withColumnRenamed("pos", "_time"), ["movie"], [F.col("sequence_index"), F.col("_time")], "pos", longest, hot_rows)
    framed = prior_context(by_number, k, "prior", longest=longest, hot_rows=hot_rows)
    frames = framed.groupBy("movie", "sequence_index").agg(F.min_by("prior", "pos").alias("prior"))
    by_id = ordered.groupBy("movie", F.col("clip_id").alias("target_clip_id")).agg(F.min_by("sequence_index", "pos").alias("_found"))
    located = examples.join(by_id, ["movie", "target_clip_id"], "left").withColumn(
        "_index", F.coalesce("target_index", "_found"))
    joined = located.join(frames.select("movie", F.col("sequence_index").alias("_index"), "prior"), ["movie", "_index"], "left")
    lost = F.raise_error(F.concat(F.lit("could not locate target sequence index for "), F.col("id")))
    return joined.withColumn("prior", F.when(F.col("prior").isNull(), lost.cast(joined.schema["prior"].dataType)).otherwise(
        F.col("prior"))).drop("_found", "_index")


def last_k(prior: Column, k: Column | int) -> Column:
    """Last ``k`` entries of an array that may be shorter than ``k``."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.slice(prior, F.greatest(F.size(prior) - k + 1, F.lit(1)), k)


def strictly_prior(context: Column, target_index: Column) -> Column:
    """Context entries before the target; entries without an index stay, and so does everything without a target index."""
    return F.filter(
        context,
        lambda c: target_index.isNull() | c["sequence_index"].isNull() | (c["sequence_index"] < target_index),
    )


def timestamp_gap(context: Column, target_start: Column) -> Column:
    """Target start minus the end of the last context clip; null when either is missing."""
    return S.safe_double(target_start) - S.safe_double(F.try_element_at(context, F.lit(-1))["timestamp_end"])
