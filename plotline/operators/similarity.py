"""Continuity features between a context and its target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions import domains as D
from plotline.functions import text as X


def tfidf_cosine(pairs: DataFrame, keys: Sequence[str], left: str, right: str, out: str = "similarity") -> DataFrame:
    """Cosine of two texts with idf 1 for shared tokens and 1 + ln 2 for one-sided ones; one row per pair key.

    Tokens of both sides are counted in one aggregation on (pair, token), summed once more per pair; both are
    combined on the map side and neither depends on how long a text is. A side without tokens leaves one empty row, so
    every pair comes out without being joined back.
    """
    sides = pairs.select(*keys, F.explode(F.array(
        F.struct(F.lit(1).alias("is_left"), X.content_tokens(F.col(left)).alias("toks")),
        F.struct(F.lit(0).alias("is_left"), X.content_tokens(F.col(right)).alias("toks")),
    )).alias("s"))
    token_rows = sides.select(*keys, F.col("s.is_left").alias("is_left"), F.explode_outer("s.toks").alias("tok"))
    counted = token_rows.groupBy(*keys, "tok").agg(
        F.count_if(F.col("tok").isNotNull() & (F.col("is_left") == 1)).alias("a"),
        F.count_if(F.col("tok").isNotNull() & (F.col("is_left") == 0)).alias("b"))
    idf = F.when((F.col("a") > 0) & (F.col("b") > 0), F.lit(1.0)).otherwise(F.lit(D.ONE_SIDED_IDF))
    sums = counted.groupBy(*keys).agg(
        F.sum(F.col("a") * idf * F.col("b") * idf).alias("_dot"),
        F.sum(F.pow(F.col("a") * idf, F.lit(2))).alias("_aa"),
        F.sum(F.pow(F.col("b") * idf, F.lit(2))).alias("_bb"),
    )
    norm = F.sqrt("_aa") * F.sqrt("_bb")
    return sums.select(*keys, F.when(norm > 0, F.col("_dot") / norm).otherwise(0.0).alias(out))


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays, in double precision; null if a norm is zero."""
    wide_a, wide_b = a.cast("array<double>"), b.cast("array<double>")

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(wide_a, wide_b), F.sqrt(dot(wide_a, wide_a)) * F.sqrt(dot(wide_b, wide_b)))


def semantic_similarity(pairs: DataFrame, keys: Sequence[str], left: str, right: str, left_vector: str, right_vector: str) -> DataFrame:
    """Vector cosine where both vectors exist, TF-IDF cosine elsewhere; ``backend`` tells which."""
    texts = tfidf_cosine(pairs.filter(F.col(left_vector).isNull() | F.col(right_vector).isNull()), keys, left, right)
    vectors = pairs.filter(F.col(left_vector).isNotNull() & F.col(right_vector).isNotNull()).select(
        *keys, vector_cosine(F.col(left_vector), F.col(right_vector)).alias("similarity"))
    return vectors.withColumn("backend", F.lit("vectors")).unionByName(texts.withColumn("backend", F.lit("tfidf_fallback")))


def overlap_ratio(left: Column, right: Column) -> Column:
    """Share of the right set that is in the left set; 0 for an empty right set."""
    goal = F.array_distinct(right)
    return F.when(F.size(goal) == 0, 0.0).otherwise(F.size(F.array_intersect(left, goal)) / F.size(goal))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words over the smaller of two word sets; 0 if either is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), smaller))


def text_overlap(a: Column, b: Column) -> Column:
    return word_overlap(X.word_set(a), X.word_set(b))


def lexicon_overlaps(a: Column, b: Column) -> dict[str, Column]:
    """Entity, action and location overlap of two token lists (context, target)."""
    return {
        "entity_overlap": overlap_ratio(
            F.array_union(X.people(a), X.objects(a)), F.array_union(X.people(b), X.objects(b))),
        "action_overlap": overlap_ratio(X.actions(a), X.actions(b)),
        "location_overlap": overlap_ratio(X.locations(a), X.locations(b)),
    }
