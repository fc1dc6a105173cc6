"""Prediction scoring: accuracy, distributions, per-group and macro accuracy, context gain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_predictions(predictions: DataFrame, keys: Sequence[str], value: str = "prediction", order: str = "ord") -> DataFrame:
    """One prediction per id; the last in file order wins, also when it is null."""
    return predictions.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def run_metrics(examples: DataFrame, predictions: DataFrame, run: Sequence[str] = (), value: str = "prediction",
                order: str = "ord") -> DataFrame:
    """Per run: examples, distinct prediction ids, missing, correct, accuracy.

    Predictions are joined to the examples once for all runs; an example nobody answered shows up only in the total,
    so examples are never copied per run.
    """
    latest = last_predictions(predictions, [*run, "id"], value, order)
    total = examples.agg(F.count(F.lit(1))).scalar()
    hit = latest.join(examples.select("id", "answer_idx"), "id", "left")
    known = F.col("answer_idx").isNotNull() & F.col(value).isNotNull()
    counts = hit.groupBy(*run).agg(
        F.count(F.lit(1)).alias("num_predictions"),
        F.count_if(known).alias("_answered"),
        F.count_if(known & (F.col(value) == F.col("answer_idx"))).alias("num_correct"),
    )
    return counts.select(
        *run,
        total.alias("num_examples"),
        "num_predictions",
        (total - F.col("_answered")).alias("num_missing"),
        "num_correct",
        F.coalesce(F.try_divide(F.col("num_correct"), total), F.lit(0.0)).alias("accuracy"),
    )


def source_metrics(examples: DataFrame, predictions: DataFrame, run: Sequence[str], value: str = "prediction",
                   order: str = "ord") -> DataFrame:
    """Run metrics over valid predictions only, plus the number of invalid rows among all rows."""
    valid = run_metrics(examples, predictions.filter(F.col(value).isNotNull()), run, value, order)
    invalid = predictions.groupBy(*run).agg(F.count_if(F.col(value).isNull()).alias("num_invalid"))
    # A run without a valid prediction has no row on the left, but its invalid ones count.
    total = examples.agg(F.count(F.lit(1))).scalar()
    nothing = {"num_predictions": F.lit(0), "num_correct": F.lit(0), "accuracy": F.lit(0.0), "num_examples": total, "num_missing": total}
    both = invalid.join(valid, list(run), "left")
    return both.withColumns({c: F.coalesce(c, v) for c, v in nothing.items()}).select(*valid.columns, "num_invalid")


def label_distribution(examples: DataFrame, predictions: DataFrame, value: str = "prediction", order: str = "ord") -> DataFrame:
    """Counts of gold labels and of predicted labels (known ids, non-null)."""
    gold = examples.groupBy(F.col("answer_idx").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    latest = last_predictions(predictions, ["id"], value, order).filter(F.col(value).isNotNull())
    said = (
        latest.join(examples.select("id"), "id", "left_semi")
        .groupBy(F.col(value).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    )
    return gold.withColumn("kind", F.lit("gold")).unionByName(said.withColumn("kind", F.lit("prediction")))


def group_accuracy(examples: DataFrame, predictions: DataFrame, group: str = "movie", value: str = "prediction",
                   order: str = "ord") -> DataFrame:
    """Accuracy per group; a missing prediction is wrong."""
    latest = last_predictions(predictions, ["id"], value, order)
    joined = examples.select("id", group, "answer_idx").join(latest, "id", "left")
    return joined.groupBy(group).agg(
        F.count_if(F.col(value) == F.col("answer_idx")).alias("num_correct"),
        F.count(F.lit(1)).alias("num_examples"),
    ).withColumn("accuracy", F.col("num_correct") / F.col("num_examples"))


def macro_accuracy(examples: DataFrame, predictions: DataFrame, run: Sequence[str], group: str = "movie",
                   value: str = "prediction", order: str = "ord") -> DataFrame:
    """Unweighted mean of the group accuracies of each run."""
    sizes = examples.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    groups = sizes.agg(F.count(F.lit(1))).scalar()
    latest = last_predictions(predictions, [*run, "id"], value, order)
    right = (
        latest.join(examples.select("id", group, "answer_idx"), "id")
        .groupBy(*run, group).agg(F.count_if(F.col(value) == F.col("answer_idx")).alias("_right"))
    )
    return right.join(sizes, group).groupBy(*run).agg(
        (F.sum(F.col("_right") / F.col("_size")) / F.max(groups)).alias("macro_accuracy"),
        F.sum("_right").alias("num_correct"),
    )


def context_gain(runs: DataFrame, source: str = "source", k: str = "k", shared_accuracy: Column | float | None = None,
                 best_accuracy: float | None = None) -> DataFrame:
    """Accuracy minus accuracy without context, per source and context length.

    ``runs`` has ``source, k, accuracy``. The baseline is the source's own k = 0 row, or one shared value. With a best
    reachable accuracy the gain is also given as a share of it.
    """
    if shared_accuracy is None:
        # One row per context length, so a source's window stays tiny and the runs are computed once.
        own = F.max(F.when(F.col(k) == 0, F.col("accuracy"))).over(Window.partitionBy(source))
        rows = runs.withColumn("acc0", own)
        acc0 = F.coalesce("acc0", F.raise_error(F.concat(F.lit("source without a k=0 row: "), F.col(source))).cast("double"))
    else:
        rows, acc0 = runs, shared_accuracy if isinstance(shared_accuracy, Column) else F.lit(float(shared_accuracy))
    gained = rows.withColumn("acc0", acc0).withColumn("gain", F.col("accuracy") - F.col("acc0"))
    gained = gained.withColumn("gain_points", 100.0 * F.col("gain"))
    if best_accuracy is None:
        return gained
    room = F.lit(float(best_accuracy)) - F.col("acc0")
    return gained.withColumn("normalized_gain", F.when(room != 0, F.col("gain") / room))


def gain_area(gains: DataFrame, source: str = "source", k: str = "k") -> DataFrame:
    """Mean normalised gain over all context lengths but 0."""
    return gains.filter(F.col(k) != 0).groupBy(source).agg(F.avg("normalized_gain").alias("gain_area"))


def outcome_pivot(outcomes: DataFrame, sources: Sequence[str], key: str = "id", source: str = "source") -> DataFrame:
    """One row per id with a correct flag per source; null where a source has no prediction."""
    return outcomes.groupBy(key).pivot(source, list(sources)).agg(F.max("correct"))
