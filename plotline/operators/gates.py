"""Quality gates, challenge routing, the kept cap and text quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions import domains as D
from plotline.functions import labels as L
from plotline.functions import scalars as S
from plotline.functions import text as X

OVERFLOW_REASON = "overflow beyond pilot max_examples"


def validation_scores(rows: DataFrame, positive_default: float = D.QUALITY_THRESHOLD) -> DataFrame:
    """Normalise a validator's answer; omitted scores of a clean positive answer are raised to the default.

    Reads ``v_keep, v_confidence, v_sufficiency, v_distractor`` (strings), ``failure_reasons`` (array) and the
    existing ``sufficiency`` (string).
    """
    existing = S.loose_double(F.col("sufficiency"))
    keep = F.coalesce(S.loose_bool(F.col("v_keep")), F.lit(False))
    clean = keep & (F.coalesce(F.size("failure_reasons"), F.lit(0)) == 0)
    confidence = S.loose_double(F.col("v_confidence"))
    sufficiency = S.loose_double(F.col("v_sufficiency"), existing)
    distractor = S.loose_double(F.col("v_distractor"))

    def raised(value: Column, floor: Column | float) -> Column:
        floor = floor if isinstance(floor, Column) else F.lit(floor)
        return F.when(clean, F.greatest(value, floor)).otherwise(value)

    return (
        rows.withColumn("should_keep", keep)
        .withColumn("qwen_confidence", raised(confidence, positive_default))
        .withColumn("evidence_sufficiency", raised(sufficiency, existing))
        .withColumn("distractor_quality", raised(distractor, positive_default))
    )


def without_model(rows: DataFrame, errors: str = "errors") -> DataFrame:
    """Validation when no model is at hand: schema errors reject with zero scores, a valid row keeps its own."""
    bad = F.size(errors) > 0
    scores = ("qwen_confidence", "evidence_sufficiency", "distractor_quality")
    return rows.withColumns(
        {s: F.when(bad, 0.0).otherwise(F.col(s)) for s in scores}
        | {"should_keep": F.col("should_keep") & ~bad, "failure_reasons": F.col(errors)})


def reason_list(value: Column) -> Column:
    """A scalar failure reason becomes a list of one; null stays empty."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value))


def quality_pass(threshold: float = D.QUALITY_THRESHOLD) -> Column:
    return (
        (F.col("qwen_confidence") >= threshold)
        & (F.col("evidence_sufficiency") >= threshold)
        & (F.col("distractor_quality") >= threshold)
    )


def expectedness_pass(enabled: bool = False, low: float = D.EXPECTEDNESS_RANGE[0], high: float = D.EXPECTEDNESS_RANGE[1]) -> Column:
    return F.coalesce(F.col("expectedness").between(low, high), F.lit(False)) if enabled else F.lit(True)


def oracle_pass() -> Column:
    return F.col("should_keep") & ~F.array_contains("failure_reasons", "multi_answer")


def grounding_pass() -> Column:
    return ~F.array_join("failure_reasons", " ").contains("context does not support")


def main_gate(filter_by_expectedness: bool = False, threshold: float = D.QUALITY_THRESHOLD) -> Column:
    return F.coalesce(
        F.col("target_type").isin(*D.TARGET_TYPES)
        & (F.col("target_triviality") == "nontrivial")
        & (F.col("predictability") == "predictable")
        & (F.size("evidence") > 0)
        & (F.size("evidence_clip_ids") > 0)
        & (F.size("failure_reasons") == 0)
        & quality_pass(threshold)
        & expectedness_pass(filter_by_expectedness)
        & F.col("should_keep"),
        F.lit(False),
    )


def to_challenge() -> Column:
    return F.coalesce(
        F.coalesce(F.col("predictability").isin("underdetermined", "unpredictable"), F.lit(False))
        | F.coalesce(F.col("continuity_type") == "scene_cut_semantically_linked", F.lit(False))
        | F.coalesce(F.col("target_triviality") == "meaningful_but_noninferable", F.lit(False)),
        F.lit(False),
    )


def gate_route(passes: Column) -> Column:
    return F.when(passes, "kept").when(to_challenge(), "challenge").otherwise("rejected")


def kept_cap(routed: DataFrame, limit: int, order: list[str], overflow_to: str = "rejected") -> DataFrame:
    """Only the first ``limit`` kept rows in ``order`` stay kept.

    The order key of row ``limit`` is one value, so the cap is a comparison, not a rank over all rows. The rest goes
    to ``rejected`` with one more failure reason, or is routed like any row that failed (``overflow_to="route"``).
    """
    key = F.struct(*order)
    edge = (
        routed.filter(F.col("route") == "kept").select(*order).orderBy(*order).limit(limit)
        .agg(F.max(key).alias("_edge")).scalar()
    )
    over = (F.col("route") == "kept") & (F.coalesce(key > edge, F.lit(True)) if limit > 0 else F.lit(True))
    target = F.lit("rejected") if overflow_to == "rejected" else F.when(to_challenge(), "challenge").otherwise("rejected")
    marked = routed.withColumn("_over", over).withColumn("route", F.when(F.col("_over"), target).otherwise(F.col("route")))
    if overflow_to == "rejected":
        marked = marked.withColumn("failure_reasons", F.when(
            F.col("_over"), F.array_append("failure_reasons", F.lit(OVERFLOW_REASON))).otherwise(F.col("failure_reasons")))
    return marked.drop("_over")


def normalize_candidates(rows: DataFrame) -> DataFrame:
    """Whole-row normaliser: labels, evidence and quality scalars in one projection."""
    reasoning = L.reasoning_types(F.col("reasoning_type"))
    return rows.withColumns({
        "question_type": L.question_type(F.col("question_type"), F.col("target_type")),
        "evidence": L.evidence_rows(F.col("evidence")),
        "reasoning_type": reasoning,
        "continuity_type": L.continuity_type(F.col("continuity_type"), reasoning),
        "qwen_confidence": S.loose_double(F.col("qwen_confidence")),
        "evidence_sufficiency": S.loose_double(F.col("evidence_sufficiency")),
        "distractor_quality": S.loose_double(F.col("distractor_quality")),
        "should_keep": F.coalesce(S.loose_bool(F.col("should_keep")), F.lit(False)),
    })


def quarantine_reason(text: Column, patterns=D.PRIVATE_SUBSTRINGS, allowed=D.ALLOWED_LINE_MARKERS) -> Column:
    """Reason of the first line with a private substring that carries no allow marker; null for clean text."""
    def allowed_line(line: Column) -> Column:
        found = F.lit(False)
        for marker in allowed:
            found = found | line["text"].contains(marker)
        return found

    def first_pattern(line: Column) -> Column:
        found = F.when(F.lit(False), F.lit(""))
        for pattern in reversed(patterns):
            found = F.when(line["text"].contains(pattern.lower()), F.lit(pattern)).otherwise(found)
        return F.when(line.isNotNull(), F.concat(F.lit("matched private/secret pattern '"), found, F.lit("'")))

    literal = "|".join(r"\Q" + p.lower() + r"\E" for p in patterns)
    hits = F.filter(X.lines_with(F.lower(text), literal), lambda line: ~allowed_line(line))
    return X.with_value(F.try_element_at(hits, F.lit(1)), first_pattern)
