"""Scored picks: diversified top-k, rule scores, comparison scores, weak and paraphrased items."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions import domains as D
from plotline.functions import text as X
from plotline.operators.similarity import word_overlap


def capped_topk(scored: DataFrame, group: str, per_group: int = 2, take: int = 8, trim: int = 6,
                score: str = "score", tie: str = "id") -> DataFrame:
    """Best rows with at most ``per_group`` of a group; the rank filter prunes before the shuffle."""
    rank = Window.partitionBy(group).orderBy(F.desc(score), tie)
    best = scored.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= per_group).drop("_r")
    return best.orderBy(F.desc(score), tie).limit(min(take, trim))


def capped_topk2(scored: DataFrame, first: str, second: str, per_first: int = 2, per_second: int = 4, take: int = 14,
                 trim: int = 10, min_score: float = 6, score: str = "score", then: str | None = None, tie: str = "id") -> DataFrame:
    """Greedy top-k under two caps, exact, over a row set whose size does not depend on the data.

    Rows with equal scores are ordered by ``then`` (largest first), if given, and by ``tie``.

    A row that is passed over is one whose ``first`` or ``second`` value is full, and full values stay full. So in a
    (first, second) cell only the best ``min(caps)`` rows can be taken. Among the rows of one ``second`` value, those
    passed over belong to full ``first`` values, of which there are at most ``take / per_first``; the same holds the
    other way round. What these bounds leave is folded in score order.
    """
    least = min(per_first, per_second)
    full_first, full_second = take // per_first, take // per_second
    reach_second = per_second + full_first * least
    reach_first = per_first + full_second * least
    few = (
        scored.filter(F.col(score) >= min_score)
        .select(F.col(score).alias("s"), (F.lit(0) if then is None else F.col(then)).cast("double").alias("e"), F.col(tie).alias("t"), F.col(first).alias("a"), F.col(second).alias("b"))
    )
    for keys, limit in ((("a", "b"), least), (("b",), reach_second), (("a",), reach_first)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("s"), F.desc("e"), "t"))
        few = few.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")
    head = few.orderBy(F.desc("s"), F.desc("e"), "t").limit(take + full_first * reach_first + full_second * reach_second)
    ordered = head.agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("n"), (-F.col("e")).alias("m"), "t", "a", "b"))).alias("rows"))
    kind = dict(few.dtypes)
    row = f"struct<n:double,m:double,t:{kind['t']},a:{kind['a']},b:{kind['b']}>"
    taken = F.aggregate(
        F.transform("rows", lambda r: F.struct(r["n"].cast("double").alias("n"), r["m"], r["t"], r["a"], r["b"])),
        F.array().cast(f"array<{row}>"),
        lambda acc, r: F.when(
            (F.size(acc) < take)
            & (F.size(F.filter(acc, lambda x: x["a"].eqNullSafe(r["a"]))) < per_first)
            & (F.size(F.filter(acc, lambda x: x["b"].eqNullSafe(r["b"]))) < per_second),
            F.array_append(acc, r),
        ).otherwise(acc),
    )
    best = ordered.select(F.posexplode(F.slice(taken, 1, trim)).alias("place", "r"))
    return best.select("place", F.col("r.t").alias(tie), F.col("r.a").alias(first), F.col("r.b").alias(second),
                       (-F.col("r.n")).alias(score))


def with_word_sets(rows: DataFrame) -> DataFrame:
    """Word sets of answer, target, context sentences and evidence spans, each made once per row."""
    return rows.withColumns({
        "answer_words": X.word_set(F.col("answer_text")),
        "target_words": X.word_set(F.col("target_sentence")),
        "context_words": F.transform("context_sentences", X.word_set),
        "evidence_words": F.transform("evidence", lambda e: X.word_set(e["span"])),
    })


def with_overlaps(rows: DataFrame) -> DataFrame:
    """Overlap of the answer with the hidden target and with its closest context sentence, and the bridge words.

    Bridge words are answer words that also occur in the evidence, or in the context if the evidence has no words.
    """
    closest = F.array_max(F.transform("context_words", lambda w: word_overlap(F.col("answer_words"), w)))
    spans = F.array_distinct(F.flatten("evidence_words"))
    around = F.array_distinct(F.flatten("context_words"))
    return rows.withColumns({
        "target_overlap": word_overlap(F.col("answer_words"), F.col("target_words")),
        "context_overlap": F.coalesce(closest, F.lit(0.0)),
        "bridge": F.array_intersect(F.when(F.size(spans) > 0, spans).otherwise(around), F.col("answer_words")),
    })


def evidence_supports(evidence_words: Column, answer_words: Column) -> Column:
    """Any evidence span shares a word with the answer."""
    return F.exists(evidence_words, lambda w: F.arrays_overlap(w, answer_words))


def _score(rules: Sequence[tuple[str, Column, float]]) -> tuple[Column, Column]:
    total, notes = F.lit(0.0), []
    for name, condition, weight in rules:
        held = F.coalesce(condition, F.lit(False))
        total = total + F.when(held, F.lit(float(weight))).otherwise(0.0)
        notes.append(F.when(held, F.lit(name)))
    return total, F.array_compact(F.array(*notes))


def rule_score(rows: DataFrame, main: str = "human", second: str = "alpha", none: str = "none") -> DataFrame:
    """Weighted rules for a good showcase item. Reads overlap columns and one correct flag per source."""
    t, c = F.col("target_overlap"), F.col("context_overlap")
    total, notes = _score([
        ("main_source_correct", F.col(main), 3),
        ("second_source_correct", F.col(second), 1),
        ("compact_context", F.size("context_sentences") <= 2, 2),
        ("expected", F.col("expectedness") >= 0.7, 2),
        ("evidence_supports_answer", evidence_supports(F.col("evidence_words"), F.col("answer_words")), 2),
        ("concrete_target", F.col("target_type").isin(*D.CONCRETE_TARGET_TYPES), 1),
        ("empty_context_sentence", F.exists("context_sentences", lambda s: F.length(s) == 0), -2),
        ("no_context_correct", F.col(none), -2),
        ("answer_paraphrases_target", t >= 0.6, -2),
        ("answer_resembles_context", (c > t + 0.1) & (c >= 0.3), -5),
        ("other_question_type", F.col("question_type") != "what_happens_next", -1),
        ("video_available", F.col("has_video"), 1),
    ])
    return rows.withColumns({"score": total, "notes": notes})


def comparison_score(rows: DataFrame, main: str, others: tuple[str, str], none: str) -> DataFrame:
    """Items the main source gets right, at least one other gets wrong, and nobody gets without context."""
    t, c = F.col("target_overlap"), F.col("context_overlap")
    x, y = F.col(others[0]), F.col(others[1])
    wanted = (
        F.col(main) & x.isNotNull() & y.isNotNull() & ~(x & y)
        & ~F.coalesce(F.col(none), F.lit(False))
        & ~((c > t + 0.1) & (c >= 0.3)) & (t >= 0.15)
    )
    total, notes = _score([
        ("first_other_wrong", ~x, 1.5),
        ("second_other_wrong", ~y, 1.5),
        ("both_others_wrong", ~x & ~y, 2),
        ("no_context_wrong", F.lit(True), 2),
        ("bridge_words", F.size("bridge") > 0, 1),
        ("first_other_drops_words", F.col("first_drops") > 0, 1.5),
        ("second_other_drops_words", F.col("second_drops") > 0, 1.5),
        ("compact_context", F.size("context_sentences") <= 2, 2),
    ])
    return rows.filter(wanted).withColumns({"score": total, "notes": notes})


def dropped_words(bridge: Column, reference: Column, other: Column) -> Column:
    """Bridge words the reference text has and the other text lacks."""
    return F.size(F.array_except(F.array_intersect(X.word_set(reference), bridge), X.word_set(other)))


def matching_ratio(a: Column, b: Column) -> Column:
    """Share of characters in the matching blocks of two texts in lower case, as Python's own ``difflib`` defines it: found longest
    first, and in texts of 200 and more characters without the most frequent ones. Texts go to Python in Arrow batches."""
    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right, strict=True)], dtype="float64")

    return ratio(F.lower(a), F.lower(b))


def near_paraphrases(rows: DataFrame, limit: float = 0.45) -> DataFrame:
    """Items whose right option repeats the hidden target: ``ratio`` above the limit. Items without either text are left out."""
    option = F.try_element_at("options", F.col("answer_idx") + 1)
    given = rows.filter((F.length(option) > 0) & (F.length("target_sentence") > 0))
    return given.withColumn("ratio", matching_ratio(option, F.col("target_sentence"))).filter(F.col("ratio") > limit)


def weak_reasons() -> Column:
    """Why an item is weak; reads ``distractor_quality, distractor_metadata, answer_idx, target_sentence,
    context_sentences`` and the word sets of answer and target."""
    wrong = F.filter(F.transform("distractor_metadata", lambda d, i: F.when(i != F.col("answer_idx"), d)), lambda d: d.isNotNull())

    def opening(sentence: Column) -> Column:
        return F.slice(F.split(F.trim(F.lower(sentence)), r"\s+"), 1, 3)

    return F.array_compact(F.array(
        F.when(F.col("distractor_quality") == 0, F.lit("distractor_quality_zero")),
        F.when((F.size(wrong) > 0) & (F.size(F.array_distinct(wrong)) <= 2), F.lit("few_distractor_types")),
        F.when(F.array_contains("distractor_metadata", "already_happened") & F.exists(
            "context_sentences", lambda s: opening(s) == opening(F.col("target_sentence"))), F.lit("target_repeats_context")),
        F.when(word_overlap(F.col("answer_words"), F.col("target_words")) >= 0.6,
               F.lit("answer_near_paraphrase")),
    ))


def paraphrase_items(rows: DataFrame, none: str, threshold: float = 0.7, fill: int = 5, have: int = 0) -> DataFrame:
    """Items solved without context whose answer is close to the target, best first, to fill up to ``fill``."""
    found = rows.filter(F.coalesce(F.col(none), F.lit(False)) & (F.col("target_overlap") >= threshold))
    return found.orderBy(F.desc("target_overlap"), "id").limit(max(0, fill - have))
