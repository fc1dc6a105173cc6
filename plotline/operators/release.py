"""Assembly and projections of benchmark rows: candidates, public/private rows, release rows, question blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions import domains as D
from plotline.functions import labels as L
from plotline.functions import scalars as S
from plotline.functions import text as X

PUBLIC_COLUMNS = (
    "id", "movie", "target_clip_id", "target_sentence", "context_clip_ids", "context_sentences", "question_type",
    "question", "options", "predictability", "expectedness", "target_type", "evidence_clip_ids",
)


def public_rows(examples: DataFrame, split: Column) -> DataFrame:
    return examples.select(*PUBLIC_COLUMNS, F.concat(split, F.lit("_public")).alias("split"))


def private_rows(examples: DataFrame, split: Column) -> DataFrame:
    return examples.select(
        *PUBLIC_COLUMNS,
        F.concat(split, F.lit("_private")).alias("split"),
        "answer_idx",
        "answer_text",
        F.struct(F.lit("target_sentence").alias("source"), "target_clip_id", "target_sentence").alias("answer_source"),
    )


def prior_context(ids: Column, sentences: Column) -> Column:
    """Ids and sentences zipped into objects; the job fails if they do not align."""
    zipped = F.zip_with(ids, sentences, lambda i, t: F.struct(i.alias("clip_id"), t.alias("text")))
    return F.when(F.size(ids) == F.size(sentences), zipped).otherwise(
        F.raise_error(F.lit("context_clip_ids and context_sentences do not align")).cast(
            "array<struct<clip_id:string,text:string>>"))


def clean_evidence(evidence: Column) -> Column:
    """Evidence with both clip id and span; null if nothing is left."""
    kept = F.filter(evidence, lambda e: (F.length(e["clip_id"]) > 0) & (F.length(e["span"]) > 0))
    return F.when(F.size(kept) > 0, kept)


def release_public(examples: DataFrame) -> DataFrame:
    context = prior_context(F.col("context_clip_ids"), F.col("context_sentences"))
    return examples.select(
        "id", F.col("movie").alias("source_id"), context.alias("prior_context"), "question", "options", "question_type",
        "target_type", F.size("context_clip_ids").alias("context_length"), "expectedness")


def release_with_answers(examples: DataFrame) -> DataFrame:
    context = prior_context(F.col("context_clip_ids"), F.col("context_sentences"))
    return examples.select(
        "id", F.col("movie").alias("source_id"), context.alias("prior_context"), "question", "options", "question_type",
        "target_type", F.size("context_clip_ids").alias("context_length"), "expectedness", "answer_idx", "answer_text",
        F.col("target_sentence").alias("hidden_target_ad"), clean_evidence(F.col("evidence")).alias("evidence"),
        "distractor_metadata")


def answer_index(value: Column, options: Column, answer: Column, answer_text: Column) -> Column:
    """Index from a digit, a letter A-D or the option's wording; then the same from ``answer`` and ``answer_text``.

    A digit string settles the matter even when it is out of range.
    """
    def digits(raw: Column) -> Column:
        return X.strip(raw).rlike(r"^\d+$")

    def direct(raw: Column) -> Column:
        text = X.strip(raw)
        number = text.try_cast("bigint")
        at = F.array_position(F.transform(options, X.strip), text)
        return (
            F.when(digits(raw), F.when(number.between(0, 3), number.cast("int")))
            .when(text.rlike("^[A-Da-d]$"), F.ascii(F.upper(text)) - F.ascii(F.lit("A")))
            .when(at > 0, (at - 1).cast("int"))
        )

    last = direct(answer_text)
    second = F.when(digits(answer), direct(answer)).otherwise(F.coalesce(direct(answer), last))
    return F.when(digits(value), direct(value)).otherwise(F.coalesce(direct(value), second))


def question_blocks(raw: DataFrame) -> DataFrame:
    """Normalise question answers of a model.

    Reads ``choices`` (map or null), ``options``, ``answer_idx`` and ``answer`` (strings), ``answer_text``,
    ``choice_labels`` (map or null), ``distractor_metadata`` (array), ``question_type``, ``target_type``. Rows without
    four options or a usable answer get an ``error`` and no options.
    """
    keys = F.array_sort(F.map_keys("choices"))
    given = F.col("choices").isNotNull()
    by_key = F.transform(keys, lambda k: F.element_at("choices", k))
    key_at = F.array_position(keys, F.coalesce("answer", F.lit("A")))
    key_index = F.when(F.coalesce(key_at, F.lit(0)) > 0, key_at - 1).otherwise(0).cast("string")
    rows = (
        raw.withColumn("options", F.when(given, by_key).otherwise(F.col("options")))
        .withColumn("_idx", F.when(given, key_index).otherwise(F.col("answer_idx")))
        .withColumn("_labels", F.when(
            given & F.col("choice_labels").isNotNull(),
            F.transform(keys, lambda k: F.coalesce(F.try_element_at("choice_labels", k), F.lit("plausible_unsupported"))),
        ).otherwise(F.col("distractor_metadata")))
    )
    rows = rows.withColumn("_at", answer_index(F.col("_idx"), F.col("options"), F.col("answer"), F.col("answer_text")))
    four = F.coalesce(F.size("options") == 4, F.lit(False))
    error = F.when(~four, "generate_question must return exactly four options").when(
        F.col("_at").isNull(), "generate_question must return answer_idx in [0, 3]")
    labelled = F.coalesce(F.size("_labels") == 4, F.lit(False))
    repaired = F.transform("_labels", lambda d, i: F.when(i == F.col("_at"), "correct").when(
        (d == "correct") | ~F.coalesce(d.isin(*D.DISTRACTOR_TYPES), F.lit(False)), "plausible_unsupported").otherwise(d))
    plain = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == F.col("_at"), "correct").otherwise("plausible_unsupported"))
    return (
        rows.withColumn("error", error)
        .withColumn("options", F.when(F.col("error").isNull(), F.col("options")))
        .withColumn("answer_idx", F.when(F.col("error").isNull(), F.col("_at")))
        .withColumn("answer_text", F.when(F.col("error").isNull(), F.try_element_at("options", F.col("_at") + 1)))
        .withColumn("distractor_metadata", F.when(F.col("error").isNull(), F.when(labelled, repaired).otherwise(plain)))
        .withColumn("question_type", L.question_type(F.col("question_type"), F.col("target_type")))
        .drop("_idx", "_labels", "_at")
    )


def with_expectedness(selection: DataFrame, scored: DataFrame, key: str = "id", value: str = "expectedness_raw") -> DataFrame:
    """Selection rows with their clamped expectedness; a missing or unusable score gives a warning."""
    joined = selection.join(scored.select(key, value), key, "left")
    return joined.withColumn("expectedness", S.score(F.col(value))).withColumn(
        "expectedness_warning", S.score_warning(F.coalesce(F.col(value), F.lit("")))).drop(value)


def assemble_candidates(selection: DataFrame, decisions: DataFrame, questions: DataFrame, key: str = "block_id") -> DataFrame:
    """Selection row over model decision over default, plus the question block; rows without a question drop out.

    ``decisions`` carries the same fields with prefix ``d_``.
    """
    joined = selection.join(decisions, key, "left").join(questions.filter("error is null").drop("error"), key)
    reasoning = L.reasoning_types(F.coalesce("reasoning_type", "d_reasoning_type"))
    return joined.select(
        key,
        *[c for c in selection.columns if c not in {key, "predictability", "continuity_type", "reasoning_type",
                                                    "evidence_sufficiency", "should_keep"}],
        F.coalesce("predictability", "d_predictability", F.lit("unpredictable")).alias("predictability"),
        reasoning.alias("reasoning_type"),
        L.continuity_type(F.coalesce("continuity_type", "d_continuity_type"), reasoning).alias("continuity_type"),
        S.loose_double(F.coalesce("evidence_sufficiency", "d_evidence_sufficiency")).alias("evidence_sufficiency"),
        F.coalesce("should_keep", S.loose_bool(F.col("d_should_keep")), F.lit(False)).alias("should_keep"),
        F.lit(0.0).alias("qwen_confidence"),
        F.lit(0.0).alias("distractor_quality"),
        *[c for c in questions.columns if c not in {key, "error"}],
    )


#: Continuity features of a candidate row; zero where they were not worked out.
FEATURES = ("semantic_similarity_last", "semantic_similarity_mean", "entity_overlap", "action_overlap", "location_overlap")


def full_candidates(rows: DataFrame, strategy: str = "block_search") -> DataFrame:
    """Candidate rows in the internal schema: answer fields, clips, evidence, features and nested metadata.

    Reads a selection row (``context``, ``full_context``, ``target``, ``evidence``, ids and labels) with its question block. Columns
    that may be missing: the features, ``timestamp_gap``, ``target_validity_reason``, ``selected_window_size``, ``rejection_reason``.
    A fresh candidate has no confidence and no verdict yet, so those scores are zero and the passes null.
    """
    def given(name: str, kind: str, default: Column | None = None) -> Column:
        value = F.col(name) if name in rows.columns else F.lit(None)
        return F.coalesce(value.cast(kind), default) if default is not None else value.cast(kind)

    clip_ids = lambda clips: F.transform(clips, lambda c: c["clip_id"])
    reasoning = L.reasoning_types(F.col("reasoning_type"))
    evidence = L.evidence_rows(F.col("evidence"))
    size = given("selected_window_size", "int", F.size("context"))
    features = {name: given(name, "double", F.lit(0.0)) for name in FEATURES}
    cited = F.col("evidence_clip_ids")
    return rows.select(
        "id", "movie", "target_clip_id", "target_sentence",
        clip_ids(F.col("context")).alias("context_clip_ids"),
        F.transform("context", lambda c: c["text"]).alias("context_sentences"),
        L.question_type(F.col("question_type"), F.col("target_type")).alias("question_type"),
        "question", "options", "answer_idx", "answer_text",
        F.coalesce("predictability", F.lit("unpredictable")).alias("predictability"),
        given("expectedness", "double").alias("expectedness"),
        "target_type",
        F.when(F.size(cited) > 0, cited).otherwise(clip_ids(evidence)).alias("evidence_clip_ids"),
        F.struct(F.col("target_triviality"), given("target_validity_reason", "string").alias("target_validity_reason"), size.alias("selected_window_size")).alias("selection_metadata"),
        F.struct(F.lit(None).cast("boolean").alias("oracle_pass"), F.lit(None).cast("boolean").alias("grounding_pass"), F.lit(0.0).alias("distractor_quality")).alias("validation_metadata"),
        "distractor_metadata", F.lit(None).cast("string").alias("split"), "context", "target",
        evidence.alias("evidence"), reasoning.alias("reasoning_type"),
        L.continuity_type(F.col("continuity_type"), reasoning).alias("continuity_type"),
        F.struct(*[v.alias(n) for n, v in features.items()]).alias("continuity_scores"),
        *[v.alias(n) for n, v in features.items()],
        given("timestamp_gap", "double").alias("timestamp_gap"),
        size.alias("selected_window_size"), F.lit(strategy).alias("context_selection_strategy"),
        clip_ids(F.col("full_context")).alias("full_prior_context_clip_ids"),
        clip_ids(F.col("context")).alias("selected_context_clip_ids"),
        given("rejection_reason", "string").alias("rejection_reason"),
        F.struct(
            F.lit(0.0).alias("qwen_confidence"), S.loose_double(F.col("evidence_sufficiency")).alias("evidence_sufficiency"),
            F.lit(0.0).alias("distractor_quality"), F.coalesce(S.loose_bool(F.col("should_keep")), F.lit(False)).alias("should_keep")).alias("quality"),
    )
