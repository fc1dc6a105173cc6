"""Benchmark-shaped views over the given tables, so that every operator can run on them.

Model outputs (decisions, scores, predictions) are not in the tables. They are derived from ids by plain arithmetic,
which any SQL engine reproduces; garbage values are part of the lists on purpose.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.functions import domains as D
from plotline.functions import labels as L
from plotline.functions import scalars as S
from plotline.functions import text as X
from plotline.operators import sequence as Q
from plotline.operators.ordering import longest_group, neighbour_columns

BLOCK_WIDTH = 4
SOURCES = ("a", "b", "c")
CONTEXT_LENGTHS = (0, 1, 2, 4, 8)
LOOSE_REASONING = (("spatial_setup", "motion_trajectory"), ("emotion_cue",), ("dialogue_cue",), (), ("nonsense", "intent_driven"))
LOOSE_EVIDENCE = ("physical_precondition", "emotion_driven", "hazard_prediction", "unheard_of", None, " dialogue_cue ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (tuple, list)):
        return f"CAST(array({', '.join(_literal(x) for x in v)}) AS array<string>)"
    return "'" + v.replace("'", "\\'") + "'"


def pick(values: Sequence, index: str) -> Column:
    """Entry ``index mod len`` of a list of literals (strings, nulls or lists of strings); ``index`` is a SQL expression."""
    return F.expr(f"element_at(array({', '.join(_literal(v) for v in values)}), CAST(pmod({index}, {len(values)}) AS INT) + 1)")


def planted() -> Column:
    """Turns that carry the planted faults; the SQL of the queries states the same rule."""
    return F.pmod(F.col("conv_id") + F.col("pos"), F.lit(11)) == 4


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sequences of clips: two seconds per turn."""
    raw = table(spark, sf_dir, "conversations")
    start, end = F.col("turn") * F.lit(2.0), F.col("turn") * F.lit(2.0) + F.lit(1.5)
    named = raw.select(
        "conv_id", "turn", "role",
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("movie"),
        F.col("turn").alias("sequence_index"),
        start.alias("start_s"), end.alias("end_s"),
        start.cast("string").alias("timestamp_start"), end.cast("string").alias("timestamp_end"),
        X.normalize_text(F.col("text")).alias("text"),
    )
    return named.withColumn("clip_id", S.make_clip_id(
        F.col("movie"), F.col("timestamp_start"), F.col("timestamp_end"), F.col("sequence_index"), F.lit(None).cast("string")))


def longest_conversation(spark: SparkSession, sf_dir: str) -> int:
    return longest_group(table(spark, sf_dir, "conversations"), ["conv_id"])


def ordered_clips(spark: SparkSession, sf_dir: str, longest: int | None = None) -> DataFrame:
    return Q.order_clips(clips(spark, sf_dir), longest or longest_conversation(spark, sf_dir))


def blocks(spark: SparkSession, sf_dir: str, longest: int | None = None, width: int = BLOCK_WIDTH) -> DataFrame:
    longest = longest or longest_conversation(spark, sf_dir)
    return Q.search_blocks(ordered_clips(spark, sf_dir, longest), width, longest=longest, keep=("conv_id",))


def _last_word(text: Column) -> Column:
    return F.try_element_at(F.split(text, " "), F.lit(-1))


def decisions(spark: SparkSession, sf_dir: str, longest: int | None = None) -> DataFrame:
    """Blocks with one raw model decision each."""
    c, s, n = F.col("conv_id"), F.col("block_start"), F.size("clips")
    first = F.try_element_at("clips", F.lit(1))
    second = F.try_element_at("clips", F.least(F.lit(2), n))
    third = F.coalesce(F.try_element_at("clips", F.lit(3))["clip_id"], F.lit("none"))

    def span(clip: Column, text: Column, kind: Column) -> Column:
        return F.struct(clip["clip_id"].alias("clip_id"), text.alias("span"), kind.alias("evidence_type"))

    return blocks(spark, sf_dir, longest).select(
        "*",
        pick(("true", "yes", "True ", "1", "keep", "no", "false"), "conv_id + 3 * block_start").alias("found_valid_target"),
        F.when(F.pmod(c + s, F.lit(11)) != 0, 2 + F.pmod(7 * c + s, F.lit(3))).alias("target_position"),
        F.when((F.pmod(c + 2 * s, F.lit(5)) == 0) & (n >= 2), second["clip_id"])
        .when(F.pmod(c + 2 * s, F.lit(13)) == 1, "ghost_clip").alias("target_clip_id"),
        pick((*D.TARGET_TYPES, "dance_move", ""), "5 * conv_id + block_start").alias("target_type"),
        pick(("nontrivial", "nontrivial", "nontrivial", "trivial_generic_motion", "meaningful_but_noninferable"),
             "2 * conv_id + block_start").alias("target_triviality"),
        pick(("predictable", "predictable", "underdetermined", "unpredictable", None), "conv_id + block_start").alias("predictability"),
        pick(("continuous_physical", "continuous_social", "scene_cut_semantically_linked", "garbage", None),
             "3 * conv_id + block_start").alias("continuity_type"),
        pick(LOOSE_REASONING, "conv_id + block_start").alias("reasoning_type"),
        pick(("0.85", "score 0.7", "-0.9", "", "high", "1", None), "conv_id + 2 * block_start").alias("evidence_sufficiency"),
        F.array(first["clip_id"], third, F.lit("ghost_clip")).alias("selected_context_clip_ids"),
        F.array(
            span(first, F.concat(F.lit(" "), _last_word(first["text"])), pick(LOOSE_EVIDENCE, "conv_id + block_start")),
            span(second, _last_word(second["text"]), F.lit("motion_trajectory")),
            span(first, F.lit("§ not in the text"), F.lit("other")),
        ).alias("selected_context_spans"),
        F.when(F.pmod(c + s, F.lit(3)) == 0, F.array().cast("array<string>"))
        .otherwise(F.array(first["clip_id"], F.lit("ghost_clip"))).alias("evidence_clip_ids"),
        (F.pmod(c + s, F.lit(7)) != 3).alias("called"),
        pick(("keep", "reject", "true", "no", "1"), "conv_id + 4 * block_start").alias("should_keep_raw"),
    )


def examples(spark: SparkSession, sf_dir: str, longest: int | None = None) -> DataFrame:
    """One multiple-choice item per turn that has a turn before it, with raw labels and scores."""
    longest = longest or longest_conversation(spark, sf_dir)
    ordered = ordered_clips(spark, sf_dir, longest)
    framed = neighbour_columns(
        ordered, ["movie"], "pos",
        {
            # Eight clips back by id only; texts are carried for the three that can be shown.
            "prior": lambda w: F.collect_list(Q.clip_struct(("clip_id", "sequence_index"))).over(w.rowsBetween(-8, -1)),
            "_near": lambda w: F.collect_list(Q.clip_struct()).over(w.rowsBetween(-3, -1)),
            "next_text": lambda w: F.lead("text").over(w),
        },
        before=8, after=1, longest=longest,
    ).filter(F.col("pos") >= 1)
    c, p = F.col("conv_id"), F.col("pos")
    items = framed.select(
        F.concat_ws(":", "movie", p.cast("string")).alias("id"),
        "conv_id", "role", "movie", "pos", "sequence_index", "prior",
        F.col("clip_id").alias("target_clip_id"),
        F.col("text").alias("target_sentence"),
        F.col("timestamp_start").alias("target_start"),
        Q.last_k(F.col("_near"), (1 + F.pmod(c + p, F.lit(3))).cast("int")).alias("context"),
        F.pmod(c + p, F.lit(4)).cast("int").alias("answer_idx"),
        F.when(F.col("role") == "user", F.col("text")).otherwise(F.concat(F.lit("They say: "), F.col("text"))).alias("answer_text"),
        F.array(F.try_element_at("_near", F.lit(-1))["text"], F.coalesce("next_text", F.lit("Nothing more is said.")),
                F.lit("The scene ends without a word.")).alias("_wrong"),
        F.when(F.pmod(c + p, F.lit(3)) == 0, F.array(*[F.lit("entity_swapped")] * 3)).otherwise(
            F.array(F.lit("already_happened"), F.lit("plausible_unsupported"), F.lit("unrelated"))).alias("_kinds"),
        F.lit("What happens next?").alias("question"),
        pick(("what_happens_next", "state_change", "object_reveal", "mystery", None), "conv_id + 2 * pos").alias("question_type_raw"),
        pick((*D.TARGET_TYPES, "dance_move"), "5 * conv_id + pos").alias("target_type"),
        pick(("nontrivial", "nontrivial", "nontrivial", "meaningful_but_noninferable"), "2 * conv_id + pos").alias("target_triviality"),
        pick(("predictable", "predictable", "underdetermined", "unpredictable"), "conv_id + pos").alias("predictability"),
        pick(("continuous_physical", "scene_cut_semantically_linked", "garbage", None), "3 * conv_id + pos").alias("continuity_raw"),
        pick(("0.55", "1.7", "-0.2", "n/a", None, "0.8 ", "0.3"), "2 * conv_id + pos").alias("expectedness_raw"),
        pick(LOOSE_REASONING, "conv_id + pos").alias("reasoning_raw"),
        pick(LOOSE_EVIDENCE, "conv_id + pos").alias("_evidence_raw"),
        pick(("0.9", "confidence 0.65", "", "0.72", None), "conv_id + 3 * pos").alias("confidence_raw"),
        pick(("0.8", "-0.4", "0.75 of 1", None), "conv_id + pos").alias("sufficiency_raw"),
        pick(("0.0", "0.71", "none", "1"), "3 * conv_id + pos").alias("distractor_raw"),
        pick(("keep", "reject", "true", "no", "1", "yes", "maybe", None), "conv_id + pos").alias("keep_raw"),
        pick((None, None, None, "multi_answer", "context does not support the answer"), "3 * conv_id + pos").alias("failure_reason"),
        (F.col("role") == "assistant").alias("has_video"),
    )
    a = F.col("answer_idx")

    def inserted(values: Column, own: Column) -> Column:
        return F.concat(F.slice(values, F.lit(1), a), F.array(own), F.slice(values, a + 1, 3 - a))

    last = F.try_element_at("context", F.lit(-1))
    own_evidence = F.struct(last["clip_id"].alias("clip_id"), _last_word(last["text"]).alias("span"), F.col("_evidence_raw").alias("evidence_type"))
    blank = F.struct(F.lit("").alias("clip_id"), F.lit("x").alias("span"), F.lit("other").alias("evidence_type"))
    ids = F.transform("context", lambda x: x["clip_id"])
    return items.withColumns({
        "options": inserted(F.col("_wrong"), F.col("answer_text")),
        "distractor_metadata": inserted(F.col("_kinds"), F.lit("correct")),
        "evidence_raw": F.when(F.expr("pmod(conv_id + pos, 4) = 0"), F.array(own_evidence, blank)).otherwise(F.array(own_evidence)),
        "question_type": L.question_type(F.col("question_type_raw"), F.col("target_type")),
        "expectedness": S.score(F.col("expectedness_raw")),
        "context_clip_ids": ids,
        "context_sentences": F.transform("context", lambda x: x["text"]),
        "evidence_clip_ids": F.slice(ids, -1, 1),
    }).drop("_wrong", "_kinds", "_evidence_raw")


def answer_key(spark: SparkSession, sf_dir: str, longest: int | None = None) -> DataFrame:
    """Ids and gold answers only: no window frame, no text."""
    ordered = ordered_clips(spark, sf_dir, longest).filter(F.col("pos") >= 1)
    return ordered.select(
        F.concat_ws(":", "movie", F.col("pos").cast("string")).alias("id"), "movie", "role", "conv_id", "pos",
        F.pmod(F.col("conv_id") + F.col("pos"), F.lit(4)).cast("int").alias("answer_idx"))


def predictions(spark: SparkSession, sf_dir: str, longest: int | None = None) -> DataFrame:
    """Answers of three sources at five context lengths, in original option numbers.

    Planted turns get none, assistant turns a second one that replaces the first, and the first turn of a conversation,
    which is no item, gets some as well. One value in five is null.
    """
    ordered = ordered_clips(spark, sf_dir, longest).filter(~planted())
    runs = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(i).alias("number"), F.lit(k).alias("k"))
                     for i, s in enumerate(SOURCES) for k in CONTEXT_LENGTHS])
    tries = F.when(F.col("role") == "assistant", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = (
        ordered.select("conv_id", "movie", "pos", F.explode(tries).alias("ord"), runs.alias("_runs"))
        .select("conv_id", "movie", "pos", "ord", F.explode("_runs").alias("r"))
    )
    value = F.pmod(F.col("conv_id") * 3 + F.col("pos") * 5 + F.col("r.k") + F.col("r.number") + F.col("ord") - 1, F.lit(5)).cast("int")
    return rows.select(
        F.concat_ws(":", "movie", F.col("pos").cast("string")).alias("id"),
        F.col("r.source").alias("source"), F.col("r.k").alias("k"), "ord",
        F.when(value < 4, value).alias("prediction"),
    )


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed texts: one sequence per user, times in seconds to the millisecond."""
    e = table(spark, sf_dir, "events")
    start = F.round(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 1e6, 3)
    rows = e.select(
        "event_id", "user_id", "event_type",
        F.concat(F.lit("1005_User "), F.col("user_id").cast("string")).alias("movie"),
        start.alias("start_s"), F.round(start + F.col("value"), 3).alias("end_s"),
        F.concat(F.col("event_type"), F.lit("'s "), F.get_json_object("props", "$.k")).alias("text"),
    )
    return rows.withColumn("key", X.sequence_key(F.col("movie")))


def generated_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated texts for the timed events: errors have none, the other types are shifted by 0, +-0.01 or 0.2 s."""
    t = timed(spark, sf_dir).filter(F.col("event_type") != "error")
    shift = (
        F.when(F.col("event_type") == "view", 0.01).when(F.col("event_type") == "purchase", -0.01)
        .when(F.col("event_type") == "signup", 0.2).otherwise(0.0)
    )
    return t.select(
        F.col("event_id").alias("ord"),
        F.concat(F.lit("USER_"), F.col("user_id").cast("string")).alias("movie"),
        F.round(F.col("start_s") + shift, 3).alias("r_start"), F.round(F.col("end_s") + shift, 3).alias("r_end"),
        F.col("text").alias("ground_truth"),
        F.concat(F.lit("alpha "), "text").alias("alpha"),
        F.when(F.col("event_type") == "view", "  ").otherwise(F.concat(F.lit("  beta "), "text")).alias("beta"),
        F.concat(F.lit("gamma "), F.upper("text"), F.lit(" ")).alias("gamma"),
    )


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.operators.matching import unpivot_sources

    long = unpivot_sources(generated_wide(spark, sf_dir), ["ord", "movie", "r_start", "r_end", "ground_truth"], ["alpha", "beta", "gamma"])
    return long.withColumn("key", X.sequence_key(F.col("movie")))
