"""Prompts, option order, model outputs, the model hook and the incremental route."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from plotline.functions import json_recovery as J
from plotline.functions import text as X
from plotline.operators import answering as N
from plotline.operators import selection as P
from plotline.plans import oracle_views as O
from plotline.plans.registry import query
from plotline.plans.sequences import SELECTION_THRESHOLD
from plotline.session import scratch_path
from plotline.sources import adapters as A
from plotline.streaming import route as H

# The stand-in models travel with the job, so workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

O.VIEWS["v_shown"] = (("v_examples",), """
    SELECT *, list_transform(ord, lambda i: options[i + 1]) AS shown
    FROM (SELECT *, list_transform(list_sort(list_transform([0, 1, 2, 3], lambda i: {'h': sha256(id || ':' || i), 'i': i})), lambda s: s.i) AS ord
          FROM v_examples)""")


def shown(spark, sf_dir, longest=None):
    rows = A.examples(spark, sf_dir, longest).withColumn("option_order", N.option_order(F.col("id"), F.col("options")))
    return rows.withColumn("shown", N.displayed_options(F.col("options"), F.col("option_order")))


@query("option_shuffle", O.with_views("""
    SELECT id, array_to_string(ord, ',') AS option_order, array_to_string(shown, '|') AS shown FROM v_shown""", "v_shown"))
def option_shuffle(spark, sf_dir):
    return shown(spark, sf_dir).select(
        "id", F.array_join(F.transform("option_order", lambda i: i.cast("string")), ",").alias("option_order"),
        F.array_join("shown", "|").alias("shown"))


_TAIL = """'Question:' || chr(10) || question || chr(10) || chr(10) || 'Options:' || chr(10)
    || array_to_string(list_transform(shown, lambda o, i: (i - 1) || '. ' || o), chr(10)) || chr(10) || chr(10)
    || 'Return strict JSON with keys "prediction_idx" and "prediction_text".' || chr(10)
    || '"prediction_idx" must be one of 0, 1, 2, or 3.' || chr(10) || '"prediction_text" must exactly match the selected option.' || chr(10)"""
_HEAD = "'You are answering a multiple-choice question about what happens next in a movie.' || chr(10) || chr(10)"


@query("prompt_table", O.with_views(f"""
    SELECT id, {_HEAD} || 'Choose the best answer.' || chr(10) || chr(10) || {_TAIL} AS plain,
           {_HEAD} || 'Base your answer on the prior audio descriptions below. First identify which answer option is best supported by the prior descriptions, then return only the final JSON answer.'
             || chr(10) || chr(10) || 'Prior audio descriptions:' || chr(10)
             || array_to_string(list_transform(context_sentences, lambda s, i: i || '. ' || s), chr(10)) || chr(10) || chr(10) || {_TAIL} AS grounded,
           array_to_string(list_transform(context, lambda c: '- ' || c.clip_id || ' [' || c.timestamp_start || ', ' || c.timestamp_end || ']: ' || c.text), chr(10)) AS clips
    FROM v_shown""", "v_shown"))
def prompt_table(spark, sf_dir):
    rows, none = shown(spark, sf_dir), F.array().cast("array<string>")
    return rows.select(
        "id", N.question_prompt(F.col("question"), F.col("shown"), none).alias("plain"),
        N.question_prompt(F.col("question"), F.col("shown"), F.col("context_sentences")).alias("grounded"),
        N.context_lines(F.col("context")).alias("clips"))


@query("prediction_normalize", O.with_views("""
    SELECT id, CASE WHEN d < 4 THEN ord[d + 1] END::BIGINT AS prediction_idx, CASE WHEN d < 4 THEN options[ord[d + 1] + 1] END AS prediction_text,
           CASE WHEN d < 4 THEN d END AS displayed_idx
    FROM (SELECT *, CASE WHEN (conv_id + pos) % 11 = 4 THEN 9 WHEN role = 'user' THEN (conv_id + pos) % 5
                         WHEN role = 'assistant' THEN list_position(list_transform(shown, lambda o: lower(o)), lower(answer_text)) - 1 ELSE 9 END AS d FROM v_shown)""",
    "v_shown"))
def prediction_normalize(spark, sf_dir):
    """User turns are answered by number (4 is out of range), assistant turns by wording, planted turns not at all."""
    rows = shown(spark, sf_dir)
    index = F.when((F.col("role") == "user") & ~A.planted(), F.concat(F.lit(" "), F.pmod(F.col("conv_id") + F.col("pos"), F.lit(5)).cast("string")))
    wording = F.when((F.col("role") == "assistant") & ~A.planted(), F.concat(F.lower("answer_text"), F.lit(" ")))
    p = rows.select("id", N.normalize_prediction(index, wording, F.col("options"), F.col("option_order")).alias("p"))
    return p.select("id", F.col("p.prediction_idx").cast("bigint").alias("prediction_idx"), "p.prediction_text",
                    F.col("p.displayed_idx").cast("bigint").alias("displayed_idx"))


def raw_outputs(spark, sf_dir, longest=None):
    """Items with a raw model text of five kinds: fenced, after noise, prose only, by wording, empty."""
    kind = F.pmod(F.col("conv_id") + F.col("pos"), F.lit(5))
    text = (
        F.when(kind == 0, '```json\n{"prediction_idx": 1}\n```')
        .when(kind == 1, 'noise {"bad": } more {"prediction_idx": "2", "note": "a } brace \\" and {"} end')
        .when(kind == 2, F.concat(F.lit("no object: "), "target_sentence"))
        .when(kind == 3, F.concat(F.lit("Sure. "), F.to_json(F.struct(F.lower("answer_text").alias("prediction_text")))))
        .otherwise(" \n ")
    )
    return shown(spark, sf_dir, longest).withColumn("raw_text", text)


O.VIEWS["v_triage"] = (("v_shown",), """
    SELECT *, (conv_id + pos) % 5 AS kind FROM v_shown""")


@query("output_triage", O.with_views("""
    SELECT id, CASE kind WHEN 0 THEN '1' WHEN 1 THEN '2' END AS given, CASE WHEN kind = 1 THEN 'a } brace " and {' END AS note,
           CASE kind WHEN 2 THEN 'no JSON object found in model output' WHEN 4 THEN 'empty model output' END AS error,
           CASE kind WHEN 0 THEN ord[2] WHEN 1 THEN ord[3] WHEN 3 THEN ord[list_position(list_transform(shown, lambda o: lower(o)), lower(answer_text))] END::BIGINT AS prediction_idx
    FROM v_triage""", "v_triage"))
def output_triage(spark, sf_dir):
    done = N.prediction_rows(raw_outputs(spark, sf_dir), "triage").withColumn("_json", J.recovered_object(F.col("raw_text")))
    return done.select("id", F.get_json_object("_json", "$.prediction_idx").alias("given"), F.get_json_object("_json", "$.note").alias("note"),
                       "error", F.col("prediction_idx").cast("bigint").alias("prediction_idx"))


@query("failure_log", O.with_views("""
    SELECT id, 'triage' AS run_name, CASE kind WHEN 2 THEN 'no JSON object found in model output' ELSE 'empty model output' END AS error,
           left(question, 500) AS prompt_preview, left(CASE kind WHEN 2 THEN 'no object: ' || target_sentence ELSE ' ' || chr(10) || ' ' END, 1000) AS output_preview
    FROM v_triage WHERE kind IN (2, 4)""", "v_triage"))
def failure_log(spark, sf_dir):
    """The previews are the feature: a log line keeps 500 characters of the prompt and 1000 of the output."""
    rows = N.prediction_rows(raw_outputs(spark, sf_dir), "triage")
    return N.failure_log(rows.withColumn("prompt", F.col("question")))


@query("heuristic_answerer", O.with_views(f"""
    SELECT id, (list_position(scores, list_max(scores)) - 1)::BIGINT AS prediction_idx FROM (
      SELECT id, list_transform(options, lambda o: {O.overlap(O.word_set('o'), 'cw')}) AS scores
      FROM (SELECT id, options, {O.word_set("array_to_string(context_sentences, ' ')")} AS cw FROM v_examples))""", "v_examples"))
def heuristic_answerer(spark, sf_dir):
    rows = A.examples(spark, sf_dir).withColumn("_words", X.word_set(F.array_join("context_sentences", " ")))
    return rows.select(
        "id", N.best_option(F.col("_words"), F.col("options")).cast("bigint").alias("prediction_idx"))


def _first_model(batch):
    """Answers items of users, mumbles otherwise."""
    return batch["role"].map(lambda r: '{"prediction_idx": 0}' if r == "user" else "hm")


def _second_model(batch):
    return batch["role"].map(lambda r: 'well {"prediction_idx": "3"}' if r == "assistant" else "hm")


@query("retry_invalid", O.with_views("""
    SELECT id, CASE role WHEN 'user' THEN ord[1] WHEN 'assistant' THEN ord[4] END::BIGINT AS prediction_idx,
           CASE WHEN role = 'user' THEN 'ask' ELSE 'ask_retry' END AS run_name FROM v_shown""", "v_shown"))
def retry_invalid(spark, sf_dir):
    prompts = shown(spark, sf_dir).select("id", "role", "options", "option_order", "answer_idx")
    rows = N.ask_with_retry(prompts, _first_model, "ask", _second_model)
    return rows.select("id", F.col("prediction_idx").cast("bigint").alias("prediction_idx"), "run_name")


def selection_stream(spark, decisions, base, runs=("first",)):
    """Decisions as files, routed by as many streams as there are names in ``runs``."""
    decisions.write.parquet(f"{base}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")

    def route(batch):
        return P.materialize(batch, SELECTION_THRESHOLD).select("id", "movie", "rejection_reason", "route")

    for name in runs:
        H.route_stream(spark, source, route, f"{base}/out", f"{base}/check-{name}", order=["movie"]).awaitTermination()


@query("stream_route", O.with_views("SELECT route, count(*) AS n FROM v_selection GROUP BY route", "v_selection"))
def stream_route(spark, sf_dir):
    """Decisions arrive as files; each run routes what is new. A second run over the same input adds nothing."""
    base = scratch_path(spark, "stream-route")
    selection_stream(spark, A.decisions(spark, sf_dir), base, ("first", "again"))
    return spark.read.parquet(f"{base}/out").groupBy("route").agg(F.count(F.lit(1)).alias("n"))
