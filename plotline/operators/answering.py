"""Prompts, option order, prediction normalising and the pluggable model call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline.functions import json_recovery as J
from plotline.functions import text as X
from plotline.operators.similarity import word_overlap

# Fixed prompt wording.
_OPENING = "You are answering a multiple-choice question about what happens next in a movie."
_WITH_CONTEXT = (
    "Base your answer on the prior audio descriptions below. First identify which answer option is best supported by "
    "the prior descriptions, then return only the final JSON answer."
)
_CLOSING = (
    'Return strict JSON with keys "prediction_idx" and "prediction_text".\n'
    '"prediction_idx" must be one of 0, 1, 2, or 3.\n'
    '"prediction_text" must exactly match the selected option.\n'
)


def option_order(row_id: Column, options: Column) -> Column:
    """Stable permutation per id: options sorted by the digest of id and place."""
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(options) - 1), lambda i: F.struct(
        F.sha2(F.concat_ws(":", row_id, i.cast("string")), 256).alias("h"), i.alias("i"))))
    return F.transform(ranked, lambda s: s["i"])


def displayed_options(options: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.element_at(options, i + 1))


def context_lines(clips: Column) -> Column:
    """Prompt block with one line per clip: id, times, text."""
    return F.array_join(F.transform(clips, lambda c: F.concat(
        F.lit("- "), c["clip_id"], F.lit(" ["), F.coalesce(c["timestamp_start"], F.lit("None")), F.lit(", "),
        F.coalesce(c["timestamp_end"], F.lit("None")), F.lit("]: "), F.coalesce(c["text"], F.lit("")))), "\n")


def question_prompt(question: Column, shown: Column, context: Column) -> Column:
    """Multiple-choice prompt; without context it does not mention any. It never names a text source."""
    options = F.array_join(F.transform(shown, lambda o, i: F.concat(i.cast("string"), F.lit(". "), o)), "\n")
    numbered = F.array_join(F.transform(context, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    tail = F.concat(F.lit("Question:\n"), question, F.lit("\n\nOptions:\n"), options, F.lit("\n\n" + _CLOSING))
    return F.when(F.size(context) == 0, F.concat(F.lit(_OPENING + "\n\nChoose the best answer.\n\n"), tail)).otherwise(
        F.concat(F.lit(f"{_OPENING}\n\n{_WITH_CONTEXT}\n\nPrior audio descriptions:\n"), numbered, F.lit("\n\n"), tail))


def normalize_prediction(index: Column, text: Column, options: Column, order: Column) -> Column:
    """STRUCT(prediction_idx, prediction_text, displayed_idx) in original option numbers; nulls if unusable.

    ``index`` is the displayed number as a string; the wording is tried exactly, then ignoring case.
    """
    number = F.when(X.strip(index).rlike(r"^\d+$"), X.strip(index).try_cast("bigint"))
    by_index = F.when(number < F.size(options), number.cast("int"))
    shown = displayed_options(options, order)
    at = F.array_position(F.transform(shown, F.lower), F.lower(X.strip(text)))
    displayed = F.coalesce(by_index, F.when(at > 0, (at - 1).cast("int")))
    original = F.try_element_at(order, displayed + 1)
    return F.struct(
        original.alias("prediction_idx"),
        F.try_element_at(options, original + 1).alias("prediction_text"),
        displayed.alias("displayed_idx"),
    )


def prediction_rows(answers: DataFrame, run_name: str) -> DataFrame:
    """Raw model texts (``raw_text``) become prediction rows, with the failure text where nothing was found."""
    found = answers.withColumn("_json", J.recovered_object(F.col("raw_text")))
    fields = F.from_json("_json", "map<string,string>")

    def first_present(*keys: str) -> Column:
        """Value of the first key that the object has, even if it is null."""
        value = F.lit(None).cast("string")
        for key in reversed(keys):
            value = F.when(F.map_contains_key(fields, F.lit(key)), F.try_element_at(fields, F.lit(key))).otherwise(value)
        return value

    index = first_present("prediction_idx", "answer_idx", "prediction")
    wording = first_present("prediction_text", "answer_text")
    return found.withColumn("_p", normalize_prediction(index, wording, F.col("options"), F.col("option_order"))).withColumns({
        "prediction_idx": F.col("_p.prediction_idx"),
        "prediction_text": F.col("_p.prediction_text"),
        "displayed_idx": F.col("_p.displayed_idx"),
        "displayed_answer_idx": (F.array_position("option_order", F.col("answer_idx")) - 1).cast("int"),
        "correct": F.coalesce(F.col("_p.prediction_idx") == F.col("answer_idx"), F.lit(False)),
        "error": J.recovery_error(F.col("raw_text")),
        "run_name": F.lit(run_name),
    }).drop("_p", "_json")


def ask(prompts: DataFrame, model: Callable[[pd.DataFrame], pd.Series], column: str = "raw_text") -> DataFrame:
    """Call a model on Arrow batches of prompt rows; ``model`` maps a batch to one text per row."""
    fields = T.StructType([*prompts.schema.fields, T.StructField(column, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(**{column: model(batch)})

    return prompts.mapInPandas(run, fields)


def ask_with_retry(prompts: DataFrame, model: Callable[[pd.DataFrame], pd.Series], run_name: str,
                   retry_model: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """Prediction rows; rows without a usable answer are asked once more under ``<run_name>_retry``."""
    first = prediction_rows(ask(prompts, model), run_name)
    again = first.filter("prediction_idx is null").select(*prompts.columns)
    second = prediction_rows(ask(again, retry_model or model), f"{run_name}_retry")
    return first.filter("prediction_idx is not null").unionByName(second)


def failure_log(rows: DataFrame, prompt: str = "prompt", prompt_chars: int = 500, output_chars: int = 1000) -> DataFrame:
    """Failed rows with previews of prompt and output."""
    return rows.filter("error is not null").select(
        "id", "run_name", "error", F.left(prompt, F.lit(prompt_chars)).alias("prompt_preview"),
        F.left("raw_text", F.lit(output_chars)).alias("output_preview"))


def best_option(context_words: Column, options: Column) -> Column:
    """Heuristic answer: the option that shares most words with the context, the first one on ties.

    ``context_words`` should be a column of its own, so that it is not made again for every option.
    """
    scores = F.transform(options, lambda o, i: F.struct(word_overlap(X.word_set(o), context_words).alias("s"), (-i).alias("i")))
    return (-F.array_max(scores)["i"]).cast("int")
