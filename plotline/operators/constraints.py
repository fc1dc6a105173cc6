"""Row constraints of the benchmark schemas, on rows read as JSON text.

Rows are parsed to VARIANT, since a typed DataFrame cannot tell a missing key from a null or a wrong type. A schema is a
list of rule stages, and a row's errors are those of the first stage that has any. Some rules are reported along with
whichever of the first two stages that is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.json_recovery import whole_json
from plotline.functions import domains as D

#: (condition under which the rule is broken, one message or an array<string> of messages)
Rule = tuple[Column, str | Column]


@dataclass
class Schema:
    stages: list[list[Rule]]
    along: list[Rule] = field(default_factory=list)


CORE_KEYS = (
    "id", "movie", "target_clip_id", "target_sentence", "context_clip_ids", "context_sentences", "question_type",
    "question", "options", "predictability", "expectedness", "target_type", "evidence_clip_ids",
)
RELEASE_KEYS = ("id", "source_id", "prior_context", "question", "options", "question_type", "target_type", "context_length")
HIDDEN_KEYS = ("answer_idx", "answer_text", "hidden_target_ad", "target_sentence", "target_clip_id")


class Row:
    """Typed look-ups in one VARIANT column."""

    def __init__(self, variant: Column):
        self.v = variant

    def raw(self, path: str) -> Column:
        return F.try_variant_get(self.v, f"$.{path}", "variant")

    def has(self, path: str) -> Column:
        return self.raw(path).isNotNull()

    def kind(self, path: str) -> Column:
        """OBJECT, ARRAY, STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN, VOID (a JSON null) or NONE (no such key)."""
        return _kind(self.raw(path))

    def text(self, path: str) -> Column:
        return F.when(self.kind(path) == "STRING", F.try_variant_get(self.v, f"$.{path}", "string"))

    def number(self, path: str) -> Column:
        return F.when(self.is_number(path), F.try_variant_get(self.v, f"$.{path}", "double"))

    def is_number(self, path: str) -> Column:
        return self.kind(path).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")

    def is_text(self, path: str) -> Column:
        return F.coalesce(F.length(self.text(path)) > 0, F.lit(False))

    def is_array(self, path: str) -> Column:
        return self.kind(path) == "ARRAY"

    def is_null(self, path: str) -> Column:
        """Missing or JSON null."""
        return self.kind(path).isin("NONE", "VOID")

    def items(self, path: str) -> Column:
        return F.coalesce(
            F.when(self.is_array(path), F.try_variant_get(self.v, f"$.{path}", "array<variant>")),
            F.array().cast("array<variant>"))

    def size(self, path: str) -> Column:
        return F.size(self.items(path))

    def within(self, path: str, domain: Sequence[str]) -> Column:
        return F.coalesce(self.text(path).isin(*domain), F.lit(False))


def _kind(variant: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(variant), "^[A-Z]+", 0), F.lit("NONE"))


def _item_text(item: Column, key: str) -> Column:
    """Non-empty string at ``key`` of an array item."""
    value = F.try_variant_get(item, f"$.{key}", "variant")
    return (_kind(value) == "STRING") & F.coalesce(
        F.length(F.try_variant_get(item, f"$.{key}", "string")) > 0, F.lit(False))


def _missing(row: Row, keys: Sequence[str]) -> list[Rule]:
    return [(~row.has(k), f"missing top-level key: {k}") for k in keys]


def _expectedness(row: Row) -> list[Rule]:
    given = ~row.is_null("expectedness")
    return [
        (given & ~row.is_number("expectedness"), "expectedness must be numeric or null"),
        (given & row.is_number("expectedness") & ~row.number("expectedness").between(0.0, 1.0),
         "expectedness must be in [0.0, 1.0]"),
    ]


def _options(row: Row) -> list[Rule]:
    four = row.size("options") == 4
    blank = F.exists(row.items("options"), lambda o: (_kind(o) != "STRING") | F.coalesce(
        F.length(F.trim(F.try_variant_get(o, "$", "string"))) == 0, F.lit(True)))
    return [
        (~four, "options must contain exactly four strings"),
        (four & blank, "each option must be a non-empty string"),
    ]


def core_stages(row: Row) -> list[list[Rule]]:
    text = [(~row.is_text(k), f"{k} must be non-empty string") for k in ("movie", "target_clip_id", "target_sentence")]
    return [
        _missing(row, CORE_KEYS),
        text
        + [
            (~row.is_array("context_clip_ids"), "context_clip_ids must be a list"),
            (~row.is_array("context_sentences"), "context_sentences must be a list"),
            (row.size("context_clip_ids") != row.size("context_sentences"), "context_clip_ids and context_sentences must align"),
            (~row.within("question_type", D.QUESTION_TYPES), "invalid question_type"),
            (~row.is_text("question"), "question must be non-empty string"),
        ]
        + _options(row)
        + [
            (~row.within("predictability", D.PREDICTABILITY), "invalid predictability label"),
            (~row.within("target_type", D.TARGET_TYPES), "invalid target_type"),
            (~row.is_array("evidence_clip_ids"), "evidence_clip_ids must be a list"),
        ]
        + _expectedness(row)
        + [(row.has("track"), "track must not be present")],
    ]


def _split(row: Row, suffix: str) -> list[Rule]:
    wrong = ~row.is_null("split") & ~F.coalesce(row.text("split").endswith(f"_{suffix}"), F.lit(False))
    return [(wrong, f"{suffix} split must end with _{suffix}")]


def _answer(row: Row) -> list[Rule]:
    index = F.try_variant_get(row.v, "$.answer_idx", "int")
    valid = (row.kind("answer_idx") == "BIGINT") & F.coalesce(index.between(0, 3), F.lit(False))
    chosen = F.try_variant_get(F.try_element_at(row.items("options"), index + 1), "$", "string")
    return [
        (~valid, "answer_idx must be in [0, 3]"),
        (valid & ~chosen.eqNullSafe(row.text("answer_text")), "answer_text must match options[answer_idx]"),
    ]


def public_schema(row: Row) -> Schema:
    key = row.has("answer_idx") | row.has("answer_text")
    return Schema(core_stages(row), [(key, "public example must not contain answer key")] + _split(row, "public"))


def private_schema(row: Row) -> Schema:
    source = row.kind("answer_source") == "OBJECT"

    def same(key: str) -> Column:
        return row.text(f"answer_source.{key}").eqNullSafe(row.text(key))

    answers = (
        _answer(row)
        + [
            (~source, "answer_source must be an object"),
            (source & ~row.text("answer_source.source").eqNullSafe(F.lit("target_sentence")),
             "answer_source.source must be target_sentence"),
            (source & ~same("target_clip_id"), "answer_source.target_clip_id must match target_clip_id"),
            (source & ~same("target_sentence"), "answer_source.target_sentence must match target_sentence"),
        ]
        + _split(row, "private")
    )
    return Schema(core_stages(row) + [answers], _missing(row, ("answer_idx", "answer_text", "answer_source")))


def _item_rules(row: Row, path: str, noun: str, keys: Sequence[str]) -> list[Rule]:
    """At most one message per array: that of the first faulty item."""
    def fault(item: Column) -> Column:
        out = F.when(_kind(item) != "OBJECT", f"each {noun} item must be an object")
        for key in keys:
            out = out.when(~_item_text(item, key), f"each {noun} item must have non-empty {key}")
        return out

    faults = F.filter(F.transform(row.items(path), fault), lambda m: m.isNotNull())
    return [(F.size(faults) > 0, F.slice(faults, 1, 1))]


def release_public_stages(row: Row, hidden: Sequence[str] = HIDDEN_KEYS) -> list[list[Rule]]:
    length = F.try_variant_get(row.v, "$.context_length", "bigint")
    whole = (row.kind("context_length") == "BIGINT") & F.coalesce(length >= 0, F.lit(False))
    return [
        _missing(row, RELEASE_KEYS) + [(row.has(k), f"public example must not contain {k}") for k in hidden],
        [(~row.is_text(k), f"{k} must be non-empty string") for k in ("id", "source_id")]
        + [(~row.is_array("prior_context"), "prior_context must be a list")]
        + _item_rules(row, "prior_context", "prior_context", ("clip_id", "text"))
        + [(~row.is_text("question"), "question must be non-empty string")]
        + _options(row)
        + [
            (~row.within("question_type", D.QUESTION_TYPES), "invalid question_type"),
            (~row.within("target_type", D.TARGET_TYPES), "invalid target_type"),
            (~whole, "context_length must be a non-negative integer"),
            (whole & row.is_array("prior_context") & (length != row.size("prior_context")),
             "context_length must equal len(prior_context)"),
        ]
        + _expectedness(row),
    ]


def release_public_schema(row: Row) -> Schema:
    return Schema(release_public_stages(row))


def release_answer_schema(row: Row) -> Schema:
    answers = (
        _answer(row)
        + [
            (row.has("hidden_target_ad") & ~row.is_text("hidden_target_ad"),
             "hidden_target_ad must be non-empty string when present"),
            (row.has("evidence") & ~row.is_array("evidence"), "evidence must be a list"),
        ]
        + _item_rules(row, "evidence", "evidence", ("clip_id", "span"))
    )
    public = release_public_stages(row, ("target_sentence", "target_clip_id"))
    return Schema(public + [answers], _missing(row, ("answer_idx", "answer_text")))


def internal_schema(row: Row) -> Schema:
    meta = _missing(row, ("selection_metadata", "validation_metadata"))
    index = F.try_variant_get(row.v, "$.answer_idx", "int")
    labels = F.transform(row.items("distractor_metadata"), lambda d: F.try_variant_get(d, "$", "string"))
    four = row.size("distractor_metadata") == 4

    def every(values: Column, domain: Sequence[str], prefix: str) -> Column:
        bad = F.filter(values, lambda x: ~F.coalesce(x.isin(*domain), F.lit(False)))
        return F.transform(bad, lambda x: F.concat(F.lit(prefix), F.coalesce(x, F.lit("None"))))

    evidence = row.items("evidence")
    objects = ("selection_metadata", "validation_metadata")
    rules: list[Rule] = (
        [(row.kind(k) != "OBJECT", f"{k} must be an object") for k in objects]
        + [
            (~four, "distractor_metadata must be a list of four labels"),
            (four, every(labels, D.DISTRACTOR_TYPES, "invalid distractor type: ")),
            (~F.try_element_at(labels, index + 1).eqNullSafe(F.lit("correct")),
             "correct answer must be labeled correct in distractor metadata"),
            (~row.within("continuity_type", D.CONTINUITY_TYPES), "invalid continuity_type"),
            (~row.is_array("context"), "context must be a list"),
            (~row.is_null("target") & (row.kind("target") != "OBJECT"), "target must be an object or null"),
            (~row.is_array("evidence"), "evidence must be a list"),
            (row.kind("quality") != "OBJECT", "quality must be an object"),
            (row.kind("continuity_scores") != "OBJECT", "continuity_scores must be an object"),
        ]
        + [
            (~(row.is_number(k) | (row.kind(k) == "BOOLEAN")), f"{k} must be numeric")
            for k in ("semantic_similarity_last", "semantic_similarity_mean", "entity_overlap", "action_overlap",
                      "location_overlap")
        ]
        + [
            (~row.is_null("timestamp_gap") & ~row.is_number("timestamp_gap"), "timestamp_gap must be numeric or null"),
            (row.kind("selected_window_size") != "BIGINT", "selected_window_size must be int"),
            (~row.is_text("context_selection_strategy"), "context_selection_strategy must be non-empty string"),
            (~row.is_array("full_prior_context_clip_ids"), "full_prior_context_clip_ids must be a list"),
            (~row.is_array("selected_context_clip_ids"), "selected_context_clip_ids must be a list"),
            (~row.is_null("rejection_reason") & (row.kind("rejection_reason") != "STRING"),
             "rejection_reason must be string or null"),
            (F.lit(True), every(F.transform(row.items("reasoning_type"), lambda d: F.try_variant_get(d, "$", "string")),
                                D.REASONING_TYPES, "invalid reasoning_type: ")),
            (F.lit(True), every(F.transform(evidence, lambda e: F.try_variant_get(e, "$.evidence_type", "string")),
                                D.EVIDENCE_TYPES, "invalid evidence_type: ")),
            (F.lit(True), F.transform(F.filter(evidence, lambda e: ~_item_text(e, "clip_id")), lambda e: F.lit("evidence missing clip_id"))),
            (F.lit(True), F.transform(F.filter(evidence, lambda e: ~_item_text(e, "span")), lambda e: F.lit("evidence missing span"))),
        ]
        + [
            (~row.is_number(f"quality.{k}"), f"quality.{k} must be numeric")
            for k in ("qwen_confidence", "evidence_sufficiency", "distractor_quality")
        ]
        + [(row.kind("quality.should_keep") != "BOOLEAN", "quality.should_keep must be boolean")]
    )
    # A wrong answer or missing metadata ends the checks.
    return Schema(core_stages(row) + [_answer(row) + meta, rules], _missing(row, ("answer_idx", "answer_text")))


SCHEMAS: dict[str, Callable[[Row], Schema]] = {
    "public": release_public_schema,
    "with_answers": release_answer_schema,
    "private": private_schema,
    "legacy_public": public_schema,
    "legacy_private": private_schema,
    "internal": internal_schema,
}


def _collect(rules: Sequence[Rule]) -> Column:
    """Messages of the rules that are broken, in rule order."""
    empty = F.array().cast("array<string>")
    if not rules:
        return empty
    parts = [F.when(broken, F.array(F.lit(m)) if isinstance(m, str) else m) for broken, m in rules]
    return F.flatten(F.array(*[F.coalesce(p, empty) for p in parts]))


def check(rows: DataFrame, schema: str, text: str = "json") -> DataFrame:
    """Add ``errors`` to rows of JSON text; empty for a valid row. A text is parsed once, a stage evaluated once."""
    parsed = rows.withColumn("_v", whole_json(F.col(text)))
    rules = SCHEMAS[schema](Row(F.col("_v")))
    names = [f"_s{i}" for i in range(len(rules.stages))]
    staged = parsed.withColumns(
        {"_along": _collect(rules.along)} | {n: _collect(stage) for n, stage in zip(names, rules.stages)})
    errors = F.when(F.size(names[0]) > 0, F.concat(names[0], "_along")).when(
        F.size(names[1]) + F.size("_along") > 0, F.concat(names[1], "_along"))
    for later in names[2:]:
        errors = errors.when(F.size(later) > 0, F.col(later))
    return staged.withColumn("errors", errors.otherwise(F.array().cast("array<string>"))).drop("_v", "_along", *names)


def inferred_schema(variant: Column) -> Column:
    row = Row(variant)
    answered = row.has("answer_idx") | row.has("answer_text")
    return (
        F.when(row.has("prior_context"), F.when(answered, "with_answers").otherwise("public"))
        .when(row.has("selection_metadata") | row.has("validation_metadata"), "internal")
        .when(answered, "private")
        .otherwise("public")
    )


def schema_mix(rows: DataFrame, text: str = "json") -> DataFrame:
    """Rows per inferred schema, and whether more than one occurs."""
    parsed = rows.select(F.try_parse_json(text).alias("_v"))
    counts = parsed.groupBy(inferred_schema(F.col("_v")).alias("schema")).agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("mixed", kinds > 1)


def error_report(checked: DataFrame, row: str = "row", errors: str = "errors", first: int = 20) -> DataFrame:
    """The first messages in row order, each with the total number of messages."""
    # An outer explode keeps the optimizer from testing the whole check a second time before it.
    listed = checked.select(row, F.posexplode_outer(errors).alias("place", "message")).filter("message IS NOT NULL")
    total = checked.agg(F.coalesce(F.sum(F.size(errors)), F.lit(0))).scalar()
    return listed.orderBy(row, "place").limit(first).select(
        F.format_string("row %d: %s", F.col(row), F.col("message")).alias("message"), total.alias("total"))


def require_valid(rows: DataFrame, schema: str, text: str = "json") -> DataFrame:
    """The rows themselves; the job fails at the first row that breaks a constraint."""
    report = F.concat(F.lit(f"{schema} export failed validation: "), F.array_join("errors", "; "))
    passed = F.when(F.size("errors") == 0, F.lit(True)).otherwise(F.raise_error(report).cast("boolean"))
    return check(rows, schema, text).filter(passed).drop("errors")
