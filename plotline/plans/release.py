"""Question blocks, candidate assembly and the projections that leave the house."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import labels as L
from plotline.operators import constraints as C
from plotline.operators import release as E
from plotline.operators import splits as D
from plotline.plans import oracle_views as O
from plotline.plans.registry import query
from plotline.plans.scoring import _FOLD
from plotline.plans.sequences import continuity_features, selection_rows
from plotline.sources import adapters as A

_LETTER = "chr((65 + answer_idx)::INT)"
O.VIEWS["v_raw_questions"] = (("v_examples",), f"""
    SELECT *, CASE m WHEN 0 THEN answer_idx::VARCHAR WHEN 1 THEN lower({_LETTER}) WHEN 2 THEN answer_text WHEN 3 THEN ' 2 ' WHEN 4 THEN 'E' END AS idx_raw,
           CASE WHEN m = 4 THEN {_LETTER} END AS answer_raw, CASE WHEN m = 5 THEN answer_text END AS text_raw,
           CASE WHEN m IN (0, 1, 4) THEN answer_idx WHEN m = 3 THEN 2 ELSE list_position(options, answer_text) - 1 END AS idx
    FROM (SELECT *, (conv_id + 2*pos) % 6 AS m FROM v_examples)""")


def raw_questions(spark, sf_dir, longest=None):
    """Question answers as a model might word them: digits, letters, wording, letters in another field."""
    m = F.pmod(F.col("conv_id") + 2 * F.col("pos"), F.lit(6))
    letter = F.char(65 + F.col("answer_idx"))
    return A.examples(spark, sf_dir, longest).withColumns({
        "idx_raw": F.when(m == 0, F.col("answer_idx").cast("string")).when(m == 1, F.lower(letter)).when(m == 2, F.col("answer_text"))
        .when(m == 3, " 2 ").when(m == 4, "E"),
        "answer_raw": F.when(m == 4, letter),
        "text_raw": F.when(m == 5, F.col("answer_text")),
    })


@query("answer_index", O.with_views("SELECT id, idx AS answer_idx FROM v_raw_questions", "v_raw_questions"))
def answer_index(spark, sf_dir):
    found = E.answer_index(F.col("idx_raw"), F.col("options"), F.col("answer_raw"), F.col("text_raw"))
    return raw_questions(spark, sf_dir).select("id", found.cast("bigint").alias("answer_idx"))


def question_rows(spark, sf_dir, longest=None):
    """User turns answer as a lettered map, other planted turns give three options only, labels need repair."""
    raw = raw_questions(spark, sf_dir, longest)
    letters = F.array(*[F.lit(c) for c in "ABCD"])
    is_map = F.col("role") == "user"
    return E.question_blocks(raw.select(
        "id", "target_type",
        F.when(is_map, F.map_from_arrays(letters, F.col("options"))).alias("choices"),
        F.when(A.planted(), F.slice("options", 1, 3)).otherwise(F.col("options")).alias("options"),
        F.col("idx_raw").alias("answer_idx"),
        F.when(is_map, F.char(65 + F.col("answer_idx"))).otherwise(F.col("answer_raw")).alias("answer"),
        F.col("text_raw").alias("answer_text"),
        F.lit(None).cast("map<string,string>").alias("choice_labels"),
        F.when(~is_map, F.array(F.lit("correct"), F.lit("correct"), F.lit("weird"), F.lit("unrelated"))).alias("distractor_metadata"),
        F.col("question_type_raw").alias("question_type"),
    ))


@query("question_block", O.with_views("""
    SELECT id, error, question_type, CASE WHEN error IS NULL THEN i END AS answer_idx, CASE WHEN error IS NULL THEN options[i + 1] END AS answer_text,
           CASE WHEN error IS NULL THEN array_to_string(list_transform([0,1,2,3], lambda j: CASE WHEN j = i THEN 'correct'
             WHEN role = 'user' OR j < 3 THEN 'plausible_unsupported' ELSE 'unrelated' END), ',') END AS labels
    FROM (SELECT *, CASE WHEN (conv_id + pos) % 11 = 4 AND role <> 'user' THEN 'generate_question must return exactly four options' END AS error,
                 CASE WHEN role = 'user' THEN answer_idx ELSE idx END AS i FROM v_raw_questions)""", "v_raw_questions"))
def question_block(spark, sf_dir):
    return question_rows(spark, sf_dir).select(
        "id", "error", "question_type", F.col("answer_idx").cast("bigint").alias("answer_idx"), "answer_text",
        F.array_join("distractor_metadata", ",").alias("labels"))


@query("candidate_assemble", O.with_views(f"""
    SELECT block_id, id, coalesce(CASE WHEN route <> 'rejected' THEN predictability END, predictability, 'unpredictable') AS predictability,
           array_to_string(reasoning, ',') AS reasoning, {O.continuity_type('continuity_raw', 'reasoning')} AS continuity,
           {O.loose_double("coalesce(CASE WHEN found THEN sufficiency_raw END, sufficiency_raw)")} AS sufficiency,
           CASE WHEN found THEN route = 'selected' ELSE coalesce({O.loose_bool('should_keep_raw')}, false) END AS should_keep,
           'What follows ' || block_id || '?' AS question
    FROM v_selection WHERE tid IS NOT NULL""", "v_selection"))
def candidate_assemble(spark, sf_dir):
    n = A.longest_conversation(spark, sf_dir)
    raw = A.decisions(spark, sf_dir, n)
    chosen = selection_rows(spark, sf_dir, n)
    selection = chosen.select(
        "block_id", "id",
        F.when(F.col("route") != "rejected", F.col("predictability")).alias("predictability"),
        F.lit(None).cast("string").alias("continuity_type"), F.lit(None).cast("array<string>").alias("reasoning_type"),
        F.when(F.col("found"), F.col("evidence_sufficiency")).alias("evidence_sufficiency"),
        F.when(F.col("found"), F.col("route") == "selected").alias("should_keep"))
    decided = raw.select(
        "block_id", F.col("predictability").alias("d_predictability"), F.col("continuity_type").alias("d_continuity_type"),
        F.col("reasoning_type").alias("d_reasoning_type"), F.col("evidence_sufficiency").alias("d_evidence_sufficiency"),
        F.col("should_keep_raw").alias("d_should_keep"))
    questions = chosen.select(
        "block_id", F.concat(F.lit("What follows "), "block_id", F.lit("?")).alias("question"),
        F.when(F.col("target_clip_id").isNull(), "no target").alias("error"))
    return E.assemble_candidates(selection, decided, questions).select(
        "block_id", "id", "predictability", F.array_join("reasoning_type", ",").alias("reasoning"),
        F.col("continuity_type").alias("continuity"), F.col("evidence_sufficiency").alias("sufficiency"), "should_keep", "question")


@query("candidate_rows", O.with_views(f"""
    SELECT id, CASE WHEN s % 9 = 0 THEN 'correct answer must be labeled correct in distractor metadata'
                    WHEN s % 9 = 4 THEN 'invalid distractor type: weird' ELSE '' END AS errors,
           len(selected_ids) AS window, target_triviality AS triviality, len(evidence) AS evidence, {O.loose_double('sufficiency_raw')} AS sufficiency,
           coalesce({O.loose_bool('should_keep_raw')}, false) AS should_keep, len(list_filter(prefix, lambda c: true)) AS reach, array_to_string(selected_ids, ',') AS context
    FROM (SELECT *, conv_id + block_start AS s FROM v_selection WHERE route = 'selected')""", "v_selection"))
def candidate_rows(spark, sf_dir):
    """Whole candidate rows of selected blocks, with features, checked by the internal rules; some labels are planted wrong."""
    n, planted = A.longest_conversation(spark, sf_dir), F.col("conv_id") + F.col("block_start")
    at = F.pmod(planted, F.lit(4)).cast("int")
    labels = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when((i == at) & (planted % 9 != 0), "correct").when((i == F.pmod(at + 1, F.lit(4))) & (planted % 9 == 4), "weird").otherwise("unrelated"))
    options = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == at, F.col("target_sentence")).otherwise(F.concat(F.lit("Nothing of kind "), i.cast("string"))))
    chosen = selection_rows(spark, sf_dir, n).filter("route = 'selected'").withColumns({
        "full_context": F.col("prefix"), "options": options, "answer_idx": at, "answer_text": F.col("target_sentence"), "distractor_metadata": labels,
        "question": F.concat(F.lit("What follows "), "block_id", F.lit("?")), "question_type": F.lit("what_happens_next"), "should_keep": F.col("should_keep_raw")})
    whole = E.full_candidates(chosen.join(continuity_features(spark, sf_dir), "block_id"))
    text = whole.withColumn("json", F.to_json(F.struct(*whole.columns), {"ignoreNullFields": "false"}))
    return C.check(text, "internal").select(
        "id", F.array_join("errors", ";").alias("errors"), F.col("selection_metadata.selected_window_size").cast("bigint").alias("window"),
        F.col("selection_metadata.target_triviality").alias("triviality"), F.size("evidence").cast("bigint").alias("evidence"),
        F.col("quality.evidence_sufficiency").alias("sufficiency"), F.col("quality.should_keep").alias("should_keep"),
        F.size("full_prior_context_clip_ids").cast("bigint").alias("reach"), F.array_join("selected_context_clip_ids", ",").alias("context"))


@query("expectedness_enriched", O.with_views(f"""
    SELECT id, {O.score('expectedness_raw')} AS expectedness,
           CASE WHEN {O.score('expectedness_raw')} IS NULL THEN 'invalid_expectedness_output' END AS expectedness_warning
    FROM (SELECT id, CASE WHEN (conv_id + pos) % 11 <> 4 THEN expectedness_raw END AS expectedness_raw FROM v_examples)""", "v_examples"))
def expectedness_enriched(spark, sf_dir):
    """Items joined with a score table that has no rows for planted turns."""
    n = A.longest_conversation(spark, sf_dir)
    scores = A.examples(spark, sf_dir, n).filter("(conv_id + pos) % 11 <> 4").select("id", "expectedness_raw")
    return E.with_expectedness(A.answer_key(spark, sf_dir, n).select("id"), scores)


def split_examples(spark, sf_dir):
    n = A.longest_conversation(spark, sf_dir)
    split = D.group_split(A.answer_key(spark, sf_dir, n)).select("movie", F.col("split").alias("_split"))
    return A.examples(spark, sf_dir, n).join(split, "movie")


_SHOWN = """id, e.movie, target_clip_id, target_sentence, array_to_string(context_clip_ids, ',') AS context_clip_ids,
    md5(array_to_string(context_sentences, '|')) AS contexts, question_type, question, md5(array_to_string(options, '|')) AS options, predictability,
    expectedness, target_type, array_to_string(evidence_clip_ids, ',') AS evidence_clip_ids"""


def _shown(rows):
    return rows.select(
        "*", F.array_join("context_clip_ids", ",").alias("_i"), F.md5(F.array_join("context_sentences", "|")).alias("contexts"),
        F.md5(F.array_join("options", "|")).alias("_o"), F.array_join("evidence_clip_ids", ",").alias("_e"),
    ).drop("context_clip_ids", "context_sentences", "options", "evidence_clip_ids").withColumnsRenamed(
        {"_i": "context_clip_ids", "_o": "options", "_e": "evidence_clip_ids"})


@query("public_rows", O.with_views(_FOLD + f" SELECT {_SHOWN}, split || '_public' AS split FROM v_examples e JOIN fold f ON f.movie = e.movie AND f.i > 0",
                                   "v_sizes", "v_examples", recursive=True))
def public_rows(spark, sf_dir):
    return _shown(E.public_rows(split_examples(spark, sf_dir), F.col("_split")))


@query("private_rows", O.with_views(_FOLD + f""" SELECT {_SHOWN}, split || '_private' AS split, answer_idx, answer_text,
        'target_sentence' AS source, target_clip_id AS source_clip FROM v_examples e JOIN fold f ON f.movie = e.movie AND f.i > 0""",
                                    "v_sizes", "v_examples", recursive=True))
def private_rows(spark, sf_dir):
    rows = E.private_rows(split_examples(spark, sf_dir), F.col("_split"))
    return _shown(rows).select("*", F.col("answer_source.source").alias("source"), F.col("answer_source.target_clip_id").alias("source_clip")).drop("answer_source").withColumn(
        "answer_idx", F.col("answer_idx").cast("bigint"))


_CONTEXT = "array_to_string(list_transform(context, lambda c: c.clip_id || '=' || c.text), '|')"


@query("release_public", O.with_views(f"""
    SELECT id, movie AS source_id, {_CONTEXT} AS prior_context, question, array_to_string(options, '|') AS options, question_type, target_type,
           len(context) AS context_length, expectedness FROM v_examples""", "v_examples"))
def release_public(spark, sf_dir):
    return _flat(E.release_public(A.examples(spark, sf_dir)))


def _flat(rows):
    return rows.withColumns({
        "prior_context": F.array_join(F.transform("prior_context", lambda c: F.concat_ws("=", c["clip_id"], c["text"])), "|"),
        "options": F.array_join("options", "|"), "context_length": F.col("context_length").cast("bigint")})


@query("release_answers", O.with_views(f"""
    SELECT id, movie AS source_id, {_CONTEXT} AS prior_context, question, array_to_string(options, '|') AS options, question_type, target_type,
           len(context) AS context_length, expectedness, answer_idx, answer_text, target_sentence AS hidden_target_ad,
           context[-1].clip_id || ':' || string_split(context[-1].text, ' ')[-1] || ':' || {O.evidence_type('evidence_label')} AS evidence,
           array_to_string(distractor_metadata, ',') AS distractor_metadata FROM v_examples""", "v_examples"))
def release_answers(spark, sf_dir):
    rows = A.examples(spark, sf_dir).withColumn("evidence", L.evidence_rows(F.col("evidence_raw")))
    shown = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["clip_id"], e["span"], e["evidence_type"])), ";")
    return _flat(E.release_with_answers(rows)).withColumns({
        "evidence": shown, "distractor_metadata": F.array_join("distractor_metadata", ","), "answer_idx": F.col("answer_idx").cast("bigint")})
