"""Constraint checks and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import scalars as S
from plotline.operators import audits as U
from plotline.operators import constraints as C
from plotline.operators import gates as G
from plotline.operators import answering as N
from plotline.operators import release as E
from plotline.operators import sequence as Q
from plotline.plans import oracle_views as O
from plotline.plans.registry import query
from plotline.sources import adapters as A

def _sum():
    return F.col("conv_id") + F.col("pos")


def internal_json(spark, sf_dir, keep=()):
    """Items as JSON text with faults: missing keys (user turns drop nulls), blank names, short lists, foreign keys."""
    rows = A.examples(spark, sf_dir)
    cut = F.slice("context_sentences", F.lit(1), F.greatest(F.size("context_sentences") - 1, F.lit(0)))
    fields = [
        F.col("id"), F.when(A.planted(), "").otherwise(F.col("movie")).alias("movie"), F.col("target_clip_id"),
        F.col("target_sentence"), F.col("context_clip_ids"),
        F.when(F.pmod(_sum(), F.lit(7)) == 0, cut).otherwise(F.col("context_sentences")).alias("context_sentences"),
        F.col("question_type_raw").alias("question_type"), F.col("question"),
        F.when(F.pmod(_sum(), F.lit(9)) == 0, F.slice("options", 1, 3)).otherwise(F.col("options")).alias("options"),
        F.col("predictability"), S.safe_double(F.col("expectedness_raw")).alias("expectedness"), F.col("target_type"),
        F.col("evidence_clip_ids"),
    ]
    track = F.lit("main").alias("track")
    json = (
        F.when(F.col("role") == "user", F.to_json(F.struct(*fields)))
        .when(F.pmod(_sum(), F.lit(5)) == 0, F.to_json(F.struct(*fields, track), {"ignoreNullFields": "false"}))
        .otherwise(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    )
    return rows.select("id", (F.col("conv_id") * 1000 + F.col("pos")).alias("row"), json.alias("json"), *keep)


_EXPECT = O.safe_double("expectedness_raw")
O.VIEWS["v_core_errors"] = (("v_examples",), f"""
    SELECT id, conv_id * 1000 + pos AS row, CASE WHEN role = 'user' AND len(gone) > 0 THEN gone ELSE list_filter([
        CASE WHEN (conv_id + pos) % 11 = 4 THEN 'movie must be non-empty string' END,
        CASE WHEN s % 7 = 0 THEN 'context_clip_ids and context_sentences must align' END,
        CASE WHEN question_type_raw IS NULL OR NOT list_contains({O.QUESTION_TYPES}, question_type_raw) THEN 'invalid question_type' END,
        CASE WHEN s % 9 = 0 THEN 'options must contain exactly four strings' END,
        CASE WHEN NOT list_contains({O.TYPES}, target_type) THEN 'invalid target_type' END,
        CASE WHEN {_EXPECT} NOT BETWEEN 0 AND 1 THEN 'expectedness must be in [0.0, 1.0]' END,
        CASE WHEN role <> 'user' AND s % 5 = 0 THEN 'track must not be present' END], lambda x: x IS NOT NULL) END AS errors
    FROM (SELECT *, conv_id + pos AS s, list_filter([
            CASE WHEN question_type_raw IS NULL THEN 'missing top-level key: question_type' END,
            CASE WHEN {_EXPECT} IS NULL THEN 'missing top-level key: expectedness' END], lambda x: x IS NOT NULL) AS gone FROM v_examples)""")


@query("constraint_errors", O.with_views("SELECT id, array_to_string(errors, ';') AS errors FROM v_core_errors", "v_core_errors"))
def constraint_errors(spark, sf_dir):
    checked = C.check(internal_json(spark, sf_dir), "legacy_public")
    return checked.select("id", F.array_join("errors", ";").alias("errors"))


@query("error_report", O.with_views("""
    SELECT 'row ' || row || ': ' || message AS message, total FROM (
      SELECT row, unnest(errors) AS message, generate_subscripts(errors, 1) AS n FROM v_core_errors),
      (SELECT sum(len(errors))::BIGINT AS total FROM v_core_errors) ORDER BY row, n LIMIT 20""", "v_core_errors"))
def error_report(spark, sf_dir):
    return C.error_report(C.check(internal_json(spark, sf_dir), "legacy_public"))


def release_json(spark, sf_dir):
    """Release rows with faults: an answer key, a blank context text, a wrong context length."""
    rows = A.examples(spark, sf_dir)
    context = F.transform("context", lambda c, i: F.struct(
        c["clip_id"].alias("clip_id"), F.when((F.pmod(_sum(), F.lit(6)) == 0) & (i == 0), "").otherwise(c["text"]).alias("text")))
    fields = [
        F.col("id"), F.col("movie").alias("source_id"), context.alias("prior_context"), F.col("question"), F.col("options"),
        F.col("question_type"), F.col("target_type"),
        (F.size("context") + F.when(F.pmod(_sum(), F.lit(5)) == 0, 1).otherwise(0)).alias("context_length"), F.col("expectedness"),
    ]
    keep = {"ignoreNullFields": "false"}
    return rows.select("id", F.when(A.planted(), F.to_json(F.struct(*fields, "answer_idx"), keep))
                       .otherwise(F.to_json(F.struct(*fields), keep)).alias("json"))


@query("release_constraints", O.with_views(f"""
    SELECT id, CASE WHEN (conv_id + pos) % 11 = 4 THEN 'public example must not contain answer_idx' ELSE array_to_string(list_filter([
        CASE WHEN s % 6 = 0 THEN 'each prior_context item must have non-empty text' END,
        CASE WHEN NOT list_contains({O.TYPES}, target_type) THEN 'invalid target_type' END,
        CASE WHEN s % 5 = 0 THEN 'context_length must equal len(prior_context)' END], lambda x: x IS NOT NULL), ';') END AS errors
    FROM (SELECT *, conv_id + pos AS s FROM v_examples)""", "v_examples"))
def release_constraints(spark, sf_dir):
    return C.check(release_json(spark, sf_dir), "public").select("id", F.array_join("errors", ";").alias("errors"))


@query("answer_consistency", O.with_views(f"""
    SELECT id, CASE WHEN NOT list_contains({O.TYPES}, target_type) THEN 'invalid target_type'
                    WHEN i > 3 THEN 'answer_idx must be in [0, 3]' WHEN options[i + 1] <> answer_text THEN 'answer_text must match options[answer_idx]'
                    ELSE '' END AS errors
    FROM (SELECT *, answer_idx + CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS i FROM v_examples)""", "v_examples"))
def answer_consistency(spark, sf_dir):
    """Answer-bearing release rows; the index of assistant turns is off by one."""
    rows = E.release_with_answers(A.examples(spark, sf_dir).withColumns({
        "evidence": F.col("evidence_raw"), "answer_idx": F.col("answer_idx") + F.when(F.col("role") == "assistant", 1).otherwise(0)}))
    text = rows.select("id", F.to_json(F.struct(*[c for c in rows.columns]), {"ignoreNullFields": "false"}).alias("json"))
    return C.check(text, "with_answers").select("id", F.array_join("errors", ";").alias("errors"))


_SHAPE = """CASE role WHEN 'user' THEN '{"prior_context": [], "answer_idx": ' || turn || '}'
    WHEN 'assistant' THEN '{"selection_metadata": {"turn": ' || turn || '}}' ELSE '{"answer_text": null}' END"""


@query("schema_mix", """
    SELECT CASE role WHEN 'user' THEN 'with_answers' WHEN 'assistant' THEN 'internal' ELSE 'private' END AS schema, count(*) AS n,
           (SELECT count(DISTINCT role) FROM conversations) > 1 AS mixed FROM conversations GROUP BY role""")
def schema_mix(spark, sf_dir):
    return C.schema_mix(A.table(spark, sf_dir, "conversations").selectExpr(f"{_SHAPE} AS json"))


@query("verbatim_options", O.with_views(f"""
    SELECT id, i AS matching_option_idx, i = answer_idx AS matching_option_is_correct FROM (
      SELECT id, answer_idx, target_sentence, unnest(options) AS o, generate_subscripts(options, 1) - 1 AS i FROM v_examples)
    WHERE {O.compare_key('o')} = {O.compare_key('target_sentence')}""", "v_examples"))
def verbatim_options(spark, sf_dir):
    return U.verbatim_options(A.examples(spark, sf_dir)).select(
        "id", F.col("matching_option_idx").cast("bigint").alias("matching_option_idx"), "matching_option_is_correct")


@query("benchmark_contamination", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_contamination(spark, sf_dir):
    return U.contained_items(A.documents(spark, sf_dir), A.table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


_FLAGS = ("no_context_prompt_differs_across_sources", "no_context_prompt_contains_source_name", "no_context_prompt_contains_real_id",
          "no_context_prompt_contains_context_header", "prompt_contains_dummy_answer", "context_includes_target_or_later",
          "k1_not_immediate_prior", "k_not_last_k_prior")


@query("leak_audit", O.with_views("""
    WITH flags AS (
      SELECT id, ((conv_id + pos) % 17 = 6)::INT AS no_context_prompt_differs_across_sources, (leaks OR contains(shown, 'ground_truth') OR contains(shown, 'alpha'))::INT AS no_context_prompt_contains_source_name,
             ((conv_id + pos) % 11 = 4 OR contains(shown, id))::INT AS no_context_prompt_contains_real_id,
             (leaks OR contains(shown, 'Prior') OR contains(shown, 'audio descriptions'))::INT AS no_context_prompt_contains_context_header,
             (leaks OR contains(shown, '"prediction_idx": 0'))::INT AS prompt_contains_dummy_answer,
             ((conv_id + pos) % 11 = 4)::INT AS context_includes_target_or_later,
             (length(target_sentence) < 60)::INT AS k1_not_immediate_prior, ((conv_id + pos) % 11 = 4)::INT AS k_not_last_k_prior
      FROM (SELECT *, array_to_string(options, ' ') AS shown, (conv_id + pos) % 13 = 5 AS leaks FROM v_examples)),
    long AS (UNPIVOT flags ON COLUMNS(* EXCLUDE id) INTO NAME "check" VALUE n)
    SELECT "check", sum(n)::BIGINT AS violations, coalesce(array_to_string((list(id ORDER BY id) FILTER (n > 0))[1:5], ','), '') AS samples
    FROM long GROUP BY "check" """, "v_examples"))
def leak_audit(spark, sf_dir):
    """Contexts and prompts with planted faults: planted turns leak the target and the id, others a source name,
    a context header and an answer, or differ across sources; short targets lose their context."""
    rows = A.examples(spark, sf_dir)
    index, system = F.col("sequence_index"), A.planted()
    prior = F.transform("prior", lambda c: c["sequence_index"])
    contexts = {k: Q.last_k(prior, k) for k in (1, 2, 4, 8)}
    contexts[1] = F.when(F.length("target_sentence") < 60, F.slice(prior, 1, 0)).otherwise(contexts[1])
    contexts[4] = F.when(system, F.array_append(contexts[4], index)).otherwise(contexts[4])
    leaked = F.when(F.pmod(_sum(), F.lit(13)) == 5, ' alpha Prior audio descriptions "prediction_idx": 0').otherwise("")
    asked = F.concat(F.col("question"), F.when(system, F.concat(F.lit(" "), F.col("id"))).otherwise(""), leaked)
    shown = N.displayed_options(F.col("options"), N.option_order(F.col("id"), F.col("options")))
    prompt = N.question_prompt(asked, shown, F.array().cast("array<string>"))
    rows = rows.withColumn("_prompt", prompt).withColumn("_other", F.concat("_prompt", F.when(F.pmod(_sum(), F.lit(17)) == 6, " ").otherwise("")))
    flags = U.leak_flags(index, prior, contexts, F.col("_prompt"), F.col("id"), ("ground_truth", "alpha"), (F.col("_prompt"), F.col("_other")))
    return U.leak_report(rows.select("id", *[v.alias(n) for n, v in flags.items()]), list(flags))


def _finding(place: int, label: str, hit: str) -> str:
    return f"SELECT doc_id, {place} AS pattern, '{label}' AS label, line, t FROM lines WHERE {hit}"


# Word edges with every letter counted as part of a word, spelled out because engines differ in what \b means.
_B, _E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
_KEYWORDS = "api[_-]?key|secret[_-]?key|access[_-]?token|hf_token|openai_api_key"
_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def _host(host: str, allowed: str) -> str:
    urls = rf"regexp_extract_all(t, '(?i){_B}{host}/[A-Za-z0-9_./-]+')"
    return f"len(list_filter({urls}, lambda u: NOT regexp_matches(u, '(?i){host}/({allowed}|[^A-Za-z0-9_.-])'))) > 0"


@query("sensitive_scan", f"""
    WITH lines AS (SELECT doc_id, line, t FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS line
                     FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS l FROM documents)) WHERE NOT contains(t, 'Pattern(')),
    hits AS ({_finding(0, 'private path', "regexp_matches(t, '(?i)(/Users/|/home/[A-Za-z0-9_.-]+)')")}
      UNION ALL {_finding(1, 'email', f"regexp_matches(t, '{_B}{_MAIL}{_E}')")}
      UNION ALL {_finding(2, 'institution/lab string', f"regexp_matches(t, '(?i){_B}(tufts|stanford|mit|berkeley|cmu|cornell){_E}')")}
      UNION ALL {_finding(3, 'api key wording', f"regexp_matches(t, '(?i){_B}({_KEYWORDS}){_E}')")}
      UNION ALL {_finding(4, 'personal github/hf name', _host('github[.]com', f'huggingface{_E}'))}
      UNION ALL {_finding(5, 'personal github/hf name', _host('huggingface[.]co', 'api/'))})
    SELECT doc_id, pattern, label, min(line) AS line, left(trim(arg_min(t, line)), 180) AS excerpt FROM hits GROUP BY doc_id, pattern, label""")
def sensitive_scan(spark, sf_dir):
    found = A.documents(spark, sf_dir).select("doc_id", F.explode(U.sensitive_findings(F.col("text"))).alias("f"))
    return found.select("doc_id", "f.pattern", "f.label", F.col("f.line").cast("bigint").alias("line"), "f.excerpt")


@query("candidate_validation", O.with_views(f"""
    SELECT v.id, v.keep AND len(c.errors) = 0 AS should_keep, CASE WHEN len(c.errors) > 0 THEN 0.0::DOUBLE ELSE {O.loose_double('confidence_raw')} END AS confidence,
           array_to_string(c.errors, ';') AS failure_reasons FROM v_validated v JOIN v_core_errors c USING (id)""", "v_validated", "v_core_errors"))
def candidate_validation(spark, sf_dir):
    """Validation without a model."""
    text = internal_json(spark, sf_dir, keep=("confidence_raw", "sufficiency_raw", "distractor_raw", "keep_raw"))
    checked = C.check(text, "legacy_public").withColumns({
        "qwen_confidence": S.loose_double(F.col("confidence_raw")), "evidence_sufficiency": S.loose_double(F.col("sufficiency_raw")),
        "distractor_quality": S.loose_double(F.col("distractor_raw")), "should_keep": F.coalesce(S.loose_bool(F.col("keep_raw")), F.lit(False))})
    return G.without_model(checked).select(
        "id", "should_keep", F.col("qwen_confidence").alias("confidence"), F.array_join("failure_reasons", ";").alias("failure_reasons"))
