"""Target resolution, evidence, gates and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import labels as L
from plotline.functions import scalars as S
from plotline.operators import gates as G
from plotline.operators import reports as R
from plotline.operators import selection as P
from plotline.plans import oracle_views as O
from plotline.plans.normalise import validated
from plotline.plans.registry import query
from plotline.plans.sequences import SELECTION_THRESHOLD, selection_rows
from plotline.sources import adapters as A

KEPT_LIMIT = 25


@query("target_resolve", O.with_views("""
    SELECT block_id, tid AS target_clip_id, pos_in_block AS target_position, found, len(prefix) AS n_prefix FROM v_resolved""", "v_resolved"))
def target_resolve(spark, sf_dir):
    return P.resolve_target(A.decisions(spark, sf_dir)).select(
        "block_id", "target_clip_id", F.col("target_position").cast("bigint").alias("target_position"), "found",
        F.size("prefix").cast("bigint").alias("n_prefix"))


@query("evidence_reconcile", O.with_views("""
    SELECT block_id, array_to_string(list_transform(evidence, lambda e: e.clip_id || '|' || e.span || '|' || e.evidence_type), ';') AS evidence,
           array_to_string(selected_ids, ',') AS selected, array_to_string(evidence_ids, ',') AS evidence_ids FROM v_reconciled""", "v_reconciled"))
def evidence_reconcile(spark, sf_dir):
    rows = P.reconcile_evidence(P.resolve_target(A.decisions(spark, sf_dir)))
    shown = F.transform("evidence", lambda e: F.concat_ws("|", e["clip_id"], e["span"], e["evidence_type"]))
    return rows.select(
        "block_id", F.array_join(shown, ";").alias("evidence"), F.array_join("selected_context_clip_ids", ",").alias("selected"),
        F.array_join("evidence_clip_ids", ",").alias("evidence_ids"))


@query("needs_antecedent", """
    SELECT doc_id, regexp_matches(lower(trim(text)), '^(knocking|sending|causing|making|leaving|revealing|showing|then|he|she|it|they|his|her|their) ') AS needs
    FROM documents""")
def needs_antecedent(spark, sf_dir):
    return A.documents(spark, sf_dir).select("doc_id", P.needs_antecedent(F.col("text")).alias("needs"))


@query("selection_gate", O.with_views("SELECT id, passes, sufficiency, continuity, array_to_string(reasoning, ',') AS reasoning FROM v_selection", "v_selection"))
def selection_gate(spark, sf_dir):
    return selection_rows(spark, sf_dir).select(
        "id", "passes", "sufficiency", F.col("continuity_type").alias("continuity"), F.array_join("reasoning_type", ",").alias("reasoning"))


@query("selection_route", O.with_views("SELECT id, route FROM v_selection", "v_selection"))
def selection_route(spark, sf_dir):
    return selection_rows(spark, sf_dir).select("id", "route")


_REASON = """CASE WHEN target_triviality = 'meaningful_but_noninferable' THEN 'meaningful_but_noninferable'
    WHEN target_triviality LIKE 'trivial_%' THEN 'trivial_target'
    WHEN predictability = 'underdetermined' THEN 'underdetermined'
    WHEN predictability = 'unpredictable' THEN 'insufficient_buildup'
    WHEN NOT found AND (target_clip_id IS NOT NULL OR target_position IS NOT NULL) AND bad THEN 'invalid_target'
    WHEN NOT found THEN 'no_valid_target' WHEN bad THEN 'invalid_target' ELSE 'insufficient_buildup' END"""


@query("rejection_reasons", O.with_views(f"""
    SELECT id, {_REASON} AS reason FROM v_selection WHERE route <> 'selected'""", "v_selection"))
def rejection_reasons(spark, sf_dir):
    return selection_rows(spark, sf_dir).filter("route <> 'selected'").select("id", F.col("rejection_reason").alias("reason"))


@query("route_counts", O.with_views("SELECT route, count(*) AS n FROM v_selection GROUP BY route", "v_selection"))
def route_counts(spark, sf_dir):
    return R.count_by(selection_rows(spark, sf_dir), "route")


@query("fixed_window_route", O.with_views(f"""
    SELECT block_id, CASE WHEN {O.loose_bool('should_keep_raw')} AND predictability = 'predictable'
             AND continuity_raw IN ('continuous_physical','continuous_social') AND {O.loose_double('sufficiency_raw')} >= 0.5 THEN 'selected'
           WHEN predictability = 'underdetermined' OR continuity_raw = 'scene_cut_semantically_linked' THEN 'challenge'
           ELSE 'rejected' END AS route FROM v_decisions""", "v_decisions"))
def fixed_window_route(spark, sf_dir):
    rows = A.decisions(spark, sf_dir).withColumns({
        "keep": S.loose_bool(F.col("should_keep_raw")), "sufficiency": S.loose_double(F.col("evidence_sufficiency"))})
    return rows.select("block_id", P.fixed_window_route(0.5).alias("route"))


_QUALITY = "(confidence >= 0.7 AND sufficiency >= 0.7 AND distractor >= 0.7)"
_GATE = f"""coalesce(list_contains({O.TYPES}, target_type) AND target_triviality = 'nontrivial' AND predictability = 'predictable'
    AND len(evidence_raw) > 0 AND len(evidence_clip_ids) > 0 AND failure_reason IS NULL AND {_QUALITY} AND keep, false)"""
_CHALLENGE = """(predictability IN ('underdetermined','unpredictable') OR continuity = 'scene_cut_semantically_linked'
    OR target_triviality = 'meaningful_but_noninferable')"""
_ROUTED = f"""SELECT *, CASE WHEN {_GATE} THEN 'kept' WHEN {_CHALLENGE} THEN 'challenge' ELSE 'rejected' END AS route FROM v_validated"""
O.VIEWS["v_routed"] = (("v_validated",), _ROUTED)


@query("quality_gate", O.with_views(f"""
    SELECT id, {_QUALITY} AS quality_pass, coalesce(expectedness BETWEEN 0.4 AND 0.8, false) AS expectedness_pass,
           keep AND coalesce(failure_reason, '') <> 'multi_answer' AS oracle_pass,
           NOT contains(coalesce(failure_reason, ''), 'context does not support') AS grounding_pass FROM v_validated""", "v_validated"))
def quality_gate(spark, sf_dir):
    return validated(spark, sf_dir).select(
        "id", G.quality_pass().alias("quality_pass"), G.expectedness_pass(True).alias("expectedness_pass"),
        G.oracle_pass().alias("oracle_pass"), G.grounding_pass().alias("grounding_pass"))


def routed(spark, sf_dir, longest=None):
    return validated(spark, sf_dir, longest).withColumn("route", G.gate_route(G.main_gate()))


@query("main_gate", O.with_views("SELECT id, route FROM v_routed", "v_routed"))
def main_gate(spark, sf_dir):
    return routed(spark, sf_dir).select("id", "route")


@query("kept_cap", O.with_views(f"""
    SELECT id, CASE WHEN route = 'kept' AND n > {KEPT_LIMIT} THEN 'rejected' ELSE route END AS route,
           CASE WHEN route = 'kept' AND n > {KEPT_LIMIT} THEN 'overflow beyond pilot max_examples' ELSE coalesce(failure_reason, '') END AS reasons
    FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY conv_id, pos) AS n FROM v_routed)""", "v_routed"))
def kept_cap(spark, sf_dir):
    capped = G.kept_cap(routed(spark, sf_dir), KEPT_LIMIT, ["conv_id", "pos"])
    return capped.select("id", "route", F.array_join("failure_reasons", ";").alias("reasons"))


_PLANTED_LINES = ("log of /Users/x", "raw source of /users/y", "OPENAI_API_KEY=1", "api_key: 2", "no access_token here", "secret_key", "private path secret_key")


@query("quarantine", f"""
    WITH texts AS (SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN text || chr(10) || {list(_PLANTED_LINES)}[(doc_id // 5 % 7 + 1)::INT] ELSE text END AS text FROM documents),
    lines AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
                     FROM (SELECT doc_id, regexp_split_to_array(lower(text), '\\r\\n|\\n|\\r') AS l FROM texts))
                   WHERE NOT (contains(line, 'todo(author)') OR contains(line, 'private path') OR contains(line, 'raw source'))),
    hits AS (SELECT doc_id, pos, CASE WHEN contains(line, '/users/') THEN '/users/' WHEN contains(line, 'openai_api_key') THEN 'openai_api_key'
               WHEN contains(line, 'api_key:') THEN 'api_key:' WHEN contains(line, 'access_token') THEN 'access_token'
               WHEN contains(line, 'secret_key') THEN 'secret_key' END AS p FROM lines)
    SELECT d.doc_id, CASE WHEN h.p IS NOT NULL THEN 'matched private/secret pattern ''' || h.p || '''' END AS reason
    FROM documents d LEFT JOIN (SELECT doc_id, arg_min(p, pos) AS p FROM hits WHERE p IS NOT NULL GROUP BY doc_id) h USING (doc_id)""")
def quarantine(spark, sf_dir):
    """One document in five gets a further line; two of the seven lines carry a marker that lets them through."""
    line = A.pick(_PLANTED_LINES, "doc_id div 5")
    text = F.when(F.pmod("doc_id", F.lit(5)) == 2, F.concat("text", F.lit("\n"), line)).otherwise(F.col("text"))
    return A.documents(spark, sf_dir).select("doc_id", G.quarantine_reason(text).alias("reason"))


@query("validation_outcome", O.with_views("SELECT route, count(*) AS n FROM v_routed GROUP BY route", "v_routed"))
def validation_outcome(spark, sf_dir):
    return R.count_by(routed(spark, sf_dir), "route")


@query("default_decisions", O.with_views("""
    SELECT block_id, CASE WHEN called THEN route ELSE 'rejected' END AS route,
           CASE WHEN called THEN block_id || '::' || coalesce(tid, 'no_target') ELSE block_id || '::no_target' END AS id FROM v_selection""", "v_selection"))
def default_decisions(spark, sf_dir):
    """Blocks joined with the decisions of the calls that came back; the others get the default."""
    n = A.longest_conversation(spark, sf_dir)
    fields = ("found_valid_target", "target_clip_id", "target_position", "target_type", "target_triviality", "predictability", "continuity_type",
              "reasoning_type", "evidence_sufficiency", "selected_context_clip_ids", "selected_context_spans", "evidence_clip_ids")
    came_back = A.decisions(spark, sf_dir, n).filter("called").select("block_id", *fields, F.lit(True).alias("answered"))
    rows = P.with_decisions(A.blocks(spark, sf_dir, n), came_back)
    return P.materialize(rows, SELECTION_THRESHOLD).select("block_id", "route", "id")
