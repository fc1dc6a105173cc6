"""Text, scalar and label normalisers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import labels as L
from plotline.functions import scalars as S
from plotline.functions import text as X
from plotline.operators import gates as G
from plotline.plans import oracle_views as O
from plotline.plans.registry import query
from plotline.sources import adapters as A


@query("normalize_text", f"""
    SELECT doc_id, length(t) AS n_chars, md5(t) AS digest
    FROM (SELECT doc_id, {O.squeeze("translate(text, '’“”', '''\"\"')")} AS t FROM documents)""")
def normalize_text(spark, sf_dir):
    t = A.documents(spark, sf_dir).select("doc_id", X.normalize_text(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


@query("lookup_keys", O.with_views(f"""
    SELECT event_id, {O.compare_key('text')} AS compare_key, {O.lookup_key('text')} AS lookup_key, key AS sequence_key
    FROM v_timed
    UNION ALL
    SELECT -1 - doc_id, md5({O.compare_key('text')}), md5({O.lookup_key('text')}), {O.sequence_key("'17_' || source")} FROM documents""",
    "v_timed"))
def lookup_keys(spark, sf_dir):
    t = A.timed(spark, sf_dir).select(
        "event_id", X.compare_key(F.col("text")).alias("compare_key"), X.lookup_key(F.col("text")).alias("lookup_key"),
        F.col("key").alias("sequence_key"))
    d = A.documents(spark, sf_dir).select(
        (-1 - F.col("doc_id")).alias("event_id"), F.md5(X.compare_key(F.col("text"))).alias("compare_key"),
        F.md5(X.lookup_key(F.col("text"))).alias("lookup_key"),
        X.sequence_key(F.concat(F.lit("17_"), "source")).alias("sequence_key"))
    return t.unionByName(d)


@query("clip_id_roundtrip", O.with_views(
    "SELECT clip_id, timestamp_start AS start, timestamp_end AS \"end\" FROM v_clips", "v_clips"))
def clip_id_roundtrip(spark, sf_dir):
    return A.clips(spark, sf_dir).select("clip_id", S.clip_times(F.col("clip_id")).alias("t")).select("clip_id", "t.start", "t.end")


def _clock(x: str) -> str:
    ms = f"CAST(round_even({x} * 1000, 0) AS BIGINT)"
    return f"printf('%02d.%02d.%02d.%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


@query("format_time", O.with_views(
    f"SELECT event_id, {_clock('start_s')} AS start, {_clock('end_s')} AS \"end\" FROM v_timed", "v_timed"))
def format_time(spark, sf_dir):
    return A.timed(spark, sf_dir).select(
        "event_id", S.clock(F.col("start_s")).alias("start"), S.clock(F.col("end_s")).alias("end"))


@query("loose_scalars", O.with_views(f"""
    SELECT id, {O.loose_bool('keep_raw')} AS keep, {O.truthy('keep_raw')} AS truthy,
           {O.loose_double('sufficiency_raw')} AS signed_value, {O.loose_double('sufficiency_raw', signed=False)} AS unsigned_value,
           {O.loose_double('confidence_raw')} AS confidence, {O.safe_double('expectedness_raw')} AS parsed FROM v_examples""", "v_examples"))
def loose_scalars(spark, sf_dir):
    return A.examples(spark, sf_dir).select(
        "id", S.loose_bool(F.col("keep_raw")).alias("keep"), S.truthy_bool(F.col("keep_raw")).alias("truthy"),
        S.loose_double(F.col("sufficiency_raw")).alias("signed_value"),
        S.loose_double(F.col("sufficiency_raw"), signed=False).alias("unsigned_value"),
        S.loose_double(F.col("confidence_raw")).alias("confidence"), S.safe_double(F.col("expectedness_raw")).alias("parsed"))


@query("clamp_score", O.with_views(f"""
    SELECT id, {O.score('expectedness_raw')} AS expectedness,
           CASE WHEN {O.score('expectedness_raw')} IS NULL THEN 'invalid_expectedness_output' END AS warning FROM v_examples""", "v_examples"))
def clamp_score(spark, sf_dir):
    return A.examples(spark, sf_dir).select(
        "id", S.score(F.col("expectedness_raw")).alias("expectedness"),
        S.score_warning(F.coalesce("expectedness_raw", F.lit(""))).alias("warning"))


@query("label_normalize", O.with_views(f"""
    SELECT id, question_type, {O.evidence_type('evidence_raw[1].evidence_type')} AS first_evidence,
           len(evidence_raw) AS n_evidence, array_to_string({O.reasoning_types('reasoning_raw')}, ',') AS reasoning FROM v_examples""", "v_examples"))
def label_normalize(spark, sf_dir):
    return A.examples(spark, sf_dir).select("*", L.evidence_rows(F.col("evidence_raw")).alias("e")).select(
        "id", "question_type", F.col("e")[0]["evidence_type"].alias("first_evidence"),
        F.size("e").cast("bigint").alias("n_evidence"),
        F.array_join(L.reasoning_types(F.col("reasoning_raw")), ",").alias("reasoning"))


@query("continuity_label", O.with_views(f"""
    SELECT continuity_raw, {O.continuity_type('continuity_raw', O.reasoning_types('reasoning_raw'))} AS continuity, count(*) AS n
    FROM v_examples GROUP BY ALL""", "v_examples"))
def continuity_label(spark, sf_dir):
    label = L.continuity_type(F.col("continuity_raw"), L.reasoning_types(F.col("reasoning_raw")))
    return A.examples(spark, sf_dir).groupBy("continuity_raw", label.alias("continuity")).agg(F.count(F.lit(1)).alias("n"))


def raw_candidates(spark, sf_dir, longest=None):
    """Examples under the column names of a raw candidate row."""
    return A.examples(spark, sf_dir, longest).withColumns({
        "evidence": F.col("evidence_raw"), "reasoning_type": F.col("reasoning_raw"), "continuity_type": F.col("continuity_raw"),
        "question_type": F.col("question_type_raw"), "qwen_confidence": F.col("confidence_raw"),
        "evidence_sufficiency": F.col("sufficiency_raw"), "distractor_quality": F.col("distractor_raw"),
        "should_keep": F.col("keep_raw"),
    })


@query("candidate_normalize", O.with_views(f"""
    SELECT id, question_type, array_to_string({O.reasoning_types('reasoning_raw')}, ',') AS reasoning,
           {O.continuity_type('continuity_raw', O.reasoning_types('reasoning_raw'))} AS continuity,
           {O.loose_double('confidence_raw')} AS confidence, {O.loose_double('sufficiency_raw')} AS sufficiency,
           {O.loose_double('distractor_raw')} AS distractor, {O.loose_bool('keep_raw')} AS should_keep FROM v_examples""", "v_examples"))
def candidate_normalize(spark, sf_dir):
    return G.normalize_candidates(raw_candidates(spark, sf_dir)).select(
        "id", "question_type", F.array_join("reasoning_type", ",").alias("reasoning"), F.col("continuity_type").alias("continuity"),
        F.col("qwen_confidence").alias("confidence"), F.col("evidence_sufficiency").alias("sufficiency"),
        F.col("distractor_quality").alias("distractor"), "should_keep")


VALIDATED = f"""
    SELECT *, CASE WHEN keep AND failure_reason IS NULL THEN greatest(conf, 0.7::DOUBLE) ELSE conf END AS confidence,
           CASE WHEN keep AND failure_reason IS NULL THEN greatest(suff, old) ELSE suff END AS sufficiency,
           CASE WHEN keep AND failure_reason IS NULL THEN greatest(dist, 0.7::DOUBLE) ELSE dist END AS distractor
    FROM (SELECT *, coalesce({O.loose_bool('keep_raw')}, false) AS keep, {O.loose_double('confidence_raw')} AS conf,
                 {O.loose_double('sufficiency_raw')} AS old,
                 {O.loose_double("CASE WHEN role = 'user' THEN sufficiency_raw END", O.loose_double('sufficiency_raw'))} AS suff,
                 {O.loose_double('distractor_raw')} AS dist,
                 {O.continuity_type('continuity_raw', O.reasoning_types('reasoning_raw'))} AS continuity
          FROM v_examples)"""
O.VIEWS["v_validated"] = (("v_examples",), VALIDATED)


def validated(spark, sf_dir, longest=None):
    """Examples with normalised labels and validator scores; only user turns carry a sufficiency of their own."""
    rows = A.examples(spark, sf_dir, longest).withColumns({
        "v_keep": F.col("keep_raw"), "v_confidence": F.col("confidence_raw"),
        "v_sufficiency": F.when(F.col("role") == "user", F.col("sufficiency_raw")),
        "v_distractor": F.col("distractor_raw"), "sufficiency": F.col("sufficiency_raw"),
        "failure_reasons": G.reason_list(F.col("failure_reason")),
        "evidence": L.evidence_rows(F.col("evidence_raw")),
        "reasoning_type": L.reasoning_types(F.col("reasoning_raw")),
    })
    rows = rows.withColumn("continuity_type", L.continuity_type(F.col("continuity_raw"), F.col("reasoning_type")))
    return G.validation_scores(rows)


@query("validation_scores", O.with_views("SELECT id, keep, confidence, sufficiency, distractor FROM v_validated", "v_validated"))
def validation_scores(spark, sf_dir):
    return validated(spark, sf_dir).select(
        "id", F.col("should_keep").alias("keep"), F.col("qwen_confidence").alias("confidence"),
        F.col("evidence_sufficiency").alias("sufficiency"), F.col("distractor_quality").alias("distractor"))


@query("token_counts", f"""
    SELECT token, count(*) AS n FROM (SELECT unnest({O.tokens('text')}) AS token FROM documents) GROUP BY token""")
def token_counts(spark, sf_dir):
    t = A.documents(spark, sf_dir).select(F.explode(X.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("lexicon_tags", f"""
    SELECT doc_id, array_to_string({O.people('t')}, ' ') AS people, array_to_string({O.locations('t')}, ' ') AS locations,
           md5(array_to_string({O.actions('t')}, ' ')) AS actions, md5(array_to_string({O.objects('t')}, ' ')) AS objects
    FROM (SELECT doc_id, {O.tokens('text')} AS t FROM documents)""")
def lexicon_tags(spark, sf_dir):
    t = A.documents(spark, sf_dir).select("doc_id", X.tokens(F.col("text")).alias("t"))
    toks = F.col("t")
    return t.select(
        "doc_id", F.array_join(X.people(toks), " ").alias("people"), F.array_join(X.locations(toks), " ").alias("locations"),
        F.md5(F.array_join(X.actions(toks), " ")).alias("actions"), F.md5(F.array_join(X.objects(toks), " ")).alias("objects"))
