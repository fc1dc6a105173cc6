"""Scores and picks of showcase, comparison and weak items."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import scalars as S
from plotline.operators import picks as T
from plotline.plans import oracle_views as O
from plotline.plans.registry import query
from plotline.plans.scoring import outcomes
from plotline.sources import adapters as A

O.VIEWS["v_scored_items"] = (("v_examples", "v_outcomes"), f"""
    SELECT *, {O.overlap('aw', 'tw')} AS t, coalesce(list_max(list_transform(cw, lambda w: {O.overlap('aw', 'w')})), 0.0::DOUBLE) AS c,
           list_intersect(CASE WHEN len(sw) > 0 THEN sw ELSE list_distinct(flatten(cw)) END, aw) AS bridge
    FROM (SELECT e.*, o.human, o.alpha, o.beta, o.none, {O.word_set('answer_text')} AS aw, {O.word_set('target_sentence')} AS tw,
                 list_transform(context_sentences, lambda s: {O.word_set('s')}) AS cw,
                 list_transform(context_sentences, lambda s: {O.word_set("replace(s, 'er', 'or')")}) AS first_cw,
                 list_transform(context_sentences, lambda s: {O.word_set("replace(s, 'th', 'ht')")}) AS second_cw,
                 list_distinct(flatten(list_transform(evidence_raw, lambda v: {O.word_set('v.span')}))) AS sw
          FROM v_examples e LEFT JOIN v_outcomes o USING (id))""")


def items(spark, sf_dir):
    """Items with outcomes, overlaps and bridge words. Two altered copies of the context stand for generated texts."""
    n = A.longest_conversation(spark, sf_dir)
    rows = A.examples(spark, sf_dir, n).join(outcomes(spark, sf_dir, n), "id", "left").withColumn("evidence", F.col("evidence_raw"))
    rows = T.with_overlaps(T.with_word_sets(rows))

    def drops(old: str, new: str):
        per_clip = F.transform("context_sentences", lambda s: T.dropped_words(F.col("bridge"), s, F.replace(s, F.lit(old), F.lit(new))))
        return F.aggregate(per_clip, F.lit(0), lambda a, x: a + x)

    return rows.withColumns({"first_drops": drops("er", "or"), "second_drops": drops("th", "ht")})


_RULE = f"""(CASE WHEN human THEN 3 ELSE 0 END + CASE WHEN alpha THEN 1 ELSE 0 END + CASE WHEN len(context_sentences) <= 2 THEN 2 ELSE 0 END
    + CASE WHEN expectedness >= 0.7 THEN 2 ELSE 0 END
    + CASE WHEN len(list_filter(evidence_raw, lambda v: len(list_intersect({O.word_set('v.span')}, aw)) > 0)) > 0 THEN 2 ELSE 0 END
    + CASE WHEN target_type IN ('object_reveal','spatial_consequence','state_change','participant_update') THEN 1 ELSE 0 END
    + CASE WHEN len(list_filter(context_sentences, lambda s: length(s) = 0)) > 0 THEN -2 ELSE 0 END + CASE WHEN none THEN -2 ELSE 0 END
    + CASE WHEN t >= 0.6 THEN -2 ELSE 0 END + CASE WHEN c > t + 0.1 AND c >= 0.3 THEN -5 ELSE 0 END
    + CASE WHEN question_type <> 'what_happens_next' THEN -1 ELSE 0 END + CASE WHEN has_video THEN 1 ELSE 0 END)::DOUBLE"""
O.VIEWS["v_rule"] = (("v_scored_items",), f"SELECT *, {_RULE} AS score FROM v_scored_items")


@query("rule_score", O.with_views("SELECT id, score FROM v_rule", "v_rule"))
def rule_score(spark, sf_dir):
    return T.rule_score(items(spark, sf_dir)).select("id", "score")


def _drops(words: str) -> str:
    return (f"list_sum(list_transform(list_zip(cw, {words}), lambda z: len(list_filter(list_intersect(z[1], bridge), "
            "lambda w: NOT list_contains(z[2], w)))))")


O.VIEWS["v_drops"] = (("v_scored_items",), f"""
    SELECT *, coalesce({_drops('first_cw')}, 0)::BIGINT AS first_drops, coalesce({_drops('second_cw')}, 0)::BIGINT AS second_drops FROM v_scored_items""")


@query("keyword_drops", O.with_views("""
    SELECT id, array_to_string(list_sort(bridge), ',') AS bridge, first_drops, second_drops FROM v_drops""", "v_drops"))
def keyword_drops(spark, sf_dir):
    return items(spark, sf_dir).select(
        "id", F.array_join(F.array_sort("bridge"), ",").alias("bridge"), F.col("first_drops").cast("bigint").alias("first_drops"),
        F.col("second_drops").cast("bigint").alias("second_drops"))


_COMPARE = """(CASE WHEN NOT alpha THEN 1.5 ELSE 0 END + CASE WHEN NOT beta THEN 1.5 ELSE 0 END + CASE WHEN NOT alpha AND NOT beta THEN 2 ELSE 0 END
    + 2 + CASE WHEN len(bridge) > 0 THEN 1 ELSE 0 END + CASE WHEN first_drops > 0 THEN 1.5 ELSE 0 END
    + CASE WHEN second_drops > 0 THEN 1.5 ELSE 0 END + CASE WHEN len(context_sentences) <= 2 THEN 2 ELSE 0 END)::DOUBLE"""
O.VIEWS["v_compare"] = (("v_drops",), f"""
    SELECT *, {_COMPARE} AS score FROM v_drops WHERE human AND alpha IS NOT NULL AND beta IS NOT NULL AND NOT (alpha AND beta)
      AND NOT coalesce(none, false) AND NOT (c > t + 0.1 AND c >= 0.3) AND t >= 0.15""")


@query("comparison_score", O.with_views("SELECT id, score FROM v_compare", "v_compare"))
def comparison_score(spark, sf_dir):
    return T.comparison_score(items(spark, sf_dir), "human", ("alpha", "beta"), "none").select("id", "score")


@query("capped_topk", O.with_views("""
    SELECT id, movie, score FROM (SELECT *, row_number() OVER (PARTITION BY movie ORDER BY score DESC, id) AS r FROM v_compare)
    WHERE r <= 2 ORDER BY score DESC, id LIMIT 6""", "v_compare"))
def capped_topk(spark, sf_dir):
    scored = T.comparison_score(items(spark, sf_dir), "human", ("alpha", "beta"), "none")
    return T.capped_topk(scored, "movie").select("id", "movie", "score")


@query("capped_topk2", O.with_views("""
    WITH ranked AS (SELECT id, movie, target_type, score, row_number() OVER (ORDER BY score DESC, id) AS i FROM v_rule WHERE score >= 6),
    greedy AS (
      SELECT 0::BIGINT AS i, []::VARCHAR[] AS ids, []::VARCHAR[] AS movies, []::VARCHAR[] AS kinds
      UNION ALL
      SELECT r.i, CASE WHEN ok THEN list_append(ids, r.id) ELSE ids END, CASE WHEN ok THEN list_append(movies, r.movie) ELSE movies END,
             CASE WHEN ok THEN list_append(kinds, r.target_type) ELSE kinds END
      FROM (SELECT g.*, r.i AS ri, len(g.ids) < 14 AND len(list_filter(g.movies, lambda m: m = r.movie)) < 2
                   AND len(list_filter(g.kinds, lambda k: k = r.target_type)) < 4 AS ok FROM greedy g JOIN ranked r ON r.i = g.i + 1) g
      JOIN ranked r ON r.i = g.ri)
    SELECT k.id, k.movie, k.target_type, k.score FROM (SELECT unnest(ids[1:10]) AS id FROM (SELECT ids FROM greedy ORDER BY i DESC LIMIT 1)) p
    JOIN ranked k USING (id)""", "v_rule", recursive=True))
def capped_topk2(spark, sf_dir):
    scored = T.rule_score(items(spark, sf_dir))
    return T.capped_topk2(scored, "movie", "target_type").select("id", "movie", "target_type", "score")


@query("paraphrase_items", O.with_views("""
    SELECT id, round(t, 6) AS overlap FROM v_scored_items WHERE none AND t >= 0.7 ORDER BY t DESC, id LIMIT 5""", "v_scored_items"))
def paraphrase_items(spark, sf_dir):
    return T.paraphrase_items(items(spark, sf_dir), "none").select("id", F.round("target_overlap", 6).alias("overlap"))


@query("weak_items", O.with_views(f"""
    SELECT id, array_to_string(list_filter([
        CASE WHEN {O.loose_double('distractor_raw')} = 0 THEN 'distractor_quality_zero' END,
        CASE WHEN (conv_id + pos) % 3 = 0 THEN 'few_distractor_types' END,
        CASE WHEN (conv_id + pos) % 3 <> 0 AND len(list_filter(context_sentences, lambda s:
          string_split(lower(s), ' ')[1:3] = string_split(lower(target_sentence), ' ')[1:3])) > 0 THEN 'target_repeats_context' END,
        CASE WHEN t >= 0.6 THEN 'answer_near_paraphrase' END], lambda x: x IS NOT NULL), ';') AS reasons FROM v_scored_items""", "v_scored_items"))
def weak_items(spark, sf_dir):
    rows = A.examples(spark, sf_dir).withColumns({
        "distractor_quality": S.loose_double(F.col("distractor_raw")), "evidence": F.col("evidence_raw")})
    return T.with_word_sets(rows).select("id", F.array_join(T.weak_reasons(), ";").alias("reasons"))


@query("near_paraphrases")
def near_paraphrases(spark, sf_dir):
    """Items whose right option is close to the hidden target, character by character; SQL has no such ratio."""
    found = T.near_paraphrases(A.examples(spark, sf_dir))
    return found.select("id", F.round("ratio", 6).alias("ratio"))
