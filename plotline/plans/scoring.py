"""Accuracy, gain and score reports, and the split."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import labels as L
from plotline.operators import reports as R
from plotline.operators import scoring as K
from plotline.operators import splits as D
from plotline.plans import oracle_views as O
from plotline.plans.registry import query
from plotline.plans.selection import routed
from plotline.sources import adapters as A

RUN = ["source", "k"]
BEST_ACCURACY = 0.9

O.VIEWS["v_runs"] = (("v_key", "v_last"), """
    SELECT l.source, l.k, (SELECT count(*) FROM v_key) AS num_examples, count(*) AS num_predictions,
           (SELECT count(*) FROM v_key) - count(*) FILTER (e.answer_idx IS NOT NULL AND l.prediction IS NOT NULL) AS num_missing,
           count(*) FILTER (l.prediction = e.answer_idx) AS num_correct,
           count(*) FILTER (l.prediction = e.answer_idx)::DOUBLE / (SELECT count(*) FROM v_key) AS accuracy
    FROM v_last l LEFT JOIN v_key e USING (id) GROUP BY l.source, l.k""")


@query("mcq_metrics", O.with_views("""
    SELECT source, k, num_examples, num_predictions, num_missing, num_correct, round(accuracy, 6) AS accuracy FROM v_runs""", "v_runs"))
def mcq_metrics(spark, sf_dir):
    n = A.longest_conversation(spark, sf_dir)
    runs = K.run_metrics(A.answer_key(spark, sf_dir, n), A.predictions(spark, sf_dir, n), RUN)
    return runs.withColumn("accuracy", F.round("accuracy", 6))


@query("source_metrics", O.with_views("""
    SELECT p.source, p.k, p.num_invalid, coalesce(v.num_predictions, 0) AS num_predictions, coalesce(v.num_correct, 0) AS num_correct
    FROM (SELECT source, k, count(*) FILTER (prediction IS NULL) AS num_invalid FROM v_predictions GROUP BY ALL) p
    LEFT JOIN (SELECT l.source, l.k, count(*) AS num_predictions, count(*) FILTER (l.prediction = e.answer_idx) AS num_correct
          FROM (SELECT id, source, k, arg_max(prediction, ord) AS prediction FROM v_predictions WHERE prediction IS NOT NULL GROUP BY ALL) l
          LEFT JOIN v_key e USING (id) GROUP BY ALL) v USING (source, k)""", "v_predictions", "v_key"))
def source_metrics(spark, sf_dir):
    n = A.longest_conversation(spark, sf_dir)
    rows = K.source_metrics(A.answer_key(spark, sf_dir, n), A.predictions(spark, sf_dir, n), RUN)
    return rows.select(*RUN, "num_invalid", "num_predictions", "num_correct")


@query("label_distribution", O.with_views("""
    SELECT 'gold' AS kind, answer_idx AS label, count(*) AS n FROM v_key GROUP BY ALL
    UNION ALL SELECT 'prediction', prediction, count(*) FROM v_last WHERE source = 'a' AND k = 8 AND prediction IS NOT NULL
      AND id IN (SELECT id FROM v_key) GROUP BY ALL""", "v_key", "v_last"))
def label_distribution(spark, sf_dir):
    n = A.longest_conversation(spark, sf_dir)
    one_run = A.predictions(spark, sf_dir, n).filter("source = 'a' AND k = 8")
    return K.label_distribution(A.answer_key(spark, sf_dir, n), one_run).select("kind", F.col("label").cast("bigint").alias("label"), "n")


@query("group_accuracy", O.with_views("""
    SELECT e.movie, count(*) FILTER (l.prediction = e.answer_idx) AS num_correct, count(*) AS num_examples,
           round(count(*) FILTER (l.prediction = e.answer_idx)::DOUBLE / count(*), 6) AS accuracy
    FROM v_key e LEFT JOIN (SELECT * FROM v_last WHERE source = 'a' AND k = 8) l USING (id) GROUP BY e.movie""", "v_key", "v_last"))
def group_accuracy(spark, sf_dir):
    n = A.longest_conversation(spark, sf_dir)
    one_run = A.predictions(spark, sf_dir, n).filter("source = 'a' AND k = 8")
    return K.group_accuracy(A.answer_key(spark, sf_dir, n), one_run).withColumn("accuracy", F.round("accuracy", 6))


@query("macro_accuracy", O.with_views("""
    SELECT source, k, round(avg(acc), 6) AS macro_accuracy, sum(right_ones)::BIGINT AS num_correct FROM (
      SELECT r.source, r.k, e.movie, count(*) FILTER (l.prediction = e.answer_idx) AS right_ones,
             count(*) FILTER (l.prediction = e.answer_idx)::DOUBLE / count(*) AS acc
      FROM v_key e CROSS JOIN (SELECT DISTINCT source, k FROM v_last) r
      LEFT JOIN v_last l ON l.id = e.id AND l.source = r.source AND l.k = r.k GROUP BY ALL) GROUP BY ALL""", "v_key", "v_last"))
def macro_accuracy(spark, sf_dir):
    n = A.longest_conversation(spark, sf_dir)
    rows = K.macro_accuracy(A.answer_key(spark, sf_dir, n), A.predictions(spark, sf_dir, n), RUN)
    return rows.withColumn("macro_accuracy", F.round("macro_accuracy", 6))


O.VIEWS["v_gain"] = (("v_runs",), f"""
    SELECT r.source, r.k, r.num_examples, r.num_correct, r.accuracy, b.accuracy AS acc0, r.accuracy - b.accuracy AS gain,
           (r.accuracy - b.accuracy) / ({BEST_ACCURACY}::DOUBLE - b.accuracy) AS normalized_gain
    FROM v_runs r JOIN v_runs b ON b.source = r.source AND b.k = 0""")


def gains(spark, sf_dir):
    n = A.longest_conversation(spark, sf_dir)
    runs = K.run_metrics(A.answer_key(spark, sf_dir, n), A.predictions(spark, sf_dir, n), RUN)
    return K.context_gain(runs, best_accuracy=BEST_ACCURACY)


@query("context_gain", O.with_views("""
    SELECT source, k, num_examples, num_correct, round(accuracy, 6) AS accuracy, round(gain, 6) AS gain,
           round(100.0::DOUBLE * gain, 6) AS gain_points, round(normalized_gain, 6) AS normalized_gain FROM v_gain""", "v_gain"))
def context_gain(spark, sf_dir):
    """Flagship: how much each source's context of each length changes the accuracy."""
    rounded = [F.round(c, 6).alias(c) for c in ("accuracy", "gain", "gain_points", "normalized_gain")]
    return gains(spark, sf_dir).select(*RUN, "num_examples", "num_correct", *rounded)


@query("context_gain_shared", O.with_views("""
    SELECT r.source, r.k, round(r.accuracy - b.accuracy, 6) AS gain FROM v_runs r, (SELECT accuracy FROM v_runs WHERE source = 'a' AND k = 0) b
    WHERE r.k <> 0""", "v_runs"))
def context_gain_shared(spark, sf_dir):
    """One run without context as the baseline of all sources."""
    n = A.longest_conversation(spark, sf_dir)
    runs = K.run_metrics(A.answer_key(spark, sf_dir, n), A.predictions(spark, sf_dir, n), RUN)
    shared = runs.filter("source = 'a' AND k = 0").select("accuracy").scalar()
    return K.context_gain(runs.filter("k <> 0"), shared_accuracy=shared).select(*RUN, F.round("gain", 6).alias("gain"))


@query("context_gain_area", O.with_views("""
    SELECT source, round(avg(normalized_gain), 6) AS gain_area FROM v_gain WHERE k <> 0 GROUP BY source""", "v_gain"))
def context_gain_area(spark, sf_dir):
    return K.gain_area(gains(spark, sf_dir)).withColumn("gain_area", F.round("gain_area", 6))


@query("scaling_table", O.with_views("""
    SELECT label, k, round(100.0::DOUBLE * accuracy, 6) AS accuracy_percent, round(100.0::DOUBLE * gain, 6) AS gain_points, num_correct
    FROM (SELECT *, CASE source WHEN 'a' THEN 'Human text' WHEN 'b' THEN 'Generated text' ELSE source END AS label FROM v_gain)
    WHERE label <> 'c'""", "v_gain"))
def scaling_table(spark, sf_dir):
    named = R.scaling_table(gains(spark, sf_dir), {"a": "Human text", "b": "Generated text"}, ["c"], ["Human text", "Generated text"])
    return named.select("label", "k", F.round(100.0 * F.col("accuracy"), 6).alias("accuracy_percent"),
                        F.round("gain_points", 6).alias("gain_points"), "num_correct")


O.VIEWS["v_outcomes"] = (("v_key", "v_last"), """
    SELECT e.id, max(c) FILTER (l.source = 'a' AND l.k = 8) AS human, max(c) FILTER (l.source = 'b' AND l.k = 8) AS alpha,
           max(c) FILTER (l.source = 'c' AND l.k = 8) AS beta, max(c) FILTER (l.source = 'a' AND l.k = 0) AS none
    FROM v_key e JOIN (SELECT l.*, coalesce(l.prediction = e.answer_idx, false) AS c FROM v_last l JOIN v_key e USING (id)) l USING (id)
    GROUP BY e.id""")


def outcomes(spark, sf_dir, longest):
    """Correct flags of three sources at full context and of the run without context, one row per item."""
    named = (
        F.when((F.col("source") == "a") & (F.col("k") == 8), "human").when((F.col("source") == "b") & (F.col("k") == 8), "alpha")
        .when((F.col("source") == "c") & (F.col("k") == 8), "beta").when((F.col("source") == "a") & (F.col("k") == 0), "none")
    )
    tagged = A.predictions(spark, sf_dir, longest).withColumn("run", named).filter("run IS NOT NULL")
    latest = K.last_predictions(tagged, ["run", "id"])
    joined = latest.join(A.answer_key(spark, sf_dir, longest).select("id", "answer_idx"), "id")
    flags = joined.select("id", F.col("run").alias("source"), F.coalesce(F.col("prediction") == F.col("answer_idx"), F.lit(False)).alias("correct"))
    return K.outcome_pivot(flags, ["human", "alpha", "beta", "none"])


@query("outcome_pivot", O.with_views("SELECT id, human, alpha, beta, none FROM v_outcomes", "v_outcomes"))
def outcome_pivot(spark, sf_dir):
    return outcomes(spark, sf_dir, A.longest_conversation(spark, sf_dir))


def scored(spark, sf_dir):
    return A.examples(spark, sf_dir).select("id", "expectedness", L.reasoning_types(F.col("reasoning_raw")).alias("reasoning_type"))


@query("score_summary", O.with_views("""
    SELECT count(*) AS count, round(avg(expectedness), 6) AS mean, round(quantile_cont(expectedness, 0.5), 6) AS median, min(expectedness) AS min,
           max(expectedness) AS max, count(*) FILTER (expectedness > 0.8) AS above, count(*) FILTER (expectedness BETWEEN 0.4 AND 0.8) AS between,
           count(*) FILTER (expectedness < 0.4) AS below, count(*) FILTER (expectedness IS NULL) AS nulls FROM v_examples""", "v_examples"))
def score_summary(spark, sf_dir):
    return R.score_summary(scored(spark, sf_dir)).withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


@query("score_by_label", O.with_views("""
    SELECT label, count(*) AS count, count(*) FILTER (expectedness IS NULL) AS nulls, round(avg(expectedness), 6) AS mean
    FROM (SELECT expectedness, unnest(CASE WHEN len(reasoning_raw) = 0 THEN ['unknown'] ELSE reasoning_raw END) AS label FROM v_examples)
    GROUP BY label""", "v_examples"))
def score_by_label(spark, sf_dir):
    rows = A.examples(spark, sf_dir).select("expectedness", F.col("reasoning_raw").alias("reasoning_type"))
    return R.score_by_label(rows).withColumn("mean", F.round("mean", 6))


@query("top_values", O.with_views(f"""
    SELECT path, value, n FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, value) AS r FROM (
      SELECT path, value, count(*) AS n FROM (
        SELECT 'target_type' AS path, coalesce(target_type, 'None') AS value FROM v_examples
        UNION ALL SELECT 'continuity_type', coalesce(continuity_raw, 'None') FROM v_examples
        UNION ALL SELECT 'reasoning_type', unnest(reasoning_raw) FROM v_examples
        UNION ALL SELECT 'target_sentence', target_sentence FROM v_examples) GROUP BY ALL)) WHERE r <= 8""", "v_examples"))
def top_values(spark, sf_dir):
    return R.top_values(A.examples(spark, sf_dir), {
        "target_type": F.array("target_type"), "continuity_type": F.array("continuity_raw"),
        "reasoning_type": F.col("reasoning_raw"), "target_sentence": F.array("target_sentence")})


@query("failure_reasons", O.with_views("""
    SELECT failure_reason AS reason, count(*) AS n FROM v_routed WHERE route = 'rejected' AND failure_reason IS NOT NULL GROUP BY ALL""", "v_routed"))
def failure_reasons(spark, sf_dir):
    return R.failure_reasons(routed(spark, sf_dir).filter("route = 'rejected'"))


@query("stage_funnel", O.with_views("""
    SELECT 'elements' AS stage, count(*) AS n FROM v_ordered UNION ALL SELECT 'blocks', count(*) FROM v_blocks
    UNION ALL SELECT 'examples', count(*) FROM v_key UNION ALL SELECT 'kept', count(*) FROM v_routed WHERE route = 'kept'""",
    "v_ordered", "v_blocks", "v_key", "v_routed"))
def stage_funnel(spark, sf_dir):
    n = A.longest_conversation(spark, sf_dir)
    return R.stage_funnel({
        "elements": A.clips(spark, sf_dir), "blocks": A.blocks(spark, sf_dir, n), "examples": A.answer_key(spark, sf_dir, n),
        "kept": routed(spark, sf_dir, n).filter("route = 'kept'")})


O.VIEWS["v_sizes"] = (("v_key",), """
    SELECT *, row_number() OVER (ORDER BY size DESC, movie) AS i FROM (SELECT movie, count(*) AS size FROM v_key GROUP BY movie)""")
_FOLD = """
    WITH t AS (SELECT sum(size) * 0.8::DOUBLE AS a, sum(size) * 0.1::DOUBLE AS b, sum(size) * 0.1::DOUBLE AS c FROM v_sizes),
    fold AS (
      SELECT 0::BIGINT AS i, '' AS movie, 0::BIGINT AS size, '' AS split, 0::DOUBLE AS x, 0::DOUBLE AS y, 0::DOUBLE AS z
      UNION ALL
      SELECT i, movie, size, s, x + CASE WHEN s = 'train' THEN size ELSE 0 END, y + CASE WHEN s = 'val' THEN size ELSE 0 END,
             z + CASE WHEN s = 'test' THEN size ELSE 0 END
      FROM (SELECT g.i, g.movie, g.size, f.x, f.y, f.z, CASE
              WHEN (f.x/t.a, f.x) <= (f.y/t.b, f.y) AND (f.x/t.a, f.x) <= (f.z/t.c, f.z) THEN 'train'
              WHEN (f.y/t.b, f.y) <= (f.z/t.c, f.z) THEN 'val' ELSE 'test' END AS s
            FROM fold f JOIN v_sizes g ON g.i = f.i + 1, t))"""


@query("group_split", O.with_views(_FOLD + " SELECT movie, size, split FROM fold WHERE i > 0", "v_sizes", recursive=True))
def group_split(spark, sf_dir):
    return D.group_split(A.answer_key(spark, sf_dir))


@query("split_sizes", O.with_views(_FOLD + " SELECT split, sum(size)::BIGINT AS n FROM fold WHERE i > 0 GROUP BY split", "v_sizes", recursive=True))
def split_sizes(spark, sf_dir):
    return D.group_split(A.answer_key(spark, sf_dir)).groupBy("split").agg(F.sum("size").alias("n"))
