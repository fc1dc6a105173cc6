"""Joins to other text sources by time, by wording, by nearest time; contexts that need every clip matched."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plotline.operators import matching as M
from plotline.operators import scoring as K
from plotline.operators import sequence as Q
from plotline.operators.ordering import longest_group, neighbour_columns, positions
from plotline.plans import oracle_views as O
from plotline.plans.registry import query
from plotline.sources import adapters as A

CONTEXT = 3


def probes(spark, sf_dir):
    return A.timed(spark, sf_dir).withColumnsRenamed({"start_s": "l_start", "end_s": "l_end"})


GENERATED = ("alpha", "beta", "gamma")
LENGTHS = (1, 2, 4, 8)
_SOURCES = ", ".join(f"('{s}', {i})" for i, s in enumerate(GENERATED))

O.VIEWS["v_tried"] = (("v_timed",), f"SELECT t.*, s.source FROM v_timed t CROSS JOIN (VALUES {_SOURCES}) s(source, number)")
O.VIEWS["v_by_time"] = (("v_timed", "v_generated"), """
    SELECT event_id, source, ord, text FROM (
      SELECT t.event_id, g.source, g.ord, g.text, row_number() OVER (PARTITION BY t.event_id, g.source ORDER BY g.r_start, g.r_end, g.ord) AS n
      FROM v_timed t JOIN v_generated g ON g.key = t.key AND abs(g.r_start - t.start_s) <= 0.02 AND abs(g.r_end - t.end_s) <= 0.02)
    WHERE n = 1""")
O.VIEWS["v_index"] = (("v_generated",), f"""
    SELECT source, key, {O.compare_key('ground_truth')} AS tkey, r_start, r_end, ord, text FROM v_generated
    UNION ALL SELECT source, key, {O.lookup_key('ground_truth')}, r_start, r_end, ord, text FROM v_generated""")
O.VIEWS["v_by_text"] = (("v_tried", "v_index"), f"""
    SELECT event_id, source, ord, text FROM (
      SELECT p.event_id, p.source, i.ord, i.text, p.n, abs(i.r_start - p.start_s) + abs(i.r_end - p.end_s) AS d,
             row_number() OVER (PARTITION BY p.event_id, p.source ORDER BY abs(i.r_start - p.start_s) + abs(i.r_end - p.end_s), i.ord) AS rn
      FROM (SELECT t.event_id, t.source, t.key, t.start_s, t.end_s, coalesce(c1.n, c2.n) AS n, CASE WHEN c1.n IS NOT NULL THEN t.k1 ELSE t.k2 END AS tkey
            FROM (SELECT *, {O.compare_key('text')} AS k1, {O.lookup_key('text')} AS k2 FROM v_tried) t
            LEFT JOIN (SELECT source, key, tkey, count(*) AS n FROM v_index GROUP BY ALL) c1 ON c1.source = t.source AND c1.key = t.key AND c1.tkey = t.k1
            LEFT JOIN (SELECT source, key, tkey, count(*) AS n FROM v_index GROUP BY ALL) c2 ON c2.source = t.source AND c2.key = t.key AND c2.tkey = t.k2
            WHERE coalesce(c1.n, c2.n) IS NOT NULL) p
      JOIN v_index i ON i.source = p.source AND i.key = p.key AND i.tkey = p.tkey)
    WHERE rn = 1 AND (n = 1 OR d <= 6.0)""")
O.VIEWS["v_matched"] = (("v_by_time", "v_by_text"), """
    SELECT event_id, source, ord, text, 'time' AS matched_by FROM v_by_time
    UNION ALL SELECT event_id, source, ord, text, 'text' FROM v_by_text ANTI JOIN v_by_time USING (event_id, source)""")
O.VIEWS["v_context"] = (("v_matched", "v_timed"), f"""
    SELECT c.item, s.source, c.place, c.event_id, m.text FROM (
      SELECT o.event_id AS item, p.pos - o.pos + {CONTEXT} AS place, p.event_id
      FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start_s, event_id) AS pos FROM v_timed) o
      JOIN (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start_s, event_id) AS pos FROM v_timed) p
        ON p.key = o.key AND p.pos < o.pos AND p.pos >= o.pos - {CONTEXT}) c
    CROSS JOIN (VALUES {_SOURCES}) s(source, number) LEFT JOIN v_matched m ON m.event_id = c.event_id AND m.source = s.source""")


@query("tolerance_join", O.with_views("SELECT event_id, source, ord, text FROM v_by_time", "v_by_time"))
def tolerance_join(spark, sf_dir):
    found = M.tolerance_match(probes(spark, sf_dir), A.generated(spark, sf_dir), ["event_id"], ["key"], ["ord", "text"], by=["source"])
    return found.select("event_id", "source", "ord", "text")


@query("text_key_join", O.with_views("SELECT event_id, source, ord, text FROM v_by_text", "v_by_text"))
def text_key_join(spark, sf_dir):
    found = M.text_match(probes(spark, sf_dir), A.generated(spark, sf_dir), ["event_id"], ["key"], ["ord", "text"], by=["source"], times=False)
    return found.select("event_id", "source", "ord", "text")


@query("nearest_join", O.with_views("""
    SELECT event_id, source, ord, round(e, 6) AS error FROM (
      SELECT t.event_id, g.source, g.ord, greatest(abs(g.r_start - t.start_s), abs(g.r_end - t.end_s)) AS e,
             row_number() OVER (PARTITION BY t.event_id, g.source ORDER BY greatest(abs(g.r_start - t.start_s), abs(g.r_end - t.end_s)), g.ord) AS n
      FROM v_timed t JOIN v_generated g ON g.key = t.key AND greatest(abs(g.r_start - t.start_s), abs(g.r_end - t.end_s)) < 0.4)
    WHERE n = 1""", "v_timed", "v_generated"))
def nearest_join(spark, sf_dir):
    found = M.nearest_match(probes(spark, sf_dir), A.generated(spark, sf_dir), ["event_id"], ["key"], ["ord"], by=["source"])
    return found.select("event_id", "source", "ord", F.round("error", 6).alias("error"))


def contexts(spark, sf_dir):
    """Last three events of the same user as context; each source's text of them, all or nothing."""
    rows = probes(spark, sf_dir)
    # Skew check on the raw table; the sequence key is a function of the user id.
    longest = longest_group(A.table(spark, sf_dir, "events"), ["user_id"])
    ordered = positions(rows, ["key"], ["l_start", "event_id"], "pos", longest)
    framed = neighbour_columns(
        ordered, ["key"], "pos", {"before": lambda w: F.collect_list("event_id").over(w.rowsBetween(-CONTEXT, -1))},
        before=CONTEXT, after=0, longest=longest)
    wanted = framed.select(F.col("event_id").alias("item"), F.posexplode("before").alias("place", "source_event"))
    matched = M.match_texts(rows, A.generated(spark, sf_dir), ["event_id"], ["key"], ["text"], by=["source"], times=False)
    # A place goes with the texts of all sources to its item; only there is it listed for each source.
    told = matched.groupBy(F.col("event_id").alias("source_event")).agg(F.map_from_entries(F.collect_list(F.struct("source", "text"))).alias("told"))
    asked = wanted.join(M.shuffled(told), "source_event", "left").repartition("item").withColumn("source", F.explode(F.array(*map(F.lit, GENERATED))))
    placed = asked.withColumns({"text": F.col("told")[F.col("source")], "clip_id": F.col("source_event").cast("string")})
    return M.materialize_context(placed, ["item", "source"])


@query("context_materialize", O.with_views("""
    SELECT item, source, array_to_string(list(text ORDER BY place), '|') AS context FROM v_context
    GROUP BY item, source HAVING count(*) = count(text)""", "v_context"))
def context_materialize(spark, sf_dir):
    return contexts(spark, sf_dir).filter("complete").select("item", "source", F.array_join("context", "|").alias("context"))


@query("unmatched_report", O.with_views("""
    SELECT item, source, array_to_string(list_sort(list(event_id::VARCHAR) FILTER (text IS NULL)), ',') AS unmatched FROM v_context
    GROUP BY item, source HAVING count(*) > count(text)""", "v_context"))
def unmatched_report(spark, sf_dir):
    return contexts(spark, sf_dir).filter("NOT complete").select("item", "source", F.array_join("unmatched", ",").alias("unmatched"))


O.VIEWS["v_all_matched"] = (("v_matched",), "SELECT event_id, source FROM v_matched")
O.VIEWS["v_eval"] = (("v_tried", "v_all_matched", "v_timed"), f"""
    WITH pos AS (SELECT event_id, key, row_number() OVER (PARTITION BY key ORDER BY start_s, event_id) AS pos FROM v_timed),
    runs AS (SELECT s.source, s.number, k.k FROM (VALUES {_SOURCES}) s(source, number) CROSS JOIN (VALUES (1), (2), (4), (8)) k(k)),
    gone AS (SELECT o.event_id, r.source, r.k, count(*) AS lost FROM pos o JOIN pos p ON p.key = o.key AND p.pos < o.pos AND p.pos >= o.pos - 8
             JOIN runs r ON p.pos >= o.pos - r.k LEFT JOIN v_all_matched m ON m.event_id = p.event_id AND m.source = r.source
             WHERE m.event_id IS NULL GROUP BY ALL)
    SELECT o.event_id, r.source, r.k, g.lost IS NULL AS complete, (o.event_id * 3 + r.k * 2 + r.number) % 7 < 4 AS correct,
           bool_and(g.lost IS NULL) OVER (PARTITION BY o.event_id) AS common
    FROM pos o CROSS JOIN runs r LEFT JOIN gone g ON g.event_id = o.event_id AND g.source = r.source AND g.k = r.k""")


def matched_sources(spark, sf_dir):
    """Events with the list of sources that have a text for them, by time or wording."""
    rows = probes(spark, sf_dir)
    matched = M.match_texts(rows, A.generated(spark, sf_dir), ["event_id"], ["key"], ["text"], by=["source"], times=False)
    found = matched.groupBy("event_id").agg(F.collect_set("source").alias("found"))
    return rows.join(M.shuffled(found), "event_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))


def _holds(source):
    return lambda found: F.array_contains(found, source)


def evaluated(spark, sf_dir):
    """Every event as an item, asked with the last k events of its user as context, told by each source.

    One frame of eight serves all lengths: a run leaves out the items of which it lacks a text.
    """
    longest = longest_group(A.table(spark, sf_dir, "events"), ["user_id"])
    ordered = positions(matched_sources(spark, sf_dir).select("event_id", "key", "l_start", "found"), ["key"], ["l_start", "event_id"], "pos", longest)
    framed = neighbour_columns(ordered, ["key"], "pos", {"before": lambda w: F.collect_list("found").over(w.rowsBetween(-max(LENGTHS), -1))},
                               before=max(LENGTHS), after=0, longest=longest)
    runs = []
    for number, source in enumerate(GENERATED):
        for k in LENGTHS:
            complete = F.forall(Q.last_k(F.col("before"), k), _holds(source))
            correct = F.pmod(F.col("event_id") * 3 + k * 2 + number, F.lit(7)) < 4
            runs.append(F.struct(F.lit(source).alias("source"), F.lit(k).alias("k"), complete.alias("complete"), correct.alias("correct")))
    rows = framed.select("event_id", F.array(*runs).alias("runs"))
    return rows.withColumn("common", F.forall("runs", lambda r: r["complete"])).select("event_id", "common", F.inline("runs"))


@query("context_eval", O.with_views("""
    WITH runs AS (
      SELECT source, k, count(*) FILTER (complete) AS num_examples, count(*) FILTER (NOT complete) AS num_unmatched,
             count(*) FILTER (complete AND correct) AS num_correct, count(*) FILTER (common) AS num_common, count(*) FILTER (common AND correct) AS common_correct
      FROM v_eval GROUP BY ALL
      UNION ALL SELECT 'shared', 0, count(*), 0, count(*) FILTER (event_id % 7 < 3), NULL, NULL FROM v_timed),
    acc AS (SELECT *, coalesce(num_correct / nullif(num_examples, 0), 0) AS a FROM runs)
    SELECT source, k, num_examples, num_unmatched, num_correct, round(a, 6) AS accuracy, round(a - (SELECT a FROM acc WHERE k = 0), 6) AS gain,
           k = 0 AS shared_baseline, num_common, common_correct FROM acc""", "v_eval", "v_timed"))
def context_eval(spark, sf_dir):
    """Accuracy per source and context length over the items that are matched, and over those matched in every run; gain over a shared k = 0 run."""
    rows = evaluated(spark, sf_dir).groupBy("source", "k").agg(
        F.count_if("complete").alias("num_examples"), F.count_if(~F.col("complete")).alias("num_unmatched"),
        F.count_if(F.col("complete") & F.col("correct")).alias("num_correct"), F.count_if("common").alias("num_common"),
        F.count_if(F.col("common") & F.col("correct")).alias("common_correct"))
    none = F.lit(None).cast("bigint")
    shared = A.table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("num_examples"), F.count_if(F.col("event_id") % 7 < 3).alias("num_correct")).select(
        F.lit("shared").alias("source"), F.lit(0).alias("k"), "num_examples", F.lit(0).cast("bigint").alias("num_unmatched"), "num_correct",
        none.alias("num_common"), none.alias("common_correct"))
    runs = rows.select(*shared.columns).unionByName(shared)
    runs = runs.withColumn("accuracy", F.coalesce(F.try_divide("num_correct", "num_examples"), F.lit(0.0)))
    # One row per run: the window over all of them is a dozen rows.
    baseline = F.max(F.when(F.col("k") == 0, F.col("accuracy"))).over(Window.partitionBy())
    gained = K.context_gain(runs, shared_accuracy=baseline)
    return gained.select("source", "k", "num_examples", "num_unmatched", "num_correct", F.round("accuracy", 6).alias("accuracy"), F.round("gain", 6).alias("gain"),
                         (F.col("k") == 0).alias("shared_baseline"), "num_common", "common_correct")


@query("unmatched_contexts", O.with_views("""
    SELECT t.source, t.movie, t.event_id, round(t.start_s, 3) AS l_start, round(t.end_s, 3) AS l_end
    FROM v_tried t LEFT JOIN v_all_matched m USING (event_id, source) WHERE m.event_id IS NULL""", "v_tried", "v_all_matched"))
def unmatched_contexts(spark, sf_dir):
    """Events that a source has no text for, with movie and both times."""
    rows = matched_sources(spark, sf_dir)
    lost = F.array_except(F.array(*map(F.lit, GENERATED)), F.col("found"))
    return rows.select(F.explode(lost).alias("source"), "movie", "event_id", F.round("l_start", 3).alias("l_start"), F.round("l_end", 3).alias("l_end"))
