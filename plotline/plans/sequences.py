"""Order, blocks, contexts, walks and continuity features."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import text as X
from plotline.operators import selection as P
from plotline.operators import sequence as Q
from plotline.operators import similarity as V
from plotline.operators import walk as W
from plotline.plans import oracle_views as O
from plotline.plans.registry import query
from plotline.sources import adapters as A

SELECTION_THRESHOLD = 0.5
BUDGET = 100


@query("clip_order", O.with_views("SELECT movie, pos, clip_id FROM v_ordered", "v_ordered"))
def clip_order(spark, sf_dir):
    return A.ordered_clips(spark, sf_dir).select("movie", "pos", "clip_id")


@query("search_blocks", O.with_views("""
    SELECT block_id, movie, block_start, block_end, array_to_string(list_transform(clips, lambda c: c.clip_id), ',') AS members
    FROM v_blocks""", "v_blocks"))
def search_blocks(spark, sf_dir):
    return A.blocks(spark, sf_dir).select(
        "block_id", "movie", "block_start", "block_end",
        F.array_join(F.transform("clips", lambda c: c["clip_id"]), ",").alias("members"))


@query("line_blocks", """
    WITH lines AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos
                     FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS l FROM documents)))
    SELECT doc_id, pos AS block_start, pos + len(m) - 1 AS block_end, md5(array_to_string(m, ' ')) AS digest
    FROM (SELECT *, list(line) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m FROM lines)
    WHERE length(trim(array_to_string(m, ' '))) >= 20""")
def line_blocks(spark, sf_dir):
    """Blocks over the lines of whole documents. A text lies in one row, so no line has to be shuffled."""
    docs = A.documents(spark, sf_dir).select("doc_id", X.lines(F.col("text")).alias("lines"))
    members = F.transform("lines", lambda ln, i: F.slice("lines", i + 1, 3))
    rows = docs.select("doc_id", F.posexplode(members).alias("pos", "m"))
    joined = F.array_join("m", " ")
    return rows.filter(F.length(F.trim(joined)) >= 20).select(
        "doc_id", F.col("pos").cast("bigint").alias("block_start"),
        (F.col("pos") + F.size("m") - 1).cast("bigint").alias("block_end"), F.md5(joined).alias("digest"))


@query("last_k_context", O.with_views("""
    SELECT id, k, array_to_string(list_transform(prior[greatest(len(prior) - k + 1, 1):len(prior)], lambda c: c.clip_id), ',') AS context
    FROM v_items CROSS JOIN (VALUES (0),(1),(2),(4),(8)) ks(k)""", "v_items"))
def last_k_context(spark, sf_dir):
    """All context lengths from one frame of eight."""
    items = A.examples(spark, sf_dir).select("id", F.transform("prior", lambda c: c["clip_id"]).alias("prior"))
    ks = items.select("*", F.explode(F.array(*[F.lit(k) for k in A.CONTEXT_LENGTHS])).alias("k"))
    return ks.select("id", "k", F.array_join(Q.last_k(F.col("prior"), F.col("k")), ",").alias("context"))


@query("strict_prior", O.with_views("""
    SELECT block_id, array_to_string(list_transform(list_filter(clips, lambda c:
             CASE WHEN length(c.text) < 60 THEN NULL ELSE c.sequence_index END IS NULL OR c.sequence_index < block_start + 2),
             lambda c: c.clip_id), ',') AS kept FROM v_blocks""", "v_blocks"))
def strict_prior(spark, sf_dir):
    """Blocks as contexts of their third clip; short clips carry no sequence number."""
    context = F.transform("clips", lambda c: F.struct(
        c["clip_id"].alias("clip_id"), F.when(F.length(c["text"]) >= 60, c["sequence_index"]).alias("sequence_index")))
    rows = A.blocks(spark, sf_dir).select("block_id", context.alias("context"), (F.col("block_start") + 2).alias("target_index"))
    kept = Q.strictly_prior(F.col("context"), F.col("target_index"))
    return rows.select("block_id", F.array_join(F.transform(kept, lambda c: c["clip_id"]), ",").alias("kept"))


def selection_rows(spark, sf_dir, longest=None):
    return P.materialize(A.decisions(spark, sf_dir, longest), SELECTION_THRESHOLD)


def _steps(spark, sf_dir, longest):
    rows = P.resolve_target(A.decisions(spark, sf_dir, longest))
    return rows.select("movie", "block_start", "called", W.step_of(F.col("found"), F.col("target_position")).alias("step"))


_STEPS = "SELECT movie, block_start, called, CASE WHEN found THEN pos_in_block ELSE 1 END AS step FROM v_resolved"


@query("target_walk", O.with_views(f"""
    WITH steps AS ({_STEPS}),
    visited AS (
      SELECT movie, min(block_start) AS block_start FROM steps GROUP BY movie
      UNION ALL
      SELECT v.movie, v.block_start + s.step FROM visited v JOIN steps s ON s.movie = v.movie AND s.block_start = v.block_start)
    SELECT v.movie, v.block_start FROM visited v JOIN steps s ON s.movie = v.movie AND s.block_start = v.block_start""",
    "v_resolved", recursive=True))
def target_walk(spark, sf_dir):
    n = A.longest_conversation(spark, sf_dir)
    return W.walk(_steps(spark, sf_dir, n), A.BLOCK_WIDTH, n)


@query("walk_over_gaps", O.with_views(f"""
    WITH steps AS (SELECT * FROM ({_STEPS}) WHERE (block_start + length(movie)) % 4 <> 1),
    nxt AS (SELECT s.movie, s.block_start, min(t.block_start) AS next FROM steps s LEFT JOIN steps t ON t.movie = s.movie AND t.block_start >= s.block_start + s.step GROUP BY ALL),
    visited AS (
      SELECT movie, min(block_start) AS block_start FROM steps GROUP BY movie
      UNION ALL
      SELECT v.movie, n.next FROM visited v JOIN nxt n ON n.movie = v.movie AND n.block_start = v.block_start WHERE n.next IS NOT NULL)
    SELECT movie, block_start FROM visited""", "v_resolved", recursive=True))
def walk_over_gaps(spark, sf_dir):
    """A walk that goes on behind missing blocks."""
    n = A.longest_conversation(spark, sf_dir)
    some = _steps(spark, sf_dir, n).filter("(block_start + length(movie)) % 4 <> 1")
    return W.walk(some, A.BLOCK_WIDTH, n, skip_gaps=True)


@query("walk_budget", O.with_views(f"""
    WITH steps AS (SELECT movie, block_start, called, CASE WHEN called THEN step ELSE 1 END AS step FROM ({_STEPS})),
    visited AS (
      SELECT movie, min(block_start) AS block_start FROM steps GROUP BY movie
      UNION ALL
      SELECT v.movie, v.block_start + s.step FROM visited v JOIN steps s ON s.movie = v.movie AND s.block_start = v.block_start),
    called AS (SELECT v.movie, v.block_start, row_number() OVER (ORDER BY v.movie, v.block_start) AS n
               FROM visited v JOIN steps s ON s.movie = v.movie AND s.block_start = v.block_start AND s.called),
    edge AS (SELECT max(movie) FILTER (n = {BUDGET}) AS m, max(block_start) FILTER (n = {BUDGET}) AS b FROM called),
    limited AS (SELECT s.*, e.m IS NULL OR s.movie < e.m OR (s.movie = e.m AND s.block_start <= e.b) AS inside FROM steps s, edge e),
    again AS (
      SELECT movie, min(block_start) AS block_start FROM limited GROUP BY movie
      UNION ALL
      SELECT v.movie, v.block_start + CASE WHEN s.inside THEN s.step ELSE 1 END
      FROM again v JOIN limited s ON s.movie = v.movie AND s.block_start = v.block_start)
    SELECT v.movie, v.block_start, s.inside AND s.called AS used
    FROM again v JOIN limited s ON s.movie = v.movie AND s.block_start = v.block_start""", "v_resolved", recursive=True))
def walk_budget(spark, sf_dir):
    n = A.longest_conversation(spark, sf_dir)
    return W.walk_with_budget(_steps(spark, sf_dir, n), A.BLOCK_WIDTH, n, BUDGET)


@query("timestamp_gap", O.with_views(f"""
    SELECT block_id, round({O.safe_double('tstart')} - {O.safe_double('prefix[-1].timestamp_end')}, 6) AS gap FROM v_resolved""", "v_resolved"))
def timestamp_gap(spark, sf_dir):
    rows = P.resolve_target(A.decisions(spark, sf_dir))
    return rows.select("block_id", F.round(Q.timestamp_gap(F.col("prefix"), F.col("target.timestamp_start")), 6).alias("gap"))


def _tfidf_sql(source: str, key: str, left: str, right: str, out: str) -> str:
    return f"""SELECT s.{key}, coalesce(t.sim, 0.0::DOUBLE) AS {out} FROM {source} s LEFT JOIN (
        SELECT {key}, CASE WHEN sum(x*x) > 0 AND sum(y*y) > 0 THEN sum(x*y) / (sqrt(sum(x*x)) * sqrt(sum(y*y))) ELSE 0.0::DOUBLE END AS sim
        FROM (SELECT {key}, tok, a * CASE WHEN a > 0 AND b > 0 THEN 1.0::DOUBLE ELSE 1.69314718056::DOUBLE END AS x,
                     b * CASE WHEN a > 0 AND b > 0 THEN 1.0::DOUBLE ELSE 1.69314718056::DOUBLE END AS y
              FROM (SELECT {key}, tok, sum(l)::DOUBLE AS a, sum(1 - l)::DOUBLE AS b FROM (
                      SELECT {key}, 1 AS l, unnest({O.content_tokens(left)}) AS tok FROM {source}
                      UNION ALL SELECT {key}, 0, unnest({O.content_tokens(right)}) FROM {source}) GROUP BY {key}, tok))
        GROUP BY {key}) t ON t.{key} = s.{key}"""


@query("tfidf_pairs", O.with_views(f"""
    WITH pairs AS (SELECT id, prior[-1].text AS l, text AS r FROM v_items)
    SELECT id, round(similarity, 6) AS similarity FROM ({_tfidf_sql('pairs', 'id', 'l', 'r', 'similarity')})""", "v_items"))
def tfidf_pairs(spark, sf_dir):
    pairs = A.examples(spark, sf_dir).select("id", F.try_element_at("context", F.lit(-1))["text"].alias("l"), F.col("target_sentence").alias("r"))
    return V.tfidf_cosine(pairs, ["id"], "l", "r").withColumn("similarity", F.round("similarity", 6))


@query("embedding_cosine", """
    SELECT a.vec_id AS left_id, b.vec_id AS right_id,
           round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b
      ON b.vec_id = a.vec_id + 1""")
def embedding_cosine(spark, sf_dir):
    """Similarity of each vector to the next one: the pairs are given, so this is one join on ids."""
    e = A.table(spark, sf_dir, "embeddings")
    left = e.select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("a"), (F.col("vec_id") + 1).alias("right_id"))
    right = e.select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("b"))
    return left.join(right, "right_id").select(
        "left_id", "right_id", F.round(V.vector_cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


def _ratio(left: str, right: str) -> str:
    return f"CASE WHEN len({right}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({left}, {right}))::DOUBLE / len({right}) END"


def _overlap_sql(source: str, key: str) -> str:
    """Overlaps of token columns ``ct`` (context) and ``tt`` (target)."""
    entities = lambda t: f"list_distinct(list_concat({O.people(t)}, {O.objects(t)}))"
    return f"""SELECT {key}, round({_ratio(entities('ct'), entities('tt'))}, 6) AS entity_overlap,
        round({_ratio(O.actions('ct'), O.actions('tt'))}, 6) AS action_overlap,
        round({_ratio(O.locations('ct'), O.locations('tt'))}, 6) AS location_overlap FROM {source}"""


@query("overlap_ratios", O.with_views(f"""
    WITH toks AS (SELECT id, {O.tokens("array_to_string(context_sentences, ' ')")} AS ct, {O.tokens('target_sentence')} AS tt FROM v_examples)
    {_overlap_sql('toks', 'id')}""", "v_examples"))
def overlap_ratios(spark, sf_dir):
    rows = A.examples(spark, sf_dir).select("id", F.array_join("context_sentences", " ").alias("c"), F.col("target_sentence").alias("t"))
    rows = rows.select("id", X.tokens(F.col("c")).alias("c"), X.tokens(F.col("t")).alias("t"))
    return rows.select("id", *[F.round(v, 6).alias(n) for n, v in V.lexicon_overlaps(F.col("c"), F.col("t")).items()])


def continuity_pairs(rows):
    """Texts of prefix and target of resolved blocks that have a target."""
    return rows.filter(F.col("target").isNotNull()).select(
        "block_id", Q.joined_text(F.col("prefix")).alias("context_text"),
        F.coalesce(F.try_element_at("prefix", F.lit(-1))["text"], F.lit("")).alias("last_text"),
        F.col("target.text").alias("target_text"),
        Q.timestamp_gap(F.col("prefix"), F.col("target.timestamp_start")).alias("timestamp_gap"))


@query("continuity_features", O.with_views(f"""
    WITH pairs AS (SELECT block_id, array_to_string(list_transform(prefix, lambda c: c.text), ' ') AS ctx, coalesce(prefix[-1].text, '') AS last_text,
                          sentence AS tgt, round({O.safe_double('tstart')} - {O.safe_double('prefix[-1].timestamp_end')}, 6) AS timestamp_gap
                   FROM v_resolved WHERE hit > 0),
    toks AS (SELECT block_id, {O.tokens('ctx')} AS ct, {O.tokens('tgt')} AS tt FROM pairs),
    m AS ({_tfidf_sql('pairs', 'block_id', 'ctx', 'tgt', 'sim')}), l AS ({_tfidf_sql('pairs', 'block_id', 'last_text', 'tgt', 'sim')}),
    o AS ({_overlap_sql('toks', 'block_id')})
    SELECT block_id, timestamp_gap, round(l.sim, 6) AS semantic_similarity_last, round(m.sim, 6) AS semantic_similarity_mean,
           entity_overlap, action_overlap, location_overlap
    FROM pairs JOIN m USING (block_id) JOIN l USING (block_id) JOIN o USING (block_id)""", "v_resolved"))
def continuity_features(spark, sf_dir):
    pairs = continuity_pairs(P.resolve_target(A.decisions(spark, sf_dir)))
    # Both similarities in one token aggregation, told apart by a kind column.
    both = pairs.select("block_id", F.explode(F.array(
        F.struct(F.lit("last").alias("kind"), F.col("last_text").alias("l"), F.col("target_text").alias("r")),
        F.struct(F.lit("mean").alias("kind"), F.col("context_text").alias("l"), F.col("target_text").alias("r")),
    )).alias("p")).select("block_id", "p.*")
    sims = (
        V.tfidf_cosine(both, ["block_id", "kind"], "l", "r").groupBy("block_id")
        .agg(F.max(F.when(F.col("kind") == "last", F.col("similarity"))).alias("last"),
             F.max(F.when(F.col("kind") == "mean", F.col("similarity"))).alias("mean"))
    )
    tokened = pairs.select("block_id", "timestamp_gap", X.tokens(F.col("context_text")).alias("_c"), X.tokens(F.col("target_text")).alias("_t"))
    overlaps = V.lexicon_overlaps(F.col("_c"), F.col("_t"))
    return tokened.select("block_id", "timestamp_gap", *[v.alias(n) for n, v in overlaps.items()]).join(sims, "block_id").select(
        "block_id", F.round("timestamp_gap", 6).alias("timestamp_gap"),
        F.round("last", 6).alias("semantic_similarity_last"), F.round("mean", 6).alias("semantic_similarity_mean"),
        *[F.round(n, 6).alias(n) for n in overlaps])
