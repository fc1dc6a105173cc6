"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm import suffixes

    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm import exact

    return exact.groups(table(spark, sf_dir, "documents"), keep="largest")


def op3_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm import suffix_tree

    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm import language

    return language.identify(table(spark, sf_dir, "documents"))


def op5_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm import windows

    return windows.remove_repeats(table(spark, sf_dir, "documents"))


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm import pack

    return pack.pack(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm import mix

    return mix.plan(table(spark, sf_dir, "documents"))


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm import shards

    return shards.shard(table(spark, sf_dir, "documents"))


def op9_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm import jaccard

    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm import vectors

    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm import importance

    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm import centroids

    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm import compression

    return compression.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _rounds(rounds: int) -> str:
    """SQL of op12: each round assigns all vectors, then moves the centroids."""
    near = """a{i} AS MATERIALIZED (
            SELECT id, arg_min(c, o) AS c, min(d) AS d FROM (
                SELECT v.id, m.c, d, d * 1000 + m.c AS o FROM v, m{i} AS m, LATERAL (SELECT list_sum(list_transform(list_zip(v.q, m.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d) AS x
            ) GROUP BY id),"""
    move = """m{j} AS MATERIALIZED (
            SELECT m.c, coalesce(n.q, m.q) AS q FROM m{i} AS m LEFT JOIN (
                SELECT c, list(((s - (((s % n) + n) % n)) / n)::BIGINT ORDER BY p) AS q FROM (
                    SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT a.c, unnest(v.q) AS x, generate_subscripts(v.q, 1) AS p FROM a{i} AS a JOIN v USING (id)) GROUP BY c, p
                ) GROUP BY c
            ) AS n USING (c)),"""
    return "".join(near.format(i=i) + move.format(i=i, j=i + 1) for i in range(rounds)) + near.format(i=rounds)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_suffix_dedup, op2_exact_dedup, op3_suffix_tree_score, op4_language, op5_window_dedup, op6_best_two_fit, op7_mix_sources, op8_kd_shards, op9_bayes_jaccard, op10_vector_near_dedup,
                                                op11_importance_resample, op12_simplex_clusters, op13_compression_quality)}
ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g ON t.norm = g.norm
    """,
    # DuckDB has no crc32: it is folded over the bytes of each distinct word, by a table made here.
    "op11_importance_resample": r"""
        WITH RECURSIVE poly(i, k, c) AS (
                SELECT i, 0, i::BIGINT FROM range(256) AS r(i)
                UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8),
             tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
             d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, text FROM documents),
             found AS MATERIALIZED (SELECT id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM d),
             aim AS MATERIALIZED (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
             code AS MATERIALIZED (
                SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT)),
                                          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
                FROM (SELECT w FROM found UNION SELECT w FROM aim), tab),
             s AS (SELECT b, count(*) AS s FROM found JOIN code USING (w) GROUP BY b),
             t AS (SELECT b, count(*) AS t FROM aim JOIN code USING (w) GROUP BY b),
             gain AS MATERIALIZED (
                SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM found)::DOUBLE + 10000)
                                          / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT count(*) FROM aim)::DOUBLE + 10000))))::BIGINT AS g
                FROM (SELECT DISTINCT b FROM code) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
             f AS (SELECT id, count(*) AS n, sum(g) AS g FROM found JOIN code USING (w) JOIN gain USING (b) GROUP BY id),
             x AS (SELECT id, doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - (((g % n) + n) % n)) / n END::BIGINT AS weight,
                          ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
                   FROM d LEFT JOIN f USING (id)),
             y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
             z AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, id) AS rank, count(*) OVER () AS total FROM y WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * total // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (id)
    """,
    "op12_simplex_clusters": f"""
        WITH v AS MATERIALIZED (
                SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
             m0 AS MATERIALIZED (
                SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM v ORDER BY h, q LIMIT 8)),
             {_rounds(10)}
             f AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a10 GROUP BY c)
        SELECT vec_id, a.c::INTEGER AS cluster, a.d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a10) AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256
        FROM a10 AS a JOIN v USING (id) JOIN f USING (c) JOIN m10 AS m USING (c)
    """,
}
