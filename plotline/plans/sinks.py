"""Sinks written and read back: JSON lines, JSON documents, splits, routes, audit CSV, row counts, stream progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.operators import selection as P
from plotline.plans import oracle_views as O
from plotline.plans.models import selection_stream
from plotline.plans.registry import query
from plotline.plans.release import split_examples
from plotline.plans.sequences import SELECTION_THRESHOLD
from plotline.session import scratch_path
from plotline.sources import adapters as A
from plotline.sources import rows as R
from plotline.sources import tables as T
from plotline.streaming import route as H

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def row_counts(spark, sf_dir):
    return R.row_counts(spark, {t: f"{sf_dir}/{t}.parquet" for t in TABLES})


@query("jsonl_roundtrip", "SELECT doc_id, lang, source, sha256(text) AS text_sha256, (SELECT count(*) FROM documents) AS written FROM documents")
def jsonl_roundtrip(spark, sf_dir):
    """Documents written as JSON lines and read strictly; the number of rows comes from the write."""
    path = scratch_path(spark, "jsonl")
    n = R.write_json(A.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), path)
    rows = R.strict_lines(spark, path).select(F.from_json("json", "doc_id long, lang string, source string, text string").alias("r")).select("r.*")
    return rows.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), F.lit(n).cast("long").alias("written"))


@query("json_documents", "SELECT conv_id, turn, role, sha256(text) AS text_sha256 FROM conversations")
def json_documents(spark, sf_dir):
    """Turns as JSON documents of about a thousand each, half of them bare lists, half lists under a key."""
    path = scratch_path(spark, "json-documents")
    turns = A.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text")
    files = max(1, turns.count() // 1000)
    row = F.struct("conv_id", "turn", "role", "text")
    listed = turns.groupBy(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(files)).alias("file")).agg(F.collect_list(row).alias("data"))
    text = F.when(F.col("file") % 2 == 0, F.to_json("data")).otherwise(F.to_json(F.struct("data")))
    listed.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows = R.json_document(spark, path, "conv_id: long, turn: int, role: string, text: string")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.sha2("text", 256).alias("text_sha256"))


@query("split_files", O.with_views("""
    WITH s AS (SELECT *, CASE conv_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS part FROM v_examples)
    SELECT 'raw' AS kind, part, count(*) AS n, sum(answer_idx)::BIGINT AS answers FROM s GROUP BY part
    UNION ALL SELECT 'public', part || '_public', count(*), NULL FROM s GROUP BY part
    UNION ALL SELECT 'private', part || '_private', count(*), sum(answer_idx)::BIGINT FROM s GROUP BY part""", "v_examples"))
def split_files(spark, sf_dir):
    """Raw, public and private files per split, read back; public rows have no answer."""
    path = scratch_path(spark, "splits")
    part = F.when(F.col("conv_id") % 10 == 0, "test").when(F.col("conv_id") % 10 == 1, "val").otherwise("train")
    T.write_splits(split_examples(spark, sf_dir), part, path)
    out = []
    for kind, by in (("raw", "part"), ("public", "split"), ("private", "split")):
        rows = spark.read.schema(f"id string, answer_idx long, {by} string").json(f"{path}/{kind}")
        out.append(rows.groupBy(F.col(by).alias("part")).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("answer_idx").alias("answers")))
    return R.union_all(out).select("kind", "part", "n", "answers")


@query("routed_files", O.with_views("SELECT route, id, movie FROM v_selection", "v_selection"))
def routed_files(spark, sf_dir):
    """Routed decisions written to a folder a route and read back."""
    path = scratch_path(spark, "routed")
    T.write_routed(P.materialize(A.decisions(spark, sf_dir), SELECTION_THRESHOLD).select("id", "movie", "route"), path)
    return spark.read.schema("id string, movie string, route string").json(path).select("route", "id", "movie")


@query("audit_csv", """
    SELECT doc_id, lang, string_split(text, ' ')[1:3][1] AS first, len(string_split(text, ' ')[1:3]) AS n, source, length(text) AS chars FROM documents""")
def audit_csv(spark, sf_dir):
    """Audit rows with a list and a record, flattened into CSV and read back."""
    path = scratch_path(spark, "audit")
    rows = A.table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.slice(F.split("text", " ", -1), 1, 3).alias("words"), F.struct("source", F.length("text").alias("chars")).alias("facts"))
    R.write_audit_csv(rows, path)
    back = spark.read.csv(path, header=True, escape='"', schema="doc_id long, lang string, words string, facts string")
    words, facts = F.from_json("words", "array<string>"), F.from_json("facts", "source string, chars long")
    return back.select("doc_id", "lang", F.get(words, F.lit(0)).alias("first"), F.size(words).cast("long").alias("n"), facts["source"].alias("source"), facts["chars"].alias("chars"))


@query("stream_progress", O.with_views("""
    SELECT route, count(*) AS n FROM v_selection WHERE conv_id % 3 <> 0 GROUP BY route
    UNION ALL SELECT 'remaining', count(*) FILTER (WHERE conv_id % 3 = 0) FROM v_selection""", "v_selection"))
def stream_progress(spark, sf_dir):
    """Two thirds of the conversations have arrived; counts come from the writes, what remains from the number of all decisions."""
    base, total = scratch_path(spark, "stream-progress"), A.decisions(spark, sf_dir).count()
    selection_stream(spark, A.decisions(spark, sf_dir).filter("conv_id % 3 <> 0"), base)
    return H.progress(spark, f"{base}/out", total)
