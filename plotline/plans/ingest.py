"""Scans, clip ids, slices, row and column checks, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import scalars as S
from plotline.operators import matching as M
from plotline.plans import oracle_views as O
from plotline.plans.registry import query
from plotline.session import scratch_path
from plotline.sources import adapters as A
from plotline.sources import clips as C
from plotline.sources import rows as R
from plotline.sources import tables as T


@query("clip_scan", O.with_views("SELECT movie, clip_id, timestamp_start, timestamp_end, text FROM v_clips", "v_clips"))
def clip_scan(spark, sf_dir):
    """Turns written as CSV with two headers, TSV and JSON lines, read back from one folder as one clip table."""
    base = scratch_path(spark, "clip-scan")
    turns = A.clips(spark, sf_dir)
    times = ("timestamp_start", "timestamp_end")
    csv = turns.filter("role = 'user' AND conv_id % 2 = 0").select("movie", *[F.col(t).alias(a) for t, a in zip(times, ("start", "end"))], F.col("text").alias("Sentence"))
    tsv = turns.filter("role = 'assistant'").select(F.col("movie").alias("Video_ID"), *times, F.lit(None).cast("string").alias("id"), F.col("text").alias("caption"))
    jsonl = turns.filter("role = 'system'").select(F.col("movie").alias("imdb"), *[F.col(t).alias(a) for t, a in zip(times, ("start_time", "end_time"))], "text")
    csv.write.option("header", True).option("escape", '"').csv(f"{base}/csv")
    tsv.write.option("header", True).option("escape", '"').option("sep", "\t").option("extension", "tsv").csv(f"{base}/tsv")
    # A second header among the comma-separated files, in one scan with the first.
    other = turns.filter("role = 'user' AND conv_id % 2 = 1").select(F.col("text").alias("description"), F.col("movie").alias("Movie_ID"), *times)
    other.write.option("header", True).option("escape", '"').csv(f"{base}/other")
    jsonl.write.json(f"{base}/jsonl")
    # Spark names JSON lines .json.
    return C.scan_clips(spark, base, suffixes=C.LAYOUTS | {"json": "jsonl"}).select("movie", "clip_id", *times, "text")


@query("clip_ids", O.with_views("""
    SELECT conv_id, turn, CASE role WHEN 'system' THEN 'sys_' || turn
           WHEN 'user' THEN movie || '__' || replace(timestamp_start, '.', 'p') || '_' || replace(timestamp_end, '.', 'p')
           ELSE movie || '__' || printf('%05d', turn) END AS clip_id FROM v_clips""", "v_clips"))
def clip_ids(spark, sf_dir):
    t = A.clips(spark, sf_dir)
    explicit = F.when(F.col("role") == "system", F.concat(F.lit("sys_"), F.col("turn").cast("string")))
    start = F.when(F.col("role") != "assistant", F.col("timestamp_start"))
    return t.select("conv_id", "turn", S.make_clip_id(
        F.col("movie"), start, F.col("timestamp_end"), F.col("turn"), explicit).alias("clip_id"))


@query("movie_slice", O.with_views("""
    SELECT clip_id, text FROM v_clips WHERE movie = 'conv_1' ORDER BY start_s, sequence_index, clip_id LIMIT 3""", "v_clips"))
def movie_slice(spark, sf_dir):
    """The slice is the feature: one sequence by name, then its first clips."""
    return C.movie_slice(A.clips(spark, sf_dir), "conv_1", 3, ["start_s", "sequence_index", "clip_id"]).select("clip_id", "text")


_JSON_LINE = "CASE role WHEN 'user' THEN '{\"turn\": ' || turn || '}' WHEN 'assistant' THEN '{\"turn\": ' || turn ELSE '[' || turn || ']' END"


@query("json_malformed_report", f"""
    SELECT role, bad AS malformed, count(*) AS n
    FROM (SELECT role, NOT (json_valid(j) AND coalesce(CASE WHEN json_valid(j) THEN json_type(j) END, '') = 'OBJECT') AS bad
          FROM (SELECT role, {_JSON_LINE} AS j FROM conversations))
    GROUP BY ALL""")
def json_malformed_report(spark, sf_dir):
    """Turns as JSON lines of three kinds: an object, a cut-off object, an array."""
    lines = A.table(spark, sf_dir, "conversations").selectExpr("role", f"{_JSON_LINE} AS json")
    return lines.withColumn("malformed", R.malformed(F.col("json"))).groupBy("role", "malformed").agg(F.count(F.lit(1)).alias("n"))


@query("required_columns_report", """
    SELECT CASE role WHEN 'assistant' THEN 'clip_id' WHEN 'system' THEN 'movie' END AS first_empty, count(*) AS n
    FROM conversations GROUP BY ALL""")
def required_columns_report(spark, sf_dir):
    t = A.table(spark, sf_dir, "conversations").select(
        F.when(F.col("role") == "system", "").otherwise(F.col("conv_id").cast("string")).alias("movie"),
        F.when(F.col("role") != "assistant", F.col("turn").cast("string")).alias("clip_id"),
        F.col("text").alias("audio_description"))
    return t.groupBy(R.first_empty_column(t).alias("first_empty")).agg(F.count(F.lit(1)).alias("n"))


@query("source_unpivot", O.with_views("SELECT ord, key, source, text, r_start, r_end FROM v_generated", "v_generated"))
def source_unpivot(spark, sf_dir):
    return A.generated(spark, sf_dir).select("ord", "key", "source", "text", "r_start", "r_end")


_LISTED = """CASE WHEN doc_id % 19 = 2 THEN 'gone-' || doc_id ELSE 'doc-' || doc_id END"""


@query("manifest_check", f"""
    WITH m AS (SELECT *, {_LISTED} AS name, doc_id % 19 = 2 AS gone, doc_id % 11 = 4 AS other, doc_id % 13 = 5 AS vague, doc_id % 7 = 3 AS longer FROM documents)
    SELECT name, array_to_string(list_filter([
        CASE WHEN gone THEN 'file does not exist' END,
        CASE WHEN NOT gone AND other THEN 'sha256 mismatch' END,
        CASE WHEN NOT gone AND vague THEN 'size must be a byte count' END,
        CASE WHEN NOT gone AND NOT vague AND longer THEN 'size mismatch' END], lambda e: e IS NOT NULL), ';') AS errors FROM m""")
def manifest_check(spark, sf_dir):
    """Texts as files, and a manifest with absent names, foreign hashes, sizes that are no number and sizes that are off."""
    docs = A.table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    facts = R.row_facts(docs, F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.col("text"))
    rest = lambda n, r: F.col("doc_id") % n == r
    size = F.octet_length("text") + F.when(rest(7, 3), 1).otherwise(0)
    manifest = docs.select(
        F.expr(_LISTED).alias("name"), F.when(rest(11, 4), F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("sha256"),
        F.when(rest(13, 5), "many").otherwise(size.cast("string")).alias("size"))
    return R.manifest_errors(manifest, facts).select("name", F.array_join("errors", ";").alias("errors"))


@query("manifest_files")
def manifest_files(spark, sf_dir):
    """Document texts written per language; a manifest with one wrong size, one bad hash and one missing file."""
    path = scratch_path(spark, "manifest")
    A.table(spark, sf_dir, "documents").select("lang", F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.partitionBy("lang").text(path)
    facts = R.file_facts(spark, path)
    listed = facts.select("name", F.col("actual_sha256").alias("sha256"), F.col("actual_size").cast("string").alias("size"))
    faulty = (
        listed.withColumn("size", F.when(F.col("name").rlike("^part-0*0-"), "many").otherwise(F.col("size")))
        .unionByName(listed.agg(F.lit("absent.txt").alias("name"), F.max("sha256").alias("sha256"), F.max("size").alias("size")))
    )
    return R.manifest_errors(faulty, facts).select(F.explode_outer("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("dangling_refs", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dangling_refs(spark, sf_dir):
    """Documents that point to no label row."""
    files = A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id")).distinct()
    return R.dangling_references(A.table(spark, sf_dir, "documents").select("doc_id"), files, "doc_id")


@query("resume_pending", O.with_views("""
    SELECT id FROM v_key WHERE id NOT IN (SELECT id FROM v_predictions WHERE source = 'a' AND k = 1)""", "v_key", "v_predictions"))
def resume_pending(spark, sf_dir):
    n = A.longest_conversation(spark, sf_dir)
    done = A.predictions(spark, sf_dir, n).filter("source = 'a' AND k = 1")
    return R.pending(A.answer_key(spark, sf_dir, n).select("id"), done)


@query("variant_lookup", O.with_views(f"""
    WITH probes AS (SELECT event_id, start_s, end_s, v.rank, v.name FROM (
            SELECT *, [movie, regexp_replace(movie, '^\\d{{4}}_', ''), upper(replace(regexp_replace(movie, '^\\d{{4}}_', ''), ' ', '_'))] AS names FROM v_timed) t,
            LATERAL (SELECT unnest(names) AS name, generate_subscripts(names, 1) - 1 AS rank) v)
    SELECT event_id, arg_min(ord, rank) AS ord, min(rank) AS variant_rank
    FROM probes p JOIN (SELECT movie, r_start, r_end, max(ord) AS ord FROM v_wide GROUP BY ALL) w
      ON p.name = w.movie AND p.start_s = w.r_start AND p.end_s = w.r_end GROUP BY event_id""", "v_timed", "v_wide"))
def variant_lookup(spark, sf_dir):
    t = A.timed(spark, sf_dir).withColumnsRenamed({"start_s": "l_start", "end_s": "l_end"})
    bare = F.regexp_replace("movie", r"^\d{4}_", "")
    names = F.array(F.col("movie"), bare, F.upper(F.replace(bare, F.lit(" "), F.lit("_"))))
    right = A.generated_wide(spark, sf_dir)
    return M.variant_lookup(t, right, ["event_id"], names, "movie", ["ord"]).select(
        "event_id", "ord", F.col("variant_rank").cast("bigint").alias("variant_rank"))


@query("sequence_store", O.with_views("SELECT movie, pos, clip_id, md5(text) AS digest FROM v_ordered", "v_ordered"))
def sequence_store(spark, sf_dir):
    """Ordered clips written as a sequence store and read back."""
    path = scratch_path(spark, "sequences")
    T.write_sequences(A.ordered_clips(spark, sf_dir), path)
    return T.read_sequences(spark, path).select("movie", "pos", "clip_id", F.md5("text").alias("digest"))
