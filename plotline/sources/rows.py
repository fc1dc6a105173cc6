"""JSON-lines, JSON-document and CSV rows: strict and tolerant scans, sinks, column checks, manifests."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plotline.functions.json_recovery import is_object
from plotline.functions.text import strip
from plotline.sources.clips import placed_lines, union_all, with_row_numbers

# The digest helper travels with the job, so workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REQUIRED_CLIP_COLUMNS = ("audio_description", "clip_id", "movie")


def tolerant_lines(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Non-blank lines as ``json`` with a ``malformed`` flag; ``numbered`` adds file and 1-based line number."""
    text = spark.read.text(path)
    if numbered:
        placed = placed_lines(text, [F.col("_metadata.file_path").alias("file")])
        text = with_row_numbers(placed).withColumn("line", F.col("sequence_index") + 1)
    keep = ["file", "line"] if numbered else []
    rows = text.select(strip(F.col("value")).alias("json"), *keep).filter(F.length("json") > 0)
    return rows.withColumn("malformed", malformed(F.col("json")))


def malformed(json: Column) -> Column:
    """No JSON, or JSON that is no object."""
    return ~is_object(json)


def strict_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines as ``json``; the job fails at a line that is no JSON object and names its place."""
    rows = tolerant_lines(spark, path, numbered=True)
    place = F.concat_ws(":", "file", "line")
    checked = F.when(~F.col("malformed"), F.lit(True)).otherwise(
        F.raise_error(F.concat(place, F.lit(": invalid JSON object: "), F.left("json", F.lit(200)))).cast("boolean"))
    return rows.filter(checked).select("json")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON document that is a list, or an object with the list under ``data``."""
    text = spark.read.text(path, wholetext=True).select(F.col("value"))
    listed = F.from_json("value", f"array<struct<{schema}>>")
    below = F.from_json("value", f"struct<data:array<struct<{schema}>>>")["data"]
    first = F.left(F.regexp_replace("value", r"^\s+", ""), F.lit(1))
    return text.select(F.inline(F.when(first == "[", listed).otherwise(below)))


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> int:
    """Write JSON lines (nulls kept) and return the number of rows, counted while writing."""
    seen = Observation("written")
    observed = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    writer = observed.write.mode(mode).option("ignoreNullFields", False)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)
    return int(seen.get["n"])


def flat_columns(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, ready for CSV."""
    nested = ("array", "struct", "map")
    return rows.select(*[
        F.to_json(c).alias(c) if kind.startswith(nested) else F.col(c) for c, kind in rows.dtypes])


def write_audit_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flat_columns(rows).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def missing_columns(rows: DataFrame, required: Sequence[str] = REQUIRED_CLIP_COLUMNS) -> list[str]:
    return sorted(set(required) - set(rows.columns))


def first_empty_column(rows: DataFrame, required: Sequence[str] = REQUIRED_CLIP_COLUMNS) -> Column:
    """Name of the first required column that is empty in a row; null if none is."""
    present = [c for c in required if c in rows.columns]
    return F.coalesce(*[F.when(F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) == 0, F.lit(c)) for c in present], F.lit(None))


#: Files up to so many bytes are hashed whole.
WHOLE_BYTES = 64 << 20
#: Suffixes that the text reader unpacks; such files are always taken whole.
_PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd)$"


def file_facts(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Name, byte size and sha256 of the files below a path.

    A file of up to ``whole_bytes`` is hashed in the task that reads it. Larger ones are read in pieces by many tasks, brought
    into order by file, and hashed piece by piece as they stream through, so their size has no limit but that of one line. Spark's
    readers pass over files without a byte.
    """
    name = F.regexp_extract("path", "[^/]+$", 0).alias("name")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.filter((F.col("length") <= whole_bytes) | F.lower("path").rlike(_PACKED)).select(
        name, F.col("length").alias("actual_size"), F.sha2("content", 256).alias("actual_sha256"))
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    large = placed_lines(lines.filter((F.col("_metadata.file_size") > whole_bytes) & ~F.lower(F.col("_metadata.file_name")).rlike(_PACKED)))
    pieces = large.select(F.col("_file").alias("path"), "_block", "_at", "_size", F.col("value").cast("binary").alias("value"))
    ordered = pieces.repartition("path").sortWithinPartitions("path", "_block", "_at").select("path", "_size", "value")
    hashed = ordered.mapInArrow(_streamed_digests, "path string, actual_size long, actual_sha256 string")
    return small.unionByName(hashed.select(name, "actual_size", "actual_sha256"))


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest per file of its lines, which come in order. The reader drops a leading byte order mark and line feeds; how many
    bytes are missing at the end tells which of them there were."""
    mark, now, found = b"\xef\xbb\xbf", None, []

    def close() -> None:
        path, size, plain, marked, n = now
        lost = size - n
        chosen = marked if lost >= len(mark) else plain
        if lost in (1, len(mark) + 1):
            chosen.update(b"\n")
        found.append((path, size, chosen.hexdigest()))

    for batch in batches:
        for path, size, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if now is None or now[0] != path:
                if now is not None:
                    close()
                now = (path, size, hashlib.sha256(value), hashlib.sha256(mark + value), len(value))
            else:
                for digest in now[2:4]:
                    digest.update(b"\n")
                    digest.update(value)
                now = (*now[:4], now[4] + 1 + len(value))
    if now is not None:
        close()
    columns = list(zip(*found, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "actual_size", "actual_sha256"])


def row_facts(rows: DataFrame, name: Column, content: Column) -> DataFrame:
    """The same facts of contents that are rows of a table."""
    return rows.select(name.alias("name"), F.octet_length(content).cast("bigint").alias("actual_size"), F.sha2(content, 256).alias("actual_sha256"))


def row_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Rows of each Parquet table by name; counts come from file footers, no column is read."""
    counts = [spark.read.parquet(path).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, path in paths.items()]
    return union_all(counts)


def manifest_errors(manifest: DataFrame, facts: DataFrame) -> DataFrame:
    """``(name, errors)`` of a manifest (name, sha256, size as string) against the files that exist."""
    size = F.col("size").try_cast("bigint")
    gone = F.col("actual_size").isNull()
    return manifest.join(facts, "name", "left").select("name", F.array_compact(F.array(
        F.when(gone, F.lit("file does not exist")),
        F.when(~gone & ~F.col("sha256").eqNullSafe(F.col("actual_sha256")), F.lit("sha256 mismatch")),
        F.when(~gone & size.isNull(), F.lit("size must be a byte count")),
        F.when(~gone & size.isNotNull() & (size != F.col("actual_size")), F.lit("size mismatch")),
    )).alias("errors"))


def dangling_references(fields: DataFrame, files: DataFrame, reference: str = "file_id") -> DataFrame:
    """Fields whose source file is not in the distribution."""
    return fields.join(files.select(F.col("file_id").alias(reference)), reference, "left_anti")


def pending(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is in no output yet."""
    return rows.join(done.select(key), key, "left_anti")
