"""Clip scan: CSV, TSV and JSONL files with varying headers into one clip table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotline.functions import domains as D
from plotline.functions import scalars as S
from plotline.functions import text as X
from plotline.functions.json_recovery import whole_json

LAYOUTS = {"csv": "csv", "tsv": "tsv", "jsonl": "jsonl"}
_PLACE = ("_file", "_block")


def finish_clips(columns: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop rows without movie or text, normalise the text, make the missing clip ids."""
    return columns.filter((F.length("movie") > 0) & (F.length("audio_description") > 0)).select(
        "movie",
        S.make_clip_id(F.col("movie"), F.col("timestamp_start"), F.col("timestamp_end"), F.col("sequence_index"),
                       F.col("clip_id")).alias("clip_id"),
        "timestamp_start",
        "timestamp_end",
        X.normalize_text(F.col("audio_description")).alias("text"),
        "sequence_index",
        "video_path",
        *keep,
    )


def _bytes(setting: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([a-zA-Z]*)", setting.strip()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit.lower()[:1]]


def placed_lines(raw: DataFrame, keep: Sequence[str | Column] = ()) -> DataFrame:
    """Lines of a text scan with their file, its size, the offset of their input split and their order inside it."""
    return raw.select(*keep, "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"),
                      F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))


def with_row_numbers(rows: DataFrame, header: bool = False) -> DataFrame:
    """0-based row number within each file (``sequence_index``), counted split by split.

    ``rows`` comes from :func:`placed_lines`. No group is larger than one input split, so a single huge file is numbered by many
    tasks. Only files that may have several splits are read ahead, to count what lies before each; other files are skipped by
    their size. With ``header`` the first row of each file is not counted but handed to the others as ``_header``.
    """
    conf = rows.sparkSession.conf
    least = min(_bytes(conf.get("spark.sql.files.maxPartitionBytes")), _bytes(conf.get("spark.sql.files.openCostInBytes")))
    ahead = rows.filter(F.col("_size") > least).groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("_n"), F.min_by("value", "_at").alias("_first"))
    run = Window.partitionBy("_file").orderBy("_block")
    before = ahead.select(
        *_PLACE, (F.sum("_n").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.first("_first").over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("_top"))
    split = Window.partitionBy(*_PLACE).orderBy("_at")
    out = (
        rows.withColumn("_local", F.row_number().over(split) - 1).withColumn("_own", F.first("value").over(split))
        .join(before, list(_PLACE), "left")
        .withColumn("sequence_index", (F.coalesce("_before", F.lit(0)) + F.col("_local")).cast("bigint"))
    )
    if header:
        out = out.filter("sequence_index > 0").withColumn("sequence_index", F.col("sequence_index") - 1).withColumn("_header", F.coalesce("_top", "_own"))
    return out.drop("_local", "_own", "_before", "_top", "_at", "_size", *_PLACE)


def _records(lines: DataFrame) -> DataFrame:
    """Lines put together again where a quoted field holds line ends: a record starts where all quotes before are paired."""
    before = Window.partitionBy("_file").orderBy("_block", "_at").rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    upto = Window.partitionBy("_file").orderBy("_block", "_at").rowsBetween(Window.unboundedPreceding, 0)
    starts = (F.pmod(F.coalesce(F.sum(quotes).over(before), F.lit(0)), F.lit(2)) == 0).cast("int")
    numbered = lines.withColumn("_starts", starts).withColumn("_record", F.sum("_starts").over(upto))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_block", "_at", "value"))), lambda p: p["value"])
    return numbered.groupBy("_file", "_size", "_kind", "_record").agg(F.array_join(parts, "\n").alias("value")).select(
        "_kind", "value", "_file", "_size", F.lit(0).cast("bigint").alias("_block"), F.col("_record").alias("_at"))


def fields(line: Column, separator: str) -> Column:
    """Fields of a delimited line. A field that opens with a quote runs to its closing quote; two quotes inside are one."""
    found = F.regexp_extract_all(
        F.concat(F.lit(separator), line), F.lit(rf'{separator}("(?:[^"]++|"")*+"(?=$|{separator})|[^{separator}]*+)'), F.lit(1))
    quoted = lambda f: (F.length(f) > 1) & f.startswith('"') & f.endswith('"')
    return F.transform(found, lambda f: F.when(quoted(f), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def _by_kind(line: Column) -> Column:
    return F.when(F.col("_kind") == "tsv", fields(line, "\t")).otherwise(fields(line, ","))


def _places(header: Column) -> Column:
    """For each clip field the place of its column: the first alias that is a column decides, of equal names the last one."""
    def found(names: Column) -> Column:
        back = F.reverse(names)
        place = lambda alias: F.size(names) - F.nullif(F.array_position(back, alias), F.lit(0)).cast("int")
        return F.array(*[F.coalesce(*[place(a) for a in aliases]) for aliases in D.CLIP_COLUMN_ALIASES.values()])

    return X.with_value(F.transform(_by_kind(F.ltrim(header, F.lit("\ufeff"))), F.lower), found)


def _delimited_columns(lines: DataFrame, multi_line: bool) -> DataFrame:
    """Clip columns of CSV and TSV lines, each read by the header of its own file."""
    whole = _records(lines) if multi_line else lines
    rows = with_row_numbers(whole.filter(F.length(F.btrim("value")) > 0), header=True)
    cut = rows.select("sequence_index", _places(F.col("_header")).alias("_places"), _by_kind(F.col("value")).alias("_fields"))
    value = lambda i: F.get("_fields", F.get("_places", F.lit(i)))
    return cut.select(*[F.when(F.length(value(i)) > 0, X.strip(value(i))).alias(f) for i, f in enumerate(D.CLIP_COLUMN_ALIASES)], "sequence_index")


def _json_field(entries: Column, field: str) -> Column:
    """The same rule row by row: the first alias that is a key of the row decides."""
    value = None
    for alias in D.CLIP_COLUMN_ALIASES[field]:
        hits = F.filter(entries, _key_is(alias))
        found = F.try_element_at(hits, F.lit(-1))["value"]
        value = F.when(F.size(hits) > 0, found) if value is None else value.when(F.size(hits) > 0, found)
    return F.when(F.length(value) > 0, X.strip(value))


def _key_is(alias: str):
    return lambda e: F.lower(e["key"]) == alias


def _json_columns(lines: DataFrame) -> DataFrame:
    """Objects of a JSON-lines file; blank lines and other JSON values are skipped, broken JSON makes the job fail."""
    parsed = lines.withColumn("value", X.strip(F.col("value"))).filter(F.length("value") > 0).withColumn("_v", whole_json(F.col("value")))
    valid = F.when(F.col("_v").isNotNull(), F.schema_of_variant("_v").startswith("OBJECT")).otherwise(
        F.raise_error(F.concat(F.lit("invalid JSON in "), "_file", F.lit(": "), F.left("value", F.lit(200)))).cast("boolean"))
    rows = with_row_numbers(parsed.filter(valid).drop("_v")).withColumn("_e", F.map_entries(F.from_json("value", "map<string,string>")))
    return rows.select(*[_json_field(F.col("_e"), f).alias(f) for f in D.CLIP_COLUMN_ALIASES], "sequence_index")


def scan_clips(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False, suffixes: dict[str, str] = LAYOUTS) -> DataFrame:
    """All clips in the given files or directories, whatever clip file types these hold; other files are skipped.

    Files are read as lines, in one scan of all delimited and one of all JSON-lines files, and every line is taken apart by the
    header of its own file, which numbering brings to it. So the plan is the same for any number of files and headers, no file is
    listed here, and no header is read apart. ``multi_line`` allows line breaks inside quoted fields; such a file is put together
    in one task. ``suffixes`` maps lower-case file suffixes to layouts. Without a clip file there are no rows.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    if not listed:
        raise ValueError("no path to scan")
    raw = spark.read.option("recursiveFileLookup", True).text(listed)
    suffix = F.lower(F.substring_index(F.col("_metadata.file_name"), ".", -1))
    of = lambda *layouts: [s for s, layout in suffixes.items() if layout in layouts]
    tables = placed_lines(raw.filter(suffix.isin(of("csv", "tsv"))), [F.when(suffix.isin(of("tsv")), "tsv").otherwise("csv").alias("_kind")])
    lines = placed_lines(raw.filter(suffix.isin(of("jsonl"))))
    return finish_clips(_delimited_columns(tables, multi_line).unionByName(_json_columns(lines)))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    return rows


def movie_slice(clips: DataFrame, movie: str | None = None, limit: int | None = None,
                order: Sequence[str | Column] = ()) -> DataFrame:
    """Clips of one movie, then the first ``limit`` in order."""
    chosen = clips if movie is None else clips.filter(F.col("movie") == movie)
    return chosen if limit is None else chosen.orderBy(*order).limit(limit)
