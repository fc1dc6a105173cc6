"""Ordering that holds up when one sequence carries a large share of all rows.

A window over ``PARTITION BY sequence`` sorts a whole sequence in one task. That is the right plan while sequences are
short, which ``longest_group`` checks with one map-side-combined count. Beyond ``HOT_GROUP_ROWS`` the same positions
come from a range partitioning on the full sort key, which cuts a hot sequence over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plotline.session import durable

#: Settings and their defaults: rows from which a group counts as hot, rows per chunk of a hot group, starts per
#: piece of a walk.
HOT_GROUP_ROWS = ("spark.plotline.hotGroupRows", 1_000_000)
CHUNK_ROWS = ("spark.plotline.chunkRows", 4096)
WALK_STARTS = ("spark.plotline.walkStarts", 256)


def setting(df: DataFrame, entry: tuple[str, int], given: int | None = None) -> int:
    """The argument if there is one, else the session's setting, else the default."""
    return given if given is not None else int(df.sparkSession.conf.get(entry[0], str(entry[1])))


def longest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest group: two-stage counts, one number to the driver."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def _names(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def global_rank(df: DataFrame, order: Sequence[str | Column], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """0-based rank over all rows. ``order`` must be a total order.

    Rows are range partitioned and sorted, the result is checkpointed so that its partitions stay as they are, and
    each row gets its place in its partition plus the sizes of the partitions before it (one row per partition).
    """
    n = partitions or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cols = _names(order)
    placed = durable(
        df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per range partition (at most ``n``), so one task and a broadcast are bounded by ``n``.
    before = sizes.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(before), "_part")
        .withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_before", "_at")
    )


def ranged_positions(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str = "pos",
                     partitions: int | None = None) -> DataFrame:
    """Dense position inside each group without ever sorting a group in one task.

    Only the group, what the order needs and two hashes of the row are range partitioned, and of these only group, hashes and
    place are checkpointed. A row then finds its place by its hashes; equal rows share out theirs.
    """
    n = partitions or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cols = [F.col(g) for g in group] + _names(order)
    hashed = df.withColumns({"_h1": F.xxhash64(*df.columns), "_h2": F.xxhash64(F.lit(1), *df.columns)})
    placed = durable(
        hashed.repartitionByRange(n, *cols).sortWithinPartitions(*cols).select(*group, "_h1", "_h2", F.monotonically_increasing_id().alias("_at"))
    ).withColumn("_part", F.shiftright("_at", 33))
    # Pieces of a group, one per range partition it touches: at most ``n`` rows per group below.
    pieces = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("_before", F.sum("_n").over(run) - F.col("_n")).drop("_n")
    numbered = placed.join(pieces, [*group, "_part"]).select(*group, "_h1", "_h2", (F.col("_before") + F.col("_at") - F.col("_first")).alias(out))
    keys = [*group, "_h1", "_h2"]
    alike = lambda by: F.row_number().over(Window.partitionBy(*keys).orderBy(by))
    return (
        hashed.withColumn("_like", alike(F.lit(0))).join(numbered.withColumn("_like", alike(out)), [*keys, "_like"])
        .drop("_h1", "_h2", "_like")
    )


def positions(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str = "pos",
              longest: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Dense 0-based position of each row in its group. Only groups beyond the limit take the range plan and are checkpointed."""
    limit = setting(df, HOT_GROUP_ROWS, hot_rows)
    if longest is None:
        longest = longest_group(df, group)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*_names(order))).cast("bigint") - 1)

    if longest <= limit:
        return plain(df)
    hot = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).drop("_n")
    long = ranged_positions(df.join(hot, list(group), "left_semi"), group, order, out)
    return plain(df.join(hot, list(group), "left_anti")).unionByName(long)


def neighbour_columns(df: DataFrame, group: Sequence[str], pos: str, columns: dict[str, Callable[[WindowSpec], Column]],
                      before: int, after: int, longest: int, hot_rows: int | None = None,
                      chunk: int | None = None) -> DataFrame:
    """Columns computed over at most ``before`` rows back and ``after`` rows ahead by dense position.

    Short groups share the partitioning that gave the position. Long ones are cut into chunks by position; only the
    few rows at a chunk edge are copied into the neighbouring chunk.
    """
    if longest <= setting(df, HOT_GROUP_ROWS, hot_rows):
        spec = Window.partitionBy(*group).orderBy(pos)
        return df.select("*", *[make(spec).alias(name) for name, make in columns.items()])
    chunk = setting(df, CHUNK_ROWS, chunk)
    own = F.floor(F.col(pos) / chunk)
    first = F.greatest(F.lit(0), F.floor((F.col(pos) - after) / chunk))
    last = F.floor((F.col(pos) + before) / chunk)
    spread = df.select("*", own.alias("_own"), F.explode(F.sequence(first, last)).alias("_chunk"))
    spec = Window.partitionBy(*group, "_chunk").orderBy(pos)
    return (
        spread.select("*", *[make(spec).alias(name) for name, make in columns.items()])
        .filter(F.col("_own") == F.col("_chunk"))
        .drop("_own", "_chunk")
    )


def exact_median(df: DataFrame, value: str, few_values: int = 1_000_000) -> float | None:
    """Interpolated median. The aggregate holds one entry per distinct value, so that number is checked first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    facts = counts.agg(F.count(F.lit(1)).alias("d"), F.sum("_n").alias("n")).first()
    if not facts["n"]:
        return None
    if facts["d"] <= few_values:
        return counts.agg(F.expr(f"percentile({value}, 0.5, _n)")).first()[0]
    low, high = (facts["n"] - 1) // 2, facts["n"] // 2
    # Many distinct values: range partition them and pick the one or two middle rows by rank.
    ranked = global_rank(
        df.filter(F.col(value).isNotNull()).select(value, F.monotonically_increasing_id().alias("_tie")), [value, "_tie"])
    return ranked.filter(F.col("rank").isin(low, high)).agg(F.avg(value)).first()[0]
