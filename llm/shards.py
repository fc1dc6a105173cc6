"""Sharding by a k-d tree over document metadata, with DataFrame operations only.

Law ``bytes``: shards get near equal sizes. A unit is a group of equal texts, which stays in one shard; only a group larger than
a whole shard is cut, into quarters of a shard. Every cell of the tree that must become several shards is split along its widest
dimension at the weighted quantile that gives each side bytes in proportion to its shards. The quantile is found by sums over
4096 bins, refined twice inside the bin where it lies; rows never meet in one task, and the driver holds one entry per cell
(there are as many cells as shards).

Edge cases: null text has no bytes and counts as equal to an empty text; null source and lang are values of their own; an empty
table gives no rows; repeated rows are equal texts. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import ranked, stored

SHARDS = 24
#: Bytes that each document counts beyond its text.
OVERHEAD = 8
BINS = 4096
#: Dimensions of the tree; each coordinate lies in 0..1 over the whole table.
DIMENSIONS = ("d_bytes", "d_source", "d_lang", "d_length")


def _lookup(values: dict[int, float], key: Column, kind: str) -> Column:
    pairs = [F.lit(x) for k, v in values.items() for x in (int(k), v)]
    return F.element_at(F.create_map(*pairs), key).cast(kind)


def _unit_of_hash(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(1 << 20)) / F.lit(float(1 << 20))


def _cut(units: DataFrame, cells: dict[int, int]) -> DataFrame:
    """One level of the tree: every cell with more than one shard is split. ``units`` has cell; ``cells`` maps it to its shards."""
    open_ = {c: n for c, n in cells.items() if n > 1}
    part = units.where(F.col("cell").isin(list(open_)))
    spread = [f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]
    found = {r["cell"]: r for r in part.groupBy("cell").agg(F.sum("bytes").alias("bytes"), *spread).collect()}
    widest = {c: max(DIMENSIONS, key=lambda d: r[f"max_{d}"] - r[f"min_{d}"]) for c, r in found.items()}
    if not found:
        return units
    which = _lookup({c: DIMENSIONS.index(d) for c, d in widest.items()}, F.col("cell"), "int")
    x = F.element_at(F.array(*DIMENSIONS), which + 1)
    low = _lookup({c: float(r[f"min_{widest[c]}"]) for c, r in found.items()}, F.col("cell"), "double")
    width = _lookup({c: max(1e-12, float(r[f"max_{widest[c]}"] - r[f"min_{widest[c]}"])) for c, r in found.items()}, F.col("cell"), "double")
    # Three digits of 12 bits: the coordinate, then a hash that tells apart what shares a coordinate.
    tie = F.xxhash64("group", "chunk", "cell")
    digits = [F.least(F.lit(BINS - 1), F.floor((x - low) / width * BINS)).cast("int"),
              F.pmod(tie, F.lit(BINS)).cast("int"), F.pmod(F.shiftright(tie, 12), F.lit(BINS)).cast("int")]
    part = part.select("*", *[d.alias(f"k{i}") for i, d in enumerate(digits)])
    goal = {c: found[c]["bytes"] * (n // 2) / n for c, n in open_.items() if c in found}
    at: dict[int, list[int]] = {c: [] for c in goal}
    before = dict.fromkeys(goal, 0)
    left: dict[int, list[int]] = {}
    for i in range(3):
        inside = part
        for j in range(i):
            inside = inside.where(F.col(f"k{j}") == _lookup({c: v[j] for c, v in at.items()}, F.col("cell"), "int"))
        sums = inside.groupBy("cell", f"k{i}").agg(F.sum("bytes").alias("bytes"))
        sums = sums.withColumn("upto", F.sum("bytes").over(Window.partitionBy("cell").orderBy(f"k{i}")))
        sums = sums.withColumn("upto", F.col("upto") + _lookup(before, F.col("cell"), "long"))
        crossing = sums.where(F.col("upto") >= _lookup(goal, F.col("cell"), "double")).groupBy("cell").agg(F.min(F.struct(f"k{i}", "upto", "bytes")).alias("m"))
        for r in crossing.collect():
            c, m = r["cell"], r["m"]
            at[c].append(m[0])
            before[c] = m["upto"] - m["bytes"]
            if i == 2:  # the last bin goes to the side where it misses the goal by less
                left[c] = [*at[c][:2], m[0] + (1 if m["upto"] - goal[c] <= goal[c] - before[c] else 0)]
    cut = [_lookup({c: v[i] for c, v in left.items()}, F.col("cell"), "int") for i in range(3)]
    goes_left = (F.col("k0") < cut[0]) | ((F.col("k0") == cut[0]) & ((F.col("k1") < cut[1]) | ((F.col("k1") == cut[1]) & (F.col("k2") < cut[2]))))
    half = _lookup({c: n // 2 for c, n in open_.items()}, F.col("cell"), "int")
    moved = part.withColumn("cell", F.when(goes_left, F.col("cell")).otherwise(F.col("cell") + half)).select(*units.columns)
    rest = units.where(~F.col("cell").isin(list(open_)))
    return moved.unionByName(rest)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = docs.select(
        "doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).alias("group"),
        _unit_of_hash(F.coalesce("source", F.lit("\0"))).alias("d_source"), _unit_of_hash(F.coalesce("lang", F.lit("\0"))).alias("d_lang"))
    rows = stored(rows.withColumn("__doc", F.coalesce("doc_id", F.lit(-1))), "shard-rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    target = max(1.0, total / shards)
    groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.min("d_source").alias("d_source"), F.min("d_lang").alias("d_lang"))
    # Rows of a group that go into one unit: all, or a quarter of a shard where the group exceeds a shard.
    groups = groups.withColumn("per", F.when(F.col("n") * F.col("size") <= target, F.col("n")).otherwise(F.greatest(F.lit(1), F.floor(F.lit(target / 4) / F.col("size")))).cast("long"))
    groups = stored(groups, "shard-groups")
    large = groups.where("per < n").select("group", "per")
    chunked = ranked(stored(rows.join(large, "group"), "shard-large"), ["group"], ["__doc", "d_source", "d_lang"], "rank")
    chunked = chunked.withColumn("chunk", F.floor(F.col("rank") / F.col("per")).cast("long")).drop("rank", "per")
    rows = stored(rows.join(large.select("group"), "group", "left_anti").withColumn("chunk", F.lit(0).cast("long")).unionByName(chunked), "shard-chunks")
    pieces = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("per")).cast("long"))))
    weight = F.least(F.col("per"), F.col("n") - F.col("chunk") * F.col("per")) * F.col("size")
    units = pieces.select(
        "group", "chunk", weight.alias("bytes"), F.least(F.lit(1.0), weight / F.lit(target)).alias("d_bytes"), "d_source", "d_lang",
        F.least(F.lit(1.0), F.log2(F.col("size").cast("double")) / 32).alias("d_length"), F.lit(0).alias("cell"))
    units = stored(units, "shard-units")
    cells = {0: shards}
    while any(n > 1 for n in cells.values()):
        units = stored(_cut(units, cells), "shard-units")
        cells = {c: k for a, n in cells.items() for c, k in (((a, n),) if n == 1 else ((a, n // 2), (a + n // 2, n - n // 2)))}
    placed = stored(rows.join(units.select("group", "chunk", F.col("cell").alias("shard")), ["group", "chunk"])
                    .select("doc_id", "__doc", "size", "text_crc32", "shard"), "shard-placed")
    return ranked(placed, ["shard"], ["__doc", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
