"""Group-disjoint train/val/test split.

Groups go, by falling size and then by name, to the split that is least full relative to its target. That is a sequential rule,
but it only sees sizes: among groups of one size the n-th pick depends on nothing but n. So the state is carried over the distinct
sizes alone (fewer than the square root of twice the number of rows, in one row), and every group works out its own split from its
rank among the groups of its size. All of it is Column arithmetic.

Picks of one size are taken in the order of (fill before the pick, count before the pick, split), which rises along each split. So
any picks known to be among the first n may be taken at once, and the few that are left are played out one by one. A common level
that n - 3 picks reach in fractions gives such picks: with it no split gets more than it has after n whole picks.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.text import with_value
from plotline.operators.ordering import positions

SPLITS = ("train", "val", "test")
#: Distinct sizes whose states are kept in one list while they are worked out; a fold copies its state at every step.
_BLOCK = 256


def _next(counts: Column, targets: Sequence[float]) -> Column:
    """Place of the split that gets the next group: smallest fill, then smallest count, then split order."""
    keys = [F.struct((F.get(counts, F.lit(i)) / t).alias("fill"), F.get(counts, F.lit(i)).alias("count"), F.lit(i).alias("place")) for i, t in enumerate(targets)]
    return F.least(*keys)["place"] if len(keys) > 1 else F.lit(0)


def _after(counts: Column, size: Column, picks: Column, targets: Sequence[float]) -> Column:
    """Counts after ``picks`` groups of ``size`` rows."""
    places = range(len(targets))
    count = lambda c, i: F.get(c, F.lit(i))
    ahead = F.greatest(picks - len(targets), F.lit(0)) * size
    # The level at which splits share what is ahead: the smallest over all sets of splits that might take part.
    shared = [(ahead + sum((count(counts, i) for i in some), F.lit(0.0))) / sum(targets[i] for i in some) for n in places for some in combinations(places, n + 1)]
    level = F.least(*shared) if len(shared) > 1 else shared[0]

    def given(at: Column) -> Column:
        sure = [F.greatest(F.floor((at * t - count(counts, i)) / size) - 1, F.lit(0)).cast("double") for i, t in enumerate(targets)]
        return F.array(*sure)

    def played(first: Column) -> Column:
        left = (picks - F.aggregate(first, F.lit(0.0), lambda a, n: a + n)).cast("int")
        begun = F.zip_with(counts, first, lambda c, n: c + n * size)
        one = lambda c: with_value(_next(c, targets), lambda best: F.transform(c, lambda x, i: F.when(i == best, x + size).otherwise(x)))
        return F.aggregate(F.sequence(F.lit(0), left), begun, lambda c, k: F.when(k < left, one(c)).otherwise(c))

    return with_value(level, lambda at: with_value(given(at), played))


def _states(runs: Column, targets: Sequence[float], block: int) -> Column:
    """For each run of equal sizes, largest first: its size and the counts before it. ``runs`` lists (size, groups)."""
    start = F.array(*[F.lit(0.0)] * len(targets))
    step = lambda c, r: _after(c, r["size"], r["groups"], targets)
    entry = lambda c, r: F.struct(r["size"].alias("size"), c.alias("counts"))
    kind = "array<struct<size:bigint,counts:array<double>>>"

    def within(part: Column, before: Column) -> Column:
        zero = F.struct(before.alias("counts"), F.array().cast(kind).alias("list"))
        return F.aggregate(part, zero, lambda a, r: F.struct(
            step(a["counts"], r).alias("counts"), F.array_append(a["list"], entry(a["counts"], r)).alias("list")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(runs) - 1) / block).cast("int")), lambda k: F.slice(runs, k * block + 1, F.lit(block)))
    zero = F.struct(start.alias("counts"), F.array().cast(f"array<{kind}>").alias("lists"))
    return F.aggregate(
        blocks, zero,
        lambda a, part: with_value(within(part, a["counts"]), lambda w: F.struct(
            w["counts"].alias("counts"), F.array_append(a["lists"], w["list"]).alias("lists"))),
        lambda a: F.flatten(a["lists"]))


def group_split(examples: DataFrame, group: str = "movie", ratios: tuple[float, float, float] = (0.8, 0.1, 0.1),
                hot_rows: int | None = None) -> DataFrame:
    """``(group, size, split)``; every group lies in exactly one split."""
    if round(sum(ratios), 6) != 1.0:
        raise ValueError("split ratios must sum to 1.0")
    sizes = examples.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    # One row per distinct size. Distinct sizes add up to at most the number of rows, hence the square-root bound.
    runs = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
    facts = runs.agg(F.sum(F.col("size") * F.col("groups")).alias("total"), F.max("groups").alias("most")).first()
    # A split with target 0 is never the least full one while rows are left, so it gets no group.
    chosen = [(s, (facts["total"] or 0) * r) for s, r in zip(SPLITS, ratios, strict=True) if r > 0]
    names, targets = [s for s, _ in chosen], [t for _, t in chosen]
    if not facts["total"]:
        return sizes.withColumn("split", F.lit(names[0]))
    listed = runs.agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "groups")))).alias("runs"))
    state = listed.select(F.inline(_states(F.col("runs"), targets, _BLOCK)))
    ranked = positions(sizes, ["size"], [group], "_rank", longest=int(facts["most"]), hot_rows=hot_rows).join(state, "size")
    after = _after(F.col("counts"), F.col("size"), F.col("_rank"), targets)
    split = with_value(after, lambda c: F.get(F.array(*[F.lit(n) for n in names]), _next(c, targets)))
    return ranked.select(group, "size", split.alias("split"))
