"""Greedy target-advance walk over the blocks of a sequence.

The walk starts at the first block of a sequence and goes from a start to ``start + step``; it ends at the first start
that has no block. It is sequential, but a piece of it is a small function: for each place in the next ``width``
starts where the walk may come in, where it goes out. Pieces compose, so a sequence of any length is cut into pieces
of ``chunk`` starts, the functions are composed level by level, and the true entry is handed back down. No task ever
holds more than ``chunk`` entries of one sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.operators.ordering import WALK_STARTS, neighbour_columns, positions, setting

DEAD = -1


def _leaf_exits(width: int, chunk: int) -> Column:
    """exits[e]: where the walk leaves the piece when it enters ``e`` starts after the piece begins."""
    begin = F.col("piece") * chunk

    def run(entry: Column) -> Column:
        out = F.aggregate("starts", entry, lambda at, s: F.when(s["start"] == at, at + s["step"]).otherwise(at))
        return F.when(out >= begin + chunk, out - begin - chunk).otherwise(F.lit(DEAD).cast("bigint"))

    lone = run(F.col("first_start"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda e: F.when(F.col("is_first"), lone).otherwise(run(begin + e)),
    )


def _through(children: Column, entry: Column, chunk: int) -> Column:
    """Fold an entry through consecutive child pieces; a missing child ends the walk."""
    zero = F.struct(F.try_element_at(children, F.lit(1))["piece"].alias("next"), entry.cast("bigint").alias("at"))
    return F.aggregate(
        children,
        zero,
        lambda acc, c: F.struct(
            (c["piece"] + 1).alias("next"),
            F.when((c["piece"] == acc["next"]) & (acc["at"] >= 0),
                   F.try_element_at(c["exits"], (acc["at"] + 1).cast("int")))
            .otherwise(F.lit(DEAD).cast("bigint")).alias("at"),
        ),
    )


def walk(blocks: DataFrame, width: int, longest: int, group: str = "movie", start: str = "block_start",
         step: str = "step", chunk: int | None = None, skip_gaps: bool = False) -> DataFrame:
    """Visited ``(group, start)`` rows. ``step`` lies in 1..width; ``longest`` bounds the length of a sequence.

    A start without a block ends the walk of its sequence; with ``skip_gaps`` the walk goes on at the next block there is.
    """
    if skip_gaps:
        return _walk_over_gaps(blocks, width, longest, group, start, step, chunk)
    chunk = setting(blocks, WALK_STARTS, chunk)
    if chunk < width:
        raise ValueError("a piece must not be shorter than a step")
    moves, place = F.col(step).cast("bigint"), F.col(start).cast("bigint")
    # Checked in the plan, so that both ways of walking give the same rows or both fail.
    sound = F.when(moves.between(1, width), moves).otherwise(F.raise_error(F.concat(F.lit(f"a step outside 1..{width} at "), place.cast("string"))).cast("bigint"))
    inside = F.when(place.between(0, longest - 1), place).otherwise(F.raise_error(F.concat(F.lit(f"a sequence longer than {longest}: start "), place.cast("string"))).cast("bigint"))
    steps = blocks.select(F.col(group).alias("g"), inside.alias("start"), sound.alias("step"))
    leaves = (
        steps.groupBy("g", F.floor(F.col("start") / chunk).alias("piece"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "step"))).alias("starts"))
    )
    if longest <= chunk:
        entered = leaves.withColumn("entry", F.col("starts")[0]["start"])
    else:
        entered = _entered_leaves(leaves, width, longest, chunk)
    path = F.aggregate(
        "starts",
        F.struct(F.col("entry").alias("at"), F.array().cast("array<bigint>").alias("seen")),
        lambda acc, s: F.when(
            s["start"] == acc["at"],
            F.struct((s["start"] + s["step"]).alias("at"), F.array_append(acc["seen"], s["start"]).alias("seen")),
        ).otherwise(acc),
        lambda acc: acc["seen"],
    )
    return entered.select(F.col("g").alias(group), F.explode(path).alias(start))


def _walk_over_gaps(blocks: DataFrame, width: int, longest: int, group: str, start: str, step: str, chunk: int | None) -> DataFrame:
    """The walk over the blocks there are, by their place in the sequence: a step of n starts passes the blocks below start + n."""
    placed = positions(blocks.select(group, F.col(start).cast("bigint").alias(start), F.col(step).cast("bigint").alias(step)), [group], [start], "_place", longest=longest)
    seen = neighbour_columns(placed, [group], "_place", {"_ahead": lambda w: F.collect_list(start).over(w.rowsBetween(1, width))}, before=0, after=width, longest=longest)
    wide = F.col(step).between(1, width)
    moves = F.when(wide, F.size(F.filter("_ahead", lambda s: s < F.col(start) + F.col(step))) + 1).otherwise(F.col(step))
    visited = walk(seen.select(group, "_place", moves.alias("_moves")), width, longest, group, "_place", "_moves", chunk)
    return visited.join(placed.select(group, "_place", start), [group, "_place"]).select(group, start)


def _entered_leaves(leaves: DataFrame, width: int, longest: int, chunk: int) -> DataFrame:
    firsts = leaves.groupBy("g").agg(F.min_by(F.struct("piece", F.col("starts")[0]["start"].alias("start")), "piece").alias("f"))
    leaves = (
        leaves.join(firsts, "g")
        .select("g", "piece", "starts", (F.col("piece") == F.col("f.piece")).alias("is_first"),
                F.col("f.start").alias("first_start"))
    )
    levels = [leaves.select("g", "piece", _leaf_exits(width, chunk).alias("exits"))]
    parents = []
    size = chunk
    while size < longest:
        below = levels[-1]
        parent = below.groupBy("g", F.floor(F.col("piece") / chunk).alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("piece", "exits"))).alias("children"))
        # A parent whose first child is not at its beginning is only correct for the first piece of a sequence,
        # where every entry gives the same exit; elsewhere the walk dies in the hole.
        first_up = parent.groupBy("g").agg(F.min("up").alias("first_up"))
        parent = parent.join(first_up, "g").withColumn(
            "whole", (F.col("up") == F.col("first_up")) | (F.col("children")[0]["piece"] == F.col("up") * chunk))

        def exits(e: Column) -> Column:
            acc = _through(F.col("children"), e, chunk)
            full = acc["next"] == (F.col("up") + 1) * chunk
            return F.when(F.col("whole") & full, acc["at"]).otherwise(F.lit(DEAD).cast("bigint"))

        parents.append(parent)
        levels.append(parent.select("g", F.col("up").alias("piece"),
                                    F.transform(F.sequence(F.lit(0), F.lit(width - 1)), exits).alias("exits")))
        size *= chunk
    entries = levels[-1].select("g", "piece", F.lit(0).cast("bigint").alias("entry"))
    for parent in reversed(parents):
        entries = (
            parent.join(entries.withColumnRenamed("piece", "up"), ["g", "up"])
            .filter("whole")
            .select("g", F.explode(_child_entries(F.col("children"), F.col("entry"))).alias("c"))
            .select("g", F.col("c.piece").alias("piece"), F.col("c.entry").alias("entry"))
        )
    return leaves.join(entries, ["g", "piece"]).select(
        "g", "piece", "starts",
        F.when(F.col("is_first"), F.col("first_start")).otherwise(F.col("piece") * chunk + F.col("entry")).alias("entry"))


def _child_entries(children: Column, entry: Column) -> Column:
    """The entry of every child the walk reaches."""
    empty = F.array().cast("array<struct<piece:bigint,entry:bigint>>")
    zero = F.struct(children[0]["piece"].alias("next"), entry.alias("at"), empty.alias("seen"))
    return F.aggregate(
        children,
        zero,
        lambda acc, c: F.when(
            (c["piece"] == acc["next"]) & (acc["at"] >= 0),
            F.struct(
                (c["piece"] + 1).alias("next"),
                F.try_element_at(c["exits"], (acc["at"] + 1).cast("int")).alias("at"),
                F.array_append(acc["seen"], F.struct(c["piece"].alias("piece"), acc["at"].alias("entry"))).alias("seen"),
            ),
        ).otherwise(F.struct(acc["next"].alias("next"), F.lit(DEAD).cast("bigint").alias("at"), acc["seen"].alias("seen"))),
        lambda acc: acc["seen"],
    )


def step_of(found: Column, position: Column) -> Column:
    """Starts to move on: past the target if one was found, else one."""
    return F.when(found & position.isNotNull(), position).otherwise(F.lit(1)).cast("bigint")


def walk_with_budget(blocks: DataFrame, width: int, longest: int, budget: int, called: str = "called",
                     group: str = "movie", start: str = "block_start", step: str = "step",
                     chunk: int | None = None) -> DataFrame:
    """Walk in which only the first ``budget`` calls (over all sequences, in sequence order) use their decision.

    Later blocks, and blocks whose call did not come back, get the default decision, which moves on by one. Adds ``used``.
    """
    blocks = blocks.withColumn(step, F.when(F.col(called), F.col(step)).otherwise(F.lit(1)))
    flags = blocks.select(group, start, called)
    plain = walk(blocks, width, longest, group, start, step, chunk).join(flags, [group, start])
    # The last call inside the budget: at most one row to the driver.
    edge = None
    if budget > 0:
        edge = (
            plain.filter(called).select(group, start).orderBy(group, start).limit(budget)
            .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.col(group).alias("g"), F.col(start).alias("s"))).alias("last"))
            .first()
        )
    if budget <= 0:
        inside = F.lit(False)
    elif edge["n"] < budget:
        inside = F.lit(True)
    else:
        inside = (F.col(group) < edge["last"]["g"]) | (
            (F.col(group) == edge["last"]["g"]) & (F.col(start) <= edge["last"]["s"]))
    limited = blocks.withColumn(start, F.col(start).cast("bigint")).withColumn("_inside", inside)
    again = walk(
        limited.withColumn(step, F.when(F.col("_inside"), F.col(step)).otherwise(F.lit(1))),
        width, longest, group, start, step, chunk)
    return again.join(limited.select(group, start, (F.col("_inside") & F.col(called)).alias("used")), [group, start])
