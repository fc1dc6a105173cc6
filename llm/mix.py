"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Each document i of source s gets a rate r_i that minimises sum(r log r - r) subject to sum(r_i * size_i) = target_s and
0 <= r_i <= 3. The dual has one variable per source and r_i = min(3, exp(lambda_s * size_i / mean size of s)). Newton steps
(kept inside a bracket) solve it: each step is one pre-aggregated sum over the histogram of (source, size), never over texts.
Rates become copies by systematic rounding along each source in order of size, in integers, so that reruns agree. What is then
missing or too much (about one long document at most) is settled with documents that are short against it.

Edge cases: null text has size 0; size 0 keeps one copy and takes nothing; null sources are one source, ordered last; a
source without words has target 0. An empty table gives an empty result. Repeated rows are separate documents. Extra columns
are ignored by :func:`plan` and kept by :func:`apply`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import WORD, ranked, stored

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Rates are kept in units of 2^-20 copies for the rounding.
UNIT = 1 << 20
TOLERANCE = 1e-6
STEPS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per source: sid, source_size, n, target. ``sizes`` has source, size.

    Sources are ordered by code point, null last, and take the weights in turn. Filling each source to ``cap`` times its size
    and resharing the excess by weight until none is above ends in min(cap * size, weight * level) with one common level.
    With sources in order of cap * size / weight, those before a position are full, and the level follows from prefix sums.
    The windows hold one row per source, not per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    per = per.withColumn("full", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("full") / F.col("weight"))
    everything = Window.partitionBy()
    earlier = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(earlier), F.lit(0.0)))
                         / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
    # The first source that the level does not fill fixes the level for all.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(everything)["level"]
    return per.select("sid", "source", "source_size", "n", F.coalesce(F.least("full", F.col("weight") * level), "full").alias("target"))


def _rates(lam: Column, x: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(F.lit(700.0), lam * x)))


def solve(hist: DataFrame, sources: DataFrame, cap: float = CAP) -> DataFrame:
    """sources with the dual variable ``lam``. ``hist`` has sid, size, n; ``sources`` what :func:`targets` gives."""
    mean = F.col("source_size") / F.col("n")
    state = stored(sources.select("sid", "target", mean.alias("mean"), F.coalesce(F.log(F.try_divide("target", "source_size")), F.lit(0.0)).alias("lam"), F.lit(-1e7).alias("lo"), F.lit(1e7).alias("hi"),
                                  (F.col("target") >= cap * F.col("source_size")).alias("full"), F.lit(False).alias("done")), "dual")
    for _ in range(STEPS):
        at = hist.where("size > 0").join(state.where("not full and not done"), "sid").withColumn("x", F.col("size") / F.col("mean"))
        at = at.withColumn("r", _rates(F.col("lam"), F.col("x"), cap))
        sums = at.groupBy("sid").agg(
            F.sum(F.col("n") * F.col("size") * F.col("r")).alias("got"),
            F.sum(F.when(F.col("r") < cap, F.col("n") * F.col("size") * F.col("x") * F.col("r")).otherwise(0.0)).alias("slope"))
        new = state.join(sums, "sid", "left")
        low = F.col("got") < F.col("target")
        lo, hi = F.when(low, F.col("lam")).otherwise(F.col("lo")), F.when(low, F.col("hi")).otherwise(F.col("lam"))
        reach = F.greatest(F.lit(1.0), F.abs("lam")) * 4.0
        step = F.when(F.col("slope") > 0, (F.col("target") - F.col("got")) / F.col("slope")).otherwise(F.when(low, reach).otherwise(-reach))
        newton = F.col("lam") + F.greatest(-reach, F.least(reach, step))
        inside = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        done = F.col("done") | F.col("full") | F.col("got").isNull() | (F.abs(F.col("got") - F.col("target")) <= TOLERANCE * F.col("target"))
        state = stored(new.select("sid", "target", "mean", F.when(done, F.col("lam")).otherwise(inside).alias("lam"),
                                  F.when(done, F.col("lo")).otherwise(lo).alias("lo"), F.when(done, F.col("hi")).otherwise(hi).alias("hi"), "full", done.alias("done")), "dual")
        if state.where("not done").isEmpty():
            break
    return state.select("sid", "full", "mean", F.round("lam", 9).alias("lam"))


def _tie() -> Column:
    """What rows of one id, source and size are told apart by."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    sizes = stored(docs.select(F.lit(0).alias("id"), _tie(), "doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return _planned(sizes, weights, cap).drop("id")


def _planned(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """The plan of a stored table (id, tie, doc_id, source, size), where ``id`` is the caller's and settles ties of equal rows."""
    sources = stored(targets(sizes, weights, cap), "sources")
    # A null source matches its own row: compare flag and text.
    named = sources.select("sid", F.col("source").isNull().alias("__none"), F.coalesce("source", F.lit("")).alias("__source"))
    keyed = sizes.select("id", "tie", "doc_id", "size", F.col("source").isNull().alias("__none"), F.coalesce("source", F.lit("")).alias("__source"))
    keyed = stored(keyed.join(named, ["__none", "__source"]).select(F.coalesce("doc_id", F.lit(-1)).alias("__doc"), "id", "tie", "doc_id", "size", "sid"), "keyed")
    hist = stored(keyed.groupBy("sid", "size").agg(F.count(F.lit(1)).alias("n")), "sizes-by-source")
    dual = solve(hist, sources, cap)
    rate = F.when(F.col("full"), F.lit(cap)).otherwise(_rates(F.col("lam"), F.col("size") / F.greatest("mean", F.lit(1e-300)), cap))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate)
    hist = hist.join(dual, "sid").select("sid", "size", "n", F.round(rate * UNIT).cast("long").alias("rate"))
    # Prefix sums of rates along each source by size, in two steps: bands of sizes first, so that no task sorts a whole source.
    hist = stored(hist.withColumn("band", F.floor(F.log2(F.col("size") + 1.0) * 16).cast("int")), "rates")
    bands = hist.groupBy("sid", "band").agg(F.sum(F.col("n") * F.col("rate")).alias("sum"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("sid", "band", F.coalesce(F.sum("sum").over(earlier("sid").orderBy("band")), F.lit(0)).alias("__band"))
    inner = F.coalesce(F.sum(F.col("n") * F.col("rate")).over(earlier("sid", "band").orderBy("size")), F.lit(0))
    starts = hist.withColumn("__inner", inner).join(bands, ["sid", "band"]).select("sid", "size", "n", "rate", (F.col("__inner") + F.col("__band")).alias("start"))
    half = F.lit(UNIT // 2)
    total = F.floor((F.col("start") + F.col("n") * F.col("rate") + half) / F.lit(UNIT)) - F.floor((F.col("start") + half) / F.lit(UNIT))
    groups = stored(starts.select("sid", "size", "n", total.cast("long").alias("total")), "copies")
    for part in (4, 4, 1):
        groups = stored(_settled(groups, sources, part, cap), "copies")
    rows = ranked(keyed, ["sid", "size"], ["__doc", "tie"], "rank", ["id"]).join(groups, ["sid", "size"]).join(sources.select("sid", "source_size", "target"), "sid")
    copies = F.floor((F.col("rank") + 1) * F.col("total") / F.col("n")) - F.floor(F.col("rank") * F.col("total") / F.col("n"))
    return rows.select("id", "doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def _settled(groups: DataFrame, sources: DataFrame, part: int, cap: float) -> DataFrame:
    """Move each source's sum towards its target with copies of documents of at most 1/part of the difference, long ones first.

    Documents of one source and size are alike, so only the copies of the whole group (``total``) matter.
    """
    taken = groups.groupBy("sid").agg(F.sum(F.col("total") * F.col("size")).alias("taken"))
    off = taken.join(sources.select("sid", "target"), "sid").select("sid", (F.round("target") - F.col("taken")).cast("long").alias("off"))
    at = groups.join(off, "sid")
    room = F.when(F.col("off") > 0, F.floor(F.lit(cap)).cast("long") * F.col("n") - F.col("total")).otherwise(F.col("total"))
    usable = (F.col("size") > 0) & (F.col("size") * part <= F.abs("off"))
    at = at.withColumn("room", F.when(usable, room).otherwise(F.lit(0).cast("long")))
    longer = Window.partitionBy("sid").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.abs("off") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(longer), F.lit(0))
    at = at.withColumn("move", F.greatest(F.lit(0), F.least(F.col("room"), F.floor(left / F.greatest("size", F.lit(1))))).cast("long"))
    return at.select("sid", "size", "n", (F.col("total") + F.signum("off").cast("long") * F.col("move")).alias("total"))


def apply(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The documents of the mix, each repeated by its copies, with the columns of ``docs``.

    A row finds its copies by its number in the stored table, so nothing depends on ids; equal rows are alike to the plan.
    """
    own = docs.select(F.struct(*docs.columns).alias("row"), _tie(), F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    rows = stored(own.withColumn("id", F.monotonically_increasing_id()), "mix-rows")
    placed = _planned(rows.select("id", "tie", "doc_id", "source", "size"), weights, cap).where("copies > 0").select("id", "copies")
    repeated = rows.select("id", "row").join(placed, "id").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return repeated.select("row.*")
