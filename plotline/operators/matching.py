"""Match clips to rows of other text sources: by time tolerance, by text key, by nearest time, by name variants.

Rows are counted by sequence first. Where a task can hold any sequence they are matched in place: either side is shuffled once,
by sequence. Where one is longer, or a cell is crowded, they are matched by joins over stored places, as follows.

All time joins are equi joins on (sequence, start cell, end cell). Both times are cells of a grid, a left row is
copied to the few cells its tolerance touches, and right rows at the same place are first reduced to the one that can
win; these places are stored, so the right side is read once. A cell therefore holds at most as many right rows as there are clock ticks in it, whatever the size of the
tables; a sequence that holds a third of all rows spreads over as many cells as it has moments. Where the nearest row
is wanted and the densest cell, which is counted first, is still crowded, the search goes outwards in rings: a row found
within a small reach is the nearest, and only rows that found none go on to larger cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions import domains as D
from plotline.functions import text as X
from plotline.operators.ordering import HOT_GROUP_ROWS, setting
from plotline.session import durable

_SLACK = 1e-6


def shuffled(rows: DataFrame) -> DataFrame:
    """Rows as the right side of a join that sends neither side through the driver.

    Sizes of exploded rows are estimated by the size of the packed files they come from, which is many times too low.
    """
    return rows.hint("shuffle_merge")


def unpivot_sources(wide: DataFrame, ids: Sequence[str], sources: Sequence[str]) -> DataFrame:
    """Long (ids, source, text) rows of all text sources in one pass; empty texts dropped."""
    missing = [s for s in sources if s not in wide.columns]
    if missing:
        raise ValueError(f"no such source column: {missing}")
    return (
        wide.unpivot(list(ids), list(sources), "source", "text")
        .withColumn("text", X.strip(F.col("text")))
        .filter(F.length("text") > 0)
    )


def _cells(value: Column, reach: float, width: float) -> Column:
    return F.sequence(
        F.floor((value - (reach + _SLACK)) / width).cast("bigint"), F.floor((value + (reach + _SLACK)) / width).cast("bigint"))


def _cell(value: Column, width: float) -> Column:
    return F.floor(value / width).cast("bigint")


#: What a row of the index is found by: its two times, its wording alone, its wording and its times. The last: it is a left row.
_TIME, _WORD, _NEAR, _ASKS = 0, 1, 2, 3
#: Rows in a cell from which the search goes outwards in rings.
DENSE_CELL = ("spark.plotline.denseCell", 2000)
#: Rows of both sides that a task gets where sequences are matched in place: at least, and on average at most.
TASK_ROWS = (10_000, 250_000)
#: Counts that all cells share when it is first asked whether one may be crowded.
SHARED_COUNTS = 1 << 20
#: Width of a cell for wordings, in limits: a left row looks in one or two cells of each time, in 1.6 of both on average.
NEAR_WIDTH = 8
_TIMES = ("_b.r_start", "_b.r_end")
_SLOT = ("_slot", "_t", "_u", "_cs", "_ce")


def _hashes(keys: Sequence[str], *wording: Column) -> tuple[Column, Column]:
    """Sequence, and wording if any, as 128 bits."""
    parts = [*[F.col(k).cast("string") for k in keys], *wording]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def _known(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Without rows of an unknown sequence: they match nothing."""
    return rows.dropna(subset=list(keys)) if keys else rows


def _way(slot: int, hashes: tuple[Column, Column]) -> Column:
    return F.struct(F.lit(slot).alias("_slot"), hashes[0].alias("_t"), hashes[1].alias("_u"))


def _places(right: DataFrame, keys: Sequence[str], by: Sequence[str], payload: Sequence[str], order: str, by_time: bool, by_text: bool, truth: str) -> DataFrame:
    """One row per (way to find it, ``by``, start, end): the first in input order and how many there are. Read once, then stored.

    A row is listed under both of its text keys, and twice where these are equal, as the rules want.
    """
    ways = [F.array(_way(_TIME, _hashes(keys)))] if by_time else []
    if by_text:
        keyed = F.array(*[_way(_WORD, _hashes(keys, k)) for k in (X.compare_key(F.col(truth)), X.lookup_key(F.col(truth)))])
        ways.append(F.when(F.length(truth) > 0, keyed).otherwise(F.slice(keyed, 1, 0)))
    rows = _known(right, keys).select(*by, "r_start", "r_end", F.struct(*payload).alias("_p"), F.col(order).alias("_o"), F.explode(F.concat(*ways)).alias("_w")).select("*", "_w.*").drop("_w")
    return durable(rows.groupBy(*by, "_slot", "_t", "_u", "r_start", "r_end").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("_p", "_o").alias("_p"), F.min("_o").alias("_o")))


def _celled(places: DataFrame, slot: int, width: float) -> DataFrame:
    return places.withColumns({"_slot": F.lit(slot), "_cs": _cell(F.col("r_start"), width), "_ce": _cell(F.col("r_end"), width)})


def _probe(slot: int, which: int, key: Sequence[Column], cells: tuple[Column, Column] | None) -> Column:
    """Array of what a left row looks for in one way: one entry per cell in reach."""
    zero = F.lit(0).cast("bigint")
    starts, ends = cells or (F.array(zero), F.array(zero))

    def entry(cs: Column, ce: Column) -> Column:
        return F.struct(F.lit(slot).alias("_slot"), F.lit(which).alias("_which"), key[0].alias("_t"), key[1].alias("_u"), cs.alias("_cs"), ce.alias("_ce"))

    return F.flatten(F.transform(starts, lambda cs: F.transform(ends, lambda ce: entry(cs, ce))))


def _dense(places: DataFrame, by: Sequence[str], slot: int, width: float) -> bool:
    """Whether any cell holds many places: one combined count by hash over the stored places, one number to the driver."""
    cells = _celled(places.filter(F.col("_slot") == slot), slot, width)
    densest = cells.groupBy(F.xxhash64(*by, *_SLOT)).count().agg(F.max("count")).first()[0] or 0
    return densest > setting(places, DENSE_CELL)


def _by_cells(left: DataFrame, right: DataFrame, left_id: Sequence[str], keys: Sequence[str], payload: Sequence[str], order: str, by: Sequence[str],
              tolerance: float | None, limit: float | None, text: str, truth: str, times: bool) -> DataFrame:
    """Match that spreads any sequence over its cells.

    Either side is read once. A left row looks in one join for its cell of times, for the count of rows under each of its wordings,
    and for rows under these in its larger cells; what it has found is put together in one aggregation. ``by`` are columns
    of the right rows alone: a left row is matched with the rows of each of their values.
    """
    places = _places(right, keys, by, payload, order, tolerance is not None, limit is not None, truth)
    found_by = [*left_id, *by]
    listed, looks, hashed, stamps = [], [], {}, ["r_start", "r_end"] if times else []
    crowded = limit is not None and _dense(places, by, _WORD, NEAR_WIDTH * limit)

    def look(slot: int, which: int, cells: tuple[Column, Column] | None) -> None:
        looks.append(_probe(slot, which, (F.col(f"_t{which}"), F.col(f"_u{which}")), cells))

    def hash_(which: int, *wording: Column) -> None:
        hashed[f"_t{which}"], hashed[f"_u{which}"] = _hashes(keys, *wording)

    if tolerance is not None:
        width = 4 * tolerance
        listed.append(_celled(places.filter(F.col("_slot") == _TIME), _TIME, width))
        hash_(0)
        look(_TIME, 0, (_cells(F.col("l_start"), tolerance, width), _cells(F.col("l_end"), tolerance, width)))
    if limit is not None:
        worded, width = places.filter(F.col("_slot") == _WORD), NEAR_WIDTH * limit
        first = F.min_by(F.struct("_p", *stamps), "_o").alias("_f")
        at = [F.col(f"_f.{x}") if times else F.lit(None).cast("double").alias(x) for x in ("r_start", "r_end")]
        counts = worded.groupBy(*by, "_t", "_u").agg(F.sum("_n").alias("_n"), first).select(
            *by, F.lit(_WORD).alias("_slot"), "_t", "_u", *at, "_n", F.when(F.col("_n") == 1, F.col("_f._p")).alias("_p"), F.lit(None).cast(dict(places.dtypes)["_o"]).alias("_o"),
            F.lit(0).cast("bigint").alias("_cs"), F.lit(0).cast("bigint").alias("_ce"))
        listed.append(counts)
        for which, key in ((1, X.compare_key(F.col(text))), (2, X.lookup_key(F.col(text)))):
            hash_(which, key)
            look(_WORD, which, None)
            if not crowded:
                look(_NEAR, which, (_cells(F.col("l_start"), limit, width), _cells(F.col("l_end"), limit, width)))
        if not crowded:
            listed.append(_celled(worded, _NEAR, width))
    index = listed[0]
    for other in listed[1:]:
        index = index.unionByName(other)
    asked = _known(left, keys).select(*left_id, "l_start", "l_end", *[h.alias(name) for name, h in hashed.items()])
    probes = asked.select(*left_id, "l_start", "l_end", F.explode(F.concat(*looks)).alias("_l")).select(*left_id, "l_start", "l_end", "_l.*")
    apart = (F.abs(F.col("r_start") - F.col("l_start")), F.abs(F.col("r_end") - F.col("l_end")))
    slot = F.col("_slot")
    reached = slot == _WORD
    if tolerance is not None:
        reached = reached | ((slot == _TIME) & (apart[0] <= tolerance) & (apart[1] <= tolerance))
    if limit is not None:
        reached = reached | ((slot == _NEAR) & (apart[0] + apart[1] <= limit))
    hits = probes.join(shuffled(index), list(_SLOT)).filter(reached)
    here = F.struct("_p", *stamps)

    def best(condition: Column, *sort: str | Column) -> Column:
        return F.min_by(here, F.when(condition, F.struct(*sort)))

    picks = [best(slot == _TIME, "r_start", "r_end", "_o").alias("_time")]
    for which in (1, 2):
        mine = F.col("_which") == which
        picks += [
            F.max(F.when(mine & (slot == _WORD), F.col("_n"))).alias(f"_n{which}"),
            best(mine & (slot == _WORD) & (F.col("_n") == 1), F.lit(0)).alias(f"_one{which}"), best(mine & (slot == _NEAR), (apart[0] + apart[1]).alias("d"), "_o").alias(f"_near{which}")]
        if crowded:
            picks.append(F.max(F.when(mine & (slot == _WORD), F.struct("_t", "_u"))).alias(f"_k{which}"))
    # Only the search in rings asks once more with the times and the key.
    again = [F.first("l_start").alias("l_start"), F.first("l_end").alias("l_end")] if crowded else []
    put = hits.groupBy(*found_by).agg(*picks, *again)
    parts = ["n", "one", "near"] + (["k"] if crowded else [])
    first_key = F.col("_n1").isNotNull()
    put = put.select(*found_by, "_time", *[F.when(first_key, F.col(f"_{x}1")).otherwise(F.col(f"_{x}2")).alias(f"_{x}") for x in parts], *(["l_start", "l_end"] if crowded else []))
    chosen = F.when(F.col("_time").isNotNull(), F.col("_time")).when(F.col("_n") == 1, F.col("_one")).otherwise(F.col("_near"))
    how = F.when(F.col("_time").isNotNull(), "time").otherwise("text").alias("matched_by")
    done = put.select(*found_by, chosen.alias("_b"), how).filter(F.col("_b").isNotNull())
    if not crowded:
        return done
    several = put.filter(F.col("_time").isNull() & (F.col("_n") > 1)).select(*found_by, "l_start", "l_end", "_k._t", "_k._u")
    worded = places.filter(F.col("_slot") == _WORD).drop("_slot", "_n")
    rest = _nearest(several, worded, found_by, [*by, "_t", "_u"], apart[0] + apart[1], _rings(limit), strict=False)
    return done.unionByName(rest.select(*found_by, F.struct(*[F.col(f"_b.{x}").alias(x) for x in ("_p", *stamps)]).alias("_b"), F.lit("text").alias("matched_by")))


def _lengths(rows: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the longest sequence and of all: two numbers to the driver."""
    counts = _known(rows, keys).groupBy(*_hashes(keys)).agg(F.count(F.lit(1)).alias("n"))
    facts = counts.agg(F.max("n"), F.sum("n")).first()
    return facts[0] or 0, facts[1] or 0


def _crowded(right: DataFrame, keys: Sequence[str], by: Sequence[str], tolerance: float | None, limit: float | None, truth: str) -> bool:
    """Whether any cell holds many places. Cells share their counts at first, so that what is shuffled does not grow with the rows."""
    def cell(width: float, *wording: Column) -> Column:
        return F.xxhash64(*by, _hashes(keys, *wording)[0], _cell(F.col("r_start"), width), _cell(F.col("r_end"), width))

    cells = [cell(4 * tolerance)] if tolerance is not None else []
    if limit is not None:
        cells += [F.when(F.length(truth) > 0, cell(NEAR_WIDTH * limit, k)) for k in (X.compare_key(F.col(truth)), X.lookup_key(F.col(truth)))]
    most = setting(right, DENSE_CELL)
    rows = _known(right, keys).select("r_start", "r_end", F.explode(F.array_compact(F.array(*cells))).alias("_c")).withColumn("_shared", F.pmod("_c", F.lit(SHARED_COUNTS)).cast("int"))
    full = durable(rows.groupBy("_shared").count().filter(F.col("count") > most).select("_shared"))
    if full.isEmpty():
        return False
    places = rows.join(full, "_shared", "left_semi").select("_c", "r_start", "r_end").distinct()
    return (places.groupBy("_c").count().agg(F.max("count")).first()[0] or 0) > most


def _match(left: DataFrame, right: DataFrame, left_id: Sequence[str], keys: Sequence[str], payload: Sequence[str], order: str, by: Sequence[str],
           tolerance: float | None, limit: float | None, text: str, truth: str = "ground_truth", times: bool = True) -> DataFrame:
    """``left_id``, ``by``, ``_b`` (payload, and times where wanted) and ``matched_by`` of the left rows that found a row.

    Rows are counted by sequence first. Sequences are matched in place; where one is too long for a task or a cell is crowded, by cells.
    ``by`` are columns of the right rows alone: a left row is matched with the rows of each of their values.
    """
    rest = (left_id, keys, payload, order, by, tolerance, limit, text, truth, times)
    most, totals = zip(*[_lengths(rows, keys) for rows in (left, right)], strict=True)
    hot, dense = setting(left, HOT_GROUP_ROWS), setting(left, DENSE_CELL)
    least, largest = TASK_ROWS
    parts = max(min(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(totals) // least), sum(totals) // largest) + 1
    if max(most) > hot or (most[1] > dense and _crowded(right, keys, by, tolerance, limit, truth)):
        return _by_cells(left, right, *rest)
    return _in_place(left, right, *rest, parts)


def _in_place(left: DataFrame, right: DataFrame, left_id: Sequence[str], keys: Sequence[str], payload: Sequence[str], order: str, by: Sequence[str],
              tolerance: float | None, limit: float | None, text: str, truth: str, times: bool, parts: int) -> DataFrame:
    """Match of sequences that one task can hold, dealt to ``parts`` tasks: a number, as rows become many more there than their size tells.

    Rows of both sides go by sequence in one shuffle, as they are: places, counts of wordings, cells, and what lies in them are made
    where the rows then are, by windows, which unlike a join keep them there. What was picked goes by left row, as an id may come in
    several sequences. Wordings are found as in ``_by_cells``, but only those that occur several times are listed by cell.
    """
    stamps = ["r_start", "r_end"] if times else []
    spans = {_TIME: 4 * (tolerance or 1.0), _NEAR: NEAR_WIDTH * (limit or 1.0)}
    both, none = limit is not None, F.lit(0).cast("bigint")
    words = ["_w1", "_w2"] if both else []

    def rows_of(rows: DataFrame, name: str, start: str, end: str, *more: Column | str) -> DataFrame:
        named = [_hashes(keys, k)[0] for k in (X.compare_key(F.col(name)), X.lookup_key(F.col(name)))] if both else []
        if more:
            named = [F.when(F.length(name) > 0, w) for w in named]
        return _known(rows, keys).select(
            *(more or left_id), F.col(start).alias("_s"), F.col(end).alias("_e"), F.lit(bool(more)).alias("_right"), _hashes(keys)[0].alias("_t"), *[w.alias(x) for w, x in zip(named, words, strict=True)])

    listed = rows_of(right, truth, "r_start", "r_end", *by, F.when(F.col(order).isNotNull(), F.struct(*payload)).alias("_p"), F.col(order).alias("_o"))
    rows = rows_of(left, text, "l_start", "l_end").unionByName(listed, allowMissingColumns=True).repartition(parts, "_t")
    is_right, first = F.col("_right"), F.asc_nulls_last("_o")

    # Right rows at one place are reduced to the first.
    place = Window.partitionBy("_t", "_right", *by, "_s", "_e", *words)
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(place), "_at": F.row_number().over(place.orderBy(first))}).filter(~is_right | (F.col("_at") == 1))

    # Each is listed by its times and by its wordings, with the number of rows that are found so.
    def key(slot: int, word: Column, *cells: Column) -> Column:
        return F.xxhash64(F.lit(slot), word, *cells)

    def way(slot: int, word: Column) -> Column:
        return F.struct(F.lit(slot).alias("_slot"), word.alias("_w"))

    def own_cells(slot: int) -> list[Column]:
        return [_cell(F.col(x), spans[slot]) for x in ("_s", "_e")]

    ways = [way(_TIME, key(_TIME, none, *own_cells(_TIME)))] if tolerance is not None else []
    ways += [F.when(F.col(w).isNotNull(), way(_WORD, F.col(w))) for w in words]
    ways = F.when(is_right, F.array_compact(F.array(*ways))).otherwise(F.array(way(_ASKS, F.xxhash64("_s", "_e"))))
    rows = rows.select("*", F.explode(ways).alias("_l")).select("*", "_l.*").drop("_l", "_at")
    alike = Window.partitionBy("_t", *by, "_slot", "_w")
    rows = rows.withColumns({"_n": F.sum("_n").over(alike), "_at": F.row_number().over(alike.orderBy(first))})

    # Rows that ask and rows that are found meet where they have the same key.
    def entry(slot: int, which: int, key: Column) -> Column:
        return F.struct(F.lit(slot).alias("_slot"), F.lit(which).alias("_which"), key.alias("_k"))

    def looks(slot: int, which: int, word: Column, reach: float) -> Column:
        starts, ends = (_cells(F.col(x), reach, spans[slot]) for x in ("_s", "_e"))
        return F.flatten(F.transform(starts, lambda cs: F.transform(ends, lambda ce: entry(_ASKS, which, key(slot, word, cs, ce)))))

    word, slot = F.col("_w"), F.col("_slot")
    shown = F.array_compact(F.array(
        F.when(slot == _TIME, entry(_TIME, 0, word)), F.when((slot == _WORD) & (F.col("_at") == 1), entry(_WORD, 0, key(_WORD, word))),
        F.when((slot == _WORD) & (F.col("_n") > 1), entry(_NEAR, 0, key(_NEAR, word, *own_cells(_NEAR))))))
    asked = [looks(_TIME, 0, none, tolerance)] if tolerance is not None else []
    for which, w in enumerate(words, 1):
        asked += [F.array(entry(_ASKS, which, key(_WORD, F.col(w)))), looks(_NEAR, which, F.col(w), limit)]
    rows = rows.withColumn("_l", F.explode(F.when(is_right, shown).otherwise(F.concat(*asked)))).drop("_slot", "_w", "_at", *words).select("*", "_l.*").drop("_l")
    found = F.collect_list(F.when(is_right, F.struct(*by, F.col("_s").alias("r_start"), F.col("_e").alias("r_end"), "_slot", "_n", "_p", "_o"))).over(Window.partitionBy("_t", "_k"))
    hits = rows.select("*", found.alias("_found")).filter(~is_right & (F.size("_found") > 0)).select(
        *left_id, F.col("_s").alias("l_start"), F.col("_e").alias("l_end"), "_t", "_which", F.explode("_found").alias("_f")).select("*", "_f.*").drop("_f")

    apart = (F.abs(F.col("r_start") - F.col("l_start")), F.abs(F.col("r_end") - F.col("l_end")))
    distance = apart[0] + apart[1]
    reached = slot == _WORD
    if tolerance is not None:
        reached = reached | ((slot == _TIME) & (apart[0] <= tolerance) & (apart[1] <= tolerance))
    if limit is not None:
        reached = reached | ((slot == _NEAR) & (distance <= limit))
    here, time_at, near_at = F.struct("_p", *stamps), F.struct("r_start", "r_end", "_o"), F.struct(distance.alias("d"), "_o")
    picks = [F.min_by(here, F.when(slot == _TIME, time_at)).alias("_time"), F.min(F.when(slot == _TIME, time_at)).alias("_time_at")]
    for which in (1, 2):
        mine = F.col("_which") == which
        near = F.when(mine & (slot == _NEAR), near_at)
        picks += [
            F.max(F.when(mine & (slot == _WORD), F.col("_n"))).alias(f"_n{which}"), F.min_by(here, F.when(mine & (slot == _WORD) & (F.col("_n") == 1), F.lit(0))).alias(f"_one{which}"),
            F.min_by(here, near).alias(f"_near{which}"), F.min(near).alias(f"_near_at{which}")]
    put = hits.filter(reached).groupBy("_t", *left_id, *by).agg(*picks)
    # Time goes before wording and the first wording before the second; the rest need not be sent.
    untimed, first_key = F.col("_time").isNull(), F.col("_n1").isNotNull()
    put = put.select(*left_id, *by, "_time", "_time_at", F.when(untimed, F.when(first_key, 1).otherwise(2)).alias("_which"), *[
        F.when(untimed, F.when(first_key, F.col(f"_{x}1")).otherwise(F.col(f"_{x}2"))).alias(f"_{x}") for x in ("n", "one", "near", "near_at")])
    put = put.repartition(parts, *left_id).groupBy(*left_id, *by).agg(
        F.min_by("_time", "_time_at").alias("_time"), F.min("_which").alias("_which"), F.max(F.struct(-F.col("_which"), "_n"))["_n"].alias("_n"),
        F.min_by("_one", F.when(F.col("_one").isNotNull(), F.col("_which"))).alias("_one"),
        F.min_by(F.struct("_near", "_which"), F.when(F.col("_near").isNotNull(), F.struct("_which", "_near_at"))).alias("_near"))
    near = F.when(F.col("_near._which") == F.col("_which"), F.col("_near._near"))
    chosen = F.when(F.col("_time").isNotNull(), F.col("_time")).when(F.col("_n") == 1, F.col("_one")).otherwise(near)
    how = F.when(F.col("_time").isNotNull(), "time").otherwise("text").alias("matched_by")
    return put.select(*left_id, *by, chosen.alias("_b"), how).filter(F.col("_b").isNotNull())


def tolerance_match(left: DataFrame, right: DataFrame, left_id: Sequence[str], keys: Sequence[str], payload: Sequence[str],
                    order: str = "ord", tolerance: float = D.MATCH_TOLERANCE, by: Sequence[str] = ()) -> DataFrame:
    """First right row by (start, end) with both times within the tolerance; only matched left rows.

    ``left`` has ``left_id, keys, l_start, l_end``; ``right`` has ``keys, by, r_start, r_end, order`` and the payload.
    """
    return _match(left, right, left_id, keys, payload, order, by, tolerance, None, "").select(*left_id, *by, "_b._p.*", "_b.r_start", "_b.r_end")


def text_match(left: DataFrame, right: DataFrame, left_id: Sequence[str], keys: Sequence[str], payload: Sequence[str],
               text: str = "text", order: str = "ord", limit: float = D.TEXT_MATCH_LIMIT, by: Sequence[str] = (), times: bool = True) -> DataFrame:
    """Match by wording: the only candidate under a key, or the nearest in time within ``limit`` of several. ``times``: with its times."""
    found = _match(left, right, left_id, keys, payload, order, by, None, limit, text, times=times)
    return found.select(*left_id, *by, "_b._p.*", *_TIMES * times)


def match_texts(left: DataFrame, right: DataFrame, left_id: Sequence[str], keys: Sequence[str], payload: Sequence[str],
                text: str = "text", order: str = "ord", by: Sequence[str] = (), times: bool = True) -> DataFrame:
    """Time tolerance first, wording for what is left; adds ``matched_by``. ``times``: with the times of the row found."""
    found = _match(left, right, left_id, keys, payload, order, by, D.MATCH_TOLERANCE, D.TEXT_MATCH_LIMIT, text, times=times)
    return found.select(*left_id, *by, "_b._p.*", *_TIMES * times, "matched_by")


def _rings(limit: float) -> list[float]:
    return [limit / 100, limit / 10, limit]


def _in_reach(left: DataFrame, places: DataFrame, keys: Sequence[str], reach: float) -> DataFrame:
    width = 4 * reach
    probes = (
        left.withColumn("_cs", F.explode(_cells(F.col("l_start"), reach, width)))
        .withColumn("_ce", F.explode(_cells(F.col("l_end"), reach, width)))
    )
    stored = places.withColumn("_cs", _cell(F.col("r_start"), width)).withColumn("_ce", _cell(F.col("r_end"), width))
    return probes.join(shuffled(stored), [*keys, "_cs", "_ce"]).drop("_cs", "_ce")


def _nearest(left: DataFrame, places: DataFrame, found_by: Sequence[str], keys: Sequence[str], distance: Column,
             reaches: Sequence[float], strict: bool) -> DataFrame:
    """``found_by`` and winning place ``_b`` (with its distance ``_d``) per left row with a place in reach."""
    found = None
    rest = left
    for reach in reaches:
        close = _in_reach(rest, places, [k for k in keys if k in rest.columns], reach).withColumn("_d", distance)
        close = close.filter(F.col("_d") < reach if strict else F.col("_d") <= reach)
        best = close.groupBy(*found_by).agg(
            F.min_by(F.struct("_p", "r_start", "r_end", "_d"), F.struct("_d", "_o")).alias("_b"))
        found = best if found is None else found.unionByName(best)
        if reach != reaches[-1]:
            rest = rest.join(shuffled(best.select(*found_by)), list(found_by), "left_anti")
    return found


def nearest_match(left: DataFrame, right: DataFrame, left_id: Sequence[str], keys: Sequence[str], payload: Sequence[str],
                  order: str = "ord", limit: float = D.NEAREST_LIMIT, by: Sequence[str] = ()) -> DataFrame:
    """Right row with the smallest max(|start|, |end|) difference below the limit; first in input order on ties."""
    error = F.greatest(F.abs(F.col("r_start") - F.col("l_start")), F.abs(F.col("r_end") - F.col("l_end")))
    places = _places(right, keys, by, payload, order, True, False, "")
    hashes = _hashes(keys)
    rows = _known(left, keys).select(*left_id, "l_start", "l_end", hashes[0].alias("_t"), hashes[1].alias("_u"))
    crowded = _dense(places, by, _TIME, 4 * limit)
    if crowded and by:  # rings drop left rows that are settled, for each value of ``by`` on its own
        rows = rows.join(shuffled(places.select("_t", "_u", *by).distinct()), ["_t", "_u"])
    found = _nearest(rows, places, [*left_id, *by], ["_t", "_u", *by], error, _rings(limit) if crowded else [limit], strict=True)
    return found.select(*left_id, *by, "_b._p.*", F.col("_b._d").alias("error"))


def variant_lookup(left: DataFrame, right: DataFrame, left_id: Sequence[str], variants: Column, name: str,
                   payload: Sequence[str], order: str = "ord") -> DataFrame:
    """Exact (name variant, start, end) lookup; variants are tried in array order, later duplicates win as in a dict."""
    tried = left.select(*left_id, F.col("l_start").alias("_s"), F.col("l_end").alias("_e"),
                        F.posexplode(variants).alias("_rank", "_name"))
    stored = right.groupBy(F.col(name).alias("_name"), F.col("r_start").alias("_s"), F.col("r_end").alias("_e")).agg(
        F.max_by(F.struct(*payload), order).alias("_p"))
    hits = tried.join(shuffled(stored), ["_name", "_s", "_e"])
    return (
        hits.groupBy(*left_id)
        .agg(F.min_by(F.struct("_p", "_rank"), "_rank").alias("_b"))
        .select(*left_id, "_b._p.*", F.col("_b._rank").alias("variant_rank"))
    )


def materialize_context(placed: DataFrame, item: Sequence[str]) -> DataFrame:
    """All-or-nothing contexts.

    ``placed`` has one row per (item, place) with ``clip_id`` and the matched ``text``, null where nothing matched. An
    item with any such place is not complete; its missing clips are listed. Lists are as long as the context asked for.
    """
    found, text = F.col("text").isNotNull(), F.struct("place", "text")
    return placed.groupBy(*item).agg(
        F.transform(F.array_sort(F.collect_list(F.when(found, text))), lambda s: s["text"]).alias("context"),
        F.array_sort(F.collect_list(F.when(~found, F.col("clip_id")))).alias("unmatched"),
    ).withColumn("complete", F.size("unmatched") == 0)
