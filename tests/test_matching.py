"""Matching by time, wording and nearest time, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from plotline.functions import text as X
from plotline.operators import matching as M

LEFT = "id long, key string, l_start double, l_end double, text string"
RIGHT = "ord long, key string, r_start double, r_end double, ground_truth string, text string"


def _data(seed):
    rng = random.Random(seed)
    words = ["He nods.", "The dog's bowl", "the dogs bowl", "Rain", "rain"]
    left = [(i, rng.choice("ppq"), round(rng.uniform(0, 30), 2), round(rng.uniform(0, 30), 2), rng.choice(words)) for i in range(150)]
    right = []
    for i in range(150):
        if i % 2:
            _, key, s, e, t = rng.choice(left)
            s, e = round(s + rng.choice([0, 0.01, 0.02, 0.03, -0.02, 0.3]), 2), round(e + rng.choice([0, 0.01, -0.02, 0.2]), 2)
        else:
            key, s, e, t = rng.choice("pq"), round(rng.uniform(0, 30), 2), round(rng.uniform(0, 30), 2), rng.choice(words)
        right.append((i, key, s, e, rng.choice([t, ""]), f"text {i}"))
    return left, right


def _k1(t):
    return " ".join(t.split()).lower()


def _k2(t):
    import re

    return re.sub(r"[^a-z0-9]+", "", re.sub(r"\b([a-z0-9]+)'s\b", r"\1", t.lower()))


def _time(l, right):
    hits = [r for r in sorted(right, key=lambda r: (r[2], r[3])) if r[1] == l[1] and abs(r[2] - l[2]) <= 0.02 and abs(r[3] - l[3]) <= 0.02]
    return hits[0] if hits else None


def _text(l, right):
    index = {}
    for r in right:
        if r[4]:
            for k in (_k1(r[4]), _k2(r[4])):
                index.setdefault((r[1], k), []).append(r)
    found = index.get((l[1], _k1(l[4]))) or index.get((l[1], _k2(l[4]))) or []
    if len(found) == 1:
        return found[0]
    if found:
        best = min(found, key=lambda r: abs(r[2] - l[2]) + abs(r[3] - l[3]))
        if abs(best[2] - l[2]) + abs(best[3] - l[3]) <= 6.0:
            return best
    return None


@pytest.fixture(params=[None, "0"])
def rings(spark, request):
    """Plain cells, and a search in rings whatever the density."""
    if request.param:
        spark.conf.set("spark.plotline.denseCell", request.param)
    yield
    spark.conf.unset("spark.plotline.denseCell")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_equal_the_sequential_rules(spark, rings, seed):
    left, right = _data(seed)
    ldf, rdf = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    by_time = {r["id"]: r["ord"] for r in M.tolerance_match(ldf, rdf, ["id"], ["key"], ["ord", "text"]).collect()}
    assert by_time == {l[0]: _time(l, right)[0] for l in left if _time(l, right)}
    by_text = {r["id"]: r["ord"] for r in M.text_match(ldf, rdf, ["id"], ["key"], ["ord", "text"]).collect()}
    assert by_text == {l[0]: _text(l, right)[0] for l in left if _text(l, right)}
    near = {}
    for l in left:
        hits = [(max(abs(r[2] - l[2]), abs(r[3] - l[3])), r[0]) for r in right if r[1] == l[1]]
        hits = [h for h in hits if h[0] < 0.4]
        if hits:
            near[l[0]] = min(hits)[1]
    assert {r["id"]: r["ord"] for r in M.nearest_match(ldf, rdf, ["id"], ["key"], ["ord"]).collect()} == near
    both = {r["id"]: r["ord"] for r in M.match_texts(ldf, rdf, ["id"], ["key"], ["ord"]).collect()}
    assert both == {l[0]: (_time(l, right) or _text(l, right))[0] for l in left if _time(l, right) or _text(l, right)}


def test_columns_of_the_right_side_split_the_candidates(spark, rings):
    """With two sources every left row is matched with the rows of each, as if these were alone."""
    left, right = _data(4)
    ldf = spark.createDataFrame(left, LEFT)
    rdf = spark.createDataFrame(right, RIGHT).withColumn("source", F.when(F.col("ord") % 3 == 0, "a").otherwise("b"))
    for match in (M.tolerance_match, M.text_match, M.match_texts, M.nearest_match):
        both = sorted((r["source"], r["id"], r["ord"]) for r in match(ldf, rdf, ["id"], ["key"], ["ord"], by=["source"]).collect())
        apart = sorted((s, r["id"], r["ord"]) for s in "ab" for r in match(ldf, rdf.filter(F.col("source") == s), ["id"], ["key"], ["ord"]).collect())
        assert both == apart and len({s for s, *_ in both}) == 2


def test_equal_keys_count_twice_so_the_time_limit_applies(spark):
    ldf = spark.createDataFrame([(1, "m", 0.0, 1.0, "rain"), (2, "m", 0.0, 1.0, "It rains.")], LEFT)
    rdf = spark.createDataFrame([(1, "m", 50.0, 51.0, "rain", "a"), (2, "m", 50.0, 51.0, "it rains.", "b")], RIGHT)
    got = {r["id"]: r["text"] for r in M.text_match(ldf, rdf, ["id"], ["key"], ["text"]).collect()}
    assert got == {2: "b"}


def test_names_match_without_prefix_and_case(spark):
    row = spark.createDataFrame([("1005_Signs", "SIGNS")], "a string, b string").select(X.sequence_key(F.col("a")), X.sequence_key(F.col("b"))).first()
    assert row[0] == row[1] == "signs"


def test_unpivot_trims_and_wants_known_columns(spark):
    wide = spark.createDataFrame([(1, " x ", ""), (2, None, "y")], "id long, alpha string, beta string")
    got = {tuple(r) for r in M.unpivot_sources(wide, ["id"], ["alpha", "beta"]).collect()}
    assert got == {(1, "alpha", "x"), (2, "beta", "y")}
    with pytest.raises(ValueError):
        M.unpivot_sources(wide, ["id"], ["gamma"])


def test_context_is_all_or_nothing(spark):
    rows = spark.createDataFrame([(1, 0, "c0", "x"), (1, 1, "c1", "y"), (2, 0, "c0", "x"), (2, 1, "c9", None)], "id int, place int, clip_id string, text string")
    got = {r["id"]: (r["context"], r["unmatched"], r["complete"]) for r in M.materialize_context(rows, ["id"]).collect()}
    assert got[1] == (["x", "y"], [], True) and got[2][1:] == (["c9"], False)


def test_variants_are_tried_in_order(spark):
    left = spark.createDataFrame([(1, 0.0, 1.0, ["x", "y"]), (2, 0.0, 1.0, ["z"])], "id long, l_start double, l_end double, names array<string>")
    right = spark.createDataFrame([(1, "y", 0.0, 1.0), (2, "x", 0.0, 1.0), (3, "x", 0.0, 1.0)], "ord long, name string, r_start double, r_end double")
    got = [tuple(r) for r in M.variant_lookup(left, right, ["id"], F.col("names"), "name", ["ord"]).collect()]
    assert got == [(1, 3, 0)]


def test_sides_of_a_match_are_not_broadcast(spark):
    # Sizes estimated from packed files are far too low, so a plan that trusts them sends the whole index through the driver.
    left, right = (spark.range(200) for _ in range(2))
    ldf = left.selectExpr("id", "'p' AS key", "double(id) AS l_start", "double(id) AS l_end", "'rain' AS text")
    rdf = right.selectExpr("id AS ord", "'p' AS key", "double(id) AS r_start", "double(id) AS r_end", "'rain' AS ground_truth", "'t' AS text")
    for match in (M.tolerance_match, M.text_match, M.match_texts, M.nearest_match):
        found = match(ldf, rdf, ["id"], ["key"], ["text"])
        assert found.count() == 200
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString(), match.__name__
    placed = M.shuffled(rdf.select(F.col("ord").alias("id")))
    assert "Broadcast" not in ldf.join(placed, "id", "left")._jdf.queryExecution().executedPlan().toString()


def test_times_can_be_left_out_and_unknown_sequences_match_nothing(spark, rings):
    left, right = _data(3)
    left, right = [*left, (900, None, 1.0, 1.0, "Rain")], [*right, (900, None, 1.0, 1.0, "Rain", "unknown")]
    ldf, rdf = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    for match in (M.text_match, M.match_texts):
        full = match(ldf, rdf, ["id"], ["key"], ["ord"])
        bare = match(ldf, rdf, ["id"], ["key"], ["ord"], times=False)
        assert [c for c in full.columns if c not in bare.columns] == ["r_start", "r_end"]
        got = sorted(map(tuple, bare.collect()))
        assert got == sorted(map(tuple, full.drop("r_start", "r_end").collect()))
        assert got and 900 not in [g[0] for g in got]


def test_short_sequences_are_matched_where_they_lie(spark):
    """Either side is shuffled once and as it is, what was found once more, and nothing is stored on the way."""
    left, right = _data(5)
    ldf = spark.createDataFrame(left, LEFT)
    rdf = spark.createDataFrame(right, RIGHT).withColumn("source", F.when(F.col("ord") % 3 == 0, "a").otherwise("b"))
    for match in (M.tolerance_match, M.text_match, M.match_texts):
        plan = match(ldf, rdf, ["id"], ["key"], ["ord"], by=["source"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 2 and "Join" not in plan, match.__name__


def test_plans_of_short_and_of_long_sequences_agree(spark):
    left, right = _data(6)
    # An id that comes in two sequences, several rows at one place, rows without an order, a time or a wording.
    left += [(0, "q", 3.0, 4.0, "Rain"), (0, "r", 3.0, 4.0, "Rain"), (901, "r", None, 4.0, "Rain"), (902, "r", 3.0, 4.0, None), (None, "r", 3.0, 4.0, "rain"), (None, "p", 3.0, 4.0, "x")]
    right += [(900 + i, "r", 3.0, 4.0, "Rain", "same place") for i in range(30)] + [(990, "r", None, 4.0, "He nods.", "no start"), (991, "r", 3.01, 4.0, None, "no wording")]
    ldf = spark.createDataFrame(left, LEFT)
    rdf = spark.createDataFrame(right, RIGHT).withColumn("source", F.when(F.col("ord") % 3 == 0, "a").otherwise("b"))

    def found(**settings):
        for name, value in settings.items():
            spark.conf.set(f"spark.plotline.{name}", value)
        try:
            return [sorted(map(repr, match(ldf, rdf, ["id"], ["key"], ["ord"], by=["source"]).collect())) for match in (M.tolerance_match, M.text_match, M.match_texts)]
        finally:
            for name in settings:
                spark.conf.unset(f"spark.plotline.{name}")

    in_place = found()
    assert all(in_place)
    assert in_place == found(hotGroupRows="0")  # by cells
    assert in_place == found(denseCell="10")  # cells are counted, 30 rows at one place are one


def _events(spark, folder):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=7 * i), i % 3, ["view", "click", "signup", "error"][i % 4], 1.5 + i % 5, '{"k": %d}' % (i % 2)) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")


def test_texts_go_once_to_each_place_of_an_item(spark, tmp_path):
    """Places are listed by source only where the item is put together."""
    from plotline.plans import matching as P

    _events(spark, tmp_path)
    for query, parts in ((P.context_materialize, {(i, s) for i in range(60) for s in P.GENERATED}), (P.unmatched_report, set())):
        found = query(spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(item" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "source#" in x], plan
        parts ^= {(r["item"], r["source"]) for r in found.collect()}
        assert parts
    whole = {(r["item"], r["source"]) for r in P.context_materialize(spark, str(tmp_path)).collect()}
    lost = {(r["item"], r["source"]) for r in P.unmatched_report(spark, str(tmp_path)).collect()}
    assert whole and lost and not whole & lost
    assert {i for i, _ in whole | lost} == set(range(3, 60))  # the first event of a user has no context


def test_sources_found_are_listed_where_the_match_leaves_them(spark, tmp_path):
    """What was found goes by event; nothing is shuffled for each source of an event."""
    from plotline.plans import matching as P

    _events(spark, tmp_path)
    lost, evaluated = P.unmatched_contexts(spark, str(tmp_path)), P.evaluated(spark, str(tmp_path))
    for plan in (x._jdf.queryExecution().executedPlan().toString() for x in (lost, evaluated)):
        assert "Exchange hashpartitioning(event_id" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "source#" in x], plan
    gone = {(r["event_id"], r["source"]) for r in lost.collect()}
    assert {(i, s) for i in range(60) for s in P.GENERATED if i % 4 == 3 or (i % 4 == 0 and s == "beta")} == gone
    ready = {(r["event_id"], r["source"]) for r in evaluated.filter("k = 1 AND complete").collect()}
    assert ready == {(i, s) for i in range(60) for s in P.GENERATED if i < 3 or (i - 3, s) not in gone}
