"""Order, blocks, contexts, walk and selection on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from plotline.operators import ordering as R
from plotline.operators import selection as P
from plotline.operators import sequence as Q
from plotline.operators import walk as W

CLIPS = [
    (m.upper(), f"{m[-1]}{i}", f"{2 * i - 2}.0", f"{2 * i}.0", f"Somebody does thing number {i} in the house.", i - 1)
    for m in ("movieA".lower(), "movieB".lower()) for i in range(1, 5)
]
SCHEMA = "movie string, clip_id string, timestamp_start string, timestamp_end string, text string, sequence_index long"


@pytest.fixture(scope="module")
def clips(spark):
    return spark.createDataFrame(CLIPS, SCHEMA)


def test_blocks_stay_inside_a_sequence(clips):
    blocks = Q.search_blocks(Q.order_clips(clips), 3).orderBy("movie", "block_start").collect()
    assert len(blocks) == 8
    assert [c["clip_id"] for c in blocks[0]["clips"]] == ["a1", "a2", "a3"]
    assert [c["clip_id"] for c in blocks[4]["clips"]] == ["b1", "b2", "b3"]
    assert (blocks[0]["block_start"], blocks[0]["block_end"]) == (0, 2)
    assert blocks[3]["block_id"].endswith("::block::00003_00003::w3")


def test_short_blocks_are_dropped(spark):
    rows = spark.createDataFrame([("m", "c1", "0", "1", "Hi.", 0), ("m", "c2", "1", "2", "A long enough sentence.", 1), ("m", "c3", "2", "3", "Oh.", 2)], SCHEMA)
    starts = [r[0] for r in Q.search_blocks(Q.order_clips(rows), 2).select("block_start").orderBy("block_start").collect()]
    assert starts == [0, 1]


def test_unparsable_start_sorts_last_then_row_number_then_id(spark):
    rows = spark.createDataFrame([
        ("m", "z", None, None, "t", 0), ("m", "y", "10", None, "t", 1), ("m", "x", "9.5", None, "t", 2), ("m", "w", "abc", None, "t", 3),
        ("m", "v", "9.5", None, "t", 2)], SCHEMA)
    got = [r[0] for r in Q.order_clips(rows).orderBy("pos").select("clip_id").collect()]
    assert got == ["v", "x", "y", "z", "w"]


def test_last_k_and_strictly_prior(spark):
    base = spark.range(1)
    clip = lambda i: F.struct(F.lit(f"c{i}").alias("clip_id"), F.lit(i).cast("bigint").alias("sequence_index"))
    rows = base.select(F.array(*[clip(i) for i in range(4)]).alias("prior"), F.array(clip(1), clip(3), clip(4)).alias("context"))
    ids = lambda c: F.transform(c, lambda x: x["clip_id"])
    got = rows.select(
        ids(Q.last_k(F.col("prior"), 2)).alias("two"), ids(Q.last_k(F.col("prior"), 9)).alias("nine"), ids(Q.last_k(F.col("prior"), 0)).alias("none"),
        ids(Q.strictly_prior(F.col("context"), F.lit(3))).alias("strict"), ids(Q.strictly_prior(F.col("context"), F.lit(None))).alias("all")).first()
    assert got["two"] == ["c2", "c3"] and got["nine"] == ["c0", "c1", "c2", "c3"] and got["none"] == []
    assert got["strict"] == ["c1"] and got["all"] == ["c1", "c3", "c4"]


def test_contexts_of_examples(spark, clips):
    ordered = Q.order_clips(clips)
    examples = spark.createDataFrame([("e1", "MOVIEA", "a3", None), ("e2", "MOVIEB", "nowhere", 3), ("e3", "MOVIEA", "a1", 0)],
                                     "id string, movie string, target_clip_id string, target_index long")
    got = {r["id"]: [c["clip_id"] for c in r["prior"]] for r in Q.contexts_of(examples, ordered, 2).collect()}
    assert got == {"e1": ["a1", "a2"], "e2": ["b2", "b3"], "e3": []}
    lost = spark.createDataFrame([("e1", "MOVIEA", "b1", None)], examples.schema)
    with pytest.raises(Exception, match="could not locate target"):
        Q.contexts_of(lost, ordered, 2).collect()


def _naive_walk(steps):
    out = {}
    for movie, by_start in steps.items():
        at, seen = min(by_start), []
        while at in by_start:
            seen.append(at)
            at += by_start[at]
        out[movie] = seen
    return out


@pytest.mark.parametrize("chunk", [4, 5, 256])
def test_walk_equals_the_sequential_rule(spark, chunk):
    rng = random.Random(chunk)
    steps = {}
    for m in range(12):
        first = rng.choice([0, 0, 1, 7])
        length = rng.choice([1, 3, 9, 60, 150])
        steps[f"m{m}"] = {first + i: rng.randint(1, 4) for i in range(length) if rng.random() > (0.0 if m % 2 else 0.02) or i == 0}
    rows = [(m, s, k) for m, by in steps.items() for s, k in by.items()]
    df = spark.createDataFrame(rows, "movie string, block_start long, step long").repartition(3)
    longest = max(max(by) for by in steps.values()) + 1
    got = {}
    for r in W.walk(df, 4, longest, chunk=chunk).collect():
        got.setdefault(r["movie"], []).append(r["block_start"])
    assert {m: sorted(v) for m, v in got.items()} == _naive_walk(steps)


@pytest.mark.parametrize("budget", [0, 1, 5, 17, 1000])
def test_walk_budget_equals_the_sequential_rule(spark, budget):
    rng = random.Random(7)
    rows = [(f"m{m}", s, rng.randint(1, 3), rng.random() > 0.2) for m in range(6) for s in range(rng.randint(1, 14))]
    want, calls = set(), 0
    for m in sorted({r[0] for r in rows}):
        by = {s: (k, c) for mm, s, k, c in rows if mm == m}
        at = min(by)
        while at in by:
            step, called = by[at]
            used = calls < budget
            want.add((m, at, used and called))
            if used and called:
                calls += 1
            at += step if used and called else 1  # a call that did not come back gives the default decision
    df = spark.createDataFrame(rows, "movie string, block_start long, step long, called boolean")
    got = {tuple(r) for r in W.walk_with_budget(df, 3, 14, budget, chunk=4).select("movie", "block_start", "used").collect()}
    assert got == want


def test_hot_sequence_paths_equal_plain_windows(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("m"), (F.col("id") % 50).cast("string"))).alias("g"),
        ((F.col("id") * 7919) % 997).alias("a"), F.col("id").alias("b"))
    plain = R.positions(rows, ["g"], ["a", "b"])
    hot = R.positions(rows, ["g"], ["a", "b"], hot_rows=100)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, hot.select(*plain.columns).collect()))
    make = {"prev": lambda w: F.collect_list("b").over(w.rowsBetween(-3, -1)), "next": lambda w: F.lead("b").over(w)}
    one = R.neighbour_columns(plain, ["g"], "pos", make, 3, 1, longest=10)
    two = R.neighbour_columns(plain, ["g"], "pos", make, 3, 1, longest=10**9, chunk=16)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.select(*one.columns).collect()))
    ranks = R.global_rank(rows, ["a", "b"]).orderBy("a", "b").select("rank").collect()
    assert [r[0] for r in ranks] == list(range(3000))


def test_median_on_both_paths(spark):
    for n in (101, 100):
        rows = spark.range(n).select((F.col("id") * 37 % n).cast("double").alias("v"))
        assert R.exact_median(rows, "v") == R.exact_median(rows, "v", few_values=10) == (n - 1) / 2


BLOCK = """block_id string, movie string, block_start long, clips array<struct<clip_id:string,sequence_index:long,timestamp_start:string,timestamp_end:string,text:string>>,
    found_valid_target string, target_clip_id string, target_position int, target_type string, target_triviality string, predictability string,
    continuity_type string, reasoning_type array<string>, evidence_sufficiency string, selected_context_clip_ids array<string>,
    selected_context_spans array<struct<clip_id:string,span:string,evidence_type:string>>, evidence_clip_ids array<string>"""
TEXTS = ["A man walks to the locked door.", "He takes a key from his pocket.", "The door swings open.", "A dog runs out.", "It barks.", "Night falls."]


def _block(start, **changes):
    clips = [(f"a{i + 1}", i, f"{i}.0", f"{i + 1}.0", TEXTS[i]) for i in range(start, min(start + 3, 6))]
    row = dict(
        block_id=f"b{start}", movie="m", block_start=start, clips=clips, found_valid_target="true", target_clip_id=f"a{start + 3}", target_position=3,
        target_type="state_change", target_triviality="nontrivial", predictability="predictable", continuity_type="continuous_physical",
        reasoning_type=["physical_precondition"], evidence_sufficiency="0.9", selected_context_clip_ids=[f"a{start + 1}"],
        selected_context_spans=[(f"a{start + 2}", TEXTS[start + 1].split()[-1] if start < 5 else "x", "physical_precondition")],
        evidence_clip_ids=[f"a{start + 2}"])
    row.update(changes)
    return row


def _materialize(spark, *rows):
    names = ["block_id", "movie", "block_start", "clips", "found_valid_target", "target_clip_id", "target_position", "target_type", "target_triviality",
             "predictability", "continuity_type", "reasoning_type", "evidence_sufficiency", "selected_context_clip_ids", "selected_context_spans",
             "evidence_clip_ids"]
    return P.materialize(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], BLOCK), 0.7)


def test_walk_advances_past_the_target_and_merges_evidence(spark):
    rows = _materialize(spark, *[_block(s) for s in range(4)])
    first = rows.filter("block_start = 0").first()
    assert first["route"] == "selected"
    assert first["selected_context_clip_ids"] == ["a1", "a2"] and first["evidence_clip_ids"] == ["a2"]
    steps = rows.select("movie", "block_start", W.step_of(F.col("found"), F.col("target_position")).alias("step"))
    assert sorted(r["block_start"] for r in W.walk(steps, 3, 4).collect()) == [0, 3]


@pytest.mark.parametrize("changes,route,reason", [
    ({"target_triviality": "trivial_static_state"}, "rejected", "trivial_target"),
    ({"target_triviality": "meaningful_but_noninferable"}, "challenge", "meaningful_but_noninferable"),
    ({"predictability": None}, "selected", None),
    ({"predictability": "underdetermined"}, "challenge", "underdetermined"),
    ({"predictability": "unpredictable"}, "rejected", "insufficient_buildup"),
    ({"target_clip_id": "nowhere"}, "rejected", "no_valid_target"),
    ({"target_type": "dance"}, "rejected", "invalid_target"),
    ({"evidence_sufficiency": "-0.9"}, "selected", None),
    ({"evidence_sufficiency": "0.5"}, "rejected", "insufficient_buildup"),
    ({"selected_context_spans": [("a2", "not there", "other")]}, "rejected", "insufficient_buildup"),
    ({"found_valid_target": "perhaps"}, "selected", None),
])
def test_routes(spark, changes, route, reason):
    row = _materialize(spark, _block(0, **changes)).first()
    assert (row["route"], row["rejection_reason"]) == (route, reason)


def test_pronoun_target_needs_the_clip_before_it(spark):
    row = _block(0, target_clip_id=None, target_position=2, selected_context_clip_ids=[], evidence_clip_ids=[], selected_context_spans=[("a1", "door", "other")])
    assert _materialize(spark, row).first()["route"] == "selected"
    clips = [(f"a{i + 1}", i, None, None, t) for i, t in enumerate(["The hall is dark.", "A lamp is lit.", "He smiles."])]
    far = _block(0, clips=clips, selected_context_spans=[("a1", "dark", "other")], selected_context_clip_ids=[])
    assert _materialize(spark, far).first()["route"] == "rejected"


def test_last_k_counts_by_number_and_first_match_wins(spark):
    from plotline.operators import sequence as Q

    clips = spark.createDataFrame([("m", "c5", "0", 5), ("m", "c1", "1", 1), ("m", "c7", "2", 7), ("m", "c9", "3", 9), ("m", "c7", "4", 11)],
                                  "movie string, clip_id string, timestamp_start string, sequence_index long").selectExpr("*", "'' AS timestamp_end", "clip_id AS text")
    ordered = Q.order_clips(clips)
    examples = spark.createDataFrame([("a", "m", None, 5), ("b", "m", "c7", None), ("c", "m", None, 9)], "id string, movie string, target_clip_id string, target_index long")
    got = {r["id"]: [c["sequence_index"] for c in r["prior"]] for r in Q.contexts_of(examples, ordered, 2).collect()}
    assert got == {"a": [1], "b": [1, 5], "c": [5, 7]}


def test_both_walks_refuse_the_same_steps(spark):
    import pytest

    from plotline.operators import walk as W

    for step, longest in ((6, 100), (0, 100), (1, 30)):
        blocks = spark.createDataFrame([("m", i, step if i == 5 else 1) for i in range(40)], "movie string, block_start long, step long")
        for chunk in (64, 4):
            with pytest.raises(Exception, match="outside 1..4|longer than"):
                W.walk(blocks, 4, longest, chunk=chunk).collect()


def test_a_call_that_did_not_come_back_moves_on_by_one(spark):
    from plotline.operators import walk as W

    blocks = spark.createDataFrame([("m", 0, 3, False), ("m", 1, 2, True), ("m", 2, 1, True), ("m", 3, 1, True)], "movie string, block_start long, step long, called boolean")
    got = {(r["block_start"], r["used"]) for r in W.walk_with_budget(blocks, 4, 4, 5).collect()}
    assert got == {(0, False), (1, True), (3, True)}


def test_only_hot_groups_take_the_range_plan(spark, monkeypatch):
    """One hot and many short groups: the checkpoint holds rows of the hot one only."""
    from plotline.operators import ordering

    rows = spark.range(400).select(F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("m"), (F.col("id") % 40).cast("string"))).alias("g"), ((F.col("id") * 37) % 401).alias("a"))
    kept = []
    durable = ordering.durable
    monkeypatch.setattr(ordering, "durable", lambda df: kept.append(durable(df)) or kept[-1])
    got = ordering.positions(rows, ["g"], ["a"], "pos", 200, 50)
    plain = ordering.positions(rows, ["g"], ["a"], "pos", 200, 1000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert len(kept) == 1 and {r["g"] for r in kept[0].select("g").distinct().collect()} == {"hot"}
