"""Scalars, labels, gates, constraints, question blocks, JSON recovery and prompts."""

import json

import pytest
from pyspark.sql import functions as F

from plotline.functions import json_recovery as J
from plotline.functions import labels as L
from plotline.functions import scalars as S
from plotline.functions import text as X
from plotline.operators import answering as N
from plotline.operators import audits as U
from plotline.operators import constraints as C
from plotline.operators import gates as G
from plotline.operators import release as E
from plotline.operators import similarity as V


def _map(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_text_normalisers(spark):
    assert _map(spark, ["  It’s “fine”\r\n now ", None], X.normalize_text) == ['It\'s "fine" now', ""]
    assert _map(spark, ["The Dog's  Bowl", "éa's"], X.lookup_key) == ["thedogbowl", "as"]
    assert _map(spark, ["person1 OPENED it's door", ""], X.tokens) == [["person", "opened", "it's", "door"], []]
    toks = X.tokens(F.col("v"))
    got = spark.createDataFrame([("The waiter opened a green door walking home",)], "v string").select(
        X.people(toks).alias("p"), X.locations(toks).alias("l"), X.actions(toks).alias("a"), X.objects(toks).alias("o")).first()
    assert (got["p"], got["l"], got["a"], got["o"]) == (["waiter"], ["door"], ["opened", "walking"], ["green", "home"])


def test_scalars(spark):
    assert _map(spark, ["1.5", " 2 ", "", "x", "1_0", None, "-.5e1"], S.safe_double) == [1.5, 2.0, None, None, None, None, -5.0]
    assert _map(spark, ["Yes", "reject", "maybe", None, ""], S.loose_bool) == [True, False, False, False, False]
    assert _map(spark, ["keep", "No", None, "maybe"], S.truthy_bool) == [True, False, False, True]
    assert _map(spark, ["score -0.7 ok", "none", None], S.loose_double) == [-0.7, 0.0, 0.0]
    assert _map(spark, ["-0.7"], lambda c: S.loose_double(c, signed=False)) == [0.7]
    assert _map(spark, ["1.4", "-1", "0.3", "n/a"], S.score) == [1.0, 0.0, 0.3, None]
    assert _map(spark, [3661.0625, 0.0005, 0.0015], S.clock, "double") == ["01.01.01.062", "00.00.00.000", "00.00.00.002"]
    times = _map(spark, ["1005_Signs__225p1_227p561", "m__1p0_x_2p5", "plain", "m__a_b_c"], S.clip_times)
    assert [tuple(t) for t in times] == [("225.1", "227.561"), ("1.0", "2.5"), ("", ""), ("", "")]


def test_labels(spark):
    assert _map(spark, ["emotion_driven", "nope", None, " dialogue_cue "], L.evidence_type) == ["emotional_cue", "other", "other", "dialogue_cue"]
    assert _map(spark, [["spatial_setup", "x"], [], None], L.reasoning_types, "array<string>") == [["physical_precondition", "other"], ["other"], ["other"]]
    assert _map(spark, ["state_change", "what_happens_next", "odd"], lambda c: L.question_type(c, F.lit("object_reveal"))) == [
        "what_changes_next", "what_happens_next", "what_is_revealed_next"]
    derive = lambda r: L.continuity_type(F.lit("bad"), r)
    assert _map(spark, [["scene_script"], ["intent_driven"], ["dialogue_grounded"], ["other"]], derive, "array<string>") == [
        "continuous_physical", "continuous_social", "dialogue_continuous", "discontinuous_unpredictable"]
    kind = "array<struct<clip_id:string,span:string,evidence_type:string>>"
    assert _map(spark, [None, [None, ("c", "s", "emotion_cue")]], L.evidence_rows, kind)[0] == []


CANDIDATE = ("v_keep string, v_confidence string, v_sufficiency string, v_distractor string, sufficiency string, failure_reasons array<string>, target_type string, "
             "target_triviality string, predictability string, evidence array<string>, evidence_clip_ids array<string>, expectedness double, continuity_type string")


def _candidate(**changes):
    row = dict(v_keep="keep", v_confidence=".95", v_sufficiency="0.92", v_distractor="0.88", sufficiency="0.76", failure_reasons=[], target_type="state_change",
               target_triviality="nontrivial", predictability="predictable", evidence=["e"], evidence_clip_ids=["c"], expectedness=0.5, continuity_type="continuous_physical")
    row.update(changes)
    return tuple(row.values())


def test_gate_and_positive_fill(spark):
    rows = spark.createDataFrame([
        _candidate(v_confidence="0.95"), _candidate(v_confidence=None, v_sufficiency=None, v_distractor=None),
        _candidate(v_confidence=None, failure_reasons=["multi_answer"]), _candidate(predictability="unpredictable"), _candidate(v_keep="no"),
        _candidate(v_keep="no", continuity_type="scene_cut_semantically_linked")], CANDIDATE)
    scored = G.validation_scores(rows).withColumn("route", G.gate_route(G.main_gate()))
    got = [(r["route"], r["qwen_confidence"], r["evidence_sufficiency"], r["distractor_quality"]) for r in scored.collect()]
    assert got[0] == ("kept", 0.95, 0.92, 0.88) and got[1] == ("kept", 0.7, 0.76, 0.7) and got[2][:2] == ("rejected", 0.0)
    assert [g[0] for g in got[3:]] == ["challenge", "rejected", "challenge"]


@pytest.mark.parametrize("limit,kept", [(0, 0), (2, 2), (9, 5)])
def test_kept_cap(spark, limit, kept):
    rows = spark.range(8).select("id", F.when(F.col("id") % 3 != 2, "kept").otherwise("challenge").alias("route"), F.array().cast("array<string>").alias("failure_reasons"))
    rows = rows.filter("id <> 7").repartition(3)
    capped = G.kept_cap(rows, limit, ["id"]).orderBy("id").collect()
    assert sum(r["route"] == "kept" for r in capped) == kept
    over = [r for r in capped if r["failure_reasons"]]
    assert len(over) == 5 - kept and all(r["route"] == "rejected" and r["failure_reasons"] == [G.OVERFLOW_REASON] for r in over)


def test_kept_cap_can_route_the_overflow(spark):
    rows = spark.createDataFrame([(1, "kept", "predictable"), (2, "kept", "underdetermined"), (3, "kept", "predictable")], "id int, route string, predictability string")
    rows = rows.withColumns({"failure_reasons": F.array().cast("array<string>"), "continuity_type": F.lit("x"), "target_triviality": F.lit("nontrivial")})
    got = [r["route"] for r in G.kept_cap(rows, 1, ["id"], overflow_to="route").orderBy("id").collect()]
    assert got == ["kept", "challenge", "rejected"]


def test_quarantine(spark):
    texts = ["fine", "a\nAPI_KEY: x", "todo(author) api_key: x", "/Users/me and secret_key", None]
    assert _map(spark, texts, G.quarantine_reason) == [
        None, "matched private/secret pattern 'api_key:'", None, "matched private/secret pattern '/users/'", None]


PUBLIC = {
    "id": "x", "movie": "m", "target_clip_id": "c3", "target_sentence": "He leaves.", "context_clip_ids": ["c1", "c2"], "context_sentences": ["A.", "B."],
    "question_type": "what_happens_next", "question": "What happens next?", "options": ["a", "b", "c", "d"], "predictability": "predictable",
    "expectedness": None, "target_type": "state_change", "evidence_clip_ids": ["c1"],
}
PRIVATE = PUBLIC | {"answer_idx": 1, "answer_text": "b", "split": "train_private",
                    "answer_source": {"source": "target_sentence", "target_clip_id": "c3", "target_sentence": "He leaves."}}
RELEASE = {"id": "x", "source_id": "m", "prior_context": [{"clip_id": "c1", "text": "A."}], "question": "Q?", "options": ["a", "b", "c", "d"],
           "question_type": "what_happens_next", "target_type": "state_change", "context_length": 1, "expectedness": 0.5}
INTERNAL = PUBLIC | {
    "answer_idx": 1, "answer_text": "b", "selection_metadata": {}, "validation_metadata": {}, "distractor_metadata": ["unrelated", "correct", "unrelated", "unrelated"],
    "continuity_type": "continuous_physical", "context": [], "target": None, "evidence": [{"clip_id": "c1", "span": "A", "evidence_type": "other"}],
    "quality": {"qwen_confidence": 0.9, "evidence_sufficiency": 1, "distractor_quality": 0.8, "should_keep": True}, "continuity_scores": {},
    "semantic_similarity_last": 0.1, "semantic_similarity_mean": 0.1, "entity_overlap": 0, "action_overlap": 0.0, "location_overlap": 0.0, "timestamp_gap": None,
    "selected_window_size": 2, "context_selection_strategy": "s", "full_prior_context_clip_ids": [], "selected_context_clip_ids": [], "rejection_reason": None,
    "reasoning_type": ["other"],
}


def _without(row, key):
    return {k: v for k, v in row.items() if k != key}


@pytest.mark.parametrize("schema,row,errors", [
    ("legacy_public", PUBLIC, []),
    ("legacy_public", PUBLIC | {"track": None, "expectedness": 1.2}, ["expectedness must be in [0.0, 1.0]", "track must not be present"]),
    ("legacy_public", PUBLIC | {"expectedness": True, "movie": 3}, ["movie must be non-empty string", "expectedness must be numeric or null"]),
    ("legacy_public", _without(PUBLIC, "expectedness") | {"movie": "", "answer_idx": 1},
     ["missing top-level key: expectedness", "public example must not contain answer key"]),
    ("legacy_public", PUBLIC | {"split": "train"}, ["public split must end with _public"]),
    ("private", PRIVATE, []),
    ("private", _without(PRIVATE, "answer_source"), ["missing top-level key: answer_source"]),
    ("private", PRIVATE | {"answer_idx": 4, "answer_source": {"source": "x", "target_clip_id": "c3", "target_sentence": "He leaves."}},
     ["answer_idx must be in [0, 3]", "answer_source.source must be target_sentence"]),
    ("public", RELEASE, []),
    ("public", RELEASE | {"answer_text": "a"}, ["public example must not contain answer_text"]),
    ("public", RELEASE | {"context_length": 1.5}, ["context_length must be a non-negative integer"]),
    ("public", RELEASE | {"prior_context": ["c"], "options": ["a", " ", "c", "d"]}, ["each prior_context item must be an object", "each option must be a non-empty string"]),
    ("with_answers", RELEASE | {"answer_idx": 1, "answer_text": "b", "hidden_target_ad": "t", "evidence": []}, []),
    ("with_answers", RELEASE | {"answer_idx": 1, "answer_text": "a", "hidden_target_ad": "", "evidence": [{"clip_id": "c"}]},
     ["answer_text must match options[answer_idx]", "hidden_target_ad must be non-empty string when present", "each evidence item must have non-empty span"]),
    ("with_answers", RELEASE | {"answer_idx": 1}, ["missing top-level key: answer_text"]),
    ("internal", INTERNAL, []),
    ("internal", _without(INTERNAL, "selection_metadata") | {"answer_text": "z"}, ["answer_text must match options[answer_idx]", "missing top-level key: selection_metadata"]),
    ("internal", INTERNAL | {"distractor_metadata": ["correct", "odd", "unrelated", "unrelated"], "reasoning_type": ["other", "x"], "quality": {"should_keep": 1}},
     ["invalid distractor type: odd", "correct answer must be labeled correct in distractor metadata", "invalid reasoning_type: x", "quality.qwen_confidence must be numeric",
      "quality.evidence_sufficiency must be numeric", "quality.distractor_quality must be numeric", "quality.should_keep must be boolean"]),
])
def test_constraints(spark, schema, row, errors):
    rows = spark.createDataFrame([(json.dumps(row),)], "json string")
    assert C.check(rows, schema).first()["errors"] == errors


def test_inferred_schema_and_strict_check(spark):
    rows = spark.createDataFrame([(json.dumps(r),) for r in (RELEASE, RELEASE | {"answer_idx": 1}, INTERNAL, PRIVATE, PUBLIC)], "json string")
    got = [r[0] for r in rows.select(C.inferred_schema(F.try_parse_json("json"))).collect()]
    assert got == ["public", "with_answers", "internal", "private", "public"]
    assert C.require_valid(rows.limit(1), "public").count() == 1
    with pytest.raises(Exception, match="export failed validation"):
        C.require_valid(rows, "public").collect()


def test_json_recovery(spark):
    texts = ['```json\n{"answer":"A","ok":true}\n```', 'noise {"bad": } more noise {"answer":"B","score":0.9}', "none", "  ", None, '[1] {"a": "}{\\"", "b": {"c": 1}} tail',
             'say "{" then {"x": 1}', "} {", '{"n": 1}{"longer": 2}', '{"a": "' + "x" * 5000 + '"}']
    got = [None if t is None else json.loads(t) for t in _map(spark, texts, J.recovered_object)]
    assert got[:9] == [{"answer": "A", "ok": True}, {"answer": "B", "score": 0.9}, None, None, None, {"a": '}{"', "b": {"c": 1}}, {"x": 1}, None, {"longer": 2}]
    assert len(got[9]["a"]) == 5000
    assert _map(spark, texts[1:5], J.recovery_error) == [None, "no JSON object found in model output", "empty model output", "empty model output"]
    assert _map(spark, ['{"a": }'], J.recovery_error) == ["failed to parse model JSON"]


def test_option_order_maps_back(spark):
    rows = spark.createDataFrame([("i", ["a", "b", "c", "d"], [2, 0, 3, 1])], "id string, options array<string>, option_order array<int>")
    p = rows.select(N.normalize_prediction(F.lit("1"), F.lit(None).cast("string"), F.col("options"), F.col("option_order")).alias("p")).first()["p"]
    assert (p["prediction_idx"], p["prediction_text"], p["displayed_idx"]) == (0, "a", 1)
    p = rows.select(N.normalize_prediction(F.lit("7"), F.lit(" D "), F.col("options"), F.col("option_order")).alias("p")).first()["p"]
    assert (p["prediction_idx"], p["displayed_idx"]) == (3, 2)
    ids = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.array(*[F.lit(x) for x in "abcd"]).alias("o"))
    firsts = ids.select(N.option_order(F.col("id"), F.col("o"))[0].alias("f")).groupBy("f").count().collect()
    assert len(firsts) == 4 and all(380 < r["count"] < 620 for r in firsts)


def test_answer_index_forms(spark):
    opts = F.array(*[F.lit(x) for x in ("red", "blue", "12", "d")])
    none = F.lit(None).cast("string")
    cases = [("2", None, None, 2), ("b", None, None, 1), (" blue ", None, None, 1), ("9", "A", None, None), ("E", "C", None, 2), (None, "zz", "red", 0), (None, None, None, None)]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, v string, a string, t string")
    got = [r[0] for r in rows.orderBy("i").select(E.answer_index(F.col("v"), opts, F.col("a"), F.col("t"))).collect()]
    assert got == [c[3] for c in cases] and none is not None


def test_release_context_must_align(spark):
    rows = spark.createDataFrame([(["a"], ["x", "y"])], "i array<string>, t array<string>")
    with pytest.raises(Exception, match="do not align"):
        rows.select(E.prior_context(F.col("i"), F.col("t"))).collect()


def test_overlaps_and_similarity(spark):
    pairs = spark.createDataFrame([(1, "dog runs", "dog sits"), (2, "", "dog"), (3, "dog dog", "dog dog")], "id int, l string, r string")
    got = {r["id"]: r["similarity"] for r in V.tfidf_cosine(pairs, ["id"], "l", "r").collect()}
    idf = 1.69314718056
    assert got[1] == pytest.approx(1 / (1 + idf * idf)) and got[2] == 0.0 and got[3] == pytest.approx(1.0)
    row = spark.range(1).select(V.text_overlap(F.lit("the red dog"), F.lit("red dogs bark")), V.overlap_ratio(F.array(F.lit("a")), F.array().cast("array<string>"))).first()
    assert tuple(row) == (0.5, 0.0)


def test_contained_items_of_every_length(spark):
    items = ["one two three four five six seven eight nine ten eleven", "uno dos tres cuatro", "solo dúo", "zig", "never there at all in any of the given texts today"]
    texts = ["x" + items[0] + "y and so on", items[0].replace("six", "6"), "(uno dos tres cuatro)", "presolo dúos", "zigzag " + items[1], "uno  dos tres cuatro"]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    want = {(a, b) for a, x in enumerate(texts) for b, y in enumerate(items) if y in x}
    assert {tuple(r) for r in U.contained_items(t, i, "doc_id", "item_id").collect()} == want
    assert U.contained_items(t, i.filter("item_id < 0"), "doc_id", "item_id").count() == 0


def test_contained_items_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab  ") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    items = [t[i:i + rng.randint(1, 30)] for t in texts if len(t) > 2 for i in [rng.randrange(len(t) - 1)]] + ["", " ", "ba" * 9]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    want = {(a, b) for a, x in enumerate(texts) for b, y in enumerate(items) if y and y in x}
    assert {tuple(r) for r in U.contained_items(t, i, "doc_id", "item_id", gram=3).collect()} == want


def test_similarity_falls_back_to_text(spark):
    pairs = spark.createDataFrame([(1, "a dog", "a dog", [1.0, 0.0], [0.0, 2.0]), (2, "red dog", "red dog", None, [1.0])],
                                  "id int, l string, r string, lv array<double>, rv array<double>")
    got = {r["id"]: (round(r["similarity"], 6), r["backend"]) for r in V.semantic_similarity(pairs, ["id"], "l", "r", "lv", "rv").collect()}
    assert got == {1: (0.0, "vectors"), 2: (1.0, "tfidf_fallback")}


def test_sensitive_lines(spark):
    text = "ok\nPattern( a@b.co )\nwrite to me@site.org now\nsee github.com/huggingface and github.com/someone"
    got = spark.createDataFrame([(text,)], "t string").select(U.sensitive_findings(F.col("t"))).first()[0]
    assert [(f["label"], f["line"]) for f in got] == [("email", 3), ("personal github/hf name", 4)]
