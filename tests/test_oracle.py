"""Every registered query against its SQL, over whole tables."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from plotline.plans import load

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"manifest_files", "near_paraphrases"}
#: The library's own queries; those of the llm subpackage have tests of their own.
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    query, sql = QUERIES[name], SQL.get(name)
    if sql is None:
        assert query(spark, SF).count() > 0
    else:
        assert differences(spark, query, sql, SF, con) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 15


HOT = ["walk_over_gaps", "clip_order", "search_blocks", "last_k_context", "target_walk", "walk_budget", "verbatim_options", "context_materialize", "context_gain", "group_split",
       "selection_route", "leak_audit"]


@pytest.mark.parametrize("name", HOT)
def test_query_when_every_group_counts_as_hot(spark, con, name):
    settings = {"spark.plotline.hotGroupRows": "2", "spark.plotline.chunkRows": "3", "spark.plotline.walkStarts": "4"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        assert differences(spark, QUERIES[name], SQL[name], SF, con) is None
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_planted_faults_are_found(spark):
    """Queries whose faults are planted give each outcome at least once."""
    found = {name: QUERIES[name](spark, SF).collect() for name in ("leak_audit", "resume_pending", "question_block", "expectedness_enriched", "release_constraints", "quarantine", "context_eval")}
    assert all(r["violations"] > 0 for r in found["leak_audit"]) and len(found["leak_audit"]) == 8
    assert found["resume_pending"]
    assert {r["error"] is None for r in found["question_block"]} == {True, False}
    assert {r["expectedness_warning"] is None for r in found["expectedness_enriched"]} == {True, False}
    assert any("answer_idx" in r["errors"] for r in found["release_constraints"])
    assert len({r["reason"] for r in found["quarantine"]}) == 6
    assert len(found["context_eval"]) == 13 and all(r["num_unmatched"] > 0 for r in found["context_eval"] if r["source"] == "beta")
