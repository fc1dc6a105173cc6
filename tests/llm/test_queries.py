"""Registered queries against their SQL, over whole tables, and the pipeline."""

import pytest
from compare import differences

import __spark_entry__ as entry
import corpus_pipeline
from llm import exact, jaccard, language, mix, pack
from llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) <= set(names) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert differences(spark, QUERIES[name], ORACLES[name], SF) is None


def test_pipeline_is_its_stages(spark):
    """Each stage does what its operator does, on all that the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = docs.join(language.identify(docs).where("not rejected").select("doc_id"), "doc_id").select(*docs.columns)
    assert ids(corpus_pipeline.language_id(spark, docs, SF)) == ids(kept)
    once = kept.join(exact.groups(kept).where("kept").select("doc_id"), "doc_id").select(*docs.columns)
    assert ids(corpus_pipeline.exact_dedup(spark, kept, SF)) == ids(once)
    apart = once.join(jaccard.join(once).where("kept").select("doc_id"), "doc_id").select(*docs.columns)
    assert ids(corpus_pipeline.near_dedup(spark, once, SF)) == ids(apart)
    copies = {r.doc_id: r.copies for r in mix.plan(apart).collect()}
    assert ids(corpus_pipeline.mix_sources(spark, apart, SF)) == sorted(i for i, n in copies.items() for _ in range(n))
    pieces = [(r.doc_id, r.piece) for r in pack.tokenised(apart).collect()]
    want = sorted(p for p in pieces for _ in range(copies[p[0]]))
    assert sorted((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_pipeline_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
