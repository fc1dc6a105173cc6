"""Language-model scores and language identification, against brute force and held-out documents."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm import language, suffix_tree
from llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tree_by_hand(texts, depth=suffix_tree.DEPTH):
    """Pairs of all depths, retained contexts, and a function for log10 P(text)."""
    spell = lambda w: b"".join(x.encode() + b" " for x in w) + b"\n"
    counts = [defaultdict(Counter) for _ in range(depth + 1)]
    for w in texts:
        s = b"\n" * depth + spell(w)
        for k in range(depth, len(s)):
            for d in range(depth + 1):
                counts[d][s[k - d : k]][s[k]] += 1
    keep = set()
    for d in range(depth, 0, -1):
        for context, nxt in counts[d].items():
            n, lower = sum(nxt.values()), counts[d - 1][context[1:]]
            gain = sum(c * math.log(c / n / (lower[x] / sum(lower.values()))) for x, c in nxt.items())
            if gain > suffix_tree.PENALTY * len(nxt) * math.log(n + 1):
                keep |= {context[k:] for k in range(d)}

    def probability(context, x):
        if not context:
            return (counts[0][b""][x] + 1) / (sum(counts[0][b""].values()) + suffix_tree.SYMBOLS)
        lower = probability(context[1:], x)
        if context not in keep:
            return lower
        nxt = counts[len(context)][context]
        return (nxt[x] + len(nxt) * lower) / (sum(nxt.values()) + len(nxt))

    def score(w):
        s = b"\n" * depth + spell(w)
        return sum(math.log10(probability(s[k - depth : k], s[k])) for k in range(depth, len(s)))

    return score


def held(i, folds, fold):
    return i is not None and zlib.crc32(str(i).encode()) % folds == fold


@pytest.mark.parametrize("limit", [suffix_tree.LIMIT, 2000])
def test_scores(docs, awkward, limit):
    rows = [(i, held(i, 7, 2), WORD.findall((t or "").translate(LOWER))) for i, t, *_ in awkward]
    train = [w for _, h, w in rows if not h]
    count = Counter(x for w in train for x in w)
    total, kinds = sum(count.values()) + len(train), len(count) + 1
    base = lambda c: math.log10((c + 1) / (total + kinds + 1))
    by_hand = tree_by_hand(train)
    order = lambda g: str(g[:5])
    want = sorted(((i, h, len(w) + 1, sum(x in count for x in w) + 1, total, sum(base(count[x]) for x in w) + base(len(train)), by_hand(w)) for i, h, w in rows), key=order)
    got = sorted(map(tuple, suffix_tree.score(docs, limit).collect()), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-4)


def test_scores_of_held_out_documents(spark):
    """With a few megabytes of training text the tree is close to the baseline, which does not sum to one over unknown words."""
    rows = QUERIES["op3_suffix_tree_score"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens - 0.2


def test_nothing_to_score_or_learn(nothing, docs):
    assert suffix_tree.score(nothing).collect() == []
    only = docs.where("doc_id = 1")
    assert held(1, 7, 2) or suffix_tree.score(only).count() == 1


def test_language(docs, awkward):
    got = {}
    for r in language.identify(docs).collect():
        got.setdefault(r.doc_id, r)
    for i, t, *_ in awkward:
        if i == 20:
            continue
        r = got[i]
        assert r.held_out == held(i, 4, 2)
        has_letter = t is not None and any(c.isalpha() for c in t)
        assert (r.lang_pred == "und") == (not has_letter)
        assert 0 <= r.score <= 1
        assert has_letter or r.rejected


def test_language_without_labels(docs, nothing):
    from pyspark.sql import functions as F

    assert language.identify(nothing).collect() == []
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.accepted(nothing).collect() == []


@pytest.mark.parametrize("number", [None, 4])
def test_language_whatever_the_ids(spark, number):
    """All ids null or equal: every language is learned, from as many distinct texts as asked for, copies counted once."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("doc_id", F.lit(number).cast("long"))
    hot = docs.where("lang is not null").orderBy(F.length("text").desc()).limit(1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(500)))).select(*docs.columns)
    both = docs.unionByName(hot)
    model = language.fit(both, sample=60)
    names = {r.lang for r in docs.where("lang is not null").select("lang").distinct().collect()}
    assert set(model.languages) == names
    rows = language.predict(docs, model).select("lang_pred").count()
    assert rows == docs.count()
    got = docs.select("lang", "text").distinct().where("lang is not null")
    right = language.predict(got.select(F.lit(1).alias("doc_id"), "text", "lang"), model).groupBy("lang_pred").count().collect()
    assert {r.lang_pred for r in right} >= names


def test_language_without_labels_keeps_texts_with_letters(docs):
    from pyspark.sql import functions as F

    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.accepted(bare).count() == bare.where(F.col("text").rlike(r"\p{L}")).count()


def test_language_accepts_whole_rows(docs):
    kept = language.accepted(docs)
    assert kept.columns == docs.columns
    assert 0 < kept.count() < docs.count()


def test_language_on_held_out_documents(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op4_language"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in rows) >= 0.98 * len(rows)
