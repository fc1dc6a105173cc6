"""Importance resampling, centroid clustering and the compression classifier against brute force."""

import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import centroids, compression, importance


def brute_resample(rows, target, longest=1, buckets=10000, percent=10, least=20, seed=2024):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return len(words), [crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    made = [(i, *grams(t)) for i, t in rows]
    s, t = [0] * buckets, [0] * buckets
    for _, _, g in made:
        for b in g:
            s[b] += 1
    for text in target:
        for b in grams(text)[1]:
            t[b] += 1
    total, aim = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (total + buckets) / ((s[b] + 1.0) * (aim + buckets)))) for b in range(buckets)]
    out = []
    for i, n, g in made:
        weight = math.floor(sum(gain[b] for b in g) / len(g)) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(able[: percent * len(able) // 100])]
    rest = [(*r[:4], None) for r in able[percent * len(able) // 100 :]] + [(*r[:4], None) for r in out if r[4] < least]
    return sorted(drawn + rest, key=str)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling(spark, docs, awkward, longest):
    target = ["stone river Lamp of the w1 w2 w3", None, "", "the river; naïve größe 7 w9"]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = importance.resample(docs, aim, longest=longest, percent=30)
    assert got.columns[:5] == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute_resample([(r[0], r[1]) for r in awkward], target, longest, percent=30)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_features_in_small_steps(monkeypatch):
    """Runs over the edges of steps are found once, runs over the edges of texts never."""
    texts = [b"a b c d e", b"", b"F, g", b"h"] + [b" ".join(b"w%d" % i for i in range(50))]
    whole = [(n, d.tolist(), b.tolist()) for n, d, b in importance.features(texts, 3, 997)]
    monkeypatch.setattr(importance, "STEP", 4)
    cut = sorted((n, x, y) for n, d, b in importance.features(texts, 3, 997) for x, y in zip(d.tolist(), b.tolist(), strict=True))
    assert cut == sorted((n, x, y) for n, d, b in whole for x, y in zip(d, b, strict=True))
    assert sum(n == 3 for n, _, _ in cut) == 3 + 48


def test_resampling_of_nothing(spark, docs, nothing):
    aim = spark.createDataFrame([("one two",)], "text string")
    assert importance.resample(nothing, aim).collect() == []
    assert importance.resample(docs, aim.limit(0)).count() == docs.count()
    assert importance.resample(docs.withColumn("text", F.lit(None).cast("string")), aim).where("rank is not null or weight <> 0").count() == 0


def vectors_():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 64)) * 0.2
    rows = [(int(i), (middle[i % 12] + rng.normal(size=64) * 0.05).tolist(), int(i % 3)) for i in range(400)]
    rows += [(1000 + i, rows[5][1], None) for i in range(150)]  # one group of equal vectors
    rows += [(7, rows[7][1], 1), (None, rows[9][1], 1), (None, None, 1), (2000, [0.1] * 63, 1), (2001, [float("nan")] + [0.1] * 63, 1), (2002, [None] + [0.1] * 63, 1),
             (2003, [float("inf")] + [0.1] * 63, 1), (2004, [], 1), (2005, [0.0] * 64, 1), (2006, [-0.0001] * 64, 1), (2007, [9000.5] * 64, 1)]
    return rows


def brute_clusters(rows, k=8, rounds=10, seed=3):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in order[:k]]
    x = np.array([v for _, v in kept], dtype=object)

    def near():
        d = np.array([((x - np.array(c, dtype=object)) ** 2).sum(axis=1) for c in now], dtype=object)
        return [min(range(len(now)), key=lambda j: (d[j][r], j)) for r in range(len(kept))], d

    for _ in range(rounds):
        which, _ = near()
        for j in range(len(now)):
            own = [r for r in range(len(kept)) if which[r] == j]
            if own:
                now[j] = [int(s) // len(own) for s in x[own].sum(axis=0)]
    which, d = near()
    dist = [d[j][r] for r, j in enumerate(which)]
    each = [sum(q for q, j in zip(dist, which, strict=True) if j == c) for c in range(len(now))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, j, q, each[j], sum(dist), sha[j]) for (i, _), j, q in zip(kept, which, dist, strict=True)), key=str)


SHAPE = "vec_id long, embedding array<double>, label int"


def clustered(spark, rows, **more):
    df = spark.createDataFrame(rows, SHAPE).withColumn("cluster", F.lit("own")).withColumn("q", F.lit("own")).withColumn("apex", F.lit(1)).repartition(5)
    return sorted((tuple(r) for r in centroids.cluster(df, **more).collect()), key=str)


def test_clusters(spark):
    assert clustered(spark, vectors_()) == brute_clusters(vectors_())


@pytest.mark.parametrize("n", [1, 3, 20])
def test_clusters_of_few_vectors(spark, n):
    rows = vectors_()[:n] + [(50, vectors_()[0][1], 1)]
    assert clustered(spark, rows, rounds=3) == brute_clusters(rows, rounds=3)


def test_clusters_of_nothing_and_of_equal_vectors(spark):
    assert clustered(spark, []) == []
    same = [(i, [0.5] * 64, 0) for i in range(40)]
    assert clustered(spark, same) == brute_clusters(same)
    with pytest.raises(Exception, match="after scaling"):
        clustered(spark, [(1, [1e9] * 64, 0)])


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(1)
    for spread, rank in ((1000, 64), (1 << 26, 64), (50, 5), (1, 64)):
        x = np.rint(rng.normal(size=(300, rank)) @ rng.normal(size=(rank, 64)) / math.sqrt(rank) * spread / 4).astype(np.int64).clip(-centroids.LIMIT, centroids.LIMIT)
        x[10:20] = x[0]
        base = centroids.base_simplex(x[:64])
        assert 1 <= len(base.pivots) <= centroids.PIVOTS
        apex = centroids.apexes(base, x)
        low, high = centroids.bounds(apex, apex[:40])
        true = np.sqrt(centroids.squared(x, x[:40]).astype(float))
        assert (low <= true).all() and (true <= high).all()
    groups = rng.normal(size=(8, 64)) * 300
    x = np.rint(np.repeat(groups, 50, axis=0) + rng.normal(size=(400, 64)) * 20).astype(np.int64)
    base = centroids.base_simplex(x[rng.permutation(400)[:64]])
    low, high = centroids.bounds(centroids.apexes(base, x), centroids.apexes(base, x[::50]))
    assert (low <= high.min(axis=1)[:, None]).sum() < 1.5 * len(x)  # of 8 each


def labelled(spark, n=600):
    rng = random.Random(5)
    parts = ["stone", "river", "lamp", "the", "of", "and", "cold", "night", "tree", "road", "song", "bird"]
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(parts) + rng.choice(["", "s", "ing", "ed"]) for _ in range(rng.randint(20, 120))]
        text = " ".join(words) if good else " ".join(w.upper() + rng.choice(["!!", "###", "$$$"]) for w in words)
        rows.append((i, text if rng.random() < 0.9 else text + "\nshared boilerplate of every page, all rights reserved", int(good)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, rows[0][1], "x"), (n + 1, None, "x"), (n + 2, "", "x"), (n + 3, "long " * 100_000, "x"), (0, rows[0][1], "x")],
                                 "doc_id long, text string, quality string").withColumn("score", F.lit("own"))
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(3, None, 0), (4, 7, 0), (None, 1, 0), (99999, 0, 1), (5, rows[5][2], 1)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: q for i, _, q in rows}


def test_quality_by_held_out_labels(spark):
    docs, labels, truth = labelled(spark)
    got = compression.classify(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(crc32(str(r.doc_id).encode()) % 5 == 0 for r in held) and len(held) > 80
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert len({r.score for r in got if r.doc_id in (601, 602)}) == 1  # null and empty
    again = compression.classify(docs.repartition(7), labels.repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.score) for r in got) == sorted((r.doc_id or -1, r.score) for r in again)


def test_held_out_labels_are_not_learned(spark):
    docs, labels, _ = labelled(spark, 200)
    turned = labels.withColumn("quality", F.when(compression.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [sorted((r.doc_id or -1, r.score) for r in compression.classify(docs, x).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_quality_scores_are_what_the_dictionaries_say(spark):
    """Every score is the curve at the difference of two plain compressions of the whole text."""
    import zstandard

    docs, labels, _ = labelled(spark, 200)
    model = compression.fit(docs, labels)
    plain = {"level": compression.LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    for r in docs.join(compression.scores(docs, model).withColumnRenamed("score", "got"), "doc_id").collect():
        text = (r.text or "").encode()
        bad, good = (len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **plain).compress(text)) for b in (model.bad, model.good))
        z = min(4.0, max(-4.0, ((bad - good) / (len(text) + 128) - model.scale[0]) / model.scale[1]))
        # A prepared dictionary may cost a long text a few bytes more or less than one given raw.
        assert r.got == pytest.approx(1 / (1 + math.exp(-(model.offset + model.slope * z))), abs=0.05)
    assert b"all rights reserved" not in model.bad + model.good
    assert len(model.bad) <= compression.SIZE and len(model.good) <= compression.SIZE


def test_quality_without_labels(spark, nothing):
    docs, labels, _ = labelled(spark, 60)
    assert all(r.score == pytest.approx(0.5) for r in compression.classify(docs, labels.limit(0)).collect())
    one = compression.classify(docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.9
    assert compression.classify(nothing, labels).collect() == []
    alone = docs.withColumn("doc_id", F.lit(3).cast("long"))  # one id for all rows: one text is learned from
    assert compression.sampled(alone, labels).count() == 1
