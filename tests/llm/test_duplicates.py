"""Exact, near and vector duplicates, against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from conftest import components
from pyspark.sql import functions as F

from llm import exact, jaccard, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("parts", [1, 4, 23])
def test_exact(spark, docs, awkward, keep, parts):
    """With many partitions the forty copies are cut over several of them."""
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = exact.groups(docs, keep).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = {}
    for i, t, *_ in awkward:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    order = lambda i: -1 if i is None else i
    want = Counter()
    for norm, ids in groups.items():
        best = (min if keep == "smallest" else max)(ids, key=order)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        stays = False
        for i in ids:
            want[(i, best, len(ids), i == best and not stays, sha)] += 1
            stays |= i == best
    assert Counter(map(tuple, got)) == want


def test_exact_keeps_one_whole_row(docs, nothing, awkward):
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns
    texts = [(r.text or "").translate(LOWER) for r in kept.collect()]
    assert sorted(texts) == sorted({(t or "").translate(LOWER) for _, t, *_ in awkward})
    assert exact.groups(nothing).collect() == []


def shingle_sets(rows):
    out = []
    for _, t, *_ in rows:
        w = WORD.findall(t or "")
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def wanted_classes(rows):
    sets, ids = shingle_sets(rows), [-1 if r[0] is None else r[0] for r in rows]
    links = [[j for j, b in enumerate(sets) if i != j and a and b and len(a & b) / len(a | b) >= 0.8] for i, a in enumerate(sets)]
    found = components(links, ids)
    return sorted((i, c, len(x), c == i) for i, c, x in zip(ids, found, links, strict=True))


def test_jaccard(docs, awkward):
    assert sorted(map(tuple, jaccard.join(docs).collect())) == wanted_classes(awkward)


def test_jaccard_of_texts_that_collide_under_powers_of_two(spark):
    """Thue-Morse differences: long words that polynomial hashes modulo 2^64 take for equal."""
    rng = np.random.default_rng(3)
    base, signs = rng.integers(0x4A, 0x6F, 2048), np.array([1 - 2 * (i.bit_count() % 2) for i in range(2048)])
    one, two = "".join(map(chr, base)), "".join(map(chr, base + signs))
    rows = [(1, one), (2, two), (3, f"a b {one} c d"), (4, f"a b {two} c d"), (5, one)]
    assert sorted(map(tuple, jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == wanted_classes(rows)


def test_jaccard_in_blocks(spark, monkeypatch):
    """Many different near copies of one text, with small blocks: buckets and groups are cut into tiles."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 5000, 260)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.integers(0, len(w), 3):
            w[k] = f"v{rng.integers(0, 10**9)}"
        rows.append((i * 3, " ".join(w), None, None, 0))
    rows += [(1000 + i, " ".join(f"u{k}" for k in rng.integers(0, 5000, 200)), None, None, 0) for i in range(40)]
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    monkeypatch.setattr(jaccard, "TILE", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    assert sorted(map(tuple, jaccard.join(df).collect())) == wanted_classes(rows)


def test_jaccard_keeps_one_of_each_class(docs, nothing, awkward):
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert ids == sorted({c for _, c, _, _ in wanted_classes(awkward)})
    assert jaccard.join(nothing).collect() == []


def test_jaccard_with_null_and_equal_ids(spark):
    """Different texts that share an id, or have none, are different documents: as vertices, in buckets and among what stays."""
    rng = np.random.default_rng(8)
    prose = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]

    def near(words):
        return " ".join([*words[:90], "changed", *words[91:]])

    a, b, c, d, e, f = (prose(n) for n in (200, 180, 160, 220, 240, 210))
    rows = [(None, " ".join(a)), (None, " ".join(b)), (None, near(a)), (7, " ".join(c)), (7, " ".join(d)), (9, near(c)), (3, " ".join(e)), (8, near(e)), (8, " ".join(f)),
            (10, near(f)), (10, near(b)), (11, near(d)), (11, near(d)), (None, ""), (None, " "), (12, None), (12, "\t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard.join(df).collect())) == wanted_classes(rows)
    kept = [(r.doc_id, r.text) for r in jaccard.deduplicate(df).collect()]
    firsts = [{rows[0], rows[2]}, {rows[1]}, {rows[3]}, {rows[4]}, {rows[6]}, {rows[8]}, {(None, "")}, {(None, " ")}, {(12, None)}, {(12, "\t")}]
    assert len(kept) == len(firsts) and all(len(x & set(kept)) == 1 for x in firsts)


def test_pruning_loses_a_true_pair_rarely():
    """The chance that a pair at the threshold is dropped, summed over the rounds."""
    from math import comb

    p = jaccard.THRESHOLD + (1 - jaccard.THRESHOLD) / 256
    lost = sum(sum(comb(n, m) * p**m * (1 - p) ** (n - m) for m in range(least)) for n, least in zip(jaccard.ROUNDS, jaccard.least_matches(), strict=True))
    assert lost < 1e-5


def some_vectors(dim=24):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(300):
        v = centres[i % 6] + rng.normal(size=dim) * rng.choice([0.05, 0.25, 0.32, 1.0])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 2)))
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * dim, 0), (2003, [float("nan")] * dim, 0), (2004, [None, 1.0], 0), (2005, rows[0][1], None), (2006, [1.0, 2.0], 0),
             (2007, [2.0, 4.0], 0), (2008, [float("inf")] * dim, 1), (5, rows[5][1], 1), (2009, [1e-30] * dim, 1), (2010, [3.0] * dim, 1)]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors(spark, block):
    rows = some_vectors()
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    unit = [np.array(v, dtype=np.float32).astype(float) / np.linalg.norm(np.array(v, dtype=np.float32).astype(float)) if g else None for (_, v, _), g in zip(rows, ok, strict=True)]
    links = [[j for j in range(len(rows)) if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93] for i in range(len(rows))]
    found = components(links, [r[0] for r in rows])
    want = sorted((r[0], len(x), c, c == r[0]) for r, x, c in zip(rows, links, found, strict=True))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1)).withColumn("block", F.lit(2)).repartition(5)
    assert sorted(map(tuple, vectors.near_duplicates(df, block=block).collect())) == want
    assert sum(len(x) for x in links) > 1000


def test_vectors_of_any_size(spark):
    rows = [(1, [2e-200, 2e-200], 0), (2, [1e-200, 1e-200], 0), (3, [1e200, 1e200], 0), (4, [2e200, 2e200], 0), (5, [1e200, -1e200], 0), (6, [5e-324, 0.0], 0), (7, [3.0, 0.1], 0)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (1, 6), 7: (1, 6)}


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 33))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, scale, error = vectors.quantised(x)
    off = np.abs((q.astype(float) @ q.T.astype(float)) * scale[:, None] * scale - x @ x.T)
    assert (off <= error[:, None] + error + error[:, None] * error).all()
