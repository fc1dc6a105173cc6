"""Packing, mixing and sharding: laws and round trips."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import mix, pack, shards


def encoded(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pack.default_tokenizer())
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("limit", [2048, 64])
def test_pack(docs, awkward, limit):
    rows = pack.pack(docs, limit=limit).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    want = Counter()
    total = 0
    for i, t, *_ in awkward:
        ids = encoded(t)
        total += len(ids)
        head = len(ids) - (-(-len(ids) // limit) - 1) * limit
        cuts = [0, *range(head, len(ids) + 1, limit)]
        for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[(i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert len(by_sequence) <= 1.03 * total / limit + 2


def test_pack_nothing(nothing):
    assert pack.pack(nothing).collect() == []


def test_two_fit_replaces_the_shortest():
    """Greedy fills 10 with 6 and 3; 3 makes room for 2 and 2, which fit exactly."""
    assert pack.patterns({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]


def test_patterns_use_every_piece():
    rng = np.random.default_rng(1)
    counts = {int(s): int(n) for s, n in zip(rng.permutation(np.arange(1, 500))[:200], rng.integers(1, 5000, 200), strict=True)}
    used = Counter()
    bins = pack.patterns(counts, 512)
    for lengths, times in bins:
        assert sum(lengths) <= 512
        for s in lengths:
            used[s] += times
    assert used == counts
    assert len(bins) < 4 * len(counts)


def targets_by_hand(size):
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(3 * size[s] for s in full)
        got = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if got[s] > 3 * size[s]}
        if not over:
            return {**{s: 3 * size[s] for s in full}, **got}
        full |= over


def test_mix(docs, awkward):
    import re

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = defaultdict(int)
    for _, t, _, s, _ in awkward:
        size[s] += words(t)
    want = targets_by_hand(size)
    rows = mix.plan(docs).collect()
    assert sorted(r["size"] for r in rows) == sorted(words(t) for _, t, *_ in awkward)
    by_total = defaultdict(set)
    for s, n in size.items():
        by_total[n].add(s)
    taken = defaultdict(int)
    for r in rows:
        source = next(iter(by_total[r.source_size])) if len(by_total[r.source_size]) == 1 else None
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[r.source_size] += r.taken
        assert any(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for s in by_total[r.source_size]) or source is not None
    for n, sources in by_total.items():
        goal = sum(want[s] for s in sources)
        assert abs(taken[n] - goal) <= max(0.05 * goal, 60)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.taken)
    again = mix.plan(docs.repartition(3)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str) and sorted(map(key, rows)) == sorted(map(key, again))


def test_mix_repeats_the_rows_of_the_plan(spark):
    """Copies go to rows of their own source, also where ids are null or shared between sources."""
    rng = np.random.default_rng(4)
    rows = [(None if k % 3 == 0 else 9 if k % 3 == 1 else k, " ".join("abc"[: 1 + k % 3] for _ in range(1 + int(rng.integers(0, 4)))), "xyz"[int(rng.integers(0, 3)) if k > 40 else 0], "own") for k in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row string").repartition(3)
    planned = Counter()
    for r in mix.plan(df).collect():
        planned[r.doc_id, r["size"], r.source_size] += r.copies
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len(t.split())
    assert len(set(size.values())) == len(size)
    got = Counter((r.doc_id, len(r.text.split()), size[r.source]) for r in mix.apply(df).collect())
    assert got == +planned and len({s for *_, s in got}) == 3
    assert mix.apply(df).columns == df.columns


def test_mix_repeats_rows(docs, nothing):
    taken = sum(r.taken for r in mix.plan(docs).collect())
    mixed = mix.apply(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(mix.word_count(F.col("text")))).first()[0] == taken
    assert mix.plan(nothing).collect() == [] and mix.apply(nothing).collect() == []


def test_mix_without_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in mix.plan(df).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_native_operators_run_no_python(docs):
    for df in (mix.plan(docs), shards.shard(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_shards(docs, awkward):
    rows = shards.shard(docs).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in awkward)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None
        slots[r.shard].append(r.slot)
        groups[(r.text_crc32, r["size"])].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    target = sum(r["size"] for r in rows) / 24
    held = Counter()
    for r in rows:
        held[(r.text_crc32, r["size"])] += r["size"]
    assert all(len(s) == 1 for k, s in groups.items() if held[k] <= target)


def test_shards_are_near_equal(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "x" * int(rng.integers(10, 400)) + str(i), "en", f"s{i % 7}") for i in range(6000)]
    rows += [(10000 + i, "copy " * 60, "en", "s1") for i in range(3000)]  # a group larger than a shard is cut
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    size = [r[1] for r in shards.shard(df).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(size) == 24
    assert max(size) < 1.05 * np.mean(size) and min(size) > 0.95 * np.mean(size)


def test_shards_of_nothing(nothing):
    assert shards.shard(nothing).collect() == []
