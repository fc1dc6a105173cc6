"""Operators that cut repeated strings, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm import suffixes, textops, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def wanted_bytes(rows):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[k : k + 200] for b in texts for k in range(len(b) - 199))
    out = []
    for (i, *_), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def wanted_words(rows):
    rows = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in sorted(r for r in rows if r[0] is not None):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_bytes(docs, awkward):
    assert sorted(map(tuple, suffixes.remove_repeats(docs).collect()), key=str) == wanted_bytes(awkward)


def test_bytes_when_every_anchor_is_hot(docs, awkward, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 1)
    assert sorted(map(tuple, suffixes.remove_repeats(docs).collect()), key=str) == wanted_bytes(awkward)


def test_words(docs, awkward):
    assert sorted(map(tuple, windows.remove_repeats(docs).collect()), key=str) == wanted_words(awkward)


@pytest.fixture(scope="module")
def shared_ids():
    """Long texts of different lengths that share passages with others, and their ids with one another."""
    rng = random.Random(21)
    prose = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    a, b, c, d = (prose(90) for _ in range(4))
    return [(None, prose(700) + " " + a), (None, b + " " + prose(75)), (None, prose(80) + " " + c + " " + prose(300)), (5, prose(60) + " " + a + " " + prose(600) + " " + d), (5, c + " " + prose(70)),
            (5, prose(65) + " " + b), (6, a + " " + prose(400)), (6, prose(500) + " " + d), (6, prose(55) + " " + d), (7, prose(300)), (7, prose(300))]


@pytest.mark.parametrize("hot", [256, 1])
def test_bytes_of_texts_that_share_an_id(spark, shared_ids, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    df = spark.createDataFrame(shared_ids, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, suffixes.remove_repeats(df).collect()), key=str) == wanted_bytes(shared_ids)


def test_words_of_texts_that_share_an_id(spark, shared_ids):
    df = spark.createDataFrame(shared_ids, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, windows.remove_repeats(df).collect()), key=str) == wanted_words(shared_ids)


def mirrored(n=2048):
    """Two texts without blanks whose bytes differ by the Thue-Morse signs: every polynomial hash modulo 2^64 takes them for equal."""
    rng = random.Random(11)
    base = [rng.randint(0x4A, 0x6F) for _ in range(n)]
    signs = [1 - 2 * (i.bit_count() % 2) for i in range(n)]
    return "".join(map(chr, base)), "".join(chr(x + s) for x, s in zip(base, signs, strict=True))


def test_texts_that_collide_under_powers_of_two(spark):
    one, two = mirrored()
    rows = [(1, one), (2, two), (3, f"{one} {' '.join(f'w{i}' for i in range(60))}"), (4, f"{two} {' '.join(f'v{i}' for i in range(60))}"), (5, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, suffixes.remove_repeats(df).collect()), key=str) == wanted_bytes(rows)
    assert sorted(map(tuple, windows.remove_repeats(df).collect()), key=str) == wanted_words(rows)
    data = np.frombuffer((one + two).encode(), dtype=np.uint8)
    for which in (0, 1):
        a, b = textops.span_hashes(data, np.array([0, 2048]), np.array([2048, 4096]), which)
        assert a != b


def test_span_hashes_do_not_depend_on_place_or_block(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 4600, 3000))
    ends = starts + rng.integers(0, 6, 3000)
    ends[::500] += 380
    whole = {w: textops.span_hashes(data, starts, ends, w) for w in (0, 1)}
    for w, h in whole.items():
        by = {}
        for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
            by.setdefault(data[a:b].tobytes(), set()).add(int(h[k]))
        assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    values = rng.integers(0, 1 << 62, 5000).astype(np.uint64)
    runs = textops.run_hashes(values, 50)
    monkeypatch.setattr(textops, "BLOCK", 64)
    textops.release()
    assert all((textops.span_hashes(data, starts, ends, w) == h).all() for w, h in whole.items())
    assert (textops.run_hashes(values, 50) == runs).all()
    monkeypatch.setattr(textops, "LONG", 300)
    long = textops.span_hashes(data, starts, ends)
    assert (long[ends - starts <= 300] == whole[0][ends - starts <= 300]).all() and len(set(long[::500].tolist())) == 6


def test_families_begin_anew_between_anchors(docs, awkward, monkeypatch):
    monkeypatch.setattr(suffixes, "FRESH", 1)
    assert sorted(map(tuple, suffixes.remove_repeats(docs).collect()), key=str) == wanted_bytes(awkward)


@pytest.mark.parametrize("operator", [suffixes.remove_repeats, windows.remove_repeats])
def test_empty_table(nothing, operator):
    assert operator(nothing).collect() == []


def test_index_family_over_many_batches():
    """Repeats within a batch, across batches and across merged levels are all found."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 4, 3000).astype(np.uint8)
    batches = []
    for _ in range(11):
        pieces = [pool[(s := int(rng.integers(0, 2500))) : s + int(rng.integers(200, 480))] if rng.random() < 0.4 else rng.integers(0, 4, int(rng.integers(200, 400))).astype(np.uint8) for _ in range(6)]
        batches.append(pieces)
    family, found = suffixes.Family(), []
    for pieces in batches:
        starts, at = [], 0
        for p in pieces:
            starts += range(at, at + len(p) - 199)
            at += len(p)
        family.add(np.concatenate(pieces), np.array(starts))
        found += [p[k : k + 200].tobytes() for p in pieces for k in range(len(p) - 199)]
    seen = Counter(found)
    assert family.repeated.tolist() == [seen[w] > 1 for w in found]
    assert sum(family.repeated) > 500
    assert len(family.levels) <= 4
