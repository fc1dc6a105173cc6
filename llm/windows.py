"""Substring deduplication by windows of 50 words: Rabin-Karp hashes of windows, counted in Spark.

A window is removed where its word sequence also starts in a document with a smaller id. Four steps:

1. Each text is read once. It gives its number of words, digests, and its anchors: the smallest hash of ``GRAM`` consecutive words
   in each window. Equal windows have equal anchors, and anchors are few (one in about a dozen words).
2. Texts with equal word sequences are one class; all but the smallest id are removed whole. Anchors are counted over classes.
3. Only texts with an anchor that occurs twice are read again, and only windows on such an anchor are hashed (128 bits) and reduced
   to the smallest id per hash, with partial aggregation before the shuffle. Nothing is dropped: a window whose anchor occurs once
   occurs once.
4. Windows that start in an earlier document merge into intervals, which are cut out.

Edge cases: null and empty texts have no words; texts shorter than a window are left alone; rows with equal ids are not earlier
than one another, and different texts all the same; a null doc_id is neither smaller nor larger than another, so such a row loses
nothing and takes nothing. An empty table gives no rows; extra columns are ignored.

Windows on an anchor that one class alone has are not hashed: they occur once. Whole copies need no windows either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import stored
from llm.textops import covered, halves, pieces, released, run_hashes, runs_within, sliding_min, span_hashes, text_buffer, word_spans

WINDOW = 50
GRAM = 25
_READ = "doc long, digest binary, n_words long, sha string, h1 long, h2 long, anchors array<long>"
_EMPTY = hashlib.sha256(b"").hexdigest()


def joined(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of each document joined by one blank, end to end, and their offsets."""
    s, e, o = starts[keep], ends[keep], owner[keep]
    delta = np.zeros(len(data) + 1, dtype=np.int8)
    delta[s] += 1
    delta[e] -= 1
    mask = np.cumsum(delta[:-1], dtype=np.int8).astype(bool)
    word = mask.copy()
    more = np.zeros(len(s), dtype=bool)
    more[:-1] = o[1:] == o[:-1]
    mask[e[more]] = True  # the byte behind a word that another one follows is white space
    out = np.where(word, data, np.uint8(0x20))[mask]
    upto = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return out, upto[offsets]


def _digests(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = memoryview(np.ascontiguousarray(data))
    return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _anchored(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that lie in one document, and the anchor of each."""
    at = np.flatnonzero(runs_within(first, WINDOW, len(words)))
    if len(at) == 0:
        return at, np.zeros(0, np.uint64)
    return at, sliding_min(run_hashes(words, GRAM), WINDOW - GRAM + 1)[at]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in pieces(batch):
            data, offsets = text_buffer(some.column(1))
            starts, ends, first = word_spans(data, offsets)
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            sha = _digests(*joined(data, offsets, starts, ends, owner, np.ones(len(starts), bool)))
            words = span_hashes(data, starts, ends)
            h1, h2 = halves(sha)  # words hold no blank, so joined texts are equal where the words are
            at, anchor = _anchored(words, first)
            own = owner[at]
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
            order = np.lexsort((anchor[new], own[new]))
            a, o = anchor[new][order], own[new][order]
            once = np.ones(len(a), bool)
            once[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
            a, o = a[once], o[once]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(some.schema.get_field_index("digest")), pa.array(np.diff(first)), pa.array(sha), h1, h2, _lists(a, np.searchsorted(o, np.arange(len(offsets))))],
                names=["doc", "digest", "n_words", "sha", "h1", "h2", "anchors"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows on repeated anchors: two hashes, class, document, first word."""
    for batch in batches:
        for some in pieces(batch):
            data, offsets = text_buffer(some.column(some.schema.get_field_index("text")))
            starts, ends, first = word_spans(data, offsets)
            words = span_hashes(data, starts, ends)
            at, anchor = _anchored(words, first)
            own = np.searchsorted(first, at, side="right") - 1
            wanted = some.column(some.schema.get_field_index("anchors"))
            lists, values = wanted.offsets.to_numpy(), wanted.values.to_numpy().view(np.uint64)
            hit = np.zeros(len(at), bool)
            bounds = np.searchsorted(own, np.arange(len(offsets)))
            for d in range(len(offsets) - 1):
                hit[bounds[d] : bounds[d + 1]] = np.isin(anchor[bounds[d] : bounds[d + 1]], values[lists[d] : lists[d + 1]])
            at, own = at[hit], own[hit]
            w1 = run_hashes(words, WINDOW)[at] if len(at) else anchor[:0]
            w2 = run_hashes(span_hashes(data, starts, ends, 1), WINDOW, 1)[at] if len(at) else anchor[:0]
            yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), some.column(0).take(pa.array(own)), some.column(1).take(pa.array(own)), pa.array((at - first[own]).astype(np.int32))],
                                             names=["w1", "w2", "rep", "doc", "start"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in pieces(batch):
            data, offsets = text_buffer(some.column(some.schema.get_field_index("text")))
            starts, ends, first = word_spans(data, offsets)
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            found = some.column(some.schema.get_field_index("starts"))
            lists, values = found.offsets.to_numpy(), found.values.to_numpy()
            place = np.repeat(first[:-1], np.diff(lists)) + values[lists[0] : lists[-1]]
            gone = covered(place, WINDOW, len(starts))
            c = np.concatenate([[0], np.cumsum(gone)])
            sha = _digests(*joined(data, offsets, starts, ends, owner, ~gone))
            yield pa.RecordBatch.from_arrays([some.column(some.schema.get_field_index("rep")), pa.array(c[first[1:]] - c[first[:-1]]), pa.array(sha)],
                                             names=["rep", "cut", "cut_sha"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    read = stored(rows.mapInArrow(released(_read), _READ), "word-texts")
    # Equal word sequences have equal anchors, so any row's will do. A class has a number of its own (fixed by storing it): ids may be null or repeated.
    classes = read.where(F.col("n_words") >= WINDOW).groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "digest")).alias("at"), F.first("anchors").alias("anchors"))
    classes = stored(classes.select("h1", "h2", "at.doc", "at.digest", "anchors", F.monotonically_increasing_id().alias("rep")), "word-classes")
    own = classes.select("rep", "doc", "digest", F.explode("anchors").alias("anchor"))
    again = stored(own.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    wanted = stored(own.join(again, "anchor").groupBy("rep", "doc", "digest").agg(F.collect_list("anchor").alias("anchors")), "anchored")  # at most a text's own
    texts = rows.alias("r").join(wanted.alias("w"), F.expr("r.doc <=> w.doc and r.digest = w.digest")).select("rep", "w.doc", "anchors", "text")
    texts = stored(texts, "anchored-texts")
    windows = stored(texts.mapInArrow(released(_hashed), "w1 long, w2 long, rep long, doc long, start int"), "windows")
    earliest = windows.groupBy("w1", "w2").agg(F.min("doc").alias("earliest"), F.max("doc").alias("latest")).where("earliest < latest").drop("latest")
    late = windows.join(stored(earliest, "repeated-windows"), ["w1", "w2"]).where("doc > earliest")
    starts = late.groupBy("rep").agg(F.collect_list("start").alias("starts"))  # at most a text's own windows
    cuts = stored(texts.select("rep", "text").join(starts, "rep").mapInArrow(released(_cut), "rep long, cut long, cut_sha string"), "cuts").dropDuplicates(["rep"])
    found = stored(classes.select("h1", "h2", F.col("doc").alias("least"), "rep").join(cuts, "rep", "left").drop("rep"), "word-results")
    out = read.drop("anchors", "digest").join(found, ["h1", "h2"], "left")
    copy = F.coalesce(F.col("doc") > F.col("least"), F.lit(False))
    return out.select(F.col("doc").alias("doc_id"), "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
                      F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"))
