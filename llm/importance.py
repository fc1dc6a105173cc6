"""Target-distribution importance resampling: draw the documents whose words look most like those of a target corpus.

Texts become hashed counts of word n-grams. Two readings of the corpus do the work, both over concatenated batches: the texts of
a batch are joined with a separator that no word can hold, one regex pass finds all words, the place of a word among the document
offsets (``searchsorted``) gives its document, and runs of words that reach into the next document are masked out.

1. Counting: a task adds up its buckets (``bincount``) and emits each once, so at most ``buckets`` rows a task are shuffled. The
   counts of the corpus and of the target (``buckets`` numbers each, whatever the input) give the gain of every bucket.
2. Scoring: a document's weight is the floored mean gain of its features; a Gumbel number made from its id is added to it.

The highest scores are drawn. Scores are whole numbers in a narrow range, so their histogram finds the lowest score drawn, and only
rows from there on are sorted, range-partitioned by (score, id).

Edge cases: null and empty texts have no words, weight 0 and are never drawn below ``least_words``; a null doc_id hashes like an
empty one and loses ties; equal rows have equal scores and take neighbouring ranks; an empty corpus gives no rows, an empty target
counts as one with no features. Long texts are taken ``STEP`` words at a time. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import stored
from llm.textops import LOWER, text_lists
from plotline.operators.ordering import global_rank

BUCKETS = 10000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
#: Words in hand at a time.
STEP = 1 << 17
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Between texts; not part of any word.
_BETWEEN = b"\x00"
_LOWER = LOWER.tobytes()


def features(texts: list[bytes], longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(run length, document, bucket) of every run of 1 to ``longest`` words, of a batch of texts, a few words at a time."""
    joined = _BETWEEN.join(texts).translate(_LOWER)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64)])
    found = _WORD.finditer(joined)
    words: list[bytes] = []
    at: list[int] = []
    while True:
        kept = len(words)  # the last words of the step before, which runs of this one may start with
        for m in islice(found, STEP):
            at.append(m.start())
            words.append(m.group())
        if len(words) == kept:
            return
        owner = np.searchsorted(begins, np.array(at), side="right") - 1
        code: list[int] = []
        for n in range(1, longest + 1):
            first = max(0, kept - n + 1)  # earlier runs of this length came with the step before
            if n == 1:
                code = list(map(crc32, words))
            else:
                code = list(map(crc32, [b" " + w for w in words[n - 1 :]], code))
            own, last = owner[: len(owner) - n + 1], owner[n - 1 :]
            if len(last) == 0:
                break
            inside = np.flatnonzero(own == last)
            inside = inside[inside >= first]
            yield n, own[inside], (np.array(code, dtype=np.uint32)[inside] % np.uint32(buckets)).astype(np.int64)
        tail = longest - 1
        words, at = (words[-tail:], at[-tail:]) if tail else ([], [])


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for _, some in text_lists(batches):
            for _, _, bucket in features(some, longest, buckets):
                total += np.bincount(bucket, minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in found:  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of the smoothed shares of each bucket in target and corpus."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    k = float(len(corpus))
    return np.floor(1000.0 * np.log((t + 1.0) * (s.sum() + k) / ((s + 1.0) * (t.sum() + k)))).astype(np.int64)


def scores(docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for some, texts in text_lists(batches):
            n = np.zeros((3, len(texts)), dtype=np.int64)  # words, features, gains
            for length, doc, bucket in features(texts, longest, len(own)):
                here = np.bincount(doc, minlength=len(texts))
                n[0] += here if length == 1 else 0
                n[1] += here
                n[2] += np.bincount(doc, own[bucket], len(texts)).astype(np.int64)  # whole numbers far below 2^53
            weight = np.where(n[1] > 0, n[2] // np.maximum(n[1], 1), 0)
            yield pa.RecordBatch.from_arrays([some.column(0), *map(pa.array, (n[0], n[1], weight))], names=["doc_id", "n_words", "n_features", "weight"])

    weighted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    return weighted.withColumn("score", (F.col("weight") + noise).cast("long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where the document isn't drawn.

    Drawn are the ``percent`` in a hundred highest scores among documents of ``least_words`` words, ties to the smaller doc_id.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = stored(scores(docs, gain, longest, seed).withColumn("row", F.monotonically_increasing_id()), "importance-scores")
    able = F.col("n_words") >= least_words
    # Gains and noise are logarithms, so there are some ten thousand distinct scores, however many documents.
    histogram = sorted(((r["score"], r["n"]) for r in rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in histogram) // 100
    lowest, above = None, 0
    for score, n in histogram:
        if above >= wanted:
            break
        lowest, above = score, above + n
    plain = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if lowest is None:
        return rows.select(*plain, none)
    near = F.coalesce(able & (F.col("score") >= lowest), F.lit(False))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    best = global_rank(rows.where(near), order, "place")
    drawn = best.select(*plain, F.when(F.col("place") < wanted, F.col("place") + 1).cast("long").alias("rank"))
    return rows.where(~near).select(*plain, none).unionByName(drawn)
