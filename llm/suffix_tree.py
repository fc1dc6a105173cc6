"""Language-model scoring with a probabilistic suffix tree over bytes.

A text is its lower-cased words, each followed by a blank, and an end symbol, so that token sequences and byte strings match one to
one. A context is up to ``DEPTH`` preceding bytes. Counts of all (context, next byte) pairs are gathered from the training documents,
pre-aggregated in each task and summed in Spark. A context is retained if the divergence of its next-symbol distribution from that of
its longest proper suffix, times its count, pays for its parameters; with a context its suffixes are retained. Distributions are
smoothed towards the suffix (Witten-Bell): P(x|s) = (c(s,x) + d(s) P(x|suffix)) / (n(s) + d(s)), and each byte is scored in the
longest retained state.

The tree falls into independent parts by the last byte of the context. Parts are grouped up to ``LIMIT`` counted pairs; one group at
a time is brought to the tasks, so memory stays bounded: a larger tree takes more passes over the texts, and leaves out nothing.

The baseline needs the count of every word of every text. Each input partition lists its distinct words once; counts are summed by
word, and go back to the partitions that asked. A hot word is one row per partition, however often it occurs.

Edge cases: null and empty texts have one token, the end; without training documents the model is uniform and the baseline counts
are zero; a null doc_id is a training document; repeated rows are scored (and learned from) each. An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import stored
from llm.textops import LOWER, pieces, release, released, span_hashes, text_buffer, word_spans

DEPTH = 5
#: Nats that a context must gain per parameter, times the logarithm of its count.
PENALTY = 0.1
#: Counted pairs that are brought to the tasks at once.
LIMIT = 1 << 23
#: Bytes of input whose counts a task sums before it passes them on, and of texts scored together.
CHUNK = 32 << 20
SYMBOLS = 257
END, BLANK = 0x0A, 0x20
_PIECE = 1 << 19
_COUNTED = "gram long, n long"


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


# ---- texts ------------------------------------------------------------------------------------------------------------------


def spelled(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, ``DEPTH`` end symbols before each, and the place of each text's first symbol (and one past all)."""
    starts, ends, first = word_spans(low, offsets)
    docs = len(offsets) - 1
    size = ends - starts
    upto = np.concatenate([[0], np.cumsum(size)])
    length = upto[first[1:]] - upto[first[:-1]] + np.diff(first) + 1
    begin = np.concatenate([[0], np.cumsum(length + DEPTH)]) + DEPTH
    out = np.full(begin[-1] - DEPTH, END, dtype=np.uint8)
    owner = np.repeat(np.arange(docs), np.diff(first))
    at = begin[owner] + upto[:-1] - upto[first[owner]] + np.arange(len(starts)) - first[owner]  # where each word goes
    shift = np.repeat(at - upto[:-1], size)
    source = np.repeat(starts - upto[:-1], size) + np.arange(upto[-1])
    out[shift + np.arange(upto[-1])] = low[source]
    out[at + size] = BLANK
    return out, begin


def grams(symbols: np.ndarray) -> np.ndarray:
    """For each place from ``DEPTH`` on the ``DEPTH`` symbols before it and its own, as one number."""
    n = len(symbols) - DEPTH
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(DEPTH + 1):
        out = (out << np.uint64(8)) | symbols[k : k + n]
    return out


def _targets(begin: np.ndarray, total: int) -> np.ndarray:
    """Mask over places from ``DEPTH`` on: symbols of texts, not the end symbols before them."""
    mask = np.ones(total - DEPTH, dtype=bool)
    for k in range(1, DEPTH + 1):
        at = begin[1:-1] - k - DEPTH
        mask[at] = False
    return mask


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


class _Sums:
    """Counts by key, merged when the parts outgrow the whole."""

    def __init__(self) -> None:
        self.whole, self.parts, self.loose = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.loose += len(keys)
        if self.loose > max(1 << 20, len(self.whole[0])):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            keys, counts = zip(self.whole, *self.parts, strict=True)
            self.whole, self.parts, self.loose = _summed(np.concatenate(keys), np.concatenate(counts)), [], 0
        return self.whole


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, read = _Sums(), 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys, counts = sums.merge()
        for k in range(0, len(keys), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 18)].view(np.int64)), pa.array(counts[k : k + (1 << 18)])], names=["gram", "n"])

    for batch in batches:
        for some in pieces(batch, limit=_PIECE):
            data, offsets = text_buffer(some.column(0))
            symbols, begin = spelled(LOWER[data], offsets)
            sums.add(*_distinct(grams(symbols)[_targets(begin, len(symbols))]))
            read += len(data)
            if read >= CHUNK:
                yield from flush()
                sums, read = _Sums(), 0
    yield from flush()


def _list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each chunk, and how often they occur in its training documents."""
    every: dict[int, _Sums] = {}
    for batch in batches:
        for some in pieces(batch, limit=_PIECE):
            data, offsets = text_buffer(some.column(2))
            starts, ends, first = word_spans(data, offsets)
            words = span_hashes(LOWER[data], starts, ends)
            chunk = some.column(0).to_numpy()
            train = np.repeat(~some.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
            where = np.repeat(chunk, np.diff(first))
            for c in np.unique(chunk).tolist():
                sums = every.setdefault(c, _Sums())
                for flag in (True, False):
                    keys, counts = _distinct(words[(train == flag) & (where == c)])
                    sums.add(keys, counts if flag else np.zeros_like(counts))
    for c, sums in every.items():
        keys, counts = sums.merge()
        for k in range(0, len(keys), 1 << 18):
            part = keys[k : k + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), c, np.int32)), pa.array(part.view(np.int64)), pa.array(counts[k : k + (1 << 18)])], names=["chunk", "word", "n"])


# ---- the tree ---------------------------------------------------------------------------------------------------------------


class Index:
    """Values by key, in an open hash table. Keys are below 2^63."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(1.5 * len(keys)).bit_length())
        self.shift, self.mask, self.free = np.uint64(64 - bits), (1 << bits) - 1, np.uint64((1 << 64) - 1)
        self.keys, self.values = np.full(1 << bits, self.free), np.zeros(1 << bits, dtype=values.dtype)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot] == self.free
            self.keys[slot[free]] = keys[todo[free]]
            mine = self.keys[slot] == keys[todo]
            self.values[slot[mine]] = values[todo[mine]]
            slot, todo = (slot[~mine] + 1) & self.mask, todo[~mine]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys, and the places of the keys that are not there."""
        slot = self._slot(keys)
        got = self.keys[slot]
        odd = np.flatnonzero((got != keys) & (got != self.free))
        lost = [np.flatnonzero(got == self.free)]
        while len(odd):
            slot[odd] = (slot[odd] + 1) & self.mask
            got = self.keys[slot[odd]]
            lost.append(odd[got == self.free])
            odd = odd[(got != keys[odd]) & (got != self.free)]
        return self.values[slot], np.concatenate(lost)


@dataclass
class Tree:
    """Part of the tree: contexts whose last byte is in ``last``. Levels hold sorted pairs and contexts; logarithms are natural."""

    last: np.ndarray
    root: np.ndarray
    pairs: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    back: list[np.ndarray] = field(default_factory=list)
    index: Index | None = None

    def score(self, gram: np.ndarray) -> np.ndarray:
        """log P of each place in its longest retained state; 0 where the context belongs to another part."""
        if self.index is None:
            self.index = Index(self.pairs[-1], self.logs[-1])
        if self.last.all():
            return self._own(gram)
        out = np.zeros(len(gram))
        own = np.flatnonzero(self.last[((gram >> np.uint64(8)) & np.uint64(255)).astype(np.int64)])
        out[own] = self._own(gram[own])
        return out

    def _own(self, gram: np.ndarray) -> np.ndarray:
        values, new = self.index.find(gram)
        found = values.astype(np.float64)
        if len(new):
            unseen, back = np.unique(gram[new], return_inverse=True)
            found[new] = self._unseen(unseen)[back]
        return found

    def _unseen(self, keys: np.ndarray) -> np.ndarray:
        """Pairs that training has not shown at full length: back off until it has."""
        out, todo = np.zeros(len(keys)), np.arange(len(keys))
        for depth in range(DEPTH, 0, -1):
            gram = keys[todo] & np.uint64((1 << 8 * (depth + 1)) - 1)
            if len(self.pairs[depth - 1]):
                at = np.minimum(np.searchsorted(self.pairs[depth - 1], gram), len(self.pairs[depth - 1]) - 1)
                hit = self.pairs[depth - 1][at] == gram
                out[todo[hit]] += self.logs[depth - 1][at[hit]]
                todo, gram = todo[~hit], gram[~hit]
                context = gram >> np.uint64(8)
                at = np.minimum(np.searchsorted(self.contexts[depth - 1], context), len(self.contexts[depth - 1]) - 1)
                hit = self.contexts[depth - 1][at] == context
                out[todo[hit]] += self.back[depth - 1][at[hit]]
        out[todo] += self.root[(keys[todo] & np.uint64(255)).astype(np.int64)]
        return out


def grow(keys: np.ndarray, counts: np.ndarray, symbols: np.ndarray, last: np.ndarray) -> Tree:
    """The part of the tree whose contexts end in ``last``, from its counted pairs; ``symbols`` has the counts of all next bytes."""
    root = np.log((symbols + 1.0) / (symbols.sum() + SYMBOLS))
    levels = [_summed(keys.astype(np.uint64), counts.astype(np.int64))]
    for depth in range(DEPTH - 1, 0, -1):
        k, c = levels[0]
        levels.insert(0, _summed(k & np.uint64((1 << 8 * (depth + 1)) - 1), c))
    stats = []
    for k, _ in levels:
        context = k >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(k) else np.zeros(0, np.int64)
        stats.append((context[first], first, np.diff(np.append(first, len(k)))))
    total = [np.add.reduceat(c, s[1]) if len(s[1]) else c for (_, c), s in zip(levels, stats, strict=True)]
    share = np.maximum(symbols, 1e-300) / max(1, symbols.sum())
    keep, up = [], []
    for i, ((k, c), (context, first, kinds)) in enumerate(zip(levels, stats, strict=True)):
        n = np.repeat(total[i], kinds)
        if i == 0:
            q = share[(k & np.uint64(255)).astype(np.int64)]
            up.append(np.zeros(len(k), np.int64))
        else:
            at = np.searchsorted(levels[i - 1][0], k & np.uint64((1 << 8 * (i + 1)) - 1))
            up.append(at)
            q = levels[i - 1][1][at] / np.repeat(total[i - 1], stats[i - 1][2])[at]
        gain = np.add.reduceat(c * np.log(c / n / q), first) if len(first) else np.zeros(0)
        keep.append(gain > PENALTY * kinds * np.log(total[i] + 1.0))
    for i in range(DEPTH - 1, 0, -1):  # the suffixes of a retained context are retained
        suffix = stats[i][0][keep[i]] & np.uint64((1 << 8 * i) - 1)
        keep[i - 1][np.searchsorted(stats[i - 1][0], suffix)] = True
    tree = Tree(last, root)
    for i, ((k, c), (context, _, kinds)) in enumerate(zip(levels, stats, strict=True)):
        lower = np.exp(root[(k & np.uint64(255)).astype(np.int64)] if i == 0 else tree.logs[i - 1][up[i]].astype(np.float64))
        n, d = np.repeat(total[i], kinds), np.repeat(kinds, kinds)
        p = np.where(np.repeat(keep[i], kinds), (c + d * lower) / (n + d), lower)
        tree.pairs.append(k)
        tree.logs.append(np.log(p).astype(np.float32))
        tree.contexts.append(context)
        tree.back.append(np.where(keep[i], np.log(kinds / (total[i] + kinds)), 0.0).astype(np.float32))
    return tree


def trees(counted: DataFrame, limit: int = LIMIT) -> Iterator[Tree]:
    """The tree in parts of at most about ``limit`` pairs (a last byte is never cut)."""
    last = F.shiftright("gram", 8).bitwiseAND(255)
    size = {r["last"]: r["n"] for r in counted.groupBy(last.alias("last")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 256 rows at most
    symbols = np.zeros(256)
    for r in counted.groupBy(F.col("gram").bitwiseAND(255).alias("x")).agg(F.sum("n").alias("n")).collect():
        symbols[r["x"]] = r["n"]
    groups: list[list[int]] = [[]]
    for b in range(256):
        if groups[-1] and sum(size.get(x, 0) for x in groups[-1]) + size.get(b, 0) > limit:
            groups.append([])
        groups[-1].append(b)
    for group in groups:
        rows = counted.where(last.isin(group)).toArrow()
        mask = np.zeros(256, bool)
        mask[group] = True
        yield grow(rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy(), symbols, mask)


def _text_scores(data: np.ndarray, offsets: np.ndarray, tree: Tree) -> np.ndarray:
    symbols, begin = spelled(LOWER[data], offsets)
    if len(begin) < 2:
        return np.zeros(0)
    logs = tree.score(grams(symbols))
    logs[~_targets(begin, len(symbols))] = 0
    return np.add.reduceat(logs, begin[:-1] - DEPTH) / np.log(10)


# ---- the operator -----------------------------------------------------------------------------------------------------------

_SCORED = "doc long, held_out boolean, mark long, n_tokens long, n_known long, base_score double, score double"


def _scored(texts: pa.Table, words: pa.Table, tree: Broadcast, train: int, kinds: int, total: int) -> pa.Table:
    """Score the texts of a chunk with the counts of its words."""
    keys, n = words.column("word").to_numpy().view(np.uint64), words.column("n").to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    base = lambda c: np.log10((c + 1.0) / (total + kinds + 1))
    out = []
    for batch in texts.to_batches():
        for some in pieces(batch, limit=_PIECE):
            data, offsets = text_buffer(some.column(some.schema.get_field_index("text")))
            starts, ends, first = word_spans(data, offsets)
            h = span_hashes(LOWER[data], starts, ends)
            count = np.zeros(len(h), dtype=np.int64)
            if len(h):
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                if not len(keys) or (keys[at] != h).any():
                    raise RuntimeError("the input was partitioned in another way when its words were listed")
                count = n[at]
            known = np.concatenate([[0], np.cumsum(count > 0)])
            sums = np.concatenate([[0.0], np.cumsum(base(count))])
            out.append(pa.table({
                "doc": some.column(some.schema.get_field_index("doc")), "held_out": some.column(some.schema.get_field_index("held")),
                "mark": some.column(some.schema.get_field_index("mark")), "n_tokens": pa.array(np.diff(first) + 1), "n_known": pa.array(known[first[1:]] - known[first[:-1]] + (train > 0)),
                "base_score": pa.array(sums[first[1:]] - sums[first[:-1]] + base(train)), "score": pa.array(_text_scores(data, offsets, tree.value))}))
    release()
    return pa.concat_tables(out)


def _shares(docs: DataFrame) -> int:
    """Chunks per input partition, by the size that the session gives partitions."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", docs.sparkSession.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return max(1, (int(number) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}[unit]) // CHUNK)


def score(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    spark = docs.sparkSession
    held = held_out(F.col("doc_id"))
    text = F.coalesce("text", F.lit("")).alias("text")
    counted = stored(docs.where(~held).select(text).mapInArrow(released(_count_grams), _COUNTED).groupBy("gram").agg(F.sum("n").alias("n")), "grams")

    # A chunk is an input partition, or a share of one where partitions are large. Reading the same files with the same settings
    # cuts them alike; a word that is missing in the end stops the job.
    share = _shares(docs)
    chunk = (F.spark_partition_id() * share + F.pmod(F.xxhash64("doc_id"), F.lit(share)).cast("int")).alias("chunk")
    listed = docs.select(chunk, held.alias("held"), text).mapInArrow(released(_list_words), "chunk int, word long, n long")
    words = stored(listed.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list("chunk").alias("chunks")), "words")  # a chunk lists a word once
    whole = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("n") > 0, 1)), F.lit(0)).alias("kinds")).first()
    train = docs.where(~held).count()
    total, kinds = whole["n"] + train, whole["kinds"] + (1 if train else 0)
    asked = words.select(F.explode("chunks").alias("chunk"), "word", "n")

    mark = F.xxhash64("text").alias("mark")
    rows = docs.select(chunk, F.col("doc_id").cast("long").alias("doc"), held.alias("held"), mark, text)
    parts = trees(counted, limit)
    tree = spark.sparkContext.broadcast(next(parts))
    found = rows.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(lambda t, w: _scored(t, w, tree, train, kinds, total), _SCORED)
    for more in parts:  # further parts of the tree: one more pass each
        other = spark.sparkContext.broadcast(more)

        def partial(batches: Iterator[pa.RecordBatch], other: Broadcast = other) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in pieces(batch, limit=_PIECE):
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(_text_scores(*text_buffer(some.column(2)), other.value))], names=["doc", "mark", "more"])

        extra = rows.select("doc", "mark", "text").mapInArrow(released(partial), "doc long, mark long, more double").dropDuplicates(["doc", "mark"])
        extra = stored(extra, "scores").withColumnsRenamed({"doc": "_doc", "mark": "_mark"})
        found = found.join(extra, F.expr("doc <=> _doc and mark = _mark")).withColumn("score", F.col("score") + F.col("more")).drop("more", "_doc", "_mark")
    return found.select(F.col("doc").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
