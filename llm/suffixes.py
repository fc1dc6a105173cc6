"""Suffix-array deduplication of byte strings with a logarithmic index family.

A byte goes if a 200-byte string that covers it also starts anywhere else. The work is cut down before any suffix is sorted:

1. Each text is read once and gives its digests and anchors: the places where the smallest hash of ``GRAM`` consecutive bytes of
   some 200-byte window lies (about one byte in sixty). Equal windows have equal anchors, so a window whose anchor occurs once
   occurs once. Equal texts are one class, removed whole; one text of it stands for the rest.
2. Texts with repeated anchors are read again. Consecutive windows on one anchor form a run; runs with equal bytes are one
   snippet with a count, and a snippet that occurs twice repeats in all its windows.
3. Snippets that occur once, with the other snippets on their anchor, are dealt out by anchor. In a task they arrive in batches;
   each batch gets a suffix array (prefix doubling, order by the first 200 bytes), is merge-scanned against the levels that exist
   for matches of 200 bytes, and then levels of equal rank merge, so that a task with n batches holds at most log2(n) + 1 levels.
   An anchor with very many different snippets (the edges of a passage that a large share of documents holds) is not
   dealt to one task: its windows are compared by 128-bit hashes, counted with partial aggregation.
4. Repeated windows merge into spans, which are cut out.

Edge cases: null and empty texts have no bytes; texts under 200 bytes are left alone; equal rows are repeats of one another
whatever their ids; different texts under one id (or a null one, which counts as -1) are different texts. Cutting is by bytes, so kept bytes need not be valid UTF-8. An empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import partitions, stored
from llm.textops import halves, pieces, released, run_hashes, runs_within, sliding_min, span_hashes, text_buffer

WINDOW = 200
GRAM = 80
#: Windows in a run at most.
RUN = 128
#: Different snippets on an anchor beyond which its windows are counted instead of sorted in one task.
HOT = 256
#: Bytes of a batch of the index family.
BATCH = 1 << 20
#: Bytes of snippets from which a new family begins at the next anchor.
FRESH = 4 << 20
_PIECE = 1 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()
_READ = "doc long, n_bytes long, sha string, h1 long, h2 long, anchors array<long>"


# ---- the index family -------------------------------------------------------------------------------------------------------


class Level:
    """Windows of a text in the order of their bytes. ``ids`` are the callers' numbers of the windows."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, ids: np.ndarray, rank: int = 0) -> None:
        self.text, self.starts, self.ids, self.rank = text, starts, ids, rank
        wide = np.concatenate([text, np.zeros(7, np.uint8)])
        self.words = np.zeros(len(text), dtype=np.uint64)  # eight bytes from each place on, first byte highest
        for k in range(8):
            self.words = (self.words << np.uint64(8)) | wide[k : k + len(text)]


def suffix_array(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows at ``starts`` by their bytes, and which of them (in that order) equal the one before."""
    level = Level(text, starts, starts)
    rank, have = np.unique(level.words, return_inverse=True)[1].astype(np.uint64), 8
    while have * 2 <= WINDOW:  # prefix doubling: ranks by 16, 32, 64, 128 bytes
        n = len(rank) - have
        if n <= 0:
            break
        rank, have = np.unique((rank[:n] << np.uint64(32)) | rank[have : have + n], return_inverse=True)[1].astype(np.uint64), have * 2
    key = (rank[starts] << np.uint64(32)) | rank[starts + (WINDOW - have)]
    order = np.argsort(key, kind="stable")
    key = key[order]
    equal = np.zeros(len(key), bool)
    equal[1:] = key[1:] == key[:-1]
    return order, equal


def locate(level: Level, text: Level, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``text`` its place in the level's order (after smaller ones), and whether an equal one is there."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(level.starts), np.int64)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) // 2
        less = _less(level, level.starts[mid], text, starts[open_])
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
        open_ = open_[low[open_] < high[open_]]
    found = np.zeros(len(starts), bool)
    inside = np.flatnonzero(low < len(level.starts))
    found[inside] = _same(level, level.starts[low[inside]], text, starts[inside])
    return low, found


def _less(a: Level, i: np.ndarray, b: Level, j: np.ndarray) -> np.ndarray:
    out, tied = np.zeros(len(i), bool), np.arange(len(i))
    for k in range(0, WINDOW, 8):
        x, y = a.words[i[tied] + k], b.words[j[tied] + k]
        out[tied] = x < y
        tied = tied[x == y]
        if not len(tied):
            break
    return out


def _same(a: Level, i: np.ndarray, b: Level, j: np.ndarray) -> np.ndarray:
    out = np.ones(len(i), bool)
    for k in range(0, WINDOW, 8):
        at = np.flatnonzero(out)
        out[at] = a.words[i[at] + k] == b.words[j[at] + k]
    return out


class Family:
    """Levels of geometrically growing size; ``repeated`` tells of every window whether another equals it."""

    def __init__(self) -> None:
        self.levels: list[Level] = []
        self.repeated = np.zeros(0, bool)

    def add(self, text: np.ndarray, starts: np.ndarray) -> None:
        """Index a batch: window ids go on from those before."""
        ids = len(self.repeated) + np.arange(len(starts))
        self.repeated = np.concatenate([self.repeated, np.zeros(len(starts), bool)])
        if not len(starts):
            return
        order, equal = suffix_array(text, starts)
        new = Level(text, starts[order], ids[order])
        self.repeated[new.ids[equal]] = True
        self.repeated[new.ids[:-1][equal[1:]]] = True
        for level in self.levels:
            self._scan(level, new)
        while self.levels and self.levels[-1].rank == new.rank:
            new = self._merged(self.levels.pop(), new)
        self.levels.append(new)

    def _scan(self, level: Level, new: Level) -> None:
        at, found = locate(level, new, new.starts)
        self.repeated[new.ids[found]] = True
        self.repeated[level.ids[at[found]]] = True

    @staticmethod
    def _merged(a: Level, b: Level) -> Level:
        at, _ = locate(a, b, b.starts)
        return Level(np.concatenate([a.text, b.text]), np.insert(a.starts, at, b.starts + len(a.text)), np.insert(a.ids, at, b.ids), a.rank + 1)


class _Search:
    """A family and the snippets it holds, in batches."""

    def __init__(self) -> None:
        self.family, self.held, self.size, self.total = Family(), [], 0, 0
        self.keys: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # per batch: s1, s2, n, windows

    def add(self, some: pa.RecordBatch) -> None:
        self.held.append(some)
        more = len(text_buffer(_column(some, "snippet"))[0])
        self.size, self.total = self.size + more, self.total + more
        if self.size >= BATCH:
            self.index()

    def index(self) -> None:
        if not self.held:
            return
        table = pa.Table.from_batches(self.held).combine_chunks()
        data, offsets = text_buffer(table.column("snippet"))
        windows = np.diff(offsets) - (WINDOW - 1)
        starts = np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        self.family.add(data, starts)
        self.keys.append((table.column("s1").to_numpy(), table.column("s2").to_numpy(), table.column("n").to_numpy(), windows))
        self.held, self.size = [], 0

    def results(self) -> Iterator[pa.RecordBatch]:
        self.index()
        done = 0
        for s1, s2, n, windows in self.keys:
            hit = self.family.repeated[done : done + windows.sum()]
            done += windows.sum()
            owner = np.repeat(np.arange(len(n)), windows)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            hit = hit & (n[owner] == 1)
            begin = hit.copy()  # runs of repeated windows
            begin[1:] &= ~(hit[:-1] & (owner[1:] == owner[:-1]))
            first = np.flatnonzero(begin)
            length = np.add.reduceat(hit, first).astype(np.int32) if len(first) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(s1[owner[first]]), pa.array(s2[owner[first]]), pa.array(place[first].astype(np.int32)), pa.array(length)], names=["s1", "s2", "skip", "windows"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Snippets, sorted by anchor, to the windows in them that repeat; snippets that occur twice are only looked at as partners.

    Equal windows have equal anchors, so beyond ``FRESH`` bytes a new family begins at the next anchor.
    """
    search, last = _Search(), None
    for batch in batches:
        for some in pieces(batch, "snippet", BATCH // 4):
            anchor = _column(some, "anchor").to_numpy()
            if search.total >= FRESH:
                fresh = 0 if anchor[0] != last else int(np.argmax(anchor != last)) if (anchor != last).any() else -1
                if fresh >= 0:
                    if fresh:
                        search.add(some.slice(0, fresh))
                    yield from search.results()
                    search, some = _Search(), some.slice(fresh)
            search.add(some)
            last = anchor[-1]
    yield from search.results()


# ---- reading texts ----------------------------------------------------------------------------------------------------------


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _digests(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = memoryview(np.ascontiguousarray(data))
    return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all grams, windows that lie in one text, and the anchor of each."""
    grams = run_hashes(data.astype(np.uint64) + np.uint64(1), GRAM) | np.uint64(1)
    at = np.flatnonzero(runs_within(offsets, WINDOW, len(data)))
    return grams, at, sliding_min(grams, WINDOW - GRAM + 1)[at] if len(at) else grams[:0]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reach = WINDOW - GRAM + 1
    for batch in batches:
        for some in pieces(batch, limit=_PIECE):
            data, offsets = text_buffer(some.column(1))
            grams, at, anchor = _anchored(data, offsets)
            places = np.zeros(0, np.int64)
            if len(at):  # a place is an anchor if some window on it has no smaller gram
                m = np.zeros(len(grams) + reach - 1, dtype=np.uint64)
                m[at + reach - 1] = anchor
                places = np.flatnonzero(~sliding_min(~m, reach) == grams)
            sha = _digests(data, offsets)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.diff(offsets)), pa.array(sha), *halves(sha), _lists(grams[places], np.searchsorted(places, offsets))],
                                             names=["doc", "n_bytes", "sha", "h1", "h2", "anchors"])


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _contested(some: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts, and the windows on one of their listed anchors, with anchor and owner."""
    data, offsets = text_buffer(_column(some, "text"))
    _, at, anchor = _anchored(data, offsets)
    own = np.searchsorted(offsets, at, side="right") - 1
    wanted = _column(some, "anchors")
    lists, values = wanted.offsets.to_numpy(), wanted.values.to_numpy().view(np.uint64)
    bounds, hit = np.searchsorted(own, np.arange(len(offsets))), np.zeros(len(at), bool)
    for d in range(len(offsets) - 1):
        hit[bounds[d] : bounds[d + 1]] = np.isin(anchor[bounds[d] : bounds[d + 1]], values[lists[d] : lists[d + 1]])
    return data, offsets, at[hit], anchor[hit], own[hit]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in pieces(batch, limit=_PIECE):
            data, offsets, at, anchor, own = _contested(some)
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
            first = np.flatnonzero(new)
            if len(first):  # long runs (periodic text) are cut
                place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                first = np.flatnonzero(place % RUN == 0)
            windows = np.diff(np.append(first, len(at)))
            start = at[first]
            s1, s2 = (span_hashes(data, start, start + windows + (WINDOW - 1), w).view(np.int64) for w in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[first].view(np.int64)), pa.array(s1), pa.array(s2), _column(some, "rep").take(pa.array(own[first])), pa.array((start - offsets[own[first]]).astype(np.int32)), pa.array(windows.astype(np.int32))],
                names=["anchor", "s1", "s2", "rep", "start", "windows"])


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in pieces(batch, limit=_PIECE):
            data, offsets, at, _, own = _contested(some)
            w1, w2 = (span_hashes(data, at, at + WINDOW, w).view(np.int64) for w in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), _column(some, "rep").take(pa.array(own)), pa.array((at - offsets[own]).astype(np.int32))], names=["w1", "w2", "rep", "start"])


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the listed runs of each text."""
    for batch in batches:
        for some in pieces(batch):
            data, offsets = text_buffer(_column(some, "text"))
            runs = _column(some, "runs")
            flat, owner = runs.values, np.repeat(np.arange(some.num_rows), np.diff(runs.offsets.to_numpy()))
            flat = flat.slice(runs.offsets[0].as_py(), len(owner))
            start = offsets[owner] + flat.field("start").to_numpy()
            raw, end = data.tobytes(), start + flat.field("windows").to_numpy() + WINDOW - 1
            cut = pa.array([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([flat.field("anchor"), flat.field("s1"), flat.field("s2"), flat.field("n"), cut], names=["anchor", "s1", "s2", "n", "snippet"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in pieces(batch):
            data, offsets = text_buffer(_column(some, "text"))
            spans = _column(some, "spans")
            flat, owner = spans.values, np.repeat(np.arange(some.num_rows), np.diff(spans.offsets.to_numpy()))
            flat = flat.slice(spans.offsets[0].as_py(), len(owner))
            start, windows = offsets[owner] + flat.field("start").to_numpy(), flat.field("windows").to_numpy()
            delta = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(delta, start, 1)
            np.add.at(delta, start + windows + WINDOW - 1, -1)
            gone = np.cumsum(delta[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edge = offsets[:-1][offsets[:-1] < offsets[1:]]
            begins[edge] = gone[edge]
            c, b = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
            kept = data[~gone]
            sha = _digests(kept, offsets - c[offsets])
            yield pa.RecordBatch.from_arrays([_column(some, "rep"), pa.array(c[offsets[1:]] - c[offsets[:-1]]), pa.array(b[offsets[1:]] - b[offsets[:-1]]), pa.array(sha)],
                                             names=["rep", "cut", "cut_spans", "cut_sha"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    read = stored(rows.mapInArrow(released(_read), _READ), "byte-texts")
    # Equal texts have equal anchors, so any row's will do.
    classes = read.where(F.col("n_bytes") >= WINDOW).groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.first("sha").alias("sha"), F.count(F.lit(1)).alias("members"), F.first("anchors").alias("anchors"))
    # A class has a number of its own (fixed by storing it): ids may be null or repeated.
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "byte-classes")
    own = classes.select("rep", "doc", "sha", "members", F.explode("anchors").alias("anchor"))
    # An anchor matters if it occurs twice, and not only in texts that are removed whole anyway.
    again = own.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("members").alias("least")).where("n > 1 and least = 1")
    wanted = own.join(stored(again.select("anchor"), "anchors"), "anchor").groupBy("rep", "doc", "sha").agg(F.collect_set("anchor").alias("anchors"))  # at most a text's own
    texts = rows.withColumn("sha", F.sha2("text", 256)).alias("r").join(stored(wanted, "anchored").alias("w"), F.expr("r.doc <=> w.doc and r.sha = w.sha")).select("rep", "anchors", "text")
    texts = stored(texts, "anchored-texts")
    runs = stored(texts.select("rep", "anchors", "text").mapInArrow(released(_runs), "anchor long, s1 long, s2 long, rep long, start int, windows int"), "runs")
    snippets = runs.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min("anchor").alias("anchor"), F.min(F.struct("rep", "start")).alias("at"), F.min("windows").alias("windows"))
    snippets = stored(snippets, "snippets")
    mixed = stored(snippets.groupBy("anchor").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("kinds")).where("least = 1").select("anchor", "kinds"), "mixed-anchors")

    listed = snippets.join(mixed.where(F.col("kinds") <= HOT).select("anchor"), "anchor")
    listed = listed.groupBy(F.col("at.rep").alias("rep")).agg(F.collect_list(F.struct(F.col("at.start").alias("start"), "windows", "anchor", "s1", "s2", "n")).alias("runs"))
    cut = texts.select("rep", "text").join(listed, "rep").mapInArrow(released(_snippets), "anchor long, s1 long, s2 long, n long, snippet binary")
    dealt = cut.repartition(partitions(docs.sparkSession), "anchor").sortWithinPartitions("anchor")
    searched = stored(dealt.mapInArrow(released(_searched), "s1 long, s2 long, skip int, windows int"), "matches")

    hot = mixed.where(F.col("kinds") > HOT).select("anchor")
    hot = texts.select("rep", F.explode("anchors").alias("anchor")).join(hot, "anchor").groupBy("rep").agg(F.collect_list("anchor").alias("anchors"))
    dense = stored(texts.select("rep", "text").join(hot, "rep").select("rep", "anchors", "text").mapInArrow(released(_dense), "w1 long, w2 long, rep long, start int"), "hot-windows")
    twice = stored(dense.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2"), "hot-repeats")

    full = runs.join(snippets.where("n > 1").select("s1", "s2"), ["s1", "s2"]).select("rep", "start", "windows")
    part = runs.select("s1", "s2", "rep", "start").join(searched, ["s1", "s2"]).select("rep", (F.col("start") + F.col("skip")).alias("start"), "windows")
    single = dense.join(twice, ["w1", "w2"]).select("rep", "start", F.lit(1).alias("windows"))
    spans = full.unionByName(part).unionByName(single).groupBy("rep").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))  # at most a text's own
    cuts = texts.select("rep", "text").join(spans, "rep").mapInArrow(released(_cut), "rep long, cut long, cut_spans long, cut_sha string")
    found = stored(classes.select("rep", "h1", "h2", "members").join(stored(cuts, "cuts").dropDuplicates(["rep"]), "rep", "left").drop("rep"), "byte-results")
    out = read.drop("anchors").join(found, ["h1", "h2"], "left")
    copy = F.coalesce(F.col("members") > 1, F.lit(False))
    return out.select(
        F.col("doc").alias("doc_id"), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("cut_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"))
