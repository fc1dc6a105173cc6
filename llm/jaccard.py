"""N-gram Jaccard join with Bayesian pruning.

Word 5-gram sets, similarity 0.8 or more. Documents with equal sets are one representative with a count, under a number of its own:
doc_ids may be null or repeated, so they only order and name classes. Representatives that
share a band of MinHash values (40 bands of 5: a pair at 0.8 shares none with probability 1.3e-7) meet in a bucket, where their
signatures are compared a few values at a time: a pair is dropped as soon as the posterior probability that it reaches the
threshold (uniform prior) is below ``TOLERANCE``. What survives joins documents into candidate groups, and within each group every
pair is verified exactly on the whole sets, in tiles of two blocks.

No pair is ever a row: a bucket or tile returns a star per connected part and link counts. Buckets and groups larger than a block
are cut into pairs of blocks, so no task holds a whole hot bucket. Within a bucket pairs that are joined already are not compared
again, which keeps thousands of near copies cheap.

Edge cases: null and empty texts have no set and link with nothing; a text of one to four words has one n-gram, all its words;
repeated rows link with one another; a null doc_id counts as -1. Different texts under one doc_id are different documents. An empty
table gives no rows. Extra columns are ignored by :func:`join` and kept by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import components, partitions, stars, stored
from llm.textops import mixed, pieces, released, run_hashes, runs_within, span_hashes, text_buffer, word_spans

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
#: Signature values looked at before each pruning decision.
ROUNDS = (20, 40, 80, 120, HASHES)
TOLERANCE = 1e-7
BUCKET, TILE = 512, 256
_DRAWS = np.random.default_rng(20240229).integers(0, 1 << 32, (2, HASHES), dtype=np.uint64)
_A, _B = (_DRAWS[0] | np.uint64(1)).astype(np.uint32), _DRAWS[1].astype(np.uint32)
_SIGNED = "doc long, digest binary, n int, h1 long, h2 long, sig binary, bands array<long>"


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each round the fewest equal signature bytes with which a pair may still reach the threshold.

    With m of n equal and a uniform prior, the chance p of equal bytes has a Beta(m + 1, n - m + 1) posterior, and
    P(p >= t) = P(Binomial(n + 1, t) <= m). Bytes of different values agree once in 256, which raises t a little.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in ROUNDS:
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all documents end to end, and their offsets."""
    starts, ends, first = word_spans(data, offsets)
    docs = len(offsets) - 1
    h = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    ok = runs_within(first, words, len(h))
    at = np.flatnonzero(ok)
    grams = run_hashes(h, words)[at]
    owner = np.searchsorted(first, at, side="right") - 1
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        own = [run_hashes(h[first[d] : first[d + 1]], int(count[d]), 1)[0] for d in short.tolist()]
        grams, owner = np.concatenate([grams, np.array(own, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(docs + 1))


def minhashes(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``HASHES`` values per document; documents without n-grams get the largest value."""
    out = np.full((len(offsets) - 1, HASHES), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    begin = 0
    while begin < len(full):  # blocks that stay in the processor's cache
        end = max(begin + 1, int(np.searchsorted(offsets[full], offsets[full[begin]] + (1 << 15), side="right")))
        rows = full[begin:end]
        low, high = offsets[rows[0]], offsets[rows[-1] + 1]
        x = (grams[low:high] >> np.uint64(32)).astype(np.uint32)
        cuts = offsets[rows] - low
        v, block = np.empty_like(x), np.empty((HASHES, len(rows)), dtype=np.uint32)
        for k in range(HASHES):
            np.multiply(x, _A[k], out=v)
            np.add(v, _B[k], out=v)
            block[k] = np.minimum.reduceat(v, cuts)
        out[rows] = block.T
        begin = end
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in pieces(batch):
            grams, offsets = shingles(*text_buffer(some.column(2)))
            mins = minhashes(grams, offsets)
            n = np.diff(offsets)
            sums = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                c = np.zeros(len(grams) + 1, dtype=np.uint64)
                np.cumsum(mixed(grams ^ np.uint64(salt)), out=c[1:])
                sums.append((c[offsets[1:]] - c[offsets[:-1]]).view(np.int64))
            sig = ((mins * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            key = np.zeros((len(n), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for r in range(ROWS):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + mins[:, r::ROWS][:, :BANDS])
            flat = key.view(np.int64).reshape(-1)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
            sigs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.arange(0, sig.size + 1, HASHES, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(sig))])
            out = pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(n.astype(np.int32)), pa.array(sums[0]), pa.array(sums[1]), sigs, bands], names=["doc", "digest", "n", "h1", "h2", "sig", "bands"])
            yield out


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups of a sorted partition, several small groups together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        cols = [whole.column(k).to_numpy() for k in keys]
        same = np.logical_and.reduce([c == c[-1] for c in cols])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield whole.slice(0, cut)
            held = whole.slice(cut).to_batches()
        else:
            held = whole.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    cols = [table.column(k).to_numpy() for k in keys]
    new = np.ones(table.num_rows, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return new


def _survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs pass all rounds."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), dtype=np.int32), 0
    for upto, need in zip(ROUNDS, least, strict=True):
        matches[alive] += (sig[a[alive], done:upto] == sig[b[alive], done:upto]).sum(axis=1, dtype=np.int32)
        alive, done = alive[matches[alive] >= need], upto
    return alive


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets to stars of pairs that may reach the threshold."""
    least = least_matches()
    for table in _runs(batches, ["key", "i", "j"], 20_000):
        group = np.cumsum(_changes(table, ["key", "i", "j"]))
        rep, local = np.unique(table.column("rep").to_numpy(), return_inverse=True)
        data, _ = text_buffer(table.column("sig"))
        row = np.zeros(len(rep), dtype=np.int64)
        row[local] = np.arange(len(local))
        sig = data.reshape(-1, HASHES)[row]
        label = np.arange(len(rep))
        one, d = np.arange(len(local)), 1
        links: list[tuple[np.ndarray, np.ndarray]] = []
        while len(one):
            one = one[one + d < len(local)]
            one = one[group[one] == group[one + d]]
            found = False
            for k in range(0, len(one), 1 << 16):
                a, b = local[one[k : k + (1 << 16)]], local[one[k : k + (1 << 16)] + d]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                keep = _survivors(sig, a, b, least)
                if len(keep):
                    links.append((a[keep], b[keep]))
                    found = True
            if found:
                s, t = stars(len(rep), np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
                label = np.arange(len(rep))
                label[s] = t
                links = [(s, t)]
            d += 1
        s = np.flatnonzero(label != np.arange(len(rep)))
        yield pa.RecordBatch.from_arrays([pa.array(rep[s]), pa.array(rep[label[s]])], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in pieces(batch):
            grams, offsets = shingles(*text_buffer(some.column(some.schema.get_field_index("text"))))
            own = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(grams.view(np.int64)))
            rest = [some.column(some.schema.get_field_index(c)) for c in ("component", "rep", "members", "size")]
            new = np.ones(some.num_rows, bool)  # repeated rows are neighbours and give one set
            new[1:] = np.diff(rest[1].to_numpy()) != 0
            out = pa.RecordBatch.from_arrays([*rest, own], names=["component", "rep", "members", "size", "grams"])
            yield out.filter(pa.array(new))


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Tiles of a candidate group to link counts and stars, by exact intersections."""
    for table in _runs(batches, ["component", "i", "j"], 2_000):
        bounds = [*np.flatnonzero(_changes(table, ["component", "i", "j"])).tolist(), table.num_rows]
        rep_, members_, block_, i_, j_ = (table.column(c).to_numpy() for c in ("rep", "members", "block", "i", "j"))
        lists = table.column("grams").combine_chunks()
        offs = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            rep, where = np.unique(rep_[begin:end], return_index=True)
            if len(rep) < 2:
                continue
            rows = begin + where
            members, block, i, j = members_[rows], block_[rows], i_[begin], j_[begin]
            size = offs[rows + 1] - offs[rows]
            owner = np.repeat(np.arange(len(rep)), size)
            vals = np.concatenate([values[offs[r] : offs[r + 1]] for r in rows.tolist()])
            _, which, times = np.unique(vals, return_inverse=True, return_counts=True)
            shared = times > 1
            number = np.cumsum(shared) - 1
            keep = shared[which]
            owner, which = owner[keep], number[which[keep]]
            common = np.zeros((len(rep), len(rep)), dtype=np.float32)
            order = np.argsort(which, kind="stable")
            owner, which = owner[order], which[order]
            for low in range(0, int(shared.sum()), 4096):
                a, b = np.searchsorted(which, [low, low + 4096])
                has = np.zeros((len(rep), 4096), dtype=np.float32)
                has[owner[a:b], which[a:b] - low] = 1
                common += has @ has.T
            common = common.astype(np.float64)
            near = common / np.maximum(size[:, None] + size[None, :] - common, 1) >= threshold
            p, q = np.nonzero(np.triu(near, 1))
            if i != j:  # pairs inside one block belong to that block's own tile
                cross = block[p] != block[q]
                p, q = p[cross], q[cross]
            count = np.bincount(p, members[q], len(rep)) + np.bincount(q, members[p], len(rep))
            has = np.flatnonzero(count)
            s, t = stars(len(rep), p, q)
            out.append((rep[has], np.zeros(len(has), np.int64), count[has].astype(np.int64), np.zeros(len(has), bool)))
            out.append((rep[s], rep[t], np.zeros(len(s), np.int64), np.ones(len(s), bool)))
        if out:
            a, b, n, edge = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=~edge), pa.array(n, mask=edge)], names=["a", "b", "links"])


def _tiled(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Deal the rows of each group into blocks and copy each to the tiles of its block with every block of the group."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(group)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", size)
    return dealt.repartition(partitions(rows.sparkSession), group, "i", "j").sortWithinPartitions(group, "i", "j")


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))


def _digest() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """doc, digest, n, members, links for every row, and in ``first`` the smallest (doc, digest) of its class (null if n is 0)."""
    rows = docs.select(_doc().alias("doc"), _digest().alias("digest"), "text")
    signed = stored(rows.mapInArrow(released(_signed), _SIGNED), "signatures")
    # Equal sets have equal signatures, so any will do. The numbers are fixed by storing them.
    reps = signed.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct("doc", "digest")).alias("at"), F.count(F.lit(1)).alias("members"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "shingle-sets")
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    crowded = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    own = keyed.join(crowded, "key").groupBy("rep").agg(F.collect_list(F.struct("key", "size")).alias("in"))  # at most one entry per band
    entries = reps.select("rep", "sig").join(own, "rep").select("rep", "sig", F.explode("in").alias("e")).select("rep", "sig", "e.key", "e.size")
    candidates = _tiled(entries, "key", "size", BUCKET).select("key", "i", "j", "rep", "sig").mapInArrow(released(_buckets), "a long, b long")
    groups = stored(components(candidates), "candidate-groups")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = stored(reps.select("rep", "members", "at.doc", "at.digest").join(groups.withColumnRenamed("id", "rep"), "rep").join(stored(sizes, "group-sizes"), "component"), "members")
    # A merge join at every size: whether the few members fit a broadcast must not decide the plan.
    sets = rows.join(members.hint("merge"), ["doc", "digest"]).select("component", "rep", "members", "size", "text").mapInArrow(
        released(_sets), "component long, rep long, members long, size long, grams array<long>")
    verified = _tiled(sets, "component", "size", TILE).mapInArrow(released(lambda it: _verified(it, threshold)), "a long, b long, links long")
    verified = stored(verified, "links")
    links = verified.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = components(verified.where("b is not null").select("a", "b")).withColumnRenamed("id", "rep")
    parts = stored(reps.select("rep", "at").join(parts, "rep"), "parts")
    first = stored(parts.groupBy("component").agg(F.min("at").alias("first")), "firsts")
    parts = parts.select("rep", "component").join(first, "component").select("rep", "first")
    found = reps.select("h1", "h2", "rep", "members", "at").join(links, "rep", "left").join(parts, "rep", "left")
    found = stored(found.select("h1", "h2", "members", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("first", "at").alias("first")), "classes")
    return signed.select("doc", "digest", "n", "h1", "h2").join(found, ["h1", "h2"], "left").drop("h1", "h2")


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links, kept for every document.

    n_links counts the other documents with similarity at or above the threshold; class_id is the smallest doc_id reachable by
    links; kept is true for that document.
    """
    some = F.col("n") > 0
    number = F.when(some, F.col("members") - 1 + F.col("links")).otherwise(F.lit(0)).cast("long")
    class_ = F.when(some, F.col("first.doc")).otherwise(F.col("doc"))
    return _classes(docs, threshold).select(F.col("doc").alias("doc_id"), class_.alias("class_id"), number.alias("n_links"), (class_ == F.col("doc")).alias("kept"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with all columns of ``docs``: the one with the smallest doc_id, and of several texts under that
    id the one with the smallest digest. Texts without words are classes of their own; of repeated rows one stays."""
    stay = _classes(docs, threshold).where("n = 0 or (doc = first.doc and digest = first.digest)").select(F.col("doc").alias("__doc"), F.col("digest").alias("__digest")).distinct()
    keyed = docs.withColumn("__doc", _doc()).withColumn("__digest", _digest())
    one = F.row_number().over(Window.partitionBy("__doc", "__digest").orderBy("__doc"))
    return keyed.join(stay, ["__doc", "__digest"]).withColumn("__one", one).where("__one = 1").select(*docs.columns)
