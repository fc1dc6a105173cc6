"""Best-fit packing of tokenised documents into sequences of bounded length: best-two-fit.

Tasks tokenise the texts and cut longer documents; a piece is then a row of numbers. What packing needs of all pieces is how
many there are of each length (at most ``limit`` counts). On these counts bins are filled greedily with the longest piece that
fits; then the shortest piece of the bin is replaced with two unpacked ones that fill the widened gap better, as long as any do.
A bin is repeated as often as the counts allow, so the result is a short list of bin patterns, whatever the number of pieces.
Pieces find their place by their rank within their length.

Tokenising: a text falls into units at white space such that no token of the byte-level BPE crosses two units; each task encodes a
unit once and looks repeats up. Texts with white space beyond ASCII are encoded whole.

Edge cases: null text is empty and takes one token (the end); repeated rows are packed each on its own; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import ranked, stored
from llm.textops import SPACE, pieces, released, span_hashes, text_buffer

LIMIT = 2048
END = 0
#: Units that a task remembers before it starts over.
MEMORY = 1 << 20
#: Units encoded at a time, and bytes of text handled at a time.
AT_ONCE = 2048
PIECE = 1 << 20
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units start: a word takes the one blank before it; other white space stands alone, its last byte apart from the rest."""
    white = SPACE[data]
    begins = np.zeros(len(data), dtype=bool)
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    change = begins.copy()
    change[1:] |= white[1:] != white[:-1]
    start = change & white  # runs of white space
    words = np.flatnonzero(change & ~white)
    after = words[~begins[words]]  # white space goes before
    start[after - 1] = True
    start[words[begins[words]]] = True
    start[after[data[after - 1] != 0x20]] = True
    return np.flatnonzero(start)


def _wide_white(data: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII."""
    if len(data) < 2:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    pad = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = data[at], pad[at + 1], pad[at + 2]
    hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    hit |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    hit |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    hit |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    hit |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return at[hit]


class Encoder:
    """Token ids of many texts at once, with the units seen so far kept in sorted arrays."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._forget()

    def _forget(self) -> None:
        self.keys, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.array([END], dtype=np.uint32)  # place 0: the end

    def _learn(self, data: np.ndarray, keys: np.ndarray, check: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self.keys) > MEMORY:
            self._forget()
        raw, spans = data.tobytes(), list(zip(starts.tolist(), ends.tolist(), strict=True))
        sizes, flat = [], [self.ids]
        for k in range(0, len(spans), AT_ONCE):  # an encoding is much larger than its ids
            found = self.tokenizer.encode_batch([raw[s:e].decode() for s, e in spans[k : k + AT_ONCE]], add_special_tokens=False)
            ids = [e.ids for e in found]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.uint32))
        size = np.concatenate(sizes)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate(flat)
        keys, check, at, size = (np.concatenate(p) for p in ((self.keys, keys), (self.check, check), (self.at, at), (self.size, size)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.check, self.at, self.size = keys[order], check[order], at[order], size[order]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents end to end, each with the end id behind it, and their offsets."""
        docs = len(offsets) - 1
        starts = _starts(data, offsets)
        ends = np.append(starts[1:], len(data)).astype(np.int64)
        keys, check = span_hashes(data, starts, ends), span_hashes(data, starts, ends, 1)
        unique, first = np.unique(keys, return_index=True)
        if len(self.keys):
            near = np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)
            new = self.keys[near] != unique
        else:
            new = np.ones(len(unique), bool)
        if len(self.keys) > MEMORY:
            new[:] = True
        if new.any():
            at = first[new]
            self._learn(data, unique[new], check[at], starts[at], ends[at])
        owner = np.searchsorted(offsets, starts, side="right") - 1
        if len(starts):
            near = np.searchsorted(self.keys, keys)
            at, size = self.at[near], self.size[near]
            odd = set(owner[self.check[near] != check].tolist())  # two units with one key
        else:
            at, size, odd = np.zeros(0, np.int64), np.zeros(0, np.int64), set()
        behind = np.searchsorted(owner, np.arange(docs), side="right")
        at, size = np.insert(at, behind, 0), np.insert(size, behind, 1)
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(at - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
        bounds = np.concatenate([[0], upto[behind + np.arange(docs)]])
        odd |= set((np.searchsorted(offsets, _wide_white(data), side="right") - 1).tolist())
        if odd:
            parts = [ids[bounds[i] : bounds[i + 1]] for i in range(docs)]
            for i in odd:
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                parts[i] = np.asarray([*self.tokenizer.encode(text, add_special_tokens=False).ids, END], dtype=np.uint32)
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids.astype("<u4"), bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenised(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32. The first piece takes what the others leave."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for some in pieces(batch, limit=PIECE):
                data, offsets = text_buffer(some.column(1))
                ids, bounds = encode(data, offsets)
                n = np.diff(bounds)
                count = (n + limit - 1) // limit
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                head = n - (count - 1) * limit
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * limit)
                length = np.where(piece == 0, head[doc], limit)
                at = bounds[doc] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), _PIECES)


def _best_pair(left: list[int], count: list[int], room: int) -> tuple[int, int]:
    """The two lengths of ``left`` (ascending, with ``count``) whose sum comes closest to ``room`` from below."""
    best, pair, i, j = 0, (0, 0), 0, len(left) - 1
    while i <= j:
        a, b = left[i], left[j]
        if a + b > room or (i == j and count[a] < 2):
            j -= 1
        else:
            if a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            i += 1
    return pair


def patterns(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how often), for so many pieces of each length."""
    have = [0] * (limit + 1)
    for size, n in counts.items():
        have[size] = n
    left = sorted(s for s, n in counts.items() if n)
    out = []
    while left:
        bin_, gap, i = [], limit, len(left) - 1
        while i >= 0:
            size = left[i]
            if size > gap or have[size] == 0:
                i -= 1
                continue
            bin_.append(size)
            have[size] -= 1
            gap -= size
        while gap and len(bin_) > 1:
            last = bin_[-1]
            a, b = _best_pair([s for s in left if s < gap + last and have[s]], have, gap + last)
            if a + b <= last:
                break
            bin_[-1:] = sorted((a, b), reverse=True)
            have[a] -= 1
            have[b] -= 1
            have[last] += 1
            gap += last - a - b
            bin_.sort(reverse=True)
        times = min(have[s] // bin_.count(s) for s in set(bin_)) + 1
        for s in bin_:
            have[s] -= times - 1
        left = [s for s in left if have[s]]
        out.append((bin_, times))
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    spark = docs.sparkSession
    rows = stored(tokenised(docs, tokenizer, limit).withColumn("__doc", F.coalesce("doc_id", F.lit(-1))), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``limit`` rows
    slots, used, base = [], dict.fromkeys(counts, 0), 0
    for bin_, times in patterns(counts, limit):
        offset = 0
        for size in sorted(set(bin_), reverse=True):
            many = bin_.count(size)
            slots.append((size, used[size], used[size] + many * times, base, many, offset))
            used[size] += many * times
            offset += many * size
        base += times
    # The list of slots depends on ``limit`` only, not on the number of documents.
    slots = spark.createDataFrame(slots, "length long, low long, high long, base long, many long, at long")
    placed = ranked(rows, ["length"], ["__doc", "piece", "start"], "rank").join(F.broadcast(slots), "length").where("rank >= low and rank < high")
    place = F.col("rank") - F.col("low")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.floor(place / F.col("many"))).cast("long").alias("sequence_id"),
                         (F.col("at") + place % F.col("many") * F.col("length")).cast("long").alias("offset"))
