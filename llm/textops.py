"""Vectorised text helpers for Arrow tasks: word spans, rolling hashes, sliding minima.

All functions work on one buffer of UTF-8 bytes that holds many documents end to end, with the offsets of the documents, so
the cost per document is a few numpy calls per *batch*, not per document or word.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space as the contracts define it: blank and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
#: For each of the two span hashes two primes below 2^31, and a base for each.
_FIELDS = (((2147483647, 1640531527), (2147483629, 1100585497)), ((2147483587, 1812433253), (2147483579, 1274126177)))
#: Bytes hashed at a time, and the length from which a span is digested instead.
BLOCK = 1 << 19
LONG = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_FIELD_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _doubled(size: int, step: int, modulus: int, kind: type) -> np.ndarray:
    """Powers of ``step``, by doubling: p[k:2k] = p[:k] * step^k."""
    p = np.empty(size, dtype=kind)
    p[0], filled = 1, 1
    while filled < size:
        take = min(filled, size - filled)
        more = p[:take].astype(np.uint64) * np.uint64(step)
        p[filled : filled + take] = more if modulus > _MASK else more % np.uint64(modulus)
        filled += take
        step = step * step % modulus
    return p


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least ``n`` of them."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = _BASES[which] | 1
        have = (_doubled(size, base, 1 << 64, np.uint64), _doubled(size, pow(base, -1, 1 << 64), 1 << 64, np.uint64))
        if size <= 2 * BLOCK:
            _POWERS[which] = have
    return have


def _field_powers(n: int, prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo a prime, at least ``n`` of them; ``n`` is at most ``BLOCK + LONG``."""
    have = _FIELD_POWERS.get((prime, base))
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = (_doubled(size, base, prime, np.uint32), _doubled(size, pow(base, -1, prime), prime, np.uint32))
        if size <= 2 * BLOCK:
            _FIELD_POWERS[prime, base] = have
    return have


def release() -> None:
    """Give memory of the ended task back: Python workers live on, and executors count it."""
    _POWERS.clear()
    _FIELD_POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a task, with :func:`release` at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Rabin-Karp hash of each span, starts ascending; equal bytes give equal hashes wherever they lie.

    A hash joins two residues modulo primes of 31 bits: a modulus of 2^64 would spare the division, but has texts that collide
    under every base. Prefix sums are taken over ``BLOCK`` bytes at a time; spans beyond ``LONG`` are digested.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    size = ends - starts
    for k in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.sha256(bytes([which]) + np.ascontiguousarray(data[starts[k] : ends[k]]).tobytes()).digest()
        out[k] = int.from_bytes(digest[:8], "little")
    short = np.flatnonzero(size <= LONG)
    begin = 0
    while begin < len(short):
        low = int(starts[short[begin]])
        some = short[begin : max(begin + 1, int(np.searchsorted(starts[short], low + BLOCK, side="right")))]
        begin += len(some)
        s, e = starts[some] - low, ends[some] - low
        n = int(e.max())
        values = data[low : low + n].astype(np.uint64) + np.uint64(1)
        parts = []
        for prime, base in _FIELDS[which]:
            power, inverse = _field_powers(n + 1, prime, base)
            c = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(values * power[:n], out=c[1:])  # terms below 2^40, so many that no sum leaves 64 bits
            parts.append((c[e] - c[s]) % np.uint64(prime) * inverse[s] % np.uint64(prime))
        out[some] = mixed((parts[0] << np.uint64(32)) | parts[1])
    return out


def run_hashes(values: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Rolling hash of each run of ``length`` consecutive 64-bit values, ``BLOCK`` runs at a time."""
    n = max(0, len(values) - length + 1)
    out = np.empty(n, dtype=np.uint64)
    for low in range(0, n, BLOCK):
        some = values[low : low + BLOCK + length - 1]
        runs = len(some) - length + 1
        pow_, inv = _powers(len(some) + 1, which)
        c = np.zeros(len(some) + 1, dtype=np.uint64)
        np.cumsum(some * pow_[: len(some)], out=c[1:])
        out[low : low + runs] = mixed((c[length:] - c[:runs]) * inv[:runs])
    return out


def sliding_min(values: np.ndarray, length: int) -> np.ndarray:
    """Minimum of each run of ``length`` values, by doubling."""
    n = len(values) - length + 1
    if n <= 0:
        return values[:0]
    m, have = values, 1
    while have * 2 <= length:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = length - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def halves(digests: list[str]) -> tuple[pa.Array, pa.Array]:
    """The first 128 bits of SHA-256 digests, as two keys."""
    raw = np.frombuffer(b"".join(bytes.fromhex(d[:32]) for d in digests), dtype="<i8").reshape(-1, 2)
    return pa.array(np.ascontiguousarray(raw[:, 0])), pa.array(np.ascontiguousarray(raw[:, 1]))


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes (one row at least), so that arrays stay small."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size, dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def text_lists(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of the batches and the bytes of their texts; null counts as empty."""
    for batch in batches:
        for some in pieces(batch, "text", limit):
            yield some, pc.fill_null(some.column(some.schema.get_field_index("text")), "").cast(pa.binary()).to_pylist()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document (and one past the last) the number of its first word."""
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    word = ~SPACE[data]
    edge = np.unique(offsets)
    start = word.copy()
    start[1:] &= ~word[:-1]
    at = edge[edge < len(data)]
    start[at] = word[at]
    end = word.copy()
    end[:-1] &= ~word[1:]
    at = edge[edge > 0] - 1
    end[at] = word[at]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def runs_within(first: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of the ``total - length + 1`` runs of words lie in one document; ``first`` as from :func:`word_spans`."""
    n = total - length + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    ok = np.ones(n, dtype=bool)
    for e in np.unique(first[(first > 0) & (first < total)]).tolist():
        ok[max(0, e - length + 1) : min(e, n)] = False
    return ok


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of ``n`` places covered by windows of ``length`` places at ``starts``."""
    delta = np.zeros(n + 1, dtype=np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + length, n), -1)
    return np.cumsum(delta[:n]) > 0
