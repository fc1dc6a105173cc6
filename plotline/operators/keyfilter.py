"""A Bloom filter over 64-bit keys, built by an aggregation and tested as a Column before rows are shuffled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.session import durable

#: Bits a key, and probes of each, all in one word: few keys that are not in a small set pass, about one in two thousand at 40
#: bits. Large sets get fewer bits, never under ``LEAST_BITS`` a key: about one in fifty passes.
BITS, PROBES, LEAST_BITS = 128, 4, 10
#: Bits that small sets may grow to.
MOST_BITS = 1 << 25
#: Beyond so many keys there is no filter: its bits travel with every task.
MOST_KEYS = 8_000_000
#: Words that are put together at once when the row of all words is built, as a power of two.
BLOCK = 9


@dataclass(frozen=True)
class KeyFilter:
    words: DataFrame | str  # one row: the bits, 64 a number
    size: int  # number of bits, a power of two; 0: no filter

    def may_contain(self, key: Column) -> Column:
        """False only for keys that are not in the set. ``key`` is a 64-bit hash.

        The words come in as a subquery, so neither plans nor what is shown and logged of them hold any bits.
        """
        if self.size == 0:
            return F.lit(True)
        word, mask = F.get(self.words.scalar(), _word(key, self.size).cast("int")), _mask(key)
        # Most keys fail at the first bit, so the rest, for which the hash is worked out again, is not asked.
        return (F.getbit(word, _bit(key, 0)) == 1) & (word.bitwiseAND(mask) == mask)


def _word(key: Column, size: int) -> Column:
    return F.shiftrightunsigned(key, 1).bitwiseAND(F.lit(size // 64 - 1))


def _bit(key: Column, probe: int) -> Column:
    """Place of a bit in its word, from the upper bits of the hash, which do not choose the word."""
    return F.shiftrightunsigned(key, 64 - 6 * (probe + 1)).bitwiseAND(F.lit(63)).cast("int")


def _mask(key: Column) -> Column:
    """All bits of a key in its word."""
    mask = F.lit(0).cast("bigint")
    for i in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(key, i)))
    return mask


def key_filter(keys: DataFrame, key: str, most: int = MOST_KEYS) -> KeyFilter:
    """Filter of the distinct values of ``key``. Its words are put together in the tasks and stored as one row."""
    n = keys.select(F.approx_count_distinct(key).alias("n")).first()["n"]
    if n > most:
        return KeyFilter("", 0)
    size = 1 << max(6, int(max(min(n * BITS, MOST_BITS), n * LEAST_BITS) - 1).bit_length())
    every = keys.sparkSession.range(size // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    bits = keys.filter(F.col(key).isNotNull()).select(_word(F.col(key), size).alias("word"), _mask(F.col(key)).alias("bits"))
    words = bits.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def row(parts: DataFrame, at: str, value: str, *by: Column) -> DataFrame:
        return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda s: s[value]).alias(value))

    blocks = row(words, "word", "bits", F.shiftright("word", BLOCK).alias("block"))
    return KeyFilter(durable(row(blocks, "block", "bits").select(F.flatten("bits").alias("bits"))), size)
