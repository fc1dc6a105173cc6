"""Loosely typed scalars: numbers, flags, scores, times and clip ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotline.functions.text import strip

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def safe_double(value: Column) -> Column:
    """A timestamp-like string as DOUBLE; null when it is empty or no number."""
    return F.when(value.rlike(NUMBER), strip(value).try_cast("double"))


def loose_bool(value: Column, default: bool = False) -> Column:
    """Common spellings of a flag; anything else is the default."""
    text = F.lower(strip(value))
    return (
        F.when(text.isin("true", "yes", "1", "keep"), True)
        .when(text.isin("false", "no", "0", "", "reject"), False)
        .otherwise(F.lit(default))
    )


def truthy_bool(value: Column, default: bool = False) -> Column:
    """Spelling rules of the selection stage: any other non-empty string counts as true."""
    text = F.lower(strip(value))
    return (
        F.when(value.isNull(), F.lit(default))
        .when(text.isin("false", "no", "0", ""), False)
        .otherwise(F.lit(True))
    )


def loose_double(value: Column, default: Column | float = 0.0, signed: bool = True) -> Column:
    """First number inside a string; ``signed=False`` ignores a minus sign."""
    pattern = r"-?\d+(?:\.\d+)?" if signed else r"\d+(?:\.\d+)?"
    fallback = default if isinstance(default, Column) else F.lit(float(default))
    return F.coalesce(F.regexp_extract(value, pattern, 0).try_cast("double"), fallback)


def score(value: Column) -> Column:
    """A nullable score clamped to [0, 1]."""
    number = safe_double(value)
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def score_warning(value: Column) -> Column:
    return F.when(safe_double(value).isNull(), F.lit("invalid_expectedness_output"))


def clock(seconds: Column) -> Column:
    """Seconds as HH.MM.SS.mmm, rounded half-even to the millisecond."""
    ms = F.bround(seconds * 1000).cast("bigint")
    return F.format_string(
        "%02d.%02d.%02d.%03d",
        F.floor(ms / 3_600_000),
        F.pmod(F.floor(ms / 60_000), F.lit(60)),
        F.pmod(F.floor(ms / 1000), F.lit(60)),
        F.pmod(ms, F.lit(1000)),
    )


def make_clip_id(movie: Column, start: Column, end: Column, sequence_index: Column, explicit: Column) -> Column:
    """The given id, else sequence name with both times, else sequence name with the row number."""
    timed = F.concat(movie, F.lit("__"), F.replace(start, F.lit("."), F.lit("p")), F.lit("_"),
                     F.replace(end, F.lit("."), F.lit("p")))
    numbered = F.concat(movie, F.lit("__"), F.format_string("%05d", sequence_index))
    return (
        F.when(F.length(explicit) > 0, explicit)
        .when((F.length(start) > 0) & (F.length(end) > 0), timed)
        .otherwise(numbered)
    )


def clip_times(clip_id: Column) -> Column:
    """STRUCT(start, end) of time strings read back from a clip id; empty strings if there are none."""
    bits = F.split(F.coalesce(F.try_element_at(F.split(clip_id, "__"), F.lit(2)), F.lit("")), "_")
    stamps = F.when(F.size(bits) == 2, bits).otherwise(F.filter(bits, lambda b: b.rlike(r"^\d+p\d+$")))
    usable = F.size(stamps) >= 2

    def part(index: int) -> Column:
        return F.when(usable, F.replace(F.try_element_at(stamps, F.lit(index)), F.lit("p"), F.lit("."))).otherwise("")

    return F.struct(part(1).alias("start"), part(-1).alias("end"))
