"""Text normalisers, tokenisers and word sets as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotline.functions import domains as D

# Every code point Unicode counts as white space, spelled out so that all engines agree.
WHITESPACE = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
#: The same code points as a plain list.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TOKEN = r"[A-Za-z][A-Za-z']+"
WORD = r"[a-z']+"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """White-space runs become one blank; none is left at either end."""
    return F.trim(F.regexp_replace(text, WHITESPACE + "+", " "))


def normalize_text(text: Column) -> Column:
    """Straight quotes, single blanks, single line; null becomes the empty string."""
    return squeeze(F.translate(F.coalesce(text, F.lit("")), "’“”", "'\"\""))


def compare_key(text: Column) -> Column:
    """Key under which two texts count as the same wording."""
    return F.lower(squeeze(F.coalesce(text, F.lit(""))))


def lookup_key(text: Column) -> Column:
    """Looser key: possessive 's and everything but ASCII letters and digits are dropped."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bare = F.regexp_replace(low, r"(?<![\p{L}\p{N}_])([a-z0-9]+)'s(?![\p{L}\p{N}_])", "$1")
    # Most texts have no possessive and skip the costlier search.
    return F.regexp_replace(F.when(low.contains("'s"), bare).otherwise(low), "[^a-z0-9]+", "")


def sequence_key(name: Column) -> Column:
    """Sequence name without its number prefix, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"^\d+_", "")), "[^a-z0-9]+", "")


def tokens(text: Column) -> Column:
    """All lower-cased tokens of two or more characters, in text order, with repeats."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def content_tokens(text: Column) -> Column:
    """Tokens that are no stopwords, with repeats."""
    return F.filter(tokens(text), lambda t: ~t.isin(*D.FEATURE_STOPWORDS))


def word_set(text: Column) -> Column:
    """Distinct words of three or more characters, stopwords removed."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*D.OVERLAP_STOPWORDS) & (F.length(w) > 2)))


def people(toks: Column) -> Column:
    return _tagged(toks, lambda t: t.startswith("person") | t.isin(*D.PEOPLE_WORDS))


def locations(toks: Column) -> Column:
    return _tagged(toks, lambda t: t.isin(*D.LOCATION_WORDS))


def actions(toks: Column) -> Column:
    return _tagged(toks, lambda t: t.isin(*D.ACTION_WORDS) | t.endswith("ing") | t.endswith("ed"))


def objects(toks: Column) -> Column:
    """What is left after people, locations, actions and stopwords."""
    return _tagged(
        toks,
        lambda t: ~(
            t.isin(*D.FEATURE_STOPWORDS)
            | t.startswith("person")
            | t.isin(*D.PEOPLE_WORDS)
            | t.isin(*D.LOCATION_WORDS)
            | t.isin(*D.ACTION_WORDS)
            | t.endswith("ing")
            | t.endswith("ed")
        ),
    )


def _tagged(toks: Column, keep) -> Column:
    return F.array_sort(F.array_distinct(F.filter(toks, keep)))


def lines(text: Column) -> Column:
    """Lines of a text; the carriage return of a Windows line end goes too."""
    return F.split(text, "\r\n|\n|\r")


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines_with(text: Column, sign: str) -> Column:
    """Lines that hold a match of ``sign``, as (line, text); ``sign`` must not match line ends.

    One search finds signs and line ends: the j-th sign, at place i of all finds, has i - j line ends before it. Only texts with
    a sign are cut into lines.
    """
    finds = F.regexp_extract_all(text, F.lit(f"(?:{sign})|\\r\\n|\\n|\\r"), F.lit(0))
    placed = F.filter(F.transform(finds, lambda t, i: F.when(~t.isin("\r\n", "\n", "\r"), i)), lambda i: i.isNotNull())
    numbers = F.array_distinct(F.transform(placed, lambda i, j: i - j))

    def found(at: Column) -> Column:
        shown = with_value(lines(text), lambda all_: F.transform(at, lambda n: F.struct((n + 1).alias("line"), F.get(all_, n).alias("text"))))
        return F.when(F.size(at) > 0, shown).otherwise(F.array().cast("array<struct<line:int,text:string>>"))

    return with_value(numbers, found)
