"""Recover a JSON object from free-form model text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotline.functions.text import with_value


def without_fences(text: Column) -> Column:
    bare = F.regexp_replace(F.btrim(text, F.lit(ASCII_SPACES)), r"(?i)^```(?:json)?\s*+", "")
    return F.regexp_replace(bare, r"(?<!\s)\s*+```$", "")


ASCII_SPACES = "\t\n\x0b\x0c\r "
# Quoted strings (with escapes, or unclosed) and the text between them, up to and with the next brace or the end.
_PIECES = r'(?:[^"{}]++|"(?:[^"\\]++|\\[\s\S])*+(?:"|\\?$))*+(?:[{}]|$)'
#: Braces that are followed one after the other.
_BLOCK = 512


def top_level_objects(text: Column, block: int = _BLOCK) -> Column:
    """All balanced top-level ``{...}`` substrings, in text order. Braces inside quoted strings do not count.

    The text is cut at its braces, and the running depth tells at which pieces an object opens and closes; each object is put
    together once. A fold copies its state at every step, so lists only grow within blocks of braces: what a block does to the
    depth is worked out first, then the depth at which each block starts. The work is linear in the text.
    """
    some = "array<int>"

    def found(pieces: Column) -> Column:
        return with_value(F.transform(pieces, lambda p: F.when(p.endswith("{"), 1).when(p.endswith("}"), -1).otherwise(0)), lambda signs: placed(pieces, signs))

    def placed(pieces: Column, signs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(signs) - 1) / block).cast("int")), lambda k: F.slice(signs, k * block + 1, F.lit(block)))
        return with_value(blocks, lambda cut: opened_and_closed(pieces, cut))

    def effect(signs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("net"), F.lit(0).alias("low"))
        return F.aggregate(signs, zero, lambda a, s: F.struct((a["net"] + s).alias("net"), F.least(a["low"], a["net"] + s).alias("low")))

    def opened_and_closed(pieces: Column, blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("depth"), F.array().cast(some).alias("list"))
        depths = F.aggregate(F.transform(blocks, effect), zero, lambda a, e: F.struct(
            F.greatest(a["depth"] + e["net"], e["net"] - e["low"]).alias("depth"), F.array_append(a["list"], a["depth"]).alias("list")), lambda a: a["list"])
        each = F.transform(F.arrays_zip(blocks.alias("signs"), depths.alias("depth")), lambda b, k: events(b["signs"], b["depth"], k * block))
        return with_value(each, lambda all_: objects(
            pieces, F.flatten(F.transform(all_, lambda e: e["opens"])), F.flatten(F.transform(all_, lambda e: e["closes"]))))

    def events(signs: Column, depth: Column, first: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            return F.struct(
                (a["at"] + 1).alias("at"), F.greatest(a["depth"] + s, F.lit(0)).alias("depth"),
                F.when((s == 1) & (a["depth"] == 0), F.array_append(a["opens"], a["at"])).otherwise(a["opens"]).alias("opens"),
                F.when((s == -1) & (a["depth"] == 1), F.array_append(a["closes"], a["at"])).otherwise(a["closes"]).alias("closes"))

        return F.aggregate(signs, F.struct(first.alias("at"), depth.alias("depth"), F.array().cast(some).alias("opens"), F.array().cast(some).alias("closes")), step)

    def objects(pieces: Column, opens: Column, closes: Column) -> Column:
        spans = F.filter(F.arrays_zip(opens.alias("first"), closes.alias("last")), lambda s: s["last"].isNotNull())
        return F.transform(spans, lambda s: F.concat(F.lit("{"), F.array_join(F.slice(pieces, s["first"] + 2, s["last"] - s["first"]), "")))

    # The line end closes the last piece, so that no piece but those at braces ends with one.
    return with_value(F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(_PIECES), F.lit(0)), found)


def json_candidates(text: Column) -> Column:
    """Candidate substrings, longest first (text order among equals), without repeats."""
    found = top_level_objects(without_fences(text))
    ranked = F.array_sort(F.transform(found, lambda c, i: F.struct((-F.length(c)).alias("n"), i.alias("i"), c.alias("c"))))
    return F.array_distinct(F.transform(ranked, lambda s: s["c"]))


def _parses_to_object(text: Column) -> Column:
    parsed = F.try_parse_json(text)
    return parsed.isNotNull() & F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))


def whole_json(text: Column) -> Column:
    """The text as VARIANT; null unless it is one JSON value and nothing else.

    The parser lets anything follow a value. So the text is parsed as the first element of a list whose second element is a
    hash of the text: only a single whole value leaves that in its place.
    """
    mark = F.xxhash64(text)
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    whole = F.try_variant_get(listed, "$[1]", "bigint") == mark
    return F.when(F.coalesce(whole, F.lit(False)), F.variant_get(listed, "$[0]", "variant"))


def is_object(text: Column) -> Column:
    """The whole text is one JSON object."""
    return F.coalesce(F.schema_of_variant(whole_json(text)).startswith("OBJECT"), F.lit(False))


def recovered_object(text: Column) -> Column:
    """First candidate that parses to a JSON object, as text; null if there is none."""
    return F.try_element_at(F.filter(json_candidates(text), _parses_to_object), F.lit(1))


def recovery_error(text: Column) -> Column:
    """Why no object was found; null if one was."""
    bare = without_fences(text)
    return (
        F.when(text.isNull() | (F.length(F.btrim(text, F.lit(ASCII_SPACES))) == 0), "empty model output")
        .when(recovered_object(text).isNotNull(), None)
        .when((F.size(json_candidates(text)) == 0) & ~bare.rlike(r"^\{[\s\S]*\}$"), "no JSON object found in model output")
        .otherwise("failed to parse model JSON")
    )
