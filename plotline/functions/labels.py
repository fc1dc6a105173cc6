"""Label normalisers: alias map, closed domain, default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotline.functions import domains as D
from plotline.functions.text import strip


def _mapped(label: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), label)


def _clean(label: Column) -> Column:
    return strip(F.coalesce(label, F.lit("")))


def question_type(label: Column, target_type: Column) -> Column:
    """A question label as is, or derived from a target label in either column."""
    own = _clean(label)
    return F.when(own.isin(*D.QUESTION_TYPES), own).otherwise(
        F.coalesce(
            _mapped(own, D.QUESTION_TYPE_OF_TARGET),
            _mapped(_clean(target_type), D.QUESTION_TYPE_OF_TARGET),
            F.lit("what_happens_next"),
        )
    )


def _aliased(label: Column, aliases: dict[str, str], domain: tuple[str, ...]) -> Column:
    own = _clean(label)
    final = F.coalesce(_mapped(own, aliases), own)
    return F.when(final.isin(*domain), final).otherwise("other")


def evidence_type(label: Column) -> Column:
    return _aliased(label, D.EVIDENCE_ALIASES, D.EVIDENCE_TYPES)


def reasoning_type(label: Column) -> Column:
    return _aliased(label, D.REASONING_ALIASES, D.REASONING_TYPES)


def reasoning_types(values: Column) -> Column:
    """Every label of a list; a null or empty list is ['other']."""
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.transform(values, reasoning_type)).otherwise(
        F.array(F.lit("other"))
    )


def continuity_type(label: Column, reasoning: Column) -> Column:
    """A valid label, else one derived from the normalised reasoning labels."""
    own = _clean(label)

    def any_of(values) -> Column:
        return F.arrays_overlap(reasoning, F.array(*[F.lit(v) for v in values]))

    return (
        F.when(own.isin(*D.CONTINUITY_TYPES), own)
        .when(any_of(D.PHYSICAL_REASONING), "continuous_physical")
        .when(any_of(D.SOCIAL_REASONING), "continuous_social")
        .when(F.array_contains(reasoning, "dialogue_grounded"), "dialogue_continuous")
        .otherwise("discontinuous_unpredictable")
    )


def evidence_rows(rows: Column) -> Column:
    """Evidence array with its types mapped; null entries dropped, null array emptied."""
    kept = F.filter(rows, lambda e: e.isNotNull())
    mapped = F.transform(kept, lambda e: e.withField("evidence_type", evidence_type(e["evidence_type"])))
    return F.coalesce(mapped, F.filter(mapped, lambda e: F.lit(False)), F.array().cast(
        "array<struct<clip_id:string,span:string,evidence_type:string>>"))


def display_source(source: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(_mapped(source, labels), source)
