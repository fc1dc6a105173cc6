"""Target and context selection: resolve targets, reconcile evidence, gate and route decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions import domains as D
from plotline.functions import labels as L
from plotline.functions import scalars as S
from plotline.functions import text as X


def _ids(clips: Column) -> Column:
    return F.transform(clips, lambda c: c["clip_id"])


def needs_antecedent(sentence: Column) -> Column:
    """A sentence that opens with a fragment verb or a pronoun leans on the clip right before it."""
    starts = D.FRAGMENT_STARTS + D.PRONOUN_STARTS
    opening = F.left(X.strip(F.coalesce(sentence, F.lit(""))), F.lit(2 * max(map(len, starts))))
    return F.lower(opening).rlike(f"^({'|'.join(starts)}) ")


def explicitly_invalid(target_type: Column, triviality: Column) -> Column:
    """Type given but outside the domain (a null counts as given), or a trivial target."""
    label = F.lower(X.strip(F.coalesce(target_type, F.lit("none"))))
    return ((label != "") & ~label.isin(*D.TARGET_TYPES)) | F.coalesce(
        F.lower(X.strip(triviality)).isin(*D.TRIVIAL), F.lit(False))


def resolve_target(blocks: DataFrame) -> DataFrame:
    """Target by clip id, else by 1-based position; a target outside the block is no target."""
    ids = _ids(F.col("clips"))
    by_position = F.when(
        (F.col("target_position") >= 1) & (F.col("target_position") <= F.size("clips")),
        F.try_element_at(ids, F.col("target_position").cast("int")))
    wanted = F.coalesce(F.col("target_clip_id"), by_position)
    at = F.coalesce(F.array_position(ids, wanted), F.lit(0)).cast("int")
    target = F.when(F.col("_at") > 0, F.try_element_at("clips", F.col("_at")))
    return blocks.withColumn("_at", at).withColumns({
        "target": target,
        "target_clip_id": target["clip_id"],
        "target_position": F.when(F.col("_at") > 0, F.col("_at")),
        "target_sentence": target["text"],
        "found": S.truthy_bool(F.col("found_valid_target")) & (F.col("_at") > 0),
        "prefix": F.slice("clips", 1, F.greatest(F.col("_at") - 1, F.lit(0))),
    }).drop("_at")


def reconcile_evidence(rows: DataFrame) -> DataFrame:
    """Keep evidence that quotes a prior clip, merge its clips into the context, restore prefix order."""
    prefix_ids = _ids(F.col("prefix"))
    quoted = F.filter(
        F.coalesce("selected_context_spans", F.array().cast("array<struct<clip_id:string,span:string,evidence_type:string>>")),
        lambda e: F.exists(
            "prefix",
            lambda c: (c["clip_id"] == e["clip_id"]) & (F.length(X.strip(e["span"])) > 0) & c["text"].contains(X.strip(e["span"])),
        ),
    )
    evidence = F.transform(quoted, lambda e: F.struct(
        e["clip_id"].alias("clip_id"),
        X.strip(e["span"]).alias("span"),
        F.when(X.strip(e["evidence_type"]).isin(*D.EVIDENCE_TYPES), X.strip(e["evidence_type"])).otherwise("other")
        .alias("evidence_type"),
    ))
    chosen = F.filter("selected_context_clip_ids", lambda x: F.array_contains(prefix_ids, x))
    cited = F.filter("evidence_clip_ids", lambda x: F.array_contains(prefix_ids, x))
    merged = rows.withColumn("evidence", evidence).withColumn("_merged", F.concat(chosen, _ids(F.col("evidence"))))
    context = F.filter("prefix", lambda c: F.array_contains("_merged", c["clip_id"]))
    return merged.withColumns({
        "context": context,
        "selected_context_clip_ids": _ids(context),
        "evidence_clip_ids": F.when(F.size(cited) > 0, cited).otherwise(_ids(F.col("evidence"))),
    }).drop("_merged")


def passes_selection(threshold: float) -> Column:
    prior = F.try_element_at("prefix", F.lit(-1))["clip_id"]
    return F.coalesce(
        F.col("found")
        & F.col("target").isNotNull()
        & (F.length("target_clip_id") > 0)
        & F.col("target_type").isin(*D.TARGET_TYPES)
        & (F.col("target_triviality") == "nontrivial")
        & (F.size("selected_context_clip_ids") > 0)
        & (F.size("evidence") > 0)
        & (F.col("sufficiency") >= threshold)
        & (~needs_antecedent(F.col("target_sentence")) | F.array_contains("selected_context_clip_ids", prior))
        & (F.size(F.array_except(_ids(F.col("context")), _ids(F.col("prefix")))) == 0)
        & ~explicitly_invalid(F.col("target_type"), F.col("target_triviality"))
        & (F.coalesce("predictability", F.lit("")) != "unpredictable"),
        F.lit(False),
    )


def route(passes: Column) -> Column:
    """selected, challenge or rejected."""
    under = F.coalesce(F.col("predictability") == "underdetermined", F.lit(False))
    open_ended = F.coalesce(F.col("target_triviality") == "meaningful_but_noninferable", F.lit(False))
    return (
        F.when(~passes & (open_ended | under), "challenge")
        .when(~passes, "rejected")
        .when(under, "challenge")
        .otherwise("selected")
    )


def rejection_reason(raw_target_id: Column, raw_position: Column) -> Column:
    """First rule that applies, in fixed order."""
    triviality = F.lower(X.strip(F.coalesce("target_triviality", F.lit(""))))
    no_target = ~F.col("found") | F.col("target").isNull()
    named = F.coalesce(F.length(raw_target_id) > 0, F.lit(False)) | raw_position.isNotNull()
    invalid = explicitly_invalid(F.col("target_type"), F.col("target_triviality"))
    return (
        F.when(triviality == "meaningful_but_noninferable", "meaningful_but_noninferable")
        .when(triviality.isin(*D.TRIVIAL), "trivial_target")
        .when(F.col("predictability") == "underdetermined", "underdetermined")
        .when(F.col("predictability") == "unpredictable", "insufficient_buildup")
        .when(no_target & named & invalid, "invalid_target")
        .when(no_target, "no_valid_target")
        .when(invalid, "invalid_target")
        .otherwise("insufficient_buildup")
    )


def with_decisions(blocks: DataFrame, decisions: DataFrame, answered: str = "answered", key: str = "block_id") -> DataFrame:
    """Blocks with their decision; a block without one, or whose model call failed, gets the default decision."""
    ok = F.coalesce(F.col(answered), F.lit(False))
    default = {
        "found_valid_target": F.lit("false"),
        "predictability": F.lit("unpredictable"),
        "continuity_type": F.lit("discontinuous_unpredictable"),
        "reasoning_type": F.array(F.lit("other")),
        "evidence_sufficiency": F.lit("0.0"),
        "selected_context_clip_ids": F.array().cast("array<string>"),
        "selected_context_spans": F.array().cast("array<struct<clip_id:string,span:string,evidence_type:string>>"),
        "evidence_clip_ids": F.array().cast("array<string>"),
    }
    fields = [c for c in decisions.columns if c not in {key, answered}]
    joined = blocks.join(decisions, key, "left")
    return joined.withColumns(
        {c: F.when(ok, F.col(c)).otherwise(default.get(c, F.lit(None))) for c in fields} | {answered: ok})


def materialize(decided: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Blocks with raw decision columns become selection rows with route and rejection reason."""
    raw = {"raw_target_id": F.col("target_clip_id"), "raw_position": F.col("target_position")}
    reasoning = L.reasoning_types(F.col("reasoning_type"))
    rows = reconcile_evidence(resolve_target(decided.withColumns(raw))).withColumns({
        "sufficiency": S.loose_double(F.col("evidence_sufficiency"), signed=False),
        "reasoning_type": reasoning,
        "continuity_type": L.continuity_type(F.col("continuity_type"), reasoning),
    })
    routed = rows.withColumn("passes", passes_selection(threshold)).withColumn("route", route(F.col("passes")))
    return routed.withColumns({
        "rejection_reason": F.when(F.col("route") != "selected", rejection_reason(F.col("raw_target_id"), F.col("raw_position"))),
        "id": F.concat_ws("::", "block_id", F.coalesce("target_clip_id", F.lit("no_target"))),
    })


def fixed_window_route(threshold: float) -> Column:
    """Routing of fixed candidate windows from ``keep``, ``predictability``, ``continuity_type``, ``sufficiency``."""
    selected = (
        F.col("keep")
        & (F.col("predictability") == "predictable")
        & F.col("continuity_type").isin(*D.KEPT_CONTINUITY)
        & (F.col("sufficiency") >= threshold)
    )
    challenge = (F.col("predictability") == "underdetermined") | (F.col("continuity_type") == "scene_cut_semantically_linked")
    return F.when(selected, "selected").when(challenge, "challenge").otherwise("rejected")
