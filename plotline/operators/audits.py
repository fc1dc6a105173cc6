"""Audits: verbatim options, contaminated texts, temporal leaks, sensitive strings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions import text as X
from plotline.operators.keyfilter import KeyFilter, key_filter
from plotline.operators.sequence import last_k
from plotline.session import durable
from plotline.sources.clips import union_all

# Word edges with every Unicode letter and digit counted as part of a word.
_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

#: label, pattern, ignore case, and what every match holds in whatever case: plain enough to be tried at each place of a text
RISK_PATTERNS: tuple[tuple[str, str, bool, str], ...] = (
    ("private path", r"(/Users/|/home/[A-Za-z0-9_.-]+)", True, "/(?:users|home)/"),
    ("email", _B + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + _E, False, "@"),
    ("institution/lab string", _B + r"(tufts|stanford|mit|berkeley|cmu|cornell)" + _E, True, "tufts|stanford|mit|berkeley|cmu|cornell"),
    ("api key wording", _B + r"(api[_-]?key|secret[_-]?key|access[_-]?token|hf_token|openai_api_key)" + _E, True,
     "api[_-]?key|secret[_-]?key|access[_-]?token|hf_token"),
    ("personal github/hf name", _B + r"github\.com/(?!huggingface" + _E + r")[A-Za-z0-9_.-]+", True, r"github\.com/"),
    ("personal github/hf name", _B + r"huggingface\.co/(?!api/)[A-Za-z0-9_.-]+", True, r"huggingface\.co/"),
)


def verbatim_options(examples: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per option whose wording equals that of the hidden target."""
    listed = examples.filter(F.length("target_sentence") > 0).select(
        "id", *keep, "target_sentence", "answer_idx", F.posexplode("options").alias("matching_option_idx", "option"))
    return listed.filter(X.compare_key(F.col("option")) == X.compare_key(F.col("target_sentence"))).withColumn(
        "matching_option_is_correct", F.col("matching_option_idx") == F.col("answer_idx"))


#: Longest run of words, and of characters, that serves as a key.
WORD_RUN, CHAR_RUN = 4, 8
#: Up to so many items without an inner word, and so many characters of them, are looked for in each text directly.
DIRECT_ITEMS, DIRECT_CHARS = 64, 4096


def _runs(units: Column, n: int) -> Column:
    """All runs of ``n`` units, as structs of ``n`` fields; the last runs are cut short and hold nulls."""
    return F.arrays_zip(*[F.slice(units, i + 1, F.size(units)).alias(f"u{i}") for i in range(n)])


def _units(kind: int, text: str) -> Column:
    return F.split(text, " ", -1) if kind > 0 else F.split(text, "")


def _keyed_runs(rows: DataFrame, keep: Sequence[str], text: str, kinds: Sequence[int]) -> list[DataFrame]:
    """For each kind the hashed runs of the texts as ``_key``: n words for n above zero, else -n characters."""
    parts = []
    for kind in kinds:
        n, names = abs(kind), [f"_u{i}" for i in range(abs(kind))]
        found = rows.select(*keep, F.inline(_runs(_units(kind, text), n)).alias(*names)).filter(F.col(names[-1]).isNotNull())
        parts.append(found.select(*keep, F.xxhash64(F.lit(kind), *names).alias("_key")))
    return parts


def _runs_in_place(texts: DataFrame, text_id: str, text: str, reach: Mapping[int, int], chosen: KeyFilter) -> list[DataFrame]:
    """For each kind the runs that pass the filter as (``text_id``, ``_key``, ``_near``), with ``reach`` units of the text on either side."""
    parts = []
    for kind, far in reach.items():
        n = abs(kind)
        cut = texts.select(text_id, _units(kind, text).alias("_units"))
        runs = cut.select(text_id, "_units", F.posexplode(_runs(F.col("_units"), n)).alias("_at", "_run"))
        fields = [F.col(f"_run.u{i}") for i in range(n)]
        runs = runs.filter(fields[-1].isNotNull() & chosen.may_contain(F.xxhash64(F.lit(kind), *fields)))
        near = F.slice("_units", F.greatest(F.col("_at") + 1 - far, F.lit(1)), F.lit(2 * far + 1))
        parts.append(runs.select(text_id, F.xxhash64(F.lit(kind), *fields).alias("_key"), F.array_join(near, " " if kind > 0 else "").alias("_near")))
    return parts


def _item_kind(item: Column, gram: int) -> Column:
    """Runs of inner words, or of characters where there is no inner word.

    An item inside a text has its inner words, blank for blank, as whole words of that text; only its first and last word may
    be glued to something else.
    """
    inner = F.size(F.split(item, " ", -1)) - 2
    kind = F.when(inner >= gram, gram).when(inner >= 1, inner)
    for n in (CHAR_RUN, CHAR_RUN // 2, CHAR_RUN // 4, 1):
        kind = kind.when(F.length(item) >= n, -n)
    return kind


def _item_keys(items: DataFrame, item_id: str, kinds: Sequence[int]) -> DataFrame:
    """All keys of each item (``item_id``, ``_item``, ``_kind``)."""
    words = F.split("_item", " ", -1)
    shown = F.when(F.col("_kind") > 0, F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), " ")).otherwise(F.col("_item"))
    rows = items.withColumn("_shown", shown)
    parts = [_keyed_runs(rows.filter(F.col("_kind") == k), (item_id, "_item"), "_shown", [k])[0] for k in kinds]
    return union_all(parts).dropDuplicates([item_id, "_key"])


def contained_items(texts: DataFrame, items: DataFrame, text_id: str, item_id: str, text: str = "text", gram: int = WORD_RUN) -> DataFrame:
    """(text, item) pairs where the text holds the item verbatim; empty items are in no text.

    Every text that holds an item has all its runs of inner words, so one run per item is an exact join key, and the rarest run
    is the best one. Runs of texts are counted first, only those that a Bloom filter of the items' runs lets pass; an item with a
    run in no text is in no text. In a second reading only runs that pass a filter of the chosen ones leave their task, each with
    as much of the text around it as the longest item takes, and a pair is verified where the two meet: what is shuffled follows
    the hits and the length of items, not that of texts. The few items without an inner word are searched in
    each text in place; beyond ``DIRECT_ITEMS`` of them they are keyed by characters in the same way.
    """
    kept = items.filter(F.length(text) > 0).select(item_id, F.col(text).alias("_item"))
    bare = kept.filter(F.size(F.split("_item", " ", -1)) < 3)
    few = bare.select(item_id, "_item", F.length("_item").alias("n")).limit(DIRECT_ITEMS + 1).collect()
    direct = len(few) <= DIRECT_ITEMS and sum(r["n"] for r in few) <= DIRECT_CHARS
    parts = []
    if direct and few:
        listed = F.array(*[F.struct(F.lit(r[item_id]).alias(item_id), F.lit(r["_item"]).alias("_item")) for r in few])
        held = F.filter(listed, lambda i: F.col(text).contains(i["_item"]))
        parts.append(texts.select(text_id, F.explode(held).alias("_i")).select(text_id, F.col(f"_i.{item_id}").alias(item_id)))
    long = (kept.filter(F.size(F.split("_item", " ", -1)) >= 3) if direct else kept).withColumn("_kind", _item_kind(F.col("_item"), gram))
    longest = F.max(F.when(F.col("_kind") > 0, F.size(F.split("_item", " ", -1))).otherwise(F.length("_item")))
    reach = {r["_kind"]: r["n"] for r in long.groupBy("_kind").agg(longest.alias("n")).collect()}  # a handful of numbers
    kinds = list(reach)
    if kinds:
        keys = durable(_item_keys(long, item_id, kinds))
        any_run = key_filter(keys, "_key")
        counted = union_all(_keyed_runs(texts, (), text, kinds)).filter(any_run.may_contain(F.col("_key"))).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
        rarity = F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_key").alias("key"))
        rarest = keys.join(counted, "_key", "left").groupBy(item_id).agg(F.first("_item").alias("_item"), F.min(rarity).alias("_r"))
        rarest = durable(rarest.filter("_r.n > 0").select(item_id, "_item", F.col("_r.key").alias("_key")))
        chosen = key_filter(rarest, "_key")
        found = union_all(_runs_in_place(texts, text_id, text, reach, chosen))
        parts.append(found.join(rarest, "_key").filter(F.col("_near").contains(F.col("_item"))).select(text_id, item_id))
    if not parts:
        return texts.select(text_id, F.lit(None).cast(dict(items.dtypes)[item_id]).alias(item_id)).limit(0)
    return union_all(parts).dropDuplicates([text_id, item_id])


def leak_flags(index: Column, prior: Column, contexts: Mapping[int, Column], prompt0: Column, row_id: Column,
               source_names: Sequence[str], prompts0: Sequence[Column] = ()) -> dict[str, Column]:
    """Checks that must all be false. ``contexts`` maps k to the sequence numbers used; ``prior`` has all numbers in
    reach before the target, oldest first."""
    later = sum(
        (F.exists(c, lambda s: s >= index).cast("int") for c in contexts.values()), F.lit(0))
    wrong = sum(((~c.eqNullSafe(last_k(prior, k))).cast("int") for k, c in contexts.items() if k != 1), F.lit(0))
    names = F.lit(False)
    for name in source_names:
        names = names | prompt0.contains(name)
    differs = F.lit(False)
    for other in prompts0:
        differs = differs | (other != prompt0)
    return {
        "no_context_prompt_differs_across_sources": differs.cast("int"),
        "no_context_prompt_contains_source_name": names.cast("int"),
        "no_context_prompt_contains_real_id": prompt0.contains(row_id).cast("int"),
        "no_context_prompt_contains_context_header":
            (prompt0.contains("Prior") | prompt0.contains("audio descriptions")).cast("int"),
        "prompt_contains_dummy_answer": prompt0.contains('"prediction_idx": 0').cast("int"),
        "context_includes_target_or_later": later,
        "k1_not_immediate_prior": (~contexts[1].eqNullSafe(last_k(prior, 1))).cast("int"),
        "k_not_last_k_prior": wrong,
    }


def leak_report(flagged: DataFrame, checks: Sequence[str], row_id: str = "id", samples: int = 5) -> DataFrame:
    """Violations per check with a few sample ids; the rank filter keeps the sample lists short before any shuffle."""
    long = flagged.select(row_id, F.explode(F.array(*[
        F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("n")) for c in checks])).alias("c"))
    long = long.select(row_id, "c.*")
    counts = long.groupBy("check").agg(F.sum("n").alias("violations"))
    rank = F.row_number().over(Window.partitionBy("check").orderBy(row_id))
    few = long.filter("n > 0").withColumn("_r", rank).filter(F.col("_r") <= samples)
    ids = few.groupBy("check").agg(F.array_join(F.array_sort(F.collect_list(row_id)), ",").alias("samples"))
    return counts.join(ids, "check", "left").withColumn("samples", F.coalesce("samples", F.lit("")))


def sensitive_findings(text: Column, patterns=RISK_PATTERNS, marker: str = "Pattern(", excerpt: int = 180) -> Column:
    """First matching line per pattern: array of (pattern, label, line number, excerpt). No row leaves its partition.

    The text is read once, by one search for what the patterns hold; the patterns are only tried on the lines it finds.
    """
    signs = "(?i:" + "|".join(sign for *_, sign in patterns) + ")"

    def report(hits: Column) -> Column:
        shown = F.filter(hits, lambda s: ~s["text"].contains(marker))
        found = []
        for place, (label, pattern, ignore_case, _) in enumerate(patterns):
            regex = "(?i)" + pattern if ignore_case else pattern
            first = F.try_element_at(F.filter(shown, _line_has(regex)), F.lit(1))
            found.append(F.when(first.isNotNull(), F.struct(
                F.lit(place).alias("pattern"), F.lit(label).alias("label"), first["line"].alias("line"),
                F.substring(F.trim(first["text"]), 1, excerpt).alias("excerpt"))))
        return F.when(F.size(hits) > 0, F.array_compact(F.array(*found)))

    return X.with_value(X.lines_with(text, signs), report)


def _line_has(regex: str):
    return lambda line: line["text"].rlike(regex)
