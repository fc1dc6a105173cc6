"""Single-pass scans of texts: containment, findings by line, JSON recovery, stripping."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from plotline.functions import json_recovery as J
from plotline.functions import text as X
from plotline.operators import audits as U
from plotline.operators import gates as G
from plotline.operators import keyfilter as K
from plotline.operators import selection as L


def one(spark, texts, column):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column(F.col("t"))).collect()]


def corpus():
    rng = random.Random(3)
    words = ["the", "of", "a", "stone", "river", "", "née", "x"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    items = []
    for k in range(60):  # pieces of texts, cut anywhere
        t = rng.choice(texts)
        a = rng.randint(0, len(t))
        items.append(t[a : a + rng.choice([1, 2, 3, 5, 9, 15, 40, 90])])
    items += ["the of", "a", "the", "never seen words in here", "w1 w2 w3 w4 w5 w6", "", " ", "  ", "w1  w2", "née"]
    return texts + ["", None, "a", "the of"], items


@pytest.mark.parametrize("direct", [64, 0])
def test_containment(spark, monkeypatch, direct):
    monkeypatch.setattr(U, "DIRECT_ITEMS", direct)
    texts, items = corpus()
    a = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").repartition(3)
    got = sorted(map(tuple, U.contained_items(a, b, "doc_id", "item_id").collect()))
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if t is not None and x and x in t)
    assert U.contained_items(a, b.limit(0), "doc_id", "item_id").collect() == []
    assert U.contained_items(a.limit(0), b, "doc_id", "item_id").collect() == []


def test_key_filter_lets_all_its_keys_pass(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("k"))
    found = K.key_filter(keys, "k")
    assert keys.filter(~found.may_contain(F.col("k"))).count() == 0
    others = spark.range(10_000, 40_000).select(F.xxhash64("id").alias("k"))
    assert others.filter(found.may_contain(F.col("k"))).count() < 0.06 * 30_000
    assert others.filter(K.key_filter(keys.limit(0), "k").may_contain(F.col("k"))).count() == 0
    assert others.filter(K.key_filter(keys, "k", most=10).may_contain(F.col("k"))).count() == 30_000


def test_few_other_keys_pass(spark):
    keys, others = spark.range(3000).select(F.xxhash64("id").alias("k")), spark.range(10_000, 40_000).select(F.xxhash64("id").alias("k"))
    assert others.filter(K.key_filter(keys, "k").may_contain(F.col("k"))).count() < 0.002 * 30_000


def test_bits_of_a_filter_are_not_part_of_the_plan(spark):
    # As text in the plan, the bits of some 100,000 keys came to the driver's memory with every plan that was shown or logged.
    keys, others = spark.range(100_000).select(F.xxhash64("id").alias("k")), spark.range(200_000, 300_000).select(F.xxhash64("id").alias("k"))
    found = K.key_filter(keys, "k")
    assert keys.filter(~found.may_contain(F.col("k"))).count() == 0
    rest = others.filter(found.may_contain(F.col("k")))
    assert rest.count() < 0.002 * 100_000
    assert len(rest._jdf.queryExecution().toString()) < 20_000


def test_runs_take_along_no_more_text_than_items_need(spark):
    filler = " ".join(f"w{i}" for i in range(5000))
    texts = [f"{filler} xred  fox jumps over the dogs {filler}", "red  fox jumps over the dog", "fox jumps over the", f"{filler} red fox jumps over the dog", None, ""]
    a = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame([(0, "red  fox jumps over the dog"), (1, "w4998 w4999 red fox jumps"), (2, "over the dogs w0 w1")], "item_id long, text string")
    got = sorted(map(tuple, U.contained_items(a, b, "doc_id", "item_id").collect()))
    assert got == [(0, 0), (0, 2), (1, 0), (3, 1)]
    near = U.union_all(U._runs_in_place(a, "doc_id", "text", {4: 7}, K.KeyFilter("", 0)))
    assert near.agg(F.max(F.size(F.split("_near", " ")))).first()[0] == 15


def test_windows_of_characters_hold_items_beyond_the_plane(spark):
    items = [f"\U0001F600{chr(0x1F400 + i)}x{i}" for i in range(70)]
    texts = [f"ab {items[3]}{items[40]} \U0001F600", "".join(items), "\U0001F600x1", "x" * 50 + items[69] + "\U0001F600" * 30]
    a = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted(map(tuple, U.contained_items(a, b, "doc_id", "item_id").collect()))
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if x in t)


LINES = ["plain", "", "mail a@b.org and tufts", "Pattern( c@d.org )", "see /home/x and /Users/y", "permit", "MIT.", "my API_KEY", "OPENAI_API_KEY x", "hf_token", "github.com/huggingface", "GitHub.com/me",
         "huggingface.co/api/x", "huggingface.co/me", "xgithub.com/me", "@", "secret_key: todo(author)", "/users/z raw source", "é@b.org", "a@b.org" + "x" * 300, "  cornell   x@y.org"]


def test_findings_by_line(spark):
    rng = random.Random(5)
    ends = ["\n", "\r\n", "\r"]
    texts = ["".join(rng.choice(LINES) + rng.choice(ends) for _ in range(rng.randint(0, 12))) + rng.choice(LINES) for _ in range(200)] + ["\n\n\r\r\n@", "", None]
    letter = r"[^\W]"
    for text, got in zip(texts, one(spark, texts, U.sensitive_findings), strict=True):
        want = []
        for place, (label, pattern, fold, _) in enumerate(U.RISK_PATTERNS):
            rx = re.compile(pattern.replace(U._B, f"(?<!{letter})").replace(U._E, f"(?!{letter})"), re.I if fold else 0)
            for n, line in enumerate(re.split("\r\n|\n|\r", text or "")):
                if "Pattern(" not in line and rx.search(line):
                    want.append((place, label, n + 1, line.strip(" ")[:180]))
                    break
        assert [tuple(x) for x in got or []] == want
    for text, got in zip(texts, one(spark, texts, G.quarantine_reason), strict=True):
        want = None
        for line in re.split("\r\n|\n|\r", (text or "").lower()):
            if want is None and not any(m in line for m in G.D.ALLOWED_LINE_MARKERS):
                want = next((f"matched private/secret pattern '{p}'" for p in G.D.PRIVATE_SUBSTRINGS if p in line), None)
        assert got == want


def objects_by_hand(text):
    depth, quoted, start, out, k = 0, False, 0, [], 0
    while k < len(text):
        c = text[k]
        if quoted and c == "\\":
            k += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted and c == "{":
            start = k if depth == 0 else start
            depth += 1
        elif not quoted and c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : k + 1])
        k += 1
    return out


@pytest.mark.parametrize("block", [512, 3])
def test_objects_in_text(spark, block):
    rng = random.Random(9)
    texts = ["".join(rng.choice(['{', '}', '"', '\\', 'a', '{"k":1}', '{"k":"}"}', ' ', '\n', '{"a":{"b":[1]}}']) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    assert one(spark, texts, lambda t: J.top_level_objects(t, block)) == [objects_by_hand(t) for t in texts]


def test_whole_json(spark):
    texts = ['{"a":1}', ' {"a": [1]}\n', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1}, {"b":2}', '{"a":1}] {"b":2}', '{"a":1}, 5] x', "[1]", "[1] x", "1", '"x"', "", " ", "nul", "null", '{"a":1', "1, 2", None]

    def plain(text):
        try:
            return json.loads(text)
        except (TypeError, ValueError):
            return "none"

    got = one(spark, texts, lambda t: F.to_json(F.struct(J.whole_json(t).alias("v"))))
    assert [json.loads(g).get("v") if plain(t) not in ("none", None) else None for t, g in zip(texts, got, strict=True)] == [None if plain(t) == "none" else plain(t) for t in texts]
    assert [g == "{}" for g in got] == [plain(t) == "none" for t in texts]
    assert one(spark, texts, J.is_object) == [isinstance(plain(t), dict) for t in texts]


LONG = {
    "string": '{"a":"' + "x" * 10_000_000 + '"}', "escapes": 'x {"a":"' + '\\"' * 500_000 + '"} t', "objects": '{"k":1} ' * 40_000, "nested": '{"k":' * 3000 + "1" + "}" * 3000,
    "blanks": '{"a":1}' + " " * 1_000_000 + "x", "open": "{" * 100_000,
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_lines(spark, name):
    """Ten megabytes in a line, a million blanks or tens of thousands of objects take seconds, not hours."""
    begin = time.perf_counter()
    rows = spark.createDataFrame([(LONG[name],)], "t string")
    got = rows.select(J.recovered_object(F.col("t")).alias("o"), J.is_object(F.col("t")).alias("is"), F.length(X.strip(F.col("t"))).alias("n"), L.needs_antecedent(F.col("t")).alias("a")).first()
    want = {"string": LONG["string"], "escapes": LONG["escapes"][2:-2], "objects": '{"k":1}', "blanks": '{"a":1}', "open": None}
    assert name == "nested" or got["o"] == want[name]
    assert got["is"] == (name == "string") or name == "nested"
    assert got["n"] == len(LONG[name].strip()) and not got["a"]
    assert time.perf_counter() - begin < 60


def test_strip_takes_every_white_space(spark):
    every = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"
    texts = [every + "a" + every + "b" + every, every, "", "x", None, "​x"]
    assert one(spark, texts, X.strip) == [None if t is None else t.strip() for t in texts]
