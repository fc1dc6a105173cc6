"""Small documents with every awkward case, shared by the tests of the operators."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(7)
    words = ["the", "of", "and", "stone", "river", "Lamp", "x1", "don't", "naïve", "größe", "été", "—", "a,b", "END."] + [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = prose(9000)
    shared = prose(80)
    near = prose(300).split(" ")
    changed = [*near]
    changed[150] = "changed"
    out = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, long, "en", "b"), (5, long.upper(), "en", "b"),
        (6, shared + " " + prose(120), "de", "c"), (7, prose(60) + "\n" + shared, "de", "c"), (8, " ".join(near), "fr", None), (9, " ".join(changed), "fr", "a"),
        (10, " ".join(near), "fr", "a"), (11, "one two", "fr", "b"), (12, "one two", None, "b"), (13, "12345 67890", "en", "c"), (14, "a" * 700, "en", "c"),
        (15, "tab\tand wide space 　 here", "en", "a"), (16, "<|endoftext|> is text", "en", "a"), (17, "ab " * 300, "en", "b"), (None, "no id at all here", "en", "b"),
        (18, "x\u0000y nul", "en", "a"), (19, "\U0001f600 smile  two  blanks ", "en", "a"),
    ]
    out += [(i, prose(rng.randint(1, 400)), rng.choice(["en", "de", "fr"]), rng.choice(["a", "b", "c", "é", "Z"])) for i in range(20, 90)]
    out += [(200 + i, " ".join(near), "fr", "hot") for i in range(40)]
    out += [(20, out[20][1], "en", "a"), (20, out[20][1], "en", "a")]  # repeated rows
    return [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in out]


@pytest.fixture(scope="session")
def awkward():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, awkward):
    """The rows as a table with further columns whose names operators might use themselves."""
    df = spark.createDataFrame(awkward, SCHEMA)
    for name in ("size", "n", "rep", "key", "copies", "kept", "rank", "component", "length", "shard", "words", "hash"):
        df = df.withColumn(name, F.lit("own"))
    return df.repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def components(links, ids):
    """Smallest id reachable, for an adjacency list of positions."""
    label = {}
    for start in sorted(range(len(ids)), key=lambda k: ids[k]):
        if start in label:
            continue
        todo = [start]
        while todo:
            k = todo.pop()
            if k not in label:
                label[k] = ids[start]
                todo += links[k]
    return [label[k] for k in range(len(ids))]
