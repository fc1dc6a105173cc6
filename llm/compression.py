"""Quality by compression: a text is good if a dictionary of good text shortens it more than one of bad text.

Two zstandard dictionaries hold stretches of labelled text. A text is compressed with either; the difference of the two sizes over
its length (plus ``SMOOTH`` bytes, so that few bytes say little) is the evidence, and a logistic curve fitted on labelled rows that
the dictionaries have not seen turns it into a probability.

What is learned comes from a bounded sample of the labelled rows: at most ``ROWS`` rows per label for the dictionaries and
``CALIBRATE`` rows for the curve, taken in the order of a hash. A dictionary takes its stretches (lines, long ones in pieces of
``STRETCH`` characters) in the order of a hash too, up to ``SIZE`` bytes; a stretch that occurs under both labels tells nothing and
is left out, and repeats count once. Every document is scored on its whole text.

Edge cases: null and empty texts have no evidence and get the score of a difference of zero; null labels and labels other than 0
and 1 are ignored, as are labels without a document; a document with both labels counts for either; of different texts under one labelled
id the one with the smallest hash is learned from; where one label is missing all scores are the share of label 1 (a half without
any label). Repeated rows are scored each, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import stored
from llm.textops import text_lists

ROWS = 2000
CALIBRATE = 4000
SIZE = 1 << 18
STRETCH = 512
LEVEL = 3
SMOOTH = 128
THRESHOLD = 0.3
#: Of every hundred labelled rows so many may feed a dictionary, the others the curve.
SHARE = 60


@dataclass
class Model:
    bad: bytes
    good: bytes
    slope: float
    offset: float
    scale: tuple[float, float]  # centre and width of the evidence

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.offset + self.slope * _standard(evidence, self.scale))))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _standard(evidence: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    return np.clip((evidence - scale[0]) / scale[1], -4.0, 4.0)


class Sizes:
    """Compressed sizes under the two dictionaries, without headers and checksums."""

    def __init__(self, bad: bytes, good: bytes, level: int = LEVEL):
        self.parts = []
        for body in (bad, good):
            plain = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if body:
                plain["dict_data"] = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                plain["dict_data"].precompute_compress(level=level)
            self.parts.append(zstandard.ZstdCompressor(**plain))

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Bytes that the good dictionary saves over the bad one, per byte of text."""
        bad, good = self.parts
        return np.array([(len(bad.compress(t)) - len(good.compress(t))) / (len(t) + SMOOTH) for t in texts], dtype=np.float64)


def sampled(docs: DataFrame, labels: DataFrame, rows: int = ROWS, calibrate: int = CALIBRATE) -> DataFrame:
    """quality, use ('dictionary' or 'curve') and text of the sample; ids and labels are drawn before texts are read."""
    label = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").distinct()
    draw = F.xxhash64("doc_id", F.lit("quality"))
    known = label.withColumn("draw", draw).withColumn("use", F.when(F.pmod(F.shiftright("draw", 7), F.lit(100)) < SHARE, F.lit("dictionary")).otherwise(F.lit("curve")))

    def first(some: DataFrame, n: int) -> DataFrame:
        return some.orderBy("draw", "doc_id", "quality").limit(n)  # the n smallest of each task, then of all

    parts = [first(known.where((F.col("use") == "dictionary") & (F.col("quality") == q)), rows) for q in (0, 1)]
    ids = parts[0].unionByName(parts[1]).unionByName(first(known.where("use = 'curve'"), calibrate)).select("doc_id", "quality", "use")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id")  # at most 2 * rows + calibrate ids are broadcast
    # An id that many rows share gives one text, reduced in the tasks before the shuffle.
    return found.groupBy("doc_id", "quality", "use").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")).select("quality", "use", "text")


def dictionaries(sample: DataFrame, size: int = SIZE, stretch: int = STRETCH) -> tuple[bytes, bytes]:
    """Contents of the bad and the good dictionary."""
    line = F.explode(F.split("text", "\n"))
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("line") / stretch).cast("int") - 1)), lambda k: F.col("line").substr(k * stretch + 1, F.lit(stretch))))
    parts = sample.where("use = 'dictionary'").select("quality", line.alias("line")).select("quality", cut.alias("part")).where("length(part) > 0")
    own = parts.groupBy("part").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    # In the order of a hash up to the size: the sum runs over stretches of the sample, whose number is bounded.
    upto = F.sum(F.octet_length("part") + 1).over(Window.partitionBy("quality").orderBy(F.xxhash64("part"), "part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = own.withColumn("upto", upto).where(F.col("upto") <= size).select("quality", "part", "upto").collect()  # two times ``size`` bytes
    bodies = [b"\n".join(r["part"].encode() for r in sorted((r for r in chosen if r["quality"] == q), key=lambda r: r["upto"])) for q in (0, 1)]
    return bodies[0], bodies[1]


def curve(evidence: np.ndarray, quality: np.ndarray) -> tuple[float, float, tuple[float, float]]:
    """Slope, offset and scale of the logistic curve: Newton steps with a small ridge, which separable data need."""
    scale = (float(evidence.mean()), float(evidence.std()) or 1.0)
    x = np.column_stack([_standard(evidence, scale), np.ones(len(evidence))])
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-(x @ w)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - quality) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), float(w[1]), scale


def fit(docs: DataFrame, labels: DataFrame, size: int = SIZE, rows: int = ROWS, calibrate: int = CALIBRATE) -> Model:
    """The model of the labelled documents; ``labels`` has doc_id and quality."""
    sample = stored(sampled(docs, labels, rows, calibrate), "quality-sample")
    bad, good = dictionaries(sample, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(bad, good)
        for some, texts in text_lists(batches):
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes.evidence(texts))], names=["quality", "evidence"])

    rest = sample.where("use = 'curve'").select(F.col("quality").cast("int").alias("quality"), "text").mapInArrow(run, "quality int, evidence double")
    found = sorted((r["evidence"], r["quality"]) for r in rest.collect())  # two numbers for each of ``calibrate`` ids
    evidence, quality = np.array([e for e, _ in found]), np.array([float(q) for _, q in found])
    if not bad or not good or not 0 < quality.sum() < len(quality):
        n = {r["quality"]: r["n"] for r in sample.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
        p = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1.0)
        return Model(bad, good, 0.0, float(np.log(p / (1 - p))), (0.0, 1.0))
    return Model(bad, good, *curve(evidence, quality))


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = Sizes(m.bad, m.good)
        for some, texts in text_lists(batches):
            score = m.score(sizes.evidence(texts))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the labels whose fold is not held out, score all documents."""
    return scores(docs, fit(docs, labels.where(~held_out(F.col("doc_id")))), threshold)
