"""Language identification by nearest centroid.

A text becomes a hashed vector of byte n-grams (one to three bytes of lower-cased letters and single blanks), weighted by TF-IDF
and normalised. Spherical k-means gives several centroids per language; a text takes the language of the centroid with the
largest cosine. A text is rejected if it has no letter, or if its cosine is far below what the language's own documents reach.

The model is fitted on a sample: about ``SAMPLE`` distinct labelled texts per language and ``TOTAL`` in all (up to ``PARTS`` of each
language at least), the first in the order of a hash of the text; a language with fewer gives nearly all. This bound is the only one; every document is scored on its whole text. The model has languages x ``CLUSTERS`` x ``DIMENSIONS``
numbers, whatever the number of documents.

Edge cases: null, empty and letterless texts are ``und`` with score 0; ties between centroids go to the language first by code
point; without any labelled document every text is ``und``, and :func:`accepted` keeps all texts with a letter; repeated rows are
scored each; extra columns are ignored by :func:`predict` and kept by :func:`accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import stored
from llm.textops import LOWER, pieces, released, text_buffer

DIMENSIONS = 8192
CLUSTERS = 4
SAMPLE = 1000
TOTAL = 8000
ROUNDS = 8
#: Dense rows in hand at a time.
ROWS = 64
#: Classes of draws that the sample is taken from.
PARTS = 64
#: A text is rejected below this share of the cosine that 99 % of the language's sample reach.
REJECT = 0.4
UNKNOWN = "und"
_SCORED = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"

# Letters (and all bytes beyond ASCII) stay, everything else is a blank.
_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row per centroid
    owner: np.ndarray  # its language
    floor: np.ndarray  # per language: cosine below which a text is rejected


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts, one row per document."""
    docs = len(offsets) - 1
    out = np.zeros((docs, DIMENSIONS), dtype=np.float32)
    if len(data) == 0:
        return out
    low = _FOLD[data].astype(np.uint32)
    owner = np.repeat(np.arange(docs, dtype=np.int64), np.diff(offsets))
    letter = low != 0x20
    gram, whole = low.copy(), letter.copy()
    for n in range(1, 4):
        if n > 1:  # an n-gram lies in one document, has a letter, and no two blanks side by side
            size = len(data) - n + 1
            if size <= 0:
                break
            gram = gram[:size] * np.uint32(257) + low[n - 1 :]
            whole = whole[:size] & (letter[n - 2 : n - 2 + size] | letter[n - 1 :]) & (owner[n - 1 :] == owner[:size]) if n > 2 else (letter[:-1] | letter[1:]) & (owner[1:] == owner[:-1])
        at = np.flatnonzero(whole)
        h = (gram[at] + np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        slot = owner[at] * DIMENSIONS + (h >> np.uint32(19)).astype(np.int64)
        out += np.bincount(slot, minlength=docs * DIMENSIONS).reshape(docs, DIMENSIONS)
    return out


def weighted(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows, with the logarithm of the counts; works in place."""
    np.log1p(count, out=count)
    count *= idf
    count /= np.maximum(np.linalg.norm(count, axis=1, keepdims=True), 1e-12)
    return count


def _blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for some in pieces(batch, text, 1 << 20):
            for k in range(0, some.num_rows, ROWS):
                part = some.slice(k, ROWS)
                yield part, counts(*text_buffer(part.column(part.schema.get_field_index(text))))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, count in _blocks(batches, "text"):
        rows = [np.flatnonzero(c) for c in count]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(rows, pa.list_(pa.int32())), pa.array([c[r] for c, r in zip(count, rows, strict=True)], pa.list_(pa.float32()))], names=["lang", "at", "count"])


def clustered(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; starts from rows far from one another."""
    first = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(first) < min(k, len(x)):
        first.append(int(np.argmin((x @ x[first].T).max(axis=1))))
    c = x[first]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(labelled: DataFrame, sample: int = SAMPLE, total: int = TOTAL) -> Model | None:
    """The model of ``labelled`` (doc_id, text, lang), or None without labelled documents."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("draw"))
    distinct = stored(usable.select("lang", "draw").distinct(), "language-draws")
    size = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not size:
        return None
    want = min(sample, max(1, total // len(size)))
    # Draws of distinct texts are spread evenly, so twice the share holds enough; of those the first few of each of ``PARTS``
    # classes of draws stay, so that no task has a language.
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in size.items() for v in (k, min(1.0, 2.0 * (want + PARTS) / n))]), F.col("lang"))
    near = distinct.where(F.shiftrightunsigned("draw", 11) / float(1 << 53) < share).withColumn("part", F.pmod("draw", F.lit(PARTS)))
    place = F.row_number().over(Window.partitionBy("lang", "part").orderBy("draw"))
    chosen = near.withColumn("place", place).where(F.col("place") <= -(-want // PARTS)).select("lang", "draw")
    # Little more than ``total`` rows, or ``PARTS`` per language, are broadcast; equal texts give one row, reduced in the tasks.
    texts = usable.join(F.broadcast(chosen), ["lang", "draw"]).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    rows = texts.select("lang", "text").mapInArrow(released(_sampled), "lang string, at array<int>, count array<float>").toArrow()
    if rows.num_rows == 0:
        return None
    langs, at, count = (rows.column(c).to_pylist() if c == "lang" else rows.column(c).to_numpy() for c in ("lang", "at", "count"))
    names = sorted(set(langs))
    which = np.array([names.index(x) for x in langs])
    seen = np.zeros(DIMENSIONS, dtype=np.float32)
    for a in at:
        seen[a] += 1
    idf = np.log((1 + len(langs)) / (1 + seen)) + np.float32(0.1)
    centres, floor = [], []
    for i in range(len(names)):  # dense rows of one language at a time
        own = np.flatnonzero(which == i)
        own = own[np.argsort([float(count[k].sum()) + float(at[k].sum()) / 2**40 for k in own], kind="stable")]  # however the rows arrive
        x = np.zeros((len(own), DIMENSIONS), dtype=np.float32)
        for k, row in zip(own.tolist(), x, strict=True):
            row[at[k]] = count[k]
        c = clustered(weighted(x, idf), CLUSTERS)
        centres.append(c)
        floor.append(REJECT * np.quantile((x @ c.T).max(axis=1), 0.01))
    owner = np.repeat(np.arange(len(names)), [len(c) for c in centres])
    return Model(names, idf, np.concatenate(centres), owner, np.array(floor))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, count in _blocks(batches, "text"):
            known = part.column(3).to_numpy(zero_copy_only=False).astype(bool)
            if m is None:
                name, score, out = [UNKNOWN] * len(known), np.zeros(len(known)), np.ones(len(known), bool)
            else:
                cosine = weighted(count, m.idf) @ m.centroids.T
                best = cosine.argmax(axis=1)
                which = m.owner[best]
                score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
                name = [m.languages[w] if k else UNKNOWN for w, k in zip(which.tolist(), known.tolist(), strict=True)]
                out = ~known | (score < m.floor[which])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(name, pa.string()), pa.array(score), pa.array(out)],
                                             names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("known")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text", letters).mapInArrow(released(run), _SCORED)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the documents whose fold is not held out, predict all."""
    return predict(docs, fit(docs.where(~held_out(F.col("doc_id")))))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns; scored in place, so texts are not shuffled."""
    found = fit(docs.where(~held_out(F.col("doc_id"))))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if found is None:
        return docs.where(letters)
    model = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for part, count in _blocks(batches, "text"):
            cosine = weighted(count, m.idf) @ m.centroids.T
            best = cosine.argmax(axis=1)
            yield part.filter(pa.array(cosine[np.arange(len(best)), best] >= m.floor[m.owner[best]]))

    return docs.where(letters).mapInArrow(released(run), docs.schema)
