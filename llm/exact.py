"""Exact deduplication by content sort.

Texts are normalised (A-Z lower-cased, null as empty) and range-partitioned by sampled splitters on the first bytes of the
content, its digest and the id; the sort within a partition places equal texts side by side, and each text is compared in full
with its neighbour. The splitters stay small however long the texts are, and as the id is part of the key, a group of copies of
any size is spread over as many partitions as its rows need. A group that crosses a partition edge is put together from one
record per partition and edge.

Edge cases: null and empty texts are equal; among equal texts the row with the largest (or smallest) doc_id stays, a null doc_id
counts as the smallest, and of repeated rows with one id exactly one stays. An empty table gives no rows. Extra columns are
ignored by :func:`groups` and kept by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import lower_ascii, partitions, stored

#: Bytes of content in the range key.
PREFIX = 32
_RUNS = "doc_id long, text_sha256 string, part int, run long, n long, low long, high long, first boolean, last boolean, edge_text string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to rows with the size and ids of their run of equal texts, as far as this partition shows it."""
    part, run = TaskContext.get().partitionId(), 0
    held: list[pa.Table] = []  # id and digest of the open run
    text = None

    def closed(final: bool) -> pa.RecordBatch:
        rows = pa.concat_tables(held).combine_chunks()
        n, ids = rows.num_rows, rows.column("doc_id")
        flags = np.zeros(n, dtype=bool)
        first, last = flags.copy(), flags.copy()
        first[0] = last[-1] = True
        edge = pa.array([text if run == 0 or final else None] + [None] * (n - 1), pa.string())
        same = lambda v, kind: pa.array([v] * n, kind)
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids.chunks) if ids.num_chunks != 1 else ids.chunk(0), pa.concat_arrays(rows.column("text_sha256").chunks), same(part, pa.int32()),
             same(run, pa.int64()), same(n, pa.int64()), same(ids[0].as_py(), pa.int64()), same(ids[-1].as_py(), pa.int64()), pa.array(first), pa.array(last), edge],
            names=["doc_id", "text_sha256", "part", "run", "n", "low", "high", "first", "last", "edge_text"])

    out: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column("__norm")
        keep = pa.Table.from_batches([batch.select(["doc_id", "text_sha256"])])
        equal = pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False) if len(texts) > 1 else np.zeros(0, bool)
        cuts = [0, *(np.flatnonzero(~equal.astype(bool)) + 1).tolist(), len(texts)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            here = texts[begin].as_py()
            if held and (begin > 0 or here != text):
                out.append(closed(False))
                held, run = [], run + 1
            text = here
            held.append(keep.slice(begin, end - begin))
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
            out = []
    if held:
        yield closed(True)


def groups(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    norm = lower_ascii(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("__norm"))
    rows = rows.select("doc_id", "__norm", F.sha2("__norm", 256).alias("text_sha256"), F.substring("__norm", 1, PREFIX).alias("__prefix"))
    order = ["__prefix", "text_sha256", "doc_id"]
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    runs = stored(dealt.select("doc_id", "__norm", "text_sha256").mapInArrow(_runs, _RUNS), "runs")
    # At most two runs of a partition touch its edges. Each is compared with the one before it; texts meet pairwise only.
    edges = runs.where("first and edge_text is not null").select("part", "run", "n", "low", "high", "edge_text")
    place = Window.orderBy("part", "run")
    numbers = edges.select("part", "run", "n", "low", "high", F.row_number().over(place).alias("i"))
    texts = edges.select("part", "run", "edge_text").join(numbers.select("part", "run", "i"), ["part", "run"])
    same = texts.select("i", "edge_text").join(texts.select((F.col("i") + 1).alias("i"), F.col("edge_text").alias("before")), "i").where("edge_text = before").select("i", F.lit(0).alias("new"))
    chain = numbers.join(same, "i", "left").withColumn("chain", F.sum(F.coalesce("new", F.lit(1))).over(Window.orderBy("i")))
    whole = Window.partitionBy("chain")
    chain = chain.select("part", "run", F.sum("n").over(whole).alias("__n"), F.first("low").over(whole.orderBy("i")).alias("__low"),
                         F.last("high").over(whole.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__high"),
                         (F.min("i").over(whole) == F.col("i")).alias("__begins"), (F.max("i").over(whole) == F.col("i")).alias("__ends"))
    # Two records per partition at most: small whatever the rows.
    joined = runs.join(F.broadcast(stored(chain, "run-edges")), ["part", "run"], "left")
    size, low, high = F.coalesce("__n", "n"), F.when(F.col("__n").isNull(), F.col("low")).otherwise(F.col("__low")), F.when(F.col("__n").isNull(), F.col("high")).otherwise(F.col("__high"))
    stays = F.col("first") & F.coalesce("__begins", F.lit(True)) if keep == "smallest" else F.col("last") & F.coalesce("__ends", F.lit(True))
    return joined.select("doc_id", (low if keep == "smallest" else high).alias("keep_id"), size.alias("group_size"), stays.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stay = groups(docs, keep).where("kept").select(F.coalesce("doc_id", F.lit(-1)).alias("__exact_doc"), F.col("text_sha256").alias("__exact_sha"))
    keyed = docs.withColumn("__exact_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn("__exact_sha", F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256))
    one = F.row_number().over(Window.partitionBy("__exact_doc", "__exact_sha").orderBy("__exact_doc"))
    return keyed.join(stay, ["__exact_doc", "__exact_sha"]).withColumn("__exact_one", one).where("__exact_one = 1").select(*docs.columns)
