"""Packing of documents into token sequences: a cutting-stock plan by column generation.

A document longer than a sequence is cut at multiples of the sequence length.  The histogram of piece lengths (in classes
of ``GRAIN`` tokens, rounded up: its size does not depend on the data) is a cutting-stock problem; its linear program is
solved over patterns that a knapsack dynamic programme prices; patterns are rounded down, what is left is packed best-fit
by the same histogram, and patterns are dealt to the documents ranked within their class.

Cases: a null text is empty and a document of one token, the end id; repeated rows are packed each; an empty table packs
to nothing; columns other than those named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import bounded, chunks, lean
from .shared import written
from .tokens import encoder

SEQUENCE, END_ID, GRAIN = 2048, 1, 16
#: Column generation ends here at the latest, or when the bound is this near.
ROUNDS, NEAR = 4000, 1.001
#: Rows that are ranked together, about.
RANKED = 20_000


def _pieces(path: str, sequence: int, end_id: int):
    end = np.uint32(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, had = encoder(path), 0
        for batch in batches:
            for c in chunks(batch.column(1)):
                ids, cuts = own.texts(c)
                size = np.diff(cuts) + 1
                whole = np.empty(len(ids) + c.n, "<u4")
                last = np.cumsum(size) - 1
                place = np.ones(len(whole), bool)
                place[last] = False
                whole[place], whole[last] = ids, end
                n = -(-size // sequence)
                doc = np.repeat(np.arange(c.n), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * sequence
                length = np.minimum(sequence, size[doc] - start)
                at = (last + 1 - size)[doc] + start
                raw = memoryview(whole).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                keys = batch.column(0).slice(c.first, c.n).take(pa.array(doc))
                nth = np.arange(had, had + len(doc))
                had += len(doc)
                yield pa.RecordBatch.from_arrays([keys, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[doc]), pa.array(nth)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth"])

    return run


def pieces(docs: DataFrame, tokenizer: str, *, text: str = "text", doc_id: str = "doc_id", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of every whole text, and its number within its task (nth)."""
    rows = bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(_pieces(tokenizer, sequence, end_id)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long")


def knapsack(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best multiset of items within ``room``: its value and the count of each item."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fit = int(np.searchsorted(size, c, "right"))
        best[c], last[c] = best[c - 1], -1
        if fit:
            got = best[c - size[:fit]] + value[:fit]
            k = int(got.argmax())
            if got[k] > best[c] + 1e-12:
                best[c], last[c] = got[k], k
    counts, c = np.zeros(len(size), np.int64), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= size[last[c]]
    return float(best[room]), counts


def patterns(size: np.ndarray, demand: np.ndarray, room: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Columns (patterns) and their use in the linear program; sizes ascend."""
    m = len(size)
    columns = np.diag(room // size).astype(float)
    inverse = np.diag(1.0 / (room // size))
    use = inverse @ demand
    for _ in range(rounds):
        duals = np.maximum(inverse.sum(axis=0), 0)
        value, new = knapsack(duals, size, room)
        if value <= NEAR:
            break
        way = inverse @ new
        ratio = np.where(way > 1e-9, use / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        use = use - ratio[out] * way
        use[out] = ratio[out]
        np.maximum(use, 0, out=use)
        pivot = inverse[out] / way[out]
        inverse = inverse - np.outer(way, pivot)
        inverse[out] = pivot
        columns[:, out] = new
    return columns.astype(np.int64), use


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class: how many}) and how often each is used; together they use every item of the histogram once."""
    size = np.array(sorted(k for k, v in histogram.items() if v), np.int64)
    if not len(size):
        return []
    demand = np.array([histogram[int(k)] for k in size], np.int64)
    columns, use = patterns(size, demand.astype(float), room)
    left = demand.copy()
    out: list[tuple[dict[int, int], int]] = []
    for p in np.argsort(-use, kind="stable"):
        column = columns[:, p]
        n = int(min(np.floor(use[p] + 1e-9), (left[column > 0] // column[column > 0]).min(initial=10**18)))
        if n > 0:
            left -= n * column
            out.append(({int(size[i]): int(column[i]) for i in np.flatnonzero(column)}, n))
    # What rounding left: the fullest sequence that the items left allow, again and again.
    while left.any():
        free, pattern = room, {}
        for i in np.flatnonzero(left)[::-1]:
            n = int(min(left[i], free // size[i]))
            if n:
                pattern[int(size[i])] = n
                free -= n * int(size[i])
        n = min(int(left[np.searchsorted(size, k)] // v) for k, v in pattern.items())
        for k, v in pattern.items():
            left[np.searchsorted(size, k)] -= n * v
        out.append((pattern, n))
    return out


def pack(cut: DataFrame, sequence: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """The pieces (as :func:`pieces` gives them, written) with sequence_id and offset.

    Ranks within a class come from counts by (class, bucket), so that no class, however common, is sorted in one task;
    repeated rows are dealt over buckets by their number within the task that read them.
    The driver sees the histogram (at most sequence / grain counts) and the patterns.
    """
    spark = cut.sparkSession
    total = cut.count()
    buckets = max(1, -(-total // RANKED))
    rows = cut.withColumn("__class", F.ceil(F.col("length") / grain).cast("int")).withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "start", "nth"), F.lit(buckets)))
    counts = written(rows.groupBy("__class", "__bucket").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("__class").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__class", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    histogram = {r["__class"]: r["n"] for r in counts.groupBy("__class").agg(F.sum("n").alias("n")).collect()}
    intervals, taken, first = [], dict.fromkeys(histogram, 0), 0
    for pattern, n in plan(histogram, sequence // grain):
        slot = 0
        for k in sorted(pattern, reverse=True):
            intervals.append((k, taken[k], taken[k] + pattern[k] * n, pattern[k], first, slot))
            taken[k] += pattern[k] * n
            slot += pattern[k]
        first += n
    dealt = spark.createDataFrame(intervals, "class int, lo long, hi long, each long, first long, slot long")
    own = Window.partitionBy("__class", "__bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens", "nth")
    ranked = rows.join(bases, ["__class", "__bucket"]).withColumn("__rank", F.col("__base") + F.row_number().over(own) - 1)
    placed = ranked.join(F.broadcast(dealt), (F.col("__class") == F.col("class")) & (F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi")))
    nth = F.col("__rank") - F.col("lo")
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor(nth / F.col("each")).cast("long")).withColumn("__slot", F.col("slot") + nth % F.col("each"))
    inside = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))


def packed(docs: DataFrame, tokenizer: str, *, text: str = "text", doc_id: str = "doc_id", sequence: int = SEQUENCE, end_id: int = END_ID, grain: int = GRAIN) -> DataFrame:
    """Every piece of every document with its place in a sequence; texts are read once, the pieces written."""
    return pack(written(pieces(docs, tokenizer, text=text, doc_id=doc_id, sequence=sequence, end_id=end_id)), sequence, grain)
