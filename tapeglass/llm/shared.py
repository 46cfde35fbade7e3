"""Helpers that several operators share: tables in the shared folder, size-checked joins, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import bounded, lean

#: Most bytes that one side of a join may have, by its row count and width, to be broadcast.
BROADCAST_BYTES = 24 << 20
#: The shuffle files of a write that is done are of no more use: Spark deletes them at once.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits a key of the filters of hashes, and the logarithm of the bits that a filter has at least and at most (64 MB).
BITS_A_KEY, FILTER_LEAST, FILTER_MOST = 16, 20, 29


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the checkpoint folder set on the context.

    Where neither is set, a local session (driver and executors in one process) gets one of its own; on a cluster that
    would be a folder of one machine only, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="tapeglass-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage is cut and lost executors lose nothing."""
    return _write(df)[0]


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tapeglass-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables that only the steps inside a ``with`` block read: they are deleted at its end.

    What leaves the block must itself be written before, so that nothing depends on them any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def written(self, df: DataFrame) -> DataFrame:
        out, path = _write(df)
        self.paths.append(path)
        return out

    def __exit__(self, *failure) -> None:
        delete(self.spark, self.paths)


def delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def small_enough(df: DataFrame, row_bytes: int | Column) -> bool:
    """Whether ``df`` (cheap to read: a written table) surely fits a broadcast; a column gives the bytes row by row."""
    size = F.count(F.lit(1)) * row_bytes if isinstance(row_bytes, int) else F.sum(row_bytes)
    return (df.agg(size.alias("b")).first()["b"] or 0) <= BROADCAST_BYTES


def offered(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is under the bound, else as it is: the join then shuffles."""
    return F.broadcast(df) if small_enough(df, row_bytes) else df


def _bitmap(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of the filter: 512 bytes each, of the keys of one partition (which holds all keys of its parts)."""
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - size)
            part = (at >> np.uint64(12)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at, part = at[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = parts.setdefault(int(part[a]), np.zeros(512, np.uint8))
                bit = at[a:b] & np.uint64(4095)
                np.bitwise_or.at(own, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([v.tobytes() for v in parts.values()], pa.binary())], names=["part", "bits"])

    return run


def _filter_parts(keys: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The parts of a filter of the hashes in ``column`` (of a written table), and the logarithm of its bits."""
    size = min(max(FILTER_LEAST, (BITS_A_KEY * keys.count()).bit_length()), FILTER_MOST)
    dealt = keys.select(column).repartition(F.shiftrightunsigned(column, 64 - size + 12))
    return dealt.mapInArrow(lean(_bitmap(size)), "part long, bits binary"), size


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A filter of the hashes in ``column`` (of a written table), sized by their counted number up to 64 MB.

    It only saves rows of a join that follows (it lets through what it cannot tell, and ever more the more keys there are
    beyond its bound).  Each part is made where its keys are, so the driver gets no more than the filter itself.
    """
    parts, size = _filter_parts(keys, column)
    bits = np.zeros(1 << (size - 3), np.uint8)
    for r in parts.toLocalIterator():
        bits[r["part"] * 512 : r["part"] * 512 + 512] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def marked(rows: DataFrame, ids: DataFrame, tmp: Scratch, key: str = "doc") -> DataFrame:
    """``rows`` with ``maybe``: whether ``key`` may be among that of ``ids`` (written), by such a filter, without a shuffle.

    Rows that are not need no part in a join with ``ids``.
    """
    parts, size = _filter_parts(tmp.written(ids.select(F.xxhash64(key).alias("h"))), "h")
    parts = F.broadcast(tmp.written(parts.withColumnRenamed("part", "__part").withColumnRenamed("bits", "__bits")))  # 64 MB at most
    h = F.xxhash64(key)
    bit = F.shiftrightunsigned(h, 64 - size).bitwiseAND(F.lit(4095)).cast("int")
    found = rows.join(parts.withColumn("__at", F.col("__part")), F.shiftrightunsigned(h, 64 - size + 12) == F.col("__at"), "left").withColumn("__bit", bit)
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__bit / 8 as int) + 1, 1)")), 16, 10).cast("int")
    on = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, __bit % 8)")) != 0, F.lit(False))
    return found.select(*rows.columns, on.alias("maybe"))


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be among the filter's."""
    at = hashes >> np.uint64(64 - (len(bits).bit_length() + 2))
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def identified(docs: DataFrame, text: str, doc_id: str, *, merged: bool = False) -> tuple[DataFrame, bool]:
    """doc, text, id, and whether ``doc`` is a number given to the rows: where ids are null or repeated it stands for the id.

    The numbers ascend with (id, hash of the text), null ids first.  Rows equal in both have a number each, or, ``merged``,
    that of the first.  The numbered texts are written once; where ids name the rows, nothing is.
    """
    rows = bounded(docs).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("distinct")).first()
    if n["rows"] == n["distinct"]:
        return rows.select(F.col("id").alias("doc"), "text", "id"), False
    same = ["id", "th", "th2"]
    hashed = rows.select("*", F.xxhash64("text").alias("th"), F.xxhash64(F.lit(7), "text").alias("th2"), F.monotonically_increasing_id().alias("n"))
    rows = written(hashed.sort(*same, "n").drop("n").withColumn("doc", F.monotonically_increasing_id()))  # n deals equal rows over partitions
    if merged:
        again = rows.groupBy(*same).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        again = offered(written(again.select(*(F.col(c).alias(f"{c}0") for c in same), "first")), 40)
        rows = rows.join(again, (F.col("th") == F.col("th0")) & (F.col("th2") == F.col("th20")) & F.col("id").eqNullSafe(F.col("id0")), "left").withColumn("doc", F.coalesce("first", "doc"))
    return rows.select("doc", "text", "id"), True


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long).  Returns (node, component), component the least node reachable.

    Every round takes the least label among the neighbours and then the label of that label; labels are written
    after each round.  Only minima cross a shuffle, so a hub with many edges needs no large task.
    """
    with Scratch(edges.sparkSession) as tmp:
        both = tmp.written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
        labels, path = _write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
        while True:
            near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
            step = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
            up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
            new, new_path = _write(step.join(up, "label", "left").select("node", "was", F.least("label", "up").alias("label")))
            delete(edges.sparkSession, [path])
            if new.where("label <> was").isEmpty():
                return new.select("node", F.col("label").alias("component"))
            labels, path = new.select("node", "label"), new_path
