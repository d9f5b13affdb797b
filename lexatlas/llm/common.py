"""Shared pieces of the pipeline operators: tables in the shared folder, words, two-level positions."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; the same class splits bytes in Python.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows a table may have before it is no longer sent to every executor.
BROADCAST_ROWS = 100_000
#: Texts per Arrow batch, so that a batch of very long texts still fits a worker.
BATCH_ROWS = 1_000


#: Folders made for sessions that name none, by application; and the tables of the scratch blocks that are open.
_folders: dict[str, str] = {}
_scratch: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or an own one in local runs only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _folders:
        _folders[application] = tempfile.mkdtemp(prefix="lexatlas-", dir=os.environ.get("TMPDIR"))
    return _folders[application]


def save(frame: DataFrame, what: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends, any executor can reread it.

    Also fixes values that a recomputation might number anew, and lets later
    readers fetch single columns. Inside a ``scratch`` block the table goes
    with the block.
    """
    path = f"{shared_folder(frame.sparkSession)}/lexatlas/{what}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose saved tables are deleted at its end; what it yields saves a table that outlives the block.

    Nothing lazy may leave the block but what reads tables saved that way, so
    a lost executor finds every table that its work still needs.
    """
    own: list[str] = []

    def keep(frame: DataFrame, what: str) -> DataFrame:
        _scratch.remove(own)
        try:
            return save(frame, what)
        finally:
            _scratch.append(own)

    _scratch.append(own)
    try:
        yield keep
    finally:
        _scratch.remove(own)
        for name in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the texts per Arrow batch of this session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def worker_state() -> dict:
    """Values that a Python worker keeps from task to task.

    The package's functions travel by value, so their own globals are new in every task.
    """
    return vars(sys.modules.setdefault("_lexatlas_worker", types.ModuleType("_lexatlas_worker")))


def let_go() -> None:
    """Free what tasks of other operators keep in this worker, before work that needs memory of its own."""
    worker_state().clear()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lowered(text: Column) -> Column:
    """ASCII letters in lower case and nothing else changed."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


#: Bounds of a bit filter's size as powers of two: at most 32 MB.
FILTER_LEAST, FILTER_MOST = 16, 28


def bit_filter(values: DataFrame, column: str, per_value: int) -> np.ndarray:
    """A bit for each value of a long column, as 64-bit words: ``per_value`` bits a row, up to a fixed size.

    Sent to tasks to leave out rows that cannot match before anything is
    exchanged. It passes some that do not; full, it only filters less.
    """
    count = max(1, values.count())
    bits = min(FILTER_MOST, max(FILTER_LEAST, (count * per_value).bit_length()))
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    placed = values.select(slot.alias("_slot")).select(F.shiftright("_slot", 6).alias("at"), F.expr("shiftleft(1L, cast(_slot & 63 as int))").alias("bit"))
    table = np.zeros(1 << bits - 6, np.int64)
    for row in placed.groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # no more rows than the filter has words
        table[row["at"]] = row["bits"]
    return table.view(np.uint64)


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values (uint64) the filter lets pass."""
    slots = values & np.uint64((len(bits) << 6) - 1)
    return (bits[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1) > 0


def level_buckets(rows: int) -> int:
    """Buckets for two-level numbering: both levels hold about the root of the rows."""
    return max(1, math.isqrt(max(rows, 0)) // 16)


def running_start(
    frame: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str, buckets: int, payload: Sequence[str] = ()
) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group``, in a fixed pseudorandom order.

    Rows of a group are dealt into buckets by a hash of the ``order`` columns,
    summed inside each, and the sums of earlier buckets added; so a group with
    a third of all rows is spread over many tasks. ``frame`` is read twice:
    save it first. Rows equal in all ``order`` columns and ``payload`` are interchangeable.
    """
    placed = frame.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets))).withColumn("_value", value)
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order, *payload).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*group, "_bucket")
        .agg(F.sum("_value").alias("_sum"))
        .select(*group, "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    )
    return (
        placed.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(starts, [*group, "_bucket"])
        .withColumn(name, (F.col("_ahead") + F.col("_inside")).cast("long"))
        .drop("_bucket", "_value", "_inside", "_ahead")
    )


def numbered(frame: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number rows from 0 in a total order: ranges in parallel, then the ranges' starts."""
    ranged = save(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(starts, "_range").withColumn(name, F.col("_ahead") + F.col("_inside") - 1).drop("_range", "_ahead", "_inside")
