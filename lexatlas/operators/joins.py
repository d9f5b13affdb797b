"""Join helpers for sides of unknown size and skewed keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side may be broadcast only when its counted rows fit below this bound.
BROADCAST_ROWS = 500_000
#: ... and its rows are at most this wide (bytes, estimated from a bounded read).
BROADCAST_BYTES = 64 << 20
SALTS = 32


def fits_broadcast(frame: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a side; stops reading as soon as the row bound is passed."""
    probe = frame.limit(max_rows + 1)
    size = F.lit(0).cast("long")
    for field in frame.schema.fields:
        column = F.col(f"`{field.name}`")
        if field.dataType.typeName() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif field.dataType.typeName() in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            size = size + F.lit(8)
    row = probe.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return row["n"] <= max_rows and row["bytes"] <= max_bytes


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Column,
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join whose hot keys are spread over ``salts`` tasks.

    ``spread`` must vary within one key of ``big`` (usually its row id).
    ``small`` holds few rows per key and is copied once per salt.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn(
        "_salt", F.col("_salt").cast("long")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def bounded_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Column,
    how: str = "inner",
    broadcast: bool | None = None,
) -> DataFrame:
    """Broadcast ``small`` when it is measured to fit, else join salted."""
    if broadcast is None:
        broadcast = fits_broadcast(small)
    if broadcast:
        return big.join(F.broadcast(small), list(keys), how)
    return salted_join(big, small, keys, spread, how)


def narrow(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted, found before anything costly is done to them.

    A measured broadcast keeps the rows from being exchanged at all.
    """
    return bounded_join(rows, wanted.select(key).distinct(), [key], F.col(key), "left_semi")


#: Bytes read for one piece of a placement; the line table made of a piece is sorted in about fifty times as much memory.
PIECE_BYTES = 4 << 20
#: More pieces than any known size asks for: the size of some source is not known.
MOST_PIECES = 1 << 20


def pieces(frame: DataFrame, piece_bytes: int | None = None) -> int | None:
    """Pieces that rows derived from ``frame`` are placed in: as many more as its sources are larger.

    Partitions that Spark chooses itself grow with the input up to its advisory
    size, which counts the rows as they are exchanged and not what becomes of
    them. None if the size of a source is not known.
    """
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    count = max(frame.sparkSession.sparkContext.defaultParallelism, math.ceil(size / (piece_bytes or PIECE_BYTES)))
    return count if count <= MOST_PIECES else None


def place(frame: DataFrame, key: str, count: int | None) -> DataFrame:
    """Rows placed by ``key`` in ``count`` pieces, see :func:`pieces`."""
    return frame.repartition(key) if count is None else frame.repartition(count, key)


#: Bytes per core below which a scan has too few tasks to fill them.
SMALL_SCAN = 8 << 20


def spread(frame: DataFrame) -> DataFrame:
    """Spread the rows of a small scan over all cores before costly per-row work.

    Frames that come in as many partitions as there are cores, and large
    inputs, are returned as they are.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    plan = frame._jdf.queryExecution()
    small = int(str(plan.optimizedPlan().stats().sizeInBytes())) < SMALL_SCAN * cores
    return frame.repartition(cores) if small and plan.sparkPlan().outputPartitioning().numPartitions() < cores else frame
