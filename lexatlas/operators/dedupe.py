"""Exact duplicates, conflicting ids and keep-first selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the canonical JSON of some columns (JSN-01)."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def duplicate_groups(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """Identical contents with their size and first id (SET-06).

    Counts and minima combine map-side, so one content held by a third of all
    rows costs one row per map task.
    """
    return (
        rows.groupBy(F.sha2(content, 256).alias("content_hash"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id"))
        .where("copies > 1")
    )


def conflicting_ids(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """Ids that occur with more than one content (SET-06)."""
    digest = F.sha2(content, 256)
    return (
        rows.groupBy(key)
        .agg(F.min(digest).alias("lo"), F.max(digest).alias("hi"), F.count(F.lit(1)).alias("rows"))
        .where("lo <> hi")
        .select(key, "rows")
    )


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by some order (SET-07) as a combinable minimum."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def corpus_xor(rows: DataFrame, record: Column) -> DataFrame:
    """Order-independent corpus hash: XOR of per-record SHA-256 (A-20).

    The digest is folded in pieces that fit a long.  XOR cancels a record that
    occurs twice, so the record count and a sum of one piece are kept as well.
    """
    digest = F.sha2(record, 256)
    pieces = [F.conv(F.substring(digest, 1 + 15 * i, 15 if i < 4 else 4), 16, 10).cast("long") for i in range(5)]
    hexed = [F.lpad(F.lower(F.hex(F.bit_xor(p))), 15 if i < 4 else 4, "0") for i, p in enumerate(pieces)]
    return rows.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.concat(*hexed).alias("xor_sha256"),
        F.sum(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")).alias("prefix_sum"),
    )


def multiset_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``left`` not matched one by one in ``right`` (SET-05), with counts."""
    tagged = left.select(*columns, F.lit(1).alias("_d")).unionByName(right.select(*columns, F.lit(-1).alias("_d")))
    return tagged.groupBy(*columns).agg(F.sum("_d").alias("missing")).where("missing > 0")
