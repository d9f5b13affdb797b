"""Packing of documents into fixed-length sequences: shortest pack first over the length histogram.

Every document is cut into full sequences and one shorter rest. Rests are
placed longest first, each into the shortest pack that has room; equal packs
are one pattern with a count, so planning works on at most ``length`` histogram
rows whatever the number of documents. A pattern owns a range of sequence ids
and, per length, ranges of ranks; documents find their place by their rank
among the pieces of equal length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.llm.common import level_buckets, running_start, save, small_batches
from lexatlas.llm.tokens import loaded

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACES = np.dtype([("length", "i8"), ("rank", "i8"), ("sequence", "i8"), ("offset", "i8")])


def cut_pieces(documents: DataFrame, tokenizer: str, length: int, end_id: int) -> DataFrame:
    """Pieces of at most ``length`` ids of each document, its end id included."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, step = loaded(tokenizer), np.asarray([end_id], "<u4").tobytes(), 4 * length
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                whole = ids + end
                for at in range(0, len(whole), step):
                    part = whole[at : at + step]
                    rows.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(whole) // 4))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def plan_packs(histogram: dict[int, int], length: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns as (count, ((length, copies), ...)), longest lengths first.

    ``histogram`` maps a length to its number of pieces. Every step uses up
    either a length or a pattern, so there are at most twice as many steps as
    lengths.
    """
    open_packs: dict[int, list[list]] = defaultdict(list)  # by what they hold
    held: list[int] = []
    done: list[tuple[int, tuple[tuple[int, int], ...]]] = []

    def put(used: int, count: int, parts: tuple[tuple[int, int], ...]) -> None:
        if used == length:
            done.append((count, parts))
            return
        if not open_packs[used]:
            bisect.insort(held, used)
        open_packs[used].append([count, parts])

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            used = held[0] if held and held[0] + size <= length else None
            if used is None:
                # No room anywhere: new packs of as many pieces of this length as fit.
                copies = length // size
                packs, rest = divmod(left, copies)
                if packs:
                    put(copies * size, packs, ((size, copies),))
                if rest:
                    put(rest * size, 1, ((size, rest),))
                break
            count, parts = open_packs[used].pop()
            if not open_packs[used]:
                held.remove(used)
            taken = min(count, left)
            put(used + size, taken, (*parts, (size, 1)))
            if count > taken:
                put(used, count - taken, parts)
            left -= taken
    for used in held:
        done.extend((count, parts) for count, parts in open_packs[used])
    return done


def places(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> np.ndarray:
    """For each length, from which rank on pieces go to which sequence and offset.

    Rank r of a row's range goes to sequence ``sequence + r - rank``. Rows grow
    with the number of patterns, not of documents.
    """
    ranks: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for count, parts in patterns:
        offset = 0
        for size, copies in parts:
            for _ in range(copies):
                rows.append((size, ranks[size], base, offset))
                ranks[size] += count
                offset += size
        base += count
    return np.sort(np.array(rows, dtype=PLACES), order=["length", "rank"])


def pack(documents: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack all documents; one row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and
    offset. A null text is empty and yields its end id alone, a null id stays
    null, repeated rows are packed each, equal pieces may change places, an
    empty table gives no rows, other columns are not read.
    """
    spark = documents.sparkSession
    pieces = save(cut_pieces(documents, tokenizer, length, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `length` rows
    table = places(plan_packs(histogram, length)) if histogram else np.empty(0, PLACES)
    shared = spark.sparkContext.broadcast(table)
    ranked = running_start(
        pieces, ["length"], ["doc_id", "start"], F.lit(1), "rank", level_buckets(sum(histogram.values())), ["ids_crc32", "doc_tokens"]
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows = shared.value
        lengths, at = size.to_numpy(), np.empty(len(size), "i8")
        for value in np.unique(lengths):
            low, high = np.searchsorted(rows["length"], [value, value + 1])
            mine = lengths == value
            at[mine] = low + np.searchsorted(rows["rank"][low:high], rank.to_numpy()[mine], side="right") - 1
        found = rows[at]
        return pd.DataFrame({"sequence_id": found["sequence"] + rank.to_numpy() - found["rank"], "offset": found["offset"]})

    return ranked.withColumn("_place", place("length", "rank")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset")
    )
