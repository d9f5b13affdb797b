"""Removal of repeated byte strings: a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts
elsewhere, in this or another text. Suffixes are cut to the bytes that decide,
sorted in local runs, exchanged front-coded by ranges of the sort order, and
each range merged by a loser tree (``sorted_runs``) that never compares a
prefix again. Two windows are equal only if the merge finds their bytes equal.

Not every position of the corpus is sorted. Positions without a partner are
set aside first, without loss: equal windows have the same least hash among
their inner strings (their anchor) at the same offset, so only windows whose
anchor occurs again can be equal. They are then sorted from coarse to fine:
all windows of an anchor as one suffix; of those that found no equal, aligned
blocks of windows; of those, single windows. At each step a suffix goes on
only if it found no equal, met by one copy of those of its anchor that did,
and blocks whose common bytes are nowhere else are dropped. What occurs again
is known through bit filters of bounded size, so texts are read again rather
than exchanged; a filter may let others pass, which then find no equal. A run
holds equal suffixes once, so a string that a third of the corpus repeats is
one item per run, not a crowded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.llm.common import bit_filter, passes, save, scratch, small_batches
from lexatlas.llm.sorted_runs import borders_of, cut_at, decode, equal_groups, front_code

LENGTH = 400
#: Windows of a block, from step to step.
STEPS = (64, 8, 1)
#: Bytes of texts hashed at a time, and of suffixes in one run.
SEGMENT, RUN_BYTES = 1 << 20, 8 << 20
#: Bits of a filter per value that occurs again.
FILTER_BITS = 64
#: Suffixes that a range of the sort order is meant to hold, and suffixes that the borders are chosen from.
RANGE_ITEMS, SAMPLE_ITEMS = 50_000, 4096
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: What makes items of a source's rows.
Cut = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
PLACES = ["key", "start", "windows", "anchor", "class"]
ITEMS = "key binary, start int, windows int, anchor int, class long, bytes binary"


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash per string of ``size`` bytes of ``data``; equal strings have equal hashes."""
    n = len(data)
    if n < size:
        return np.empty(0, np.uint64)
    powers = np.full(n + 1, BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64, out=sums[1:])
    back = np.full(n - size + 1, INVERSE, np.uint64)
    back[0] = 1
    hashes = (sums[size:] - sums[:-size]) * np.cumprod(back, dtype=np.uint64)
    for shift, factor in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
        hashes ^= hashes >> np.uint64(shift)
        hashes *= np.uint64(factor)
    return hashes ^ (hashes >> np.uint64(31))


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Least hash of every ``width`` neighbours."""
    done, least = 1, hashes
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    return np.minimum(least[: len(least) - (width - done)], least[width - done :]) if done < width else least


def anchors(text: bytes, length: int = LENGTH, apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with a common anchor: first window, windows, place of the anchor, its hash.

    The anchor of a window is the first of the least hashes of the inner
    strings of a quarter its length, so it depends on the window's bytes alone.
    In periodic text the least hash comes again and again; such windows are one
    stretch without a place (-1), unless they are to be told ``apart``.
    """
    inner = max(1, length // 4)
    width = length - inner + 1
    found: list[tuple[np.ndarray, ...]] = []
    data = np.frombuffer(text, np.uint8)
    for base in range(0, max(0, len(data) - length + 1), SEGMENT):
        hashes = string_hashes(data[base : base + SEGMENT + length - 1], inner)
        least = _least(hashes, width)
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        last = np.append(first[1:], len(least)) - 1
        step = np.arange(width)
        while len(first):
            at = np.empty(len(first), np.int64)
            for low in range(0, len(first), 4096):
                part = first[low : low + 4096]
                at[low : low + 4096] = part + (hashes[part[:, None] + step] == least[part][:, None]).argmax(axis=1)
            more = at < last
            if not apart:
                found.append((first + base, last - first + 1, np.where(more, -1, at + base), least[first]))
                break
            stop = np.minimum(last, at)
            found.append((first + base, stop - first + 1, at + base, least[first]))
            first, last = at[more] + 1, last[more]
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))  # type: ignore[return-value]


def _key(body: Column) -> Column:
    """Half of the SHA-256 of a text: equal texts have the same anchors and spans."""
    return F.unhex(F.substring(F.sha2(body, 256), 1, 32))


def _again(values: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A filter that passes the values of a long column that several rows have, and the number of these rows."""
    twice = save(values.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "twice")
    return bit_filter(twice, column, FILTER_BITS), twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _classes(bodies: DataFrame, length: int) -> DataFrame:
    """The hash of every anchor of every text; twice for a periodic stretch, whose windows may equal each other."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for body in batch.column("body"):
                _, _, anchor, hashes = anchors(body.as_py(), length)
                found += [hashes, hashes[anchor < 0]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], ["class"])

    return bodies.select("body").mapInArrow(scan, "class long")


def _cut(bodies: DataFrame, length: int, again: np.ndarray) -> tuple[DataFrame, Cut]:
    """One suffix per anchor that occurs again: all its windows; as rows and what makes items of them."""
    shared = bodies.sparkSession.sparkContext.broadcast(again)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ITEMS.split(", ")]
        for batch in batches:
            keys, parts, strings = [], [], []
            for key, body in zip(batch.column("key").to_pylist(), batch.column("body"), strict=True):
                text = body.as_py()
                found = anchors(text, length)
                wanted = passes(shared.value, found[3])
                if wanted.any():
                    start, windows, anchor, hashes = (f[wanted] for f in found)
                    keys += [key] * len(start)
                    parts.append((start, windows, anchor, hashes.view(np.int64)))
                    strings += [text[s : s + n - 1 + length] for s, n in zip(start.tolist(), windows.tolist(), strict=True)]
            if parts:
                columns = [np.concatenate(p) for p in zip(*parts, strict=True)]
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *arrays, pa.array(strings, pa.binary())], names)

    return bodies.select("key", "body"), cut


RUNS = f"{ITEMS}, run long, number long, again boolean, head boolean, range int, block binary"


def _runs(source: DataFrame, cut: Cut, borders: list[bytes]) -> DataFrame:
    """Sorted runs: a row per suffix with its number in the run, and rows (range, run, block) that hold the runs front-coded.

    Equal suffixes of a run share a number; only the first keeps its bytes and
    is the ``head``. Items are cut and sorted by one Python worker.
    """
    shared = source.sparkSession.sparkContext.broadcast(borders)  # at most SAMPLE_ITEMS strings

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = [field.split()[0] for field in RUNS.split(", ")]
        types = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary()]
        run = TaskContext.get().partitionId() << 24

        def rows(columns: dict, count: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[n] if n in columns else pa.nulls(count, t) for n, t in zip(names, types, strict=True)], names)

        def finish(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts).combine_chunks()
            strings = table.column("bytes").to_pylist()
            order: dict[bytes, int] = dict.fromkeys(strings, 0)
            distinct = sorted(order)
            order = {s: i for i, s in enumerate(distinct)}
            number = np.fromiter(map(order.__getitem__, strings), np.int64, len(strings))
            times = np.bincount(number, minlength=len(distinct))
            head = np.zeros(len(strings), bool)
            head[np.unique(number, return_index=True)[1]] = True
            columns = {n: table.column(n).combine_chunks() for n in names[:5]}
            columns |= {
                "bytes": pa.array([s if h else None for s, h in zip(strings, head.tolist(), strict=True)], pa.binary()),
                "run": pa.array(np.full(len(strings), run)), "number": pa.array(number), "again": pa.array(times[number] > 1), "head": pa.array(head),
            }
            whole = rows(columns, len(strings))
            yield from (whole.slice(at, 4096) for at in range(0, len(strings), 4096))
            cuts = list(cut_at(distinct, shared.value))
            blocks = [front_code(distinct[a:b], range(a, b)) for _, a, b in cuts]
            yield rows({"run": pa.array([run] * len(cuts), pa.int64()), "range": pa.array([c[0] for c in cuts], pa.int32()), "block": pa.array(blocks, pa.binary())}, len(cuts))

        parts, size = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch)
                size += batch.column("bytes").nbytes
            if size >= RUN_BYTES:
                yield from finish(parts)
                parts, size, run = [], 0, run + 1
        if parts:
            yield from finish(parts)

    return source.mapInArrow(lambda batches: build(cut(batches)), RUNS)


def _merged(runs: DataFrame) -> DataFrame:
    """Suffixes that several runs hold: run, number, first (of those that are equal)."""

    def merge(table: pa.Table) -> pa.Table:
        run, number, first = [], [], []
        numbers = table.column("run").to_pylist()
        for _, met in equal_groups([decode(block) for block in table.column("block").to_pylist()]):
            if len(met) > 1:
                run += [numbers[r] for r, _ in met]
                number += [n for _, n in met]
                first += [True] + [False] * (len(met) - 1)
        return pa.table({"run": pa.array(run, pa.int64()), "number": pa.array(number, pa.int64()), "first": pa.array(first, pa.bool_())})

    blocks = runs.filter("block is not null").select("range", "run", "block")
    return blocks.groupBy("range").applyInArrow(merge, "run long, number long, first boolean")


def sort_suffixes(source: DataFrame, cut: Cut, count: int, sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All items that ``cut`` makes of the source's rows, with ``repeated`` (equal bytes are elsewhere) and ``copy`` (it stands for its equals), and the heads' bytes.

    ``sample`` holds some of the about ``count`` items, to choose the borders of the ranges from.
    """
    borders = []
    if count > RANGE_ITEMS:
        found = sample.select("bytes").distinct().limit(2 * SAMPLE_ITEMS).toLocalIterator()
        borders = borders_of((bytes(r["bytes"]) for r in found), min(SAMPLE_ITEMS, -(-count // RANGE_ITEMS)))
    runs = save(_runs(source, cut, borders), "runs")
    rows = runs.filter("block is null").drop("range", "block", "bytes")
    met = rows.join(_merged(runs), ["run", "number"], "left")
    stands = F.col("head") & F.coalesce("first", F.lit(True))
    level = met.select(*PLACES, "run", "number", (F.col("again") | F.col("first").isNotNull()).alias("repeated"), stands.alias("copy"))
    return save(level, "level"), runs.filter("head").select("run", "number", "bytes")


def _blocks(row: dict, block: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Aligned blocks of a suffix's windows: number, first window, windows, and where the bytes begin that a whole block has in common.

    Blocks are aligned to the anchor, so that equal windows lie in equal blocks.
    """
    parts = [(0, row["windows"], row["anchor"] - row["start"])]
    if row["anchor"] < 0:
        first, many, anchor, _ = anchors(row["bytes"], length, apart=True)
        parts = zip(first.tolist(), many.tolist(), anchor.tolist(), strict=True)
    for first, windows, anchor in parts:
        at = first
        while at < first + windows:
            number = (anchor - at) // block
            many = min(first + windows - at, anchor - at - number * block + 1)
            yield number, at, many, anchor - number * block
            at += many


def _digests(row: dict, block: int, length: int) -> np.ndarray:
    """A hash per block of a suffix, of the bytes that all windows of the whole block have in common."""
    import xxhash

    seed, whole = row["class"], row["bytes"]
    found = [xxhash.xxh3_64_intdigest(whole[s : s + length - block + 1], seed + n & (1 << 64) - 1) for n, _, _, s in _blocks(row, block, length)]
    return np.array(found, np.uint64)


def _finer(level: DataFrame, heads: DataFrame, block: int, length: int) -> tuple[DataFrame, Cut, int, DataFrame]:
    """The windows that are still open, in blocks of ``block``, as items: those whose common bytes are elsewhere, too."""
    classes = level.filter("not repeated").select("class").distinct()
    ids = level.filter("copy").join(classes, "class", "left_semi").drop("repeated", "copy")
    found = ids.join(heads, ["run", "number"]).select(*[c.split()[0] for c in ITEMS.split(", ")])

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [_digests(row, block, length).view(np.int64) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.list_(pa.int64()))], [*batch.schema.names, "digests"])

    held = save(found.mapInArrow(common, f"{ITEMS}, digests array<long>"), "open")
    again, count = _again(held.select(F.explode("digests").alias("digest")), "digest")
    shared = held.sparkSession.sparkContext.broadcast(again)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names, types = [c.split()[0] for c in ITEMS.split(", ")], [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        out: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                wanted = passes(shared.value, np.array(row["digests"], np.int64).view(np.uint64)).tolist()
                for (number, at, many, common_at), is_wanted in zip(_blocks(row, block, length), wanted, strict=True):
                    if is_wanted:
                        inner = xxhash.xxh3_64_intdigest(number.to_bytes(8, "little"), row["class"] & (1 << 64) - 1) - (1 << 63)
                        anchor = row["start"] + common_at + number * block
                        out.append((row["key"], row["start"] + at, many, anchor, inner, row["bytes"][at : at + many - 1 + length]))
                        if len(out) >= 4096:
                            yield made(out)
                            out = []
        if out:
            yield made(out)

    def some(frame: DataFrame) -> DataFrame:
        return frame.filter(F.pmod(F.xxhash64("key", "start"), F.lit(max(1, count // SAMPLE_ITEMS))) == 0)

    return held, cut, count, some(held).mapInArrow(cut, ITEMS)


def _outcomes(bodies: DataFrame, length: int, kept_bytes: bool) -> DataFrame:
    """Spans and what is left of every different text that loses bytes: key, spans, kept (null if not asked for), kept_sha256."""

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body, found in zip(batch.column("key").to_pylist(), batch.column("body"), batch.column("found").to_pylist(), strict=True):
                text, spans = body.as_py(), []
                for start, stop in sorted((f["start"], f["start"] + f["windows"] - 1 + length) for f in found):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], stop)
                    else:
                        spans.append([start, stop])
                kept, at = [], 0
                for start, stop in spans:
                    kept.append(text[at:start])
                    at = stop
                left = b"".join((*kept, text[at:]))
                listed = pa.array([[{"start": a, "stop": b} for a, b in spans]], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), listed, pa.array([left if kept_bytes else None], pa.binary()), pa.array([hashlib.sha256(left).hexdigest()])], ["key", "spans", "kept", "kept_sha256"])

    with scratch(bodies.sparkSession) as keep:
        again, count = _again(_classes(bodies, length), "class")
        some = bodies.filter(F.pmod(F.xxhash64("body", F.lit(1)), F.lit(max(1, count // SAMPLE_ITEMS))) == 0)
        few, cut_few = _cut(some, length, again)
        level, heads = sort_suffixes(*_cut(bodies, length, again), count, few.mapInArrow(cut_few, ITEMS))
        spans = [level.filter("repeated").select("key", "start", "windows")]
        for block in [b for b in STEPS if b <= length]:
            level, heads = sort_suffixes(*_finer(level, heads, block, length))
            spans.append(level.filter("repeated").select("key", "start", "windows"))
        merged = reduce(DataFrame.unionByName, spans)
        spans = keep(merged.groupBy("key").agg(F.collect_set(F.struct("start", "windows")).alias("found")), "spans")
    losing = bit_filter(spans.select(F.xxhash64("key").alias("key")), "key", FILTER_BITS)
    shared = bodies.sparkSession.sparkContext.broadcast(losing)

    @F.pandas_udf("boolean")
    def may_lose(keys: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, keys.to_numpy(np.int64).view(np.uint64)))

    held = bodies.filter(may_lose(F.xxhash64("key"))).select("key", "body")
    outcomes = held.join(spans, "key").mapInArrow(take_out, "key binary, spans array<struct<start:long,stop:long>>, kept binary, kept_sha256 string")
    return (outcomes if kept_bytes else outcomes.drop("kept").withColumn("kept", F.lit(None).cast("binary"))).dropDuplicates(["key"])


def remove_repeats(documents: DataFrame, length: int = LENGTH, kept_bytes: bool = True) -> DataFrame:
    """Every row's doc_id, n_bytes, ``spans`` removed (from, to; maximal, in order), ``kept`` bytes and their SHA-256.

    Without ``kept_bytes`` there is no column ``kept``, and no bytes are handed on for it.

    Texts are UTF-8 bytes, null is empty, and a text shorter than ``length``
    keeps all; rows with equal texts are texts of their own, so each loses all
    that is long enough; ids may be null or repeat and are handed on as they
    are; other columns are not read; an empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    bodies = documents.select(body.alias("body")).filter(F.octet_length("body") >= length).select("body", _key(F.col("body")).alias("key"))
    outcomes = _outcomes(bodies, length, kept_bytes)
    rows = documents.select("doc_id", body.alias("_body")).select(
        "doc_id", "_body", _key(F.col("_body")).alias("key"), F.octet_length("_body").cast("long").alias("n_bytes"), F.sha2("_body", 256).alias("_whole")
    )
    none = F.expr("cast(array() as array<struct<start:long,stop:long>>)")
    kept = [F.coalesce("kept", "_body").alias("kept")] if kept_bytes else []
    spans, digest = F.coalesce("spans", none).alias("spans"), F.coalesce("kept_sha256", "_whole").alias("kept_sha256")
    return rows.join(outcomes, "key", "left").select("doc_id", "n_bytes", spans, *kept, digest)
