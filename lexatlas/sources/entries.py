"""Large JSON objects and arrays, cut at their top-level entries by byte range.

A file of one JSON object or array is one row to a line reader and so one
task. Here every range of bytes is read by a task of its own, twice: first it
is summed up (whether a string is open at its end and how the depth changes,
for either state at its start), which gives the true state at the start of
every range; then each task hands on the entries that begin in its range.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and bytes read at a time beyond it to end its last entry.
RANGE_BYTES, MORE_BYTES = 32 << 20, 1 << 20
ENTRIES = "path string, at long, key string, value string"


def _open(path: str):
    """A random-access file of any Arrow file system (local, HDFS, object stores)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _read(path: str, start: int, size: int) -> bytes:
    with _open(path) as file:
        return file.read_at(size, start)


def escaped_before(path: str, start: int) -> bool:
    """Whether the byte at ``start`` follows an odd number of backslashes."""
    run, at = 0, start
    while at > 0:
        low = max(0, at - 4096)
        part = _read(path, low, at - low)
        stripped = part.rstrip(b"\\")
        run += len(part) - len(stripped)
        if stripped:
            break
        at = low
    return run % 2 == 1


def structure(data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: how many strings have begun or ended before it, and the change of depth it makes outside strings."""
    b = np.frombuffer(data, np.uint8)
    place = np.arange(len(b))
    other = np.maximum.accumulate(np.where(b != 92, place, -1))  # last byte up to here that is no backslash
    before = np.concatenate([[-1], other[:-1]])
    run = place - 1 - before
    run = run + np.where(before < 0, int(escaped), 0)  # a run that reaches back over the start
    quote = (b == 34) & (run % 2 == 0)
    ended = np.concatenate([[0], np.cumsum(quote)[:-1]])
    change = ((b == 123) | (b == 91)).astype(np.int64) - ((b == 125) | (b == 93))
    return ended, change


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, open_string: bool, depth: int):
        self.path, self.start, self.stop, self.open_string, self.depth = path, start, stop, open_string, depth


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.ranges = json.loads(options["ranges"])

    def partitions(self):
        return [_Range(*r) for r in self.ranges]


class _SummaryReader(_RangeReader):
    def read(self, partition: _Range) -> Iterator[tuple]:
        data = _read(partition.path, partition.start, partition.stop - partition.start)
        # A quote in front of a closing byte: the count before the added byte is that of the whole range.
        ended, change = structure(data + b" ", escaped_before(partition.path, partition.start))
        outside = [int(change[(ended + s) % 2 == 0].sum()) for s in (0, 1)]
        yield partition.path, partition.start, partition.stop, bool(ended[-1] % 2), outside[0], outside[1]


class JsonSummaries(DataSource):
    """One row per range: path, start, stop, whether strings flip, and the change of depth for both states."""

    @classmethod
    def name(cls) -> str:
        return "lexatlas_json_summaries"

    def schema(self) -> str:
        return "path string, start long, stop long, flips boolean, outside long, inside long"

    def reader(self, schema) -> DataSourceReader:
        return _SummaryReader(self.options)


class _EntryReader(_RangeReader):
    def read(self, partition: _Range) -> Iterator[tuple]:
        path, base = partition.path, partition.start
        data = _read(path, base, partition.stop - base)
        escaped = escaped_before(path, base)
        while True:
            ended, change = structure(data, escaped)
            outside = (ended + partition.open_string) % 2 == 0
            change = np.where(outside, change, 0)
            after = partition.depth + np.cumsum(change)
            b = np.frombuffer(data, np.uint8)
            opening = (change > 0) & (after == 1)
            closing = (change < 0) & (after == 0)
            comma = outside & (b == 44) & (after == 1)
            marks = np.flatnonzero(opening | closing | comma)
            inside = partition.stop - base
            starts = marks[(marks < inside) & ~closing[marks]]
            # The last entry that begins here ends at the first mark behind it, maybe beyond the range.
            if not len(starts) or len(marks) and marks[-1] > starts[-1]:
                break
            more = _read(path, base + len(data), MORE_BYTES)
            if not more:
                raise ValueError(f"{path}: the top-level value does not end")
            data += more
        if int(after.min(initial=0)) < 0:
            raise ValueError(f"{path}: more brackets close than open")
        stray = outside & (after == 0) & (change == 0) & (np.arange(len(b)) < inside) & ~np.isin(b, np.frombuffer(b" \t\r\n\xef\xbb\xbf", np.uint8))
        if stray.any():
            raise ValueError(f"{path}: text outside the top-level object or array at byte {base + int(np.flatnonzero(stray)[0])}")
        following = dict(zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True))
        for start in starts.tolist():
            stop = following[start]
            text = data[start + 1 : stop].decode("utf-8", "strict").strip(" \t\r\n")
            if not text:
                if opening[start] and closing[stop]:
                    continue  # an empty object or array
                raise ValueError(f"{path}: empty entry at byte {base + start}")
            if text[0] == '"' and _is_member(text):
                key, at = json.JSONDecoder().raw_decode(text)
                value = text[at:].lstrip(" \t\r\n")[1:].strip(" \t\r\n")
                yield path, base + start, key, value
            else:
                yield path, base + start, None, text


def _is_member(text: str) -> bool:
    """Whether an entry is ``"key": value`` rather than a string of an array."""
    _, at = json.JSONDecoder().raw_decode(text)
    return text[at:].lstrip(" \t\r\n").startswith(":")


class JsonEntries(DataSource):
    """One row per top-level entry: path, place of the entry, key (null in arrays) and value as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "lexatlas_json_entries"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _EntryReader(self.options)


def read_entries(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Top-level entries of JSON object or array files, each file in as many tasks as it has ranges.

    ``path`` may name files, folders or patterns, as Spark lists them; their
    bytes are read through Arrow's file systems. A repeated key is not refused
    here, see :func:`unique_keys`. A byte order mark is skipped; an empty file
    has no entries; a scalar file and text around the value are errors.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # one row per file
    for source in (JsonSummaries, JsonEntries):
        spark.dataSource.register(source)
    ranges = [(f["path"], at, min(f["length"], at + range_bytes), False, 0) for f in files for at in range(0, f["length"], range_bytes)]
    if not ranges:
        return spark.createDataFrame([], ENTRIES)
    many = {f["path"] for f in files if f["length"] > range_bytes}
    states = {}
    if many:
        told = spark.read.format("lexatlas_json_summaries").option("ranges", json.dumps([r for r in ranges if r[0] in many])).load()
        open_string, depth, last = False, 0, None
        for row in sorted(told.collect(), key=lambda r: (r["path"], r["start"])):  # one row per range
            if row["path"] != last:
                open_string, depth, last = False, 0, row["path"]
            states[row["path"], row["start"]] = (open_string, depth)
            depth += row["inside"] if open_string else row["outside"]
            open_string ^= row["flips"]
        # (the last state is that at the end of the file, which the reader of the last range checks)
    placed = [(p, a, b, *states.get((p, a), (False, 0))) for p, a, b, _, _ in ranges]
    return spark.read.format("lexatlas_json_entries").option("ranges", json.dumps(placed)).load()


def unique_keys(entries: DataFrame) -> DataFrame:
    """(path, key, value) of object entries; a key that a file has twice, or an entry without a key, fails the job."""
    grouped = entries.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"))
    sound = F.assert_true((F.col("n") == 1) & F.col("key").isNotNull(), F.concat(F.lit("repeated or missing key: "), F.coalesce("key", F.lit("null")))).isNull()
    return grouped.where(sound).select("path", "key", "value")
