"""Line dedup: exact repeats, and lines one word apart through a deletion-neighbourhood join.

Lines are compared by their words in ASCII lower case. A line goes if an
earlier line (by document id, then position) has the same words, or, from
``min_words`` words on, differs by one word inserted, deleted or replaced.

The neighbourhood of a line is its word sequence with each single word left
out. Before these variants are made, lines that cannot have a neighbour are
set aside without loss: one edit lies in the front or in the rear half, so
neighbours agree in the other half exactly, and only words of the half with
the edit need leaving out. Variants are hashed keys, so equal ones meet in a
grouping that keeps only the earliest line and, where one line is the rest of
longer ones, that line; every match found this way is verified on the words.
Texts that lose a line are exchanged once, to meet the numbers of those that
stay; the others are not, where the list of those that lose one is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.llm.common import let_go, numbered, save, scratch, small_batches
from lexatlas.operators.joins import fits_broadcast

MIN_WORDS = 8
#: Odd bases of the two sequence hashes, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
#: Bits of the filter that finds the candidates' texts again: 4 MB, whatever the corpus. Full, it only filters less.
FILTER_BITS = 25
#: Lines or variants that a task hands on at a time.
OUT_ROWS = 20_000
#: From the first character of a line that is not white space to its end: one match per line that is not blank.
LINE = r"[^ \t\n\x0B\f\r][^\n]*"
#: Where a line is: rows that share an id are told apart by their texts' hash. Ids sort before null ids.
ROW = ["nameless", "doc_id", "twin"]
PLACE = [*ROW, "line_no"]
LINES = "doc_id long, twin long, line_no int, h1 long, h2 long, front long, rear long, front_longer long, rear_longer long"


def words_of(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").lower().split()


def _line_hash(words: list[bytes]) -> tuple[int, int]:
    import xxhash

    both = xxhash.xxh3_128_intdigest(b" ".join(words))
    return (both >> 64) - (1 << 63), (both & (1 << 64) - 1) - (1 << 63)


def _half_keys(words: list[bytes]) -> tuple[int, ...]:
    """Keys of the front and rear halves, as the shorter and as the longer line of a pair."""
    import xxhash

    n, out = len(words), []
    for shorter in (n, n - 1):
        half = shorter // 2
        for side, part in ((b"f", words[:half]), (b"r", words[n - shorter + half :])):
            out.append(xxhash.xxh3_64_intdigest(b"%s%d " % (side, shorter) + b" ".join(part)) - (1 << 63))
    return tuple(out)


def row_key() -> list[Column]:
    """Columns ``ROW`` of a document."""
    return [F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("twin")]


def scan_lines(documents: DataFrame, min_words: int) -> DataFrame:
    """Non-blank lines: place, two hash halves of the words and, for long lines, their half keys."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in LINES.split(", ")]
        let_go()

        def made(rows: list) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "line_no" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

        rows: list = []
        for batch in batches:
            for doc_id, twin, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "twin", "text")), strict=True):
                for number, line in enumerate(text.split("\n")):
                    words = words_of(line)
                    if words:
                        keys = _half_keys(words) if len(words) >= min_words else (None,) * 4
                        rows.append((doc_id, twin, number, *_line_hash(words), *keys))
                if len(rows) >= OUT_ROWS:
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)

    return documents.select(*row_key(), F.coalesce("text", F.lit("")).alias("text")).drop("nameless").mapInArrow(scan, LINES)


def first_places(documents: DataFrame, min_words: int) -> DataFrame:
    """One row per different line, at its earliest place; ids sort before null ids.

    Equal lines are combined before they are exchanged.
    """
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "twin", "line_no")
    keys = ["front", "rear", "front_longer", "rear_longer"]
    grouped = scan_lines(documents, min_words).groupBy("h1", "h2").agg(F.min(place).alias("place"), *[F.max(k).alias(k) for k in keys])
    return grouped.select("h1", "h2", "place.*", *keys)


def _variants(words: list[bytes], digest) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the sequence without each word, then of the whole sequence."""
    n = len(words)
    code = np.fromiter(map(digest, words), np.uint64, n)
    out = []
    for base, inverse in zip(BASES, INVERSES, strict=True):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * powers, dtype=np.uint64)])
        out.append(np.append(sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(inverse), sums[-1]))
    return out[0], out[1]


def emit_variants(lines: DataFrame) -> DataFrame:
    """Rows (key, other, no, whole) of lines (no, line, in_front, in_rear).

    A rest with the place of the missing word is one key, shared by lines that
    differ by a replaced word; a rest alone is another, shared by a line and
    those with a word more; ``whole`` marks the line that is itself the rest.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest, columns = xxhash.xxh3_64_intdigest, ["key", "other", "no", "whole"]
        for frame in batches:
            parts: list[list[np.ndarray]] = [[], [], [], []]
            rows = 0
            for row in frame.itertuples(index=False):
                words = words_of(row.line)
                n = len(words)
                va, vb = _variants(words, digest)
                first = 0 if row.in_front else (n - 1) // 2
                last = n if row.in_rear else n // 2 + 1
                at = np.arange(first, last)
                # Sizes and places are mixed into one half, so that no key meets one of another kind.
                rest = vb[at] * np.uint64(0x100000001B3) + np.uint64(n - 1)
                placed = rest + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
                own = vb[n:] * np.uint64(0x100000001B3) + np.uint64(n)
                parts[0] += [va[at], va[at], va[n:]]
                parts[1] += [placed, rest, own]
                parts[2].append(np.full(2 * len(at) + 1, row.no))
                parts[3].append(np.arange(2 * len(at) + 1) == 2 * len(at))
                rows += 2 * len(at) + 1
                if rows >= OUT_ROWS:
                    yield pd.DataFrame(dict(zip(columns, map(np.concatenate, parts), strict=True))).astype({"key": "int64", "other": "int64"})
                    parts, rows = [[], [], [], []], 0
            if rows:
                yield pd.DataFrame(dict(zip(columns, map(np.concatenate, parts), strict=True))).astype({"key": "int64", "other": "int64"})

    return lines.select("no", "line", "in_front", "in_rear").mapInPandas(emit, "key long, other long, no long, whole boolean")


def within_one_edit(a: list, b: list) -> bool:
    """Whether one inserted, deleted or replaced word (or none) turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    front = next((i for i in range(short) if a[i] != b[i]), short)
    rear = next((i for i in range(short - front) if a[-1 - i] != b[-1 - i]), short - front)
    return max(len(a), len(b)) - front - rear <= 1


def _slot(h1):
    return (h1 >> 3) & ((1 << FILTER_BITS) - 1)


def candidate_texts(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add ``line`` to the candidates, read from the documents again.

    A bit filter of fixed size passes the candidates' lines and few others, so
    only these are exchanged to be matched exactly.
    """
    spark = documents.sparkSession
    slot = f"(shiftright(h1, 3) & {(1 << FILTER_BITS) - 1})"
    bits = candidates.select(F.expr(f"shiftright({slot}, 6)").alias("at"), F.expr(f"shiftleft(1L, cast({slot} & 63 as int))").alias("bit"))
    table = np.zeros(1 << FILTER_BITS - 6, np.int64)
    for part in bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # at most 2**19 rows
        table[part["at"]] = part["bits"]
    shared = spark.sparkContext.broadcast(table)

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = shared.value
        for frame in batches:
            rows = []
            for text in frame["text"]:
                for line in text.split("\n"):
                    words = words_of(line)
                    if words:
                        h1, h2 = _line_hash(words)
                        at = _slot(h1)
                        if int(found[at >> 6]) >> (at & 63) & 1:
                            rows.append((h1, h2, line))
            # Only the words count, so any of equal lines will do.
            yield pd.DataFrame(rows, columns=["h1", "h2", "line"]).drop_duplicates(["h1", "h2"])

    lines = documents.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(fetch, "h1 long, h2 long, line string")
    return lines.join(candidates, ["h1", "h2"]).groupBy("no").agg(F.first("line").alias("line"), F.first("in_front").alias("in_front"), F.first("in_rear").alias("in_rear"), *[F.first(c).alias(c) for c in PLACE])


def near_places(documents: DataFrame, distinct: DataFrame) -> DataFrame:
    """Places of different lines that have an earlier line one edit away."""
    keys = F.array(*[F.struct(F.col(k).alias("key"), F.lit(k.startswith("rear")).alias("in_front")) for k in ("front", "rear", "front_longer", "rear_longer")])
    keyed = distinct.filter("front is not null").select("h1", "h2", F.explode(keys).alias("k")).select("h1", "h2", "k.key", "k.in_front")
    shared = keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key")
    # An edit lies in front where the rear is shared, and the other way round.
    flagged = keyed.join(shared, "key").groupBy("h1", "h2").agg(F.max("in_front").alias("in_front"), F.max(~F.col("in_front")).alias("in_rear"))
    placed = flagged.join(distinct.select("h1", "h2", *PLACE), ["h1", "h2"])
    order = [F.col(c) for c in PLACE]
    candidates = save(numbered(placed, order, "no"), "candidates")
    lines = save(candidate_texts(documents, candidates), "lines")

    variants = save(emit_variants(lines), "variants")
    groups = variants.groupBy("key", "other").agg(F.min("no").alias("least"), F.max("no").alias("most"), F.max(F.when(F.col("whole"), F.col("no"))).alias("rest"))
    met = variants.join(groups.filter("least <> most"), ["key", "other"])
    earlier = F.when(F.col("whole"), F.col("least")).otherwise(F.coalesce("rest", "least"))
    # A line that is the rest of longer ones may come after some of them and before others: both sides are asked.
    pairs = met.select("no", earlier.alias("earlier")).filter("earlier < no").distinct()

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one_edit(words_of(x), words_of(y)) for x, y in zip(a, b, strict=True)], dtype=bool)

    texts = lines.select("no", "line")
    told = pairs.join(texts, "no").join(texts.select(F.col("no").alias("earlier"), F.col("line").alias("other")), "earlier")
    return told.filter(verified("line", "other")).select("no").distinct().join(candidates, "no").select("h1", "h2")


def _first_of_equals(documents: DataFrame, crowded: DataFrame, keep) -> DataFrame:
    """Rows as (row, nameless, doc_id, twin, repeat); ``repeat`` marks all but one of those with equal id and text.

    Only rows that are not alone under their id and text (``crowded``) are
    written down and numbered.
    """
    packed = documents.select(F.struct("*").alias("row"), *row_key())
    if crowded.isEmpty():
        return packed.withColumn("repeat", F.lit(False))
    if fits_broadcast(crowded):
        crowded = F.broadcast(crowded)
    same = [F.col(f"packed.{c}").eqNullSafe(F.col(f"crowded.{c}")) for c in ROW]
    alone = packed.alias("packed").join(crowded.alias("crowded"), same, "left_anti").withColumn("repeat", F.lit(False))
    several = packed.alias("packed").join(crowded.alias("crowded"), same, "left_semi")
    several = keep(several.withColumn("_at", F.monotonically_increasing_id()), "several")
    first = several.groupBy(*ROW).agg(F.min("_at").alias("_at")).select("_at", F.lit(True).alias("_first"))
    marked = several.join(first, "_at", "left").select("row", *ROW, F.col("_first").isNull().alias("repeat"))
    return alone.unionByName(marked)


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``documents`` with repeated lines taken out of ``text``; ``n_chars`` follows if present.

    Kept are blank lines and, of equal or neighbouring lines, the earliest. A
    null text stays null; an empty text stays empty; a null id comes after all
    others; rows that share an id, or have none, are documents of their own in
    the order of a hash of their texts, and of rows equal in id and text one
    keeps what is kept; an empty table stays empty.
    """
    spark = documents.sparkSession
    small_batches(spark)
    own = documents.select("doc_id", "text")
    with scratch(spark) as keep:
        distinct = save(first_places(own, min_words), "first")
        near = near_places(own, distinct)
        kept = distinct.select("h1", "h2", *PLACE).join(near, ["h1", "h2"], "left_anti")
        lists = kept.groupBy(*ROW).agg(F.sort_array(F.collect_list("line_no")).alias("kept"))
        # Only texts that lose a line need their list: those that have more lines than it.
        count = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(LINE)).alias("lines")
        rows = keep(own.select(*row_key(), count).groupBy(*ROW).agg(F.max("lines").alias("lines"), F.count(F.lit(1)).alias("n")), "rows")
        lines = rows.filter("lines > 0")
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ROW]
        losing = lines.alias("l").join(lists.alias("k"), same, "left").filter("kept is null or size(kept) < lines")
        losing = keep(losing.select(*[F.col(f"l.{c}").alias(c) for c in ROW], F.coalesce("kept", F.expr("cast(array() as array<int>)")).alias("kept")), "losing")
        rows = _first_of_equals(documents, rows.filter("n > 1").select(*ROW), keep)
    small = fits_broadcast(losing)

    @F.pandas_udf("string")
    def without(text: pd.Series, kept_lines: pd.Series, repeat: pd.Series) -> pd.Series:
        out = []
        for whole, numbers, again in zip(text, kept_lines, repeat, strict=True):
            keep_numbers = set() if again or numbers is None else set(numbers.tolist())
            out.append(None if whole is None else "\n".join(x for i, x in enumerate(whole.split("\n")) if i in keep_numbers or not x.strip(" \t\n\x0b\x0c\r")))
        return pd.Series(out, dtype=object)

    losing = losing.select(*[F.col(c).alias(f"_{c}") for c in ROW], "kept")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ROW]
    met = rows.join(F.broadcast(losing) if small else losing, same, "left")
    whole = F.col("kept").isNull() & ~F.col("repeat")
    text = F.when(whole, F.col("row.text")).otherwise(without(F.when(~whole, F.col("row.text")), "kept", "repeat"))
    joined = met.select("row", text.alias("_text"))
    changed = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in documents.columns])
