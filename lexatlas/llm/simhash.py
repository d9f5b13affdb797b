"""SimHash near-duplicates: pivot distance tables over candidate groups.

Two fingerprints at three or fewer differing bits agree in at least three of
six blocks of bits, so every link lies inside one of 20 groupings by about 32
bits. Within a group each fingerprint gets a row of Hamming distances to the
reference fingerprints; a pair whose rows differ by more than three anywhere
cannot be a link (triangle inequality), and only the others are compared bit
by bit. A group hands on one link per member, not its pairs. Exact copies are
one fingerprint throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.llm.common import save, small_batches
from lexatlas.llm.components import components

BITS, BLOCKS, MAX_DISTANCE = 64, 6, 3
#: Reference fingerprints of the distance tables, spread over the space by a fixed seed.
PIVOTS = np.random.default_rng(20240517).integers(0, 1 << 64, size=12, dtype=np.uint64, endpoint=False)
#: Members above which a group is divided by further bits; at 48 fixed bits it cannot exceed 65,536.
GROUP_ROWS = 4096
#: Shingle hashes whose bits are counted at a time.
HASH_ROWS = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit majority of the XXH64 hashes (seed 42) of all word shingles, as a signed number."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        return int(np.array([digest(b" ".join(parts), 42)], np.uint64).view(np.int64)[0])
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[: len(parts) - words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    ones, total = np.zeros(BITS, np.int64), len(starts)
    for at in range(0, total, HASH_ROWS):
        part = zip(starts[at : at + HASH_ROWS], stops[at : at + HASH_ROWS], strict=True)
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in part), np.uint64, min(HASH_ROWS, total - at))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > total, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` of each row; whole texts, null as empty."""

    @F.pandas_udf("long")
    def majority(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(text, words) for text in texts], dtype="int64")

    small_batches(documents.sparkSession)
    return documents.select("doc_id", majority(F.coalesce("text", F.lit(""))).alias("fp"))


def block_masks(bits: list[int], blocks: int, kept: int) -> list[int]:
    """Masks of every choice of ``kept`` of ``blocks`` even parts of the given bit positions."""
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), blocks)]
    return [sum(chosen) for chosen in combinations(parts, kept)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def link_members(members: np.ndarray, limit: int = MAX_DISTANCE) -> np.ndarray:
    """Smallest member of each member's group of links, members being distinct fingerprints.

    Members are sorted by their distance to the first pivot, so that a
    comparison ends where this coordinate alone exceeds the limit.
    """
    distances = np.bitwise_count(members[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    order = np.argsort(distances[:, 0], kind="stable")
    members, distances = members[order], distances[order]
    label = np.arange(len(members))
    for step in range(1, len(members)):
        near = np.flatnonzero(distances[step:, 0] - distances[:-step, 0] <= limit)
        if not len(near):
            break
        for pivot in range(1, len(PIVOTS)):
            near = near[np.abs(distances[near + step, pivot] - distances[near, pivot]) <= limit]
        near = near[np.bitwise_count(members[near] ^ members[near + step]) <= limit]
        while len(near):
            low = np.minimum(label[near], label[near + step])
            np.minimum.at(label, label[near], low)
            np.minimum.at(label, label[near + step], low)
            label = label[label]
            near = near[label[near] != label[near + step]]
    while not np.array_equal(label, label[label]):
        label = label[label]
    root = np.empty(len(members), members.dtype)
    root[order] = members[label]
    return root


def _group_links(groups: DataFrame) -> DataFrame:
    """Links of each array of members: one per member that is not its group's root."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            lists = [np.asarray(m, np.int64) for m in frame["members"]]
            found_a, found_b = [], []
            pairs = [m for m in lists if len(m) == 2]
            if pairs:  # most groups: all their tables at once
                pair = np.stack(pairs).view(np.uint64)
                for pivot in PIVOTS:
                    table = np.bitwise_count(pair ^ pivot).astype(np.int16)
                    pair = pair[np.abs(table[:, 0] - table[:, 1]) <= MAX_DISTANCE]
                pair = pair[np.bitwise_count(pair[:, 0] ^ pair[:, 1]) <= MAX_DISTANCE].view(np.int64)
                found_a.append(pair[:, 0])
                found_b.append(pair[:, 1])
            for members in lists:
                if len(members) > 2:
                    roots = link_members(members.view(np.uint64)).view(np.int64)
                    moved = roots != members
                    found_a.append(members[moved])
                    found_b.append(roots[moved])
            if found_a:
                yield pd.DataFrame({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})

    return groups.select("members").mapInPandas(link, "a long, b long")


def _grouped(keyed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Member arrays of the groups that fit one task, and the rows of those that do not."""
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    sizes = save(sizes, "groups")
    fits = keyed.join(sizes.filter(F.col("_n") <= GROUP_ROWS).select(*keys), keys)
    large = keyed.join(sizes.filter(F.col("_n") > GROUP_ROWS).select(*keys), keys)
    return fits.groupBy(*keys).agg(F.collect_list("fp").alias("members")), large


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints reachable from each other; ``distinct`` has one row per ``fp``."""
    masks = block_masks(list(range(BITS)), BLOCKS, BLOCKS - MAX_DISTANCE)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.i", "k.key")
    groups, large = _grouped(keyed, ["i", "key"])
    # A large group is divided again by half of the bits it does not share; that bounds it for good.
    finer = []
    for i, mask in enumerate(masks):
        rest = [b for b in range(BITS) if not mask >> b & 1]
        finer.append(F.array(*[F.lit(signed(mask | m)) for m in block_masks(rest, BLOCKS, BLOCKS - MAX_DISTANCE)]))
    second = large.select("fp", "i", F.posexplode(F.array(*finer)[F.col("i")]).alias("j", "mask")).select("fp", "i", "j", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = second.groupBy("i", "j", "key").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
    return _group_links(groups).unionByName(_group_links(sizes)).distinct()


def _groups(documents: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``fp``, the group's ``root`` and its ``component_id`` of every row."""
    prints = save(fingerprints(documents, words), "fingerprints")
    distinct = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(fingerprint_links(distinct))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(grouped.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(documents: DataFrame, words: int = 3) -> DataFrame:
    """Every row's ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Reads doc_id and text only. A null text is empty, an empty text has the
    fingerprint zero and links like any other; a null id never becomes a
    component's id unless all its ids are null; repeated rows are returned
    each; an empty table gives no rows.
    """
    return _groups(documents, words).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, words: int = 3) -> DataFrame:
    """One whole row of each group: that of its smallest id; all columns are kept.

    Of rows that share this id one is kept; a group whose ids are all null keeps one row.
    """
    found = save(_groups(documents.select("doc_id", "text"), words), "groups")
    # Rows that are alone under their id need no exchange of texts.
    kept = save(found.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")), "kept")
    once = documents.join(kept.filter("_n = 1").select("doc_id"), "doc_id", "left_semi")
    again = documents.join(kept.filter("_n > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    nameless = found.filter("component_id is null").select("fp", "root").distinct()
    unnamed = documents.filter("doc_id is null").select(F.struct("*").alias("row"))
    prints = fingerprints(unnamed.select(F.col("row").alias("doc_id"), "row.text"), words)
    unnamed = prints.join(nameless, "fp").dropDuplicates(["root"]).select("doc_id.*")
    return once.unionByName(again).unionByName(unnamed).select(documents.columns)
