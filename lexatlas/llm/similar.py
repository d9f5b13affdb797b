"""Near-duplicates by five-word similarity: SimHash pivot tables over SimHash and MinHash groups, verified by the exact Jaccard index.

Two texts are linked if their sets of word shingles have a Jaccard index of
at least ``SIMILARITY``. At 0.8 two SimHash fingerprints differ by about ten
of 64 bits and by up to ``RADIUS``. The groups that pivot tables compare are those of ``simhash``, by
three of six bit blocks, where all pairs of at most three differing bits meet;
for pairs further apart, which no groups by equal bits can hold, 24 MinHash
bands of five minima are added, which bring a pair at 0.8 together with a
probability of 0.9999 (more above it). Within a group a pair is discarded where its distances to a reference
fingerprint differ by more than the radius, then where the fingerprints do, or
the sizes; every survivor is verified on its sets of shingles, which are made
again from the texts of candidates only.

First each member of a group is compared with the group's least; then members
that are not yet linked, in fragments of bounded size. So a large group of
near copies costs a few comparisons per member, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.llm.common import let_go, save, scratch, small_batches
from lexatlas.llm.components import components
from lexatlas.llm.simhash import BITS, BLOCKS, MAX_DISTANCE, PIVOTS, block_masks, signed
from lexatlas.operators.joins import fits_broadcast

#: Words of a shingle, and the similarity of linked texts as a fraction.
WORDS, SIMILARITY = 5, (4, 5)
BANDS, BAND_ROWS = 24, 5
#: Bits that fingerprints of linked texts differ by at most: 9.7 expected at 0.8, deviation 2.9. Of fewer shingles the bits say too little.
RADIUS, LEAST_SHINGLES = 22, 64
FACTORS = np.random.default_rng(20240518).integers(0, 1 << 63, size=BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingle hashes at a time, and members of a fragment of a group.
HASH_ROWS, FRAGMENT = 1 << 12, 2048
PRINTS = "fp long, bands array<long>, simhash long, size int"
#: A row by its id and two hashes of its text.
KEY = ["doc_id", "t1", "t2"]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    count = max(1, len(parts) - words + 1) if parts else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), 42) for i in range(count)], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One hash per band of minima; none for an empty set."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), HASH_ROWS):
        np.minimum(least, (hashes[None, at : at + HASH_ROWS] * FACTORS[:, None]).min(axis=1), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64).view(np.int64).tolist()


def simhash(hashes: np.ndarray) -> int:
    """Majority of the bits of all hashes, as a signed number; zero for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), HASH_ROWS):
        ones += np.unpackbits(hashes[at : at + HASH_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _prints(text: Column) -> Column:
    """Digest of the shingle set, its bands, fingerprint and size."""

    @F.pandas_udf(PRINTS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        let_go()
        for texts in batches:
            rows = []
            for one in texts:
                hashes = shingles(one)
                digest = np.array([xxhash.xxh64_intdigest(hashes.tobytes(), 0)], np.uint64).view(np.int64)[0]
                rows.append((int(digest), bands(hashes), simhash(hashes), len(hashes)))
            yield pd.DataFrame(rows, columns=["fp", "bands", "simhash", "size"])

    return found(F.coalesce(text, F.lit("")))


def text_hashes() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _members(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shingle sets (fp, shingles) of the wanted texts (fp, t1, t2), made from the documents again; equal texts are one."""

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(one).view(np.int64) for one in texts], dtype=object)

    side = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    texts = documents.select(*text_hashes(), "text").join(side, ["t1", "t2"]).groupBy("fp").agg(F.first("text").alias("text"))
    return texts.select("fp", sets(F.coalesce("text", F.lit(""))).alias("shingles"))


def _verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one, other = (members.select(F.col("fp").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - both
    return pairs.join(one, "a").join(other, "b").filter(both * SIMILARITY[1] >= either * SIMILARITY[0]).select("a", "b")


def near_pairs(members: np.ndarray, prints: np.ndarray, sizes: np.ndarray, roots: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of different roots (and sides, if there are two) that pivots, fingerprints and sizes do not tell apart."""
    distances = np.bitwise_count(prints[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    order = np.argsort(distances[:, 0], kind="stable")
    members, prints, sizes, roots, side, distances = (x[order] for x in (members, prints, sizes, roots, side, distances))
    few, two = sizes < LEAST_SHINGLES, side.min() != side.max()
    for step in range(1, len(members)):
        near = np.arange(len(members) - step)
        near = near[roots[near] != roots[near + step]]
        if two:
            near = near[side[near] != side[near + step]]
        close = sizes[near] * SIMILARITY[1] >= sizes[near + step] * SIMILARITY[0]
        near = near[close & (sizes[near + step] * SIMILARITY[1] >= sizes[near] * SIMILARITY[0])]
        small = near[few[near] | few[near + step]]
        near = near[~(few[near] | few[near + step])]
        for pivot in range(len(PIVOTS)):
            near = near[np.abs(distances[near + step, pivot] - distances[near, pivot]) <= RADIUS]
        near = near[np.bitwise_count(prints[near] ^ prints[near + step]) <= RADIUS]
        near = np.concatenate([small, near])
        if len(near):
            yield np.minimum(members[near], members[near + step]), np.maximum(members[near], members[near + step])


def _apart(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's members (fp, simhash, size, root) with different roots.

    A crowded bucket is dealt into parts, and every two parts meet in a fragment of their own.
    """

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for members in frame["members"]:
                columns = {c: np.array([m[c] for m in members], np.int64) for c in ("fp", "simhash", "size", "root", "part")}
                for a, b in near_pairs(columns["fp"], columns["simhash"].view(np.uint64), columns["size"], columns["root"], columns["part"]):
                    yield pd.DataFrame({"a": a, "b": b})

    sizes = buckets.groupBy("i", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    parts = sizes.select("i", "key", F.ceil(F.col("n") / FRAGMENT).alias("parts"))
    placed = buckets.join(parts, ["i", "key"]).withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    placed = placed.select("*", other.alias("other"))
    fragments = placed.groupBy("i", "key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    return fragments.agg(F.collect_list(F.struct("fp", "simhash", "size", "root", "part")).alias("members")).select("members").mapInPandas(pairs, "a long, b long").distinct()


def set_links(prints: DataFrame, documents: DataFrame) -> DataFrame:
    """Links (a, b) that join exactly the similar sets of common buckets; ``prints`` has one row per ``fp`` with its text's hashes."""
    blocks = [F.col("simhash").bitwiseAND(F.lit(signed(m))) for m in block_masks(list(range(BITS)), BLOCKS, BLOCKS - MAX_DISTANCE)]
    keyed = prints.select("fp", "simhash", "size", F.posexplode(F.concat(F.array(*blocks), "bands")).alias("i", "key"))
    least = F.min(F.struct("fp", "simhash", "size")).alias("least")
    shared = keyed.groupBy("i", "key").agg(F.count(F.lit(1)).alias("_n"), least).filter("_n > 1").drop("_n")
    buckets = save(keyed.join(shared, ["i", "key"]), "buckets")
    wanted = buckets.select("fp").distinct().join(prints.select("fp", "t1", "t2"), "fp")
    members = save(_members(documents, save(wanted, "wanted")), "members")
    small, large = F.least("size", "least.size"), F.greatest("size", "least.size")
    near = (F.bit_count(F.col("simhash").bitwiseXOR(F.col("least.simhash"))) <= RADIUS) | (small < LEAST_SHINGLES)
    first = buckets.filter(F.col("least.fp") < F.col("fp")).filter((small * SIMILARITY[1] >= large * SIMILARITY[0]) & near)
    first = save(first.select(F.col("least.fp").alias("a"), F.col("fp").alias("b")).distinct(), "pairs")
    links = save(_verified(first, members), "similar")
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = buckets.join(roots, "fp", "left").select("i", "key", "fp", "simhash", "size", F.coalesce("root", "fp").alias("root"))
    rest = _apart(save(rooted, "rooted")).join(first, ["a", "b"], "left_anti")
    return links.unionByName(save(_verified(rest, members), "similar"))


def groups(documents: DataFrame) -> DataFrame:
    """Every row's ``doc_id``, its text's hashes t1 and t2, and ``root``, which rows of one group share."""
    small_batches(documents.sparkSession)
    with scratch(documents.sparkSession) as keep:
        prints = documents.select("doc_id", *text_hashes(), _prints(F.col("text")).alias("s"))
        prints = save(prints.select(*KEY, "s.*"), "prints")
        one = F.min(F.struct("t1", "t2", "simhash", "size", "bands")).alias("one")
        distinct = save(prints.groupBy("fp").agg(one).select("fp", "one.*"), "distinct")
        roots = components(set_links(distinct, documents)).withColumnRenamed("node", "fp")
        return keep(prints.select(*KEY, "fp").join(roots, "fp", "left").select(*KEY, F.coalesce("root", "fp").alias("root")), "groups")


def keep_one(documents: DataFrame) -> DataFrame:
    """One whole row of each group of texts linked at five-word similarity, that of the smallest id; all columns are kept.

    A null text is empty, and empty texts are one group. Null ids come last;
    among rows of one id a hash of the text decides, and of rows equal in id
    and text one is kept. An empty table stays empty.
    """
    with scratch(documents.sparkSession) as keep:
        found = groups(documents.select("doc_id", "text"))
        named = found.groupBy("root", *KEY).agg(F.count(F.lit(1)).alias("n"))
        named = save(named.withColumn("order", F.struct(F.col("doc_id").isNull(), *KEY)), "named")
        first = named.groupBy("root").agg(F.min("order").alias("first"))
        marked = named.join(first, "root").select(*[F.col(c).alias(f"_{c}") for c in KEY], "n", (F.col("order") == F.col("first")).alias("stays"))
        marked = keep(marked, "marked")
    others, crowded = marked.filter("not stays or n > 1").drop("n", "stays"), marked.filter("stays and n > 1").drop("n", "stays")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    rows = documents.select(F.struct("*").alias("row"), "doc_id", *text_hashes())
    if fits_broadcast(others):
        once = rows.join(F.broadcast(others), same, "left_anti")
    else:
        once = rows.join(marked.filter("stays and n = 1").drop("n", "stays"), same, "left_semi")
    several = F.broadcast(crowded) if fits_broadcast(crowded) else crowded
    again = rows.join(several, same, "left_semi").dropDuplicates(KEY)
    return once.unionByName(again).select("row.*")
