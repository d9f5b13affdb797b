"""Hash tree of a table: one digest for all rows, and the changed rows of two tables by descending."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a leaf is meant to hold at most.
LEAF_ROWS = 256


@dataclass(frozen=True)
class HashTree:
    """``entries`` (place, key, record_sha256, copies), ``nodes`` (prefix, rows, sha256); leaves have prefixes of ``depth`` digits."""

    entries: DataFrame
    nodes: DataFrame
    depth: int


def depth_for(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Hexadecimal digits of a leaf's prefix, so that leaves hold ``leaf_rows`` entries on average at most."""
    depth = 0
    while rows > leaf_rows * 16**depth:
        depth += 1
    return depth


def entries_of(rows: DataFrame, key: str, record: Column) -> DataFrame:
    """One row per different (key, record) with its number of copies, placed by a digest of both.

    Rows that share a key, or are equal, are combined or spread before they meet in a leaf.
    """
    told = rows.select(F.col(key).cast("string").alias("key"), F.sha2(record, 256).alias("record_sha256"))
    counted = told.groupBy("key", "record_sha256").agg(F.count(F.lit(1)).alias("copies"))
    return counted.withColumn("place", F.sha2(F.concat_ws(":", F.coalesce("key", F.lit("")), "record_sha256"), 256))


def _leaves(entries: DataFrame, depth: int) -> DataFrame:
    line = F.concat_ws(":", F.coalesce("key", F.lit("")), "record_sha256", F.col("copies").cast("string"))
    grouped = entries.groupBy(F.substring("place", 1, depth).alias("prefix")).agg(
        F.sum("copies").alias("rows"), F.array_sort(F.collect_list(line)).alias("lines")
    )
    return grouped.select("prefix", "rows", F.sha2(F.array_join("lines", "\n"), 256).alias("sha256"))


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes one digit shorter; at most 16 children each."""
    line = F.concat_ws(":", "prefix", "sha256")
    grouped = nodes.groupBy(F.substring("prefix", 1, level).alias("parent")).agg(F.sum("rows").alias("rows"), F.array_sort(F.collect_list(line)).alias("lines"))
    return grouped.select(F.col("parent").alias("prefix"), "rows", F.sha2(F.array_join("lines", "\n"), 256).alias("sha256"))


def hash_tree(rows: DataFrame, key: str, record: Column, leaf_rows: int = LEAF_ROWS, depth: int | None = None) -> HashTree:
    """Tree over all rows (A-21); the same for any order and partitions of the rows.

    ``record`` is what counts of a row, as text. An empty table has no nodes.
    The leaves, one row for about ``leaf_rows`` entries, are kept: every level
    above is made from them and not from the table again.
    """
    entries = entries_of(rows, key, record)
    depth = depth_for(entries.count(), leaf_rows) if depth is None else depth
    level = _leaves(entries, depth).persist()
    nodes = level
    for digits in range(depth - 1, -1, -1):
        level = _parents(level, digits)
        nodes = nodes.unionByName(level)
    return HashTree(entries, nodes, depth)


def root(tree: HashTree) -> DataFrame:
    """One row: the digest of the whole table."""
    return tree.nodes.where("prefix = ''").select(F.col("sha256").alias("corpus_sha256"), F.col("rows").alias("record_count"))


def changed_entries(before: HashTree, after: HashTree) -> DataFrame:
    """(change, key, record_sha256, copies) of entries that only one table has, or in other number.

    From the root down, only children of differing nodes are looked at; so
    equal parts of the tables are settled by their digests. The nodes of both
    trees are kept, and a level reads the one above once, so that the plan
    grows with the depth only.
    """
    if before.depth != after.depth:
        raise ValueError("trees of one depth are needed; pass depth to hash_tree")
    absent = F.lit(None).cast("string")
    nodes = before.nodes.select("prefix", F.col("sha256").alias("old"), absent.alias("new"))
    nodes = nodes.unionByName(after.nodes.select("prefix", absent.alias("old"), F.col("sha256").alias("new"))).persist()
    differing: DataFrame | None = None
    for digits in range(before.depth + 1):
        level = nodes.where(F.length("prefix") == digits)
        if differing is not None:
            parent = differing.withColumnRenamed("prefix", "parent")
            level = level.withColumn("parent", F.substring("prefix", 1, digits - 1)).join(parent, "parent", "left_semi")
        told = level.groupBy("prefix").agg(F.max("old").alias("old"), F.max("new").alias("new"))
        differing = told.where(~F.col("old").eqNullSafe(F.col("new"))).select("prefix")
    sides = [t.entries.withColumn("side", F.lit(s)) for t, s in ((before, -1), (after, 1))]
    below = sides[0].unionByName(sides[1]).withColumn("prefix", F.substring("place", 1, before.depth)).join(differing, "prefix", "left_semi")
    both = below.groupBy("key", "record_sha256").agg(F.sum(F.col("side") * F.col("copies")).alias("net"))
    return both.where("net <> 0").select(F.when(F.col("net") > 0, "added").otherwise("removed").alias("change"), "key", "record_sha256", F.abs("net").alias("copies"))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Relative path, length and SHA-256 of every file below a folder (M-20); contents are hashed where they are read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    told = read.select(F.col("path"), "length", F.sha2("content", 256).alias("sha256"))
    folder = F.lit(path.rstrip("/").removeprefix("file:"))
    below = F.substring("path", F.instr("path", folder) + F.length(folder) + 1, F.length("path"))
    return told.select(below.alias("path"), "length", "sha256")


def artifact_fingerprint(spark: SparkSession, path: str, settings: dict[str, str] | None = None) -> str:
    """Digest of a model or source folder and the settings it was made with, as a cache key (M-20)."""
    files = file_inventory(spark, path)
    named = [(f"setting:{k}", len(v), v) for k, v in sorted((settings or {}).items())]
    whole = files.unionByName(spark.createDataFrame(named, "path string, length long, sha256 string")) if named else files
    row = root(hash_tree(whole, "path", F.concat_ws(":", F.col("length").cast("string"), "sha256"))).first()
    return row["corpus_sha256"] if row else ""
