"""Tables that are checked while they are written and only then take their place."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class RejectedWrite(ValueError):
    """What was written broke a rule; nothing took its place."""

    def __init__(self, broken: dict[str, object], facts: dict[str, object]):
        super().__init__("refused: " + ", ".join(f"{k} (found {v})" for k, v in broken.items()))
        self.broken, self.facts = broken, facts


@dataclass(frozen=True)
class Rule:
    """An aggregate over all written rows and what it must be."""

    measured: Column
    expected: object


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def write_checked(frame: DataFrame, path: str, rules: Mapping[str, Rule], partition_by: tuple[str, ...] = ()) -> dict[str, object]:
    """Write a table in one pass, gather the rules' aggregates on the way, and put it in place if all hold.

    The rows go to a folder next to the target; metrics ride on that write
    (``Observation``), so nothing is read twice. If a rule is broken the folder
    is deleted and :class:`RejectedWrite` says which. An existing target is
    replaced only after the new table is complete. Returns the facts.
    """
    spark = frame.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    watch = Observation(f"checked-{uuid.uuid4().hex}")
    observed = frame.observe(watch, *[rule.measured.alias(name) for name, rule in rules.items()])
    writer = observed.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    files, source = _file_system(spark, staged)
    try:
        writer.parquet(staged)
        facts = dict(watch.get)
        broken = {name: facts[name] for name, rule in rules.items() if facts[name] != rule.expected}
        if broken:
            raise RejectedWrite(broken, facts)
    except BaseException:
        files.delete(source, True)
        raise
    _, target = _file_system(spark, path)
    files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"{path} could not be put in place")
    return facts


def finish_index(chunks: DataFrame, path: str, expected_chunks: int, dimension: int) -> dict[str, object]:
    """Write a vector index only if it is whole (M-22): every chunk once, with a finite vector of the right size."""
    v = F.col("v")
    sound = v.isNotNull() & (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rules = {
        "chunks": Rule(F.count(F.lit(1)), expected_chunks),
        "bad_vectors": Rule(F.count(F.when(~sound, 1)), 0),
        "missing_ids": Rule(F.count(F.when(F.coalesce(F.trim("chunk_id"), F.lit("")) == "", 1)), 0),
    }
    # Repeats of an id meet in one task anyway when the index is laid out by id; each row counts its predecessors there.
    placed = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_n"), F.first("v").alias("v"), *[F.first(c).alias(c) for c in chunks.columns if c not in ("chunk_id", "v")])
    return write_checked(placed, path, rules | {"repeated_ids": Rule(F.count(F.when(F.col("_n") > 1, 1)), 0)})


def write_cleaned(documents: DataFrame, path: str, expected: int, text: str = "text") -> dict[str, object]:
    """Cleaned documents and the list of those that failed, in one pass (SNK-03).

    Rows with a text go to ``outcome=cleaned``; rows without an id or text, or
    with nothing left of it, to ``outcome=error`` with their reason. Committed
    only if every document of the run is in one of the two.
    """
    reason = (
        F.when(F.col("doc_id").isNull() | (F.trim(F.col("doc_id").cast("string")) == ""), "missing id")
        .when(F.col(text).isNull(), "missing text")
        .when(F.trim(F.translate(F.col(text), "\n\r\t\f", "    ")) == "", "nothing left after cleaning")
    )
    judged = documents.withColumn("reason", reason).withColumn("outcome", F.when(F.col("reason").isNull(), "cleaned").otherwise("error"))
    rules = {"documents": Rule(F.count(F.lit(1)), expected)}
    facts = write_checked(judged, path, rules, ("outcome",))
    return facts
