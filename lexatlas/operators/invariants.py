"""Invariants of predictions, fold outputs, corpora and reports, each as a table of what breaks them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: largest difference of a reported mean from the recomputed one.
REPORT_TOLERANCE = 1e-15


def outside_corpus(predictions: DataFrame, corpus: DataFrame) -> DataFrame:
    """Predicted (qid, doc_id) pairs whose document is not allowed (F-16)."""
    return predictions.select("qid", "doc_id").distinct().join(corpus.select("doc_id").distinct(), "doc_id", "left_anti").select("qid", "doc_id")


def ranking_gaps(rankings: DataFrame, corpus: DataFrame) -> DataFrame:
    """How many allowed documents each ranking lacks, where it lacks any (F-16).

    Counted from what is ranked, so no question meets the whole corpus.
    """
    allowed = corpus.select("doc_id").distinct()
    ranked = rankings.select("qid", "doc_id").distinct().join(allowed.withColumn("_in", F.lit(1)), "doc_id", "left")
    held = ranked.groupBy("qid").agg(F.count("_in").alias("ranked"))
    size = allowed.agg(F.count(F.lit(1)).alias("size"))
    return held.join(F.broadcast(size)).select("qid", (F.col("size") - F.col("ranked")).alias("missing")).where("missing > 0")


def fold_merge_problems(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """Why fold outputs (id, part) do not merge into exactly the expected ids (SET-04)."""
    both = (
        parts.select("id", F.lit(1).alias("given"), F.lit(0).alias("due"))
        .unionByName(expected.select("id").distinct().select("id", F.lit(0).alias("given"), F.lit(1).alias("due")))
        .groupBy("id")
        .agg(F.sum("given").alias("given"), F.sum("due").alias("due"))
    )
    problem = F.when(F.col("given") == 0, "missing").when(F.col("due") == 0, "unexpected").when(F.col("given") > 1, "duplicate")
    return both.select("id", problem.alias("problem")).where("problem is not null")


def merge_folds(parts: Sequence[DataFrame], expected: DataFrame, key: str = "qid") -> DataFrame:
    """One table of all fold outputs; raises where an id is duplicate, missing or unexpected (SET-04)."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    problems = fold_merge_problems(merged.select(F.col(key).alias("id")), expected.select(F.col(key).alias("id")))
    some = problems.orderBy("problem", "id").take(5)
    if some:
        raise ValueError("fold outputs do not merge, among others " + ", ".join(f"{r['problem']} {r['id']}" for r in some))
    return merged


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\?#]*?)(?:\.[^./\\?#]*)?(?:[?#].*)?$", 1)


def stem_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """File stems on one side only, with the side (SET-09)."""
    a, b = (side.select(file_stem(F.col("path")).alias("stem")).distinct() for side in (left, right))
    return a.join(b, "stem", "left_anti").select("stem", F.lit("left").alias("side")).unionByName(b.join(a, "stem", "left_anti").select("stem", F.lit("right").alias("side")))


def metadata_mismatches(rows: DataFrame, fields: Sequence[str], metadata: str = "metadata") -> DataFrame:
    """Rows per field whose flat column differs from the copy in a string map (V-03)."""
    different = [F.count_if(~F.col(f).cast("string").eqNullSafe(F.try_element_at(metadata, F.lit(f)))).alias(f) for f in fields]
    counts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("mismatches")) for f in fields])
    return rows.agg(*different).select(F.explode(counts).alias("c")).select("c.*")


def context_counts(files: DataFrame, key: str, content: Column, orphan: Column) -> DataFrame:
    """Physical files as unique, exact duplicate and orphan ones, and whether they add up (V-04).

    Counts are per content, so one content held by very many files costs a row
    per task.
    """
    marked = files.select(F.col(key).alias("key"), F.sha2(content, 256).alias("hash"), F.coalesce(orphan, F.lit(True)).alias("orphan"))
    kinds = marked.groupBy("orphan", "hash").agg(F.count(F.lit(1)).alias("n"))
    sums = kinds.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("physical"),
        F.count_if(~F.col("orphan")).alias("unique"),
        F.coalesce(F.sum(F.when(~F.col("orphan"), F.col("n") - 1)), F.lit(0)).alias("exact_duplicates"),
        F.coalesce(F.sum(F.when(F.col("orphan"), F.col("n"))), F.lit(0)).alias("orphans"),
    )
    return sums.withColumn("adds_up", F.col("physical") == F.col("unique") + F.col("exact_duplicates") + F.col("orphans"))


def report_mismatches(reported: Mapping[str, float], rows: DataFrame, tolerance: float = REPORT_TOLERANCE) -> DataFrame:
    """Reported means that differ from the mean over the per-question rows (V-05)."""
    actual = rows.agg(*[F.avg(F.col(n).cast("double")).alias(n) for n in reported])
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("reported"), F.col(n).alias("actual")) for n, v in reported.items()])
    return actual.select(F.explode(pairs).alias("p")).select("p.*").where(F.abs(F.col("reported") - F.coalesce("actual", F.lit(0.0))) > tolerance)


def latency_violations(summaries: DataFrame, key: str) -> DataFrame:
    """Summaries whose mean or percentiles lie outside their extremes (V-10)."""
    inside = ("mean_ms", "median_ms", "p95_ms", "p99_ms")
    checks = [F.struct(F.lit(n).alias("name"), ((F.col(n) < F.col("min_ms")) | (F.col(n) > F.col("max_ms"))).alias("broken")) for n in inside]
    checks.append(F.struct(F.lit("min_ms").alias("name"), (F.col("min_ms") > F.col("max_ms")).alias("broken")))
    return summaries.select(key, F.explode(F.array(*checks)).alias("c")).where("c.broken").select(key, "c.name")


def canonical(column: Column, kind: T.DataType) -> Column:
    """The value with the fields of every struct in name order (JSN-01)."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(column.isNotNull(), F.struct(*[canonical(column[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(column))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], canonical(e["value"], kind.valueType))))
    return column


def canonical_json(frame: DataFrame, name: str) -> Column:
    """JSON of a column with sorted keys, nulls kept and no spaces; the same for any order of fields."""
    return F.to_json(canonical(F.col(name), frame.schema[name].dataType), {"ignoreNullFields": "false"})


def review_documents(reviews: DataFrame, documents: DataFrame, reason: str | None = None) -> DataFrame:
    """Documents marked for review with their reason; ids without a document keep a null text (J-15, M-18)."""
    wanted = reviews if reason is None else reviews.where(F.col("reason") == reason)
    return wanted.join(documents, "doc_id", "left")
