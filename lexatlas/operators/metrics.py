"""Set recall, precision, reciprocal rank, depth metrics and latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.operators.quantiles import percentiles

# Official answer length and diagnostic depths.
MAX_DOCUMENTS = 5
DEPTHS = (5, 10, 20, 50, 100, 200)


def judge(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per (qid, doc_id) with its gold flag and predicted rank.

    Union and one aggregation instead of a full outer join; all metrics below
    are aggregates of this table (SET-01, SET-02).
    """
    return (
        gold.select("qid", "doc_id", F.lit(True).alias("g"), F.lit(None).cast("long").alias("r"))
        .unionByName(predictions.select("qid", "doc_id", F.lit(False).alias("g"), F.col("rank").cast("long").alias("r")))
        .groupBy("qid", "doc_id")
        .agg(F.max("g").alias("is_gold"), F.min("r").alias("rank"))
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def per_query(gold: DataFrame, predictions: DataFrame, max_documents: int | None = MAX_DOCUMENTS) -> DataFrame:
    """Recall, precision and reciprocal rank per question (M-01, M-02, F-10).

    A prediction with no or too many documents counts as empty.
    """
    hit = F.col("is_gold") & F.col("rank").isNotNull()
    rows = judge(gold, predictions).groupBy("qid").agg(
        F.count_if("is_gold").alias("n_gold"),
        F.count("rank").alias("n_predicted"),
        F.count_if(hit).alias("n_matched"),
        F.min(F.when(hit, F.col("rank"))).alias("first_gold_rank"),
    )
    allowed = F.lit(True) if max_documents is None else F.col("n_predicted") <= max_documents
    matched = F.when(allowed, F.col("n_matched")).otherwise(F.lit(0))
    return rows.where(F.col("n_gold") > 0).select(
        "qid",
        "n_gold",
        "n_predicted",
        matched.alias("n_matched"),
        _ratio(matched, F.col("n_gold")).alias("recall"),
        F.when(allowed, _ratio(matched, F.col("n_predicted"))).otherwise(F.lit(0.0)).alias("precision"),
        F.coalesce(1.0 / F.col("first_gold_rank"), F.lit(0.0)).alias("reciprocal_rank"),
        (F.coalesce(F.col("first_gold_rank") <= 3, F.lit(False))).cast("int").alias("hit_at_3"),
    )


def summary(per_query_rows: DataFrame) -> DataFrame:
    """Macro averages over questions (A-01, A-03, M-03)."""
    return per_query_rows.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.round(F.avg("recall"), 9).alias("recall"),
        F.round(F.avg("precision"), 9).alias("precision"),
        F.round(F.avg("reciprocal_rank"), 9).alias("mrr"),
        F.round(F.avg("hit_at_3"), 9).alias("hit_at_3"),
        F.count_if(F.col("n_gold") > 1).alias("multi_gold_sample_count"),
        F.round(F.avg(F.when(F.col("n_gold") > 1, F.col("recall"))), 9).alias("multi_gold_recall"),
    )


def single_gold(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Retired single-answer metrics: reciprocal rank and hit within three (M-02)."""
    one = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    found = one.join(predictions.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    return found.select(
        "qid",
        F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.col("rank") <= 3, F.lit(False)).cast("int").alias("hit_at_3"),
    )


def _per_depth(gold: DataFrame, predictions: DataFrame, depths: Sequence[int]) -> DataFrame:
    hit = F.col("is_gold") & F.col("rank").isNotNull()
    counts = judge(gold, predictions).groupBy("qid").agg(
        F.count_if("is_gold").alias("n_gold"),
        *[F.count_if(hit & (F.col("rank") <= k)).alias(f"hit_{k}") for k in depths],
    )
    return counts.where("n_gold > 0")


def recall_at_k(gold: DataFrame, predictions: DataFrame, depths: Sequence[int] = DEPTHS) -> DataFrame:
    """Mean recall at each depth (A-02); depths become columns, not a cross join."""
    counts = _per_depth(gold, predictions, depths)
    wide = counts.agg(*[F.round(F.avg(F.col(f"hit_{k}") / F.col("n_gold")), 9).alias(f"at_{k}") for k in depths])
    return _long(wide, depths, ["recall"], {"recall": "at_"})


def _long(wide: DataFrame, depths: Sequence[int], names: Sequence[str], prefix: dict[str, str]) -> DataFrame:
    rows = F.array(
        *[F.struct(F.lit(k).alias("k"), *[F.col(f"{prefix[n]}{k}").alias(n) for n in names]) for k in depths]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def candidate_depths(gold: DataFrame, hits: DataFrame, depths: Sequence[int] = DEPTHS) -> DataFrame:
    """Candidate-pool metrics by chunk depth (A-09).

    ``hits`` are chunk rows (qid, doc_id, rank).  Every depth is a conditional
    aggregate over the best chunk rank of a document, so the pool is read once.
    """
    docs = judge(gold, hits)
    size = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("pool"))
    found = F.col("rank").isNotNull()
    per = docs.groupBy("qid").agg(
        F.count_if("is_gold").alias("n_gold"),
        *[F.count_if(F.col("is_gold") & found & (F.col("rank") <= k)).alias(f"hit_{k}") for k in depths],
        *[F.count_if(found & (F.col("rank") <= k)).alias(f"docs_{k}") for k in depths],
    )
    joined = per.where("n_gold > 0").join(size, "qid", "left")
    multi = F.col("n_gold") > 1
    columns = []
    for k in depths:
        recall = F.col(f"hit_{k}") / F.col("n_gold")
        columns += [
            F.round(F.avg(recall), 9).alias(f"recall_{k}"),
            F.round(F.avg(f"docs_{k}"), 9).alias(f"unique_{k}"),
            F.count_if(F.coalesce("pool", F.lit(0)) >= k).alias(f"complete_{k}"),
            F.round(F.avg(F.when(multi, recall)), 9).alias(f"multi_{k}"),
            F.count_if(multi & (F.col(f"hit_{k}") == F.col("n_gold"))).alias(f"covered_{k}"),
        ]
    wide = joined.agg(*columns)
    names = ["recall", "unique_docs", "complete_queries", "multi_gold_recall", "multi_gold_covered"]
    prefix = dict(zip(names, ["recall_", "unique_", "complete_", "multi_", "covered_"], strict=True))
    return _long(wide, depths, names, prefix)


def diagnostics(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Matched, missed and unexpected documents of each question (M-05).

    Predictions are bounded by the official length, so the arrays are short.
    """
    judged = judge(gold, predictions)
    hit = F.col("is_gold") & F.col("rank").isNotNull()
    ordered = lambda cond, key: F.transform(
        F.array_sort(F.collect_list(F.when(cond, F.struct(key.alias("k"), F.col("doc_id").alias("d"))))), lambda e: e["d"]
    )
    return judged.groupBy("qid").agg(
        ordered(hit, F.col("rank")).alias("matched"),
        ordered(F.col("is_gold") & F.col("rank").isNull(), F.col("doc_id").cast("string")).alias("missed"),
        ordered(~F.col("is_gold"), F.col("rank")).alias("unexpected"),
    )


def gold_ranks(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """First chunk rank and first document rank of each gold document (W-04)."""
    from lexatlas.operators.ranking import first_occurrence

    ranked = first_occurrence(hits).select("qid", "doc_id", "chunk_rank", F.col("rank").alias("document_rank"))
    return gold.select("qid", "doc_id").distinct().join(ranked, ["qid", "doc_id"], "left")


def rank_summary(ranks: DataFrame) -> DataFrame:
    """Mean and median gold ranks plus missing counts (A-10)."""
    missing = F.col("chunk_rank").isNull()
    return ranks.agg(
        F.count(F.lit(1)).alias("gold_document_count"),
        F.count_if(missing).alias("missing_count"),
        F.count_distinct(F.when(missing, F.col("qid"))).alias("queries_with_missing"),
        F.round(F.avg("chunk_rank"), 9).alias("mean_chunk_rank"),
        F.percentile("chunk_rank", F.lit(0.5)).alias("median_chunk_rank"),
        F.round(F.avg("document_rank"), 9).alias("mean_document_rank"),
        F.percentile("document_rank", F.lit(0.5)).alias("median_document_rank"),
    )


def failure_buckets(gold: DataFrame, hits: DataFrame, final: DataFrame) -> DataFrame:
    """Why each question succeeded or failed (A-10, D.13)."""
    tagged = (
        gold.select("qid", "doc_id", F.lit(1).alias("g"), F.lit(0).alias("c"), F.lit(0).alias("f"))
        .unionByName(hits.select("qid", "doc_id", F.lit(0).alias("g"), F.lit(1).alias("c"), F.lit(0).alias("f")))
        .unionByName(final.select("qid", "doc_id", F.lit(0).alias("g"), F.lit(0).alias("c"), F.lit(1).alias("f")))
        .groupBy("qid", "doc_id")
        .agg(F.max("g").alias("g"), F.max("c").alias("c"), F.max("f").alias("f"))
        .where("g = 1")
    )
    per = tagged.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_gold"), F.sum("c").alias("in_candidates"), F.sum("f").alias("in_final")
    )
    bucket = (
        F.when(F.col("in_candidates") == 0, "retrieval_miss")
        .when((F.col("n_gold") > 1) & (F.col("in_final") > 0) & (F.col("in_final") < F.col("n_gold")), "multi_gold_partial")
        .when(F.col("in_final") == 0, "candidate_present_final_miss")
        .otherwise("success")
    )
    return per.withColumn("bucket", bucket)


def absent_and_dropped(buckets: DataFrame) -> DataFrame:
    """Gold lost before and after candidate generation (A-11)."""
    return buckets.agg(
        F.sum(F.col("n_gold") - F.col("in_candidates")).alias("gold_absent"),
        F.sum(F.greatest(F.col("in_candidates") - F.col("in_final"), F.lit(0))).alias("gold_dropped"),
    )


def fold_metrics(per_query_rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Recall and precision per validation fold (A-10)."""
    return (
        per_query_rows.join(folds.select("qid", "fold"), "qid")
        .groupBy("fold")
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.round(F.avg("recall"), 9).alias("recall"),
            F.round(F.avg("precision"), 9).alias("precision"),
        )
    )


def coverage(expected: DataFrame, actual: DataFrame, key: str = "qid") -> DataFrame:
    """Ids on one side only (F-14); empty when coverage is exact."""
    return (
        expected.select(F.col(key).alias("id"), F.lit(1).alias("s"))
        .unionByName(actual.select(F.col(key).alias("id"), F.lit(2).alias("s")))
        .groupBy("id")
        .agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
        .where("lo = hi")
        .select("id", F.when(F.col("lo") == 1, "missing").otherwise("unexpected").alias("problem"))
    )


def latency_summary(rows: DataFrame, value: str) -> DataFrame:
    """Count, extremes, mean and interpolated percentiles (A-04), the latter by narrowing ranges over all tasks."""
    v = F.col(value)
    valid = v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < F.lit(float("inf")))
    sound = rows.where(valid)
    middle, high, higher = (F.lit(p).cast("double") for p in percentiles(sound.select(v.cast("double").alias("v")), "v", (0.5, 0.95, 0.99)))
    return sound.agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.sum(v), 4).alias("total_ms"),
        F.min(v).alias("min_ms"),
        F.max(v).alias("max_ms"),
        F.round(F.avg(v), 6).alias("mean_ms"),
    ).select("*", F.round(middle, 6).alias("median_ms"), F.round(high, 6).alias("p95_ms"), F.round(higher, 6).alias("p99_ms"))


def compare_summaries(before: DataFrame, after: DataFrame, names: Sequence[str] = ("recall", "precision", "multi_gold_recall")) -> DataFrame:
    """Before, after and delta of two one-row reports over the same samples (UDT-16)."""
    left = before.select("sample_count", *[F.col(n).alias(f"before_{n}") for n in names])
    right = after.select(F.col("sample_count").alias("after_count"), *[F.col(n).alias(f"after_{n}") for n in names])
    joined = left.crossJoin(right)  # one row on each side
    same = F.assert_true(F.col("sample_count") == F.col("after_count"), F.lit("reports cover different samples"))
    return joined.where(same.isNull()).select(
        "sample_count",
        *[c for n in names for c in (F.col(f"before_{n}"), F.col(f"after_{n}"), F.round(F.col(f"after_{n}") - F.col(f"before_{n}"), 9).alias(f"delta_{n}"))],
    )


def depth_recommendation(depth_rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Whether a deeper candidate search is worth probing (UDT-17)."""
    deepest = depth_rows.agg(F.max_by("recall", "k").alias("recall"), F.max("k").alias("depth"))
    misses = buckets.agg(F.count_if(F.col("bucket") == "retrieval_miss").alias("retrieval_miss"))
    probe = (F.col("depth") < 500) & ((F.col("recall") < 0.98) | (F.col("retrieval_miss") > 0))
    return deepest.crossJoin(misses).withColumn(
        "decision", F.when(probe, "recommended_for_gpu_probe").otherwise("not_priority_from_current_evidence")
    )


def evaluate_samples(samples: DataFrame, hits: DataFrame, scores: Sequence[str] = (), latency: str = "latency_ms", depths: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Combined evaluation in one aggregate (M-04, M-09): recall at depths and reciprocal rank, and optional parts.

    ``samples``: qid, gold (array of ids that count as found), the columns in
    ``scores`` (answer scores in 0..1) and ``latency``; ``hits``: qid, doc_id,
    rank. An optional column counts only if *all* samples have it: if none
    has, its mean is null, and if some have, the evaluation is refused, as a
    mean over the rest would look better than the run was.
    """
    found = (
        hits.join(samples.select("qid", "gold"), "qid")
        .where(F.array_contains("gold", F.col("doc_id")))
        .groupBy("qid")
        .agg(F.min("rank").alias("first"), *[F.count_distinct(F.when(F.col("rank") <= k, F.col("doc_id"))).alias(f"at_{k}") for k in depths])
    )
    rows = samples.join(found, "qid", "left")
    gold = F.greatest(F.size(F.array_distinct("gold")), F.lit(1))
    parts = [*scores, *([latency] if latency in samples.columns else [])]
    told = rows.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 9).alias("mrr"),
        *[F.round(F.avg(F.coalesce(F.col(f"at_{k}") / gold, F.lit(0.0))), 9).alias(f"recall_at_{k}") for k in depths],
        *[F.round(F.avg(p), 9).alias(f"mean_{p}") for p in parts],
        *[F.count(p).alias(f"_{p}") for p in parts],
    )
    whole = F.lit(True)
    for p in parts:
        whole = whole & F.col(f"_{p}").isin(0, F.col("sample_count"))
    mixed = F.concat_ws(", ", *[F.when(~F.col(f"_{p}").isin(0, F.col("sample_count")), F.lit(p)) for p in parts])
    checked = told.where(F.assert_true(whole, F.concat(F.lit("only some samples have "), mixed)).isNull())
    return checked.drop(*[f"_{p}" for p in parts])
