"""Rank fusion, reranking and chunk-to-document aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fusion constant, depths and method names of the published results.
RRF_K = 60
FINAL_DOCUMENTS = 5
MISSING_RANK = 10**9
AGGREGATION_METHODS = (
    "first_occurrence",
    "max",
    "max_plus_0.10_second",
    "max_plus_0.20_second",
    "top2_mean",
    "rrf_cap2",
    "rrf_cap3",
)


def with_rank(frame: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Ranks 1..n inside each group (W-01)."""
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def first_occurrence(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """Document ranking from chunk hits: each document at its best rank (W-03)."""
    best = hits.groupBy("qid", "doc_id").agg(F.min("rank").alias("chunk_rank"))
    ranked = with_rank(best, ["qid"], [F.col("chunk_rank"), F.col("doc_id")])
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def rerank(hits: DataFrame, depth: int, score: str = "rerank_score") -> DataFrame:
    """Reorder the first ``depth`` hits by score; the tail keeps its order (W-02)."""
    head = F.col("source_rank") <= depth
    order = [F.when(head, 0).otherwise(1), F.when(head, -F.col(score)).otherwise(F.lit(0.0)), F.col("source_rank")]
    return with_rank(hits.withColumnRenamed("rank", "source_rank"), ["qid"], order)


def weighted_rrf(
    sources: Sequence[DataFrame],
    weights: Sequence[float],
    k: int = RRF_K,
    limit: int | None = FINAL_DOCUMENTS,
    item: str = "doc_id",
) -> DataFrame:
    """Weighted reciprocal-rank fusion (A-08, J-09, TK-03).

    One union and one aggregation replace a chain of outer joins.  A source of
    weight zero is not read at all and breaks no ties.
    """
    if len(sources) != len(weights) or not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("one non-negative weight per source, at least one positive")
    live = [(i, s, w) for i, (s, w) in enumerate(zip(sources, weights, strict=True)) if w > 0]
    rows = reduce(
        DataFrame.unionByName,
        [
            s.select("qid", item, F.lit(i).alias("source"), F.lit(float(w)).alias("weight"), F.col("rank").cast("long").alias("rank"))
            for i, s, w in live
        ],
    )
    fused = rows.groupBy("qid", item).agg(
        F.round(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))), 12).alias("score"),
        *[
            F.coalesce(F.min(F.when(F.col("source") == i, F.col("rank"))), F.lit(MISSING_RANK)).alias(f"rank_{i}")
            for i, _, _ in live
        ],
    )
    ranked = with_rank(
        fused, ["qid"], [F.col("score").desc(), *[F.col(f"rank_{i}") for i, _, _ in live], F.col(item)]
    )
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def fuse_chunks(dense: DataFrame, reranked: DataFrame, dense_weight: float = 0.2, rerank_weight: float = 0.8, k: int = RRF_K) -> DataFrame:
    """Chunk-level fusion of two rankings over the same pool (J-10)."""
    pair = dense.select("qid", "chunk_id", F.col("rank").alias("dense_rank")).join(
        reranked.select("qid", "chunk_id", F.col("rank").alias("rerank_rank")), ["qid", "chunk_id"]
    )
    score = F.round(dense_weight / (k + F.col("dense_rank")) + rerank_weight / (k + F.col("rerank_rank")), 12)
    return with_rank(
        pair.withColumn("score", score),
        ["qid"],
        [F.col("score").desc(), F.col("dense_rank"), F.col("rerank_rank"), F.col("chunk_id")],
    )


def pool_mismatch(left: DataFrame, right: DataFrame) -> DataFrame:
    """Chunks that only one of two candidate pools holds (F-17)."""
    tagged = left.select("qid", "chunk_id", F.lit(1).alias("side")).unionByName(
        right.select("qid", "chunk_id", F.lit(2).alias("side"))
    )
    return (
        tagged.groupBy("qid", "chunk_id")
        .agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
        .where(F.col("lo") == F.col("hi"))
        .select("qid", "chunk_id", F.when(F.col("lo") == 1, "left").otherwise("right").alias("only_in"))
    )


def effective_dense_score(columns: Sequence[str]) -> Column:
    """First score present among dense, final and plain; zero if none (NUM-12)."""
    names = [F.col(c) for c in ("dense_score", "final_score", "score") if c in columns]
    return F.coalesce(*names, F.lit(0.0))


def document_profile(hits: DataFrame, evidence: int = 3, cap: int = 3, chunk: str = "chunk_id") -> DataFrame:
    """Everything the seven aggregation methods need, in one pass (A-05, TK-05).

    Only a fixed number of leaders per (question, document) is kept as arrays;
    the support count is a plain count.
    """
    by_rank = Window.partitionBy("qid", "doc_id").orderBy("rank")
    by_score = Window.partitionBy("qid", "doc_id").orderBy(F.col("dense").desc(), "rank", chunk)
    placed = (
        hits.withColumn("dense", effective_dense_score(hits.columns))
        .withColumn("_by_rank", F.row_number().over(by_rank))
        .withColumn("_by_score", F.row_number().over(by_score))
    )
    leaders = F.array_sort(F.collect_list(F.when(F.col("_by_score") <= evidence, F.struct("_by_score", chunk))))
    return placed.groupBy("qid", "doc_id").agg(
        F.min("rank").alias("first_rank"),
        F.max("dense").alias("max_score"),
        F.max(F.when(F.col("_by_score") == 2, F.col("dense"))).alias("second_score"),
        F.count(F.lit(1)).alias("support"),
        F.sum(F.when(F.col("_by_rank") <= 2, 1.0 / (RRF_K + F.col("rank")))).alias("rrf_cap2"),
        F.sum(F.when(F.col("_by_rank") <= 3, 1.0 / (RRF_K + F.col("rank")))).alias("rrf_cap3"),
        F.transform(leaders, lambda e: e[chunk]).alias("evidence"),
    )


def aggregation_score(method: str) -> Column:
    """Score of one aggregation method over a document profile (A-05)."""
    top, second = F.col("max_score"), F.col("second_score")
    table = {
        "first_occurrence": -F.col("first_rank").cast("double"),
        "max": top,
        "max_plus_0.10_second": top + 0.10 * F.coalesce(second, F.lit(0.0)),
        "max_plus_0.20_second": top + 0.20 * F.coalesce(second, F.lit(0.0)),
        "top2_mean": F.coalesce((top + second) / 2.0, top),
        "rrf_cap2": F.col("rrf_cap2"),
        "rrf_cap3": F.col("rrf_cap3"),
    }
    if method not in table:
        raise ValueError(f"unknown aggregation method: {method}")
    return F.round(table[method], 9)


def aggregate_documents(hits: DataFrame, methods: Sequence[str] = AGGREGATION_METHODS, limit: int | None = None, chunk: str = "chunk_id") -> DataFrame:
    """Documents ranked by each method side by side (A-05, TK-04, M-06, M-07)."""
    profile = document_profile(hits, chunk=chunk)
    scored = profile.withColumn(
        "m",
        F.explode(F.array(*[F.struct(F.lit(m).alias("method"), aggregation_score(m).alias("score")) for m in methods])),
    ).select("qid", "doc_id", "first_rank", "support", "evidence", F.col("m.method").alias("method"), F.col("m.score").alias("score"))
    ranked = with_rank(scored, ["qid", "method"], [F.col("score").desc(), F.col("first_rank"), F.col("doc_id")])
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def fuse_parents(parents: DataFrame, ce_weight: float = 1.0, retrieval_weight: float = 0.0, k: int = 5) -> DataFrame:
    """Cross-encoder rank fused with the retrieval rank of each parent (W-05)."""
    if abs(ce_weight + retrieval_weight - 1.0) > 1e-9 or min(ce_weight, retrieval_weight) < 0:
        raise ValueError("fusion weights must be non-negative and sum to one")
    retrieval = with_rank(
        parents, ["qid"], [F.col("candidate_rank"), F.col("doc_id"), F.col("parent_id")], "retrieval_rank"
    )
    score = F.round(ce_weight / (k + F.col("rank")) + retrieval_weight / (k + F.col("retrieval_rank")), 12)
    return with_rank(
        retrieval.withColumn("fused_score", score),
        ["qid"],
        [F.col("fused_score").desc(), F.col("rank"), F.col("candidate_rank"), F.col("doc_id"), F.col("parent_id")],
        "fused_rank",
    )


def reorder_edges(ranked: DataFrame, group: str = "qid", rank: str = "rank") -> DataFrame:
    """Strongest items at both ends: even positions from the left, odd from the right (TK-11)."""
    size = F.count(F.lit(1)).over(Window.partitionBy(group))
    zero = F.col(rank) - 1
    return ranked.withColumn(
        "slot",
        F.when(size <= 2, F.col(rank))
        .when(zero % 2 == 0, (zero / 2).cast("long") + 1)
        .otherwise(size - ((zero - 1) / 2).cast("long")),
    )


def append_missing(rankings: DataFrame, questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """Complete each ranking with the corpus ids it lacks, in id order (SET-08).

    The output holds questions x corpus rows by definition of a complete
    ranking; ids are numbered once, not per question.
    """
    full = questions.select("qid").distinct().crossJoin(corpus.select("doc_id").distinct())
    placed = full.join(rankings.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    return with_rank(
        placed.withColumnRenamed("rank", "given"), ["qid"], [F.coalesce("given", F.lit(MISSING_RANK)), F.col("doc_id")]
    ).select("qid", "doc_id", "rank")
