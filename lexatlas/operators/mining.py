"""Hard-negative mining and training groups for a reranker."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.functions import text as tx
from lexatlas.functions.unicode import casefold
from lexatlas.operators.ranking import with_rank
from lexatlas.operators.setjoin import similar_sets


@dataclass(frozen=True)
class MiningLimits:
    # Rank bands and limits of the published results.
    hard_rank_max: int = 20
    semi_min: int = 10
    semi_max: int = 100
    easy_min: int = 101
    max_hard: int = 10
    max_semi: int = 10
    max_easy: int = 0
    near_duplicate: float = 0.90
    #: Parts of source names that count as dense retrieval; add those of your encoders.
    dense_sources: tuple[str, ...] = ("dense", "parent", "semantic")


def long_tokens(text: Column) -> Column:
    """Distinct folded word tokens of more than one character."""
    return F.array_distinct(F.filter(tx.words(casefold(text)), lambda t: F.length(t) > 1))


def near_duplicates(candidates: DataFrame, positives: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Candidates too similar to a positive of the same question (F-08).

    Both sides carry ``tokens``.  Sets whose sizes alone rule out the threshold
    are dropped by the join condition before any set is compared.  Meant for a
    few positives a question; :func:`near_duplicates_indexed` gives the same
    for many.
    """
    c, p = candidates.alias("c"), positives.select("qid", F.col("tokens").alias("ptokens")).alias("p")
    small = F.least(F.size("c.tokens"), F.size("p.ptokens"))
    large = F.greatest(F.size("c.tokens"), F.size("p.ptokens"))
    pairs = c.join(p, (F.col("c.qid") == F.col("p.qid")) & (small > 0) & (small >= threshold * large))
    return (
        pairs.where(tx.jaccard(F.col("c.tokens"), F.col("p.ptokens")) >= threshold)
        .select(F.col("c.qid").alias("qid"), F.col("c.doc_id").alias("doc_id"), F.col("c.source").alias("source"))
        .distinct()
    )


def near_duplicates_indexed(candidates: DataFrame, positives: DataFrame, threshold: float = 0.90) -> DataFrame:
    """As :func:`near_duplicates`, through an index over rare tokens (``setjoin``): no candidate meets each positive.

    The same document comes up for many questions, so every different set is
    compared once.
    """
    digest = F.struct(F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), "tokens").alias("b"))
    some = candidates.select("qid", "doc_id", "source", digest.alias("one"), "tokens")
    wanted = positives.select("qid", digest.alias("two"), "tokens")
    sets = some.select("one", "tokens").dropDuplicates(["one"])
    pairs = similar_sets(sets, wanted.select("two", "tokens").dropDuplicates(["two"]), threshold, (), "one", "two").select("one", "two")
    asked = wanted.select("qid", "two").distinct().join(pairs, "two").select("qid", "one").distinct()
    return some.select("qid", "doc_id", "source", "one").join(asked, ["qid", "one"], "left_semi").select("qid", "doc_id", "source").distinct()


def negative_type(limits: MiningLimits) -> Column:
    """Class of one negative (UDT-12); null when no band applies.

    Expects same_law, source, rank and shared_tokens.
    """
    rank = F.col("rank")
    hard = rank <= limits.hard_rank_max
    dense = F.col("source").rlike("|".join(limits.dense_sources))
    return (
        F.when(F.col("same_law"), "same_law")
        .when(dense & hard, "semantic_confuser")
        .when(hard, "hard_false_positive")
        .when(rank.between(limits.semi_min, limits.semi_max), F.when(F.col("shared_tokens") >= 2, "lexical_confuser").otherwise("semi_hard"))
        .when(rank >= limits.easy_min, "easy_random")
    )


def strength(limits: MiningLimits) -> Column:
    kind = F.col("negative_type")
    return (
        F.when(kind == "same_law", F.when(F.col("rank") <= limits.hard_rank_max, "hard").otherwise("semi_hard"))
        .when(kind.isin("semantic_confuser", "hard_false_positive"), "hard")
        .when(kind == "easy_random", "easy")
        .when(kind.isNotNull(), "semi_hard")
    )


def select_negatives(questions: DataFrame, gold: DataFrame, candidates: DataFrame, limits: MiningLimits = MiningLimits()) -> DataFrame:
    """Negatives of each question within the per-strength limits (F-09, TK-07, UDT-13).

    ``candidates``: qid, doc_id, source, rank, score, text, law_name, ambiguous;
    ``source_order`` is optional and decides whose text a positive takes;
    ``tokens`` may hold the :func:`long_tokens` of the text already. Tokens are
    reduced to two facts a candidate first (near a positive, tokens shared with
    the question); everything else is decided on numbers, and only the chosen
    rows meet their texts again.
    """
    if "tokens" not in candidates.columns:
        candidates = candidates.withColumn("tokens", long_tokens(F.coalesce("text", F.lit(""))))
    if "source_order" not in candidates.columns:
        candidates = candidates.withColumn("source_order", F.col("source"))
    # one entry per (source, question, document): the first one listed
    key = ["qid", "source", "source_order", "doc_id"]
    entry = F.struct("rank", "score", "law_name", "ambiguous", "tokens")
    unique = candidates.groupBy(*key).agg(F.min_by(entry, "rank").alias("e")).select(*key, "e.*")
    is_gold = gold.select("qid", "doc_id", F.lit(True).alias("is_gold")).distinct()
    # read four times below; no larger than the candidate pool, and without its texts
    judged = unique.join(is_gold, ["qid", "doc_id"], "left").persist(StorageLevel.MEMORY_AND_DISK)
    positives = (
        judged.where("is_gold")
        .groupBy("qid", "doc_id")
        .agg(F.min_by(F.struct("tokens", "law_name"), F.struct("source_order", "rank")).alias("p"))
        .select("qid", "p.tokens", casefold(F.col("p.law_name")).alias("law"))
    )
    laws = positives.where("law <> ''").select("qid", "law").distinct().withColumn("same_law", F.lit(True))
    open_ = judged.where(F.col("is_gold").isNull() & ~F.coalesce("ambiguous", F.lit(False))).drop("is_gold")
    asked = questions.select("qid", long_tokens(F.col("question")).alias("qtokens"))
    near = near_duplicates(open_, positives, limits.near_duplicate)
    in_band = F.col("rank").between(limits.semi_min, limits.semi_max)
    typed = (
        open_.join(asked, "qid")
        .withColumn("shared_tokens", F.when(in_band, F.size(F.array_intersect("tokens", "qtokens"))))
        .drop("tokens", "qtokens")
        .join(near, ["qid", "doc_id", "source"], "left_anti")
        .withColumn("law", casefold(F.coalesce("law_name", F.lit(""))))
        .join(laws, ["qid", "law"], "left")
        .withColumn("same_law", F.coalesce("same_law", F.lit(False)))
        .withColumn("negative_type", negative_type(limits))
        .where("negative_type is not null")
        .withColumn("strength", strength(limits))
    )
    best = with_rank(typed, ["qid", "doc_id"], [F.col("rank"), F.col("source")], "_n").where("_n = 1")
    placed = with_rank(best, ["qid", "strength"], [F.col("rank"), F.col("source"), F.col("doc_id")], "_n")
    allowed = (
        F.when(F.col("strength") == "hard", limits.max_hard)
        .when(F.col("strength") == "semi_hard", limits.max_semi)
        .otherwise(limits.max_easy)
    )
    chosen = placed.where(F.col("_n") <= allowed).select(*key, "rank", "score", "law_name", "negative_type", "strength")
    texts = candidates.select(*key, "rank", "text").join(chosen, [*key, "rank"], "left_semi").groupBy(*key, "rank").agg(F.min("text").alias("text"))
    return chosen.join(texts, [*key, "rank"]).select(
        "qid", "doc_id", "source", "rank", "score", "text", "law_name", "negative_type", "strength"
    )


def training_rows(questions: DataFrame, gold: DataFrame, negatives: DataFrame, folds: DataFrame) -> DataFrame:
    """gold x negative rows for every fold that may train on the question (J-13, SNK-11)."""
    from lexatlas.operators.folds import training_folds

    return (
        negatives.withColumnRenamed("doc_id", "negative_doc")
        .join(gold.select("qid", F.col("doc_id").alias("positive_doc")).distinct(), "qid")
        .join(training_folds(folds), "qid")
    )


def negative_statistics(rows: DataFrame) -> DataFrame:
    """Counts by type and rank band (A-17)."""
    band = (
        F.when(F.col("strength") == "hard", "hard_1_20").when(F.col("strength") == "easy", "easy_101_plus").otherwise("semi_10_100")
    )
    return rows.groupBy("negative_type", band.alias("rank_band")).agg(F.count(F.lit(1)).alias("n"))


# Rank bands and sample sizes of the training groups.
HARD_END, MEDIUM_END = 20, 100
POSITIVES, NEGATIVES_PER_BAND = 3, 3


def training_members(gold: DataFrame, hits: DataFrame, positives: int = POSITIVES, per_band: int = NEGATIVES_PER_BAND) -> DataFrame:
    """Chunks that enter each question's training group (W-10).

    One row per (question, band, chunk): up to ``positives`` positive chunks and
    per band the first chunks of distinct documents.
    """
    is_gold = gold.select("qid", "doc_id", F.lit(True).alias("is_gold")).distinct()
    judged = hits.join(is_gold, ["qid", "doc_id"], "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))
    chosen = with_rank(judged.where("is_gold"), ["qid"], [F.col("rank")], "n").where(F.col("n") <= positives)
    chosen = chosen.withColumn("band", F.lit("positive"))
    laws = chosen.where(F.coalesce("law_name", F.lit("")) != "").select("qid", "law_name").distinct().withColumn("same_law", F.lit(True))
    others = judged.where("not is_gold").join(chosen.select("qid").distinct(), "qid", "left_semi")
    others = others.join(laws, ["qid", "law_name"], "left")
    rank_band = F.when(F.col("rank") <= HARD_END, "hard").when(F.col("rank") <= MEDIUM_END, "medium").otherwise("easy")
    bands = F.array_compact(F.array(rank_band, F.when(F.col("same_law"), F.lit("same_law"))))
    listed = others.withColumn("band", F.explode(bands))
    first = with_rank(listed, ["qid", "band", "doc_id"], [F.col("rank")], "_d").where("_d = 1")
    picked = with_rank(first, ["qid", "band"], [F.col("rank")], "n").where(F.col("n") <= per_band)
    columns = ["qid", "band", "n", "doc_id", "chunk_id", "rank"]
    return chosen.select(*columns).unionByName(picked.select(*columns))


def training_groups(members: DataFrame) -> DataFrame:
    """One record per question with a short array per band (UDT-14)."""
    item = F.struct("n", "doc_id", "chunk_id", "rank")
    bands = ["positive", "hard", "medium", "easy", "same_law"]
    return members.groupBy("qid").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("band") == b, item))).alias(b) for b in bands]
    )


def balanced_examples(members: DataFrame) -> DataFrame:
    """As many negatives as positives per question, hardest first (ML-06)."""
    order = F.array_position(F.array(F.lit("hard"), F.lit("medium"), F.lit("easy"), F.lit("same_law")), F.col("band"))
    positives = members.where("band = 'positive'")
    count = positives.groupBy("qid").agg(F.count(F.lit(1)).alias("n_pos"))
    negatives = with_rank(members.where("band <> 'positive'"), ["qid"], [order, F.col("n")], "pick")
    kept = negatives.join(count, "qid")
    size = kept.groupBy("qid").agg(F.count(F.lit(1)).alias("n_neg"))
    columns = ["qid", "doc_id", "chunk_id"]
    return (
        kept.where(F.col("pick") <= F.col("n_pos")).select(*columns, F.lit(0).alias("label"))
        .unionByName(positives.join(size, "qid").where(F.col("n") <= F.col("n_neg")).select(*columns, F.lit(1).alias("label")))
    )
