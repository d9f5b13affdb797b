"""The given tables in the roles the operators expect, and what Spark derives from them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.functions import text as tx
from lexatlas.functions.ngrams import known_ngrams
from lexatlas.operators import bm25, mining, models, ranking, vectors
from lexatlas.operators.joins import fits_broadcast, narrow, salted_join, spread

KNN_DEPTH = 20
TABLES = ("documents", "benchmark", "labels", "embeddings", "conversations", "pages", "events")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def turn_id() -> Column:
    """Question id of a conversation turn; distinct for any number of turns."""
    return F.concat_ws("-", "conv_id", "turn")


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as questions."""
    return table(spark, folder, "conversations").select(
        turn_id().alias("qid"), F.col("text").alias("question")
    )


def gold(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, doc_id) where the document contains the question's passage.

    The passage's first three words are an equi-join key against document
    trigrams; only documents that share it are searched for the whole passage.
    """
    asked = questions(spark, folder)
    tokens = tx.word_tokens(F.col("question"))
    anchor = F.array_join(F.slice(tokens, 1, 3), " ")
    size = F.least(F.lit(3), F.size(tokens))
    keys = asked.select("qid", "question", anchor.alias("term"), size.alias("n"))
    texts = documents(spark, folder).select("doc_id", "text")
    if fits_broadcast(keys):
        listed = keys.select("term").where("term <> ''").distinct().toArrow().combine_chunks()
        numbers = spark.createDataFrame(listed.append_column("number", pa.array(range(len(listed)), pa.int32())))
        anchors = spark.sparkContext.broadcast(pa.array(listed["term"].to_pylist(), pa.string()))
        hits = texts.select("doc_id", "text", F.explode(known_ngrams(tx.word_tokens(F.col("text")), anchors)).alias("h"))
        pairs = hits.select("doc_id", "text", F.col("h.term").alias("number")).join(F.broadcast(keys.join(numbers, "term")), "number")
        return pairs.where(F.contains("text", F.col("question"))).select("qid", "doc_id").distinct().persist()
    terms = F.explode_outer(F.array_distinct(tx.ngrams_1_to_3(tx.word_tokens(F.col("text")))))
    pairs = salted_join(texts.select("doc_id", terms.alias("term")), keys.select("qid", "term"), ["term"], F.col("doc_id"))
    found = pairs.select("qid", "doc_id").join(texts, "doc_id").join(asked, "qid")
    return found.where(F.contains("text", F.col("question"))).select("qid", "doc_id").distinct()


def bm25_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """First-stage candidates, at most 100 per question.

    Several later steps read them, so they are kept instead of being ranked
    once per reader, and handed on: each call makes a ranking of its own.
    """
    return bm25.rank_documents(questions(spark, folder), documents(spark, folder)).persist()


def scored_pool(spark: SparkSession, folder: str, found: DataFrame | None = None) -> DataFrame:
    """The candidates with both second-stage scores.

    A document is tokenised once, before it meets the questions it is a
    candidate for.  The few numbers are kept, as the rankings below and mining
    all start from them. ``found`` is the :func:`bm25_ranking`, if there is one.
    """
    words = lambda column: F.array_distinct(tx.word_tokens(F.col(column)))
    found = bm25_ranking(spark, folder) if found is None else found
    texts = spread(narrow(table(spark, folder, "documents").select("doc_id", "text"), found, "doc_id")).select("doc_id", words("text").alias("dw"))
    asked = questions(spark, folder).select("qid", words("question").alias("qw"))
    pairs = found.join(texts, "doc_id").join(asked, "qid")
    common = F.size(F.array_intersect("qw", "dw"))
    return pairs.select(
        "qid", "doc_id", "rank", "score",
        F.round(models.word_overlap(F.col("qw"), F.col("dw")), 6).alias("rerank_score"),
        F.round(common / (F.size("qw") + F.size("dw") - common), 6).alias("similarity"),
    ).persist()


def reranked(spark: SparkSession, folder: str, depth: int = 50, pool: DataFrame | None = None) -> DataFrame:
    """BM25 candidates, or a given :func:`scored_pool`, reordered by the default pair scorer."""
    pool = scored_pool(spark, folder) if pool is None else pool
    return ranking.rerank(pool.drop("similarity"), depth)


def jaccard_ranking(spark: SparkSession, folder: str, pool: DataFrame | None = None) -> DataFrame:
    """A second candidate order over the same pool: word-set similarity."""
    pool = scored_pool(spark, folder) if pool is None else pool
    scored = pool.select("qid", "doc_id", F.col("similarity").alias("score"))
    return ranking.with_rank(scored, ["qid"], [F.col("score").desc(), F.col("doc_id")])


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of two sources with texts, for mining; ``source`` plays the law."""
    found = bm25_ranking(spark, folder)
    channels = [
        frame.select("qid", "doc_id", "rank", "score", F.lit(name).alias("source"), F.lit(i).alias("source_order"))
        for i, (name, frame) in enumerate((("bm25", found), ("dense", jaccard_ranking(spark, folder, scored_pool(spark, folder, found)))))
    ]
    both = channels[0].unionByName(channels[1])
    texts = spread(narrow(table(spark, folder, "documents").select("doc_id", "text", "source"), both, "doc_id")).select(
        "doc_id", "text", F.col("source").alias("law_name"), mining.long_tokens(F.col("text")).alias("tokens")
    )
    return both.join(texts, "doc_id").withColumn("ambiguous", F.lit(False))


def knn(spark: SparkSession, folder: str, k: int = KNN_DEPTH, labels: list[int] | None = None) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    stored = rows if labels is None else rows.where(vectors.matching({"label": labels}, rows.columns))
    return vectors.nearest(
        rows.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")),
        stored.select("vec_id", F.col("embedding").alias("v")),
        k,
    )


def vector_hits(spark: SparkSession, folder: str, k: int = KNN_DEPTH) -> DataFrame:
    """Nearest vectors as chunk hits; the label plays the document."""
    owner = table(spark, folder, "embeddings").select("vec_id", F.col("label").cast("long").alias("doc_id"))
    return knn(spark, folder, k).join(owner, "vec_id").select("qid", F.col("vec_id").alias("chunk_id"), "doc_id", "score", "rank")


def statutes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents rewritten with headings at fixed line positions.

    Line 20k opens a chapter, line 5k+1 an article, 5k+2 a clause, 5k+3 a
    point; all other lines are marked as running text.
    """
    filled = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda line: line != "")

    def numbered(line, i):
        at = F.pmod(i, F.lit(5))
        return (
            F.when(F.pmod(i, F.lit(20)) == 0, F.concat(F.lit("Chương "), (F.floor(i / 20) + 1).cast("string")))
            .when(at == 1, F.concat(F.lit("Điều "), (F.floor(i / 5) + 1).cast("string"), F.lit(". "), line))
            .when(at == 2, F.concat(F.lit("1. "), line))
            .when(at == 3, F.concat(F.lit("a) "), line))
            .otherwise(F.concat(F.lit("~ "), line))
        )

    return documents(spark, folder).select(
        "doc_id", F.array_join(F.transform(filled, numbered), "\n").alias("cleaned_text"), F.col("source").alias("law_name"), F.col("source")
    )
