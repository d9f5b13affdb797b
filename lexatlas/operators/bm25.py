"""BM25 over a vocabulary fixed by the questions (1- to 3-grams).

Data flow: every document is tokenised once, its n-grams are cut down to the
question vocabulary before anything is shuffled, and the surviving terms are
placed by document.  All later steps (term counts, weights, score sums) stay
in that placement; only per-question leaders travel further.

Questions that fit a broadcast are shipped as numbers: terms are counted by
their numbers, and a task adds the weights of a document up for all questions
at once, as a matrix of bounded size, so (question, document, term) triples
never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexatlas.functions import text as tx
from lexatlas.functions.ngrams import known_ngrams
from lexatlas.operators.joins import bounded_join, fits_broadcast, pieces, place, spread

# BM25 parameters and depth of the published results.
K1 = 0.7
B = 0.3
TOP_K = 100

#: Questions up to this size (bytes) are broadcast with their vocabulary, which
#: is at most about seven times as large.
QUESTION_BYTES = 8 << 20

DOC_MARK, MARK_NUMBER = "", -1  # pseudo term: one row per document that carries its length
#: Bytes of documents whose counted terms are placed together.
PLACED_BYTES = 32 << 20

#: Scores that a task holds at once, and the most that rounding to six decimals may move two of them apart.
CELLS, ROUNDING = 1 << 20, 2e-6


@dataclass(frozen=True)
class Bm25Parts:
    """The intermediate tables, all derived from one tokenised exchange."""

    postings: DataFrame  # doc_id, term, tf, dl; a small vocabulary's terms by number
    stats: DataFrame  # one row: doc_count, avg_length
    frequencies: DataFrame  # term, df; the document mark is the term ""
    vocabulary: DataFrame  # term, n; number, if small
    small: bool  # the questions, and with them the vocabulary, may be broadcast


def vocabulary(questions: DataFrame, text: str = "question") -> DataFrame:
    """Distinct n-grams of all questions with their length (NFKC, folded)."""
    tokens = tx.folded_word_tokens(F.col(text), "NFKC")
    return (
        questions.select(tokens.alias("t"))
        .select(F.explode(tx.ngrams_1_to_3(F.col("t"))).alias("term"))
        .distinct()
        .withColumn("n", F.size(F.split("term", " ")))
    )


def question_terms(
    questions: DataFrame, vocab: DataFrame, qid: str = "qid", text: str = "question", broadcast: bool | None = None
) -> DataFrame:
    """Terms present in each question; questions are read with plain lower case."""
    terms = questions.select(F.col(qid).alias("qid"), tx.word_tokens(F.col(text)).alias("t")).select(
        "qid", F.explode(F.array_distinct(tx.ngrams_1_to_3(F.col("t")))).alias("term")
    )
    return bounded_join(terms, vocab, ["term"], F.col("qid"), broadcast=broadcast)


def parts(
    questions: DataFrame,
    documents: DataFrame,
    question: str = "question",
    doc_id: str = "doc_id",
    text: str = "text",
    broadcast: bool | None = None,
) -> Bm25Parts:
    """Postings, corpus statistics and document frequencies (A-06).

    A question set that fits a broadcast has a vocabulary that does, as it holds
    at most three n-grams per question word; the questions are measured once.
    """
    small = fits_broadcast(questions.select(question), max_bytes=QUESTION_BYTES) if broadcast is None else broadcast
    vocab = vocabulary(questions, question)
    spark = questions.sparkSession
    texts = spread(documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    tokens = texts.select("doc_id", tx.word_tokens(F.col("text")).alias("t"))
    length = F.greatest(F.size("t"), F.lit(1)).alias("dl")
    if small:
        listed = vocab.toArrow().combine_chunks()
        vocab = spark.createDataFrame(listed.append_column("number", pa.array(np.arange(len(listed), dtype=np.int32))))
        mark = F.array(F.struct(F.lit(MARK_NUMBER).alias("term"), F.lit(1).alias("tf")))
        known = known_ngrams(F.col("t"), spark.sparkContext.broadcast(pa.array(listed["term"].to_pylist(), pa.string())))
        counted = tokens.select("doc_id", length, known.alias("hits"))
        hits = counted.select("doc_id", "dl", F.explode(F.concat(mark, "hits")).alias("h"))
        # never null, so that no reader's filter makes another exchange of it
        hits = hits.select("doc_id", "dl", F.coalesce("h.term", F.lit(MARK_NUMBER)).alias("term"), "h.tf")
        tf, is_mark = F.sum("tf"), F.col("term") == MARK_NUMBER
    else:
        known = vocab.select("term").unionByName(spark.range(1).select(F.lit(DOC_MARK).alias("term")))
        terms = tokens.select("doc_id", length, F.explode_outer(F.concat(F.array(F.lit(DOC_MARK)), tx.ngrams_1_to_3(F.col("t")))).alias("term"))
        hits = bounded_join(terms, known, ["term"], F.col("doc_id"), "left_semi", broadcast=False)
        tf, is_mark = F.count(F.lit(1)), F.col("term") == DOC_MARK
    # Place by document before counting: the pairs of one document are counted,
    # weighted and summed in one task, so (question, document, term) triples
    # never cross the network.
    placed = place(hits, "doc_id", pieces(documents, PLACED_BYTES))
    postings = placed.groupBy("doc_id", "term", "dl").agg(tf.alias("tf"))
    # The document mark is counted like a term: its df is the number of documents
    # and its summed length gives the average.  It is picked out by conditional
    # aggregates, as a filter would be pushed down and tokenise the corpus again,
    # as would a count that leaves out a column.
    per_term = postings.groupBy("term").agg(F.count("tf").alias("df"), F.sum("dl").alias("length"))
    stats = per_term.agg(
        F.max(F.when(is_mark, F.col("df"))).alias("doc_count"),
        F.max(F.when(is_mark, F.col("length") / F.col("df"))).alias("avg_length"),
    )
    frequencies = per_term.select("term", "df")
    if small:
        names = F.broadcast(vocab.select(F.col("number"), F.col("term").alias("name")))
        frequencies = frequencies.join(names, F.col("term") == F.col("number"), "left").select(F.coalesce("name", F.lit(DOC_MARK)).alias("term"), "df")
    return Bm25Parts(postings, stats, frequencies, vocab, small)


def weight(tf: Column, dl: Column, df: Column, n: Column, doc_count: Column, avg_length: Column) -> Column:
    """Weight of one matched term, scaled by its n-gram length (NUM-04)."""
    saturation = tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * dl / avg_length))
    rarity = F.log1p((doc_count - df + 0.5) / (df + 0.5))
    return saturation * rarity * n


def _sums(weighted: DataFrame, asked: DataFrame, k: int | None) -> DataFrame:
    """Sum of the weights (doc_id, term, w) of each question's terms (qid, term), in the placement by document.

    With ``k`` a task leaves out what it knows to be below its k best of a
    question; documents at the same score stay.
    """
    known = asked.toArrow().combine_chunks()
    coded = pc.dictionary_encode(known["qid"], null_encoding="encode").combine_chunks()
    term = known["term"].to_numpy()
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(term.max(initial=-1) + 2))
    shipped = asked.sparkSession.sparkContext.broadcast((coded.dictionary, starts, coded.indices.to_numpy()[order]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, starts, asking = shipped.value
        width, best = len(qids), np.zeros((len(qids), k or 0))
        docs, sums, held = [], [], 0

        def done(docs: list, sums: list) -> pa.RecordBatch:
            nonlocal best
            made = np.concatenate(sums)
            wanted = made > 0
            if k:
                best = np.concatenate([best, made.T], axis=1)
                best = np.partition(best, -k, axis=1)[:, -k:]
                wanted &= made >= best.min(axis=1) - ROUNDING
            at, of = np.nonzero(wanted)
            return pa.RecordBatch.from_arrays([qids.take(pa.array(of)), pa.concat_arrays(docs).take(pa.array(at)), pa.array(made[at, of])], ["qid", "doc_id", "score"])

        for batch in batches:
            ids, terms, weights = batch.column("doc_id"), batch.column("term").to_numpy(), batch.column("w").to_numpy()
            changed = np.append(True, np.diff(ids.dictionary_encode(null_encoding="encode").indices.to_numpy()) != 0)
            many = starts[terms + 1] - starts[terms]
            triples, at = np.cumsum(many), 0
            while at < len(ids):
                run = np.cumsum(changed[at:]) - changed[at]
                stop = at + int(np.searchsorted(triples[at:], triples[at] - many[at] + CELLS, "right"))
                stop = min(max(stop, at + 1), at + int(np.searchsorted(run, max(1, CELLS // max(1, width)), "left")))
                row, size = run[: stop - at], many[at:stop]
                place = np.arange(size.sum()) + np.repeat(starts[terms[at:stop]] - np.cumsum(size) + size, size)
                added = np.bincount(np.repeat(row, size) * width + asking[place], np.repeat(weights[at:stop], size), (row[-1] + 1) * width).reshape(-1, width)
                first = ids.slice(at, 1)
                if docs and docs[-1].slice(len(docs[-1]) - 1).equals(first):  # the document before goes on
                    sums[-1][-1] += added[0]
                    added, row = added[1:], row[row > 0]
                elif held + len(added) > max(1, CELLS // max(1, width)) and docs:
                    yield done(docs, sums)
                    docs, sums, held = [], [], 0
                if len(added):
                    heads = np.flatnonzero(np.append(True, np.diff(run[: stop - at]) != 0)) + at
                    docs.append(ids.take(pa.array(heads[len(heads) - len(added) :])))
                    sums.append(added)
                    held += len(added)
                at = stop
        if docs:
            yield done(docs, sums)

    fields = [T.StructField("qid", asked.schema["qid"].dataType), T.StructField("doc_id", weighted.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())]
    return weighted.sortWithinPartitions("doc_id", "term", "w").mapInArrow(add, T.StructType(fields))


def scores(
    questions: DataFrame,
    documents: DataFrame,
    qid: str = "qid",
    question: str = "question",
    doc_id: str = "doc_id",
    text: str = "text",
    k: int | None = None,
) -> DataFrame:
    """Positive BM25 scores (qid, doc_id, score); with ``k`` at least the k best of each question."""
    p = parts(questions, documents, question, doc_id, text)
    asked = question_terms(questions, p.vocabulary, qid, question, p.small)
    if p.small:
        asked = asked.select("qid", "n", F.col("number").alias("term"))
        numbers = p.postings.join(F.broadcast(asked.select("term", "n").distinct()), "term")
        matched = numbers.join(F.broadcast(p.postings.groupBy("term").agg(F.count("tf").alias("df"))), "term")
    else:
        # df per (question, term); no larger than the questions themselves
        asked = asked.join(p.frequencies, "term")
        matched = bounded_join(p.postings, asked, ["term"], F.col("doc_id"), broadcast=False).repartition("doc_id")
    w = weight(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("doc_count"), F.col("avg_length")).alias("w")
    matched = matched.join(F.broadcast(p.stats))
    if p.small:
        summed = _sums(matched.select("doc_id", "term", w), asked.select("qid", "term"), k).withColumn("score", F.round("score", 6))
    else:
        summed = matched.select("qid", "doc_id", w).groupBy("qid", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
    return summed.where(F.col("score") > 0)


def top_documents(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """Leading documents per question, ties by document id (TK-02)."""
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(questions: DataFrame, documents: DataFrame, k: int = TOP_K, **columns: str) -> DataFrame:
    return top_documents(scores(questions, documents, **columns, k=k), k)
