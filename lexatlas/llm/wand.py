"""Exact BM25 top-k by block-max WAND over sharded inverted indexes.

Document counts and lengths are gathered over all documents first, so every
shard scores with global statistics and the shards' leaders merge exactly. A
shard is a run of documents inside a task. Its postings are kept by term, and
each term's largest weight by block of document numbers. For a question, the
sum of its terms' block maxima bounds every score in a block; blocks are taken
best bound first, in growing rounds, until no bound reaches the k-th best
score so far, which is carried from shard to shard within a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexatlas.llm.common import numbered, save, small_batches

K1, B = 1.2, 0.75
#: Documents per shard and per block of an index.
SHARD_DOCS, BLOCK_DOCS = 4096, 64
#: Questions answered in one pass over the documents.
QUESTION_BLOCK = 1024
#: Decimals that scores are compared by, so that the order of summation never decides a rank.
DECIMALS = 6
FOUND = "query_id long, doc_id long, score double"


def terms_of(text: str | None) -> list[bytes]:
    """Words in ASCII lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _statistics(documents: DataFrame, vocabulary: set[bytes]) -> tuple[int, float, dict[bytes, int]]:
    """Documents, mean length in words, and the documents of each wanted term; a row per term and task is exchanged."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        rows = words = 0
        for frame in batches:
            for text in frame["text"]:
                parts = terms_of(text)
                rows, words = rows + 1, words + len(parts)
                for term in vocabulary.intersection(parts):
                    seen[term] = seen.get(term, 0) + 1
        yield pd.DataFrame({"term": [None, *seen], "n": [rows, *seen.values()], "words": [words, *[0] * len(seen)]})

    sums = documents.select("text").mapInPandas(count, "term binary, n long, words long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()
    total = next((r for r in sums if r["term"] is None), None)
    rows, words = (total["n"], total["words"]) if total else (0, 0)
    return rows, words / rows if rows and words else 1.0, {bytes(r["term"]): r["n"] for r in sums if r["term"] is not None}


class Shard:
    """The postings of some documents for the wanted terms, with block maxima; its size follows its postings."""

    def __init__(self, found: list[np.ndarray], lengths: list[int], idf: np.ndarray, mean: float):
        self.size = len(found)
        self.blocks = -(-self.size // BLOCK_DOCS)
        docs, terms, counts = [], [], []
        for number, places in enumerate(found):
            if len(places):
                term, count = np.unique(np.asarray(places, np.int32), return_counts=True)
                docs.append(np.full(len(term), number, np.int32))
                terms.append(term)
                counts.append(count)
        none = np.empty(0, np.int32)
        doc, term, count = (np.concatenate(x) if x else none for x in (docs, terms, counts))
        self.terms, place = np.unique(term, return_inverse=True)
        key = (doc // BLOCK_DOCS).astype(np.int64) * len(self.terms) + place
        order = np.argsort(key, kind="stable")
        key, self.doc, term, count = key[order], doc[order], term[order], count[order].astype(float)
        length = np.array(lengths, float)[self.doc]
        self.weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean))
        self.start = np.searchsorted(key, np.arange(self.blocks * len(self.terms) + 1))
        self.maxima = np.zeros((len(self.terms), self.blocks))
        np.maximum.at(self.maxima, (place[order], self.doc // BLOCK_DOCS), self.weight)

    def _scores(self, blocks: np.ndarray, at: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Scores of the documents of some blocks, all terms at once."""
        keys = (blocks[:, None] * len(self.terms) + at[None, :]).ravel()
        low, count = self.start[keys], self.start[keys + 1] - self.start[keys]
        posting = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        weight = np.repeat(np.tile(times, len(blocks)), count) * self.weight[posting]
        return np.bincount(self.doc[posting], weight, minlength=self.size)

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and scores of every document that may be among the k best and reaches ``least``."""
        at = np.searchsorted(self.terms, terms)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == terms[here]
        at, times = at[here], times[here]
        bound = times @ self.maxima[at]
        order = np.argsort(-bound, kind="stable")
        scores = np.zeros(self.size)
        done, step = 0, 2
        while done < len(order):
            # Bounds and scores are summed in different orders; half a unit of the last kept decimal covers that.
            live = order[done : done + step]
            live = live[(bound[live] > 0) & (bound[live] >= least - 10.0**-DECIMALS)]
            if not len(live):
                break
            scores += self._scores(live, at, times)
            done, step = done + len(live), step * 4
            above = scores[scores > 0]
            if len(above) >= k:
                least = max(least, np.partition(above, -k)[-k])
        found = np.flatnonzero((scores > 0) & (scores >= least - 10.0**-DECIMALS))
        return found, scores[found]


def _leaders(documents: DataFrame, questions: list[tuple[int, list[bytes]]], statistics, k: int) -> DataFrame:
    rows, mean, frequency = statistics
    place = {term: i for i, term in enumerate(sorted(frequency))}
    idf = np.array([np.log(1 + (rows - frequency[t] + 0.5) / (frequency[t] + 0.5)) for t in sorted(frequency)])
    asked = []
    for number, words in questions:
        term, times = np.unique(np.array([place[w] for w in words if w in place], np.int64), return_counts=True)
        asked.append((number, term, times.astype(float)))
    shared = documents.sparkSession.sparkContext.broadcast((place, idf, asked))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, weights, wanted = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def shards() -> Iterator[tuple[list, list, list]]:
            ids, found, lengths = [], [], []
            for frame in batches:
                for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"], strict=True):
                    words = terms_of(text)
                    ids.append(doc_id)
                    found.append(np.array([terms[w] for w in words if w in terms], np.int32))
                    lengths.append(len(words))
                    if len(ids) == SHARD_DOCS:
                        yield ids, found, lengths
                        ids, found, lengths = [], [], []
            if ids:
                yield ids, found, lengths

        for ids, places, lengths in shards():
            shard, own = Shard(places, lengths, weights, mean), np.array(ids, np.int64)
            for number, term, times in wanted:
                kept_ids, kept = best.get(number, (np.empty(0, np.int64), np.empty(0)))
                least = kept[-1] if len(kept) >= k else 0.0
                found, scores = shard.best(term, times, k, least)
                if len(found):
                    all_ids = np.concatenate([kept_ids, own[found]])
                    all_scores = np.concatenate([kept, np.round(scores, DECIMALS)])
                    order = np.lexsort((all_ids, -all_scores))[:k]
                    best[number] = all_ids[order], all_scores[order]
        for number, (ids, scores) in best.items():
            yield pd.DataFrame({"query_id": number, "doc_id": ids, "score": scores})

    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(search, FOUND)


def top_documents(questions: DataFrame, documents: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each question: query_id, rank (from 1), doc_id, score.

    ``questions`` has query_id and text, ``documents`` doc_id and text. Words
    that repeat in a question count as often; documents without any of its
    words are not found; equal scores (to six decimals) go to the smaller id.
    Rows without id take no part, null texts are empty, repeated rows are
    found each, other columns are not read, and empty tables find nothing.
    Questions of any length are kept as a saved table and answered in blocks
    of ``QUESTION_BLOCK``, each in one pass over all documents.
    """
    spark = documents.sparkSession
    small_batches(spark)
    corpus = documents.filter("doc_id is not null").select("doc_id", "text")
    asked = questions.filter("query_id is not null").select("query_id", "text")
    placed = numbered(asked, [F.col("query_id"), F.col("text")], "_at").withColumn("_block", F.floor(F.col("_at") / QUESTION_BLOCK))
    placed = save(placed.select("query_id", "text", "_block"), "questions")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

    last = placed.agg(F.max("_block")).first()[0]
    parts = []
    for number in range(0 if last is None else last + 1):
        rows = placed.filter(F.col("_block") == number).select("query_id", "text").collect()
        block = [(row["query_id"], terms_of(row["text"])) for row in rows]
        statistics = _statistics(corpus, {w for _, words in block for w in words})
        parts.append(_leaders(corpus, block, statistics, k))
        if last:  # more blocks: only the leaders of each stay, and its questions leave the driver
            parts[-1] = save(ranked(parts[-1]).select("query_id", "doc_id", "score"), "leaders")
    found = spark.createDataFrame([], FOUND)
    for part in parts:
        found = found.unionByName(part)
    return ranked(found)
