"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its words (ASCII lower case, outer punctuation removed)
and their beginnings of four and five characters, hashed. From a bounded
sample of labelled rows all terms that go with either label are chosen, and a
factorization machine learns a weight for each and, through its factors, for
each pair: such as an insult beside the mention of a group. Scoring reads
whole texts and never sees labels, language, source or id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.llm.common import let_go, save, small_batches

#: Bits of the term hash, and labelled rows the model learns from at most.
HASH_BITS, SAMPLE_ROWS = 24, 20_000
FACTORS = 4
#: Rows of the sample that a term needs, and the log-likelihood ratio that tells it from chance.
LEAST_ROWS, LEAST_RATIO = 3, 5.0
#: Training of the machine.
TRAINING = {"maxIter": 100, "stepSize": 0.1, "regParam": 1e-3, "initStd": 0.01}
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words a worker remembers the terms of, and terms it counts before it hands the counts on.
REMEMBERED, COUNTED = 150_000, 50_000


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning; a missing id is."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def word_terms(word: bytes) -> tuple[int, ...]:
    """Hashed terms of one lower-case word."""
    import xxhash

    text = word.decode("utf-8", "replace").strip(EDGES)
    if not text:
        return ()
    parts = {"w " + text, "4 " + text[:4], "5 " + text[:5]}
    return tuple(xxhash.xxh32_intdigest(p.encode("utf-8", "replace"), 7) & ((1 << HASH_BITS) - 1) for p in parts)


class Terms:
    """Terms of texts, of the wanted ones only where these are given."""

    def __init__(self, wanted: dict[int, int] | None = None):
        self.wanted = wanted
        self.known: dict[bytes, tuple[int, ...]] = {}

    def of(self, text: str | None) -> set[int]:
        words = set((text or "").encode("utf-8", "surrogatepass").lower().split())
        known, found = self.known, set()
        new = words.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = words
        for word in new:
            terms = word_terms(word)
            known[word] = terms if self.wanted is None else tuple(self.wanted[t] for t in terms if t in self.wanted)
        for terms in map(known.__getitem__, words):
            if terms:
                found.update(terms)
        return found


@dataclass(frozen=True)
class Model:
    """A fitted machine; it grows with the terms of the sample and ``FACTORS``."""

    terms: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, found: set[int]) -> float:
        at = sorted(found)
        rows = self.factors[at]
        pairs = 0.5 * float(((rows.sum(axis=0)) ** 2 - (rows**2).sum(axis=0)).sum()) if at else 0.0
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at].sum() + pairs, -60, 60))))


def labelled(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``sample_rows`` texts with labels that may be learnt from; a row with any toxic label is toxic."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def choose_terms(rows: DataFrame) -> dict[int, int]:
    """All terms whose presence tells more about the label than chance, as (hash, place in the model)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        terms, held = Terms(), {0: Counter(), 1: Counter()}

        def told() -> pd.DataFrame:
            rows = [(term, n if not toxic else 0, n if toxic else 0) for toxic, counts in held.items() for term, n in counts.items()]
            for counts in held.values():
                counts.clear()
            return pd.DataFrame(rows, columns=["term", "clean", "toxic"])

        for frame in batches:
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                held[int(toxic)].update(terms.of(text))
                if len(held[0]) + len(held[1]) > COUNTED:
                    yield told()
        yield told()

    sums = rows.groupBy("toxic").count().collect()
    clean, toxic = (sum(r["count"] for r in sums if r["toxic"] == k) for k in (0, 1))
    found = rows.select("text", "toxic").mapInPandas(count, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    present = found.filter(F.col("a") + F.col("b") >= LEAST_ROWS)
    # Log-likelihood ratio of presence and label.
    def part(seen: Column, of: int) -> Column:
        share = (F.col("a") + F.col("b")) / F.lit(max(1, clean + toxic))
        rest = F.lit(of) - seen
        return F.when(seen > 0, seen * F.log(seen / (share * F.lit(max(1, of))))).otherwise(0.0) + F.when(rest > 0, rest * F.log(rest / ((1 - share) * F.lit(max(1, of))))).otherwise(0.0)

    best = present.withColumn("tells", part(F.col("a"), clean) + part(F.col("b"), toxic)).filter(F.col("tells") >= LEAST_RATIO).orderBy(F.col("tells").desc(), "term")
    return {r["term"]: i for i, r in enumerate(best.select("term").collect())}


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> Model:
    """Learn from at most ``sample_rows`` labelled rows outside the held-out fifth.

    Without two different labels the model scores every text by their share.
    """
    small_batches(documents.sparkSession)
    rows = save(labelled(documents, labels, sample_rows), "labelled")
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        return Model({}, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    terms = choose_terms(rows)
    if not terms:
        share = counts[1] / sum(counts.values())
        return Model({}, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))

    @F.pandas_udf("array<int>")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        let_go()
        finder = Terms(terms)
        for texts in batches:
            yield pd.Series([sorted(finder.of(text)) for text in texts])

    size = len(terms)
    sparse = F.udf(lambda at: Vectors.sparse(size, at, [1.0] * len(at)), VectorUDT())
    learn = save(rows.select(F.col("toxic").cast("double").alias("label"), places("text").alias("places")), "features")
    vectors = learn.coalesce(12).select("label", sparse("places").alias("features")).persist()
    machine = FMClassifier(factorSize=FACTORS, seed=seed, solver="adamW", **TRAINING).fit(vectors)
    vectors.unpersist()
    return Model(terms, float(machine.intercept), machine.linear.toArray(), machine.factors.toArray())


def score(documents: DataFrame, model: Model, text_column: str = "text") -> Column:
    """Score of a whole text between 0 and 1; a null or empty text gets the model's base score."""
    plain = (model.terms, model.bias, model.weights, model.factors)  # the class itself travels with the function
    shared = documents.sparkSession.sparkContext.broadcast(plain)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        let_go()
        machine = Model(*shared.value)
        finder = Terms(machine.terms)
        for texts in batches:
            yield pd.Series([machine.score(finder.of(text)) for text in texts], dtype="float64")

    small_batches(documents.sparkSession)
    return scored(F.coalesce(text_column, F.lit("")))


def score_documents(documents: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (1 from a score of 0.5).

    Null texts are empty, rows that repeat an id are scored each, null labels
    and labels without id teach nothing, empty tables give an empty result,
    and no other columns are read.
    """
    model = fit(documents, labels, **settings)
    scored = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(documents, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(documents: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows and columns of ``documents`` whose texts are not predicted toxic."""
    model = fit(documents, labels, **settings)
    kept = documents.select(F.struct("*").alias("row"), score(documents, model).alias("score"))
    return kept.filter("score < 0.5").select("row.*")
