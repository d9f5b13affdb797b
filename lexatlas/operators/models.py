"""Model-backed operators with injected functions.

A model is a plain function over batches: ``embed(texts) -> vectors``,
``score(questions, texts) -> floats`` or ``generate(prompts) -> texts``.  It is
built by a factory inside each Python worker, once per task.  The defaults need
no model; their results say nothing about model quality.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexatlas.functions import text as tx
from lexatlas.operators import vectors
from lexatlas.operators.answers import finish_answer
from lexatlas.operators.chunking import token_windows

Embed = Callable[[Sequence[str]], np.ndarray]
Score = Callable[[Sequence[str], Sequence[str]], Sequence[float]]
Generate = Callable[[Sequence[str]], Sequence[str]]


def embed_texts(
    rows: DataFrame,
    key: str,
    text: str,
    factory: Callable[[], Embed] | None = None,
    max_words: int | None = None,
    overlap: int = 0,
    dimension: int = 64,
) -> DataFrame:
    """Unit vectors (key, v) of texts (ML-01).

    With ``max_words`` longer texts are embedded in windows and mean-pooled.
    """
    source = rows.select(key, F.explode_outer(token_windows(F.col(text), max_words, overlap)).alias("t")).where("t is not null") if max_words else rows.select(key, F.col(text).alias("t"))
    build = factory or (lambda: hashing_encoder(dimension))

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build()
        for batch in batches:
            yield pd.Series(list(np.asarray(model(list(batch)), dtype=np.float32)))

    embedded = source.select(key, encode("t").alias("v"))
    if factory is None:  # a text without words has no direction
        embedded = embedded.where(F.exists("v", lambda x: x != 0))
    if max_words:
        return vectors.pooled(embedded, key, "v").select(key, F.transform("v", lambda x: x.cast("float")).alias("v"))
    return embedded.select(key, vectors.unit(F.col("v")).alias("v"))


def hashing_encoder(dimension: int) -> Embed:
    """Stand-in encoder: signed hashed word counts, no claim about quality."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        rows = np.zeros((len(texts), dimension), dtype=np.float32)
        for row, text in zip(rows, texts, strict=True):
            codes = np.fromiter((zlib.crc32(w.encode()) for w in re.findall(r"\w+", text.lower())), dtype=np.int64)
            np.add.at(row, codes % dimension, np.where(codes & (1 << 30), 1.0, -1.0))
        return rows

    return encode


def lexical_overlap(question: Column, text: Column) -> Column:
    """Share of question words found in the text; the default pair scorer."""
    return word_overlap(tx.word_tokens(question), tx.word_tokens(text))


def word_overlap(asked: Column, found: Column) -> Column:
    """:func:`lexical_overlap` of texts that are tokenised already."""
    return F.size(F.array_intersect(asked, found)) / F.greatest(F.size(F.array_distinct(asked)), F.lit(1))


def score_pairs(pairs: DataFrame, question: str, text: str, factory: Callable[[], Score] | None = None) -> DataFrame:
    """Adds ``rerank_score`` to (question, text) pairs (ML-02, M-12)."""
    if factory is None:
        return pairs.withColumn("rerank_score", F.round(lexical_overlap(F.col(question), F.col(text)), 6))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for questions, texts in batches:
            values = np.asarray(model(list(questions), list(texts)), dtype=np.float64)
            if values.shape != (len(questions),) or not np.isfinite(values).all():
                raise ValueError("a scorer must return one finite score per pair")
            yield pd.Series(values)

    return pairs.withColumn("rerank_score", score(question, text))


def generate_answers(prompts: DataFrame, prompt: str, factory: Callable[[], Generate] | None = None, fallback: str = "context_block") -> DataFrame:
    """Raw and finished answers (ML-03); without a model the context is the answer."""
    if factory is None:
        raw = F.col(fallback)
    else:

        @F.pandas_udf("string")
        def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = factory()
            for batch in batches:
                yield pd.Series(list(model(list(batch))))

        raw = generate(prompt)
    return prompts.withColumn("raw_answer", raw).withColumn("answer", finish_answer(F.col("raw_answer")))


def batched_calls(
    rows: DataFrame, inputs: Sequence[str], factory: Callable[[], Callable[..., Sequence]], result: str, output: str, batch_size: int = 64, retries: int = 2
) -> DataFrame:
    """Model outputs in batches of bounded size, with an error per row instead of a failed job (ML-02, ML-03).

    ``factory`` loads the model once per Python worker; the model takes one
    sequence per input column and returns as many values. A batch that raises,
    returns another number of values or non-finite ones is called again up to
    ``retries`` times, then row by row, so that one bad row costs no other.
    Adds ``output`` (null for a failed row), ``error`` (null for a good one)
    and ``calls`` (how often the model was called with the row).
    """
    if not 1 <= len(inputs) <= 3:
        raise ValueError("one to three input columns")
    textual = result == "string"
    columns = list(inputs)

    def load():
        model = factory()

        def called(*parts: Sequence) -> list:
            values = list(model(*parts))
            if len(values) != len(parts[0]):
                raise ValueError(f"{len(values)} values for {len(parts[0])} rows")
            if not textual and not np.isfinite(np.asarray(values, dtype=np.float64)).all():
                raise ValueError("a value is not finite")
            return values

        def attempt(*parts: Sequence) -> tuple[list, list, list]:
            calls = 0
            for _ in range(1 + retries):
                calls += 1
                try:
                    return called(*parts), [None] * len(parts[0]), [calls] * len(parts[0])
                except Exception as failure:  # noqa: BLE001 - any fault of a model is a row's error
                    last = f"{type(failure).__name__}: {failure}"
            if len(parts[0]) == 1:
                return [None], [last], [calls]
            outs, errors, counts = [], [], []
            for one in zip(*parts, strict=True):
                o, e, c = attempt(*[[x] for x in one])
                outs += o
                errors += e
                counts += [calls + n for n in c]
            return outs, errors, counts

        def predict(*arrays: np.ndarray) -> dict[str, np.ndarray]:
            values, errors, calls = attempt(*[a.tolist() for a in arrays])
            missing = "" if textual else float("nan")
            return {
                "value": np.array([missing if v is None else v for v in values], dtype=object if textual else np.float64),
                "error": np.array(["" if e is None else e for e in errors], dtype=object),
                "calls": np.array(calls, dtype=np.int32),
            }

        shapes = {1: lambda a: predict(a), 2: lambda a, b: predict(a, b), 3: lambda a, b, c: predict(a, b, c)}  # the caller counts arguments
        return shapes[len(columns)]

    kinds = T.StructType([T.StructField("value", T.StringType() if textual else T.DoubleType()), T.StructField("error", T.StringType()), T.StructField("calls", T.IntegerType())])
    udf = predict_batch_udf(load, return_type=kinds, batch_size=batch_size)
    told = rows.withColumn("_told", udf(*[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    failed = F.col("_told.error") != ""
    return told.select(
        *[F.col(c) for c in rows.columns], F.when(~failed, F.col("_told.value")).alias(output), F.when(failed, F.col("_told.error")).alias("error"), F.col("_told.calls").alias("calls")
    )
