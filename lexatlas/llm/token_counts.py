"""Token counts: texts are encoded in Arrow batches and only lengths come back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.llm.common import small_batches
from lexatlas.llm.tokens import loaded


def token_length(text: Column, tokenizer: str) -> Column:
    """Tokens of a whole text, without added special tokens; null counts as empty.

    Batches reach the library balanced by bytes, long texts cut at places
    where no token can cross (see ``tokens``).
    """

    @F.pandas_udf("long")
    def length(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = loaded(tokenizer)
        for texts in batches:
            yield pd.Series([len(ids) // 4 for ids in encoder.encode(texts.tolist())], dtype="int64")

    return length(F.coalesce(text, F.lit("")))


def count_tokens(documents: DataFrame, tokenizer: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    One pass over the text with no shuffle. A null text counts as empty, a
    null id stays null, repeated rows are counted each, an empty table gives
    an empty table, and other columns are not read.
    """
    small_batches(documents.sparkSession)
    counted = documents.select(
        F.col(id_column),
        F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes"),
        token_length(F.col(text_column), tokenizer).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
