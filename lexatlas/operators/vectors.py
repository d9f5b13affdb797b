"""Exact vector search and the vector table.

Search is blocked matrix multiplication inside Arrow batches.  A question set
of checked size is broadcast and the vector table is only streamed past it.
Larger question sets are laid out on a grid of (vector fragment, question
fragment) cells, each small enough for one task.  Either way a task keeps its
own k best per question, which cannot lose a global winner.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexatlas.operators.joins import spread

#: Largest question matrix (bytes) that is shipped to every executor.
QUERY_BYTES = 32 << 20
#: Rows of a cell's question fragment, and how many times as many vectors meet them there.
FRAGMENT_ROWS, VECTOR_SHARE = 16_384, 4
#: Fragments of a side that smaller fragments may add up to; every row is copied once per fragment of the other side.
GRID_SIDE = 8


def norm(vector: Column) -> Column:
    return F.sqrt(inner_product(vector, vector))


def inner_product(left: Column, right: Column) -> Column:
    """Double-precision dot product of two arrays (NUM-02)."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def is_valid(vector: Column, dimension: int | None = None) -> Column:
    """Finite, non-zero and of the expected size (M-28)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = finite & (F.size(vector) > 0) & (norm(vector) > 0)
    return good if dimension is None else good & (F.size(vector) == dimension)


def unit(vector: Column, dimension: int | None = None) -> Column:
    """L2-normalised vector, optionally cut to its first components (NUM-01).

    Rows that cannot be normalised raise, as a zero or non-finite vector would
    silently rank everywhere.
    """
    cut = vector if dimension is None else F.slice(vector, 1, dimension)
    length = norm(cut)
    scaled = F.transform(cut, lambda x: (x.cast("double") / length).cast("float"))
    return F.when(is_valid(cut), scaled).otherwise(
        F.raise_error(F.lit("vector must be finite and non-zero")).cast("array<float>")
    )


def pooled(windows: DataFrame, key: str, vector: str) -> DataFrame:
    """Renormalised mean of the vectors that share a key (A-22).

    One running mean per key and task is combined before the shuffle, so a key
    with a third of all vectors costs a row per task.
    """
    mean = windows.groupBy(key).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).alias("m"))
    length = norm(F.col("m"))
    return mean.select(key, F.transform("m", lambda x: x / length).alias(vector))


def matching(payload: Mapping[str, object], columns: Iterable[str], metadata: str | None = None) -> Column:
    """Conjunctive payload filter: equality or membership per key (F-01)."""
    present = set(columns)
    condition: Column = F.lit(True)
    for name, wanted in payload.items():
        stored = F.col(name) if name in present else F.col(metadata)[name] if metadata else F.lit(None)
        options = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        condition = condition & F.coalesce(stored.isin(options), F.lit(False))
    return condition


def _matrix(values: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    data = np.asarray(flat.flatten(), dtype=np.float64)
    return data.reshape(rows, -1) if rows else data.reshape(0, 0)


#: Bytes of scores a task holds at once; bounds memory, never the result.
SCORE_BYTES = 32 << 20


def _leaders(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k best as (ids, scores), by (-score, id); ``ids`` is one row or one per row, unordered."""
    keep = min(k, scores.shape[1])
    ids = np.broadcast_to(ids, scores.shape)
    if keep < scores.shape[1]:
        least = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1 : keep]
        above, level = scores > least, scores == least
        wanted = keep - above.sum(axis=1)
        for row in np.flatnonzero(level.sum(axis=1) > wanted):  # ties at the last place go to the smaller ids
            at = np.flatnonzero(level[row])
            level[row, at[np.argsort(ids[row, at], kind="stable")[wanted[row] :]]] = False
        chosen = np.nonzero(above | level)[1].reshape(len(scores), keep)
        scores, ids = np.take_along_axis(scores, chosen, 1), np.take_along_axis(ids, chosen, 1)
    order = np.lexsort((ids, -scores), axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


#: Parts of a block whose largest scores bound the k-th best of the whole, for each of the k; more than rounding can move a score.
PARTS, ROUNDING = 8, 2e-6


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_leaders` of the rounded scores.

    The k-th largest of the parts' maxima is no larger than the k-th best
    score, so only scores from there on, few of them, are rounded and ordered.
    """
    parts = PARTS * k
    width = scores.shape[1] // parts
    if width >= 4:
        inner = scores[:, : parts * width]
        peaks = inner.reshape(len(scores), parts, width).max(axis=2)
        bound = np.partition(peaks, parts - k, axis=1)[:, parts - k] - ROUNDING
        near = scores >= bound[:, None]
        counts = np.count_nonzero(near, axis=1)
        if not np.isnan(peaks).any() and not np.isnan(scores[:, parts * width :]).any():
            rows, columns = np.nonzero(near)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            kept = np.full((len(scores), counts.max()), -np.inf)
            kept_ids = np.full(kept.shape, np.iinfo(np.int64).max)
            kept[rows, at], kept_ids[rows, at] = np.round(scores[rows, columns], 6) + 0.0, ids[columns]
            return _leaders(kept, kept_ids, k)
    return _leaders(np.round(scores, 6) + 0.0, ids, k)


def _blocks(questions: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each question's k best of this block; scores are held for a bounded number of questions at a time."""
    step = max(1, SCORE_BYTES // (8 * len(ids)))
    parts = [_best(questions[at : at + step] @ block.T, ids, k) for at in range(0, len(questions), step)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _rows(qids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.repeat(qids, ids.shape[1]), pa.int64()), pa.array(ids.ravel(), pa.int64()), pa.array(scores.ravel(), pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=["qid", "vec_id", "score"])


_RESULT = "qid long, vec_id long, score double"


def _stream_search(vectors: DataFrame, question_ids: np.ndarray, questions: np.ndarray, k: int) -> DataFrame:
    """At most k rows per question and task: the running best is kept over a task's batches."""
    shared = vectors.sparkSession.sparkContext.broadcast((question_ids, questions))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix = shared.value
        best: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            if batch.num_rows and len(qids):
                found = _blocks(matrix, _matrix(batch.column(1), batch.num_rows), np.asarray(batch.column(0), dtype=np.int64), k)
                best = found if best is None else _leaders(np.hstack([best[1], found[1]]), np.hstack([best[0], found[0]]), k)
        if best is not None:
            yield _rows(qids, *best)

    return vectors.mapInArrow(search, _RESULT)


def _grid_search(vectors: DataFrame, questions: DataFrame, k: int, rows: int, asked: int, fragment: int) -> DataFrame:
    # Few fragments of vectors: each of them hands on k rows per question.
    down, across = max(1, math.ceil(rows / (VECTOR_SHARE * fragment))), max(1, math.ceil(asked / fragment))
    left = vectors.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(down)).alias("r"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("c"),
        "vec_id",
        "v",
    )
    right = questions.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("r"),
        F.pmod(F.xxhash64("qid"), F.lit(across)).alias("c"),
        "qid",
        "v",
    )

    def cell(vec: pa.Table, ask: pa.Table) -> pa.Table:
        if not vec.num_rows or not ask.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = np.asarray(vec["vec_id"], dtype=np.int64)
        qids = np.asarray(ask["qid"], dtype=np.int64)
        block, matrix = _matrix(vec["v"], vec.num_rows), _matrix(ask["v"], ask.num_rows)
        return pa.Table.from_batches([_rows(qids, *_blocks(matrix, block, ids, k))])

    return left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(cell, _RESULT)


def nearest(
    questions: DataFrame,
    vectors: DataFrame,
    k: int,
    query_bytes: int = QUERY_BYTES,
    fragment: int = FRAGMENT_ROWS,
) -> DataFrame:
    """Exact top-k by inner product (J-06, TK-01).

    ``questions(qid, v)`` and ``vectors(vec_id, v)`` hold integer ids and float
    arrays of one dimension.  Filters belong on ``vectors`` before the call, so
    they reach the scan.  Ties are resolved by the smaller ``vec_id``.

    ``fragment`` is the size of a cell's question side on small tables. Cells grow with
    the tables up to ``FRAGMENT_ROWS``, as each row travels to every cell of
    its row or column; all pairs are compared at any size.
    """
    asked = questions.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    count, dimension = asked["n"], asked["d"] or 0
    vectors = spread(vectors)
    if count * dimension * 8 <= query_bytes:
        table = questions.select(F.col("qid").cast("long"), "v").toArrow()
        matrix = _matrix(table["v"], table.num_rows)
        partial = _stream_search(
            vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v"),
            np.asarray(table["qid"], dtype=np.int64),
            matrix,
            k,
        )
    else:
        rows = vectors.count()
        partial = _grid_search(
            vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v"),
            questions.select(F.col("qid").cast("long").alias("qid"), "v"),
            k,
            rows,
            count,
            max(fragment, min(FRAGMENT_ROWS, math.ceil(max(rows, count) / GRID_SIDE))),
        )
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("vec_id"))
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, sequence: str) -> DataFrame:
    """Last write per key wins (SNK-09); ``sequence`` orders the incoming rows.

    A struct maximum combines map-side, so a key rewritten a billion times is
    not collected anywhere.
    """
    fields = [c for c in existing.columns if c != key]
    old = existing.select(key, F.lit(None).cast(incoming.schema[sequence].dataType).alias("_seq"), F.struct(*fields).alias("_row"))
    new = incoming.select(key, F.col(sequence).alias("_seq"), F.struct(*fields).alias("_row"))
    # max_by ignores null orderings; an existing row is ordered before all new ones.
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = both.groupBy(key).agg(F.max_by("_row", F.struct("_new", "_seq")).alias("_row"))
    return latest.select(key, *[F.col("_row")[name].alias(name) for name in fields])


def delete(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key).distinct(), key, "left_anti")
