import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexatlas.operators import bm25, folds, metrics, ranking, vectors


def test_bm25_against_brute_force(spark):
    docs = {1: "the red cat sat", 2: "the cat", 3: "a dog", 4: "", 5: "red red cat cat the dog"}
    asked = {1: "red cat", 2: "The dog sat"}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    q = spark.createDataFrame(list(asked.items()), "qid long, question string")

    def grams(text):
        words = text.lower().split()
        return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    mean = sum(max(1, len(t.split())) for t in docs.values()) / len(docs)
    vocab = {g for t in asked.values() for g in grams(t)}
    counts = {k: Counter(g for g in grams(t) if g in vocab) for k, t in docs.items()}
    df = Counter(g for c in counts.values() for g in c)
    expected = {}
    for qid, text in asked.items():
        for doc, c in counts.items():
            norm = 0.7 * (0.7 + 0.3 * max(1, len(docs[doc].split())) / mean)
            s = sum(c[g] * 1.7 / (c[g] + norm) * math.log1p((5 - df[g] + 0.5) / (df[g] + 0.5)) * len(g.split()) for g in set(grams(text)) if g in c)
            if s > 0:
                expected[qid, doc] = round(s, 6)
    for broadcast in (True, False):
        got = {(r.qid, r.doc_id): r.score for r in _scores(q, d, broadcast).collect()}
        assert got == pytest.approx(expected, abs=2e-6)


def _scores(q, d, broadcast, monkey=None):
    original = bm25.fits_broadcast
    bm25.fits_broadcast = lambda *a, **k: broadcast
    try:
        return bm25.scores(q, d)
    finally:
        bm25.fits_broadcast = original


def test_knn_paths_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    data = rng.integers(-2, 3, (60, 4)).astype("float32")  # many ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    v = spark.createDataFrame(rows, "vec_id long, v array<float>")
    q = v.where("vec_id < 9").select(F.col("vec_id").alias("qid"), "v")
    scores = data[:9].astype(float) @ data.T.astype(float)
    expected = {(i, int(j), r + 1) for i in range(9) for r, j in enumerate(sorted(range(60), key=lambda j: (-scores[i, j], j))[:5])}
    for options in ({}, {"query_bytes": 0, "fragment": 4}):
        got = {(r.qid, r.vec_id, r.rank) for r in vectors.nearest(q, v, 5, **options).collect()}
        assert got == expected


def test_upsert_and_unit(spark):
    old = spark.createDataFrame([(1, 10.0), (2, 20.0)], "k long, x double")
    new = spark.createDataFrame([(2, 21.0, 1), (2, 22.0, 2), (3, 30.0, 1)], "k long, x double, seq long")
    assert {(r.k, r.x) for r in vectors.upsert(old, new, "k", "seq").collect()} == {(1, 10.0), (2, 22.0), (3, 30.0)}
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<float>")
    with pytest.raises(Exception, match="non-zero"):
        zero.select(vectors.unit(F.col("v"))).collect()


def ranks(spark, rows):
    return spark.createDataFrame(rows, "qid long, doc_id string, rank long")


def test_rrf_and_zero_weight(spark):
    a = ranks(spark, [(1, "x", 1), (1, "y", 2)])
    b = ranks(spark, [(1, "y", 1), (1, "z", 2)])
    got = [r.doc_id for r in ranking.weighted_rrf([a, b], [1, 1]).orderBy("rank").collect()]
    assert got == ["y", "x", "z"]
    assert [r.doc_id for r in ranking.weighted_rrf([a, b], [0, 1]).orderBy("rank").collect()] == ["y", "z"]


def test_aggregation_methods(spark):
    hits = spark.createDataFrame([(1, "d", "c1", 1, 0.9), (1, "d", "c2", 3, 0.5), (1, "e", "c3", 2, 0.7)], "qid long, doc_id string, chunk_id string, rank long, score double")
    got = {r.method: r.score for r in ranking.aggregate_documents(hits).where("doc_id = 'd'").collect()}
    assert got["max_plus_0.10_second"] == pytest.approx(0.95)
    assert got["top2_mean"] == pytest.approx(0.7)
    assert got["rrf_cap2"] == pytest.approx(1 / 61 + 1 / 63, abs=1e-9)
    assert got["first_occurrence"] == -1


def test_rerank_keeps_ties_and_tail(spark):
    hits = spark.createDataFrame([(1, f"d{i}", i, s) for i, s in ((1, 0.1), (2, 0.5), (3, 0.5), (4, 9.0))], "qid long, doc_id string, rank long, rerank_score double")
    got = [r.doc_id for r in ranking.rerank(hits, 3).orderBy("rank").collect()]
    assert got == ["d2", "d3", "d1", "d4"]


def test_reorder_edges(spark):
    rows = spark.createDataFrame([(1, i) for i in range(1, 6)], "qid long, rank long")
    assert [r.rank for r in ranking.reorder_edges(rows).orderBy("slot").collect()] == [1, 3, 5, 4, 2]


def test_metrics(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "qid long, doc_id string")
    pred = ranks(spark, [(1, "x", 1), (1, "a", 2), (1, "d", 3), *[(2, c, i) for i, c in enumerate("abcdef", 1)]])
    rows = {r.qid: r for r in metrics.per_query(gold, pred).collect()}
    assert (rows[1].recall, rows[1].precision, rows[1].reciprocal_rank) == (0.5, pytest.approx(1 / 3), 0.5)
    assert (rows[2].recall, rows[2].precision) == (0, 0)  # six documents


def test_latency(spark):
    row = metrics.latency_summary(spark.createDataFrame([(1.0,), (2.0,), (10.0,), (-1.0,)], "v double"), "v").first()
    assert (row["count"], row.median_ms, row.p95_ms) == (3, 2.0, 9.2)


def test_folds_isolate_groups(spark):
    asked = spark.createDataFrame([(i, f"Question {i // 2}{'!' * (i % 2)}") for i in range(40)], "qid long, question string")
    grouped = folds.with_group(asked)
    for assigned in (folds.hashed_folds(grouped), folds.balanced_folds(grouped)):
        assert folds.fold_violations(assigned, asked).count() == 0
    sizes = [r["count"] for r in folds.balanced_folds(grouped).groupBy("fold").count().collect()]
    assert sizes == [8] * 5


def test_bootstrap_block_invariance(spark):
    deltas = spark.createDataFrame([(f"g{i}", float(i % 3) - 0.8, 1 + i % 2) for i in range(150)], "group_key string, delta double, n long")
    one = folds.bootstrap_draws(deltas, 400).agg(F.avg("mean_delta"), F.stddev("mean_delta")).first()
    many = folds.bootstrap_draws(deltas, 400, block_rows=20).agg(F.avg("mean_delta"), F.stddev("mean_delta")).first()
    assert abs(one[0] - many[0]) < 0.02 and abs(one[1] - many[1]) < 0.015
