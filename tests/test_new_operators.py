"""Exact percentiles, set-similarity joins, splittable JSON, hash trees, split bootstrap, checked writes and payloads."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexatlas.operators import folds, hashtree, metrics, mining, models, payloads, quantiles, setjoin
from lexatlas.sources import checked, entries, records


def test_percentiles_equal_sorting(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 20)
    monkeypatch.setattr(quantiles, "ACCURACY", 200)
    picks = random.Random(1)
    wide = [picks.gauss(0, 1) * 10 ** picks.randint(-200, 200) for _ in range(900)]
    for values in (wide, [float(picks.randint(0, 3)) for _ in range(200)], [2.0, 1.0]):
        frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(2)
        shares = [0.0, 0.5, 0.99]
        got = quantiles.percentiles(frame, "v", shares)
        assert got == pytest.approx(np.percentile(values, [100 * s for s in shares]).tolist(), rel=1e-12)
    assert quantiles.percentiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def plain_pairs(left, right, threshold):
    out = {}
    for s, i, a in left:
        for t, j, b in right:
            both = len(set(a) & set(b))
            if s == t and both and both / len(set(a) | set(b)) >= threshold:
                out[s, i, j] = both
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_similar_sets_equal_all_pairs(spark, threshold):
    picks = random.Random(7)
    words = [f"w{i}" for i in range(40)]

    def side(count):
        base = [picks.sample(words, picks.randint(0, 12)) for _ in range(15)]
        rows = []
        for i in range(count):
            tokens = list(picks.choice(base))
            if tokens and picks.random() < 0.5:
                tokens[0] = picks.choice(words)
            rows.append((picks.choice("xy"), i, sorted(set(tokens), key=lambda _: picks.random())))
        return rows

    left, right = side(60), side(60)
    right += [("x", 100 + i, list(a)) for i, (_, _, a) in enumerate(left[:20])]
    as_frame = lambda rows, name: spark.createDataFrame(rows, f"scope string, {name} long, tokens array<string>")
    got = setjoin.similar_sets(as_frame(left, "a"), as_frame(right, "b"), threshold, ["scope"], "a", "b").collect()
    want = plain_pairs(left, right, threshold)
    assert {(r.scope, r.a, r.b): r.common for r in got} == want and len(got) == len(want) > 10


@pytest.mark.parametrize("buckets", [1, 3, 1 << 10])
def test_similar_sets_order_tokens_without_exchanging_them(spark, monkeypatch, buckets):
    monkeypatch.setattr(setjoin, "BUCKETS", buckets)
    picks = random.Random(5)
    rows = [("x", i, picks.sample([f"w{j}" for j in range(14)], picks.randint(1, 9))) for i in range(50)]
    left = spark.createDataFrame(rows, "scope string, a long, tokens array<string>")
    right = left.where("a % 3 = 0").withColumnRenamed("a", "b")
    found = setjoin.similar_sets(left, right, 0.6, ["scope"], "a", "b")
    assert "collect_list" not in found._jdf.queryExecution().analyzed().toString()
    got = found.collect()
    want = plain_pairs(rows, [r for r in rows if r[1] % 3 == 0], 0.6)
    assert {(r.scope, r.a, r.b): r.common for r in got} == want and len(got) == len(want) > 17


def test_both_ways_to_near_duplicates_agree(spark):
    picks = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    positives = [(q, picks.sample(words, 12)) for q in range(6)]
    candidates = []
    for q, tokens in positives:
        for d in range(12):
            other = list(tokens) + ["x"] * (d % 3 == 0)
            if d % 4 == 0:
                other[0] = "changed"
            candidates.append((q, d, "bm25", other if d % 2 else picks.sample(words, 12)))
    c = spark.createDataFrame(candidates, "qid long, doc_id long, source string, tokens array<string>")
    p = spark.createDataFrame(positives, "qid long, tokens array<string>")
    found = [Counter(tuple(r) for r in f(c, p, 0.85).collect()) for f in (mining.near_duplicates, mining.near_duplicates_indexed)]
    assert found[0] == found[1] and sum(found[0].values()) > 10


def awkward(picks, depth=0):
    kind = picks.randint(0, 6 if depth < 3 else 4)
    if kind == 5:
        return [awkward(picks, depth + 1) for _ in range(picks.randint(0, 3))]
    if kind == 6:
        return {f"k{i}" + picks.choice(["", "\\", '"', "{"]): awkward(picks, depth + 1) for i in range(picks.randint(0, 3))}
    return [None, picks.random(), picks.choice(['a"b', "\\", '\\\\"', "{[,]}", "é\n", "x" * 40, '\\"', ""]), True, {}][kind]


@pytest.mark.parametrize("size", [37, 200, 1 << 20])
def test_entries_of_any_ranges(spark, tmp_path, size):
    picks = random.Random(size)
    whole = {f"q{i}" + picks.choice(["", ",", '"', "\\", "}"]): awkward(picks) for i in range(25)}
    for name, value in (("map", whole), ("list", list(whole.values())), ("empty_map", {}), ("empty_list", [])):
        for indent in (None, 1):
            path = tmp_path / f"{name}{indent}.json"
            path.write_text(json.dumps(value, indent=indent, ensure_ascii=indent is None))
            rows = entries.read_entries(spark, str(path), size)
            got = sorted(rows.collect(), key=lambda r: r["at"])
            if isinstance(value, dict):
                assert [(r.key, json.loads(r.value)) for r in got] == list(value.items())
            else:
                assert [json.loads(r.value) for r in got] == value and all(r.key is None for r in got)
            if size == 37 and name in ("map", "list"):
                assert rows.rdd.getNumPartitions() > 3


def test_entries_refuse_damage(spark, tmp_path):
    for text in ('{"a": 1} x', '{"a": 1', "[1,,2]", "[1]]", "3"):
        path = tmp_path / "bad.json"
        path.write_text(text)
        with pytest.raises(Exception):
            entries.read_entries(spark, str(path), 4).collect()
    (tmp_path / "twice.json").write_text('{"a": 1, "b": 2, "a": 3}')
    with pytest.raises(Exception, match="repeated"):
        entries.unique_keys(entries.read_entries(spark, str(tmp_path / "twice.json"), 5)).collect()


def test_question_map_by_ranges_equals_the_whole_file(spark, tmp_path):
    whole = {f"q{i}": {"question": f"what {i}?", "answer": [str(i), str(i + 1)]} for i in range(50)}
    path = tmp_path / "train.json"
    path.write_text("﻿" + json.dumps(whole))
    plain = records.read_question_map(spark, str(path))
    cut = records.read_question_map_by_ranges(spark, str(path), range_bytes=300)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, plain.collect())) and len(whole) == cut.count()
    path.write_text('{"q1": {"question": "a", "answer": ["1"], "answer": ["2"]}}')
    with pytest.raises(Exception):
        records.read_question_map_by_ranges(spark, str(path)).collect()


def test_hash_tree_finds_changed_rows(spark):
    rows = [(i, f"text {i}") for i in range(900)] + [(5, "text 5"), (6, "another six"), (None, "no key"), (None, None)]
    make = lambda data, **more: hashtree.hash_tree(spark.createDataFrame(data, "id long, t string").repartition(more.pop("parts", 3)), "id", F.coalesce("t", F.lit("")), 10, **more)
    one, other = make(rows), make(rows[::-1], parts=7)
    assert one.depth == 2 and hashtree.root(one).first() == hashtree.root(other).first()
    assert hashtree.root(one).first()["record_count"] == len(rows)
    assert one.entries.groupBy(F.substring("place", 1, one.depth)).count().agg(F.max("count")).first()[0] < 25
    changed = [r for r in rows if r[0] != 17] + [(1000, "new"), (6, "another six")]
    got = {(r["change"], r["key"], r["copies"]) for r in hashtree.changed_entries(one, make(changed, depth=one.depth)).collect()}
    assert got == {("removed", "17", 1), ("added", "1000", 1), ("added", "6", 1)}
    assert hashtree.changed_entries(one, other).count() == 0
    assert hashtree.hash_tree(spark.createDataFrame([], "id long, t string"), "id", F.col("t")).nodes.count() == 0


def test_hash_tree_plans_grow_with_the_depth_only(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(300)], "id long, t string")
    make = lambda depth, frame: hashtree.hash_tree(frame, "id", F.col("t"), depth=depth)
    compare = lambda depth: hashtree.changed_entries(make(depth, rows), make(depth, rows.where("id <> 77")))
    lines = [compare(depth)._jdf.queryExecution().analyzed().toString().count("\n") for depth in (2, 4)]
    assert lines[1] < 4 * lines[0]
    assert [(r.change, r.key) for r in compare(3).collect()] == [("removed", "77")]


def test_fingerprint_follows_files_and_settings(spark, tmp_path):
    (tmp_path / "m" / "sub").mkdir(parents=True)
    (tmp_path / "m" / "a.bin").write_bytes(b"abc")
    (tmp_path / "m" / "sub" / "b.bin").write_bytes(b"de")
    folder = str(tmp_path / "m")
    inventory = {(r["path"], r["length"]) for r in hashtree.file_inventory(spark, folder).collect()}
    assert inventory == {("a.bin", 3), ("sub/b.bin", 2)}
    first = hashtree.artifact_fingerprint(spark, folder, {"dim": "64"})
    assert first == hashtree.artifact_fingerprint(spark, folder, {"dim": "64"}) != hashtree.artifact_fingerprint(spark, folder, {"dim": "32"})
    (tmp_path / "m" / "a.bin").write_bytes(b"abd")
    assert hashtree.artifact_fingerprint(spark, folder, {"dim": "64"}) != first


def test_split_picks_are_whole_and_fair():
    sizes = np.array([10, 1, 30, 7, 52])
    picks = np.stack([folds.block_picks(sizes, b, 4000, 3) for b in range(len(sizes))])
    assert (picks.sum(axis=0) == 100).all() and (picks >= 0).all()
    spread = 100 * (sizes / 100) * (1 - sizes / 100)
    assert np.allclose(picks.mean(axis=1), sizes, atol=5 * np.sqrt(spread / 4000).max())
    assert np.allclose(picks.var(axis=1), spread, rtol=0.15, atol=0.1)
    assert np.corrcoef(picks)[0, 4] < 0
    numbers = folds.pick_numbers(1, np.repeat(np.arange(200), 50), 2, np.tile(np.arange(50), 200)) % np.uint64(10)
    assert abs(np.bincount(numbers.astype(int), minlength=10) / 10_000 - 0.1).max() < 0.015


def test_checked_writes(spark, tmp_path):
    path = str(tmp_path / "index")
    chunks = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [0.0, 1.0], "y")], "chunk_id string, v array<double>, doc_id string")
    facts = checked.finish_index(chunks, path, 2, 2)
    assert facts["chunks"] == 2 and spark.read.parquet(path).count() == 2
    for bad, count in ((chunks, 3), (chunks.union(chunks.limit(1)), 2), (chunks.union(spark.createDataFrame([("c", [math.nan, 1.0], "z")], chunks.schema)), 3)):
        with pytest.raises(checked.RejectedWrite):
            checked.finish_index(bad, path, count, 2)
        assert spark.read.parquet(path).count() == 2  # the table in place stays
    assert [p.name for p in tmp_path.iterdir()] == ["index"]
    docs = spark.createDataFrame([(1, "one"), (2, None), (None, "x"), (3, " \n ")], "doc_id long, text string")
    assert checked.write_cleaned(docs, str(tmp_path / "clean"), 4) == {"documents": 4}
    got = {(r.doc_id, r.outcome, r.reason) for r in spark.read.parquet(str(tmp_path / "clean")).collect()}
    assert got == {(1, "cleaned", None), (2, "error", "missing text"), (None, "error", "missing id"), (3, "error", "nothing left after cleaning")}
    with pytest.raises(checked.RejectedWrite):
        checked.write_cleaned(docs, str(tmp_path / "clean"), 5)


def test_payloads_keep_unknown_fields(spark):
    hits = spark.createDataFrame([(1, '{"a":1,"x":null,"n":{"q":[1,"s"]},"t\\"":"v"}'), (2, None), (3, "[1]"), (4, '{"a":1,"a":2}')], "chunk_id long, payload string")
    stored = spark.createDataFrame([(1, '{"a":5,"x":7,"law":"L"}'), (2, '{"law":"M"}')], "chunk_id long, payload string")
    got = {r.chunk_id: (json.loads(r.payload), r.law) for r in payloads.merge_hits(hits, stored, columns={"law": "law"}).collect()}
    assert got == {1: ({"a": 1, "law": "L", "n": {"q": [1, "s"]}, 't"': "v", "x": 7}, "L"), 2: ({"law": "M"}, "M"), 3: ({}, None), 4: ({}, None)}
    names = payloads.unknown_fields(payloads.fields_of(payloads.parsed(F.col("payload"))), ["a", "n", "x"], [])
    assert [r[0] for r in hits.orderBy("chunk_id").select(names).collect()] == [['t"', "x"], [], [], []]


def test_model_calls_in_batches(spark):
    def factory():
        def model(questions, texts):
            if any(t == "bad" for t in texts):
                raise RuntimeError("no")
            if len(texts) > 4:
                raise AssertionError("batch too large")
            return [float(len(q) + len(t)) if t != "inf" else math.inf for q, t in zip(questions, texts)]

        return model

    rows = spark.createDataFrame([(i, "q" * i, "bad" if i == 5 else "inf" if i == 7 else "t") for i in range(12)], "id long, q string, t string").coalesce(1)
    got = {r.id: r for r in models.batched_calls(rows, ["q", "t"], factory, "double", "score", batch_size=4, retries=1).collect()}
    assert {i: r.score for i, r in got.items()} == {i: None if i in (5, 7) else float(i + 1) for i in range(12)}
    assert "RuntimeError" in got[5].error and "finite" in got[7].error and got[0].error is None
    assert [got[i].calls for i in (0, 4, 5, 8)] == [1, 3, 4, 1]  # a good batch once; a bad one twice, then row by row

    def speaker():
        return lambda prompts: [p.upper() for p in prompts]

    said = models.batched_calls(rows, ["q"], speaker, "string", "answer", batch_size=5).collect()
    assert all(r.answer == r.q.upper() and r.error is None for r in said)


def test_evaluation_takes_optional_parts_from_all_or_none(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (2, "c", 3)], "qid long, doc_id string, rank int")
    rows = [(1, ["a", "b"], 0.5, 10.0), (2, ["c"], 1.0, 20.0), (3, ["d"], 0.0, 30.0)]
    schema = "qid long, gold array<string>, meteor double, latency_ms double"
    row = metrics.evaluate_samples(spark.createDataFrame(rows, schema), hits, ["meteor"]).first()
    assert row["mrr"] == pytest.approx((1 + 1 / 3) / 3, abs=1e-9) and row["recall_at_1"] == pytest.approx(0.5 / 3, abs=1e-9) and row["recall_at_3"] == pytest.approx(2 / 3, abs=1e-9)
    assert row["mean_meteor"] == 0.5 and row["mean_latency_ms"] == 20.0
    none = metrics.evaluate_samples(spark.createDataFrame([(q, g, None, None) for q, g, *_ in rows], schema), hits, ["meteor"]).first()
    assert none["mean_meteor"] is None and none["sample_count"] == 3
    with pytest.raises(Exception, match="only some samples have meteor"):
        metrics.evaluate_samples(spark.createDataFrame([(*rows[0][:2], None, 1.0), *rows[1:]], schema), hits, ["meteor"]).collect()


def test_rankings_of_every_shape(spark, tmp_path):
    shapes = {
        "map.json": {"q1": {"answer": ["a", "b"]}, "q2": {"answer": ["c"]}},
        "plain.json": {"q1": ["a", "b"], "q2": ["c"]},
        "array.json": [{"id": "q1", "documents": ["a", "b"]}, {"id": "q2", "gold_document": "c"}],
        "official.json": [{"question_id": "q1", "gold_documents": ["a", "b"]}, {"question_id": "q2", "answer": ["c"], "note": 1}],
    }
    want = {("q1", 1, "a"), ("q1", 2, "b"), ("q2", 1, "c")}
    for name, value in shapes.items():
        (tmp_path / name).write_text(json.dumps(value))
        assert {tuple(r) for r in records.read_ranking_inputs(spark, str(tmp_path / name)).collect()} == want, name
    (tmp_path / "lines.jsonl").write_text("\n".join(json.dumps(x) for x in shapes["array.json"]))
    rankings = records.read_ranking_inputs(spark, str(tmp_path / "lines.jsonl"))
    assert {tuple(r) for r in rankings.collect()} == want
    for bad in ([{"id": "q1", "documents": ["a", "a"]}], [{"id": "q1", "documents": ["a"]}, {"id": "q1", "documents": ["b"]}], [{"documents": ["a"]}], {"q1": {"x": 1}}):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(Exception):
            records.read_ranking_inputs(spark, str(tmp_path / "bad.json")).collect()
    asked = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "qid string")
    placed = spark.createDataFrame([("q1", 0), ("q2", 1), ("q3", 1)], "qid string, fold int")
    assert {r.qid for r in records.select_candidates(rankings, asked, placed, 0).collect()} == {"q1"}
    assert {r.qid for r in records.select_candidates(rankings, asked, head=2).collect()} == {"q1", "q2"}
    with pytest.raises(ValueError, match="q3"):
        records.select_candidates(rankings, asked, placed, 1)


def test_ngram_keys_equal_brute_force(spark, monkeypatch):
    """Totals and different n-grams of repeated, short, empty and null rows, also where a batch is counted in parts."""
    from lexatlas.functions import ngrams

    picks = random.Random(5)
    rows = [[picks.choice("abcdeé") for _ in range(size)] for size in (0, 1, 2, 3, 50, 200)] * 2 + [["a", "b"], ["b", "a"], ["ab"], None]
    frame = spark.createDataFrame([(r,) for r in rows], "w array<string>").coalesce(1)
    for starts in (7, 1 << 20):
        monkeypatch.setattr(ngrams, "STARTS", starts)
        counted = ngrams.ngram_keys(frame, "w").groupBy("n", "k1", "k2").agg(F.sum("c").alias("c"))
        got = {r.n: (r.total, r.different) for r in counted.groupBy("n").agg(F.sum("c").alias("total"), F.count("*").alias("different")).collect()}
        for n in (1, 2, 3):
            grams = [tuple(r[i : i + n]) for r in rows if r for i in range(len(r) - n + 1)]
            assert got[n] == (len(grams), len(set(grams)))
