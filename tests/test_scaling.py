"""Work and memory of a task that must not grow with the tables."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexatlas.functions import ngrams
from lexatlas.functions import text as tx
from lexatlas.operators import answers, audit, bm25, chunking, cleaning, folds, joins, setjoin, vectors


def written(spark, path, rows: int):
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.sha2(F.concat_ws("-", "id", i), 256), F.lit(" word "), i.cast("string"))), "\n")
    spark.range(rows).select(F.col("id").alias("doc_id"), lines.alias("cleaned_text")).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_chunks_are_placed_in_more_pieces_as_the_documents_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "PIECE_BYTES", 4096)
    few, many = written(spark, str(tmp_path / "few"), 40), written(spark, str(tmp_path / "many"), 160)
    assert joins.pieces(many) > 3 * joins.pieces(few) > 3 * spark.sparkContext.defaultParallelism
    for documents in (few, many):
        records = chunking.chunk_records(documents)
        assert records.rdd.getNumPartitions() == joins.pieces(documents)
        assert records.where("record = 'chunk'").select("doc_id").distinct().count() == documents.count()
    cleaned = cleaning.clean_documents(many, text="cleaned_text")
    assert cleaned.rdd.getNumPartitions() == joins.pieces(many)


def test_a_source_of_unknown_size_is_placed_as_spark_chooses(spark):
    rows = spark.createDataFrame([(1, "a b"), (None, "c"), (1, None)], "doc_id long, text string")
    assert joins.place(rows, "doc_id", None).count() == 3
    unknown = spark.createDataFrame(rows.rdd, rows.schema)
    assert joins.pieces(unknown) is None or joins.pieces(unknown) >= 1
    assert joins.place(unknown, "doc_id", joins.pieces(unknown)).count() == 3


def test_coverage_exchanges_texts_and_never_their_tokens(spark):
    source = spark.createDataFrame([(1, "a b a\nc d"), (2, "x y"), (3, None), (None, "n n")], "doc_id long, cleaned_text string")
    kept = [("chunk", 1, "a b"), ("chunk", 1, "a c d"), ("parent", 1, "a b a\nc d"), ("chunk", 2, "x"), ("parent", 2, "x y"), ("parent", None, "n"), ("chunk", None, "n n"), ("other", 2, "y")]
    records = spark.createDataFrame(kept, "record string, doc_id long, text string")
    totals = audit.coverage_totals(source, records)
    assert totals.collect() == [(2, 3)]  # y of 2 and one n; "b a" of 1, "x y" of 2 and "n n"
    for frame in (totals, audit.coverage_mismatch(source, records), audit.coverage_mismatch(source, records, bigrams=True)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(doc_id" in plan and ", item" not in "".join(part.split(")")[0] for part in plan.split("hashpartitioning(")[1:])
    assert {(r.doc_id, r.item, r.missing) for r in audit.coverage_mismatch(source, records).collect()} == {(2, "y", 1), (None, "n", 1)}


def test_grid_cells_grow_with_the_tables_and_lose_no_pair(spark, monkeypatch):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=4)]) for i in range(90)]
    stored = spark.createDataFrame(rows, "vec_id long, v array<double>")
    asked = stored.withColumnRenamed("vec_id", "qid")
    fragments, search = [], vectors._grid_search
    monkeypatch.setattr(vectors, "_grid_search", lambda v, q, k, n, m, fragment: fragments.append(fragment) or search(v, q, k, n, m, fragment))
    monkeypatch.setattr(vectors, "GRID_SIDE", 3)
    found = vectors.nearest(asked, stored, 4, query_bytes=0, fragment=5).collect()
    assert fragments == [30]  # not 18 fragments a side, each row copied 18 times
    matrix = np.array([v for _, v in rows])
    for i, scores in enumerate(np.round(matrix @ matrix.T, 6)):
        best = sorted((-s, j) for j, s in enumerate(scores))[:4]
        assert [j for _, j in best] == [r.vec_id for r in sorted((r for r in found if r.qid == i), key=lambda r: r["rank"])]
    monkeypatch.setattr(vectors, "FRAGMENT_ROWS", 12)
    vectors.nearest(asked, stored, 4, query_bytes=0, fragment=5)
    vectors.nearest(asked, stored, 4, query_bytes=0, fragment=50)
    assert fragments[1:] == [12, 50]


def test_sentences_of_a_batch_are_python_objects_one_question_at_a_time(monkeypatch):
    made = []
    monkeypatch.setattr(answers.F, "arrow_udf", lambda kind: lambda function: lambda column: made.append(function))
    answers.select_sentences(None, (4, 8))
    question = [{"idx": i, "unit": f"unit {i} of it", "tokens": ["unit", str(i), "of", "it"], "score": i / 7} for i in range(40)]
    kind = pa.list_(pa.struct({"idx": pa.int32(), "unit": pa.string(), "tokens": pa.list_(pa.string()), "score": pa.float64()}))
    batch = pa.array([question, []] * 200, kind)
    peaks = []
    for work in (batch.to_pylist, lambda: made[0](batch)):
        tracemalloc.start()
        result = work()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert result.to_pylist() == [[answers.pick_sentences(q, n) for n in (4, 8)] for q in (question, [])] * 200
    assert 10 * peaks[1] < peaks[0]  # no batch as objects


def test_known_ngrams_are_counted_in_parts_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "TOKENS", 3)
    texts = ["the red cat red", None, "", "dog", "b a b c red a b c", "cat the red", "x"]
    terms = ["red", "red cat", "cat", "the red cat", "dog", "a b c", "b c", "zebra"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    shipped = spark.sparkContext.broadcast(pa.array(terms))
    for row in rows.select("text", ngrams.known_ngrams(tx.word_tokens(F.col("text")), shipped).alias("h")).collect():
        padded = [" ".join(w[i : i + n]) for w in [(row.text or "").split()] for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        assert {terms[h.term]: h.tf for h in row.h} == {t: padded.count(t) for t in terms if t in padded}
    nothing = spark.sparkContext.broadcast(pa.array([], pa.string()))
    assert all(r.h == [] for r in rows.select(ngrams.known_ngrams(tx.word_tokens(F.col("text")), nothing).alias("h")).collect())


def test_bm25_weights_are_added_up_without_a_row_per_question_and_term(spark, monkeypatch):
    words = ["red", "cat", "dog", "the", "sat", "on", "mat"]
    draw = np.random.default_rng(5)
    docs = [(None if i % 17 == 0 else i // 2, " ".join(draw.choice(words, draw.integers(0, 12)))) for i in range(120)]
    documents = spark.createDataFrame(docs + docs[:5], "doc_id long, text string")
    asked = [(1, "red cat"), (2, "the dog sat on the mat"), (2, "cat"), (None, "on"), (4, None), (5, "mat the")]
    questions = spark.createDataFrame(asked, "qid long, question string")
    monkeypatch.setattr(bm25, "fits_broadcast", lambda *a, **k: False)
    wanted = {(r.qid, r.doc_id): r.score for r in bm25.scores(questions, documents).collect()}
    best = {(r.qid, r["rank"]): r.score for r in bm25.top_documents(bm25.scores(questions, documents), 4).collect()}
    monkeypatch.setattr(bm25, "fits_broadcast", lambda *a, **k: True)
    for cells in (1, 7, 1 << 20):
        monkeypatch.setattr(bm25, "CELLS", cells)
        found = bm25.scores(questions, documents)
        got = {(r.qid, r.doc_id): r.score for r in found.collect()}
        assert got == pytest.approx(wanted, abs=2e-6) and found.count() == len(wanted)
        assert {(r.qid, r["rank"]): r.score for r in bm25.rank_documents(questions, documents, 4).collect()} == pytest.approx(best, abs=2e-6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate [qid" not in plan


def counted(spark, frame, column):
    """The frame, and how many of its rows have been made so far."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(value):
        made.add(1)
        return value

    return frame.withColumn(column, seen.asNondeterministic()(column)), made


def test_set_pairs_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [[f"t{t}" for t in rng.choice(400, 40, replace=False)] for _ in range(30)]
    sets = {i: sorted({*base[i % 30][: 40 - i % 4], f"own{i}"}) for i in range(150)}
    frame = lambda name, ids: spark.createDataFrame([(i, sets[i]) for i in ids], f"{name} long, tokens array<string>")
    monkeypatch.setattr(setjoin, "BLOCK_SETS", 2)
    got = {(r.left_id, r.right_id): r.common for r in setjoin.similar_sets(frame("left_id", range(150)), frame("right_id", range(0, 150, 3)), 0.8).collect()}
    common = {(a, b): len({*sets[a]} & {*sets[b]}) for a in range(150) for b in range(0, 150, 3)}
    assert got == {(a, b): n for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)} and len(got) > 150


def test_anti_joins_make_the_records_once(spark):
    rows = [("parent", "p", None, "P"), ("chunk", "p", "c1", "x"), ("chunk", "q", "c2", "y"), ("chunk", None, "c3", "z"), ("parent", "r", None, "R"), ("parent", None, None, "N"), ("note", "r", None, "")]
    frame = spark.createDataFrame(rows, "record string, parent_id string, chunk_id string, text string")
    for check, wanted in ((audit.orphan_chunks, {"y", "z"}), (audit.unreferenced_parents, {"R", "N"})):
        records, made = counted(spark, frame, "text")
        found = check(records)
        assert found.columns == frame.columns and {r.text for r in found.collect()} == wanted and made.value <= len(rows)


def test_report_makes_the_records_once(spark):
    documents = spark.createDataFrame([(i, f"Điều 1. Tên {i}\n1. Nội dung\na) thêm") for i in range(12)], "doc_id long, cleaned_text string").withColumn("law_name", F.lit("l")).withColumn("source", F.lit("s"))
    records, made = counted(spark, chunking.chunk_records(documents), "text")
    report = audit.validation_report(documents, records).first()
    assert report.document_count == report.parent_count == 12 and made.value == report.chunk_count + 12


def test_bootstrap_makes_the_deltas_once(spark):
    deltas, made = counted(spark, spark.createDataFrame([(str(i), 0.1 * i, 1) for i in range(10)], "group_key string, delta double, n long"), "group_key")
    report = folds.bootstrap_report(deltas, draws=20).first()
    assert report.group_count == 10 and made.value == 10


def test_only_scores_near_the_best_are_ordered(monkeypatch):
    rng = np.random.default_rng(5)
    scores = np.round(rng.normal(size=(7, 9000)), 2)  # with many ties
    scores[0] = 0.5
    ids = rng.permutation(9000).astype(np.int64)
    wanted = [sorted(zip(-row, ids))[:20] for row in scores]
    widths, leaders = [], vectors._leaders
    monkeypatch.setattr(vectors, "_leaders", lambda s, i, k: widths.append(s.shape[1]) or leaders(s, i, k))
    found, best = vectors._best(scores, ids, 20)
    assert [list(zip(-s, i)) for s, i in zip(best, found)] == wanted
    vectors._best(rng.normal(size=(7, 9000)), ids, 20)
    assert widths[-1] < 900
