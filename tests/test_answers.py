import os

import pytest
from pyspark.sql import functions as F

from lexatlas.functions import patterns as P
from lexatlas.operators import answers, citations, evidence, selector
from lexatlas.plans import answer_queries

FOLDER = os.environ.get("LEXATLAS_DATA", "/root/testdata/sf0.001")


def test_find_words_and_windows():
    assert evidence.find_words("a bc a b".split(), "a b".split()) == 2
    assert evidence.find_words(["ab"], ["a"]) is None
    words = " ".join(f"w{i}" for i in range(20))
    assert evidence.window_text(words, ["w10"], 5) == "w8 w9 w10 w11 w12"
    assert evidence.window_text(words, ["w2", "w17"], 7) == "w1 w2 w3 […] w16 w17 w18"
    assert evidence.window_text(words, ["nothing"], 5) is None
    assert evidence.single_window(words, "no such", 1) == "no"


def test_parent_expansion(spark):
    hits = spark.createDataFrame(
        [(1, "d", "p", "c1", 1, "w3", "Điều 1"), (1, "d", "p", "c2", 2, "w6", "Điều 1"), (1, "d", "q", "c3", 3, "x y", "Điều 9"), (1, "d", None, "c4", 4, "z", None)],
        "qid long, doc_id string, parent_id string, chunk_id string, rank int, text string, article string",
    )
    parents = spark.createDataFrame([("d", "p", "w1 w2 w3 w4 w5 w6 w7", "Điều 1"), ("d", "q", "x y t", "Điều 2")], "doc_id string, parent_id string, text string, article string")
    rows = evidence.expand_parents(hits, parents, 10, 10).orderBy("rank").collect()
    assert [(r.text, r.expanded) for r in rows] == [("w1 w2 w3 w4 w5 w6 w7", True), ("x y", False), ("z", False)]


def test_post_processing(spark):
    raw = ["Trả lời: Một dòng dài\nMột dòng dài\nngắn\nngắn\n[1] (law_name=x", "không có thông tin", "Chắc chắn, tôi sẽ trả lời ngay\nKết quả.", " "]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select(answers.finish_answer(F.col("r")).alias("a")).collect()
    assert [r.a for r in rows] == ["Một dòng dài\nngắn\nngắn", P.REFUSAL_ANSWER, "Kết quả.", P.REFUSAL_ANSWER]


def test_bank_is_complete(spark):
    long = " ".join(f"từ{i} nội dung số {i}." for i in range(120))
    rows = spark.createDataFrame([(1, "từ5 nội dung?", "Câu trả lời ngắn gọn.", long), (2, "a b c", "d e f.", "a b c d. e f g h.")], "qid long, question string, generated string, extractive string")
    bank = answers.candidate_bank(rows).persist()
    assert {r.profile for r in bank.where("qid = 1").collect()} == set(answers.PROFILES)
    assert answers.bank_violations(bank).count() == 0
    smart = bank.where("qid = 1 and profile = 'evidence_256'").first().answer.split("\n")
    assert smart == sorted(smart, key=lambda s: int(s.split()[0][2:].rstrip("."))) and "từ5 nội dung số 5." in smart


def test_near_equal_join(spark):
    rows = spark.createDataFrame([("a b c", "A b c"), ("a", "x y"), ("", "q")], "x string, y string").select(answers.join_distinct(F.col("x"), F.col("y")).alias("j")).collect()
    assert [r.j for r in rows] == ["a b c", "a\nx y", "q"]


def test_citations(spark):
    texts = [
        "Xem [Bộ luật Lao động 2019, Điều 10, Khoản 1, Điểm a] và [ghi chú].",
        "Căn cứ khoản 2 Điều 38 Luật An toàn lao động 2015.",
        "Theo Nghị định số 87, Điều 5, khoản 1.",
    ]
    rows = citations.parse_citations(spark.createDataFrame(list(enumerate(texts)), "qid int, answer string")).orderBy("qid", "n").collect()
    assert tuple(rows[0])[2:] == ("Bộ luật Lao động 2019", "Điều 10", "Khoản 1", "Điểm a")
    rest = [(r.article, r.clause, r.law_name) for r in rows[1:]]
    assert ("Điều 38", "Khoản 2", "Luật An toàn lao động 2015") in rest
    assert ("Điều 5", "Khoản 1", "Nghị định số 87") in rest
    hits = spark.createDataFrame([(0, 1, "c1", "luật lao động - 2019", "điều 10", "Khoản 1", "Điểm a"), (0, 2, "c2", "Bộ luật Lao động", "Điều 10", "khoản 1", "điểm a")], "qid int, rank int, chunk_id string, law_name string, article string, clause string, point string")
    checked = citations.verify(citations.parse_citations(spark.createDataFrame([(0, texts[0])], "qid int, answer string")), hits).first()
    assert checked.is_verified and checked.chunk_id == "c1" or checked.chunk_id == "c2"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_selector_chooses_for_every_question(spark, monkeypatch):
    """All outer and inner folds are fitted with the full forests; only the fits themselves are replaced."""
    fits = []

    def scores(train, valid, trees, seed, depth=12):
        fits.append((trees, depth))
        return valid.select("qid", "profile", "position", "target", "answer", *[F.col("target").alias(m) for m in selector.METHODS])

    monkeypatch.setattr(selector, "fit_scores", scores)
    got = [r.qid for r in answer_queries.selector_fold(spark, FOLDER).select("qid").collect()]
    asked = [r.qid for r in answer_queries.turn_pairs(spark, FOLDER).select("qid").collect()]
    assert sorted(got) == sorted(set(asked)) and len(got) > 0
    assert sorted(fits) == [(selector.TREES["inner"], 12)] * 6 + [(selector.TREES["outer"], 12)] * 3


def test_bank_is_made_once_and_on_all_cores(spark):
    texts = {"question": "từ nội dung?", "generated": "Câu trả lời ngắn gọn. Có thêm một câu.", "extractive": "a b c d. e f g h."}
    rows = spark.range(0, 40, 1, 1).select(F.col("id").alias("qid"), *[F.lit(t).alias(c) for c, t in texts.items()])
    assert answers.candidate_bank(rows).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(profile):
        made.add(1)
        return profile

    entries = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "a"), (3, None)], "qid long, profile string")
    got = answers.bank_violations(entries.withColumn("profile", seen.asNondeterministic()("profile"))).collect()
    assert sorted(map(tuple, got)) == [(2, 1, 2, 2)] and made.value == 6


def test_trimmed_to_whole_sentences(spark):
    text = "một hai ba bốn. năm sáu bảy. tám chín mười mười một."
    units = answers.sentence_table(F.lit(text))
    cut = [answers.trim_to_sentences(F.lit(text), units, n) for n in (2, 4, 6, 7, 20)]
    assert list(spark.range(1).select(*cut).first()) == ["một hai", "một hai ba bốn.", "một hai ba bốn.", "một hai ba bốn.\nnăm sáu bảy.", text]


def test_only_ranked_documents_are_chunked(spark, tmp_path):
    words = ["ánh sáng mặt trời", "nước biển xanh"]
    docs = [(i, f"{words[i % 2]} dòng {i}\nđầu {i}\n{words[i % 2]} nội dung\ncuối") for i in range(40)]
    spark.createDataFrame([(i, t, "vi", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, words[0])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hits, parents = answer_queries.chunk_hits(spark, str(tmp_path))
    ranked = {r.doc_id for r in hits.select("doc_id").collect()}
    assert len(ranked) == 5 and {r.doc_id for r in parents.select("doc_id").collect()} == ranked
    whole = answer_queries.corpus_queries.records(spark, str(tmp_path)).where("record = 'parent'")
    assert sorted(map(str, parents.collect())) == sorted(str(r) for r in whole.collect() if r.doc_id in ranked)
