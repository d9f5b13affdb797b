import json
import zipfile

import pytest

from lexatlas.sources import documents, records, sinks


def test_json_documents(spark, tmp_path):
    (tmp_path / "context_1.json").write_text(json.dumps({"id": "Văn bản 1", "passage": "", "text": "x", "name": "N"}, ensure_ascii=False), encoding="utf-16")
    (tmp_path / "context_2.json").write_text('[1, {"doc_id": 7, "content": "abc", "Title": "T"}]')
    (tmp_path / "bad.json").write_text('{"a": 1, "a": 2}')
    good, bad = documents.read_json(spark, str(tmp_path))
    rows = {r.doc_id: r for r in good.collect()}
    assert rows["van_ban_1"].raw_text == "" and rows["van_ban_1"].source_content_empty
    assert rows["7"].raw_text == "abc" and rows["7"].title == "T"
    assert [r.path.rsplit("/", 1)[-1] for r in bad.collect()] == ["bad.json"]


def test_jsonl_line_numbers(spark, tmp_path):
    (tmp_path / "many.jsonl").write_text('{"text": "a"}\n\n{"text": "b"}\nnot json\n{"id": "k", "text": "c"}\n')
    good, bad = documents.read_jsonl(spark, str(tmp_path))
    assert {(r.doc_id, r.raw_text) for r in good.collect()} == {("many_line_1", "a"), ("many_line_3", "b"), ("k", "c")}
    assert bad.count() == 1


def test_duplicates(spark):
    rows = spark.createDataFrame([("a", "p1", "x"), ("a", "p2", "x"), ("b", "p1", "x"), ("b", "p3", "y")], "doc_id string, source_path string, raw_text string")
    kept, errors = documents.resolve_duplicates(rows)
    assert {(r.doc_id, r.source_path) for r in kept.collect()} == {("a", "p1"), ("b", "p1")}
    assert errors.count() == 1


def test_question_files(spark, tmp_path):
    (tmp_path / "train.json").write_text(json.dumps({"q1": {"question": "x?", "answer": ["1", "2"]}}))
    rows = records.read_question_map(spark, str(tmp_path / "train.json"))
    assert {tuple(r) for r in records.gold_rows(rows).collect()} == {("q1", "1"), ("q1", "2")}
    (tmp_path / "dup.json").write_text('{"q": {"question": "x", "answer": ["1"]}, "q": {"question": "y", "answer": ["1"]}}')
    with pytest.raises(Exception):
        records.read_question_map(spark, str(tmp_path / "dup.json")).collect()
    for name, payload in (("a", {"x": {}, "y": {}}), ("b", ["x", "y"]), ("c", [{"id": "x"}, {"id": "y", "question": "?"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(payload))
        assert {r.qid for r in records.read_question_ids(spark, str(tmp_path / f"{name}.json")).collect()} == {"x", "y"}


def test_predictions_and_folds(spark, tmp_path):
    hits = [{"chunk_id": "c1", "doc_id": "d", "rank": 1}, {"chunk_id": "c2", "doc_id": "d"}]
    (tmp_path / "p.jsonl").write_text(json.dumps({"question_id": "q", "hits": hits}) + "\n")
    assert [(r.chunk_id, r["rank"]) for r in records.read_predictions(spark, str(tmp_path / "p.jsonl")).orderBy("rank").collect()] == [("c1", 1), ("c2", 2)]
    ranked = records.read_rankings(spark, {"Dense": str(tmp_path / "p.jsonl")})
    assert {r.source for r in ranked.collect()} == {"dense"}
    (tmp_path / "f.json").write_text(json.dumps({"schema_version": "folds-v1", "folds": [{"fold": 0, "validation_ids": ["a"]}, {"fold": 1, "validation_ids": ["b"]}]}))
    assert {tuple(r) for r in records.read_folds(spark, str(tmp_path / "f.json"), "folds-v1").collect()} == {("a", 0), ("b", 1)}


def test_submission_round_trip(spark, tmp_path):
    answers = spark.createDataFrame([("q2", "b"), ("q1", "a \"x\"")], "qid string, answer string")
    first = sinks.package(answers, tmp_path / "one.zip").read_bytes()
    assert sinks.package(answers.orderBy("answer"), tmp_path / "two.zip").read_bytes() == first
    assert sinks.load_submission(tmp_path / "one.zip", ["q1", "q2"]) == {"q1": 'a "x"', "q2": "b"}
    with pytest.raises(ValueError):
        sinks.load_submission(tmp_path / "one.zip", ["q1"])
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as archive:
        archive.writestr("other.json", "{}")
    with pytest.raises(ValueError):
        sinks.load_submission(tmp_path / "bad.zip")


def test_resume_and_bundle(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "qid string, x int")
    sinks.write_pending(rows.where("qid = 'a'"), str(tmp_path / "t"))
    assert sinks.write_pending(rows, str(tmp_path / "t")).count() == 2
    assert sinks.write_pending(rows, str(tmp_path / "t")).count() == 2
    sinks.write_bundle({tmp_path / "r.json": b"{}", tmp_path / "r.md": b"#"})
    assert (tmp_path / "r.md").read_bytes() == b"#"


def test_repeats_and_conflicts_inside_one_file(spark, tmp_path):
    lines = [{"id": "a", "content": "x"}, {"id": "a", "content": "x"}, {"id": "b", "content": "one"}, {"id": "b", "content": "two"}]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\t\n \nnot json\n")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    kept, errors = documents.read_directory(spark, str(tmp_path))
    assert sorted((r.doc_id, r.raw_text) for r in kept.collect()) == [("a", "x"), ("b", "one")]
    assert sorted(r.error for r in errors.collect()) == ["conflicting duplicate id: b", "invalid JSON line", "unsupported file type"]


def test_rejected_lines_are_whole(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("x" * 500 + "\n")
    assert [len(r.line) for r in records.read_chunks(spark, str(tmp_path))[1].collect()] == [500]
