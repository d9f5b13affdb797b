import json

from lexatlas.streaming.incremental import ingest_stream, read_ingested


def test_resumes_and_replaces(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()

    def put(name, text):
        (tmp_path / "in" / name).write_text(json.dumps({"doc_id": "a", "title": "T", "text": text, "source": "s"}) + "\n")
        ingest_stream(spark, source, target, checkpoint).awaitTermination(120)

    put("1.json", "Điều 1. Cũ")
    put("2.json", "Điều 1. Mới\n1. x")
    texts = {r.text for r in read_ingested(spark, target).where("record = 'chunk'").collect()}
    assert texts == {"Điều 1. Mới", "1. x"}
