import re

import pytest
from pyspark.sql import functions as F

from lexatlas.operators import audit, chunking, cleaning, structure


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts, 1)], "doc_id string, cleaned_text string")


def levels(spark, text):
    rows = structure.entries(structure.parse(docs(spark, text))).orderBy("line_number").collect()
    return [(r.level, r.identifier) for r in rows]


def test_heading_levels(spark):
    assert levels(spark, "Chương i\nĐiều 1. A\n1. B\na) C") == [("chapter", "I"), ("article", "1"), ("clause", "1"), ("point", "a")]


def test_reference_line_is_text(spark):
    assert levels(spark, "Điều 1. A\nĐiều 98 như sau:\nĐiều 2 của Luật Đất đai") == [("article", "1")]


def test_split_heading_is_repaired(spark):
    rows = structure.parse(docs(spark, "Điều\n5. Tên\nx")).where("live").orderBy("seq").collect()
    assert [(r.kind, r.identifier, r.end_line) for r in rows][0] == ("article", "5", 2)
    assert sum(r.repaired for r in rows) == 1


def test_appendix_ends_parsing(spark):
    assert levels(spark, "Điều 1. A\nPHỤ LỤC I\nĐiều 9. B") == [("article", "1")]


def test_list_before_article_is_text(spark):
    assert levels(spark, "1. mở đầu\na) x\nĐiều 3. A\na) lẻ") == [("article", "3"), ("point", "a")]


def brute_pack(text, size, overlap):
    """Slow restatement on token positions: every part is built token by token."""
    sentences = [s.split() for s in re.split(r"(?<=[.!?;])\s+", " ".join(text.split())) if s]
    if sum(map(len, sentences)) <= size:
        return [" ".join(text.split())] if text.split() else []
    parts, current, carry = [], [], []
    for s in sentences:
        if len(s) >= size or len(sentences) == 1:
            prefix = carry
            if current:
                parts.append(current)
                prefix = current[-min(overlap, size - 1) :] if min(overlap, size - 1) else []
                current = []
            stream = prefix + s
            start = 0
            while True:
                parts.append(stream[start : start + size])
                if start + size >= len(stream):
                    break
                start += size - min(overlap, size - 1)
            carry = parts[-1][-min(overlap, size - 1) :] if min(overlap, size - 1) else []
            continue
        take = min(overlap, size - len(s))
        if not current and carry:
            current = carry[-take:] if take else []
            carry = []
        if current and len(current) + len(s) > size:
            parts.append(current)
            current = current[-take:] if take else []
        current = current + s
    if current:
        parts.append(current)
    return [" ".join(p) for p in parts]


def test_packing_matches_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice(["a", "b.", "c", "d;", "e"]) for _ in range(rng.randrange(1, 40))]
        size, overlap = rng.randrange(2, 9), rng.randrange(0, 5)
        got = chunking.pack(" ".join(words), size, overlap)
        assert got == brute_pack(" ".join(words), size, overlap)
        assert all(len(p.split()) <= size for p in got)


def test_long_sentence_windows(spark):
    assert chunking.pack("1 2 3 4 5", 3, 1) == ["1 2 3", "3 4 5"]
    rows = docs(spark, "1 2 3 4 5", "").select(chunking.token_windows(F.col("cleaned_text"), 3, 1).alias("w")).collect()
    assert [r.w for r in rows] == [["1 2 3", "3 4 5"], []]


def test_chunk_ids_routes_and_coverage(spark):
    source = docs(
        spark,
        "Mở đầu\nChương I\nĐiều 1. A\n1. B\na) C\n2. D\nĐiều 1. E\nPHỤ LỤC I\nđuôi",
        "",
        "Lời nói đầu\n\nnội dung",
        "chỉ là văn bản",
    ).withColumn("title", F.lit("Luật-mẫu")).withColumn("source", F.lit("s"))
    records = chunking.chunk_records(source).persist()
    chunks = {r.chunk_id: r for r in records.where("record = 'chunk'").collect()}
    assert set(chunks) == {
        "d1_document_context_1_part_1", "d1_article_1_intro", "d1_article_1_clause_1", "d1_article_1_clause_1_point_a", "d1_article_1_clause_2",
        "d1_article_1_occurrence_2_body", "d1_document_context_2_part_1", "d2_empty_source_placeholder", "d3_fallback_part_1", "d3_fallback_part_2", "d4_document_part_1",
    }
    assert chunks["d1_article_1_intro"].text == "Chương I Điều 1. A"
    assert chunks["d2_empty_source_placeholder"].text == "Tên văn bản: Luật mẫu"
    assert chunks["d3_fallback_part_1"].article == "Lời nói đầu"
    totals = audit.coverage_totals(source, records).first()
    assert (totals.missing_tokens, totals.missing_bigrams) == (0, 0)
    report = audit.validation_report(source, records).first()
    assert (report.orphan_parent_links, report.duplicate_chunk_ids, report.official_empty_source_content) == (0, 0, 1)
    assert not report.quality_gate_passed


def test_label_only_clause_joins_first_point(spark):
    rows = chunking.chunk_records(docs(spark, "Điều 1. A\nKhoản 2.\na) p\nb) q\nKhoản 3. T\na) r")).where("record = 'chunk'").collect()
    texts = {r.chunk_id: r.text for r in rows}
    assert texts["d1_article_1_clause_2_point_a"] == "Khoản 2. a) p"
    assert "d1_article_1_clause_2" not in texts and "d1_article_1_clause_3" in texts


def clean(spark, text):
    rows = spark.createDataFrame([("a", text)], "doc_id string, text string")
    return cleaning.clean_documents(rows).first()


def test_page_edges_kept_once(spark):
    row = clean(spark, "\f".join(f"Trang {i}\nNội dung {w}.\nCông báo" for i, w in enumerate(("một", "hai", "ba"), 1)))
    assert row.cleaned_text == "Nội dung một. \nCông báo".replace(" \n", "\n") + "\fNội dung hai.\fNội dung ba."
    assert row.removed_reasons == {"explicit_page_marker": 3, "repeated_page_edge_duplicate": 2}


def test_hard_wraps_and_repairs(spark):
    assert clean(spark, "tài-\nliệu và\r\nphần hai.\n12\nhoà HOÀ Toà quý d1eu\nd1eu 5 x").cleaned_text == "tàiliệu và phần hai.\n12\nhòa HÒA Tòa quý d1eu\nđiều 5 x"


def test_abbreviations(spark):
    rows = docs(spark, 'Bộ luật Lao động mới (sau đây gọi là BLLĐ) và QĐ').select(
        cleaning.expanded_terms(F.col("cleaned_text"), cleaning.abbreviations(F.col("cleaned_text"))).alias("t")
    )
    assert rows.first().t == {"BLLĐ": "Bộ luật Lao động mới", "QĐ": "Quyết định"}


@pytest.mark.parametrize("line, risky", [("12", True), ("3/4", True), ("***", True), ("Draft", True), ("Trang 3", False)])
def test_risky_removals(spark, line, risky):
    assert docs(spark, line).select(cleaning.is_risky_removal(F.col("cleaned_text")).alias("r")).first().r is risky
