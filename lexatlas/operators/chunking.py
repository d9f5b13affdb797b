"""Parent contexts and overlapping child chunks of parsed documents.

Every line belongs to one segment of its document: a legal unit (article body,
clause or point), a run of lines outside all articles, or, for documents that
fall back, the whole text.  Segments are formed by one grouping in the
placement of the line table; only units longer than a chunk visit Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexatlas.functions import patterns as P
from lexatlas.functions import text as tx
from lexatlas.functions.unicode import casefold, label_id, safe_id
from lexatlas.operators import structure
from lexatlas.operators.joins import pieces, place

# Chunk size and overlap in white-space tokens.
CHUNK_SIZE, CHUNK_OVERLAP = 192, 32

_SENTENCE_END = re.compile(r"(?<=[.!?;])\s+")


def _windows(words: list[str], size: int, overlap: int) -> Iterator[list[str]]:
    """Fixed windows over words, each sharing ``overlap`` words with the last."""
    step = size - min(overlap, size - 1)
    for start in range(0, len(words), step):
        yield words[start : start + size]
        if start + size >= len(words):
            return


def pack(text: str, size: int, overlap: int) -> list[str]:
    """Sentence packing of one unit longer than a chunk (STR-14).

    Works on word lists.  ``part`` is the chunk being filled; ``tail`` is what
    the next chunk may repeat.
    """
    sentences = [s.split() for s in _SENTENCE_END.split(" ".join(text.split())) if s.strip()]
    if sum(map(len, sentences)) <= size:
        return [" ".join(sum(sentences, []))] if sentences else []
    done: list[list[str]] = []
    part: list[str] = []
    tail: list[str] = []

    def last(words: list[str], count: int) -> list[str]:
        return words[len(words) - min(count, len(words)) :] if count > 0 else []

    for words in sentences:
        room = size - len(words)
        if room <= 0 or len(sentences) == 1:
            if part:
                done.append(part)
                tail = last(part, min(overlap, size - 1))
                part = []
            done.extend(_windows(tail + words, size, overlap))
            tail = last(done[-1], min(overlap, size - 1))
            continue
        if not part and tail:
            part, tail = last(tail, min(overlap, room)), []
        if part and len(part) + len(words) > size:
            done.append(part)
            part = last(part, min(overlap, room))
        part = part + words
    if part:
        done.append(part)
    return [" ".join(words) for words in done]


def packed(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunk texts of a unit; short units never leave the JVM."""
    if size < 1 or overlap < 0:
        raise ValueError("chunk size must be positive and overlap not negative")

    @F.pandas_udf("array<string>")
    def split_long(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else pack(t, size, overlap))

    long = tx.token_count(text) > size
    flat = tx.collapse_space(text)
    short = F.when(flat == "", F.array().cast("array<string>")).otherwise(F.array(flat))
    return F.when(long, split_long(F.when(long, text))).otherwise(short)


def token_windows(text: Column, size: int, overlap: int) -> Column:
    """Fixed overlapping token windows as an array of strings (W-13)."""
    words = tx.space_tokens(text)
    step = size - min(overlap, size - 1)
    count = F.size(words)
    starts = F.when(
        count > 0,
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil((count - size) / step).cast("int") * step + 1), F.lit(step)),
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.array_join(F.slice(words, at, F.lit(size)), " "))


def _doc_flags(parsed: DataFrame) -> DataFrame:
    """Per-document confidence attached to every line (W-08, UDT-06)."""
    doc = Window.partitionBy("doc_id")
    earlier = doc.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    is_article = F.col("kind") == "article"
    number = F.regexp_extract("identifier", r"^(\d+)", 1).cast("decimal(38,0)")
    rows = parsed.withColumn("_number", F.when(is_article, number))
    rows = rows.withColumn("_drop", F.col("_number") < F.last("_number", ignorenulls=True).over(earlier))
    total = lambda c: F.sum(c.cast("int")).over(doc)
    article_ids = F.collect_set(F.when(is_article, casefold(F.col("identifier")))).over(doc)
    rows = rows.withColumns(
        {
            "article_count": total(is_article),
            "distinct_articles": F.size(article_ids),
            "nonmonotonic": F.coalesce(F.max("_drop").over(doc), F.lit(False)),
            "first_article": F.min(F.when(is_article, F.col("n"))).over(doc),
            "line_count": F.greatest(F.max(F.when(F.col("piece") != "", F.col("n"))).over(doc), F.lit(1)),
            "repaired_count": total(F.col("repaired") & F.col("live")),
            "suspected_count": total(F.col("suspected") & (F.col("seq") % 2 == 0)),
            "appendix_count": total((F.col("kind") == "appendix") & F.col("live")),
            "filled": F.coalesce(F.max(tx.strip(F.col("piece")) != "").over(doc), F.lit(False)),
            "family": F.coalesce(F.first("family", ignorenulls=True).over(doc), F.lit("unknown")),
        }
    )
    late = (F.col("first_article") - 1) / F.col("line_count") > 0.5
    few = F.col("article_count") <= 3
    forced_family = F.col("family").isin(*P.FORCED_FALLBACK_FAMILIES)
    warnings = {
        "unstructured_source_family": forced_family,
        "duplicate_article_identifiers": F.col("distinct_articles") < F.col("article_count"),
        "nonmonotonic_article_sequence": F.col("nonmonotonic"),
        "late_first_article": late,
        "low_structure_confidence": few & late,
        "ambiguous_split_article_candidates": F.col("suspected_count") > 0,
        "repaired_split_article_headings": F.col("repaired_count") > 0,
        "sparse_repaired_article_sequence": (F.col("repaired_count") > 0) & few,
        "appendix_segments_detected": F.col("appendix_count") > 0,
    }
    partial = ("duplicate_article_identifiers", "nonmonotonic_article_sequence", "late_first_article", "sparse_repaired_article_sequence")
    has = F.col("article_count") > 0
    listed = F.when(
        has, F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in warnings.items()]))
    ).otherwise(F.array().cast("array<string>"))
    lowered = F.lower("piece")
    # the first label of the list that occurs anywhere in the text
    positions = [F.max(F.contains(lowered, F.lit(name.lower()))).over(doc) for name in P.FALLBACK_LABELS]
    label = F.coalesce(*[F.when(found, F.lit(name)) for name, found in zip(P.FALLBACK_LABELS, positions, strict=True)])
    return (
        rows.withColumn("structure_warnings", listed)
        .withColumn("fallback_label", label)
        .withColumn("forced", has & (forced_family | (few & late)))
        .withColumn("partial", F.arrays_overlap("structure_warnings", F.array(*map(F.lit, partial))))
        .withColumn(
            "route",
            F.when(~F.col("filled"), "empty")
            .when(F.col("forced"), "unstructured")
            .when(has, "structured")
            .when(F.col("fallback_label").isNotNull(), "recovered")
            .otherwise("unstructured"),
        )
        .withColumn(
            "structure_status",
            F.when(F.col("route") == "empty", "empty_source")
            .when(F.col("route") != "structured", "unstructured_fallback")
            .when(F.col("partial"), "partial")
            .otherwise("structured"),
        )
        .drop("_number", "_drop")
    )


_FLAGS = (
    "route", "structure_status", "structure_warnings", "family", "fallback_label", "article_count", "repaired_count", "suspected_count",
)


def segments(documents: DataFrame, text: str = "cleaned_text", placed: bool = False) -> DataFrame:
    """One row per legal unit, uncovered run or fallback document (UDT-03..05).

    ``documents`` needs doc_id and the text; ``attributes`` (any struct) and
    ``family`` are optional and kept per document.
    """
    if "attributes" not in documents.columns:
        documents = documents.withColumn("attributes", F.lit(None).cast("struct<title:string>"))
    if "family" not in documents.columns:
        documents = documents.withColumn("family", F.lit("unknown"))
    parsed = structure.parse(documents, text, ("attributes", "family"), placed)
    rows = _doc_flags(parsed)
    up = Window.partitionBy("doc_id").orderBy("seq")
    # end of the article that was opened last, for coverage of blank lines
    rows = rows.withColumn("_run", F.max(F.when(F.col("kind") == "article", F.col("seq"))).over(up))
    in_run = Window.partitionBy("doc_id", "_run")
    rows = rows.withColumn("_run_end", F.max(F.when(F.col("article_seq").isNotNull() & F.col("live"), F.col("end_line"))).over(in_run))
    rows = rows.withColumn("_covered", F.col("_run").isNotNull() & (F.col("n") <= F.col("_run_end")))
    same_line = Window.partitionBy("doc_id").orderBy("seq")
    rows = rows.withColumn("_final", F.coalesce(F.lead("n").over(same_line) != F.col("n"), F.lit(True)))
    rows = rows.withColumn("_open", F.col("_final") & ~F.col("_covered"))
    # a heading pair on one physical line is covered when its second half is
    rows = rows.withColumn("_gap_start", F.col("_open") & ~F.coalesce(F.lag("_open").over(same_line), F.lit(False)))
    rows = rows.withColumn("_gap", F.sum(F.col("_gap_start").cast("int")).over(up))
    structured = F.col("route") == "structured"
    unit = structured & F.col("live") & F.col("article_seq").isNotNull() & (F.col("kind") != "appendix")
    gap = structured & F.col("_open")
    whole = ~structured & (F.col("seq") % 2 == 0)

    def member(condition: Column, kind: str, order: Column, **keys: Column) -> Column:
        blank = F.lit(None).cast("int")
        return F.when(
            condition,
            F.struct(
                F.lit(kind).alias("segment"),
                keys.get("article", blank).alias("article_seq"),
                keys.get("clause", blank).alias("clause_seq"),
                keys.get("point", blank).alias("point_seq"),
                keys.get("gap", F.lit(None).cast("long")).alias("gap"),
                order.alias("piece"),
            ),
        )

    members = F.array_compact(
        F.array(
            member(unit, "unit", F.concat("text", F.lit("\n")), article=F.col("article_seq"), clause=F.col("clause_seq"), point=F.col("point_seq")),
            member(gap, "gap", F.concat("line", F.lit("\n")), gap=F.col("_gap").cast("long")),
            member(whole, "document", F.col("piece")),
        )
    )
    exploded = rows.withColumn("m", F.explode_outer(members)).where(F.col("m").isNotNull()).drop("article_seq", "clause_seq", "point_seq", "piece")
    keys = ["doc_id", F.col("m.segment"), F.col("m.article_seq"), F.col("m.clause_seq"), F.col("m.point_seq"), F.col("m.gap")]
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("m.piece").alias("piece")))), lambda e: e["piece"]), ""
    )
    is_clause_heading = F.col("seq") == F.col("m.clause_seq")
    grouped = exploded.groupBy(*keys).agg(
        F.regexp_replace(body, "\n$", "").alias("content"),
        F.min("seq").alias("seq"),
        F.min("n").alias("start_line"),
        F.max("end_line").alias("end_line"),
        F.count_if(tx.strip(F.col("line")) != "").alias("filled_lines"),
        F.max(F.when(is_clause_heading, F.col("title"))).alias("clause_title"),
        *[F.max(c).alias(c) for c in ("chapter", "section", "article", "clause", "point", "chapter_heading", "section_heading")],
        *[F.first(c, ignorenulls=True).alias(c) for c in _FLAGS],
        F.first("attributes", ignorenulls=True).alias("attributes"),
    )
    doc = Window.partitionBy("doc_id")
    return grouped.withColumn("attributes", F.first("attributes", ignorenulls=True).over(doc.orderBy("start_line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def units(segment_rows: DataFrame) -> DataFrame:
    """Segments with ids, unit texts and, on its first unit, each parent's text.

    Label-only clauses are merged into their first point; a clause keeps a unit
    of its own when it has a title or further lines.
    """
    in_clause = Window.partitionBy("doc_id", "segment", "article_seq", "clause_seq").orderBy("seq")
    whole_clause = Window.partitionBy("doc_id", "segment", "article_seq", "clause_seq")
    whole_article = Window.partitionBy("doc_id", "segment", "article_seq", "gap")
    ordered_article = whole_article.orderBy("seq")
    is_unit = F.col("segment") == "unit"
    is_clause = is_unit & F.col("clause_seq").isNotNull() & F.col("point_seq").isNull()
    rows = segment_rows.withColumn("_direct", F.col("clause_title").isNotNull() | F.col("content").contains("\n"))
    rows = rows.withColumn("_label_only", is_clause & ~F.col("_direct") & (F.count("point_seq").over(whole_clause) > 0))
    rows = rows.withColumn("_label", F.lag(F.when(F.col("_label_only"), F.col("content"))).over(in_clause))
    rows = rows.withColumn("_has_clauses", F.max(F.col("clause_seq")).over(whole_article).isNotNull())
    full = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "content")).over(whole_article)), lambda e: e["content"]), "\n"
    )
    rows = rows.withColumn("_place", F.row_number().over(ordered_article))
    rows = rows.withColumn("_full", F.when(F.col("_place") == 1, full))
    base = F.coalesce("doc_slug", F.lit("unknown")) if "doc_slug" in rows.columns else F.col("doc_id").cast("string")
    plain_parent = (
        F.when(is_unit, F.concat(base, F.lit("_article_"), label_id(F.col("article"))))
        .when(F.col("segment") == "gap", F.concat(base, F.lit("_document_context_"), F.col("gap").cast("string")))
        .when(F.col("route") == "empty", F.concat(base, F.lit("_empty_source")))
        .when(F.col("route") == "recovered", F.concat(base, F.lit("_fallback")))
        .otherwise(F.concat(base, F.lit("_document")))
    )
    rows = rows.withColumn("_parent", plain_parent)
    # repeated article numbers: occurrence counted over distinct articles (W-06)
    same_id = Window.partitionBy("doc_id", "_parent").orderBy("article_seq")
    rows = rows.withColumn("_occurrence", F.dense_rank().over(same_id))
    parent_id = F.when(
        is_unit & (F.col("_occurrence") > 1), F.concat("_parent", F.lit("_occurrence_"), F.col("_occurrence").cast("string"))
    ).otherwise(F.col("_parent"))
    rows = rows.withColumn("parent_id", parent_id)
    suffix = (
        F.when(~is_unit & (F.col("route") == "empty"), "_placeholder")
        .when(~is_unit, "")
        .when(F.col("clause_seq").isNull(), F.when(F.col("_has_clauses"), "_intro").otherwise("_body"))
        .when(F.col("point_seq").isNull(), F.concat(F.lit("_clause_"), label_id(F.col("clause"))))
        .otherwise(F.concat(F.lit("_clause_"), label_id(F.col("clause")), F.lit("_point_"), label_id(F.col("point"))))
    )
    headings = F.concat_ws("\n", F.nullif(F.trim("chapter_heading"), F.lit("")), F.nullif(F.trim("section_heading"), F.lit("")))
    with_headings = lambda body: F.when(headings != "", F.concat_ws("\n", headings, tx.strip(body))).otherwise(tx.strip(body))
    own = F.concat_ws("\n", tx.strip(F.col("_label")), F.col("content"))
    title = F.col("attributes.title")
    shown = tx.collapse_space(F.translate(F.coalesce(title, F.concat(F.lit("context "), F.col("doc_id").cast("string"))), "_-", "  "))
    placeholder = F.concat(F.lit("Tên văn bản: "), shown)
    unit_text = (
        F.when(F.col("route") == "empty", placeholder)
        .when(is_unit & F.col("clause_seq").isNull(), with_headings(F.col("content")))
        .otherwise(own)
    )
    parent_text = (
        F.when(F.col("route") == "empty", placeholder)
        .when(is_unit, with_headings(F.col("_full")))
        .otherwise(tx.strip(F.col("_full")))
    )
    kind = (
        F.when(is_unit, "article")
        .when(F.col("segment") == "gap", "document_context")
        .when(F.col("route") == "empty", "empty_source_placeholder")
        .otherwise("unstructured_fallback")
    )
    return (
        rows.withColumn("chunk_base", F.concat("parent_id", suffix))
        .withColumn("unit_text", F.when(~F.col("_label_only"), unit_text))
        .withColumn("parent_text", F.when(F.col("_place") == 1, parent_text))
        .withColumn("structure_type", kind)
        .where((F.col("segment") != "gap") | (tx.strip(F.col("content")) != ""))
        .select(
            "doc_id", "parent_id", "chunk_base", "unit_text", "parent_text", "structure_type", "seq", "segment", "start_line", "end_line",
            "filled_lines", "attributes", "chapter", "section", "article", "clause", "point", "chapter_heading", "section_heading", *_FLAGS,
        )
    )


def chunk_records(
    documents: DataFrame,
    text: str = "cleaned_text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    placed: bool = False,
) -> DataFrame:
    """Parents and chunks of every document as one stream of records.

    Rows are placed by document where a UDF has let go of their placement, once
    after the slugs and once after packing; so ``placed``, for documents that
    are placed by id already, makes no difference.

    ``record`` is ``parent`` or ``chunk``; write it partitioned by that column
    to get both tables in a single pass.
    """
    count = pieces(documents)
    ready = place(documents.withColumn("_slug", safe_id(F.col("doc_id").cast("string"))), "doc_id", count)
    attributes = [c for c in ("title", "source", "law_name", "effective_date") if c in documents.columns]
    fields = [F.col(c).cast("string").alias(c) for c in attributes]
    fields += [F.lit(None).cast("string").alias(c) for c in ("title", "source", "law_name", "effective_date") if c not in attributes]
    ready = ready.withColumn("attributes", F.struct(*fields, F.col("_slug").alias("slug")))
    keep = ["doc_id", text, "attributes"] + (["family"] if "family" in documents.columns else [])
    parsed = units(segments(ready.select(*keep), text, placed=True).withColumn("doc_slug", F.col("attributes.slug")))
    recovered = F.col("route") == "recovered"
    paragraphs = F.when(recovered, tx.paragraphs(F.col("unit_text"))).otherwise(F.array("unit_text"))
    spread = parsed.select("*", F.posexplode_outer(paragraphs).alias("para", "para_text"))
    # a recovered paragraph that fits keeps its own white space
    fits = recovered & (tx.token_count(F.col("para_text")) <= size)
    parts = F.when(fits, F.array("para_text")).otherwise(packed(F.col("para_text"), size, overlap))
    parted = spread.withColumn("parts", F.when(F.col("unit_text").isNotNull(), parts).otherwise(F.array().cast("array<string>")))
    label = lambda name: F.when(F.col(name).isNotNull(), F.concat_ws(" ", F.lit(structure.LABELS[name]), F.col(name)))
    is_article = F.col("structure_type") == "article"
    row = parted.select(
        "doc_id", "parent_id", "chunk_base", "structure_type", "structure_status", "structure_warnings", "family", "seq", "para",
        "article_count", "repaired_count", "suspected_count", "route", "attributes",
        F.when(is_article, label("chapter")).alias("chapter"),
        F.when(is_article, label("section")).alias("section"),
        F.when(is_article, label("article")).when(recovered, F.col("fallback_label")).alias("article"),
        F.when(is_article, label("clause")).alias("clause"),
        F.when(is_article, label("point")).alias("point"),
        F.size("parts").alias("n_parts"),
        F.explode_outer(
            F.concat(
                F.when(F.col("parent_text").isNotNull() & (F.col("para") == 0), F.array(F.struct(F.lit("parent").alias("record"), F.lit(0).alias("part"), F.col("parent_text").alias("text"))))
                .otherwise(F.array().cast("array<struct<record:string,part:int,text:string>>")),
                F.transform("parts", lambda t, i: F.struct(F.lit("chunk").alias("record"), (i + 1).alias("part"), t.alias("text"))),
            )
        ).alias("r"),
    ).where(F.col("r").isNotNull()).select("*", "r.*").drop("r")
    row = place(row, "doc_id", count)  # packing forgot where the rows were; both numberings use this placement
    is_chunk = F.col("record") == "chunk"
    always_numbered = F.col("structure_type").isin("document_context", "unstructured_fallback")
    number = F.row_number().over(Window.partitionBy("doc_id", "record", "parent_id", "chunk_base").orderBy("seq", "para", "part"))
    row = row.withColumn("_number", number)
    candidate = (
        F.when(always_numbered, F.concat("chunk_base", F.lit("_part_"), F.col("_number").cast("string")))
        .when(F.col("n_parts") > 1, F.concat("chunk_base", F.lit("_part_"), F.col("part").cast("string")))
        .otherwise(F.col("chunk_base"))
    )
    row = row.withColumn("_candidate", F.when(is_chunk, candidate))
    nth = F.row_number().over(Window.partitionBy("doc_id", "record", "_candidate").orderBy("seq", "part"))
    row = row.withColumn("_nth", nth)
    chunk_id = F.when(F.col("_nth") > 1, F.concat("_candidate", F.lit("_occurrence_"), F.col("_nth").cast("string"))).otherwise(F.col("_candidate"))
    law = F.coalesce("attributes.law_name", "attributes.title")
    return row.select(
        "record", "doc_id", "parent_id", F.when(is_chunk, chunk_id).alias("chunk_id"), "text", law.alias("law_name"),
        "chapter", "section", "article",
        F.when(is_chunk, F.col("clause")).alias("clause"), F.when(is_chunk, F.col("point")).alias("point"),
        F.col("attributes.effective_date").alias("effective_date"), F.col("attributes.source").alias("source"),
        "structure_type", "structure_status", "structure_warnings", "family", "route", "article_count", "repaired_count", "suspected_count",
        F.length("text").alias("char_count"), tx.token_count(F.col("text")).alias("token_count"),
        F.col("seq").alias("position"), "part",
    )
