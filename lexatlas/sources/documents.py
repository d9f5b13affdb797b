"""Readers of source documents: JSON, JSON lines, plain text, optional PDF and DOCX."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexatlas.functions import text as tx
from lexatlas.functions.unicode import document_slug

# Accepted field names, first match wins.
ID_FIELDS = ("doc_id", "document_id", "id", "code")
TITLE_FIELDS = ("title", "document_title", "law_name", "name")
DATE_FIELDS = ("issue_date", "issued_date", "publication_date", "date")
CONTENT_FIELDS = ("passage", "raw_text", "content", "text", "body", "document_text")
CORPUS_FILES = "context_*.json"


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(_file_name(path), r"\.[^.]*$", "")


@F.pandas_udf(T.StringType())
def _decode_json(content: pd.Series) -> pd.Series:
    """First of UTF-8 (with or without BOM), UTF-16, UTF-32 that decodes."""

    def one(raw: bytes) -> str | None:
        for encoding in ("utf-8-sig", "utf-16", "utf-32"):
            try:
                return raw.decode(encoding)
            except UnicodeDecodeError:
                continue
        return None

    return content.map(one)


@F.pandas_udf(T.StringType())
def _decode_text(content: pd.Series) -> pd.Series:
    """UTF-8 if valid, else a detected charset if a detector is present."""

    def one(raw: bytes) -> str:
        try:
            return raw.decode("utf-8-sig")
        except UnicodeDecodeError:
            pass
        try:
            from charset_normalizer import from_bytes

            best = from_bytes(raw).best()
            if best is not None:
                return str(best)
        except ImportError:
            pass
        return raw.decode("cp1258", errors="replace")

    return content.map(one)


def _lower_keys(record: Column) -> Column:
    return F.transform_keys(record, lambda k, v: F.lower(k))


def _first_filled(record: Column, names: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(tx.strip(record[n]) != "", tx.strip(record[n])) for n in names])


def _first_present(record: Column, names: Sequence[str]) -> Column:
    chain = F.lit(None).cast("string")
    for name in reversed(names):
        chain = F.when(F.map_contains_key(record, F.lit(name)), F.coalesce(record[name], F.lit(""))).otherwise(chain)
    return chain


def from_records(rows: DataFrame, record: str = "record", path: str = "path", raw: str = "raw", line: str | None = None) -> DataFrame:
    """Documents from string maps of JSON objects (SRC-03).

    Ids, titles and dates take the first filled alias; content takes the first
    alias that is present, even when empty.
    """
    r = _lower_keys(F.col(record))
    given = _first_filled(r, ID_FIELDS)
    stem = _stem(F.col(path))
    fallback = stem if line is None else F.concat(stem, F.lit("_line_"), F.col(line).cast("string"))
    content = _first_present(r, CONTENT_FIELDS)
    return rows.select(
        document_slug(F.coalesce(given, fallback)).alias("doc_id"),
        F.col(path).alias("source_path"),
        (F.lit(0) if line is None else F.col(line)).cast("long").alias("source_line"),
        _first_filled(r, TITLE_FIELDS).alias("title"),
        F.coalesce(content, F.col(raw)).alias("raw_text"),
        F.lit("json").alias("file_format"),
        _first_filled(r, DATE_FIELDS).alias("issue_date"),
        _first_filled(r, ("link",)).alias("source_link"),
        _first_filled(r, ("name",)).alias("source_name"),
        (F.coalesce(tx.strip(content), F.lit("x")) == "").alias("source_content_empty"),
    )


def _parsed(rows: DataFrame, raw: str) -> DataFrame:
    """Adds ``record`` (first object of a list root) and ``valid``."""
    trimmed = tx.strip(F.col(raw))
    one = F.from_json(F.when(trimmed.startswith("{"), F.col(raw)), "map<string,string>")
    # elements of a list stay JSON text, so one that is no object does no harm
    items = F.from_json(F.when(trimmed.startswith("["), F.col(raw)), "array<string>")
    first = F.get(F.filter(items, lambda item: tx.strip(item).startswith("{")), F.lit(0))
    return rows.withColumns(
        {
            "valid": F.try_parse_json(F.col(raw)).isNotNull(),
            "record": F.coalesce(one, F.from_json(first, "map<string,string>")),
        }
    )


def read_json(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """One document per JSON file and the files that failed (SRC-01, SRC-07, SRC-08)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    rows = _parsed(files.select("path", _decode_json("content").alias("raw")), "raw")
    good = rows.where("valid and record is not null")
    bad = rows.where("not (valid and record is not null)").select("path", F.lit("invalid JSON document").alias("error"))
    return from_records(good), bad


def read_jsonl(spark: SparkSession, path: str, glob: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """One document per line; blank lines skipped, bad lines reported (SRC-02)."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    rows = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"),
    )
    parsed = _parsed(number_lines(rows).where(tx.strip(F.col("raw")) != ""), "raw")
    good = parsed.where("valid and record is not null")
    bad = parsed.where("not (valid and record is not null)").select("path", F.lit("invalid JSON line").alias("error"))
    return from_records(good, line="line_no"), bad


def number_lines(rows: DataFrame) -> DataFrame:
    """Line numbers inside each file without reading a file in one task.

    Lines of one split are consecutive, so a split needs only its line count;
    the offsets are a running sum over splits, a table of one row per split.
    """
    splits = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    joined = rows.join(offsets, ["path", "block"])
    return joined.withColumn("line_no", F.col("offset") + F.col("at") - F.col("first") + 1).drop("block", "at", "first", "offset")


def read_text(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Plain text files; the title is the first filled line (SRC-04)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    rows = files.select("path", _decode_text("content").alias("raw"))
    return _plain(rows, "txt")


def _plain(rows: DataFrame, file_format: str) -> DataFrame:
    first = F.get(F.filter(F.transform(tx.lines(F.col("raw")), tx.strip), lambda line: line != ""), F.lit(0))
    return rows.select(
        document_slug(_stem(F.col("path"))).alias("doc_id"), F.col("path").alias("source_path"), F.lit(0).cast("long").alias("source_line"), first.alias("title"),
        F.col("raw").alias("raw_text"), F.lit(file_format).alias("file_format"), F.lit(None).cast("string").alias("issue_date"),
        F.lit(None).cast("string").alias("source_link"), F.lit(None).cast("string").alias("source_name"),
        (tx.strip(F.col("raw")) == "").alias("source_content_empty"),
    )


def read_pdf(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """PDF text without the top and bottom tenth of each page (SRC-05); needs pdfplumber."""
    try:
        import pdfplumber  # noqa: F401
    except ImportError as missing:
        raise RuntimeError("reading PDF needs pdfplumber on every executor") from missing

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pdfplumber

        for frame in frames:
            texts = []
            for raw in frame["content"]:
                with pdfplumber.open(io.BytesIO(raw)) as document:
                    pages = [p.crop((0, p.height * 0.1, p.width, p.height * 0.9)).extract_text() or "" for p in document.pages]
                texts.append("\n\f\n".join(pages))
            yield pd.DataFrame({"path": frame["path"], "raw": texts})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    rows = files.select("path", "content").mapInPandas(extract, "path string, raw string")
    return _plain(rows, "pdf").withColumn("needs_ocr", F.col("source_content_empty"))


def read_docx(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """DOCX paragraphs and tables in order, cells tab-joined (SRC-06); needs python-docx."""
    try:
        import docx  # noqa: F401
    except ImportError as missing:
        raise RuntimeError("reading DOCX needs python-docx on every executor") from missing

    def blocks(container) -> Iterator[str]:
        for item in container.iter_inner_content():
            if hasattr(item, "rows"):
                for row in item.rows:
                    yield "\t".join("\n".join(blocks(cell)) for cell in row.cells)
            elif item.text.strip():
                yield item.text

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import docx

        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "raw": ["\n".join(blocks(docx.Document(io.BytesIO(raw)))) for raw in frame["content"]]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return _plain(files.select("path", "content").mapInPandas(extract, "path string, raw string"), "docx")


def read_directory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All JSON, JSON-line and text documents below a folder (SRC-07).

    Ids found more than once are reported; identical copies are kept once.
    """
    json_docs, json_bad = read_json(spark, path)
    line_docs, line_bad = read_jsonl(spark, path)
    documents = json_docs.unionByName(line_docs).unionByName(read_text(spark, path))
    return resolve_duplicates(documents, json_bad.unionByName(line_bad).unionByName(unread_files(spark, path)))


def unread_files(spark: SparkSession, path: str) -> DataFrame:
    """An error row for every file of a type that the directory reader leaves alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    read = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("json", "jsonl", "txt")
    return files.where(~read).select("path", F.lit("unsupported file type").alias("error"))


def resolve_duplicates(documents: DataFrame, errors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Keep identical copies once; conflicting copies of an id are errors (SET-06).

    The first copy by path and line stays, one row per id; others that differ
    from it are reported. Only hashes travel to the grouping.
    """
    content = [c for c in documents.columns if c not in ("source_path", "source_line")]
    digest = F.sha2(F.to_json(F.struct(*sorted(content))), 256)
    place = F.struct(*[c for c in ("source_path", "source_line") if c in documents.columns])
    marked = documents.withColumn("_hash", digest)
    first = marked.groupBy("doc_id").agg(F.min(F.struct(place.alias("place"), F.col("_hash").alias("hash"))).alias("_first"))
    joined = marked.join(first, "doc_id")
    is_first = place == F.col("_first.place")
    kept = joined.where(is_first).drop("_hash", "_first", "source_line")
    conflicts = joined.where(~is_first & (F.col("_hash") != F.col("_first.hash"))).select(
        F.col("source_path").alias("path"), F.concat(F.lit("conflicting duplicate id: "), F.col("doc_id")).alias("error")
    )
    return kept, conflicts if errors is None else errors.unionByName(conflicts)
