"""Readers of question files, predictions, chunks, folds and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexatlas.functions import text as tx
from lexatlas.operators.audit import valid_identifier
from lexatlas.operators.metrics import coverage
from lexatlas.sources.entries import RANGE_BYTES, read_entries, unique_keys

HIT = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("law_name", T.StringType()),
        T.StructField("article", T.StringType()),
        T.StructField("clause", T.StringType()),
        T.StructField("dense_score", T.DoubleType()),
        T.StructField("sparse_score", T.DoubleType()),
        T.StructField("hybrid_score", T.DoubleType()),
        T.StructField("rerank_score", T.DoubleType()),
        T.StructField("final_score", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
PREDICTION = T.StructType(
    [
        T.StructField("question_id", T.StringType()),
        T.StructField("hits", T.ArrayType(HIT)),
        T.StructField("answer", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
    ]
)
CHUNK = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "chunk_id", "parent_id", "doc_id", "text", "parent_text", "law_name", "chapter", "section", "article", "clause", "point",
        "effective_date", "source",
    )]
    + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)


def _strict(frame: DataFrame, condition, message: str) -> DataFrame:
    """Fail the job on the first row that breaks a rule."""
    return frame.where(F.assert_true(condition, F.lit(message)).isNull())


def _whole(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("wholetext", "true").text(path).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    # parse_json refuses repeated keys and non-finite numbers
    return text.where(F.parse_json("value").isNotNull())


def read_question_map(spark: SparkSession, path: str, answers: str = "array<string>") -> DataFrame:
    """``{id: {question, answer}}`` files (SRC-13, SRC-15, SRC-16).

    ``answers`` is the answer type: ``array<string>`` for retrieval, ``string``
    for question answering.
    """
    parsed = _whole(spark, path).select(F.from_json("value", f"map<string,struct<question:string,answer:{answers}>>").alias("m"))
    return _checked_questions(parsed.select(F.explode("m").alias("qid", "r")).select("qid", "r.question", "r.answer"), answers)


def read_question_map_by_ranges(spark: SparkSession, path: str, answers: str = "array<string>", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """As :func:`read_question_map`, for large files: each is cut at its entries and read by many tasks.

    Repeated ids are refused by a grouping, repeated fields inside an entry by
    the parser of its value.
    """
    rows = unique_keys(read_entries(spark, path, range_bytes)).where(F.parse_json("value").isNotNull())
    parsed = rows.select(F.col("key").alias("qid"), F.from_json("value", f"struct<question:string,answer:{answers}>").alias("r"))
    return _checked_questions(parsed.select("qid", "r.question", "r.answer"), answers)


def _checked_questions(rows: DataFrame, answers: str) -> DataFrame:
    checked = _strict(rows, valid_identifier(F.col("qid")) & (tx.strip(F.col("question")) != ""), "invalid question record")
    if answers.startswith("array"):
        return _strict(
            checked, (F.size("answer") > 0) & (F.size(F.array_distinct("answer")) == F.size("answer")), "answers must be unique and not empty"
        )
    return checked


def gold_rows(questions: DataFrame) -> DataFrame:
    """(qid, doc_id) rows of a retrieval question map."""
    return questions.select("qid", F.explode("answer").alias("doc_id"))


def read_question_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids from a mapping, an id array or an object array (SRC-14, M-29)."""
    raw = _whole(spark, path).withColumn("shape", F.schema_of_variant(F.parse_json("value")))
    mapping = F.map_keys(F.from_json(F.when(F.col("shape").startswith("OBJECT"), F.col("value")), "map<string,string>"))
    plain = F.from_json(F.when(F.col("shape") == "ARRAY<STRING>", F.col("value")), "array<string>")
    objects = F.transform(F.from_json(F.when(F.col("shape").startswith("ARRAY<OBJECT"), F.col("value")), "array<struct<id:string>>"), lambda o: o["id"])
    ids = raw.select(F.explode(F.coalesce(mapping, plain, objects)).alias("qid"))
    return _strict(ids, valid_identifier(F.col("qid")), "invalid question id")


def read_records(spark: SparkSession, path: str, schema: str | T.StructType, container: str | None = None) -> DataFrame:
    """JSON lines, an array file or ``{container: [...]}`` (SRC-12)."""
    options = {"mode": "FAILFAST", "allowNonNumericNumbers": "false"}
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).options(**options).json(path)
    if container is None:
        return spark.read.schema(schema).options(**options, multiLine="true").json(path)
    ddl = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">")
    inner = f"array<struct<{ddl}>>" if ":" in ddl.split(",")[0] else f"array<{T.StructType.fromDDL(ddl).simpleString()}>"
    wrapped = _whole(spark, path).select(F.from_json(F.get_json_object("value", f"$.{container}"), inner).alias("r"))
    return wrapped.select(F.inline("r"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Hits with their ranks (SRC-18); explicit ranks must equal positions (V-06)."""
    rows = read_records(spark, path, PREDICTION)
    unique = F.size(F.array_distinct(F.transform("hits", lambda h: h["chunk_id"]))) == F.size("hits")
    checked = _strict(rows, valid_identifier(F.col("question_id")) & (F.size("hits") > 0) & unique, "invalid prediction row")
    hits = checked.select(F.col("question_id").alias("qid"), F.posexplode("hits").alias("at", "h")).select(
        "qid", (F.col("at") + 1).alias("position"), "h.*"
    )
    ranked = _strict(hits, F.coalesce(F.col("rank") == F.col("position"), F.lit(True)), "rank differs from position")
    return ranked.withColumn("rank", F.col("position")).drop("position")


def read_chunks(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid chunks and rejected lines; ``#`` lines are comments (SRC-09).

    ``limit`` is the caller's own head limit (TK-09).
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).where((tx.strip(F.col("value")) != "") & ~tx.strip(F.col("value")).startswith("#"))
    parsed = lines.select("value", F.col("_metadata.file_path").alias("path"), F.from_json("value", CHUNK).alias("c"), F.try_parse_json("value").alias("v"))
    ok = F.col("v").isNotNull() & valid_identifier(F.col("c.chunk_id")) & valid_identifier(F.col("c.doc_id")) & (F.coalesce(tx.strip(F.col("c.text")), F.lit("")) != "")
    good = parsed.where(ok).select("c.*")
    bad = parsed.where(~ok).select("path", F.col("value").alias("line"))
    return (good if limit is None else good.orderBy("chunk_id").limit(limit)), bad


def read_rankings(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Cached rankings of several named sources in one table (SRC-19)."""
    if not sources:
        raise ValueError("name at least one ranking source")
    schema = T.StructType([T.StructField("question_id", T.StringType()), T.StructField("id", T.StringType()), T.StructField("hits", T.ArrayType(HIT)), T.StructField("documents", T.ArrayType(T.StringType()))])

    def one(order: int, name: str, path: str) -> DataFrame:
        rows = read_records(spark, path, schema).withColumn("qid", F.coalesce("question_id", "id"))
        entries = F.coalesce("hits", F.transform("documents", lambda d: F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "doc_id" else d.alias("doc_id") for f in HIT])))
        hits = rows.select("qid", F.posexplode(entries).alias("at", "h"))
        warned = F.lower(F.concat_ws(" ", F.col("h.metadata")["structure_warnings"], F.col("h.metadata")["review_reasons"]))
        return hits.select(
            "qid", F.trim("h.doc_id").alias("doc_id"), F.lit(name.strip().lower()).alias("source"), F.lit(order).alias("source_order"),
            F.coalesce("h.rank", F.col("at") + 1).alias("rank"),
            F.coalesce("h.rerank_score", "h.final_score", "h.dense_score", "h.score").alias("score"),
            F.coalesce(F.trim("h.text"), F.lit("")).alias("text"),
            F.coalesce("h.law_name", F.col("h.metadata")["law_name"], F.lit("")).alias("law_name"),
            warned.contains("ambiguous").alias("ambiguous"),
        ).where(F.col("doc_id") != "")

    return reduce(DataFrame.unionByName, [one(i, n, p) for i, (n, p) in enumerate(sources.items())])


def read_folds(spark: SparkSession, path: str, schema_version: str) -> DataFrame:
    """(qid, fold) rows of a fold file of the expected version (M-24)."""
    fields = "struct<schema_version:string,folds:array<struct<fold:int,validation_ids:array<string>>>>"
    payload = _whole(spark, path).select(F.from_json("value", fields).alias("p"))
    checked = _strict(payload, F.col("p.schema_version") == schema_version, "unexpected fold file version")
    rows = checked.select(F.inline("p.folds")).select("fold", F.explode("validation_ids").alias("qid"))
    return rows.groupBy("qid").agg(F.min("fold").alias("fold"), F.count(F.lit(1)).alias("n")).where(
        F.assert_true(F.col("n") == 1, F.lit("question listed in two folds")).isNull()
    ).drop("n")


def require_coverage(expected: DataFrame, actual: DataFrame, report: str | None = None) -> DataFrame:
    """All ids by which two sets differ (F-14); raises with some of them if there are any.

    ``report`` is a path that gets the complete list before.
    """
    problems = coverage(expected, actual)
    if report is not None:
        problems.write.mode("overwrite").parquet(report)
    some = problems.orderBy("problem", "id").take(10)
    if some:
        raise ValueError("ids differ, among them " + "; ".join(f"{row['problem']}: {row['id']}" for row in some))
    return problems


def pending(selected: DataFrame, completed: DataFrame) -> DataFrame:
    """Questions still to do when a run is resumed (J-11, M-25)."""
    return selected.join(completed.select("qid").distinct(), "qid", "left_anti")


def read_ranking_inputs(spark: SparkSession, path: str) -> DataFrame:
    """(qid, position, doc_id) of rankings or references in any of their shapes (M-08).

    One file may hold ``{id: {answer: [...]}}``, ``{id: [...]}`` or an array of
    ``{id | question_id, documents | gold_documents | answer | gold_document}``;
    JSON lines of such objects work, too. Entries are Variants, exploded where
    they are lists; unknown shapes, empty and repeated ids are refused.
    """
    text = _whole(spark, path) if not path.endswith(".jsonl") else spark.read.text(path).where(tx.strip(F.col("value")) != "")
    raw = text.select(F.parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    lists = raw.where(kind.startswith("ARRAY")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.lit(None).cast("string").alias("key"), "value")
    objects = raw.where(kind.startswith("OBJECT"))
    single = F.try_variant_get("v", "$.id", "string").isNotNull() | F.try_variant_get("v", "$.question_id", "string").isNotNull()
    lines = objects.where(single).select(F.lit(None).cast("string").alias("key"), F.col("v").alias("value"))
    mapping = objects.where(~single).lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("key", "value")
    entries = lists.unionByName(lines).unionByName(mapping)

    def got(place: str, to: str):
        return F.try_variant_get("value", place, to)

    named = F.coalesce("key", got("$.id", "string"), got("$.question_id", "string"))
    several = F.coalesce(*[got(place, "array<string>") for place in ("$", "$.documents", "$.gold_documents", "$.answer")])
    one = got("$.gold_document", "string")
    documents = F.coalesce(several, F.when(one.isNotNull(), F.array(one)))
    rows = entries.select(named.alias("qid"), F.filter(documents, lambda d: d.isNotNull()).alias("documents"))
    unique = F.size(F.array_distinct("documents")) == F.size("documents")
    checked = _strict(rows, valid_identifier(F.col("qid")) & F.col("documents").isNotNull() & unique, "invalid ranking entry")
    once = checked.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.first("documents").alias("documents"))
    sound = _strict(once, F.col("n") == 1, "question listed twice")
    return sound.select("qid", F.posexplode("documents").alias("at", "doc_id")).select("qid", (F.col("at") + 1).alias("position"), "doc_id")


def select_candidates(rankings: DataFrame, questions: DataFrame, folds: DataFrame | None = None, fold: int | None = None, head: int | None = None) -> DataFrame:
    """Rankings of the questions that an analysis is about (M-10): of a fold, the first ``head`` by id, and covered.

    The selected questions must all be ranked; what is missing is found by an
    anti-join and refused with examples. Rankings of other questions are left out.
    """
    chosen = questions.select("qid").distinct()
    if fold is not None:
        if folds is None:
            raise ValueError("a fold needs the fold table")
        chosen = chosen.join(folds.where(F.col("fold") == fold).select("qid"), "qid", "left_semi")
    if head is not None:
        chosen = chosen.orderBy("qid").limit(head)
    missing = [r["qid"] for r in chosen.join(rankings.select("qid").distinct(), "qid", "left_anti").orderBy("qid").take(5)]
    if missing:
        raise ValueError(f"questions without a ranking, among them {missing}")
    return rankings.join(chosen, "qid", "left_semi")
