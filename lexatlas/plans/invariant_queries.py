"""Queries over the invariants of predictions, folds, corpora and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexatlas.operators import invariants, metrics
from lexatlas.plans import inputs
from lexatlas.plans.registry import query


def hits(spark, folder):
    """Labels as questions whose prediction is their document, vectors as questions for the document of the same id."""
    labels = inputs.table(spark, folder, "labels").select(F.col("quality").cast("long").alias("qid"), "doc_id")
    return labels.unionByName(inputs.table(spark, folder, "embeddings").select(F.col("label").cast("long").alias("qid"), F.col("vec_id").alias("doc_id")))


_HITS = "hits AS (SELECT quality::BIGINT AS qid, doc_id FROM labels UNION ALL SELECT label::BIGINT, vec_id FROM embeddings)"


def english(spark, folder):
    return inputs.table(spark, folder, "documents").where("lang = 'en'").select("doc_id")


@query("predictions_outside_corpus", f"WITH {_HITS} SELECT DISTINCT qid, doc_id FROM hits WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def predictions_outside_corpus(spark, folder):
    return invariants.outside_corpus(hits(spark, folder), english(spark, folder))


@query("ranking_gaps", f"""
WITH {_HITS}, c AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en'), r AS (SELECT DISTINCT qid, doc_id FROM hits)
SELECT qid, (SELECT count(*) FROM c) - count(c.doc_id) AS missing FROM r LEFT JOIN c USING (doc_id) GROUP BY qid HAVING missing > 0""")
def ranking_gaps(spark, folder):
    return invariants.ranking_gaps(hits(spark, folder), english(spark, folder))


@query("fold_merge_problems", f"""
WITH {_HITS}, p AS (SELECT doc_id AS id, count(*) AS n FROM hits GROUP BY doc_id), e AS (SELECT DISTINCT doc_id AS id FROM documents)
SELECT id, CASE WHEN n IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'unexpected' ELSE 'duplicate' END AS problem
FROM (SELECT id, n, id AS pid FROM p) p FULL JOIN e USING (id) WHERE n IS NULL OR e.id IS NULL OR n > 1""")
def fold_merge_problems(spark, folder):
    parts = hits(spark, folder).select(F.col("doc_id").alias("id"), F.col("qid").alias("part"))
    return invariants.fold_merge_problems(parts, inputs.table(spark, folder, "documents").select(F.col("doc_id").alias("id")))


@query("stem_difference", r"""
WITH s AS (SELECT DISTINCT starts_with(url, 'https:') AS secure, regexp_extract(url, '([^/\\?#]*?)(?:\.[^./\\?#]*)?(?:[?#].*)?$', 1) AS stem FROM pages)
SELECT stem, CASE WHEN bool_or(secure) THEN 'left' ELSE 'right' END AS side FROM s GROUP BY stem HAVING count(*) = 1""")
def stem_difference(spark, folder):
    """File stems of secure and of plain pages that the other kind lacks."""
    pages = inputs.table(spark, folder, "pages").select(F.col("url").alias("path"))
    secure = F.col("path").startswith("https:")
    return invariants.stem_difference(pages.where(secure), pages.where(~secure))


@query("metadata_mismatches", """
SELECT 'lang' AS field, 0::BIGINT AS mismatches UNION ALL SELECT 'n_chars', count(*) FILTER (WHERE n_chars IS DISTINCT FROM strlen(text)) FROM documents
UNION ALL SELECT 'source', count(*) FILTER (WHERE source IS NOT NULL) FROM documents""")
def metadata_mismatches(spark, folder):
    """Flat columns against a copy that has the language, counts bytes and lacks the source."""
    rows = inputs.table(spark, folder, "documents")
    copy = F.create_map(F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.octet_length("text").cast("string"))
    return invariants.metadata_mismatches(rows.withColumn("metadata", copy), ("lang", "n_chars", "source"))


@query("context_counts", """
WITH d AS (SELECT text, doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AS orphan FROM documents), k AS (SELECT orphan, text, count(*) AS n FROM d GROUP BY ALL)
SELECT sum(n)::BIGINT AS physical, count(*) FILTER (WHERE NOT orphan)::BIGINT AS "unique", sum(n - 1) FILTER (WHERE NOT orphan)::BIGINT AS exact_duplicates, sum(n) FILTER (WHERE orphan)::BIGINT AS orphans, true AS adds_up FROM k""")
def context_counts(spark, folder):
    """Documents without a label are the orphans."""
    labelled = inputs.table(spark, folder, "labels").select("doc_id", F.lit(False).alias("orphan")).distinct()
    files = inputs.table(spark, folder, "documents").join(labelled, "doc_id", "left")
    return invariants.context_counts(files, "doc_id", F.col("text"), F.col("orphan"))


@query("report_mismatches", "SELECT 'toxic' AS name, 0.5::DOUBLE AS reported, avg(toxic) AS actual FROM labels UNION ALL SELECT 'quality', 2.0::DOUBLE, avg(quality) FROM labels")
def report_mismatches(spark, folder):
    return invariants.report_mismatches({"toxic": 0.5, "quality": 2.0}, inputs.table(spark, folder, "labels"))


@query("latency_violations", """
SELECT 'events' AS name, unnest(['mean_ms', 'median_ms']) AS "check" FROM (SELECT count(*) FROM events) WHERE (SELECT sum(value) > max(value) FROM events WHERE value >= 0)""")
def latency_violations(spark, folder):
    """A summary whose mean and median were replaced by the total."""
    found = metrics.latency_summary(inputs.table(spark, folder, "events"), "value").withColumn("source", F.lit("events"))
    broken = found.withColumn("mean_ms", F.col("total_ms")).withColumn("median_ms", F.col("total_ms"))
    return invariants.latency_violations(broken, "source").select(F.col("source").alias("name"), F.col("name").alias("check"))


@query("canonical_fingerprints", """
SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"meta":{"a_source":"' || source || '","z_lang":"' || lang || '"},"n_chars":' || n_chars || '}') AS fingerprint FROM documents""")
def canonical_fingerprints(spark, folder):
    """The same digest for any order of fields."""
    meta = F.struct(F.col("lang").alias("z_lang"), F.col("source").alias("a_source"))
    rows = inputs.table(spark, folder, "documents").select("doc_id", F.struct("n_chars", meta.alias("meta"), "doc_id").alias("record"))
    return rows.select("doc_id", F.sha2(invariants.canonical_json(rows, "record"), 256).alias("fingerprint"))


@query("review_documents", "SELECT l.doc_id, 'toxic' AS reason, d.source, length(d.text)::BIGINT AS chars FROM labels l LEFT JOIN documents d USING (doc_id) WHERE l.toxic = 1")
def review_documents(spark, folder):
    reviews = inputs.table(spark, folder, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("reason"))
    texts = inputs.table(spark, folder, "documents").select("doc_id", "source", F.length("text").cast("long").alias("chars"))
    return invariants.review_documents(reviews, texts, "toxic")
