"""Queries over cleaning, hierarchy, chunks, validation and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexatlas.functions import patterns as P
from lexatlas.operators import audit, chunking, cleaning, structure
from lexatlas.plans import inputs
from lexatlas.plans.registry import query
from lexatlas.plans.text_queries import TOKEN


def _re2(pattern: str) -> str:
    """Java spelling of a fixed pattern to the SQL engine's."""
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''")



def _atomic(column: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{_re2(p)}')" for p in (P.BARE_NUMBER, P.COMPACT_NUMBER, P.ONLY_SYMBOLS)) + ")"


CLEANED = rf"""
raw AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
line AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(x, '^(\s*)[{P.BULLETS}]\s*', '\1- '), '[\t\p{{Z}}]+', ' ', 'g')) AS l FROM raw),
kept AS (SELECT doc_id, i, l, lag(l) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM line WHERE l <> '' AND NOT regexp_matches(l, '{_re2(P.PAGE_NUMBER)}')),
joined AS (SELECT doc_id, i, l, p IS NOT NULL AND NOT regexp_matches(l, '{_re2(P.STRUCTURE_LINE)}') AND NOT {_atomic('l')} AND NOT {_atomic('p')} AND NOT regexp_matches(p, '[.;:?!]$') AS j FROM kept),
piece AS (SELECT doc_id, i, CASE WHEN lead(j) OVER w THEN regexp_replace(l, '-+$', '') || CASE WHEN l LIKE '%-' AND regexp_matches(lead(l) OVER w, '^\p{{Ll}}') THEN '' ELSE ' ' END ELSE l || chr(10) END AS t, j FROM joined WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
cleaned AS (SELECT d.doc_id, coalesce(trim(string_agg(t, '' ORDER BY i), ' ' || chr(10)), '') AS cleaned_text, count(*) FILTER (WHERE j)::BIGINT AS merged FROM documents d LEFT JOIN piece USING (doc_id) GROUP BY d.doc_id)"""


@query("clean_documents", f"""
WITH {CLEANED} SELECT doc_id, sha256(cleaned_text) AS text_hash, length(cleaned_text)::BIGINT AS n_chars FROM cleaned""")
def clean_documents(spark, folder):
    cleaned = cleaning.clean_documents(inputs.documents(spark, folder))
    return cleaned.select("doc_id", F.sha2("cleaned_text", 256).alias("text_hash"), F.length("cleaned_text").cast("long").alias("n_chars"))


@query("hard_wrap_decisions", f"WITH {CLEANED} SELECT doc_id, merged FROM cleaned")
def hard_wrap_decisions(spark, folder):
    states = cleaning.line_states(inputs.documents(spark, folder))
    return states.groupBy("doc_id").agg(F.count_if("joins").alias("merged"))


def paged(spark, folder):
    """Conversations as documents: one page per turn under a running header."""
    page = F.concat(F.lit("Record of Conversation\nPage "), (F.col("turn") + 1).cast("string"), F.lit("\n"), "text")
    ordered = F.array_sort(F.collect_list(F.struct("turn", page.alias("page"))))
    turns = inputs.table(spark, folder, "conversations")
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(ordered, lambda e: e["page"]), "\f").alias("text"))


@query("page_edges_removed", r"""
WITH n AS (SELECT conv_id AS doc_id, count(*) AS pages FROM conversations GROUP BY conv_id)
SELECT doc_id, pages::BIGINT AS page_markers, (CASE WHEN pages > 1 THEN pages - 1 ELSE 0 END)::BIGINT AS repeated_headers FROM n""")
def page_edges_removed(spark, folder):
    states = cleaning.line_states(paged(spark, folder))
    return states.groupBy("doc_id").agg(
        F.count_if(F.col("reason") == "explicit_page_marker").alias("page_markers"),
        F.count_if((F.col("reason") == "repeated_page_edge_duplicate") & (F.col("line") == "Record of Conversation")).alias("repeated_headers"),
    )


@query("removal_audit")
def removal_audit(spark, folder):
    return audit.removal_audit(cleaning.clean_documents(paged(spark, folder)))


# Lines of the derived statutes with the structure their position implies.
STATUTE_LINES = r"""
src AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS a FROM documents),
line AS (SELECT doc_id, source, len(a) AS n, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS x FROM src),
sl AS (SELECT doc_id, source, n, i, i // 20 + 1 AS ch, i // 5 + 1 AS art, CASE WHEN i % 20 = 0 THEN 'chapter' WHEN i % 5 = 1 THEN 'article' WHEN i % 5 = 2 THEN 'clause' WHEN i % 5 = 3 THEN 'point' ELSE 'text' END AS kind,
  CASE WHEN i % 20 = 0 THEN 'Chương ' || (i // 20 + 1) WHEN i % 5 = 1 THEN 'Điều ' || (i // 5 + 1) || '. ' || x WHEN i % 5 = 2 THEN '1. ' || x WHEN i % 5 = 3 THEN 'a) ' || x ELSE '~ ' || x END AS t FROM line),
parts AS (SELECT doc_id, source, n, i, kind, t, ch, CASE WHEN kind = 'chapter' THEN NULL WHEN i % 5 = 0 THEN art - 1 ELSE art END AS a FROM sl)"""


def parsed(spark, folder):
    return structure.parse(inputs.statutes(spark, folder))


@query("structure_entries", f"""
WITH {STATUTE_LINES} SELECT doc_id, i + 1 AS line_number, kind AS level, CASE kind WHEN 'chapter' THEN ch::VARCHAR WHEN 'article' THEN a::VARCHAR WHEN 'clause' THEN '1' ELSE 'a' END AS identifier FROM parts WHERE kind <> 'text'""")
def structure_entries(spark, folder):
    return structure.entries(parsed(spark, folder)).select("doc_id", F.col("line_number").cast("long").alias("line_number"), "level", "identifier")


@query("structure_nodes", f"""
WITH {STATUTE_LINES},
m AS (SELECT doc_id, 'chapter' AS level, ch AS k, i, t FROM parts UNION ALL SELECT doc_id, 'article', a, i, t FROM parts WHERE a IS NOT NULL
  UNION ALL SELECT doc_id, 'clause', a, i, t FROM parts WHERE a IS NOT NULL AND kind <> 'article' UNION ALL SELECT doc_id, 'point', a, i, t FROM parts WHERE a IS NOT NULL AND kind NOT IN ('article', 'clause'))
SELECT doc_id, level, min(i) + 1 AS start_line, max(i) + 1 AS end_line, sha256(string_agg(t, chr(10) ORDER BY i)) AS text_hash FROM m GROUP BY doc_id, level, k""")
def structure_nodes(spark, folder):
    nodes = structure.nodes(parsed(spark, folder))
    return nodes.select("doc_id", "level", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.sha2("text", 256).alias("text_hash"))


@query("structure_level_counts", f"""
WITH {STATUTE_LINES} SELECT kind AS level, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS documents FROM parts WHERE kind <> 'text' GROUP BY kind""")
def structure_level_counts(spark, folder):
    rows = parsed(spark, folder).where(F.col("live") & F.col("kind").isin(*structure.LEVELS))
    return rows.groupBy(F.col("kind").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


def records(spark, folder):
    return chunking.chunk_records(inputs.statutes(spark, folder))


STATUTE_PARENTS = STATUTE_LINES + """,
parents AS (SELECT doc_id, doc_id || '_article_' || a AS parent_id, 'article' AS structure_type, 'Chương ' || any_value(ch) || chr(10) || string_agg(t, chr(10) ORDER BY i) AS body FROM parts WHERE a IS NOT NULL GROUP BY doc_id, a
  UNION ALL SELECT doc_id, doc_id || '_document_context_' || ch, 'document_context', t FROM parts WHERE kind = 'chapter' AND n > 1
  UNION ALL SELECT doc_id, doc_id || '_document', 'unstructured_fallback', t FROM parts WHERE n = 1
  UNION ALL SELECT doc_id, doc_id || '_empty_source', 'empty_source_placeholder', 'Tên văn bản: context ' || doc_id FROM src WHERE len(a) = 0)"""


@query("statute_parents", f"WITH {STATUTE_PARENTS} SELECT doc_id, parent_id, structure_type, sha256(body) AS text_hash FROM parents")
def statute_parents(spark, folder):
    return records(spark, folder).where("record = 'parent'").select("doc_id", "parent_id", "structure_type", F.sha2("text", 256).alias("text_hash"))


@query("statute_units", f"""
WITH {STATUTE_LINES}, u AS (SELECT doc_id, a, CASE WHEN kind = 'article' THEN 1 WHEN kind = 'clause' THEN 2 ELSE 3 END AS part, t, i, ch FROM parts WHERE a IS NOT NULL),
c AS (SELECT doc_id, a, max(part) AS deepest FROM u GROUP BY doc_id, a)
SELECT u.doc_id, u.doc_id || '_article_' || u.a || CASE part WHEN 1 THEN CASE WHEN deepest > 1 THEN '_intro' ELSE '_body' END WHEN 2 THEN '_clause_1' ELSE '_clause_1_point_a' END AS chunk_base,
 sha256(CASE WHEN part = 1 THEN 'Chương ' || any_value(ch) || chr(10) ELSE '' END || string_agg(t, chr(10) ORDER BY i)) AS text_hash FROM u JOIN c USING (doc_id, a) GROUP BY u.doc_id, u.a, part, deepest""")
def statute_units(spark, folder):
    rows = chunking.units(chunking.segments(inputs.statutes(spark, folder).select("doc_id", "cleaned_text")))
    return rows.where("structure_type = 'article' and unit_text is not null").select("doc_id", "chunk_base", F.sha2("unit_text", 256).alias("text_hash"))


@query("chunk_statutes")
def chunk_statutes(spark, folder):
    return records(spark, folder).where("record = 'chunk'").select("doc_id", "chunk_id", "parent_id", "structure_type", "token_count", "text")


@query("chunk_documents")
def chunk_documents(spark, folder):
    """Cleaning, routing and chunking in one placement of the corpus."""
    cleaned = cleaning.clean_documents(inputs.documents(spark, folder), carry=("source",))
    rows = chunking.chunk_records(cleaned)
    return rows.where("record = 'chunk'").select("doc_id", "chunk_id", "parent_id", "structure_type", "structure_status", "token_count", "text")


@query("chunk_coverage", "SELECT 0::BIGINT AS missing_tokens, 0::BIGINT AS missing_bigrams")
def chunk_coverage(spark, folder):
    """Every source token and in-line bigram survives in chunks and parents."""
    source = inputs.statutes(spark, folder)
    return audit.coverage_totals(source, records(spark, folder))


_LOSSY = rf"""
src AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN}')) AS item FROM documents), kid AS (SELECT doc_id, unnest(regexp_extract_all(array_to_string(list_distinct(string_split(text, chr(10))), chr(10)), '{TOKEN}')) AS item FROM documents),
s AS (SELECT doc_id, item, count(*) AS source FROM src GROUP BY ALL), k AS (SELECT doc_id, item, count(*) AS child FROM kid GROUP BY ALL)"""


@query("coverage_loss_by_token", f"""
WITH {_LOSSY} SELECT doc_id, item, (source - coalesce(child, 0))::BIGINT AS missing FROM s LEFT JOIN k USING (doc_id, item) WHERE source > coalesce(child, 0)""")
def coverage_loss_by_token(spark, folder):
    """Chunks that drop repeated lines: the lost occurrences are found."""
    docs = inputs.documents(spark, folder).select("doc_id", F.col("text").alias("cleaned_text"))
    deduped = F.array_join(F.array_distinct(F.split("cleaned_text", "\n")), "\n")
    kinds = F.explode(F.array(F.struct(F.lit("chunk").alias("record"), deduped.alias("text")), F.struct(F.lit("parent").alias("record"), F.col("cleaned_text").alias("text"))))
    lossy = docs.select("doc_id", kinds.alias("r")).select("doc_id", "r.*")
    return audit.coverage_mismatch(docs, lossy).select("doc_id", "item", "missing")


@query("structure_type_histogram", f"""
WITH {STATUTE_PARENTS}, one AS (SELECT structure_type, count(DISTINCT doc_id)::BIGINT AS documents FROM parents GROUP BY 1) SELECT structure_type, documents FROM one""")
def structure_type_histogram(spark, folder):
    return audit.structure_types(records(spark, folder)).select("structure_type", "documents")


@query("validation_report")
def validation_report(spark, folder):
    return audit.validation_report(inputs.statutes(spark, folder), records(spark, folder)).drop("quality_gate_failures")


@query("corpus_audit")
def corpus_audit(spark, folder):
    cleaned = cleaning.clean_documents(inputs.documents(spark, folder), carry=("source",)).withColumn("law_name", F.col("source")).persist()
    rows = chunking.chunk_records(cleaned)
    gold = inputs.gold(spark, folder)
    audited = audit.corpus_audit(cleaned, rows, gold)
    return audited.withColumns({c: F.array_join(c, ",") for c in ("integrity_failures", "semantic_issues")})


_BUCKET = "('0x' || sha256(parent_id)[1:6])::BIGINT % 10"


def damaged(spark, folder):
    """Records whose parents lost a tenth and whose chunks lost another tenth."""
    rows = records(spark, folder)
    bucket = F.conv(F.substring(F.sha2("parent_id", 256), 1, 6), 16, 10).cast("long") % 10
    return rows.where(~((F.col("record") == "parent") & (bucket == 0)) & ~((F.col("record") == "chunk") & (bucket == 1)))


@query("orphan_anti_join", f"WITH {STATUTE_PARENTS} SELECT parent_id FROM parents WHERE {_BUCKET} = 0")
def orphan_anti_join(spark, folder):
    return audit.orphan_chunks(damaged(spark, folder)).select("parent_id").distinct()


@query("unreferenced_anti_join", f"WITH {STATUTE_PARENTS} SELECT parent_id, sha256(body) AS text_hash FROM parents WHERE {_BUCKET} = 1")
def unreferenced_anti_join(spark, folder):
    return audit.unreferenced_parents(damaged(spark, folder).select("record", "parent_id", "text")).select("parent_id", F.sha2("text", 256).alias("text_hash"))


@query("gold_missing_documents", """
WITH g AS (SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT count(*)::BIGINT AS gold_occurrences, count(DISTINCT doc_id) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS missing_gold_documents, 0::BIGINT AS empty_gold_documents FROM g""")
def gold_missing_documents(spark, folder):
    """Labelled documents as the corpus the gold answers are checked against."""
    corpus = inputs.table(spark, folder, "labels").select(F.lit("chunk").alias("record"), "doc_id", F.lit("article").alias("structure_type"))
    return audit.gold_audit(inputs.gold(spark, folder), corpus)


@query("law_name_inference", r"""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS a FROM documents)
SELECT doc_id, list_filter(a, lambda x: regexp_matches(x, '[A-ZÀ-ỴĐ]') AND upper(x) = x AND regexp_matches(x, '\p{Lu}'))[1] AS law_name FROM l""")
def law_name_inference(spark, folder):
    return inputs.documents(spark, folder).select("doc_id", structure.law_name(F.col("text"), F.lit(None).cast("string")).alias("law_name"))
