"""Queries over metrics, diagnostics, folds, bootstrap and negative mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexatlas.functions import text as tx
from lexatlas.operators import folds, metrics, mining, ranking, setjoin
from lexatlas.plans import inputs
from lexatlas.plans.registry import query
from lexatlas.plans.retrieval_queries import _FUSED, AGGREGATED, HITS, RERANKED, final_ranking
from lexatlas.plans.text_queries import GROUPED, TURNS, WORD

GOLD = "gold AS (SELECT DISTINCT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
FINAL = RERANKED + "," + _FUSED.format(where="", limit=5) + "," + GOLD
_PER_QUERY = """
pred AS (SELECT qid, doc_id, rank FROM {pred}),
per_query AS (SELECT qid, n_gold, n_predicted, CASE WHEN n_predicted <= 5 THEN n_matched ELSE 0 END AS n_matched,
  CASE WHEN n_predicted <= 5 THEN n_matched / n_gold ELSE 0.0 END AS recall, CASE WHEN n_predicted BETWEEN 1 AND 5 THEN n_matched / n_predicted ELSE 0.0 END AS precision,
  coalesce(1.0::DOUBLE / first_rank, 0.0) AS reciprocal_rank, (coalesce(first_rank, 99) <= 3)::INT AS hit_at_3
 FROM (SELECT g.qid, count(*) AS n_gold, count(p.rank) AS n_matched, min(p.rank) AS first_rank, coalesce(any_value(c.n), 0) AS n_predicted FROM gold g LEFT JOIN pred p USING (qid, doc_id)
   LEFT JOIN (SELECT qid, count(*) AS n FROM pred GROUP BY qid) c ON c.qid = g.qid GROUP BY g.qid))"""
PER_QUERY = FINAL + "," + _PER_QUERY.format(pred="final")
_SUMMARY = """count(*)::BIGINT AS sample_count, round(avg(recall), 9) AS recall, round(avg(precision), 9) AS precision, round(avg(reciprocal_rank), 9) AS mrr, round(avg(hit_at_3), 9) AS hit_at_3,
 count(*) FILTER (WHERE n_gold > 1)::BIGINT AS multi_gold_sample_count, round(avg(recall) FILTER (WHERE n_gold > 1), 9) AS multi_gold_recall"""


def per_query_rows(spark, folder):
    return metrics.per_query(inputs.gold(spark, folder), final_ranking(spark, folder))


@query("gold_documents", f"WITH {GOLD} SELECT qid, doc_id FROM gold")
def gold_documents(spark, folder):
    return inputs.gold(spark, folder)


@query("per_query_recall_precision", f"""
WITH {PER_QUERY} SELECT qid, n_gold, n_predicted, n_matched, round(recall, 9) AS recall, round(precision, 9) AS precision, round(reciprocal_rank, 9) AS reciprocal_rank, hit_at_3 FROM per_query""")
def per_query_recall_precision(spark, folder):
    return per_query_rows(spark, folder).withColumns({c: F.round(c, 9) for c in ("recall", "precision", "reciprocal_rank")})


@query("macro_recall_precision", f"WITH {PER_QUERY} SELECT {_SUMMARY} FROM per_query")
def macro_recall_precision(spark, folder):
    return metrics.summary(per_query_rows(spark, folder))


@query("official_length_guard", f"WITH {FINAL}, {_PER_QUERY.format(pred='bm25 WHERE rank <= 6')} SELECT {_SUMMARY} FROM per_query")
def official_length_guard(spark, folder):
    """Six documents are one too many: every question scores zero."""
    six = inputs.bm25_ranking(spark, folder).where("rank <= 6")
    return metrics.summary(metrics.per_query(inputs.gold(spark, folder), six))


_OWN = HITS + ", owngold AS (SELECT vec_id AS qid, label::BIGINT AS doc_id FROM embeddings), docs AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY min(rank), doc_id) AS rank FROM hits GROUP BY qid, doc_id)"


def own_gold(spark, folder):
    """Single gold per vector query: the document of the vector itself."""
    rows = inputs.table(spark, folder, "embeddings")
    return rows.select(F.col("vec_id").alias("qid"), F.col("label").cast("long").alias("doc_id"))


@query("single_gold_reciprocal_rank", f"""
WITH {_OWN} SELECT g.qid, round(coalesce(1.0::DOUBLE / rank, 0), 9) AS reciprocal_rank, (coalesce(rank, 99) <= 3)::INT AS hit_at_3 FROM owngold g LEFT JOIN docs USING (qid, doc_id)""")
def single_gold_reciprocal_rank(spark, folder):
    ranked = ranking.first_occurrence(inputs.vector_hits(spark, folder))
    rows = metrics.single_gold(own_gold(spark, folder), ranked)
    return rows.withColumn("reciprocal_rank", F.round("reciprocal_rank", 9))


@query("recall_at_k", f"""
WITH {RERANKED}, {GOLD}, g AS (SELECT g.qid, k, count(*) AS n, count(r.rank) FILTER (WHERE r.rank <= k) AS hit FROM gold g LEFT JOIN bm25 r USING (qid, doc_id), (VALUES (1),(5),(10),(20),(50),(100)) v(k) GROUP BY g.qid, k)
SELECT k, round(avg(hit / n), 9) AS recall FROM g GROUP BY k""")
def recall_at_k(spark, folder):
    return metrics.recall_at_k(inputs.gold(spark, folder), inputs.bm25_ranking(spark, folder), (1, 5, 10, 20, 50, 100))


_MULTI = HITS + ", multigold AS (SELECT vec_id AS qid, label::BIGINT AS doc_id FROM embeddings UNION SELECT vec_id, ((label + 1 + vec_id % 3) % 10)::BIGINT FROM embeddings WHERE vec_id % 2 = 0)"


def multi_gold(spark, folder):
    """One or two gold documents per vector query."""
    rows = inputs.table(spark, folder, "embeddings")
    second = rows.where("vec_id % 2 = 0").select(
        F.col("vec_id").alias("qid"), ((F.col("label") + 1 + F.col("vec_id") % 3) % 10).cast("long").alias("doc_id")
    )
    return own_gold(spark, folder).unionByName(second)


DEPTHS = (1, 5, 10, 20)


@query("candidate_depth_metrics", f"""
WITH {_MULTI}, best AS (SELECT qid, doc_id, min(rank) AS rank FROM hits GROUP BY ALL), size AS (SELECT qid, count(*) AS pool FROM hits GROUP BY qid),
g AS (SELECT g.qid, k, count(*) AS n, count(*) FILTER (WHERE b.rank <= k) AS hit FROM multigold g LEFT JOIN best b USING (qid, doc_id), (VALUES (1),(5),(10),(20)) v(k) GROUP BY g.qid, k),
u AS (SELECT qid, k, count(*) FILTER (WHERE rank <= k) AS docs FROM best, (VALUES (1),(5),(10),(20)) v(k) GROUP BY qid, k)
SELECT k, round(avg(hit / n), 9) AS recall, round(avg(docs), 9) AS unique_docs, count(*) FILTER (WHERE pool >= k)::BIGINT AS complete_queries, round(avg(hit / n) FILTER (WHERE n > 1), 9) AS multi_gold_recall,
 count(*) FILTER (WHERE n > 1 AND hit = n)::BIGINT AS multi_gold_covered FROM g JOIN u USING (qid, k) JOIN size USING (qid) GROUP BY k""")
def candidate_depth_metrics(spark, folder):
    return metrics.candidate_depths(multi_gold(spark, folder), inputs.vector_hits(spark, folder), DEPTHS)


@query("diagnostic_rows", f"""
WITH {FINAL}, a AS (SELECT coalesce(g.qid, f.qid) AS qid, coalesce(g.doc_id, f.doc_id) AS doc_id, g.doc_id IS NOT NULL AS is_gold, f.rank FROM gold g FULL JOIN final f ON g.qid = f.qid AND g.doc_id = f.doc_id)
SELECT qid, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FILTER (WHERE is_gold AND rank IS NOT NULL), '') AS matched,
 coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) FILTER (WHERE is_gold AND rank IS NULL), '') AS missed,
 coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FILTER (WHERE NOT is_gold), '') AS unexpected FROM a GROUP BY qid""")
def diagnostic_rows(spark, folder):
    rows = metrics.diagnostics(inputs.gold(spark, folder), final_ranking(spark, folder))
    joined = lambda c: F.array_join(F.transform(c, lambda d: d.cast("string")), ",").alias(c)
    return rows.select("qid", joined("matched"), joined("missed"), joined("unexpected"))


@query("gold_first_ranks", f"""
WITH {_MULTI}, d AS (SELECT qid, doc_id, min(rank) AS chunk_rank, row_number() OVER (PARTITION BY qid ORDER BY min(rank), doc_id) AS document_rank FROM hits GROUP BY qid, doc_id)
SELECT g.qid, g.doc_id, chunk_rank, document_rank FROM multigold g LEFT JOIN d USING (qid, doc_id)""")
def gold_first_ranks(spark, folder):
    return metrics.gold_ranks(multi_gold(spark, folder), inputs.vector_hits(spark, folder))


@query("gold_rank_summary", f"""
WITH {_MULTI}, d AS (SELECT qid, doc_id, min(rank) AS chunk_rank, row_number() OVER (PARTITION BY qid ORDER BY min(rank), doc_id) AS document_rank FROM hits GROUP BY qid, doc_id),
r AS (SELECT g.qid, chunk_rank, document_rank FROM multigold g LEFT JOIN d USING (qid, doc_id))
SELECT count(*)::BIGINT AS gold_document_count, count(*) FILTER (WHERE chunk_rank IS NULL)::BIGINT AS missing_count, count(DISTINCT qid) FILTER (WHERE chunk_rank IS NULL)::BIGINT AS queries_with_missing,
 round(avg(chunk_rank), 9) AS mean_chunk_rank, quantile_cont(chunk_rank::DOUBLE, 0.5) AS median_chunk_rank, round(avg(document_rank), 9) AS mean_document_rank, quantile_cont(document_rank::DOUBLE, 0.5) AS median_document_rank FROM r""")
def gold_rank_summary(spark, folder):
    return metrics.rank_summary(metrics.gold_ranks(multi_gold(spark, folder), inputs.vector_hits(spark, folder)))


_BUCKETS = _MULTI + """, top AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY best, doc_id) AS dr FROM (SELECT qid, doc_id, min(rank) AS best FROM hits GROUP BY ALL) QUALIFY dr <= 2),
cand AS (SELECT DISTINCT qid, doc_id, 1 AS c FROM hits), b AS (SELECT g.qid, count(*)::BIGINT AS n_gold, count(c)::BIGINT AS in_candidates, count(t.dr)::BIGINT AS in_final FROM multigold g LEFT JOIN cand USING (qid, doc_id) LEFT JOIN top t USING (qid, doc_id) GROUP BY g.qid),
buckets AS (SELECT *, CASE WHEN in_candidates = 0 THEN 'retrieval_miss' WHEN n_gold > 1 AND in_final > 0 AND in_final < n_gold THEN 'multi_gold_partial' WHEN in_final = 0 THEN 'candidate_present_final_miss' ELSE 'success' END AS bucket FROM b)"""


def buckets(spark, folder):
    hits = inputs.vector_hits(spark, folder)
    return metrics.failure_buckets(multi_gold(spark, folder), hits, ranking.first_occurrence(hits, 2))


@query("failure_buckets", f"WITH {_BUCKETS} SELECT qid, n_gold, in_candidates, in_final, bucket FROM buckets")
def failure_buckets(spark, folder):
    return buckets(spark, folder)


@query("failure_bucket_counts", f"WITH {_BUCKETS} SELECT bucket, count(*)::BIGINT AS n FROM buckets GROUP BY bucket")
def failure_bucket_counts(spark, folder):
    return buckets(spark, folder).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("absent_dropped_gold", f"""
WITH {_BUCKETS} SELECT sum(n_gold - in_candidates)::BIGINT AS gold_absent, sum(greatest(in_candidates - in_final, 0))::BIGINT AS gold_dropped FROM buckets""")
def absent_dropped_gold(spark, folder):
    return metrics.absent_and_dropped(buckets(spark, folder))


@query("depth_recommendation", f"""
WITH {_BUCKETS}, best AS (SELECT qid, doc_id, min(rank) AS rank FROM hits GROUP BY ALL), g AS (SELECT g.qid, count(*) AS n, count(b.rank) AS hit FROM multigold g LEFT JOIN best b USING (qid, doc_id) GROUP BY g.qid),
r AS (SELECT round(avg(hit / n), 9) AS recall FROM g), m AS (SELECT count(*) FILTER (WHERE bucket = 'retrieval_miss')::BIGINT AS retrieval_miss FROM buckets)
SELECT recall, 20 AS depth, retrieval_miss, CASE WHEN recall < 0.98 OR retrieval_miss > 0 THEN 'recommended_for_gpu_probe' ELSE 'not_priority_from_current_evidence' END AS decision FROM r, m""")
def depth_recommendation(spark, folder):
    depths = metrics.candidate_depths(multi_gold(spark, folder), inputs.vector_hits(spark, folder), DEPTHS)
    return metrics.depth_recommendation(depths, buckets(spark, folder))


@query("aggregation_method_comparison", f"""
WITH {AGGREGATED}, multigold AS (SELECT vec_id AS qid, label::BIGINT AS doc_id FROM embeddings UNION SELECT vec_id, ((label + 1 + vec_id % 3) % 10)::BIGINT FROM embeddings WHERE vec_id % 2 = 0),
p AS (SELECT g.qid, m.method, count(*) AS n, count(a.rank) AS hit, any_value(c.n) AS npred FROM multigold g CROSS JOIN (SELECT DISTINCT method FROM aggregated) m LEFT JOIN (SELECT * FROM aggregated WHERE rank <= 5) a ON a.qid = g.qid AND a.doc_id = g.doc_id AND a.method = m.method
 JOIN (SELECT qid, method, count(*) AS n FROM aggregated WHERE rank <= 5 GROUP BY ALL) c ON c.qid = g.qid AND c.method = m.method GROUP BY g.qid, m.method)
SELECT method, round(avg(hit / n), 9) AS recall, round(avg(hit / npred), 9) AS precision, round(avg(hit / n) FILTER (WHERE n > 1), 9) AS multi_gold_recall FROM p GROUP BY method""")
def aggregation_method_comparison(spark, folder):
    """All seven methods scored in one pass: the method is part of the question key."""
    top = ranking.aggregate_documents(inputs.vector_hits(spark, folder), limit=5)
    keyed = lambda frame: frame.withColumn("qid", F.concat_ws("|", "method", "qid"))
    methods = F.explode(F.array(*map(F.lit, ranking.AGGREGATION_METHODS))).alias("method")
    gold = keyed(multi_gold(spark, folder).select("qid", "doc_id", methods))
    rows = metrics.per_query(gold, keyed(top)).withColumn("method", F.substring_index("qid", "|", 1))
    return rows.groupBy("method").agg(
        F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("precision"), 9).alias("precision"),
        F.round(F.avg(F.when(F.col("n_gold") > 1, F.col("recall"))), 9).alias("multi_gold_recall"),
    )


@query("id_coverage", """
SELECT coalesce(d.doc_id, l.doc_id) AS id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'unexpected' END AS problem FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def id_coverage(spark, folder):
    return metrics.coverage(inputs.documents(spark, folder).select("doc_id"), inputs.table(spark, folder, "labels"), "doc_id")


@query("latency_summary", """
SELECT count(*)::BIGINT AS count, round(sum(value), 4) AS total_ms, min(value) AS min_ms, max(value) AS max_ms, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS median_ms,
 round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms FROM events WHERE value >= 0""")
def latency_summary(spark, folder):
    return metrics.latency_summary(inputs.table(spark, folder, "events"), "value")


@query("report_comparison", f"""
WITH {FINAL}, {_PER_QUERY.format(pred='bm25 WHERE rank <= 5')}, a AS (SELECT {_SUMMARY} FROM per_query),
pq2 AS (SELECT g.qid, count(*) AS n, count(f.rank) AS hit FROM gold g LEFT JOIN final f USING (qid, doc_id) GROUP BY g.qid),
b AS (SELECT round(avg(hit / n), 9) AS recall, round(avg(hit / 5.0::DOUBLE), 9) AS precision, round(avg(hit / n) FILTER (WHERE n > 1), 9) AS multi_gold_recall FROM pq2)
SELECT sample_count, a.recall AS before_recall, b.recall AS after_recall, round(b.recall - a.recall, 9) AS delta_recall, a.precision AS before_precision, b.precision AS after_precision, round(b.precision - a.precision, 9) AS delta_precision,
 a.multi_gold_recall AS before_multi_gold_recall, b.multi_gold_recall AS after_multi_gold_recall, round(b.multi_gold_recall - a.multi_gold_recall, 9) AS delta_multi_gold_recall FROM a, b""")
def report_comparison(spark, folder):
    gold = inputs.gold(spark, folder)
    found = inputs.bm25_ranking(spark, folder)
    before = metrics.summary(metrics.per_query(gold, found.where("rank <= 5")))
    return metrics.compare_summaries(before, metrics.summary(metrics.per_query(gold, final_ranking(spark, folder, base=found))))


# --------------------------------------------------------------------- folds

FOLDED_TURNS = f"""{TURNS}, {GROUPED}, folded AS (SELECT qid, group_key, (('0x' || sha256('2026:' || group_key)[1:12])::BIGINT % 5)::INT AS fold FROM grouped)"""


def hashed(spark, folder):
    return folds.hashed_folds(folds.with_group(inputs.turns(spark, folder)))


@query("grouped_folds_hash", f"WITH {FOLDED_TURNS} SELECT qid, fold FROM folded")
def grouped_folds_hash(spark, folder):
    return hashed(spark, folder).select("qid", "fold")


@query("training_folds", f"""
WITH {FOLDED_TURNS} SELECT qid, fold AS validation_fold, k::INT AS fold FROM folded, range(0, 5) r(k) WHERE k <> fold""")
def training_folds(spark, folder):
    return folds.training_folds(hashed(spark, folder))


@query("fold_statistics", f"""
WITH {FOLDED_TURNS}, p AS (SELECT fold, count(*)::BIGINT AS q, count(DISTINCT group_key)::BIGINT AS g FROM folded GROUP BY fold), t AS (SELECT sum(q)::BIGINT AS tq, sum(g)::BIGINT AS tg FROM p)
SELECT fold, q AS validation_questions, g AS validation_groups, tq - q AS training_questions, tg - g AS training_groups FROM p, t""")
def fold_statistics(spark, folder):
    return folds.fold_statistics(hashed(spark, folder))


@query("fold_violations", f"""
WITH {FOLDED_TURNS}, mixed AS (SELECT *, ('0x' || md5(qid)[1:8])::BIGINT AS h FROM folded), bad AS (SELECT qid, group_key, (fold + (h % 97 = 0)::INT) % 5 AS fold FROM mixed WHERE h % 11 <> 3)
SELECT 'missing_id' AS violation, qid::VARCHAR AS subject FROM turns WHERE qid NOT IN (SELECT qid FROM bad) UNION ALL
SELECT 'group_crosses_folds', group_key FROM bad GROUP BY group_key HAVING min(fold) <> max(fold)""")
def fold_violations(spark, folder):
    """A damaged assignment: ids missing, single members moved."""
    h = F.conv(F.substring(F.md5("qid"), 1, 8), 16, 10).cast("long")
    bad = hashed(spark, folder).where(h % 11 != 3).withColumn("fold", (F.col("fold") + (h % 97 == 0).cast("int")) % 5)
    return folds.fold_violations(bad, inputs.turns(spark, folder))


@query("grouped_folds_balanced", f"""
WITH RECURSIVE {FOLDED_TURNS}, o AS (
  SELECT group_key, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, sha256('2026:' || group_key), group_key) AS i FROM folded GROUP BY group_key
), s AS (
  SELECT 0::BIGINT AS i, '' AS group_key, 0 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS load, [0, 0, 0, 0, 0]::BIGINT[] AS held
  UNION ALL
  SELECT i, group_key, f, list_transform(range(0, 5), lambda k: load[k + 1] + CASE WHEN k = f THEN size ELSE 0 END), list_transform(range(0, 5), lambda k: held[k + 1] + CASE WHEN k = f THEN 1 ELSE 0 END)
  FROM (
    SELECT o.i, o.group_key, o.size, s.load, s.held, list_sort(list_transform(range(0, 5), lambda k: {{'a': s.load[k + 1], 'b': s.held[k + 1], 'c': k}}))[1].c::INT AS f
    FROM s JOIN o ON o.i = s.i + 1
  )
)
SELECT qid, s.fold FROM folded JOIN s USING (group_key) WHERE s.i > 0""")
def grouped_folds_balanced(spark, folder):
    return folds.balanced_folds(folds.with_group(inputs.turns(spark, folder))).select("qid", "fold")


@query("fold_recall", f"""
WITH {PER_QUERY}, folded AS (SELECT item_id AS qid, (('0x' || sha256('2026:' || trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')))[1:12])::BIGINT % 5)::INT AS fold FROM benchmark)
SELECT fold, count(*)::BIGINT AS sample_count, round(avg(recall), 9) AS recall, round(avg(precision), 9) AS precision FROM per_query JOIN folded USING (qid) GROUP BY fold""")
def fold_recall(spark, folder):
    assigned = folds.hashed_folds(folds.with_group(inputs.questions(spark, folder)))
    return metrics.fold_metrics(per_query_rows(spark, folder), assigned)


_DELTAS = _MULTI + """, docs AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY min(rank), doc_id) AS dr FROM hits GROUP BY qid, doc_id),
s AS (SELECT g.qid, count(*) FILTER (WHERE dr <= 3) / count(*) - count(*) FILTER (WHERE dr <= 1) / count(*) AS d FROM multigold g LEFT JOIN docs USING (qid, doc_id) GROUP BY g.qid)"""


def deltas(spark, folder):
    """Recall of three documents against one, grouped by the vector id's remainder.

    Both depths read one ranking, so the search is made once.
    """
    ranked = ranking.first_occurrence(inputs.vector_hits(spark, folder)).persist()
    gold = multi_gold(spark, folder)
    top = lambda k: metrics.per_query(gold, ranked.where(F.col("rank") <= k))
    grouped = own_gold(spark, folder).select("qid", (F.col("qid") % 171).cast("string").alias("group_key"))
    return folds.group_deltas(top(1), top(3), grouped)


@query("paired_group_deltas", f"""
WITH {_DELTAS} SELECT (qid % 171)::VARCHAR AS group_key, sum(d)::DOUBLE AS delta, count(*)::BIGINT AS n FROM s GROUP BY 1""")
def paired_group_deltas(spark, folder):
    return deltas(spark, folder)


_WORD = "18446744073709551616::UHUGEINT"


def _times(number: str, factor: int) -> str:
    """64-bit product in SQL."""
    return f"(({number})::UHUGEINT * {factor}::UHUGEINT % {_WORD})::UBIGINT"


_A, _B, _C, _D = folds.PICK_FACTORS
_PICKS = f"""
g AS (SELECT (qid % 171)::VARCHAR AS group_key, sum(d)::DOUBLE AS delta, count(*)::BIGINT AS n FROM s GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY group_key) - 1 AS i, count(*) OVER () AS units FROM g), u AS (SELECT max(units) AS units FROM o),
z0 AS (SELECT t.draw, (({folds.SEED}::UHUGEINT * {_A}::UHUGEINT % {_WORD} + t.draw::UHUGEINT * {_B}::UHUGEINT % {_WORD} + p.pick::UHUGEINT * {_D}::UHUGEINT % {_WORD}) % {_WORD})::UBIGINT AS z, units FROM u, range(0, {folds.DRAWS}) t(draw), range(0, (SELECT units FROM u)) p(pick)),
z1 AS (SELECT draw, units, {_times('xor(z, z >> 30)', folds.MIX_FACTORS[0])} AS z FROM z0), z2 AS (SELECT draw, units, {_times('xor(z, z >> 27)', folds.MIX_FACTORS[1])} AS z FROM z1),
drawn AS (SELECT draw, round(sum(delta) / sum(n), 12) AS m FROM (SELECT draw, (xor(z, z >> 31) % units)::BIGINT AS i FROM z2) JOIN o USING (i) GROUP BY draw)"""


@query("paired_bootstrap", f"""
WITH {_DELTAS}, {_PICKS}, r AS (SELECT avg((m > 0)::INT) AS probability_positive, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM drawn), b AS (SELECT sum(delta) / sum(n) AS observed_delta, count(*)::BIGINT AS group_count FROM g)
SELECT round(observed_delta, 9) AS observed_delta, group_count, round(probability_positive, 9) AS probability_positive, round(low, 9) AS low, round(high, 9) AS high, group_count >= 100 AND observed_delta > 0 AND probability_positive >= 0.7 AS passes_gate FROM r, b""")
def paired_bootstrap(spark, folder):
    report = folds.bootstrap_report(deltas(spark, folder))
    return report.select(F.round("observed_delta", 9).alias("observed_delta"), "group_count", *[F.round(c, 9).alias(c) for c in ("probability_positive", "low", "high")], "passes_gate")


# -------------------------------------------------------------------- mining

_TOKENS = f"list_distinct(list_filter(regexp_extract_all(replace(lower({{0}}), 'ß', 'ss'), '{WORD.replace('{', '{{').replace('}', '}}')}'), lambda t: length(t) > 1))"
_MINE = RERANKED + "," + GOLD + f""",
dset AS (SELECT doc_id, {_TOKENS.format('text')} AS tokens, source AS law FROM documents),
qset AS (SELECT item_id AS qid, {_TOKENS.format('text')} AS qtokens FROM benchmark),
cand AS (SELECT qid, doc_id, rank, score, 'bm25' AS source FROM bm25 UNION ALL SELECT qid, doc_id, rank, score, 'dense' FROM jac),
pos AS (SELECT DISTINCT g.qid, g.doc_id, d.tokens, d.law FROM gold g JOIN cand USING (qid, doc_id) JOIN dset d USING (doc_id)),
open_c AS (SELECT c.*, d.tokens, d.law FROM cand c ANTI JOIN gold USING (qid, doc_id) JOIN dset d USING (doc_id)),
near AS (SELECT DISTINCT o.qid, o.doc_id FROM open_c o JOIN pos p USING (qid) WHERE len(list_intersect(o.tokens, p.tokens)) >= 0.9 * (len(o.tokens) + len(p.tokens) - len(list_intersect(o.tokens, p.tokens))) AND len(o.tokens) > 0 AND len(p.tokens) > 0),
typed AS (SELECT o.qid, o.doc_id, o.source, o.rank, o.score, CASE WHEN o.law IN (SELECT law FROM pos p WHERE p.qid = o.qid) THEN 'same_law' WHEN o.source = 'dense' AND rank <= 20 THEN 'semantic_confuser' WHEN rank <= 20 THEN 'hard_false_positive'
  WHEN rank BETWEEN 10 AND 100 THEN CASE WHEN len(list_intersect(o.tokens, q.qtokens)) >= 2 THEN 'lexical_confuser' ELSE 'semi_hard' END ELSE NULL END AS negative_type FROM open_c o JOIN qset q USING (qid) ANTI JOIN near USING (qid, doc_id)),
strong AS (SELECT *, CASE WHEN negative_type = 'same_law' THEN CASE WHEN rank <= 20 THEN 'hard' ELSE 'semi_hard' END WHEN negative_type IN ('semantic_confuser', 'hard_false_positive') THEN 'hard' ELSE 'semi_hard' END AS strength FROM typed WHERE negative_type IS NOT NULL),
best AS (SELECT * FROM strong QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY rank, source) = 1),
negatives AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY qid, strength ORDER BY rank, source, doc_id) <= 10)"""


def negatives(spark, folder):
    return mining.select_negatives(inputs.questions(spark, folder), inputs.gold(spark, folder), inputs.candidates(spark, folder))


@query("near_duplicate_exclusion", f"WITH {_MINE.replace('>= 0.9 *', '>= 0.2 *')} SELECT qid, doc_id FROM near")
def near_duplicate_exclusion(spark, folder):
    gold = inputs.gold(spark, folder)
    rows = inputs.candidates(spark, folder)
    flagged = rows.join(gold.withColumn("g", F.lit(True)), ["qid", "doc_id"], "left")
    positives = flagged.where("g").select("qid", "doc_id", "tokens").dropDuplicates(["qid", "doc_id"])
    return mining.near_duplicates(flagged.where("g is null"), positives, 0.2).select("qid", "doc_id").distinct()


_PLANTED = f"""
d AS (SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents), p AS (SELECT doc_id AS planted_id, list_append(tokens, 'zzplanted') AS tokens FROM d WHERE doc_id % 10 = 0),
pairs AS (SELECT doc_id, planted_id, len(list_intersect(d.tokens, p.tokens)) AS common, len(d.tokens) + len(p.tokens) AS both_sizes FROM d, p WHERE len(d.tokens) > 0 AND len(d.tokens) >= 0.8 * len(p.tokens) AND len(p.tokens) >= 0.8 * len(d.tokens))"""


@query("set_similarity_pairs", f"""
WITH {_PLANTED} SELECT doc_id, planted_id, common::INT AS common, round(common / (both_sizes - common), 9) AS similarity FROM pairs WHERE common >= 0.8 * (both_sizes - common)""")
def set_similarity_pairs(spark, folder):
    """Documents whose word sets are similar to those of every tenth document with a word more."""
    sets = inputs.documents(spark, folder).select("doc_id", mining.long_tokens(F.col("text")).alias("tokens"))
    planted = sets.where("doc_id % 10 = 0").select(F.col("doc_id").alias("planted_id"), F.array_append("tokens", F.lit("zzplanted")).alias("tokens"))
    return setjoin.similar_sets(sets, planted, 0.8, (), "doc_id", "planted_id").withColumn("similarity", F.round("similarity", 9))


@query("planted_near_duplicates", f"""
WITH {_MINE}, planted AS (SELECT g.qid, -1 - g.doc_id AS doc_id, list_append(d.tokens, 'zzplanted') AS tokens FROM gold g JOIN dset d USING (doc_id)),
both_kinds AS (SELECT qid, doc_id, tokens FROM open_c UNION SELECT qid, doc_id, tokens FROM planted), wanted AS (SELECT g.qid, d.tokens FROM gold g JOIN dset d USING (doc_id))
SELECT DISTINCT o.qid, o.doc_id FROM both_kinds o JOIN wanted p USING (qid) WHERE len(list_intersect(o.tokens, p.tokens)) >= 0.9 * (len(o.tokens) + len(p.tokens) - len(list_intersect(o.tokens, p.tokens))) AND len(o.tokens) > 0""")
def planted_near_duplicates(spark, folder):
    """The exclusion of near duplicates with a copy of every gold document, one word longer, among the candidates."""
    gold = inputs.gold(spark, folder)
    texts = inputs.documents(spark, folder).select("doc_id", mining.long_tokens(F.col("text")).alias("tokens"))
    positives = gold.join(texts, "doc_id")
    planted = positives.select("qid", (-1 - F.col("doc_id")).alias("doc_id"), F.lit("planted").alias("source"), F.array_append("tokens", F.lit("zzplanted")).alias("tokens"))
    open_ = inputs.candidates(spark, folder).join(gold, ["qid", "doc_id"], "left_anti").select("qid", "doc_id", "source", "tokens")
    return mining.near_duplicates_indexed(open_.unionByName(planted), positives).select("qid", "doc_id").distinct()


@query("mine_negatives", f"WITH {_MINE} SELECT qid, doc_id, source, rank, score, negative_type, strength FROM negatives")
def mine_negatives(spark, folder):
    return negatives(spark, folder).select("qid", "doc_id", "source", "rank", "score", "negative_type", "strength")


_QFOLD = r"""qfold AS (SELECT item_id AS qid, (('0x' || sha256('2026:' || trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')))[1:12])::BIGINT % 5)::INT AS vf FROM benchmark)"""
_ROWS = _MINE + ", " + _QFOLD + ", rows AS (SELECT n.*, g.doc_id AS positive_doc, k::INT AS fold, vf FROM negatives n JOIN gold g USING (qid) JOIN qfold USING (qid), range(0, 5) r(k) WHERE k <> vf)"


def training_rows(spark, folder):
    asked = inputs.questions(spark, folder)
    assigned = folds.hashed_folds(folds.with_group(asked))
    return mining.training_rows(asked, inputs.gold(spark, folder), negatives(spark, folder), assigned)


@query("negative_training_rows", f"WITH {_ROWS} SELECT fold, count(*)::BIGINT AS n_rows, count(DISTINCT qid)::BIGINT AS n_questions, count(DISTINCT positive_doc)::BIGINT AS n_positives FROM rows GROUP BY fold")
def negative_training_rows(spark, folder):
    return training_rows(spark, folder).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("qid").alias("n_questions"), F.count_distinct("positive_doc").alias("n_positives")
    )


@query("negative_statistics", f"""
WITH {_ROWS} SELECT negative_type, CASE WHEN strength = 'hard' THEN 'hard_1_20' WHEN strength = 'easy' THEN 'easy_101_plus' ELSE 'semi_10_100' END AS rank_band, count(*)::BIGINT AS n FROM rows GROUP BY 1, 2""")
def negative_statistics(spark, folder):
    return mining.negative_statistics(training_rows(spark, folder))


_MEMBERS = HITS.replace("row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM sims QUALIFY rank <= 20", "row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM sims QUALIFY rank <= 120") + """,
h AS (SELECT qid, chunk_id, doc_id, rank, 'law' || (chunk_id % 3) AS law_name, doc_id = (SELECT label FROM embeddings e WHERE e.vec_id = qid) AS is_gold FROM hits),
chosen AS (SELECT *, 'positive' AS band, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM h WHERE is_gold QUALIFY n <= 3),
laws AS (SELECT DISTINCT qid, law_name FROM chosen),
banded AS (SELECT h.*, CASE WHEN rank <= 20 THEN 'hard' WHEN rank <= 100 THEN 'medium' ELSE 'easy' END AS band FROM h WHERE NOT is_gold AND qid IN (SELECT qid FROM chosen) UNION ALL SELECT h.*, 'same_law' FROM h SEMI JOIN laws USING (qid, law_name) WHERE NOT is_gold),
firsts AS (SELECT * FROM banded QUALIFY row_number() OVER (PARTITION BY qid, band, doc_id ORDER BY rank) = 1),
members AS (SELECT qid, band, n, doc_id, chunk_id, rank FROM chosen UNION ALL SELECT qid, band, row_number() OVER (PARTITION BY qid, band ORDER BY rank) AS n, doc_id, chunk_id, rank FROM firsts QUALIFY n <= 3)"""


def members(spark, folder):
    hits = inputs.vector_hits(spark, folder, 120).withColumn("law_name", F.concat(F.lit("law"), (F.col("chunk_id") % 3).cast("string")))
    return mining.training_members(own_gold(spark, folder), hits)


@query("training_bands", f"WITH {_MEMBERS} SELECT qid, band, n, doc_id, chunk_id, rank FROM members")
def training_bands(spark, folder):
    return members(spark, folder)


@query("training_groups", f"""
WITH {_MEMBERS} SELECT qid, count(*) FILTER (WHERE band = 'positive')::BIGINT AS positives, coalesce(string_agg(chunk_id::VARCHAR, ',' ORDER BY n) FILTER (WHERE band = 'hard'), '') AS hard,
 coalesce(string_agg(chunk_id::VARCHAR, ',' ORDER BY n) FILTER (WHERE band = 'same_law'), '') AS same_law FROM members GROUP BY qid""")
def training_groups(spark, folder):
    groups = mining.training_groups(members(spark, folder))
    ids = lambda c: F.array_join(F.transform(c, lambda e: e["chunk_id"].cast("string")), ",").alias(c)
    return groups.select("qid", F.size("positive").cast("long").alias("positives"), ids("hard"), ids("same_law"))


@query("balanced_examples", f"""
WITH {_MEMBERS}, c AS (SELECT qid, count(*) FILTER (WHERE band = 'positive') AS np, count(*) FILTER (WHERE band <> 'positive') AS nn FROM members GROUP BY qid),
neg AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE band WHEN 'hard' THEN 1 WHEN 'medium' THEN 2 WHEN 'easy' THEN 3 ELSE 4 END, n) AS pick FROM members WHERE band <> 'positive')
SELECT qid, doc_id, chunk_id, 0 AS label FROM neg JOIN c USING (qid) WHERE pick <= np UNION ALL SELECT qid, doc_id, chunk_id, 1 FROM members JOIN c USING (qid) WHERE band = 'positive' AND n <= nn""")
def balanced_examples(spark, folder):
    return mining.balanced_examples(members(spark, folder))


@query("token_jaccard", f"""
WITH {RERANKED} SELECT qid, doc_id, score AS jaccard FROM jac""")
def token_jaccard(spark, folder):
    pairs = inputs.bm25_ranking(spark, folder).join(inputs.documents(spark, folder).select("doc_id", "text"), "doc_id").join(inputs.questions(spark, folder), "qid")
    return pairs.select("qid", "doc_id", F.round(tx.jaccard(tx.word_tokens(F.col("question")), tx.word_tokens(F.col("text"))), 6).alias("jaccard"))
