"""Queries over BM25, vectors, reranking and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexatlas.operators import bm25, ranking, vectors
from lexatlas.plans import inputs
from lexatlas.plans.registry import query
from lexatlas.plans.text_queries import FOLDED, WORD

_GRAMS = "(SELECT {key}, n, unnest(range(1, greatest(len(w)-n+2, 1))) AS i, w FROM {source}, (VALUES (1),(2),(3)) v(n))"
TERMS = rf"""
qtok AS (SELECT item_id AS qid, regexp_extract_all({FOLDED.format('text')}, '{WORD}') AS w FROM benchmark),
vocab AS (SELECT DISTINCT array_to_string(w[i:i+n-1], ' ') AS term, n FROM {_GRAMS.format(key='qid', source='qtok')}),
qlow AS (SELECT item_id AS qid, regexp_extract_all(lower(text), '{WORD}') AS w FROM benchmark),
qterm AS (SELECT DISTINCT qid, term, n FROM (SELECT qid, array_to_string(w[i:i+n-1], ' ') AS term, n FROM {_GRAMS.format(key='qid', source='qlow')}) SEMI JOIN vocab USING (term)),
dtok AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents),
dterm AS (SELECT doc_id, array_to_string(w[i:i+n-1], ' ') AS term FROM {_GRAMS.format(key='doc_id', source='dtok')}),
postings AS (SELECT doc_id, term, count(*) AS tf FROM dterm SEMI JOIN vocab USING (term) GROUP BY ALL),
stats AS (SELECT count(*) AS doc_count, avg(greatest(len(w), 1)) AS avg_length FROM dtok),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""
BM25 = TERMS + """,
bm25_scores AS (
  SELECT qid, p.doc_id, round(sum(tf * 1.7::DOUBLE / (tf + 0.7::DOUBLE * (0.7::DOUBLE + 0.3::DOUBLE * greatest(len(d.w), 1) / avg_length)) * ln(1 + (doc_count - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * n), 6) AS score
  FROM postings p JOIN qterm USING (term) JOIN freq USING (term) JOIN dtok d ON d.doc_id = p.doc_id, stats GROUP BY qid, p.doc_id),
bm25 AS MATERIALIZED (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bm25_scores WHERE score > 0 QUALIFY rank <= 100)"""


def _words(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '{WORD}')"


_PAIRS = f"""
pairs AS (SELECT r.qid, r.doc_id, r.rank, r.score, list_distinct({_words('b.text')}) AS qw, list_distinct({_words('d.text')}) AS dw, d.text, d.source
  FROM bm25 r JOIN benchmark b ON b.item_id = r.qid JOIN documents d USING (doc_id))"""
RERANKED = BM25 + "," + _PAIRS + """,
overlap AS (SELECT qid, doc_id, rank AS source_rank, round(len(list_intersect(qw, dw)) / greatest(len(qw), 1), 6) AS rerank_score FROM pairs),
reranked AS (SELECT qid, doc_id, source_rank, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY (source_rank > 50), CASE WHEN source_rank <= 50 THEN -rerank_score ELSE 0 END, source_rank) AS rank FROM overlap),
jac AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT qid, doc_id, round(len(list_intersect(qw, dw)) / (len(qw) + len(dw) - len(list_intersect(qw, dw))), 6) AS score FROM pairs))"""
KNN = """
sims AS (SELECT a.vec_id AS qid, b.vec_id, b.label, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b),
knn AS MATERIALIZED (SELECT qid, vec_id, label::BIGINT AS label, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM sims QUALIFY rank <= 20)"""
HITS = KNN + ", hits AS (SELECT qid, vec_id AS chunk_id, label AS doc_id, score, rank FROM knn)"


@query("bm25_top100", f"WITH {BM25} SELECT qid, doc_id, score, rank FROM bm25")
def bm25_top100(spark, folder):
    return inputs.bm25_ranking(spark, folder)


@query("bm25_doc_stats", f"WITH {TERMS} SELECT doc_count::BIGINT AS doc_count, round(avg_length, 6) AS avg_length FROM stats")
def bm25_doc_stats(spark, folder):
    stats = bm25.parts(inputs.questions(spark, folder), inputs.documents(spark, folder)).stats
    return stats.select("doc_count", F.round("avg_length", 6).alias("avg_length"))


@query("bm25_term_df", f"WITH {TERMS} SELECT term, df::BIGINT AS df FROM freq")
def bm25_term_df(spark, folder):
    return bm25.parts(inputs.questions(spark, folder), inputs.documents(spark, folder)).frequencies.where(F.col("term") != bm25.DOC_MARK)


@query("question_vocabulary", f"WITH {TERMS} SELECT qid, count(*)::BIGINT AS terms, sum(n)::BIGINT AS words FROM qterm GROUP BY qid")
def question_vocabulary(spark, folder):
    asked = inputs.questions(spark, folder)
    terms = bm25.question_terms(asked, bm25.vocabulary(asked))
    return terms.groupBy("qid").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("words"))


@query("vector_norms", """
SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, len(embedding)::BIGINT AS dimension FROM embeddings""")
def vector_norms(spark, folder):
    rows = inputs.table(spark, folder, "embeddings")
    return rows.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").cast("long").alias("dimension"))


@query("vector_truncate_renorm", """
WITH v AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, i::BIGINT AS i, round((e[i + 1] / sqrt(list_inner_product(e, e)))::FLOAT::DOUBLE, 5) AS x FROM (SELECT vec_id, e, unnest(range(0, 32)) AS i FROM v)""")
def vector_truncate_renorm(spark, folder):
    rows = inputs.table(spark, folder, "embeddings").select("vec_id", F.posexplode(vectors.unit(F.col("embedding"), 32)).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 5).alias("x"))


@query("vector_mean_pool_by_label", """
WITH m AS (SELECT label, i, avg(embedding[i + 1]::DOUBLE) AS x FROM (SELECT label, embedding, unnest(range(0, 64)) AS i FROM embeddings) GROUP BY ALL),
n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label)
SELECT label, i::BIGINT AS i, round(x / norm, 6) AS x FROM m JOIN n USING (label)""")
def vector_mean_pool_by_label(spark, folder):
    pooled = vectors.pooled(inputs.table(spark, folder, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("knn_exact_topk", f"WITH {KNN} SELECT qid, vec_id, score, rank FROM knn")
def knn_exact_topk(spark, folder):
    return inputs.knn(spark, folder)


@query("knn_filtered_topk", f"""
WITH {KNN} SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM sims WHERE label IN (1, 4, 7) QUALIFY rank <= 5""")
def knn_filtered_topk(spark, folder):
    return inputs.knn(spark, folder, 5, [1, 4, 7])


@query("knn_grid_topk", f"WITH {KNN} SELECT qid, vec_id, score, rank FROM knn WHERE rank <= 10")
def knn_grid_topk(spark, folder):
    """The layout for question sets too large to ship, on the same data."""
    rows = inputs.table(spark, folder, "embeddings")
    asked = rows.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    return vectors.nearest(asked, rows.select("vec_id", F.col("embedding").alias("v")), 10, query_bytes=0, fragment=200)


@query("vector_upsert_last_wins", """
WITH n AS (SELECT event_id AS seq, user_id AS vec_id, value FROM events),
e AS (SELECT vec_id, label::DOUBLE AS value, -1 AS seq FROM embeddings)
SELECT vec_id, value FROM (SELECT vec_id, value, seq FROM n UNION ALL SELECT vec_id, value, seq FROM e) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY seq DESC) = 1""")
def vector_upsert_last_wins(spark, folder):
    stored = inputs.table(spark, folder, "embeddings").select("vec_id", F.col("label").cast("double").alias("value"))
    incoming = inputs.table(spark, folder, "events").select(F.col("user_id").alias("vec_id"), "value", F.col("event_id").alias("seq"))
    return vectors.upsert(stored, incoming, "vec_id", "seq")


@query("vector_delete", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def vector_delete(spark, folder):
    gone = inputs.table(spark, folder, "events").where("event_type = 'error'").select(F.col("user_id").alias("vec_id"))
    return vectors.delete(inputs.table(spark, folder, "embeddings").select("vec_id", "label"), gone, "vec_id")


@query("first_occurrence_documents", f"""
WITH {HITS} SELECT qid, doc_id, chunk_rank, row_number() OVER (PARTITION BY qid ORDER BY chunk_rank, doc_id) AS rank
FROM (SELECT qid, doc_id, min(rank) AS chunk_rank FROM hits GROUP BY ALL)""")
def first_occurrence_documents(spark, folder):
    return ranking.first_occurrence(inputs.vector_hits(spark, folder))


_PROFILE = """
placed AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY rank) AS nr, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, rank, chunk_id) AS ns FROM hits),
profile AS (SELECT qid, doc_id, min(rank) AS first_rank, max(score) AS max_score, max(score) FILTER (WHERE ns = 2) AS second_score, count(*)::BIGINT AS support,
  sum(1.0::DOUBLE / (60 + rank)) FILTER (WHERE nr <= 2) AS rrf2, sum(1.0::DOUBLE / (60 + rank)) FILTER (WHERE nr <= 3) AS rrf3,
  string_agg(chunk_id::VARCHAR, ',' ORDER BY ns) FILTER (WHERE ns <= 3) AS evidence FROM placed GROUP BY qid, doc_id)"""
AGGREGATED = HITS + "," + _PROFILE + """,
scored AS (SELECT qid, doc_id, first_rank, support, method, round(CASE method WHEN 'first_occurrence' THEN -first_rank::DOUBLE WHEN 'max' THEN max_score
  WHEN 'max_plus_0.10_second' THEN max_score + 0.10::DOUBLE * coalesce(second_score, 0) WHEN 'max_plus_0.20_second' THEN max_score + 0.20::DOUBLE * coalesce(second_score, 0)
  WHEN 'top2_mean' THEN coalesce((max_score + second_score) / 2, max_score) WHEN 'rrf_cap2' THEN rrf2 ELSE rrf3 END, 9) AS score
  FROM profile, (VALUES ('first_occurrence'),('max'),('max_plus_0.10_second'),('max_plus_0.20_second'),('top2_mean'),('rrf_cap2'),('rrf_cap3')) m(method)),
aggregated AS (SELECT *, row_number() OVER (PARTITION BY qid, method ORDER BY score DESC, first_rank, doc_id) AS rank FROM scored)"""


@query("aggregate_documents", f"WITH {AGGREGATED} SELECT qid, doc_id, method, score, support, rank FROM aggregated")
def aggregate_documents(spark, folder):
    return ranking.aggregate_documents(inputs.vector_hits(spark, folder)).select("qid", "doc_id", "method", "score", "support", "rank")


@query("top_evidence_chunks", f"WITH {HITS}, {_PROFILE} SELECT qid, doc_id, evidence, support FROM profile")
def top_evidence_chunks(spark, folder):
    profile = ranking.document_profile(inputs.vector_hits(spark, folder))
    return profile.select("qid", "doc_id", F.array_join(F.transform("evidence", lambda e: e.cast("string")), ",").alias("evidence"), "support")


@query("official_predictions", f"""
WITH {AGGREGATED} SELECT qid, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS documents FROM aggregated WHERE method = 'rrf_cap2' AND rank <= 5 GROUP BY qid""")
def official_predictions(spark, folder):
    top = ranking.aggregate_documents(inputs.vector_hits(spark, folder), ("rrf_cap2",), 5)
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("d"))))
    return top.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda e: e["d"]), ",").alias("documents"))


@query("rerank_topn_tail", f"WITH {RERANKED} SELECT qid, doc_id, source_rank, rerank_score, rank FROM reranked")
def rerank_topn_tail(spark, folder):
    return inputs.reranked(spark, folder).select("qid", "doc_id", "source_rank", "rerank_score", "rank")


_FUSED = """
src AS (SELECT qid, doc_id, 0 AS s, 0.5::DOUBLE AS w, rank FROM jac UNION ALL SELECT qid, doc_id, 1, 1.0::DOUBLE, rank FROM reranked UNION ALL SELECT qid, doc_id, 2, 0.3::DOUBLE, rank FROM bm25),
fused AS (SELECT qid, doc_id, round(sum(w / (60 + rank)), 12) AS score, coalesce(min(rank) FILTER (WHERE s = 0), 1000000000) AS r0, coalesce(min(rank) FILTER (WHERE s = 1), 1000000000) AS r1,
  coalesce(min(rank) FILTER (WHERE s = 2), 1000000000) AS r2 FROM src {where} GROUP BY qid, doc_id),
final AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, r0, r1, r2, doc_id) AS rank FROM fused QUALIFY rank <= {limit})"""


@query("rrf_three_source_weighted", f"WITH {RERANKED}, {_FUSED.format(where='', limit=5)} SELECT qid, doc_id, score, rank FROM final")
def rrf_three_source_weighted(spark, folder):
    return final_ranking(spark, folder).select("qid", "doc_id", "score", "rank")


def final_ranking(spark, folder, weights=(0.5, 1.0, 0.3), limit=5, base=None):
    """Production fusion: similarity, reranker and BM25 documents."""
    base = inputs.bm25_ranking(spark, folder) if base is None else base
    pool = inputs.scored_pool(spark, folder, base)
    sources = [inputs.jaccard_ranking(spark, folder, pool), inputs.reranked(spark, folder, pool=pool), base]
    return ranking.weighted_rrf(sources, weights, limit=limit)


@query("rrf_two_source", f"WITH {RERANKED}, {_FUSED.format(where='WHERE s > 0', limit=200)} SELECT qid, doc_id, score, rank FROM final")
def rrf_two_source(spark, folder):
    """Weight zero takes the first source out of scores and ties."""
    return final_ranking(spark, folder, (0.0, 1.0, 0.3), 200).select("qid", "doc_id", "score", "rank")


@query("chunk_rank_fusion", f"""
WITH {RERANKED}, f AS (SELECT qid, doc_id AS chunk_id, j.rank AS dense_rank, r.rank AS rerank_rank, round(0.2::DOUBLE / (60 + j.rank) + 0.8::DOUBLE / (60 + r.rank), 12) AS score FROM jac j JOIN reranked r USING (qid, doc_id))
SELECT qid, chunk_id, dense_rank, rerank_rank, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, dense_rank, rerank_rank, chunk_id) AS rank FROM f""")
def chunk_rank_fusion(spark, folder):
    as_chunks = lambda frame: frame.withColumnRenamed("doc_id", "chunk_id")
    pool = inputs.scored_pool(spark, folder)
    return ranking.fuse_chunks(as_chunks(inputs.jaccard_ranking(spark, folder, pool)), as_chunks(inputs.reranked(spark, folder, pool=pool)))


@query("pool_mismatch", f"""
WITH {RERANKED}, a AS (SELECT qid, doc_id AS chunk_id FROM bm25), b AS (SELECT qid, doc_id AS chunk_id FROM reranked WHERE rerank_score >= 0.5)
SELECT qid, chunk_id, 'left' AS only_in FROM a ANTI JOIN b USING (qid, chunk_id)""")
def pool_mismatch(spark, folder):
    found = inputs.bm25_ranking(spark, folder)
    kept = inputs.reranked(spark, folder, pool=inputs.scored_pool(spark, folder, found)).where("rerank_score >= 0.5")
    return ranking.pool_mismatch(found.withColumnRenamed("doc_id", "chunk_id"), kept.withColumnRenamed("doc_id", "chunk_id"))


@query("parent_rank_fusion", f"""
WITH {HITS}, p AS (SELECT qid, chunk_id, doc_id, rank, row_number() OVER (PARTITION BY qid ORDER BY chunk_id % 7, doc_id, chunk_id) AS retrieval_rank, chunk_id % 7 AS candidate_rank FROM hits)
SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(0.7::DOUBLE / (5 + rank) + 0.3::DOUBLE / (5 + retrieval_rank), 12) DESC, rank, candidate_rank, doc_id, chunk_id) AS fused_rank FROM p""")
def parent_rank_fusion(spark, folder):
    parents = inputs.vector_hits(spark, folder).select("qid", "doc_id", F.col("chunk_id").alias("parent_id"), "rank", (F.col("chunk_id") % 7).alias("candidate_rank"))
    return ranking.fuse_parents(parents, 0.7, 0.3).select("qid", F.col("parent_id").alias("chunk_id"), "fused_rank")


@query("reorder_edges", f"""
WITH {HITS} SELECT qid, chunk_id, CASE WHEN (rank - 1) % 2 = 0 THEN (rank - 1) // 2 + 1 ELSE count(*) OVER (PARTITION BY qid) - (rank - 2) // 2 END::BIGINT AS slot FROM hits""")
def reorder_edges(spark, folder):
    return ranking.reorder_edges(inputs.vector_hits(spark, folder)).select("qid", "chunk_id", "slot")


@query("complete_rankings", f"""
WITH {HITS}, f AS (SELECT qid, doc_id, min(rank) AS r FROM hits GROUP BY ALL), c AS (SELECT DISTINCT label::BIGINT AS doc_id FROM embeddings), q AS (SELECT vec_id AS qid FROM embeddings)
SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY coalesce(r, 1000000000), doc_id) AS rank FROM (SELECT * FROM q, c) LEFT JOIN f USING (qid, doc_id)""")
def complete_rankings(spark, folder):
    rows = inputs.table(spark, folder, "embeddings")
    ranked = ranking.first_occurrence(inputs.vector_hits(spark, folder))
    return ranking.append_missing(ranked, rows.select(F.col("vec_id").alias("qid")), rows.select(F.col("label").cast("long").alias("doc_id")))


@query("hashed_embedding_search")
def hashed_embedding_search(spark, folder):
    """Text search with the stand-in encoder: all documents, all questions."""
    from lexatlas.operators import models

    asked = models.embed_texts(inputs.questions(spark, folder), "qid", "question")
    stored = models.embed_texts(inputs.documents(spark, folder), "doc_id", "text", max_words=192, overlap=32)
    return vectors.nearest(asked, stored.select(F.col("doc_id").alias("vec_id"), "v"), 10)
