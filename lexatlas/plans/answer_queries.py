"""Queries over evidence, answer candidates, citations and answer scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexatlas.functions import patterns as P
from lexatlas.functions import scoring
from lexatlas.functions import text as tx
from lexatlas.operators import answers, chunking, citations, evidence, folds, models, selector
from lexatlas.operators.joins import narrow
from lexatlas.plans import corpus_queries, inputs
from lexatlas.plans.registry import query
from lexatlas.plans.retrieval_queries import HITS, RERANKED
from lexatlas.plans.text_queries import TOKEN, WORD


def turn_pairs(spark, folder):
    """Each user turn with the reply and the opening turn of its conversation."""
    rows = inputs.table(spark, folder, "conversations")
    key = inputs.turn_id().alias("qid")
    asked = rows.where("role = 'user'").select("conv_id", "turn", key, F.col("text").alias("question"))
    reply = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("generated"))
    first = rows.where("turn = 0").select("conv_id", F.col("text").alias("opening"))
    joined = asked.join(reply, ["conv_id", "turn"]).join(first, "conv_id")
    return joined.select("qid", "question", "generated", F.concat_ws("\n", "opening", "generated", "question").alias("extractive"))


_PAIRS = """
rep AS (SELECT a.conv_id || '-' || a.turn AS qid, a.text AS question, b.text AS generated, o.text || chr(10) || b.text || chr(10) || a.text AS extractive FROM conversations a
  JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 JOIN conversations o ON o.conv_id = a.conv_id AND o.turn = 0 WHERE a.role = 'user')"""


def _words(column: str) -> str:
    return f"regexp_extract_all(replace(lower({column}), 'ß', 'ss'), '{WORD}')"


def _pairs(words: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({words}), 1)), lambda k: {words}[k] || ' ' || {words}[k + 1]))"


@query("sentence_scores", rf"""
WITH {_PAIRS},
u AS (SELECT qid, question, generated, generate_subscripts(a, 1) AS pos, unnest(a) AS raw FROM (SELECT *, string_split_regex(regexp_replace(extractive, '([.!?;:])\s+', '\1' || chr(1), 'g'), '\x01|\n+') AS a FROM rep)),
t AS (SELECT qid, question, generated, pos, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS unit, {_words('raw')} AS w FROM u),
f AS (SELECT *, row_number() OVER (PARTITION BY qid, array_to_string(w, ' ') ORDER BY pos) AS copy FROM t WHERE len(w) >= 3),
i AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) - 1 AS idx, list_distinct({_words('question')}) AS q, list_distinct({_words('generated')}) AS g, {_words('question')} AS qw, {_words('generated')} AS gw FROM f WHERE copy = 1),
p AS (SELECT *, list_distinct(w) AS ws, {_pairs('w')} AS wp, {_pairs('qw')} AS qp, {_pairs('gw')} AS gp, list_filter(q, lambda x: regexp_matches(x, '\p{{Nd}}')) AS num FROM i)
SELECT qid, idx, sha256(unit) AS unit_hash, round(round(3.0::DOUBLE * len(list_intersect(q, ws)) / greatest(1, len(q)) + 2.0::DOUBLE * len(list_intersect(qp, wp)) / greatest(1, len(qp)) + 1.2::DOUBLE * len(list_intersect(num, ws)) / greatest(1, len(num))
 + 0.7::DOUBLE * len(list_filter(list_intersect(q, ws), lambda x: NOT list_contains(g, x))) / greatest(1, len(q)) - 0.9::DOUBLE * len(list_intersect(ws, g)) / (len(ws) + len(g) - len(list_intersect(ws, g)))
 - 0.4::DOUBLE * len(list_intersect(gp, wp)) / greatest(1, len(wp)) - 0.3::DOUBLE * greatest(0, (len(w) - 90) / 180.0::DOUBLE) - 0.0005::DOUBLE * idx, 9), 6) AS score FROM p""")
def sentence_scores(spark, folder):
    rows = turn_pairs(spark, folder)
    units = rows.select("qid", answers.sentence_table(F.col("extractive")).alias("u"), *[tx.folded_word_tokens(F.col(c)).alias(c) for c in ("question", "generated")])
    rated = answers.score_sentences(units, "u", "question", "generated", "rated")
    scored = rated.select("qid", F.explode_outer("rated").alias("s")).where(F.col("s").isNotNull())
    return scored.select("qid", F.col("s.idx").cast("long").alias("idx"), F.sha2("s.unit", 256).alias("unit_hash"), F.round("s.score", 6).alias("score"))


@query("answer_bank")
def answer_bank(spark, folder):
    return answers.candidate_bank(turn_pairs(spark, folder))


@query("bank_raw_prefixes", rf"""
WITH {_PAIRS} SELECT qid, 'raw_prefix_' || n AS profile, sha256(trim(array_to_string(regexp_extract_all(extractive, '{TOKEN}')[1:n], ' ') || chr(10) || trim(generated, ' ' || chr(10)), ' ' || chr(10))) AS answer_hash
FROM rep, (VALUES (96), (160), (224), (288), (352), (416)) v(n)""")
def bank_raw_prefixes(spark, folder):
    bank = answers.candidate_bank(turn_pairs(spark, folder))
    return bank.where(F.col("profile").startswith("raw_prefix")).select("qid", "profile", F.sha2("answer", 256).alias("answer_hash"))


@query("bank_violations", "SELECT 0::BIGINT AS qid, 0::BIGINT AS profiles, 0::BIGINT AS all_profiles, 0::BIGINT AS most WHERE false")
def bank_violations(spark, folder):
    return answers.bank_violations(answers.candidate_bank(turn_pairs(spark, folder)))


@query("profile_argmax", rf"""
WITH {_PAIRS}, c AS (SELECT qid, generated AS answer, 0 AS position, 'generated' AS profile FROM rep UNION ALL SELECT qid, extractive, 1, 'extractive' FROM rep UNION ALL SELECT qid, question, 2, 'question' FROM rep)
SELECT qid, profile, score FROM (SELECT qid, profile, position, (len({_words('answer')}) % 7)::DOUBLE AS score FROM c) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, position) = 1""")
def profile_argmax(spark, folder):
    entries = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("profile"), F.col(c).alias("answer")) for i, c in enumerate(("generated", "extractive", "question"))]
    rows = turn_pairs(spark, folder).select("qid", F.explode(F.array(*entries)).alias("c")).select("qid", "c.*")
    scored = rows.withColumn("score", (F.size(tx.folded_word_tokens(F.col("answer"))) % 7).cast("double"))
    return answers.choose(scored).select("qid", "profile", "score")


@query("answer_features", rf"""
WITH {_PAIRS}, t AS (SELECT qid, {_words('question')} AS q, {_words('extractive')} AS a, {_words('generated')} AS g FROM rep)
SELECT qid, round(ln(1 + len(a)), 6) AS log_length, round(len(a) / greatest(1, len(g)), 6) AS length_ratio, round(len(list_intersect(q, a)) / greatest(1, len(list_distinct(q))), 6) AS coverage,
 round(len(list_intersect(a, g)) / greatest(1, len(list_distinct(list_concat(a, g)))), 6) AS overlap, round((len(a) - len(list_distinct(a))) / greatest(1, len(a)), 6) AS repeated FROM t""")
def answer_features(spark, folder):
    rows = turn_pairs(spark, folder)
    features = answers.answer_features(F.col("question"), F.col("extractive"), F.col("generated"), F.col("extractive"), F.lit("qwen"))
    placed = rows.select("qid", features.alias("f"))
    first = len(answers.PROFILES)
    names = {"log_length": 0, "length_ratio": 1, "coverage": 3, "overlap": 4, "repeated": 6}
    return placed.select("qid", *[F.round(F.col("f")[first + i], 6).alias(n) for n, i in names.items()])


@query("rouge_l_scores")
def rouge_l_scores(spark, folder):
    rows = turn_pairs(spark, folder)
    return rows.select(
        "qid", F.round(scoring.rouge_l(F.col("generated"), F.col("extractive")), 9).alias("rouge_l"),
        F.round(scoring.rouge_l_unicode(F.col("generated"), F.col("extractive")), 9).alias("rouge_l_unicode"),
    )


@query("meteor_scores")
def meteor_scores(spark, folder):
    return turn_pairs(spark, folder).select("qid", F.round(scoring.meteor(F.col("generated"), F.col("extractive")), 9).alias("meteor"))


@query("answer_score_means")
def answer_score_means(spark, folder):
    rows = turn_pairs(spark, folder).select(scoring.meteor(F.col("generated"), F.col("extractive")).alias("m"), scoring.rouge_l(F.col("generated"), F.col("extractive")).alias("r"))
    return rows.agg(F.count(F.lit(1)).alias("sample_count"), F.round(F.avg("m"), 9).alias("meteor"), F.round(F.avg("r"), 9).alias("rouge_l"))


@query("ensemble_answers", rf"""
WITH {_PAIRS} SELECT qid, sha256(trim(array_to_string(regexp_extract_all(extractive, '{TOKEN}')[1:40], ' ') || chr(10) || trim(generated, ' ' || chr(10)), ' ' || chr(10))) AS answer_hash, len(regexp_extract_all(extractive, '{TOKEN}')) > 40 AS truncated FROM rep""")
def ensemble_answers(spark, folder):
    rows = turn_pairs(spark, folder)
    made = answers.ensemble(rows.select("qid", F.col("generated").alias("answer")), rows.select("qid", F.col("extractive").alias("answer")), 40)
    return made.select("qid", F.sha2("answer", 256).alias("answer_hash"), "truncated")


@query("refused_answers", """
SELECT conv_id || '-' || turn AS qid, trim(text) = '' OR turn % 3 = 1 AS refused FROM conversations""")
def refused_answers(spark, folder):
    """Every third turn gets a refusal phrase; all are finished alike."""
    raw = F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" Không có thông tin."))).otherwise(F.col("text"))
    rows = inputs.table(spark, folder, "conversations").select(inputs.turn_id().alias("qid"), answers.finish_answer(raw).alias("a"))
    return rows.select("qid", (F.col("a") == P.REFUSAL_ANSWER).alias("refused"))


@query("insufficient_context", f"""
WITH {HITS}, b AS (SELECT qid, max(score) AS best_score FROM hits WHERE chunk_id <> qid GROUP BY qid) SELECT vec_id AS qid, best_score FROM embeddings LEFT JOIN b ON b.qid = vec_id WHERE best_score IS NULL OR best_score < 0.4""")
def insufficient_context(spark, folder):
    hits = inputs.vector_hits(spark, folder).where("chunk_id <> qid")
    asked = inputs.table(spark, folder, "embeddings").select(F.col("vec_id").alias("qid"))
    return answers.insufficient_context(asked, hits, 0.4)


_CONTEXT = RERANKED + """, c AS (SELECT r.qid, r.rank, r.doc_id, trim(d.text, ' ' || chr(10)) AS text, d.source FROM reranked r JOIN documents d USING (doc_id) WHERE r.rank <= 3)"""


def contexts(spark, folder):
    top = inputs.reranked(spark, folder).where("rank <= 3").select("qid", "doc_id", "rank")
    return top.join(inputs.documents(spark, folder).select("doc_id", "text", F.col("source").alias("law_name")), "doc_id").withColumn("chunk_id", F.col("doc_id").cast("string"))


@query("prompt_block", f"""
WITH {_CONTEXT} SELECT qid, sha256(string_agg('[' || rank || '] (law_name=' || source || ' | article=N/A | clause=N/A | point=N/A | chunk_id=' || doc_id || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS block_hash FROM c GROUP BY qid""")
def prompt_block(spark, folder):
    return evidence.context_block(contexts(spark, folder)).select("qid", F.sha2("context_block", 256).alias("block_hash"))


def chunk_hits(spark, folder):
    """Statute chunks ranked for each question by the pair scorer, over BM25 documents.

    A document's records are its own, so only the documents in the ranking are chunked.
    """
    top = inputs.reranked(spark, folder).where("rank <= 5").select("qid", "doc_id")
    rows = chunking.chunk_records(narrow(inputs.statutes(spark, folder), top, "doc_id")).persist()
    pairs = rows.where("record = 'chunk'").join(top, "doc_id").join(inputs.questions(spark, folder), "qid")
    scored = models.score_pairs(pairs, "question", "text")
    ordered = scored.withColumn("rank", F.row_number().over(_by("qid", F.col("rerank_score").desc(), "chunk_id")))
    return ordered.where("rank <= 20"), rows.where("record = 'parent'")


def _by(group, *order):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(*order)


@query("parent_expansion")
def parent_expansion(spark, folder):
    hits, parents = chunk_hits(spark, folder)
    return evidence.expand_parents(hits, parents, 60, 150).select("qid", "rank", "parent_id", "expanded", "tokens", "truncated", "text")


@query("extractive_answers")
def extractive_answers(spark, folder):
    hits, parents = chunk_hits(spark, folder)
    dense = hits.withColumn("rank", F.row_number().over(_by("qid", F.col("token_count").desc(), "chunk_id")))
    return evidence.extractive_answers(dense, hits, parents)


@query("parent_evidence_answers")
def parent_evidence_answers(spark, folder):
    hits, parents = chunk_hits(spark, folder)
    best = hits.groupBy("qid", "doc_id", "parent_id").agg(F.min("rank").alias("candidate_rank"), F.min_by("text", "rank").alias("anchor_text"))
    joined = best.join(parents.select("doc_id", "parent_id", F.col("text").alias("parent_text")), ["doc_id", "parent_id"])
    ranked = joined.withColumn("rank", F.row_number().over(_by("qid", F.col("candidate_rank"), "parent_id")))
    return evidence.evidence_from_parents(ranked, 2, 60, 100)


@query("canonical_evidence", f"""
WITH {corpus_queries.STATUTE_PARENTS}, g AS (SELECT DISTINCT d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
f AS (SELECT p.doc_id, parent_id, body, row_number() OVER (PARTITION BY p.doc_id ORDER BY parent_id, body) AS n FROM parents p JOIN g USING (doc_id) QUALIFY n <= 2)
SELECT doc_id, string_agg(parent_id, ',' ORDER BY n) AS evidence_ids, sha256(string_agg(body, chr(10) || chr(10) ORDER BY n)) AS evidence_hash FROM f GROUP BY doc_id""")
def canonical_evidence(spark, folder):
    parents = corpus_queries.records(spark, folder).where("record = 'parent'")
    found = evidence.canonical_evidence(inputs.gold(spark, folder), parents)
    return found.select("doc_id", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.sha2("evidence", 256).alias("evidence_hash"))


def cited(spark, folder):
    """Answers that cite articles of a law, in brackets or in running text."""
    n = (F.col("doc_id") % 9 + 1).cast("string")
    law = F.concat(F.lit("Luật số "), F.col("source"))
    bracket = F.concat(F.lit("Xem ["), law, F.lit(", Điều "), n, F.lit(", Khoản 1]. "), F.col("text"))
    inline = F.concat(F.lit("Theo khoản 2 Điều "), n, F.lit(" "), law, F.lit(". Hết."))
    return inputs.documents(spark, folder).select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 2 == 0, bracket).otherwise(inline).alias("answer"))


CITED = """
cit AS (SELECT doc_id AS qid, doc_id % 2 = 0 AS bracket, (doc_id % 9 + 1)::VARCHAR AS k, source, doc_id FROM documents),
c AS (SELECT qid, 1 AS n, 'Luật số ' || source AS law_name, 'Điều ' || k AS article, 'Khoản 1' AS clause FROM cit WHERE bracket
 UNION ALL SELECT qid, 1, 'Luật số ' || source, 'Điều ' || k, NULL FROM cit WHERE NOT bracket UNION ALL SELECT qid, 2, 'Luật số ' || source, 'Điều ' || k, 'Khoản 2' FROM cit WHERE NOT bracket)"""


@query("citations_parsed", f"WITH {CITED} SELECT qid, n, law_name, article, clause FROM c")
def citations_parsed(spark, folder):
    return citations.parse_citations(cited(spark, folder)).select("qid", "n", "law_name", "article", "clause")


def support(spark, folder):
    """Context hits: clause 1 of the cited article for two documents in three."""
    docs = inputs.documents(spark, folder)
    wrong = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    return docs.select(
        F.col("doc_id").alias("qid"), F.lit(1).alias("rank"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.lit("s").alias("source"),
        F.concat(F.lit("luật số "), "source", F.lit(" sửa đổi")).alias("law_name"),
        F.concat(F.lit("Điều "), (F.col("doc_id") % 9 + 1 + wrong).cast("string")).alias("article"), F.lit("khoản 1").alias("clause"), F.lit(None).cast("string").alias("point"),
    )


@query("citations_verified", f"""
WITH {CITED} SELECT qid, n, qid % 3 <> 0 AND coalesce(clause, 'Khoản 1') = 'Khoản 1' AS is_verified, CASE WHEN qid % 3 <> 0 AND coalesce(clause, 'Khoản 1') = 'Khoản 1' THEN 'c' || qid END AS chunk_id FROM c""")
def citations_verified(spark, folder):
    verified = citations.verify(citations.parse_citations(cited(spark, folder)), support(spark, folder))
    return verified.select("qid", "n", "is_verified", "chunk_id")


@query("answer_confidence", f"""
WITH {CITED}, v AS (SELECT qid, qid % 3 <> 0 AND coalesce(clause, 'Khoản 1') = 'Khoản 1' AS ok FROM c)
SELECT qid, count(*)::BIGINT AS citations, count(*) FILTER (WHERE ok)::BIGINT AS verified, count(*) FILTER (WHERE ok) / count(*) AS confidence FROM v GROUP BY qid""")
def answer_confidence(spark, folder):
    return citations.confidence(citations.verify(citations.parse_citations(cited(spark, folder)), support(spark, folder)))


@query("selector_documents", rf"""
WITH {_PAIRS} SELECT qid, sha256('QUESTION ' || trim(question, ' ' || chr(10)) || chr(10) || 'QWEN ' || array_to_string(regexp_extract_all(generated, '{TOKEN}')[1:160], ' ') || chr(10) || 'EVIDENCE ' || array_to_string(regexp_extract_all(extractive, '{TOKEN}')[1:160], ' ')) AS document_hash FROM rep""")
def selector_documents(spark, folder):
    document = answers.selector_document(F.col("question"), F.col("generated"), F.col("extractive"))
    return turn_pairs(spark, folder).select("qid", F.sha2(document, 256).alias("document_hash"))


@query("selector_fold")
def selector_fold(spark, folder):
    """Nested choice of the answer selector over the whole bank: every question, in the fold that leaves it out."""
    pairs = turn_pairs(spark, folder)
    bank = answers.candidate_bank(pairs).join(pairs, "qid")
    rows = bank.select(
        "qid", "profile", "position", "answer", answers.selector_document(F.col("question"), F.col("generated"), F.col("extractive")).alias("document"),
        answers.answer_features(F.col("question"), F.col("answer"), F.col("generated"), F.col("extractive"), F.col("profile")).alias("features"),
        scoring.meteor(F.col("generated"), F.col("answer")).alias("target"),
    )
    assigned = folds.hashed_folds(folds.with_group(pairs.select("qid", "question")), 3).select("qid", "fold")
    return selector.select_nested(rows, assigned, 3).select("method", "qid", "profile")
