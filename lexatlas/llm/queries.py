"""The queries of the pipeline operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.llm.common import table
from lexatlas.llm.forest import nearest
from lexatlas.llm.lines import dedup_lines
from lexatlas.llm.mixing import taken_words
from lexatlas.llm.packing import pack
from lexatlas.llm.phrases import collocations
from lexatlas.llm.preference import format_preferences, own_reply_pairs
from lexatlas.llm.simhash import near_duplicates
from lexatlas.llm.suffixes import remove_repeats
from lexatlas.llm.token_counts import count_tokens
from lexatlas.llm.toxicity import score_documents
from lexatlas.llm.wand import top_documents
from lexatlas.llm.warc import archive_pages
from lexatlas.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_token_counts")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_file())


@query("op7_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_file())


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


OP5_SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, line_no, parts[line_no + 1] AS line,
         list_filter(regexp_split_to_array(translate(parts[line_no + 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM raw
), firsts AS (
  SELECT words, min({'d': doc_id, 'l': line_no}) AS place FROM lines WHERE len(words) > 0 GROUP BY words
), long AS (
  SELECT words, place, len(words) AS n FROM firsts WHERE len(words) >= 8
), variants AS (
  SELECT place, n, i, words[1:i - 1] || words[i + 1:n] AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM long)
), groups AS (
  SELECT rest, i, min(place) AS earlier FROM variants GROUP BY rest, i HAVING count(*) > 1
), pairs AS (
  SELECT v.place, g.earlier FROM variants v JOIN groups g ON v.rest = g.rest AND v.i = g.i
  UNION ALL SELECT v.place, l.place FROM variants v JOIN long l ON v.rest = l.words
  UNION ALL SELECT l.place, v.place FROM variants v JOIN long l ON v.rest = l.words
), near AS (SELECT DISTINCT place FROM pairs WHERE earlier < place),
kept AS (SELECT place FROM firsts WHERE place NOT IN (SELECT place FROM near)),
marked AS (
  SELECT l.doc_id, l.line_no, l.line, len(l.words) = 0 AS blank, k.place IS NOT NULL AS first
  FROM lines l LEFT JOIN kept k ON k.place.d = l.doc_id AND k.place.l = l.line_no
)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE blank OR first), '')) AS kept_md5
FROM marked GROUP BY doc_id
"""


@query("op5_line_dedup", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each document and the digest of the text that is left of it."""
    documents = table(spark, folder, "documents").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    return dedup_lines(documents).select("doc_id", "n_lines", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


@query("op1_source_mixing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return taken_words(table(spark, folder, "documents"))


OP6_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), o AS (SELECT payload_digest, max(page_id) AS owner FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM p JOIN o USING (payload_digest)
"""


@query("op6_warc", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return archive_pages(table(spark, folder, "pages")).drop("verified")


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP10_SQL = """
WITH r AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM r WHERE role = 'assistant'),
e AS (
  SELECT conv_id, max(turn) AS last_turn FROM a GROUP BY conv_id
), b AS (
  SELECT conv_id, max({'t': turn, 'x': text}).x AS other FROM a JOIN e USING (conv_id) WHERE turn < last_turn GROUP BY conv_id
), k AS (
  SELECT r.*, last_turn, coalesce(other, '') AS other FROM r JOIN e USING (conv_id) LEFT JOIN b USING (conv_id) WHERE turn <= last_turn
), sides AS (
  SELECT conv_id, 'chosen' AS side, turn, role, text FROM k
  UNION ALL SELECT conv_id, 'rejected', turn, role, CASE WHEN turn = last_turn AND role = 'assistant' THEN other ELSE text END FROM k
), p AS (
  SELECT conv_id, side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id, side, turn ORDER BY coalesce(role, ''), coalesce(text, '')) AS nth FROM sides
), d AS (
  SELECT conv_id, turn, nth FROM p GROUP BY conv_id, turn, nth HAVING count(*) < 2 OR min(role) <> max(role) OR min(text) <> max(text)
), f AS (SELECT conv_id, min({'t': turn, 'n': nth}) AS fork FROM d GROUP BY conv_id),
s AS (
  SELECT p.conv_id, turn, nth, role, text, CASE WHEN fork IS NULL OR {'t': turn, 'n': nth} < fork THEN 'prompt' ELSE side END AS part, side
  FROM p LEFT JOIN f USING (conv_id)
)
SELECT conv_id AS pair_id, part, turn, nth::INTEGER AS nth, role, '<|im_start|>' || role || chr(10) AS head,
       text || '<|im_end|>' || chr(10) AS body, part <> 'prompt' AND role = 'assistant' AS learn
FROM s WHERE part <> 'prompt' OR side = 'chosen'
"""


@query("op10_preference_formatting", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return format_preferences(own_reply_pairs(table(spark, folder, "conversations")))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents WHERE doc_id IS NOT NULL
), q AS (
  SELECT item_id AS query_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM benchmark WHERE item_id IS NOT NULL
), n AS (SELECT count(*) AS rows, CASE WHEN sum(len(words)) > 0 THEN avg(len(words)) ELSE 1 END AS mean FROM d),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(words) AS term FROM q) GROUP BY ALL),
dt AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(words) AS len, unnest(words) AS term FROM d) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
s AS (
  SELECT query_id, doc_id, round(sum(times * ln(1 + (rows - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM qt JOIN df USING (term) JOIN dt USING (term), n GROUP BY query_id, doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""


@query("op9_bm25_topk", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    questions = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return top_documents(questions, table(spark, folder, "documents"))


@query("op9_bm25_documents")
def op9_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The search contract's questions: every document whose id is divisible by 20, whole, against all documents."""
    documents = table(spark, folder, "documents")
    return top_documents(documents.filter(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text"), documents)


@query("op3_lsh_forest")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_suffix_dedup")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and spans removed of each document, and the digest of what is left."""
    found = remove_repeats(table(spark, folder, "documents"), kept_bytes=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
sized AS (SELECT lang, w, unnest(range(1, least(5, len(w)) + 1)) AS m FROM p WHERE len(w) > 0),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
cuts AS (SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:len(w)], ' ') AS tail FROM (SELECT *, unnest(range(1, len(w))) AS k FROM c)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail JOIN totals ON totals.lang = cuts.lang
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ones AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(w))) AS m FROM c)) GROUP BY ALL
), kept AS (SELECT weakest.* FROM weakest LEFT JOIN inner_ones USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


@query("op12_phrase_collocations", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))
