"""Queries over tokens, lines, keys, duplicates and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexatlas.functions import ngrams
from lexatlas.functions import text as tx
from lexatlas.functions import unicode as uc
from lexatlas.operators import answers, audit, chunking, dedupe, folds, hashtree
from lexatlas.plans import inputs
from lexatlas.plans.registry import query

# SQL spellings of the character classes
SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
TOKEN = r"[^\t-\r\x1c-\x1f\x{85}\p{Z}]+"
WORD = r"[\p{L}\p{N}_]+"
FOLDED = "replace(lower(nfc_normalize({0})), 'ß', 'ss')"


@query("token_counts", rf"""
SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}'))::BIGINT AS n_tokens,
       len(regexp_extract_all(lower(text), '{WORD}'))::BIGINT AS n_words,
       len(list_distinct(regexp_extract_all(lower(text), '{WORD}')))::BIGINT AS n_distinct
FROM documents""")
def token_counts(spark, folder):
    words = tx.word_tokens(F.col("text"))
    return inputs.documents(spark, folder).select(
        "doc_id", tx.token_count(F.col("text")).cast("long").alias("n_tokens"),
        F.size(words).cast("long").alias("n_words"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
    )


@query("ngram_counts", rf"""
WITH t AS (SELECT regexp_extract_all(lower(text), '{WORD}') AS w FROM documents),
g AS (SELECT n, array_to_string(w[i:i+n-1], ' ') AS term
      FROM (SELECT w, n, unnest(range(1, greatest(len(w)-n+2, 1))) AS i FROM t, (VALUES (1),(2),(3)) v(n)))
SELECT n::BIGINT AS n, count(*)::BIGINT AS total, count(DISTINCT term)::BIGINT AS distinct_terms FROM g GROUP BY n""")
def ngram_counts(spark, folder):
    words = inputs.documents(spark, folder).select(tx.word_tokens(F.col("text")).alias("w"))
    counted = ngrams.ngram_keys(words, "w").groupBy("n", "k1", "k2").agg(F.sum("c").alias("c"))
    return counted.groupBy(F.col("n").cast("long").alias("n")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("distinct_terms"))


@query("folded_words", rf"""
SELECT doc_id, sha256(array_to_string(regexp_extract_all({FOLDED.format('text')}, '{WORD}'), ' ')) AS words FROM documents""")
def folded_words(spark, folder):
    return inputs.documents(spark, folder).select("doc_id", F.sha2(F.array_join(tx.folded_word_tokens(F.col("text")), " "), 256).alias("words"))


@query("accent_folding", r"""
SELECT doc_id, sha256(replace(strip_accents(replace(lower(text), 'ß', 'ss')), 'đ', 'd')) AS folded FROM documents""")
def accent_folding(spark, folder):
    return inputs.documents(spark, folder).select("doc_id", F.sha2(uc.fold_accents(F.col("text")), 256).alias("folded"))


@query("safe_identifiers", r"""
SELECT doc_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(strip_accents(replace(lower(source || ' ' || lang || ' ' || text), 'ß', 'ss')), 'đ', 'd_vn'),
         '[^\x00-\x7f]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM documents)""")
def safe_identifiers(spark, folder):
    return inputs.documents(spark, folder).select("doc_id", uc.safe_id(F.concat_ws(" ", "source", "lang", "text")).alias("slug"))


@query("line_and_paragraph_counts", rf"""
SELECT doc_id, (len(string_split(text, chr(10))) - (CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END))::BIGINT AS n_lines,
  len(list_filter(string_split_regex(text, '\n{SPACE}*\n+'), lambda p: regexp_matches(p, '{TOKEN}')))::BIGINT AS n_paragraphs
FROM documents""")
def line_and_paragraph_counts(spark, folder):
    text = F.col("text")
    return inputs.documents(spark, folder).select(
        "doc_id", F.size(tx.lines(text)).cast("long").alias("n_lines"), F.size(tx.paragraphs(text)).cast("long").alias("n_paragraphs")
    )


@query("sentence_counts", rf"""
SELECT doc_id,
  len(list_filter(string_split(regexp_replace(text, '([.!?;]){SPACE}+', '\1' || chr(1), 'g'), chr(1)), lambda p: regexp_matches(p, '{TOKEN}')))::BIGINT AS n_sentences,
  len(list_filter(string_split_regex(regexp_replace(text, '([.!?;:]){SPACE}+', '\1' || chr(1), 'g'), '\x01|\n+'), lambda p: regexp_matches(p, '{TOKEN}')))::BIGINT AS n_units
FROM documents""")
def sentence_counts(spark, folder):
    text = F.col("text")
    return inputs.documents(spark, folder).select(
        "doc_id", F.size(tx.sentences(text)).cast("long").alias("n_sentences"), F.size(tx.evidence_units(text)).cast("long").alias("n_units")
    )


@query("first_words", rf"""
SELECT doc_id, array_to_string(regexp_extract_all(text, '{TOKEN}')[1:20], ' ') AS head FROM documents""")
def first_words(spark, folder):
    return inputs.documents(spark, folder).select("doc_id", tx.first_words(F.col("text"), 20).alias("head"))


@query("token_windows", rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(1, ceil((len(w)-192)/160.0)::BIGINT + 1))) AS i FROM t WHERE len(w) > 0)
SELECT doc_id, (i+1)::BIGINT AS part, len(w[i*160+1:i*160+192])::BIGINT AS n_tokens, sha256(array_to_string(w[i*160+1:i*160+192], ' ')) AS window_hash FROM s""")
def token_windows(spark, folder):
    parts = inputs.documents(spark, folder).select("doc_id", F.posexplode(chunking.token_windows(F.col("text"), 192, 32)).alias("i", "t"))
    return parts.select(
        "doc_id", (F.col("i") + 1).cast("long").alias("part"), tx.token_count(F.col("t")).cast("long").alias("n_tokens"), F.sha2("t", 256).alias("window_hash")
    )


@query("law_names_from_urls", r"""
SELECT page_id, nullif(trim(regexp_replace(translate(regexp_replace(regexp_replace(url_decode(regexp_extract(path, '([^/]*)$', 1)), '(?i)\.(?:aspx?|html?)$', ''), '-\d{5,}$', ''), '_-', '  '), '\s+', ' ', 'g')), '') AS law_name,
  CASE WHEN contains(lower(path), '/tcvn/') THEN 'tcvn' WHEN contains(lower(path), '/cong-van/') THEN 'cong_van' WHEN contains(lower(path), '/van-ban/') THEN 'van_ban' ELSE 'unknown' END AS family
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*', '') AS path FROM pages)""")
def law_names_from_urls(spark, folder):
    path = tx.url_path(F.col("url"))
    return inputs.table(spark, folder, "pages").select("page_id", tx.slug_words(path).alias("law_name"), tx.source_family(F.col("url")).alias("family"))


_TERMS = ("and", "The", "une", "Les", "aus", "No.", "is")


@query("expanded_terms", "SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join(f"'{t}'" for t in _TERMS) + r"], lambda k: regexp_matches(text, '(?:^|[^\p{L}\p{N}_])' || replace(k, '.', '\.') || '(?:[^\p{L}\p{N}_]|$)'))), '|') AS terms FROM documents")
def expanded_terms(spark, folder):
    from lexatlas.operators.cleaning import expanded_terms as present

    table = F.create_map(*[F.lit(x) for t in _TERMS for x in (t, f"form of {t}")])
    return inputs.documents(spark, folder).select("doc_id", F.array_join(F.array_sort(F.map_keys(present(F.col("text"), table))), "|").alias("terms"))


@query("repeated_lines_dropped", r"""
WITH l AS (SELECT conv_id, turn, string_split(text || chr(10) || text, chr(10)) AS a FROM conversations)
SELECT conv_id, turn, sha256(trim(array_to_string(list_filter(a, lambda x, i: i = 1 OR length(trim(lower(x))) <= 5 OR trim(lower(a[i-1])) <> trim(lower(x))), chr(10)))) AS kept,
  len(list_filter(a, lambda x, i: NOT (i = 1 OR length(trim(lower(x))) <= 5 OR trim(lower(a[i-1])) <> trim(lower(x)))))::BIGINT AS dropped FROM l""")
def repeated_lines_dropped(spark, folder):
    # each turn is repeated once, so a one-line turn repeats its line
    twice = F.concat("text", F.lit("\n"), "text")
    kept = answers.drop_repeated_lines(twice)
    return inputs.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.sha2(kept, 256).alias("kept"), (F.size(tx.lines(twice)) - F.size(tx.lines(kept))).cast("long").alias("dropped")
    )


_KEY = rf"trim(regexp_replace({FOLDED.format('question')}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
TURNS = "turns AS (SELECT conv_id || '-' || turn AS qid, text AS question FROM conversations)"
GROUPED = f"grouped AS (SELECT qid, question, {_KEY} AS group_key FROM turns)"


@query("question_groups", f"""
WITH {TURNS}, {GROUPED} SELECT sha256(group_key) AS group_hash, count(*)::BIGINT AS size, min(qid) AS first_qid FROM grouped GROUP BY group_key""")
def question_groups(spark, folder):
    grouped = folds.with_group(inputs.turns(spark, folder))
    return folds.group_sizes(grouped).select(F.sha2("group_key", 256).alias("group_hash"), "size", "first_qid")


@query("duplicate_documents", """
SELECT sha256(text) AS content_hash, count(*)::BIGINT AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_documents(spark, folder):
    return dedupe.duplicate_groups(inputs.documents(spark, folder), "doc_id", F.col("text"))


@query("conflicting_ids", """
SELECT conv_id, count(*)::BIGINT AS rows FROM conversations GROUP BY conv_id HAVING min(sha256(text)) <> max(sha256(text))""")
def conflicting_ids(spark, folder):
    return dedupe.conflicting_ids(inputs.table(spark, folder, "conversations"), "conv_id", F.col("text"))


@query("keep_first_per_source", """
SELECT source, doc_id, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) = 1""")
def keep_first_per_source(spark, folder):
    rows = inputs.documents(spark, folder).select("source", "doc_id", "lang", "n_chars")
    return dedupe.keep_first(rows, ["source"], ["n_chars", "doc_id"])


@query("corpus_xor_hash", """
WITH h AS (SELECT sha256(doc_id::VARCHAR || ':' || text) AS d FROM documents),
x AS (SELECT count(*)::BIGINT AS record_count, bit_xor(('0x' || d[1:15])::BIGINT) AS a, bit_xor(('0x' || d[16:30])::BIGINT) AS b, bit_xor(('0x' || d[31:45])::BIGINT) AS c,
  bit_xor(('0x' || d[46:60])::BIGINT) AS e, bit_xor(('0x' || d[61:64])::BIGINT) AS f, sum(('0x' || d[1:8])::BIGINT)::BIGINT AS prefix_sum FROM h)
SELECT record_count, lpad(lower(hex(a)),15,'0') || lpad(lower(hex(b)),15,'0') || lpad(lower(hex(c)),15,'0') || lpad(lower(hex(e)),15,'0') || lpad(lower(hex(f)),4,'0') AS xor_sha256, prefix_sum FROM x""")
def corpus_xor_hash(spark, folder):
    return dedupe.corpus_xor(inputs.documents(spark, folder), F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text"))


_HASH_TREE = """
e AS (SELECT doc_id::VARCHAR AS key, sha256(text) AS h, count(*) AS copies FROM documents GROUP BY ALL), n AS (SELECT count(*) AS n FROM e),
d AS (SELECT CASE WHEN n <= 256 THEN 0 WHEN n <= 4096 THEN 1 WHEN n <= 65536 THEN 2 ELSE 3 END AS depth FROM n),
l AS (SELECT sha256(key || ':' || h)[1:depth] AS prefix, sum(copies)::BIGINT AS rows, sha256(string_agg(key || ':' || h || ':' || copies, chr(10) ORDER BY key || ':' || h || ':' || copies)) AS sha256 FROM e, d GROUP BY 1),
p1 AS (SELECT prefix[1:len(prefix) - 1] AS prefix, sum(rows)::BIGINT AS rows, sha256(string_agg(prefix || ':' || sha256, chr(10) ORDER BY prefix)) AS sha256 FROM l WHERE prefix <> '' GROUP BY 1),
p2 AS (SELECT prefix[1:len(prefix) - 1] AS prefix, sum(rows)::BIGINT AS rows, sha256(string_agg(prefix || ':' || sha256, chr(10) ORDER BY prefix)) AS sha256 FROM p1 WHERE prefix <> '' GROUP BY 1),
p3 AS (SELECT prefix[1:len(prefix) - 1] AS prefix, sum(rows)::BIGINT AS rows, sha256(string_agg(prefix || ':' || sha256, chr(10) ORDER BY prefix)) AS sha256 FROM p2 WHERE prefix <> '' GROUP BY 1),
nodes AS (SELECT * FROM l UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)"""


@query("corpus_ordered_hash", f"WITH {_HASH_TREE} SELECT sha256 AS corpus_sha256, rows AS record_count FROM nodes WHERE prefix = ''")
def corpus_ordered_hash(spark, folder):
    return hashtree.root(hashtree.hash_tree(inputs.documents(spark, folder), "doc_id", F.col("text")))


@query("corpus_hash_tree", f"WITH {_HASH_TREE} SELECT prefix, rows, sha256 FROM nodes")
def corpus_hash_tree(spark, folder):
    return hashtree.hash_tree(inputs.documents(spark, folder), "doc_id", F.col("text")).nodes


@query("corpus_changes", """
SELECT CASE WHEN doc_id % 50 = 0 THEN 'removed' ELSE side END AS change, doc_id::VARCHAR AS key, 1::BIGINT AS copies
FROM documents, (VALUES ('removed'), ('added')) v(side) WHERE (doc_id % 50 = 0 AND side = 'removed') OR doc_id % 50 = 7""")
def corpus_changes(spark, folder):
    """Every fiftieth document lost and another changed, found by descending from the root."""
    before = inputs.documents(spark, folder).select("doc_id", "text")
    after = before.where("doc_id % 50 <> 0").withColumn("text", F.when(F.col("doc_id") % 50 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    old = hashtree.hash_tree(before, "doc_id", F.col("text"))
    return hashtree.changed_entries(old, hashtree.hash_tree(after, "doc_id", F.col("text"), depth=old.depth)).select("change", "key", "copies")


@query("line_multiset_difference", """
WITH l AS (SELECT q.quality, unnest(string_split(d.text, chr(10))) AS line FROM documents d JOIN labels q USING (doc_id)),
c AS (SELECT line, sum(CASE WHEN quality = 1 THEN 1 ELSE -1 END)::BIGINT AS missing FROM l WHERE trim(line) <> '' GROUP BY line)
SELECT sha256(line) AS line_hash, missing FROM c WHERE missing > 0""")
def line_multiset_difference(spark, folder):
    rows = inputs.documents(spark, folder).join(inputs.table(spark, folder, "labels"), "doc_id")
    lines = rows.select("quality", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    good, bad = lines.where("quality = 1").select("line"), lines.where("quality <> 1").select("line")
    return dedupe.multiset_difference(good, bad, ["line"]).select(F.sha2("line", 256).alias("line_hash"), "missing")


@query("identifier_validity", r"""
SELECT count(*)::BIGINT AS rows, count(*) FILTER (WHERE regexp_matches(u, '^\S') AND regexp_matches(u, '\S$') AND NOT regexp_matches(u, '[\x00-\x1f\x7f-\x{9f}]'))::BIGINT AS valid
FROM (SELECT url AS u FROM pages UNION ALL SELECT text FROM documents)""")
def identifier_validity(spark, folder):
    ids = inputs.table(spark, folder, "pages").select(F.col("url").alias("u")).unionByName(inputs.documents(spark, folder).select(F.col("text").alias("u")))
    return ids.agg(F.count(F.lit(1)).alias("rows"), F.count_if(audit.valid_identifier(F.col("u"))).alias("valid"))


_BARE = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
NOISE = rf"""noise AS (SELECT doc_id, source, length(b)::BIGINT AS char_count, len(regexp_extract_all(b, '{TOKEN}'))::BIGINT AS review_tokens,
  len(regexp_extract_all(b, '\p{{Nd}}')) / greatest(length(b), 1) AS digit_ratio,
  len(regexp_extract_all(b, '[^\p{{L}}\p{{N}}\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]')) / greatest(length(b), 1) AS symbol_ratio,
  CASE WHEN len(f) > 0 THEN len(list_filter(f, lambda x: length(x) <= 4)) / len(f) ELSE 0.0 END AS short_line_ratio
 FROM (SELECT doc_id, source, b, list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS f FROM (SELECT doc_id, source, {_BARE} AS b FROM documents))),
reviewed AS (SELECT *, CASE WHEN char_count = 0 THEN 'cleaner_cleared_text' WHEN digit_ratio > 0.12 OR symbol_ratio > 0.18 OR short_line_ratio > 0.4 THEN 'ocr_noise'
  WHEN review_tokens < 20 THEN 'cleaner_cleared_text' ELSE 'no_article_structure' END AS reason FROM noise)"""


@query("review_reasons", f"""
WITH {NOISE} SELECT doc_id, reason, char_count, review_tokens, round(digit_ratio, 6) AS digit_ratio, round(symbol_ratio, 6) AS symbol_ratio, round(short_line_ratio, 6) AS short_line_ratio FROM reviewed""")
def review_reasons(spark, folder):
    reviewed = audit.review_reason(inputs.documents(spark, folder), "text", removed=None)
    return reviewed.select(
        "doc_id", "reason", F.col("char_count").cast("long").alias("char_count"), F.col("review_tokens").cast("long").alias("review_tokens"),
        *[F.round(c, 6).alias(c) for c in ("digit_ratio", "symbol_ratio", "short_line_ratio")],
    )


@query("review_buckets", f"""
WITH {NOISE}, s AS (SELECT reason, doc_id, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS n FROM reviewed),
h AS (SELECT reason, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS sample FROM s WHERE n <= 10 GROUP BY reason)
SELECT reason, c.n, h.sample FROM (SELECT reason, count(*)::BIGINT AS n FROM reviewed GROUP BY reason) c JOIN h USING (reason)""")
def review_buckets(spark, folder):
    reviewed = audit.review_reason(inputs.documents(spark, folder), "text", removed=None)
    return audit.review_buckets(reviewed).select("reason", "n", F.array_join(F.transform("sample_ids", lambda i: i.cast("string")), ",").alias("sample"))


@query("fixture_profile", """
SELECT count(*)::BIGINT AS record_count, count(*) FILTER (WHERE text IS NULL OR text = '')::BIGINT AS missing_question, count(*) FILTER (WHERE role <> 'assistant')::BIGINT AS missing_answer,
 (count(*) FILTER (WHERE text IS NULL OR text = '') + count(*) FILTER (WHERE role <> 'assistant'))::BIGINT AS missing_total,
 CASE WHEN count(*) FILTER (WHERE role = 'assistant') > 0 THEN 'text' ELSE 'none' END AS answer_kind FROM conversations""")
def fixture_profile(spark, folder):
    rows = inputs.table(spark, folder, "conversations").select(
        F.col("text").alias("question"), F.when(F.col("role") == "assistant", F.col("text")).alias("answer_text"), F.lit(None).cast("array<string>").alias("answer_list")
    )
    return audit.fixture_profile(rows)


@query("seeded_sample", """
SELECT doc_id FROM documents ORDER BY sha256('2026:' || doc_id::VARCHAR), doc_id LIMIT 100""")
def seeded_sample(spark, folder):
    return folds.seeded_sample(inputs.documents(spark, folder).select("doc_id"), 100, "doc_id")
