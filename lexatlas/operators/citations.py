"""Legal citations in answers and their verification against the context."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexatlas.functions import patterns as P
from lexatlas.functions import text as tx
from lexatlas.functions.unicode import casefold
from lexatlas.operators.ranking import with_rank

_FIELDS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("law_name", "article", "clause", "point")]))

# Inline forms.  The leading words belong to the match, so law
# names are looked for before them.
_FORWARD = re.compile(
    r"(?:(?P<lead>[\w\s\-]+?)\s+)?(?:[Đđ]i[ềê]u)\s+(?P<article>\d+[a-z]?)"
    r"(?:[,\s]+[Kk]ho[ảă]n\s+(?P<clause>\d+))?(?:[,\s]+[Đđ]i[ểê]m\s+(?P<point>[a-zđ]))?"
)
_REVERSED = re.compile(r"[Kk]hoản\s+(?P<clause>\d+)\s+[Đđ]iều\s+(?P<article>\d+[a-z]?)")
_LAW = re.compile(P.LAW_NAME)
_LAW_AFTER = re.compile(r"[,\s]*" + P.LAW_NAME)
_LAW_TAIL = re.compile(r"[,\s]+(?:tại|theo|cụ thể)?$", re.IGNORECASE)
_REACH = 90


def bracketed(answer: Column) -> Column:
    """Citations written in brackets (STR-27, first pass); pure SQL."""
    found = F.filter(F.regexp_extract_all(answer, F.lit(P.BRACKETED), F.lit(1)), lambda c: c.rlike(P.CITED_ARTICLE))

    def part(raw: Column, pattern: str, label: str) -> Column:
        return F.when(raw.rlike(pattern), F.concat(F.lit(label + " "), F.regexp_extract(raw, pattern, 1)))

    def law(raw: Column) -> Column:
        rest = raw
        for pattern in (P.CITED_ARTICLE, P.CITED_CLAUSE, P.CITED_POINT):
            rest = F.regexp_replace(rest, pattern, " ")
        rest = F.regexp_replace(F.regexp_replace(rest, r"(?U)[\s,;:]+", " "), r"^[ \-]+|[ \-]+$", "")
        rest = tx.strip(F.regexp_replace(rest, P.I + r"^(?:theo|tại|căn\s+cứ)\s+", ""))
        return F.when(rest != "", rest)

    return F.transform(
        F.transform(found, tx.strip),
        lambda raw: F.struct(
            law(raw).alias("law_name"),
            part(raw, P.CITED_ARTICLE, "Điều").alias("article"),
            part(raw, P.CITED_CLAUSE, "Khoản").alias("clause"),
            part(raw, P.CITED_POINT, "Điểm").alias("point"),
        ),
    )


def inline_citations(text: str) -> list[dict]:
    """Citations in running text with the law named within reach (second pass)."""

    def law_near(start: int, end: int) -> str | None:
        found = _LAW.search(text[max(0, start - _REACH) : start]) or _LAW_AFTER.match(text[end : end + _REACH])
        return found.group(1).strip() if found else None

    rows, seen = [], set()
    for pattern in (_FORWARD, _REVERSED):
        for match in pattern.finditer(text):
            law = law_near(match.start(), match.end())
            if law and pattern is _FORWARD:
                law = _LAW_TAIL.sub("", law).strip()
            named = match.groupdict()
            row = {
                "law_name": law,
                "article": f"Điều {named['article']}",
                "clause": f"Khoản {named['clause']}" if named["clause"] else None,
                "point": f"Điểm {named['point']}" if named.get("point") else None,
            }
            key = (row["article"], row["clause"], law or "")
            if key not in seen:
                seen.add(key)
                rows.append(row)
    return rows


@F.pandas_udf(_FIELDS)
def _inline(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [] if t is None else inline_citations(t))


def parse_citations(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """One row per citation (qid, n, law_name, article, clause, point).

    Only answers without a usable bracket are shipped to the inline pass.
    """
    first = answers.select("qid", F.col(answer).alias("_a"), bracketed(F.col(answer)).alias("_b"))
    second = _inline(F.when((F.size("_b") == 0) & F.col("_a").rlike("[Đđ]i[ềê]u"), F.col("_a")))
    merged = first.select("qid", F.when(F.size("_b") > 0, F.col("_b")).otherwise(second).alias("c"))
    return merged.select("qid", F.posexplode_outer("c").alias("at", "c")).where(F.col("c").isNotNull()).select("qid", (F.col("at") + 1).alias("n"), "c.*")


def match_key(text: Column) -> Column:
    """Markdown and hyphens dropped, case folded, single blanks (STR-28)."""
    return tx.collapse_space(casefold(F.regexp_replace(text, r"[*_`#~\\\-]+", " ")))


def verify(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """First context hit that supports each citation (J-08, F-13, M-27).

    The article equality is a join key; law containment and optional clause and
    point are checked on the few pairs of one question and article.
    """
    c = citations.select("*", match_key(F.col("article")).alias("_k"))
    wanted = {f: match_key(F.col(f)) for f in ("law_name", "clause", "point")}
    h = hits.select(
        "qid",
        match_key(F.col("article")).alias("_k"),
        F.col("rank").alias("_rank"),
        F.col("chunk_id").alias("_chunk"),
        (F.col("source") if "source" in hits.columns else F.lit(None).cast("string")).alias("_source"),
        *[(wanted[f] if f in hits.columns else F.lit(None).cast("string")).alias(f"_h_{f}") for f in wanted],
    )
    law, hit_law = match_key(F.col("law_name")), F.col("_h_law_name")
    agrees = F.col("law_name").isNull() | F.coalesce(F.contains(hit_law, law) | F.contains(law, hit_law), F.lit(False))
    for f in ("clause", "point"):
        agrees = agrees & (F.col(f).isNull() | F.coalesce(match_key(F.col(f)) == F.col(f"_h_{f}"), F.lit(False)))
    pairs = c.join(h, ["qid", "_k"]).where(agrees)
    best = pairs.groupBy("qid", "n").agg(F.min_by(F.struct("_chunk", "_source"), "_rank").alias("m"))
    shown = F.concat_ws(", ", "law_name", "article", "clause")
    warning = F.concat(
        F.lit("Trích dẫn '"), shown, F.lit("' không khớp với bất kỳ văn bản nào trong ngữ cảnh được cung cấp (nghi ngờ hallucination).")
    )
    return citations.join(best, ["qid", "n"], "left").select(
        *citations.columns,
        F.col("m").isNotNull().alias("is_verified"),
        F.col("m._chunk").alias("chunk_id"),
        F.col("m._source").alias("source"),
        F.when(F.col("m").isNull(), warning).alias("warning"),
    )


def confidence(verified: DataFrame) -> DataFrame:
    """Share of verified citations per answer; answers without any are absent (NUM-10)."""
    return verified.groupBy("qid").agg(
        F.count(F.lit(1)).alias("citations"),
        F.count_if("is_verified").alias("verified"),
        (F.count_if("is_verified") / F.count(F.lit(1))).alias("confidence"),
    )


def distinct_citations(citations: DataFrame) -> DataFrame:
    """First citation per (article, clause, law) of an answer (SET-07)."""
    keys = ["qid", "article", "clause", "law_name"]
    return with_rank(citations, keys, [F.col("n")], "_first").where("_first = 1").drop("_first")
