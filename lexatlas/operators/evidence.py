"""Parent contexts around retrieved chunks, within token budgets."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexatlas.functions import text as tx
from lexatlas.operators.ranking import fuse_chunks, fuse_parents, with_rank

# Token budgets of the published configurations.
BASE_BUDGET = (2048, 7000)
EXTRACTIVE_BUDGET = (384, 1152)
PARENT_BUDGET = (512, 1024)
GAP = "[…]"


def find_words(words: Sequence[str], wanted: Sequence[str]) -> int | None:
    """Position of the first exact run of ``wanted`` in ``words`` (STR-24).

    Words hold no blanks, so a padded string search finds whole words only.
    """
    if not wanted:
        return 0
    at = f" {' '.join(words)} ".find(f" {' '.join(wanted)} ")
    return None if at < 0 else f" {' '.join(words)} "[:at].count(" ")


def _spans(words: list[str], anchors: Sequence[str], limit: int) -> list[tuple[int, int]]:
    """Merged word spans of ``limit`` words in all, centred on the anchors."""
    folded = [w.casefold() for w in words]
    found = []
    for anchor in anchors:
        wanted = [w.casefold() for w in anchor.split()]
        at = find_words(folded, wanted) if wanted else None
        if at is not None:
            found.append((at, at + len(wanted)))
    if not found:
        return []
    share = max(1, limit // len(found))
    spans: list[tuple[int, int]] = []
    for start, end in found:
        extra = max(share - (end - start), 0)
        spans.append((max(0, start - extra // 2), min(len(words), end + extra - extra // 2)))
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((start, end))
    return merged


def window_text(parent: str, anchors: Sequence[str], limit: int) -> str | None:
    """Whole parent if it fits, else anchored windows joined by a gap (STR-25)."""
    words = parent.split()
    if not words or limit < 1:
        return None
    if len(words) <= limit:
        return parent.strip()
    output: list[str] = []
    for start, end in _spans(words, anchors, limit):
        if output and len(output) < limit:
            output.append(GAP)
        output += words[start : min(end, start + limit - len(output))]
    return " ".join(output) or None


def single_window(parent: str, anchor: str, limit: int) -> str:
    """One-anchor window; an anchor that is not found stands for itself."""
    words = parent.split()
    if len(words) <= limit:
        return parent.strip()
    spans = _spans(words, [anchor], limit)
    if not spans:
        return " ".join(anchor.split()[:limit])
    left, right = spans[0]
    return " ".join(words[left : min(right, left + limit)])


_CONTEXT = "array<struct<place:int,text:string,expanded:boolean,tokens:int,truncated:boolean>>"


def _expander(max_parent: int, max_total: int):
    @F.pandas_udf(_CONTEXT)
    def expand(groups: pd.Series) -> pd.Series:
        def one(items) -> list[dict]:
            left, contexts = max_total, []
            for item in items:
                if left <= 0:
                    break
                text = item["parent_text"]
                shown = window_text(text, list(item["anchors"]), min(max_parent, left)) if text else None
                if shown is not None:
                    size = len(shown.split())
                    contexts.append(dict(place=item["place"], text=shown, expanded=True, tokens=size, truncated=size < len(text.split())))
                    left -= size
                    continue
                for child in item["anchors"]:
                    words = child.split()[: max(left, 0)]
                    if not words:
                        break
                    contexts.append(dict(place=item["place"], text=" ".join(words), expanded=False, tokens=len(words), truncated=False))
                    left -= len(words)
            return contexts

        return groups.map(one)

    return expand


def expand_parents(hits: DataFrame, parents: DataFrame, max_parent: int = BASE_BUDGET[0], max_total: int = BASE_BUDGET[1]) -> DataFrame:
    """Prompt contexts of each question from its ranked hits (J-18, UDT-08, W-09).

    Hits of one parent form one group at their best rank; a parent whose
    article contradicts a hit is not used.  The running budget is sequential,
    so it is folded over the few groups of a question in an Arrow UDF.
    """
    if not 0 < max_parent <= max_total:
        raise ValueError("limits must be positive and ordered")
    key = F.coalesce(F.col("parent_id"), F.concat(F.lit("\x00"), F.col("chunk_id")))
    has_article = "article" in hits.columns
    rows = hits.withColumn("_group", key).withColumn("_article", F.col("article") if has_article else F.lit(None).cast("string"))
    grouped = rows.groupBy("qid", "doc_id", "_group").agg(
        F.min("rank").alias("place"),
        F.max("parent_id").alias("parent_id"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda e: e["text"]).alias("anchors"),
        F.collect_set("_article").alias("articles"),
        F.min_by("chunk_id", "rank").alias("chunk_id"),
    )
    known = parents.select(
        "doc_id",
        "parent_id",
        F.col("text").alias("parent_text"),
        (F.col("article") if "article" in parents.columns else F.lit(None).cast("string")).alias("parent_article"),
    )
    joined = grouped.join(known, ["doc_id", "parent_id"], "left")
    conflict = F.exists("articles", lambda a: (a != "") & (F.col("parent_article") != "") & (a != F.col("parent_article")))
    usable = F.when(F.coalesce(conflict, F.lit(False)), F.lit(None)).otherwise(F.col("parent_text"))
    listed = joined.groupBy("qid").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("place").cast("int").alias("place"), "doc_id", F.col("parent_id"), "chunk_id", usable.alias("parent_text"), "anchors"))
        ).alias("groups")
    )
    contexts = listed.select("qid", "groups", F.posexplode_outer(_expander(max_parent, max_total)(F.col("groups"))).alias("at", "c"))
    contexts = contexts.where(F.col("c").isNotNull())
    group = F.get(F.filter("groups", lambda g: g["place"] == F.col("c.place")), F.lit(0))
    return contexts.select(
        "qid", (F.col("at") + 1).alias("rank"), group["doc_id"].alias("doc_id"), group["parent_id"].alias("parent_id"),
        group["chunk_id"].alias("chunk_id"), F.col("c.text").alias("text"), F.col("c.expanded").alias("expanded"),
        F.col("c.tokens").alias("tokens"), F.col("c.truncated").alias("truncated"),
    )


def joined_answer(contexts: DataFrame) -> DataFrame:
    """Context texts of a question, one per line, in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.trim("text").alias("text"))))
    return contexts.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda e: e["text"]), "\n").alias("answer"))


def extractive_answers(
    dense: DataFrame,
    reranked: DataFrame,
    parents: DataFrame,
    top_chunks: int = 3,
    max_parent: int = EXTRACTIVE_BUDGET[0],
    max_total: int = EXTRACTIVE_BUDGET[1],
) -> DataFrame:
    """Answer text from the best fused chunks and their parents (UDT-10)."""
    best = fuse_chunks(dense, reranked).where(F.col("rank") <= top_chunks).select("qid", "chunk_id", "rank")
    payload = [c for c in ("doc_id", "parent_id", "text", "article") if c in reranked.columns]
    hits = best.join(reranked.select("qid", "chunk_id", *payload), ["qid", "chunk_id"])
    return joined_answer(expand_parents(hits, parents, max_parent, max_total))


def evidence_from_parents(
    parents: DataFrame, top_parents: int = 2, max_parent: int = PARENT_BUDGET[0], max_total: int = PARENT_BUDGET[1], **fusion: float
) -> DataFrame:
    """Answer from the best scored parents of each question (UDT-11)."""
    best = fuse_parents(parents, **fusion).where(F.col("fused_rank") <= top_parents)

    @F.pandas_udf("array<string>")
    def windows(items: pd.Series) -> pd.Series:
        def one(group) -> list[str]:
            left, spans = max_total, []
            for item in group:
                if left <= 0:
                    break
                spans.append(single_window(item["parent_text"], item["anchor_text"], min(max_parent, left)))
                left -= len(spans[-1].split())
            return spans

        return items.map(one)

    listed = best.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("fused_rank", "parent_text", "anchor_text"))).alias("g")
    )
    return listed.select("qid", F.trim(F.array_join(windows(F.col("g")), "\n")).alias("answer"))


def score_order_violations(parents: DataFrame) -> DataFrame:
    """Questions whose ranks have gaps or contradict the logits (V-08, SRC-20)."""
    order = Window.partitionBy("qid").orderBy("rank")
    rows = parents.withColumn("_n", F.row_number().over(order)).withColumn("_prev", F.lag("crossencoder_logit").over(order))
    return rows.groupBy("qid").agg(
        F.max((F.col("rank") != F.col("_n")).cast("int")).alias("gap"),
        F.max(F.coalesce(F.col("_prev") < F.col("crossencoder_logit"), F.lit(False)).cast("int")).alias("contradiction"),
    ).where("gap = 1 or contradiction = 1")


def canonical_evidence(gold: DataFrame, parents: DataFrame, limit: int = 2) -> DataFrame:
    """First non-blank parents of each gold document as its evidence (J-16).

    Parents are cut to the wanted documents before they are ranked.
    """
    wanted = gold.select("doc_id").distinct()
    filled = parents.where(tx.strip(F.col("text")) != "").join(wanted, "doc_id", "left_semi")
    first = with_rank(filled, ["doc_id"], [F.col("parent_id"), F.col("text")], "n").where(F.col("n") <= limit)
    ordered = F.array_sort(F.collect_list(F.struct("n", "parent_id", tx.strip(F.col("text")).alias("text"))))
    found = first.groupBy("doc_id").agg(ordered.alias("e"))
    return wanted.join(found, "doc_id", "left").select(
        "doc_id",
        F.transform("e", lambda e: e["parent_id"]).alias("evidence_ids"),
        F.array_join(F.transform("e", lambda e: e["text"]), "\n\n").alias("evidence"),
        F.when(F.col("e").isNull(), "unresolved").otherwise("resolved").alias("status"),
    )


def context_block(contexts: DataFrame, sentinel: str = "") -> DataFrame:
    """Numbered prompt block of each question (STR-29)."""
    fields = ("law_name", "article", "clause", "point")
    meta = F.concat_ws(
        " | ",
        *[
            F.concat(F.lit(f"{f}="), F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit("N/A")) if f in contexts.columns else F.lit("N/A"))
            for f in fields
        ],
        F.concat(F.lit("chunk_id="), F.col("chunk_id").cast("string")),
    )
    entry = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), meta, F.lit(")\n"), tx.strip(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
    block = F.array_join(F.transform(ordered, lambda e: e["entry"]), "\n\n")
    return contexts.groupBy("qid").agg(F.when(block == "", F.lit(sentinel)).otherwise(block).alias("context_block"))


def render_prompt(question: Column, block: Column, system: str, template: str) -> Column:
    """System text and filled user turn as chat messages (STR-29)."""
    user = F.replace(F.replace(F.lit(template), F.lit("{context_block}"), block), F.lit("{question}"), question)
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
