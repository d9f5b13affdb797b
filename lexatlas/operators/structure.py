"""Document hierarchy (chapter > section > article > clause > point).

The hierarchy is a set of running maxima over the line table: a heading opens a
node at its line, and a node is open on a later line when no heading of its own
or a higher level has come since.  Every window has the same partition and
order, so one placement and one sort by (document, line) serve all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexatlas.functions import patterns as P
from lexatlas.functions import text as tx
from lexatlas.functions.unicode import casefold, fold_accents
from lexatlas.operators.joins import pieces, place

LEVELS = ("chapter", "section", "article", "clause", "point")
LABELS = {"chapter": "Chương", "section": "Mục", "article": "Điều", "clause": "Khoản", "point": "Điểm"}

# keeps each line's own terminator, so text can be put together again exactly
_AFTER_BREAK = r"(?<=[\n\x0b\f\x1c-\x1e\x85  ])|(?<=\r)(?!\n)"
_TERMINATOR = r"[\r\n\x0b\f\x1c-\x1e\x85  ]+$"


def _heading_kind(line: Column) -> Column:
    """Heading level of a line on its own, before any state is known."""
    article_title = F.regexp_extract(line, P.ARTICLE, 2)
    cross_reference = ~line.rlike(P.ARTICLE_DELIMITED) & fold_accents(F.when(line.rlike(P.ARTICLE), article_title)).rlike(
        P.CITATION_TITLE
    )
    return (
        F.when(line.rlike(P.APPENDIX), "appendix")
        .when(line.rlike(P.CHAPTER), "chapter")
        .when(line.rlike(P.SECTION), "section")
        .when(line.rlike(P.ARTICLE), F.when(cross_reference, "text").otherwise("article"))
        .when(line.rlike(P.LABELED_POINT) | line.rlike(P.POINT), "point?")
        .when(line.rlike(P.LABELED_CLAUSE) | line.rlike(P.CLAUSE), "clause?")
        .otherwise("text")
    )


def _heading_pattern(part: int) -> Column:
    """Identifier (1) or title (2) under the pattern that made the heading."""
    kind, line = F.col("kind"), F.col("text")

    def first_of(*patterns: str) -> Column:
        column = F.lit("")
        for pattern in reversed(patterns):
            column = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, part)).otherwise(column)
        return column

    return (
        F.when(kind == "chapter", first_of(P.CHAPTER))
        .when(kind == "section", first_of(P.SECTION))
        .when(kind == "article", first_of(P.ARTICLE))
        .when(kind == "point", first_of(P.LABELED_POINT, P.POINT))
        .when(kind == "clause", first_of(P.LABELED_CLAUSE, P.CLAUSE))
    )


def logical_lines(documents: DataFrame, text: str = "cleaned_text", carry: tuple[str, ...] = (), placed: bool = False) -> DataFrame:
    """Lines after split-heading repair (UDT-02).

    A heading word alone on its line is joined with the number on the next one;
    a container line that ends in one is cut in two.  A consumed line can never
    itself start a repair, so neighbours decide everything.
    """
    source = documents if placed else place(documents, "doc_id", pieces(documents))
    split = source.select(
        "doc_id", *carry, F.posexplode_outer(F.split(F.coalesce(F.col(text), F.lit("")), _AFTER_BREAK)).alias("at", "piece")
    ).where((F.col("piece") != "") | (F.col("at") == 0))
    lines = split.select(
        "doc_id",
        *[F.when(F.col("at") == 0, F.col(c)).alias(c) for c in carry],
        (F.col("at") + 1).alias("n"),
        "piece",
        F.regexp_replace("piece", _TERMINATOR, "").alias("line"),
    )
    order = Window.partitionBy("doc_id").orderBy("n")
    lines = lines.withColumn("following", F.coalesce(F.lead("line").over(order), F.lit("")))
    continues = F.col("following").rlike(P.ARTICLE_CONTINUATION)
    alone = F.col("line").rlike(P.LONE_ARTICLE) & continues
    container = F.col("line").rlike(P.CONTAINER_THEN_ARTICLE) & continues & ~alone
    lines = lines.withColumn("alone", alone).withColumn("container", container)
    lines = lines.withColumn("consumed", F.coalesce(F.lag(F.col("alone") | F.col("container")).over(order), F.lit(False)))
    suspected = (
        ~F.col("alone") & ~F.col("container") & ~F.col("consumed")
        & F.col("following").rlike(P.SPLIT_CANDIDATE) & F.col("line").rlike(P.TRAILING_ARTICLE)
    )

    def piece(sub: int, end: Column, text: Column, repaired: bool) -> Column:
        return F.struct(F.lit(sub).alias("sub"), end.alias("end_line"), text.alias("text"), F.lit(repaired).alias("repaired"))

    n, line, following = F.col("n"), F.col("line"), tx.strip(F.col("following"))
    parts = (
        F.when(F.col("consumed"), F.array(piece(0, n, F.lit(""), False)))
        .when(F.col("alone"), F.array(piece(0, n + 1, F.concat_ws(" ", tx.strip(line), following), True)))
        .when(
            F.col("container"),
            F.array(
                piece(0, n, tx.strip(F.regexp_extract(line, P.CONTAINER_THEN_ARTICLE, 1)), False),
                piece(1, n + 1, F.concat_ws(" ", F.regexp_extract(line, P.CONTAINER_THEN_ARTICLE, 2), following), True),
            ),
        )
        .otherwise(F.array(piece(0, n, tx.strip(line), False)))
    )
    return lines.withColumn("suspected", suspected).select(
        "doc_id", *carry, "n", "piece", "line", "suspected", F.inline_outer(parts)
    ).withColumn("seq", F.col("n") * 2 + F.col("sub"))


def parse(documents: DataFrame, text: str = "cleaned_text", carry: tuple[str, ...] = (), placed: bool = False) -> DataFrame:
    """Line table with the open node of every level (UDT-01).

    ``*_seq`` is the position of the open node's heading or null; ``kind`` is
    the level the line itself opens, ``text`` or ``appendix``; ``live`` is false
    for blank lines and everything after the first appendix heading.
    """
    rows = logical_lines(documents, text, carry, placed)
    rows = rows.withColumn("raw_kind", F.when(F.col("text") == "", "blank").otherwise(_heading_kind(F.col("text"))))
    up = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.max((F.col("raw_kind") == "appendix").cast("int")).over(before), F.lit(0)) == 1
    rows = rows.withColumn("live", ~closed & (F.col("raw_kind") != "blank"))

    def last_heading(kind: str, name: str = "raw_kind") -> Column:
        return F.coalesce(F.max(F.when(F.col("live") & (F.col(name) == kind), F.col("seq"))).over(up), F.lit(-1))

    rows = rows.withColumns(
        {
            "_app": last_heading("appendix"),
            "_chapter": last_heading("chapter"),
            "_section": last_heading("section"),
            "_article": last_heading("article"),
        }
    )
    in_article = (F.col("_article") > F.greatest("_chapter", "_section", "_app"))
    rows = rows.withColumn(
        "kind",
        F.when(~F.col("live"), "blank")
        .when(F.col("raw_kind") == "point?", F.when(in_article, "point").otherwise("text"))
        .when(F.col("raw_kind") == "clause?", F.when(in_article, "clause").otherwise("text"))
        .otherwise(F.col("raw_kind")),
    )
    rows = rows.withColumns({"_clause": last_heading("clause", "kind"), "_point": last_heading("point", "kind")})
    clause_open = in_article & (F.col("_clause") > F.col("_article"))

    def when_open(name: str, condition: Column) -> Column:
        return F.when(condition, F.col(name))

    rows = rows.withColumns({"identifier": _heading_pattern(1), "title": tx.collapse_space(_heading_pattern(2))})
    rows = rows.withColumns(
        {
            "chapter_seq": when_open("_chapter", F.col("_chapter") > F.col("_app")),
            "section_seq": when_open("_section", F.col("_section") > F.greatest("_chapter", "_app")),
            "article_seq": when_open("_article", in_article),
            "clause_seq": when_open("_clause", clause_open),
            "point_seq": when_open("_point", clause_open & (F.col("_point") > F.col("_clause"))),
            "identifier": F.when(F.col("kind") == "chapter", F.upper("identifier"))
            .when(F.col("kind") == "point", casefold(F.when(F.col("kind") == "point", F.col("identifier"))))
            .otherwise(F.col("identifier")),
            "title": F.when(F.col("title") != "", F.col("title")),
        }
    )
    named = {
        level: F.when(
            F.col(f"{level}_seq").isNotNull(),
            F.last(F.when(F.col("kind") == level, F.col("identifier")), ignorenulls=True).over(up),
        )
        for level in LEVELS
    }
    headings = {
        f"{level}_heading": F.when(
            F.col(f"{level}_seq").isNotNull(), F.last(F.when(F.col("kind") == level, F.col("text")), ignorenulls=True).over(up)
        )
        for level in ("chapter", "section")
    }
    return rows.withColumns({**named, **headings}).drop(
        "raw_kind", "_app", "_chapter", "_section", "_article", "_clause", "_point", "sub"
    )


def entries(parsed: DataFrame) -> DataFrame:
    """Headings in document order with their path.

    A point without a clause is listed although it opens no node.
    """
    path = F.map_filter(
        F.create_map(
            *[
                x
                for level in LEVELS
                for x in (
                    F.lit(level),
                    F.concat_ws(" ", F.lit(LABELS[level]), F.when(F.col("kind") == level, F.col("identifier")).otherwise(F.col(level))),
                )
            ]
        ),
        lambda k, v: F.contains(v, F.lit(" ")),
    )
    label = F.create_map(*[x for pair in LABELS.items() for x in map(F.lit, pair)])[F.col("kind")]
    return parsed.where(F.col("live") & F.col("kind").isin(*LEVELS)).select(
        "doc_id", F.col("n").alias("line_number"), F.col("kind").alias("level"), "identifier",
        F.concat_ws(" ", label, F.col("identifier")).alias("label"), F.col("text").alias("heading"), path.alias("path"),
    )


def nodes(parsed: DataFrame) -> DataFrame:
    """Flat node table: own content, full text and line span of every node.

    A line belongs to all open levels; the deepest one owns it as content.  The
    grouping keys start with the document, so the line placement is reused.
    """
    deepest = F.coalesce("point_seq", "clause_seq", "article_seq", "section_seq", "chapter_seq")
    opened = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"{level}_seq").isNotNull(),
                    F.struct(F.lit(level).alias("level"), F.col(f"{level}_seq").alias("node_seq"), F.col(level).alias("identifier")),
                )
                for level in LEVELS
            ]
        )
    )
    member = (
        parsed.where(F.col("live") & (F.col("kind") != "appendix"))
        .withColumn("deepest", deepest)
        .withColumn("node", F.explode_outer(opened))
        .where(F.col("node").isNotNull())
    )
    in_order = lambda cond: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("seq", "text")))), lambda e: e["text"]), "\n"
    )
    own = F.col("node.node_seq") == F.col("deepest")
    opens = F.col("node.node_seq") == F.col("seq")
    return member.groupBy("doc_id", F.col("node.level").alias("level"), F.col("node.node_seq").alias("node_seq")).agg(
        F.max("node.identifier").alias("identifier"),
        F.max(F.when(opens, F.col("text"))).alias("heading"),
        F.max(F.when(opens, F.col("title"))).alias("title"),
        F.min("n").alias("start_line"),
        F.max("end_line").alias("end_line"),
        in_order(own).alias("content"),
        in_order(F.lit(True)).alias("text"),
    )


def law_name(text: Column, title: Column) -> Column:
    """Given title, else the first line in capitals (STR-18)."""
    candidates = F.filter(
        F.transform(tx.lines(text), tx.collapse_space),
        lambda line: line.rlike("[A-ZÀ-ỴĐ]") & (F.upper(line) == line) & line.rlike(r"\p{Lu}"),
    )
    given = tx.collapse_space(F.coalesce(title, F.lit("")))
    return F.when(given != "", given).otherwise(F.get(candidates, F.lit(0)))
