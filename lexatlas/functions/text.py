"""Token, line and n-gram columns (all JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexatlas.functions.unicode import let, normalized

# Character classes equal to the Unicode word, white-space and
# line-break classes of the published results.
WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_]+"
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x1f\x85\p{Z}]"
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def space_tokens(text: Column) -> Column:
    """White-space delimited tokens."""
    return F.regexp_extract_all(text, F.lit(f"{NOT_SPACE}+"), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of white-space delimited tokens (STR-01)."""
    return F.regexp_count(text, F.lit(f"{NOT_SPACE}+"))


def words(text: Column) -> Column:
    """Runs of word characters, cut at what lies between them, which takes a quarter of the time of finding them."""
    return F.array_remove(F.split(text, NOT_WORD), "")


def word_tokens(text: Column) -> Column:
    """Lower-cased word tokens; the passage side of BM25."""
    return words(F.lower(text))


def folded_word_tokens(text: Column, form: str = "NFC") -> Column:
    """Word tokens after normalisation and case folding (STR-06)."""
    return words(normalized(text, form, fold=True))


def matching_key(text: Column) -> Column:
    """NFKC, case folded, every non-word run one blank (STR-05)."""
    return F.trim(F.regexp_replace(normalized(text, "NFKC", fold=True), r"[^\p{L}\p{N}_]+", " "))


def query_text(text: Column) -> Column:
    """NFC with collapsed white space (STR-04)."""
    return collapse_space(normalized(text, "NFC"))


def bigrams(tokens: Column) -> Column:
    return F.array_compact(
        F.zip_with(tokens, F.slice(tokens, F.lit(2), F.size(tokens)), lambda a, b: F.concat(a, F.lit(" "), b))
    )


def ngrams_1_to_3(tokens: Column) -> Column:
    """All 1-, 2- and 3-grams in one array (STR-08)."""
    return let(
        tokens,
        lambda t: let(
            bigrams(t),
            lambda pairs: F.concat(
                t,
                pairs,
                F.array_compact(
                    F.zip_with(pairs, F.slice(t, F.lit(3), F.size(t)), lambda a, b: F.concat(a, F.lit(" "), b))
                ),
            ),
        ),
    )


def lines(text: Column) -> Column:
    """Physical lines; a final line break opens no further line."""
    return let(
        F.split(text, LINE_BREAK),
        lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts),
    )


def paragraphs(text: Column) -> Column:
    """Non-blank paragraphs (STR-15)."""
    parts = F.transform(F.split(text, rf"\n{SPACE}*\n+"), strip)
    return F.filter(parts, lambda part: part != "")


def sentences(text: Column, pattern: str = rf"(?<=[.!?;]){SPACE}+") -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda part: part != "")


def evidence_units(text: Column) -> Column:
    """Sentence units used for evidence selection (STR-13, candidate variant)."""
    return sentences(text, rf"(?<=[.!?;:]){SPACE}+|\n+")


def first_words(text: Column, count: int | Column) -> Column:
    """The first ``count`` words, single spaced (STR-22)."""
    amount = F.lit(count) if isinstance(count, int) else count
    return F.array_join(F.slice(space_tokens(text), F.lit(1), amount), " ")


def jaccard(left: Column, right: Column) -> Column:
    """Set similarity; two empty sets give zero (NUM-03)."""
    common = F.size(F.array_intersect(left, right))
    return let(F.size(F.array_union(left, right)), lambda union: F.when(union > 0, common / union).otherwise(F.lit(0.0)))


def slug_words(path: Column) -> Column:
    """Readable name from the last part of a URL path (STR-17)."""
    name = F.try_url_decode(F.regexp_extract(path, r"([^/]*)$", 1))
    stem = F.regexp_replace(name, r"(?i)\.(?:aspx?|html?)$", "")
    stem = F.regexp_replace(stem, r"-\d{5,}$", "")
    words = collapse_space(F.translate(stem, "_-", "  "))
    return F.when(words != "", words)


def source_family(link: Column) -> Column:
    """Publication family read from the URL path (STR-17)."""
    path = F.lower(url_path(link))
    return (
        F.when(path.contains("/tcvn/"), "tcvn")
        .when(path.contains("/cong-van/"), "cong_van")
        .when(path.contains("/van-ban/"), "van_ban")
        .otherwise("unknown")
    )


def url_path(link: Column) -> Column:
    """Path of a URL without query and fragment; tolerant of odd input."""
    bare = F.regexp_replace(link, r"[?#].*$", "")
    return F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*|^//[^/]*", "")
