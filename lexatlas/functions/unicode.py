"""Unicode normalisation and case folding.

Spark SQL has neither.  Text made only of characters that the requested form
leaves alone is handled by JVM built-ins; only the remaining rows carry their
text to an Arrow UDF (the others send a null), so a mostly plain corpus is
hardly serialised to Python at all.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Blocks in which a character's own properties decide (no character in them
# combines with its neighbours).
_PLAIN_BLOCKS = ((0x0000, 0x02FF), (0x1E00, 0x1EFF), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(points: Iterable[int], gap: int = 0) -> list[list[int]]:
    """Consecutive points as ranges; ``gap`` also bridges small holes."""
    runs: list[list[int]] = []
    for point in sorted(points):
        if runs and point <= runs[-1][1] + 1 + gap:
            runs[-1][1] = point
        else:
            runs.append([point, point])
    return runs


def _class_of(runs: Iterable[Iterable[int]]) -> str:
    return "".join(rf"\x{{{lo:04X}}}-\x{{{hi:04X}}}" for lo, hi in runs)


@lru_cache(maxsize=None)
def unsafe_pattern(form: str) -> str:
    """Regex that finds a character the form might change.

    Short runs of stable characters are left out to keep the class small; their
    texts merely take the exact path.
    """
    keep = [
        point
        for low, high in _PLAIN_BLOCKS
        for point in range(low, high + 1)
        if unicodedata.normalize(form, chr(point)) == chr(point)
    ]
    kept = [run for run in _runs(keep) if run[1] - run[0] > 4 or run == [0x111, 0x111]]
    # spelled as what to find, which matches much faster than a negated class
    starts = [0, *(run[1] + 1 for run in kept)]
    ends = [*(run[0] - 1 for run in kept), 0x10FFFF]
    return f"[{_class_of((lo, hi) for lo, hi in zip(starts, ends, strict=True) if lo <= hi)}]"


@lru_cache(maxsize=None)
def _normaliser(form: str) -> Callable:
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize(form, v))

    apply.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(apply, "string")


@lru_cache(maxsize=None)
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Lower-case characters that case folding still changes, by rule."""
    source, target, long = [], [], []
    for point in range(0x80, 0x1_E950):
        char = chr(point)
        folded = char.casefold()
        if char.lower() != char or folded == char:
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        else:
            long.append((char, folded))
    return "".join(source), "".join(target), tuple(long)


@lru_cache(maxsize=None)
def _fold_pattern() -> str:
    """Regex that finds a character lower-casing does not fold (a superset)."""
    source, _, long = _fold_tables()
    return f"[{_class_of(_runs([*map(ord, source), *(ord(char) for char, _ in long)], gap=48))}]"


def casefold(text: Column) -> Column:
    """Full case folding inside the JVM (STR-03).

    Lower-casing does nearly all of it.  Only texts with one of the remaining
    characters go through a ``translate`` and the expansions of ``ß`` and its
    like.
    """
    source, target, long = _fold_tables()

    def finish(lowered: Column) -> Column:
        expanded = F.translate(lowered, source, target)
        for char, letters in long:
            expanded = F.replace(expanded, F.lit(char), F.lit(letters))
        return F.when(lowered.rlike(_fold_pattern()), expanded).otherwise(lowered)

    return let(F.lower(text), finish)


def normalized(text: Column, form: str = "NFC", fold: bool = False) -> Column:
    """``text`` in a normal form, optionally case folded (STR-02, STR-03).

    The Arrow UDF forgets how rows are placed, so callers normalise before they
    repartition, never between two windows.
    """
    changed = _normaliser(form)(F.when(text.rlike(unsafe_pattern(form)), text))
    result = F.coalesce(changed, text)
    return casefold(result) if fold else result


def is_nfc(text: Column) -> Column:
    return normalized(text, "NFC") == text


@lru_cache(maxsize=None)
def _accent_table(form: str) -> tuple[str, str]:
    """Letters whose decomposition is one base letter plus marks, by rule."""
    source, target = [], []
    for low, high in ((0x00C0, 0x024F), (0x1E00, 0x1EFF)):
        for point in range(low, high + 1):
            char = chr(point)
            base = "".join(c for c in unicodedata.normalize(form, char) if not unicodedata.combining(c))
            if len(base) == 1 and base != char:
                source.append(char)
                target.append(base)
    # translate() deletes source characters that have no counterpart
    source.extend(chr(point) for point in range(0x0300, 0x0370))
    return "".join(source), "".join(target)


def fold_accents(text: Column) -> Column:
    """Case folded text without diacritics, ``đ`` read as ``d`` (STR-19)."""
    source, target = _accent_table("NFD")
    return F.translate(F.translate(casefold(text), source, target), "đ", "d")


def _slug(text: Column, crossed_d: str) -> Column:
    source, target = _accent_table("NFKD")
    # accents of plain Latin letters go by table; anything else through NFKD
    folded = normalized(F.translate(casefold(text), source, target), "NFKD")
    ascii_only = F.regexp_replace(F.regexp_replace(folded, "đ", crossed_d), r"[^\x00-\x7F]", "")
    return F.regexp_replace(F.regexp_replace(ascii_only, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_id(text: Column) -> Column:
    """Identifier part of chunk and parent ids (``đ`` becomes ``d_vn``, STR-16)."""
    slug = _slug(text, "d_vn")
    return F.when(slug == "", F.lit("unknown")).otherwise(slug)


def label_id(identifier: Column) -> Column:
    """:func:`safe_id` of a heading number such as ``12a`` (no UDF needed)."""
    plain = F.regexp_replace(F.replace(casefold(identifier), F.lit("đ"), F.lit("d_vn")), "[^a-z0-9]+", "_")
    return F.regexp_replace(plain, "^_+|_+$", "")


def document_slug(text: Column) -> Column:
    """Identifier of a source document (``đ`` becomes ``d``, STR-16)."""
    slug = _slug(text, "d")
    return F.when(slug == "", F.lit("document")).otherwise(slug)
