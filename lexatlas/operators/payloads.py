"""Open payloads of hits as Variant: unknown fields stay, precedence is explicit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A payload as a map of its top-level fields; values keep any JSON type.
FIELDS = "map<string,variant>"


def fields_of(payload: Column) -> Column:
    """Top-level fields of a JSON text or Variant object; null or another kind of value has none."""
    none = F.expr(f"cast(map() as {FIELDS})")
    return F.coalesce(F.try_variant_get(payload, "$", FIELDS), none)


def parsed(text: Column) -> Column:
    """Variant of a JSON text; text that is no JSON, and repeated keys, give null."""
    return F.try_parse_json(text)


def merged(base: Column, over: Column) -> Column:
    """Fields of both; where both have one, that of ``over`` counts, unless it is missing or null (update)."""
    both = F.map_zip_with(base, over, lambda _, a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform_values(both, lambda _, v: F.when(v["b"].isNull() | F.is_variant_null(v["b"]), v["a"]).otherwise(v["b"]))


def with_defaults(payload: Column, defaults: Column) -> Column:
    """Fields of ``payload`` and, where it has none, those of ``defaults`` (set-default)."""
    return merged(defaults, payload)


def unknown_fields(payload: Column, allowed: Sequence[str], nullable: Sequence[str] = ()) -> Column:
    """Names that break a closed record (M-29): fields not allowed, and nulls where none may be; in order."""
    allowed_names, may_be_null = F.array(*[F.lit(n) for n in allowed]), F.array(*[F.lit(n) for n in nullable]).cast("array<string>")
    bad = F.map_filter(payload, lambda k, v: ~F.array_contains(allowed_names, k) | ((v.isNull() | F.is_variant_null(v)) & ~F.array_contains(may_be_null, k)))
    return F.array_sort(F.map_keys(bad))


def as_json(payload: Column) -> Column:
    """The fields as JSON text in the order of their names."""
    entries = F.array_sort(F.transform(F.map_keys(payload), lambda k: k))
    name = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    lines = F.transform(entries, lambda k: F.concat(name(k), F.lit(":"), F.coalesce(F.to_json(payload[k]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(lines, ","), F.lit("}"))


def merge_hits(hits: DataFrame, stored: DataFrame, key: str = "chunk_id", columns: Mapping[str, str] = {}) -> DataFrame:
    """Hits whose payload takes what the stored payload of their chunk has and they lack (JSN-02).

    ``hits`` and ``stored`` have ``key`` and ``payload`` (JSON text);
    ``columns`` names payload fields that also become columns of text.
    A hit without a stored chunk keeps its own payload.
    """
    own = hits.withColumn("_own", fields_of(parsed(F.col("payload"))))
    kept = stored.select(key, fields_of(parsed(F.col("payload"))).alias("_stored"))
    whole = own.join(kept, key, "left").withColumn("_merged", with_defaults(F.col("_own"), F.coalesce("_stored", F.expr(f"cast(map() as {FIELDS})"))))
    named = [F.variant_get(F.col("_merged")[field], "$", "string").alias(name) for name, field in columns.items()]
    return whole.select(*[F.col(c) for c in hits.columns if c != "payload"], as_json(F.col("_merged")).alias("payload"), *named)
