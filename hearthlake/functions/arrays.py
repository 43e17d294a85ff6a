"""JSON, array and map helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_string_array(col: Column | str) -> Column:
    """Array of strings from JSON text; anything else is an empty array."""
    col = F.col(col) if isinstance(col, str) else col
    empty = F.array().cast("array<string>")
    parsed = F.from_json(col, "array<string>")
    return F.coalesce(F.filter(parsed, lambda x: x.isNotNull()), empty)


def union_sorted(left: Column, right: Column) -> Column:
    """Sorted union of two string arrays, missing sides empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(left, empty), F.coalesce(right, empty)))


def overlay(base: Column, update: Column) -> Column:
    """Map update in which the right side wins per key."""
    kept = F.map_filter(base, lambda k, _: ~F.coalesce(F.map_contains_key(update, k), F.lit(False)))
    return F.when(update.isNull(), base).otherwise(F.map_concat(kept, update))


def flat_for_text_sinks(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, picked from the schema; other columns untouched."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields
    ])


def record_as_json(df: DataFrame, out: str = "detalhes_completos_json") -> DataFrame:
    return df.withColumn(out, F.to_json(F.struct(*[F.col(c) for c in df.columns])))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
