"""Repair of numeric cells from raw records, and text-to-number conversion of whole frames."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlake import vocab
from hearthlake.functions.numbers import is_numeric, parse_fee, parse_number, parse_price
from hearthlake.session import cut_lineage


def _broken(name: str) -> Column:
    return F.col(name).isNotNull() & ~is_numeric(name)


def _with_raw_cells(df: DataFrame, raw: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Attach the latest raw cells of each URL as `_raw_<column>`: one shuffle per side."""
    key = vocab.URL
    cells = F.struct(*[F.col(c).cast("string").alias(c) for c in columns if c in raw.columns])
    latest = raw.groupBy(key).agg(F.max_by(cells, F.struct(*order)).alias("_raw"))
    joined = df.join(latest, key, "left")
    return joined.select(
        *df.columns,
        *[
            (F.col("_raw")[c] if c in raw.columns else F.lit(None).cast("string")).alias(f"_raw_{c}")
            for c in columns
        ],
    )


def repair_numerics(
    df: DataFrame, raw: DataFrame, order: list[str], columns: list[str] | None = None
) -> DataFrame:
    """Replace cells that are no number by the raw record's cell, or NULL when that is none either.

    `order` ranks raw records of one URL; the last one counts. Typed numeric columns need no repair.
    """
    columns = _repairable(df, columns)
    if not columns:
        return df
    return _fixed(_with_raw_cells(df, raw, columns, order), columns, df.columns)


def _fixed(full: DataFrame, columns: list[str], kept: list[str]) -> DataFrame:
    fixed = {
        c: F.when(_broken(c), F.when(is_numeric(f"_raw_{c}"), F.col(f"_raw_{c}"))).otherwise(F.col(c))
        for c in columns
    }
    return full.withColumns(fixed).select(*kept)


def repair_counts(
    df: DataFrame, raw: DataFrame, order: list[str], columns: list[str] | None = None
) -> DataFrame:
    """Rows (column, broken, repaired) for the columns with broken cells."""
    columns = _repairable(df, columns)
    return _counted(_with_raw_cells(df, raw, columns, order), columns)


def _counted(full: DataFrame, columns: list[str]) -> DataFrame:
    counts = full.agg(*[
        F.struct(
            F.count_if(_broken(c)).alias("broken"),
            F.count_if(_broken(c) & is_numeric(f"_raw_{c}")).alias("repaired"),
        ).alias(c)
        for c in columns
    ])
    long = counts.unpivot([], columns, "column", "counts")
    return long.select("column", "counts.broken", "counts.repaired").where(F.col("broken") > 0)


def repair_and_count(
    df: DataFrame, raw: DataFrame, order: list[str], columns: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """`repair_numerics` and `repair_counts` of one join, which is cut for both."""
    columns = _repairable(df, columns)
    full = cut_lineage(_with_raw_cells(df, raw, columns, order))
    return _fixed(full, columns, df.columns), _counted(full, columns)


def _repairable(df: DataFrame, columns: list[str] | None) -> list[str]:
    wanted = columns or vocab.REPAIRABLE_COLUMNS
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return [c for c in wanted if c in text]


def to_numeric_columns(df: DataFrame) -> DataFrame:
    """Text columns to doubles by their parser; `vagas` fills `garagens` and is dropped.

    Columns that already are numbers are only cast, so 70.125 stays 70.125.
    """
    changes = {}
    for field in df.schema.fields:
        if field.name not in vocab.NUMERIC_TEXT_COLUMNS:
            continue
        if isinstance(field.dataType, T.NumericType):
            changes[field.name] = F.col(field.name).cast("double")
        elif field.name in vocab.FEE_COLUMNS:
            changes[field.name] = parse_fee(field.name)
        elif field.name in vocab.MONEY_COLUMNS:
            changes[field.name] = parse_price(field.name)
        else:
            changes[field.name] = parse_number(field.name)
    out = df.withColumns(changes) if changes else df
    if "vagas" in out.columns and "garagens" in out.columns:
        out = out.withColumn("garagens", F.coalesce("garagens", "vagas")).drop("vagas")
    return out
