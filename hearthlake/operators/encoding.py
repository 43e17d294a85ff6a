"""Place filling, rare-category folding and one-hot columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.functions.text import category_value, with_place
from hearthlake.operators.amenities import column_values, column_shares


def fill_place(df: DataFrame, address: str = vocab.ADDRESS, place: str = vocab.PLACE) -> DataFrame:
    """Resolve the place of every listing from its own field or its address."""
    given = F.col(place).cast("string") if place in df.columns else F.lit(None).cast("string")
    source = F.col(address) if address in df.columns else F.lit(None).cast("string")
    return with_place(df, place, source, given)


def common_categories(df: DataFrame, column: str, at_least: int) -> DataFrame:
    return (
        df.groupBy(column).agg(F.count(F.lit(1)).alias("_cnt"))
        .where((F.col("_cnt") >= at_least) & F.col(column).isNotNull()).select(column)
    )


def fold_rare(
    df: DataFrame,
    column: str,
    at_least: int = vocab.MIN_LISTINGS_PER_PLACE,
    other: str = vocab.OTHER_PLACES,
) -> DataFrame:
    """Categories with fewer than `at_least` rows become `other`.

    Adaptive execution broadcasts the common categories when their measured size is small.
    """
    marked = common_categories(df, column, at_least).withColumn("_common", F.lit(True))
    joined = df.join(marked, column, "left")
    folded = F.when(F.col("_common") | F.col(column).isNull(), F.col(column)).otherwise(F.lit(other))
    return joined.withColumn(column, folded).select(*df.columns)


def dummy_name(column: str, value: str) -> str:
    return f"{column}_{value}"


def one_hot(
    df: DataFrame, columns: list[str], values: dict[str, list[str]] | None = None
) -> tuple[DataFrame, list[str]]:
    """Full one-hot of slugged categories as byte columns; returns the frame and the new names.

    Without `values` the vocabulary is read from the frame, for exploration. A model should pass
    the values of its training rows.
    """
    present = [c for c in columns if c in df.columns]
    clean = df.withColumns({c: category_value(c) for c in present}) if present else df
    if values is None:
        values = {c: column_values(clean, c) for c in present}
    dummies: dict[str, Column] = {
        dummy_name(c, v): F.coalesce(F.col(c) == v, F.lit(False)).cast("byte")
        for c in present for v in values[c]
    }
    rest = [F.col(f"`{c}`") for c in clean.columns if c not in present]
    return (
        clean.select(*rest, *[col.alias(name) for name, col in dummies.items()]),
        list(dummies),
    )


def filter_dummies(
    df: DataFrame,
    dummies: list[str],
    low: float = vocab.MIN_FLAG_SHARE,
    high: float = vocab.MAX_DUMMY_SHARE,
) -> tuple[DataFrame, list[str]]:
    """Drop dummies that are too rare or nearly constant; returns the frame and the dropped names."""
    shares = column_shares(df, dummies)
    rare = sorted(c for c in dummies if shares[c] < low)
    constant = sorted(c for c in dummies if shares[c] > high)
    return df.drop(*rare, *constant), rare + constant
