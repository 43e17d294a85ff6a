"""Row, value and column filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlake import vocab


def link_in_scope(
    url: Column | str,
    city: str = "pb-joao-pessoa",
    kind: str = "apartamento",
    deal: str = "venda",
) -> Column:
    """City and type by substring; `deal` is 'venda', 'aluguel' or 'ambos'."""
    link = F.lower(F.col(url) if isinstance(url, str) else url)
    is_rent = F.contains(link, F.lit("aluguel")) | F.contains(link, F.lit("locacao"))
    in_scope = F.contains(link, F.lit(city)) & F.contains(link, F.lit(kind))
    if deal == "venda":
        return in_scope & ~is_rent & F.contains(link, F.lit("venda"))
    if deal == "aluguel":
        return in_scope & is_rent
    if deal == "ambos":
        return in_scope
    raise ValueError(f"unknown deal: {deal}")


def implausible(name: str, ranges: dict | None = None) -> Column:
    low, high = (ranges or vocab.PLAUSIBLE_RANGES)[name]
    return F.col(name).isNotNull() & ~F.col(name).between(low, high)


def null_implausible(df: DataFrame, ranges: dict | None = None) -> DataFrame:
    """NULL outside the closed range; columns the frame lacks are skipped."""
    ranges = ranges or vocab.PLAUSIBLE_RANGES
    return df.withColumns({
        c: F.when(F.col(c).between(*bounds), F.col(c))
        for c, bounds in ranges.items() if c in df.columns
    })


def implausible_counts(df: DataFrame, ranges: dict | None = None) -> DataFrame:
    """Rows (column, out_of_range) for the columns that have any."""
    ranges = ranges or vocab.PLAUSIBLE_RANGES
    names = [c for c in ranges if c in df.columns]
    counts = df.agg(*[F.count_if(implausible(c, ranges)).alias(c) for c in names])
    return counts.unpivot([], names, "column", "out_of_range").where(F.col("out_of_range") > 0)


def positive_target(df: DataFrame, target: str = vocab.PRICE) -> DataFrame:
    return df.where(F.col(target) > 0)


def price_area_guard(price: Column, area: Column) -> Column:
    """Strict bounds under which a price per area is trusted."""
    return (price > 10_000) & (price < 20_000_000) & (area > 0)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with more than one distinct non-null value: min and max differ. One small row back."""
    if not columns:
        return []
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def boolean_columns(df: DataFrame, check_text: bool = False) -> list[str]:
    """Boolean columns with at least one value; `check_text` also accepts true/false text.

    Numeric 0/1 columns never qualify. One row of flags comes back to the driver.
    """
    typed = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    candidates = typed + (texts if check_text else [])
    if not candidates:
        return []
    checks = [F.count(c) > 0 if c in typed else
              F.coalesce(F.bool_and(F.lower(F.col(c)).isin("true", "false")), F.lit(False))
              for c in candidates]
    row = df.agg(*[check.alias(c) for c, check in zip(candidates, checks)]).first()
    return [c for c in df.columns if c in candidates and row[c]]


def drop_free_text(df: DataFrame, key: str = vocab.URL) -> DataFrame:
    """Drop text and identifier columns; the key comes first."""
    kept = [c for c in df.columns if c not in vocab.FREE_TEXT_COLUMNS and c != key]
    return df.select(key, *kept)


def sitemap_shard(url: Column | str, deals: list[str] | None = None) -> Column:
    """True for sitemap files that list adverts of the wanted deals."""
    url = F.col(url) if isinstance(url, str) else url
    names = "|".join(re.escape(d) for d in (deals or ["venda", "aluguel"]))
    return url.rlike(rf"sitemap-({names})-imoveis-?\d*\.xml")
