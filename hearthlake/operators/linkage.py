"""Deduplication, cross-portal linkage keys and survivorship."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.functions.arrays import json_string_array
from hearthlake.functions.numbers import parse_number, parse_price
from hearthlake.functions.text import with_place

LINK_HELPERS = ["preco_norm", "area_norm", "quartos_norm", "bairro_norm", "origem_portal"]


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per key in `order`; rows without a key are discarded.

    `min_by` keeps one candidate per key on the map side, so a key with a third of the rows moves
    one row per task.
    """
    rest = [c for c in df.columns if c != key]
    kept = (
        df.where(F.col(key).isNotNull() & (F.col(key) != ""))
        .groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    )
    return kept.select(*[F.col(key) if c == key else F.col("_row")[c].alias(c) for c in df.columns])


def new_per_source(df: DataFrame, key: str, source: str, order: list[str]) -> DataFrame:
    """Rows (source, records, new): how many of each source's rows survive first-wins."""
    usable = F.col(key).isNotNull() & (F.col(key) != "")
    records = df.groupBy(source).agg(F.count(F.lit(1)).alias("records"))
    winners = (
        df.where(usable).groupBy(key)
        .agg(F.min_by(F.col(source), F.struct(*order)).alias(source))
        .groupBy(source).agg(F.count(F.lit(1)).alias("new"))
    )
    return records.join(winners, source, "left").fillna(0, ["new"])


def with_link_columns(df: DataFrame, portal: Column, place_column: str | None = None) -> DataFrame:
    """Add the normalised price, area, bedrooms and place plus the portal label."""
    return with_place(df, "bairro_norm", vocab.ADDRESS, place_column).withColumns({
        "origem_portal": portal,
        "preco_norm": parse_price(vocab.PRICE),
        "area_norm": parse_number(vocab.AREA),
        "quartos_norm": parse_number("quartos"),
    })


def key_usable(price: Column, area: Column, bedrooms: Column) -> Column:
    return F.coalesce((price > 10_000) & (area > 10) & bedrooms.isNotNull(), F.lit(False))


def _whole(value: Column, scale: int) -> Column:
    """Half-even rounding as a whole number; key text never goes through a double."""
    return F.bround(value, scale).cast("bigint")


def unit_key(url: str = vocab.URL, surrogate: Column | None = None) -> Column:
    """Linkage key: place, price to 100, area to 1, bedrooms; the URL where those cannot be used.

    `surrogate` names rows that also lack a URL, so that they stay apart.
    """
    price, area, bedrooms = F.col("preco_norm"), F.col("area_norm"), F.col("quartos_norm")
    full = F.concat_ws(
        "|", F.col("bairro_norm"), _whole(price, -2), _whole(area, 0), bedrooms.cast("bigint")
    )
    own = F.nullif(F.col(url), F.lit(""))
    if surrogate is not None:
        own = F.coalesce(own, F.concat(F.lit("#"), surrogate.cast("string")))
    return F.when(key_usable(price, area, bedrooms), full).otherwise(F.concat(F.lit("unica|"), own))


def unit_signature(url: str = vocab.URL) -> Column:
    """Physical-unit signature; without price or area the URL stands for itself."""
    def part(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("?"))

    price, area = F.col(vocab.PRICE), F.col(vocab.AREA)
    counts = [F.col(c) for c in ("quartos", "banheiros", "garagens")]
    whole = F.concat_ws(
        "|", part(_whole(price, -3)), part(_whole(area, 0)), *[part(c.cast("double")) for c in counts]
    )
    return F.when(price.isNotNull() & area.isNotNull(), whole).otherwise(F.col(url))


def merge_units(
    df: DataFrame,
    key: str,
    order: list[str],
    flags: list[str],
    portal: str = "origem_portal",
    both: str = "ambos",
) -> DataFrame:
    """One row per unit by per-column survivorship, every rule an aggregate with map-side combine.

    Flags are OR-ed with NULL as False. Enumerations take the first informative value, and their
    first value when none is. Every other column takes its first non-null value. NULL is missing
    throughout; unique extras are a set, see `unit_extras`.
    """
    seq = F.struct(*order)

    def first_where(name: str, informative: Column) -> Column:
        return F.min_by(F.col(name), F.when(informative, seq))

    skip = {key, portal, vocab.EXTRAS, *order, *LINK_HELPERS}
    aggs = []
    for name in df.columns:
        value = F.col(name)
        if name in skip:
            continue
        if name in flags:
            agg = F.max(F.coalesce(value, F.lit(False)))
        elif name in vocab.EXTRACTION_ENUMS:
            told = value.isNotNull() & ~F.trim(value).isin("", "Nao informado")
            agg = F.coalesce(first_where(name, told), first_where(name, value.isNotNull()))
        else:
            agg = first_where(name, value.isNotNull())
        aggs.append(agg.alias(name))
    origin = F.when(F.min(portal) < F.max(portal), F.lit(both)).otherwise(F.min(portal))
    return df.groupBy(key).agg(
        origin.alias(vocab.ORIGIN), F.count(F.lit(1)).alias("listings"), *aggs
    )


def unit_extras(df: DataFrame, key: str, column: str = vocab.EXTRAS) -> DataFrame:
    """Distinct (key, extra) pairs from JSON lists; malformed lists count as empty.

    Extras stay rows whatever their number, so a unit with very many moves and fits like any other.
    """
    return df.select(key, F.explode(json_string_array(column)).alias("extra")).distinct()


def merge_summary(df: DataFrame, key: str) -> DataFrame:
    """One row: input rows, rows absorbed by merging, unique units."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_cnt"))
    return sizes.agg(
        F.coalesce(F.sum("_cnt"), F.lit(0)).alias("input_rows"),
        F.coalesce(F.sum(F.col("_cnt") - 1), F.lit(0)).alias("absorbed_rows"),
        F.count(F.lit(1)).alias("unique_units"),
    )


def cluster_stats(df: DataFrame, signature: str) -> DataFrame:
    """One row: clusters of more than one listing, the listings in them, the largest cluster."""
    sizes = df.groupBy(signature).agg(F.count(F.lit(1)).alias("_cnt"))
    many = F.col("_cnt") > 1
    return sizes.agg(
        F.count_if(many).alias("clusters"),
        F.coalesce(F.sum(F.when(many, F.col("_cnt"))), F.lit(0)).alias("clustered_listings"),
        F.max("_cnt").alias("largest_cluster"),
    )


def union_portals(first: DataFrame, second: DataFrame) -> DataFrame:
    """Column union, absent columns NULL."""
    return first.unionByName(second, allowMissingColumns=True)


def legacy_records(df: DataFrame, kind: str) -> DataFrame:
    """Scrape-stamped record: type tag, year and month, numeric NULLs as -1."""
    stamped = df.withColumns({
        "tipo_imovel": F.lit(kind),
        "ano_scraping": F.year(F.current_date()).cast("bigint"),
        "mes_scraping": F.month(F.current_date()).cast("bigint"),
    })
    return stamped.fillna(-1)
