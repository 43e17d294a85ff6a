"""One-pass run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.functions.text import bind_column, strip_space
from hearthlake.operators.filters import price_area_guard
from hearthlake.operators.ranks import grouped_medians, hash_shard


def median_price_per_area(df: DataFrame, place: str, price: str, area: str) -> DataFrame:
    """Rows (name, median): guarded price per area by place, exact, before any rounding."""
    cells = F.struct(F.col(place).alias("name"), F.col(price).alias("price"), F.col(area).alias("area"))
    bound = bind_column(df.select(place, price, area), "_m", cells).select("_m.*")
    rate = (
        bound.where(price_area_guard(F.col("price"), F.col("area")) & F.col("name").isNotNull())
        .select("name", (F.col("price") / F.col("area")).alias("_rate"))
    )
    return grouped_medians(rate, ["name"], "_rate").select("name", "n", "median")


def place_table(medians: DataFrame, city: str) -> DataFrame:
    """Place dimension: the median rate rounded half-even; curated fields stay empty."""
    empty = F.lit(None)
    return medians.select(
        "name",
        F.lit(city).alias("city"),
        empty.cast("double").alias("security_index"),
        empty.cast("double").alias("mobility_index"),
        empty.cast("double").alias("infrastructure_index"),
        F.bround("median", 0).cast("bigint").alias("avg_price_m2_sale"),
        empty.cast("double").alias("avg_price_m2_rent"),
        empty.cast("double").alias("appreciation_rate_yoy"),
        empty.cast("bigint").alias("population"),
        empty.cast("string").alias("profile_tags"),
    )


def text_volume(df: DataFrame, text: str = vocab.DESCRIPTION) -> DataFrame:
    """One row: rows, valid texts, character totals and the token estimate."""
    given = (F.col(text) != "") & (F.col(text) != vocab.NO_DESCRIPTION)
    chars = F.when(given, F.length(strip_space(F.col(text))))
    totals = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(chars).alias("valid_rows"),
        F.coalesce(F.sum(chars), F.lit(0)).alias("total_chars"),
        F.coalesce(F.avg(chars), F.lit(0.0)).alias("avg_chars"),
        F.max(chars).cast("bigint").alias("max_chars"),
        F.min(chars).cast("bigint").alias("min_chars"),
    )
    tokens_in = F.col("total_chars") / vocab.CHARS_PER_TOKEN + (
        F.col("valid_rows") * vocab.PROMPT_TOKENS_PER_ROW
    )
    tokens_out = F.col("valid_rows") * vocab.OUTPUT_TOKENS_PER_ROW
    return totals.withColumns({
        "input_tokens": F.floor(tokens_in).cast("bigint"),
        "output_tokens": tokens_out,
        "total_tokens": F.floor(tokens_in + tokens_out).cast("bigint"),
    })


def property_totals(properties: DataFrame) -> DataFrame:
    """One row: listings, boolean totals, listings with and without a place."""
    flags = ["pets_allowed", "has_elevator", "has_balcony", "furnished"]
    placed = F.col("neighborhood").isNotNull()
    return properties.agg(
        F.count(F.lit(1)).alias("properties"),
        *[F.count_if(F.col(c)).alias(c) for c in flags],
        F.count_if(placed).alias("with_place"),
        F.count_if(~placed).alias("without_place"),
    )


def run_plan(
    links: DataFrame, seen: DataFrame, key: str, shards: int = 1, shard: int = 0, exact: bool = False
) -> DataFrame:
    """One row: links in scope, already seen, pending overall and for this worker.

    The worker's share is by key hash, or every `shards`-th of the sorted pending links if `exact`.
    """
    marks = seen.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_seen", F.lit(True))
    flagged = links.select(key).distinct().join(marks, key, "left")
    todo = F.col("_seen").isNull()
    mine = hash_shard(F.col(key), shards) == shard
    return flagged.agg(
        F.count(F.lit(1)).alias("in_scope"),
        F.count_if(~todo).alias("already_seen"),
        F.count_if(todo).alias("pending"),
        (F.floor((F.count_if(todo) + shards - 1 - shard) / shards) if exact else F.count_if(todo & mine)).alias("pending_here"),
    )
