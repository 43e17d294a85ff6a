"""Amenity edges, frequencies, flag folding and flag matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.functions.text import (
    amenity_only,
    canonical_flag_name,
    canonical_term,
    comma_tokens,
    scraped_flag_name,
    slug_text,
    with_canonical_flag,
)
from hearthlake.session import cut_lineage

#: Flag names that meet their rows by broadcast.
SHARED_NAMES = 50_000


def column_values(df: DataFrame, column: str) -> list:
    """Sorted values of a vocabulary column, for a wide table's column names.

    A wide table's schema lives on the driver anyway. For an open vocabulary use the long forms
    (`amenity_edges`, `fold_flags_long`) or hand the names to the job.
    """
    return sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None)


# --- controlled vocabulary ---------------------------------------------------------------------

def amenity_vocabulary(spark: SparkSession) -> DataFrame:
    """The fixed token table (token, amenity, category)."""
    rows = [(t, name, category) for t, (name, category) in vocab.AMENITY_TOKENS.items()]
    return spark.createDataFrame(rows, "token string, amenity string, category string")


def listing_tokens(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row (key, token) per token occurrence."""
    return df.select(key, F.explode(comma_tokens(*columns)).alias("token"))


def amenity_edges(tokens: DataFrame, key: str) -> DataFrame:
    """Distinct (owner_kind, owner_key, amenity_name). The vocabulary is a fixed 42-row table."""
    words = F.broadcast(amenity_vocabulary(tokens.sparkSession))
    return (
        tokens.join(words, "token")
        .select(
            F.lit("property").alias("owner_kind"),
            F.col(key).alias("owner_key"),
            F.col("amenity").alias("amenity_name"),
        )
        .distinct()
    )


def amenities_used(edges: DataFrame) -> DataFrame:
    words = F.broadcast(
        amenity_vocabulary(edges.sparkSession).select("amenity", "category").distinct()
    )
    return (
        edges.select(F.col("amenity_name").alias("name")).distinct()
        .join(words, F.col("name") == F.col("amenity")).select("name", "category")
    )


def dropped_tokens(tokens: DataFrame) -> DataFrame:
    """Token counts outside the vocabulary and the boolean words."""
    flag_words = [w for words, _ in vocab.KEYWORD_FLAGS.values() for w in words]
    known = list(vocab.AMENITY_TOKENS) + flag_words
    return (
        tokens.where(~F.col("token").isin(known))
        .groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    )


def top_counts(counts: DataFrame, term: str, count: str, k: int) -> DataFrame:
    """The `k` most frequent terms, ties by term."""
    return counts.orderBy(F.desc(count), F.asc(term)).limit(k)


# --- scraped amenities -------------------------------------------------------------------------

def canonical_set(*columns: Column | str) -> Column:
    """Array of the distinct canonical amenities in the comma lists."""
    slugs = F.transform(comma_tokens(*columns), slug_text)
    return F.array_distinct(F.transform(F.filter(slugs, lambda s: s != ""), canonical_term))


def portal_b_flags(column: Column | str) -> Column:
    """Array of distinct flag names from a portal-B amenity list, room counts left out."""
    return F.array_distinct(F.transform(amenity_only(comma_tokens(column)), scraped_flag_name))


def amenity_frequency(df: DataFrame, amenities: str) -> DataFrame:
    """Listings per amenity, from an array column that holds each amenity once."""
    return (
        df.select(F.explode(amenities).alias("amenity"))
        .groupBy("amenity").agg(F.count(F.lit(1)).alias("listings"))
    )


def frequent_amenities(frequency: DataFrame, at_least: int = vocab.MIN_AMENITY_LISTINGS) -> DataFrame:
    return frequency.where(F.col("listings") >= at_least)


def amenity_matrix(
    df: DataFrame, key: str, amenities: str, names: list[str],
    prefix: str = vocab.SCRAPED_FLAG_PREFIX,
) -> DataFrame:
    """0/1 column per name. Each listing already holds its set, so this is a projection."""
    return df.select(key, *[
        F.array_contains(amenities, n).cast("int").alias(prefix + n) for n in names
    ])


# --- flag folding ------------------------------------------------------------------------------

def flag_groups(columns: list[str]) -> dict[str, list[str]]:
    groups: dict[str, list[str]] = {}
    for name in columns:
        groups.setdefault(canonical_flag_name(name), []).append(name)
    return groups


def fold_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """OR equivalent flag columns into one 'com_' byte column per canonical name; NULL is False."""
    groups = flag_groups(columns)
    folded = [
        F.greatest(*parts).cast("byte").alias(vocab.FLAG_PREFIX + name)
        if len(parts) > 1 else parts[0].cast("byte").alias(vocab.FLAG_PREFIX + name)
        for name, sources in groups.items()
        for parts in [[F.coalesce(F.col(f"`{c}`"), F.lit(False)) for c in sources]]
    ]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, *folded)


def fold_flags_long(flags: DataFrame, key: str, flag: str = "flag") -> DataFrame:
    """The same OR on (key, flag) rows of set flags: distinct canonical pairs.

    A name is made canonical once, not once a row. Up to SHARED_NAMES names meet the rows by broadcast, more by a shuffle.
    """
    names = cut_lineage(with_canonical_flag(flags.select(F.col(flag).alias("_flag")).distinct(), "_flag"))
    if names.count() <= SHARED_NAMES:
        names = F.broadcast(names)
    return flags.join(names, F.col(flag).eqNullSafe(F.col("_flag"))).select(key, "canonical").distinct()


def folded_groups(flags: DataFrame, flag: str = "flag") -> DataFrame:
    """Rows (canonical, sources, flag) for canonical names fed by more than one source name.

    One row per source: a canonical name may have any number of them.
    """
    names = with_canonical_flag(flags.select(flag).distinct(), flag)
    sizes = names.groupBy("canonical").agg(F.count(F.lit(1)).alias("sources")).where(F.col("sources") > 1)
    return names.join(sizes, "canonical").select("canonical", "sources", flag)


def without_generic(flags: DataFrame, flag: str = "canonical") -> DataFrame:
    """Drop flags on the fixed stop list."""
    return flags.where(~F.col(flag).isin(vocab.GENERIC_FLAGS))


def prevalence(flags: DataFrame, listings: DataFrame, flag: str = "canonical") -> DataFrame:
    """Share of listings per flag, from distinct (key, flag) rows."""
    total = listings.agg(F.count(F.lit(1))).scalar()
    return flags.groupBy(flag).agg(F.count(F.lit(1)).alias("listings")).withColumn(
        "share", F.col("listings") / total
    )


def share_band(shares: DataFrame, low: float, high: float | None = None) -> DataFrame:
    """Flags whose share is at least `low` and, for dummies, at most `high`."""
    kept = shares.where(F.col("share") >= low)
    return kept if high is None else kept.where(F.col("share") <= high)


def column_shares(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Mean of each 0/1 column; one row comes back."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in columns]).first()
    return {c: row[c] if row[c] is not None else 0.0 for c in columns}


def filter_flag_columns(
    df: DataFrame, columns: list[str], min_share: float = vocab.MIN_FLAG_SHARE
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Drop generic and rare flag columns; returns the frame and what happened to each column."""
    names = {c: c.removeprefix(vocab.FLAG_PREFIX) for c in columns}
    generic = sorted(c for c, n in names.items() if n in vocab.GENERIC_FLAGS)
    rest = [c for c in columns if c not in generic]
    shares = column_shares(df, rest)
    rare = sorted(c for c in rest if shares[c] < min_share)
    kept = sorted(c for c in rest if shares[c] >= min_share)
    return df.drop(*generic, *rare), {"generic": generic, "rare": rare, "kept": kept}
