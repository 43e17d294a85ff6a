"""Distribution, leakage and selection-bias checks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from hearthlake.operators.ranks import cumulative_counts, exact_medians, exact_percentiles


def sample_skewness(col: Column | str) -> Column:
    """Skewness with the usual sample correction; needs three values."""
    n = F.count(col).cast("double")
    return F.when(n > 2, F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(col: Column | str) -> Column:
    """Excess kurtosis with the sample correction; needs four values."""
    n = F.count(col).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col) + 6))


def target_shape(df: DataFrame, target: str) -> DataFrame:
    """One row: skewness and kurtosis of the positive target, raw and in logs."""
    priced = df.where(F.col(target) > 0).select(
        F.col(target).alias("_x"), F.ln(target).alias("_l")
    )
    return priced.agg(
        F.count(F.lit(1)).alias("n"),
        sample_skewness("_x").alias("skew_raw"),
        sample_kurtosis("_x").alias("kurtosis_raw"),
        sample_skewness("_l").alias("skew_log"),
        sample_kurtosis("_l").alias("kurtosis_log"),
    )


def leakage_audit(own: DataFrame, other: DataFrame, key: str, own_value: str, other_value: str) -> DataFrame:
    """One row: does an external per-group figure repeat the target? Correlation, median gap."""
    both = own.select(key, F.col(own_value).alias("_own")).join(
        other.select(key, F.col(other_value).alias("_other")), key
    )
    gap = F.abs(F.col("_own") - F.col("_other")) / F.col("_own")
    flat = (F.stddev_pop("_own") == 0) | (F.stddev_pop("_other") == 0)
    corr = F.when(~flat, F.try_divide(
        F.covar_pop("_own", "_other"), F.stddev_pop("_own") * F.stddev_pop("_other")
    ))
    summary = both.agg(F.count(F.lit(1)).alias("groups"), corr.alias("correlation"))
    median = exact_medians(both.select(gap.alias("_gap")), [], "_gap", "median_relative_gap")
    return summary.withColumn("median_relative_gap", median.select("median_relative_gap").scalar())


def mann_whitney(df: DataFrame, value: str, in_first: Column) -> DataFrame:
    """One row: sizes, medians, U of the first sample, tie-corrected z with continuity correction."""
    data = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"), in_first.alias("_g"))
    counts = data.groupBy("_v").agg(
        F.count(F.lit(1)).alias("cnt"), F.count_if(F.col("_g")).alias("_first")
    )
    ranked = cumulative_counts(counts, [], "_v")
    rank = F.col("before") + (F.col("cnt") + 1) / 2.0
    ties = F.col("cnt").cast("double")
    sums = ranked.agg(
        F.sum("_first").alias("n_first"),
        F.sum(F.col("cnt") - F.col("_first")).alias("n_second"),
        F.sum(F.col("_first") * rank).alias("_r"),
        F.sum(ties * ties * ties - ties).alias("_t"),
    )
    n1, n2 = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    n = n1 + n2
    u = F.col("_r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_t") / (n * (n - 1))))
    gap = F.abs(F.col("u_first") - n1 * n2 / 2) - 0.5
    medians = exact_percentiles(data, ["_g"], "_v", {"median": 0.5})

    def median_of(first: bool) -> Column:
        return medians.where(F.col("_g") == first).select("median").scalar()

    return (
        sums.withColumn("u_first", u)
        .withColumn("z", F.when(sd > 0, gap / sd))
        .withColumns({"median_first": median_of(True), "median_second": median_of(False)})
        .drop("_r", "_t")
    )


@pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Normal two-sided p-value of |z|; meant for the one-row test result."""
    return z.map(lambda v: math.erfc(max(v, 0.0) / math.sqrt(2.0)) if pd.notna(v) else None)
