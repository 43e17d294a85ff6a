"""Field extraction from prose, its measured precision, and missingness reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlake import vocab
from hearthlake.functions.numbers import to_double
from hearthlake.functions.text import bind_column, field_from_prose, plain_text

PLAIN = "_plain"


def _present(df: DataFrame) -> list[str]:
    return [c for c in vocab.PROSE_FIELDS if c in df.columns]


def _number(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name).cast("double")
    return to_double(F.trim(F.col(name).cast("string")))


def _with_plain(df: DataFrame, text: str) -> DataFrame:
    """Normalise the text once; every field pattern reads the result."""
    return bind_column(df, PLAIN, plain_text(text))


def _found(name: str) -> Column:
    return field_from_prose(F.col(PLAIN), name)


def fill_from_prose(df: DataFrame, text: str = vocab.DESCRIPTION) -> DataFrame:
    """Fill missing cells only; a given value always stands. Without the text column, a no-op."""
    if text not in df.columns:
        return df
    filled = {c: F.coalesce(_number(df, c), _found(c)) for c in _present(df)}
    return _with_plain(df, text).withColumns(filled).drop(PLAIN)


def fill_counts(df: DataFrame, text: str = vocab.DESCRIPTION) -> DataFrame:
    """Rows (field, filled) for the fields that gained cells."""
    fields = _present(df) if text in df.columns else []
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, filled bigint")
    counts = _with_plain(df, text).agg(*[
        F.count_if(_number(df, c).isNull() & _found(c).isNotNull()).alias(c) for c in fields
    ])
    return counts.unpivot([], fields, "field", "filled").where(F.col("filled") > 0)


def precision_of(df: DataFrame, gaps: dict[str, Column]) -> DataFrame:
    """Rows (campo, comparaveis, exato, ate_1_de_diferenca) from absolute gaps, NULL = not comparable."""
    aggs = [
        F.struct(
            F.count(gap).alias("comparaveis"),
            F.avg((gap == 0).cast("double")).alias("exato"),
            F.avg((gap <= 1).cast("double")).alias("ate_1_de_diferenca"),
        ).alias(name)
        for name, gap in gaps.items()
    ]
    long = df.agg(*aggs).unpivot([], list(gaps), "campo", "m")
    return long.select("campo", "m.*").where(F.col("comparaveis") > 0)


def extraction_precision(df: DataFrame, text: str = vocab.DESCRIPTION) -> DataFrame:
    """How often the prose agrees with the structured field where both exist."""
    fields = _present(df)
    gaps = {f"_gap_{c}": F.abs(_found(c) - _number(df, c)) for c in fields}
    measured = _with_plain(df, text).select(*[g.alias(n) for n, g in gaps.items()])
    return precision_of(measured, {c: F.col(f"_gap_{c}") for c in fields})


def pattern_precision(
    df: DataFrame, patterns: dict[str, str], known: str, text: str = vocab.DESCRIPTION,
    within: float = 0.10,
) -> DataFrame:
    """Rows (pattern, n, within_share): candidate patterns scored by relative distance to `known`.

    Each pattern's first group is the number; it is searched in the plain text.
    """
    number = _number(df, known)
    gaps = []
    for name, pattern in patterns.items():
        found = F.regexp_extract(PLAIN, pattern, 1).try_cast("double")
        gaps.append(F.when(number > 0, F.abs(found - number) / number).alias(name))
    measured = _with_plain(df, text).select(*gaps)
    scores = measured.agg(*[
        F.struct(
            F.count(n).alias("n"), F.avg((F.col(n) <= within).cast("double")).alias("within_share")
        ).alias(n)
        for n in patterns
    ])
    return scores.unpivot([], list(patterns), "pattern", "m").select("pattern", "m.*")


def missingness(df: DataFrame, text: str = vocab.DESCRIPTION) -> DataFrame:
    """Rows (field, before, after, recovered, ratio): missing cells around the prose fill."""
    fields = _present(df)
    counts = _with_plain(df, text).agg(*[
        F.struct(
            F.count_if(_number(df, c).isNull()).alias("before"),
            F.count_if(_number(df, c).isNull() & _found(c).isNull()).alias("after"),
        ).alias(c)
        for c in fields
    ])
    long = counts.unpivot([], fields, "field", "m").select("field", "m.before", "m.after")
    recovered = F.col("before") - F.col("after")
    return long.withColumns({
        "recovered": recovered,
        "ratio": F.when(F.col("before") > 0, recovered / F.col("before")).otherwise(F.lit(0.0)),
    })
