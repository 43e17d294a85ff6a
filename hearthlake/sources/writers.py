"""Writers. Flat formats get nested columns as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hearthlake.functions.arrays import flat_for_text_sinks


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    (
        flat_for_text_sinks(df).write.mode("overwrite")
        .option("header", True).option("quote", '"').option("escape", '"').csv(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
