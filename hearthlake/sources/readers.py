"""Readers for listing files. Schemas are explicit; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlake import vocab

LISTING_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in vocab.RAW_LISTING_COLUMNS])

EXTRACTION_SCHEMA = T.StructType([
    T.StructField(vocab.URL, T.StringType()),
    T.StructField("posicao_solar", T.StringType()),
    T.StructField("distancia_praia_m", T.LongType()),
    T.StructField("status_construcao", T.StringType()),
    T.StructField("tipo_unidade", T.StringType()),
    T.StructField("diferenciais_unicos", T.ArrayType(T.StringType())),
    T.StructField("flags", T.MapType(T.StringType(), T.BooleanType())),
])


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    jvm = spark._jvm
    found = []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
        if files:
            found.append(path)
    return found


def read_listings(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType = LISTING_SCHEMA,
    multi_line: bool = True,
    strict: bool = False,
) -> DataFrame:
    """Listings from JSON arrays, or from JSON lines with `multi_line=False`.

    Tolerant by default: missing paths and files that do not parse contribute no rows. `strict`
    fails on either. JSON lines split across tasks; a JSON array is one task per file.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if strict:
        return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(paths)
    paths = _existing(spark, paths)
    if not paths:
        return spark.createDataFrame([], schema)
    bad = T.StructField("_bad", T.StringType())
    rows = (
        spark.read.schema(T.StructType(schema.fields + [bad]))
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .json(paths)
    )
    # Spark refuses a scan of the corrupt-record column alone, as a bare count would be.
    first = F.col(schema.fields[0].name).cast("string")
    parsed = F.length(F.coalesce(first, F.lit(""))) >= 0
    return rows.where(F.col("_bad").isNull() & parsed).drop("_bad")


def read_parts(
    spark: SparkSession,
    canonical: str,
    parts: str,
    schema: T.StructType = LISTING_SCHEMA,
    multi_line: bool = True,
) -> DataFrame:
    """Canonical file before part files, parts in path order.

    Adds the order columns of PART_ORDER, as `first_wins` needs them.
    """
    def located(path: str, rank: int) -> DataFrame:
        rows = read_listings(spark, path, schema, multi_line)
        place = F.lit(None).cast("string"), F.lit(0).cast("bigint")
        if _existing(spark, [path]):
            place = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
        return rows.select(
            "*",
            F.lit(rank).alias("part_rank"),
            place[0].alias("source_file"),
            place[1].alias("block_start"),
            F.monotonically_increasing_id().alias("row_seq"),
        )

    return located(canonical, 0).unionByName(located(parts, 1))


#: Sort order of rows from `read_parts`.
PART_ORDER = ["part_rank", "source_file", "block_start", "row_seq"]


def read_portal(spark: SparkSession, root: str, portal: str, schema: T.StructType = LISTING_SCHEMA) -> DataFrame:
    """One portal of a table laid out as `portal=<name>` folders; the other folders are not read."""
    full = T.StructType(schema.fields + [T.StructField("portal", T.StringType())])
    return spark.read.schema(full).parquet(root).where(F.col("portal") == portal)


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV with header; quoted cells may span lines, as descriptions do."""
    return (
        spark.read.schema(schema)
        .option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        .csv(paths)
    )


def read_term_ranking(spark: SparkSession, path: str) -> DataFrame:
    """Rows (position, term, cnt) of a ranking artefact {"ranking_frequencia": {term: count}}."""
    text = spark.read.text(path, wholetext=True)
    ranking = F.from_json("value", "ranking_frequencia map<string,bigint>")["ranking_frequencia"]
    return text.select(F.posexplode(F.map_entries(ranking)).alias("position", "e")).select(
        "position", F.col("e.key").alias("term"), F.col("e.value").alias("cnt")
    )


def vocabulary_terms(
    ranking: DataFrame | None,
    min_count: int = vocab.MIN_TERM_COUNT,
    max_terms: int = vocab.MAX_TERMS,
) -> list[str]:
    """Flag terms for the extraction record: longer than two, frequent enough, first `max_terms`.

    The order of the ranking decides: its `position` column if it has one, else count then term.
    Without a ranking, the fixed list. The result is a schema, at most `max_terms` names.
    """
    if ranking is None:
        return list(vocab.DEFAULT_TERMS)
    order = ["position"] if "position" in ranking.columns else [F.desc("cnt"), F.asc("term")]
    rows = (
        ranking.where((F.length(F.trim("term")) > 2) & (F.col("cnt") >= min_count))
        .orderBy(*order).limit(max_terms).select(F.trim("term").alias("term")).collect()
    )
    return [r["term"] for r in rows]
