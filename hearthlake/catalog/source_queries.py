"""Readers and writers: tables written to the shared folder and read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlake.catalog.fixtures import table
from hearthlake.catalog.registry import query
from hearthlake.operators.linkage import first_wins
from hearthlake.session import cut_lineage, ensure_checkpoint_dir
from hearthlake.sources import json_arrays, readers, writers


def _place(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sources-{uuid4().hex}"


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


@query("read_json_lines", "SELECT p_partkey::VARCHAR AS url_anuncio, p_name AS titulo, p_type AS descricao_completa, NULL::VARCHAR AS bairro FROM part")
def read_json_lines(spark, sf_dir):
    """Listings written as JSON lines; a column that the files lack is NULL."""
    folder = _place(spark)
    writers.write_json(table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("url_anuncio"), F.col("p_name").alias("titulo"), F.col("p_type").alias("descricao_completa")
    ), folder)
    schema = _strings("url_anuncio", "titulo", "descricao_completa", "bairro")
    return readers.read_listings(spark, [folder, folder + "-missing"], schema, multi_line=False)


@query("read_json_array_splits", """SELECT p_partkey::VARCHAR AS url_anuncio, p_name || ' "}, {" \\' AS titulo, p_type AS descricao_completa,
  row_number() OVER (ORDER BY p_partkey) - 1 AS record_no, true AS several FROM part""")
def read_json_array_splits(spark, sf_dir):
    """One array file, read by several tasks; quotes, brackets and backslashes inside strings."""
    folder = _place(spark)
    part = table(spark, sf_dir, "part")
    first = part.agg(F.min("p_partkey").alias("first"))
    record = F.to_json(F.struct(
        F.col("p_partkey").cast("string").alias("url_anuncio"), F.concat("p_name", F.lit(' "}, {" \\')).alias("titulo"),
        F.struct(F.array("p_size").alias("p}")).alias("nested"), F.col("p_type").alias("descricao_completa"),
    ))
    rows = part.join(first).select("p_partkey", F.concat(F.when(F.col("p_partkey") == F.col("first"), "[").otherwise(", "), record).alias("value"))
    end = spark.range(1).select(F.lit(None).cast("bigint").alias("p_partkey"), F.lit("]").alias("value"))
    ordered = rows.unionByName(end).repartition(1).sortWithinPartitions(F.asc_nulls_last("p_partkey"))  # one file
    ordered.select("value").write.option("lineSep", " ").text(folder)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = json_arrays.read_json_arrays(spark, folder, _strings("url_anuncio", "titulo", "descricao_completa"))
        parts = json_arrays._cut(spark, [folder]).select("split").distinct().count()
        return cut_lineage(rows.select("url_anuncio", "titulo", "descricao_completa", "record_no", F.lit(parts > 1).alias("several")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@query("read_csv_text", "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS digest, length(text) AS n FROM documents")
def read_csv_text(spark, sf_dir):
    """Texts with line ends and quotes through CSV."""
    folder = _place(spark)
    writers.write_csv(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"), folder)
    rows = readers.read_csv(spark, folder, _strings("doc_id", "text"))
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("bigint").alias("n"))


@query("read_portal_folder", "SELECT c_custkey, c_name, c_mktsegment AS portal FROM customer WHERE c_mktsegment = 'BUILDING'")
def read_portal_folder(spark, sf_dir):
    """A table partitioned by portal, of which one folder is read."""
    folder = _place(spark)
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("portal"))
    writers.write_parquet(customers, folder, ["portal"])
    return readers.read_portal(spark, folder, "BUILDING", customers.drop("portal").schema)


@query("read_parts_priority", """SELECT o_orderkey::VARCHAR AS url_anuncio,
  CASE WHEN o_orderkey % 3 = 0 THEN 'canonical' ELSE 'part' END AS titulo FROM orders""")
def read_parts_priority(spark, sf_dir):
    """Canonical rows win over the rows of part files."""
    folder = _place(spark)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("url_anuncio"))
    writers.write_json(rows.where("o_orderkey % 3 = 0").select("url_anuncio", F.lit("canonical").alias("titulo")), f"{folder}/all")
    writers.write_json(rows.select("url_anuncio", F.lit("part").alias("titulo")), f"{folder}/parts")
    parts = readers.read_parts(spark, f"{folder}/all", f"{folder}/parts", _strings("url_anuncio", "titulo"), multi_line=False)
    return first_wins(parts, "url_anuncio", readers.PART_ORDER).select("url_anuncio", "titulo")


@query("read_ranking_artefact", """SELECT row_number() OVER (ORDER BY cnt DESC, term) - 1 AS position, term, cnt
  FROM (SELECT lang AS term, count(*) AS cnt FROM documents GROUP BY lang)""")
def read_ranking_artefact(spark, sf_dir):
    """A ranking of terms as one JSON object, read in its order."""
    folder = _place(spark)
    counts = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("term")).agg(F.count(F.lit(1)).alias("cnt"))
    entries = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("order"), "term", "cnt")))
    ranking = counts.agg(entries.alias("e")).select(F.to_json(F.struct(F.map_from_entries(
        F.transform("e", lambda x: F.struct(x["term"], x["cnt"]))
    ).alias("ranking_frequencia"))).alias("value"))
    ranking.coalesce(1).write.text(folder)
    return readers.read_term_ranking(spark, folder).select(F.col("position").cast("bigint").alias("position"), "term", "cnt")
