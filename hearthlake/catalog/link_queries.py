"""Deduplication, linkage, repair, anti-join and slicing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.catalog import duck as D
from hearthlake.catalog.fixtures import LISTINGS_CTE, UNITS_CTE, listings, table, units
from hearthlake.catalog.registry import query
from hearthlake.operators import joins, linkage, ranks, repair, reports
from hearthlake.plans import pipelines

WITH_LISTINGS = D.with_ctes(LISTINGS_CTE)
WITH_UNITS = D.with_ctes(UNITS_CTE)

# Copies of one advert across files: customers as URLs, priorities as files, orders as rows.
COPIES_SQL = """copies AS (SELECT 'https://x.example/' || o_custkey AS url_anuncio, o_orderpriority AS source_file,
  o_orderkey AS row_seq, o_totalprice AS price FROM orders)"""


def copies(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("https://x.example/"), F.col("o_custkey").cast("string")).alias("url_anuncio"),
        F.col("o_orderpriority").alias("source_file"), F.col("o_orderkey").alias("row_seq"),
        F.col("o_totalprice").alias("price"),
    )


@query("dedup_first_wins", f"""WITH {COPIES_SQL} SELECT url_anuncio, price, row_seq FROM copies
  QUALIFY row_number() OVER (PARTITION BY url_anuncio ORDER BY source_file, row_seq) = 1""")
def dedup_first_wins(spark, sf_dir):
    first = linkage.first_wins(copies(spark, sf_dir), "url_anuncio", ["source_file", "row_seq"])
    return first.select("url_anuncio", "price", "row_seq")


@query("new_per_file", f"""WITH {COPIES_SQL}, w AS (SELECT * FROM copies
    QUALIFY row_number() OVER (PARTITION BY url_anuncio ORDER BY source_file, row_seq) = 1)
  SELECT c.source_file, c.records, coalesce(w.new, 0) AS new FROM (SELECT source_file, count(*) AS records FROM copies GROUP BY 1) c
  LEFT JOIN (SELECT source_file, count(*) AS new FROM w GROUP BY 1) w USING (source_file)""")
def new_per_file(spark, sf_dir):
    return linkage.new_per_source(copies(spark, sf_dir), "url_anuncio", "source_file", ["source_file", "row_seq"])


# --- linkage -----------------------------------------------------------------------------------

LINKED_CTE = f"""linked AS (SELECT *, {D.price('preco_venda')} AS preco_norm, {D.measure('area_util')} AS area_norm,
  {D.measure('quartos')} AS quartos_norm, {D.place('endereco_completo', 'bairro')} AS bairro_norm,
  CASE WHEN portal = 'portal_a' THEN 0 ELSE 1 END AS portal_rank FROM listings)"""
KEYED_CTE = f"""keyed AS (SELECT *, CASE WHEN preco_norm > 10000 AND area_norm > 10 AND quartos_norm IS NOT NULL
  THEN bairro_norm || '|' || round_even(preco_norm, -2)::BIGINT || '|' || round_even(area_norm, 0)::BIGINT || '|' || trunc(quartos_norm)::BIGINT
  ELSE 'unica|' || url_anuncio END AS unit_key FROM linked)"""
WITH_KEYED = D.with_ctes(LISTINGS_CTE, LINKED_CTE, KEYED_CTE)


def keyed(spark, sf_dir):
    df = linkage.with_link_columns(listings(spark, sf_dir), F.col("portal"), "bairro").withColumn(
        "portal_rank", F.when(F.col("portal") == "portal_a", 0).otherwise(1)
    )
    return df.withColumn("unit_key", linkage.unit_key())


@query("dedup_key", f"{WITH_KEYED} SELECT row_seq, unit_key FROM keyed")
def dedup_key(spark, sf_dir):
    return keyed(spark, sf_dir).select("row_seq", "unit_key")


# Units that really repeat: rows of one part bought at one quantity, from either return flag.
MERGE_CTE = """rowsx AS (SELECT l_orderkey AS row_seq, l_linenumber, l_partkey || '|' || cast(l_quantity AS BIGINT) AS unit_key,
  CASE WHEN l_returnflag = 'A' THEN 'portal_a' ELSE 'portal_b' END AS origem_portal,
  CASE WHEN l_tax > 0.04 THEN l_extendedprice END AS preco_venda,
  CASE WHEN l_discount > 0.05 THEN l_discount > 0.08 END AS piscina,
  CASE WHEN l_linenumber < 3 THEN 'Nao informado' WHEN l_linenumber = 3 THEN '' WHEN l_linenumber = 4 THEN 'Sul' WHEN l_linenumber = 5 THEN 'Norte' END AS posicao_solar,
  CASE WHEN l_tax > 0.06 THEN cast(l_suppkey AS BIGINT) END AS distancia_praia_m,
  CASE WHEN l_linenumber = 1 THEN '["b","a' || l_linestatus || '"]' WHEN l_linenumber = 2 THEN '[broken' WHEN l_linenumber = 3 THEN '["c"]' END AS diferenciais_unicos,
  l_extendedprice AS tie FROM lineitem)"""


def merge_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("row_seq"), "l_linenumber",
        F.concat_ws("|", F.col("l_partkey"), F.col("l_quantity").cast("bigint")).alias("unit_key"),
        F.when(F.col("l_returnflag") == "A", "portal_a").otherwise("portal_b").alias("origem_portal"),
        F.when(F.col("l_tax") > 0.04, F.col("l_extendedprice")).alias("preco_venda"),
        F.when(F.col("l_discount") > 0.05, F.col("l_discount") > 0.08).alias("piscina"),
        F.when(n < 3, "Nao informado").when(n == 3, "").when(n == 4, "Sul").when(n == 5, "Norte").alias("posicao_solar"),
        F.when(F.col("l_tax") > 0.06, F.col("l_suppkey")).alias("distancia_praia_m"),
        F.when(n == 1, F.concat(F.lit('["b","a'), "l_linestatus", F.lit('"]')))
        .when(n == 2, "[broken").when(n == 3, '["c"]').alias("diferenciais_unicos"),
        F.col("l_extendedprice").alias("tie"),
    )


MERGE_ORDER = ["row_seq", "l_linenumber", "tie"]
ORDER_SQL = "row_seq, l_linenumber, tie"


@query("survivorship_merge", f"""WITH {MERGE_CTE}, o AS (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) AS s FROM rowsx)
  SELECT unit_key, CASE WHEN count(DISTINCT origem_portal) > 1 THEN 'ambos' ELSE min(origem_portal) END AS origem_anuncio,
    count(*) AS listings, arg_min(preco_venda, s) FILTER (WHERE preco_venda IS NOT NULL) AS preco_venda,
    bool_or(coalesce(piscina, false)) AS piscina,
    coalesce(arg_min(posicao_solar, s) FILTER (WHERE posicao_solar NOT IN ('', 'Nao informado')),
      arg_min(posicao_solar, s) FILTER (WHERE posicao_solar IS NOT NULL)) AS posicao_solar,
    arg_min(distancia_praia_m, s) FILTER (WHERE distancia_praia_m IS NOT NULL) AS distancia_praia_m
  FROM o GROUP BY unit_key""")
def survivorship_merge(spark, sf_dir):
    return linkage.merge_units(merge_rows(spark, sf_dir), "unit_key", MERGE_ORDER, ["piscina"])


@query("survivorship_extras", f"""WITH {MERGE_CTE} SELECT DISTINCT unit_key, unnest(from_json(diferenciais_unicos, '["VARCHAR"]')) AS extra
  FROM rowsx WHERE json_valid(diferenciais_unicos)""")
def survivorship_extras(spark, sf_dir):
    return linkage.unit_extras(merge_rows(spark, sf_dir), "unit_key")


@query("merge_summary", f"""WITH {MERGE_CTE} SELECT sum(c)::BIGINT AS input_rows, sum(c - 1)::BIGINT AS absorbed_rows, count(*) AS unique_units
  FROM (SELECT count(*) AS c FROM rowsx GROUP BY unit_key)""")
def merge_summary(spark, sf_dir):
    return linkage.merge_summary(merge_rows(spark, sf_dir), "unit_key")


A_HAS_NO_PLACE = LINKED_CTE.replace(
    D.place("endereco_completo", "bairro"),
    f"CASE WHEN portal = 'portal_a' THEN {D.place('endereco_completo')} ELSE {D.place('endereco_completo', 'bairro')} END",
)


@query("deduplicate_portals", f"""{D.with_ctes(LISTINGS_CTE, A_HAS_NO_PLACE, KEYED_CTE)}, o AS (SELECT *, row_number() OVER (ORDER BY portal_rank, row_seq) AS s,
    CASE pr WHEN '1-URGENT' THEN 'Sul' WHEN '2-HIGH' THEN 'Nao informado' WHEN '3-MEDIUM' THEN '' END AS sun FROM keyed)
  SELECT unit_key, CASE WHEN min(portal) < max(portal) THEN 'ambos' ELSE min(portal) END AS origem_anuncio, count(*) AS listings,
    arg_min(url_anuncio, s) AS url_anuncio, arg_min(preco_venda, s) FILTER (WHERE preco_venda IS NOT NULL) AS preco_venda,
    arg_min(descricao_completa, s) FILTER (WHERE descricao_completa IS NOT NULL) AS descricao_completa,
    bool_or(mon > 6) AS nascente_flag,
    coalesce(arg_min(sun, s) FILTER (WHERE sun = 'Sul'), arg_min(sun, s) FILTER (WHERE sun IS NOT NULL)) AS posicao_solar,
    array_to_string(list_sort(list(DISTINCT seg || ' ' || dom)), ',') AS extras
  FROM o GROUP BY unit_key""")
def deduplicate_portals(spark, sf_dir):
    df = listings(spark, sf_dir).withColumns({
        "nascente_flag": F.col("mon") > 6,
        "posicao_solar": F.when(F.col("pr") == "1-URGENT", "Sul").when(F.col("pr") == "2-HIGH", "Nao informado").when(F.col("pr") == "3-MEDIUM", ""),
        vocab.EXTRAS: F.to_json(F.array(F.concat_ws(" ", "seg", "dom"))),
    })
    parts = [df.where(F.col("portal") == p).drop("portal") for p in ("portal_a", "portal_b")]
    # Both portals of the fixture carry a place field; the first portal ignores it, as it has none.
    first = parts[0].drop("bairro")
    out = pipelines.deduplicate_portals(first, parts[1])
    names = out.extras.groupBy("unit_key").agg(F.array_join(F.array_sort(F.collect_list("extra")), ",").alias("extras"))
    return out.units.join(names, "unit_key", "left").select(
        "unit_key", "origem_anuncio", "listings", "url_anuncio", "preco_venda", "descricao_completa", "nascente_flag", "posicao_solar", "extras"
    )


def _signature_sql(prefix=""):
    def part(x):
        return f"coalesce({x}::VARCHAR, '?')"
    counts = " || '|' || ".join(part(f"{prefix}{c}") for c in ("quartos", "banheiros", "garagens"))
    return f"""CASE WHEN {prefix}preco_venda IS NOT NULL AND {prefix}area_util IS NOT NULL THEN
      round_even({prefix}preco_venda, -3)::BIGINT || '|' || round_even({prefix}area_util, 0)::BIGINT || '|' || {counts}
      ELSE {prefix}url_anuncio END"""


@query("unit_signature", f"{WITH_UNITS} SELECT url_anuncio, {_signature_sql()} AS signature FROM units")
def unit_signature(spark, sf_dir):
    return units(spark, sf_dir).select("url_anuncio", linkage.unit_signature().alias("signature"))


@query("dup_cluster_stats", f"""{WITH_UNITS} SELECT count(*) FILTER (WHERE c > 1) AS clusters,
  coalesce(sum(c) FILTER (WHERE c > 1), 0)::BIGINT AS clustered_listings, max(c) AS largest_cluster
  FROM (SELECT count(*) AS c FROM units GROUP BY {_signature_sql()})""")
def dup_cluster_stats(spark, sf_dir):
    signed = units(spark, sf_dir).select(linkage.unit_signature().alias("signature"))
    return linkage.cluster_stats(signed, "signature")


@query("union_portals", f"""{WITH_LISTINGS} SELECT row_seq, titulo, garagens, NULL AS vagas FROM listings WHERE portal = 'portal_a'
  UNION ALL SELECT row_seq, titulo, NULL, vagas FROM listings WHERE portal = 'portal_b'""")
def union_portals(spark, sf_dir):
    df = listings(spark, sf_dir)
    first = df.where("portal = 'portal_a'").select("row_seq", "titulo", "garagens")
    return linkage.union_portals(first, df.where("portal = 'portal_b'").select("row_seq", "titulo", "vagas"))


# --- repair ------------------------------------------------------------------------------------

REPAIR_SQL = f"""{WITH_LISTINGS}, raw AS (SELECT url_anuncio, row_seq, q || ' suítes' AS suites,
    CASE WHEN seg <> 'BUILDING' THEN cast(q AS VARCHAR) ELSE 'x' END AS banheiros, 0 AS copy FROM listings
    UNION ALL SELECT url_anuncio, row_seq, 'old', 'old', -1 FROM listings),
  latest AS (SELECT url_anuncio, arg_max(suites, copy) AS suites, arg_max(banheiros, copy) AS banheiros FROM raw GROUP BY 1),
  joined AS (SELECT l.row_seq, l.suites, l.banheiros, r.suites AS rs, r.banheiros AS rb FROM listings l LEFT JOIN latest r USING (url_anuncio))"""


def _raw_cells(spark, sf_dir):
    df = listings(spark, sf_dir)
    new = df.select(
        "url_anuncio", F.concat_ws("", "q", F.lit(" suítes")).alias("suites"),
        F.when(F.col("seg") != "BUILDING", F.col("q").cast("string")).otherwise("x").alias("banheiros"),
        F.lit(0).alias("copy"),
    )
    old = df.select("url_anuncio", F.lit("old").alias("suites"), F.lit("old").alias("banheiros"), F.lit(-1).alias("copy"))
    return new.unionByName(old)


def _fix(c: str, r: str) -> str:
    broken = f"{c} IS NOT NULL AND {D.measure(c)} IS NULL"
    return f"CASE WHEN {broken} THEN CASE WHEN {D.measure(r)} IS NOT NULL THEN {r} END ELSE {c} END AS {c}"


@query("numeric_repair", f"{REPAIR_SQL} SELECT row_seq, {_fix('suites', 'rs')}, {_fix('banheiros', 'rb')} FROM joined")
def numeric_repair(spark, sf_dir):
    df = listings(spark, sf_dir)
    fixed = repair.repair_numerics(df, _raw_cells(spark, sf_dir), ["copy"], ["suites", "banheiros"])
    return fixed.select("row_seq", "suites", "banheiros")


@query("repair_counts", f"""{REPAIR_SQL} SELECT * FROM (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NOT NULL AND {D.measure(c)} IS NULL) AS broken,
    count(*) FILTER (WHERE {c} IS NOT NULL AND {D.measure(c)} IS NULL AND {D.measure(r)} IS NOT NULL) AS repaired FROM joined"""
    for c, r in (("suites", "rs"), ("banheiros", "rb"))
) + ") WHERE broken > 0")
def repair_counts(spark, sf_dir):
    return repair.repair_counts(listings(spark, sf_dir), _raw_cells(spark, sf_dir), ["copy"], ["suites", "banheiros"])


# --- pending, shards, batches ------------------------------------------------------------------

SEEN_SQL = """links AS (SELECT 'https://x.example/' || c_custkey AS url FROM customer),
  seen AS (SELECT 'https://x.example/' || o_custkey AS url FROM orders WHERE o_orderpriority = '1-URGENT')"""


def _links(spark, sf_dir):
    make = lambda c: F.concat(F.lit("https://x.example/"), F.col(c).cast("string")).alias("url")
    links = table(spark, sf_dir, "customer").select(make("c_custkey"))
    seen = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(make("o_custkey"))
    return links, seen


@query("pending_antijoin", f"WITH {SEEN_SQL} SELECT DISTINCT url FROM links WHERE url NOT IN (SELECT url FROM seen)")
def pending_antijoin(spark, sf_dir):
    links, seen = _links(spark, sf_dir)
    return joins.pending(links, [seen])


@query("run_plan", f"""WITH {SEEN_SQL} SELECT count(*) AS in_scope, count(*) FILTER (WHERE s) AS already_seen,
  count(*) FILTER (WHERE NOT s) AS pending, count(*) FILTER (WHERE NOT s) AS pending_here
  FROM (SELECT DISTINCT url, url IN (SELECT url FROM seen) AS s FROM links)""")
def run_plan(spark, sf_dir):
    links, seen = _links(spark, sf_dir)
    return reports.run_plan(links, seen, "url")


@query("shard_slice", f"""WITH {SEEN_SQL}, p AS (SELECT DISTINCT url FROM links WHERE url NOT IN (SELECT url FROM seen))
  SELECT url FROM (SELECT url, row_number() OVER (ORDER BY url) - 1 AS i FROM p) WHERE i % 3 = 1""")
def shard_slice(spark, sf_dir):
    links, seen = _links(spark, sf_dir)
    return ranks.exact_slice(joins.pending(links, [seen]), ["url"], 1, 3)


@query("hash_shards", f"""WITH {SEEN_SQL} SELECT DISTINCT url, ('0x' || substr(md5(url), 1, 8))::UBIGINT::BIGINT % 3 AS shard
  FROM links WHERE url NOT IN (SELECT url FROM seen)""")
def hash_shards(spark, sf_dir):
    links, seen = _links(spark, sf_dir)
    return joins.pending(links, [seen]).withColumn("shard", ranks.hash_shard("url", 3))


@query("batch_assign", """SELECT o_orderkey, i // 6 AS batch_no, i % 6 AS item_no, i AS row_seq
  FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders)""")
def batch_assign(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return ranks.batches(orders, ["o_orderdate", "o_orderkey"], 6).drop("o_orderdate")


@query("batch_rows", """SELECT o_orderkey, o_custkey, o_totalprice, i // 6 AS batch_no, i % 6 AS item_no
  FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders)""")
def batch_rows(spark, sf_dir):
    """Whole rows in batches: their keys are sorted, the other columns join."""
    return ranks.batches(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 6).select(
        "o_orderkey", "o_custkey", "o_totalprice", "batch_no", "item_no"
    )


@query("distinct_sorted_links", "SELECT DISTINCT url FROM (SELECT 'https://x.example/' || o_custkey AS url FROM orders)")
def distinct_sorted_links(spark, sf_dir):
    return copies(spark, sf_dir).select(F.col("url_anuncio").alias("url")).distinct().orderBy("url")


@query("skew_join_left", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def skew_join_left(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey"
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    return li.join(orders, "k", "left").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


