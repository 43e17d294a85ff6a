"""Report and pipeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.catalog import duck as D
from hearthlake.catalog.amenity_queries import TOKENS_CTE, VOCAB_CTE, _flag_sql
from hearthlake.catalog.fixtures import LISTINGS_CTE, UNITS_CTE, listings, table, units
from hearthlake.catalog.registry import query
from hearthlake.operators import diagnostics, filters, legacy, linkage, reports
from hearthlake.plans import pipelines

WITH_LISTINGS = D.with_ctes(LISTINGS_CTE)
WITH_UNITS = D.with_ctes(UNITS_CTE)

PROPERTY_CTE = f"""props AS (SELECT 'prop-' || row_seq AS id, trim(titulo) AS title, nullif({D.money('preco_venda')}, 0) AS price_sale,
  coalesce(nullif({D.decimal('area_util')}, 0), nullif({D.decimal('area_total')}, 0)) AS area_m2,
  {D.integer('quartos')} AS bedrooms, {D.integer('banheiros')} AS bathrooms, {D.integer('garagens')} AS parking_spots,
  {', '.join(_flag_sql(n) for n in vocab.KEYWORD_FLAGS)}, {D.title(D.place_url('url_anuncio'))} AS neighborhood FROM listings)"""
MEDIAN_SQL = "quantile_cont(price_sale / area_m2, 0.5)"
GUARD = "price_sale > 10000 AND price_sale < 20000000 AND area_m2 > 0"


def properties(spark, sf_dir):
    return pipelines.property_rows(listings(spark, sf_dir))


@query("median_price_m2", f"""{WITH_LISTINGS}, {PROPERTY_CTE} SELECT neighborhood AS name, round_even({MEDIAN_SQL}, 0)::BIGINT AS avg_price_m2_sale
  FROM props WHERE {GUARD} AND neighborhood IS NOT NULL GROUP BY 1""")
def median_price_m2(spark, sf_dir):
    medians = reports.median_price_per_area(properties(spark, sf_dir), "neighborhood", "price_sale", "area_m2")
    return reports.place_table(medians, "Cidade").select("name", "avg_price_m2_sale")


@query("property_rows", f"""{WITH_LISTINGS}, {PROPERTY_CTE} SELECT *, 'Apartment' AS subtype, 'sale' AS transaction, NULL::BIGINT AS price_rent,
  NULL::DOUBLE AS iptu_year, NULL::DOUBLE AS condo_fee, NULL::BOOLEAN AS accepts_financing, NULL::INT AS year_built, NULL::INT AS floor,
  NULL::VARCHAR AS condominium, NULL::VARCHAR AS builder, NULL::INT AS built_year FROM props""")
def property_rows(spark, sf_dir):
    return properties(spark, sf_dir)


@query("property_totals", f"""{WITH_LISTINGS}, {PROPERTY_CTE} SELECT count(*) AS properties, count(*) FILTER (WHERE pets_allowed) AS pets_allowed,
  count(*) FILTER (WHERE has_elevator) AS has_elevator, count(*) FILTER (WHERE has_balcony) AS has_balcony,
  count(*) FILTER (WHERE furnished) AS furnished, count(neighborhood) AS with_place,
  count(*) FILTER (WHERE neighborhood IS NULL) AS without_place FROM props""")
def property_totals(spark, sf_dir):
    return reports.property_totals(properties(spark, sf_dir))


@query("normalize_listings", f"""{WITH_LISTINGS}, {PROPERTY_CTE}, {TOKENS_CTE}, {VOCAB_CTE} SELECT 'properties' AS name, count(*) AS rows FROM props
  UNION ALL SELECT 'neighborhoods', count(DISTINCT neighborhood) FROM props WHERE {GUARD}
  UNION ALL SELECT 'amenities', count(DISTINCT amenity) FROM tokens JOIN vocab USING (token)
  UNION ALL SELECT 'rel_amenities', count(*) FROM (SELECT DISTINCT row_seq, amenity FROM tokens JOIN vocab USING (token))
  UNION ALL SELECT 'cities', 1""")
def normalize_listings(spark, sf_dir):
    out = pipelines.normalize_listings(listings(spark, sf_dir), "Cidade", "UF")
    names = ["properties", "cities", "neighborhoods", "amenities", "rel_amenities"]
    counts = [getattr(out, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n in names]
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return total


@query("token_estimate", f"""SELECT count(*) AS total_rows, count(c) AS valid_rows, sum(c)::BIGINT AS total_chars, round(avg(c), 6) AS avg_chars,
  max(c)::BIGINT AS max_chars, min(c)::BIGINT AS min_chars, floor(sum(c) / 3.7::DOUBLE + count(c) * 150)::BIGINT AS input_tokens,
  (count(c) * 80)::BIGINT AS output_tokens, floor(sum(c) / 3.7::DOUBLE + count(c) * 150 + count(c) * 80)::BIGINT AS total_tokens
  FROM (SELECT CASE WHEN text <> '' AND text <> '{vocab.NO_DESCRIPTION}' THEN length({D.strip('text')}) END AS c FROM documents)""")
def token_estimate(spark, sf_dir):
    return reports.text_volume(table(spark, sf_dir, "documents"), "text").withColumn("avg_chars", F.round("avg_chars", 6))


@query("leakage_audit", f"""{WITH_UNITS}, own AS (SELECT place, quantile_cont(preco_venda / area_util, 0.5) AS m FROM units
   WHERE preco_venda > 10000 AND preco_venda < 20000000 AND area_util > 0 GROUP BY 1),
  other AS (SELECT l_returnflag AS place, avg(l_extendedprice) / 20 AS f FROM lineitem GROUP BY 1)
  SELECT count(*) AS groups, round(corr(m, f), 6) AS correlation, round(quantile_cont(abs(m - f) / m, 0.5), 6) AS median_relative_gap FROM own JOIN other USING (place)""")
def leakage_audit(spark, sf_dir):
    own = reports.median_price_per_area(units(spark, sf_dir), "place", "preco_venda", "area_util").withColumnRenamed("name", "place")
    other = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("place")).agg((F.avg("l_extendedprice") / 20).alias("figure"))
    return diagnostics.leakage_audit(own, other, "place", "median", "figure").withColumns({
        "correlation": F.round("correlation", 6), "median_relative_gap": F.round("median_relative_gap", 6)
    })


@query("enrichment_diagnostics", f"""{WITH_LISTINGS} SELECT count(*) FILTER (WHERE len({D.plain('descricao_completa')}) > 40) AS usable,
  round(avg((len({D.plain('descricao_completa')}) > 40)::INT::DOUBLE), 9) AS share FROM listings""")
def enrichment_diagnostics(spark, sf_dir):
    out = pipelines.enrichment_diagnostics(listings(spark, sf_dir))
    return out["usable"].withColumn("share", F.round("share", 9))


@query("merge_parts", """SELECT source_file, count(*) AS records, count(*) FILTER (WHERE rn = 1) AS new FROM (
  SELECT o_orderpriority AS source_file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM orders) GROUP BY 1""")
def merge_parts(spark, sf_dir):
    parts = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias(vocab.URL), F.col("o_orderpriority").alias("source_file"),
        F.col("o_orderkey").alias("row_seq"),
    )
    return pipelines.merge_parts(parts, ["source_file", "row_seq"])[1]


@query("merge_parts_rows", """SELECT o_custkey::VARCHAR AS url_anuncio, arg_min(o_orderpriority, (o_orderpriority, o_orderkey)) AS source,
  arg_min(o_totalprice, (o_orderpriority, o_orderkey)) AS o_totalprice FROM orders GROUP BY o_custkey""")
def merge_parts_rows(spark, sf_dir):
    """The merged rows themselves: the first row of each URL in file and row order."""
    parts = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias(vocab.URL), F.col("o_orderpriority").alias("source_file"),
        F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("row_seq"), "o_totalprice",
    )
    return pipelines.merge_parts(parts, ["source_file", "row_seq"])[0]


def _parsed(c):
    return {
        "preco_venda": D.price("preco_venda"), "condominio": D.fee("condominio"), "iptu": D.fee("iptu"),
        "garagens": f"coalesce({D.measure('garagens')}, {D.measure('vagas')})",
    }.get(c, D.measure(c))


def _num(c):
    lo, hi = vocab.PLAUSIBLE_RANGES[c]
    src = _parsed(c)
    return f"CASE WHEN ({src}) BETWEEN {lo} AND {hi} THEN ({src}) END"


@query("feature_matrix", f"""{WITH_LISTINGS}, t AS (SELECT row_seq, url_anuncio, {D.plain('descricao_completa')} AS plain,
   {', '.join(f'{_num(c)} AS {c}' for c in vocab.PLAUSIBLE_RANGES)}, {D.place('endereco_completo', 'bairro')} AS place, comodidades_imovel FROM listings),
  g AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY place) < 30 THEN 'outros' ELSE place END AS b FROM t)
  SELECT url_anuncio, preco_venda, area_util, area_total, condominio, iptu,
    {', '.join(f"coalesce({c}, {D.prose('plain', c)}) AS {c}" for c in vocab.PROSE_FIELDS)},
    coalesce(contains(comodidades_imovel, 'Piscina'), false)::TINYINT AS com_piscina, (b = 'centro')::TINYINT AS bairro_centro,
    (b = 'tambau')::TINYINT AS bairro_tambau FROM g""")
def feature_matrix(spark, sf_dir):
    df = listings(spark, sf_dir)
    keep = [c for c in df.columns if c in vocab.RAW_LISTING_COLUMNS]
    scraped = F.coalesce(F.contains("comodidades_imovel", F.lit("Piscina")), F.lit(False))
    master = df.select(*keep, scraped.alias("comodidade_piscina"), scraped.alias("piscina"))
    matrix, _ = pipelines.feature_matrix(master)
    return matrix.select(
        "url_anuncio", "preco_venda", "area_util", "area_total", "condominio", "iptu", *vocab.PROSE_FIELDS,
        "com_piscina", "bairro_centro", "bairro_tambau",
    )


# Columns of the matrix beside the one-hot ones: the key, ten numbers and a flag are made from the twenty given.
_PLACE_SHARES = f"""shares AS (SELECT 'bairro_' || {D.slug('b')} AS k, count(*) / (SELECT count(*) FROM t) AS s FROM g GROUP BY 1)"""
_KEPT = f"s BETWEEN {vocab.MIN_FLAG_SHARE} AND {vocab.MAX_DUMMY_SHARE}"
_REPORT_CTES = f"""{WITH_LISTINGS}, t AS (SELECT {D.plain('descricao_completa')} AS plain, {', '.join(f'{_parsed(c)} AS p_{c}, {_num(c)} AS {c}' for c in vocab.PLAUSIBLE_RANGES)},
    {', '.join(f'{c} IS NOT NULL AND {D.measure(c)} IS NULL AS broken_{c}' for c in vocab.REPAIRABLE_COLUMNS)},
    {D.place('endereco_completo', 'bairro')} AS place, coalesce(contains(comodidades_imovel, 'Piscina'), false) AS piscina FROM listings),
  g AS (SELECT CASE WHEN count(*) OVER (PARTITION BY place) < {vocab.MIN_LISTINGS_PER_PLACE} THEN 'outros' ELSE place END AS b FROM t), {_PLACE_SHARES}"""
_RARE_FLAG = f"(SELECT avg(piscina::INT) < {vocab.MIN_FLAG_SHARE} FROM t)"


@query("feature_report", f"""{_REPORT_CTES}, rows AS (
  SELECT 'flags' AS step, 'source' AS key, 2.0::DOUBLE AS value UNION ALL SELECT 'flags', 'canonical', 1 UNION ALL SELECT 'merged_flags', 'piscina', 2
  UNION ALL SELECT 'flag_filter', 'generic', 0 UNION ALL SELECT 'flag_filter', 'rare', {_RARE_FLAG}::INT UNION ALL SELECT 'flag_filter', 'kept', (NOT {_RARE_FLAG})::INT
  UNION ALL SELECT 'dummies_dropped', k, 1 FROM shares WHERE NOT ({_KEPT})
  UNION ALL SELECT 'shape', 'input_columns', 20 UNION ALL SELECT 'shape', 'output_columns', 10 + (NOT {_RARE_FLAG})::INT + (SELECT count(*) FROM shares WHERE {_KEPT})
  UNION ALL SELECT 'shape', 'rows', count(*) FROM t
  {' '.join(f"UNION ALL SELECT 'repaired', '{c}', 0 * count(*) FROM t WHERE broken_{c} HAVING count(*) > 0" for c in vocab.REPAIRABLE_COLUMNS)}
  {' '.join(f"UNION ALL SELECT 'implausible', '{c}', count(*) FROM t WHERE p_{c} IS NOT NULL AND {c} IS NULL HAVING count(*) > 0" for c in vocab.PLAUSIBLE_RANGES)}
  {' '.join(f"UNION ALL SELECT 'filled_from_prose', '{c}', count(*) FROM t WHERE {c} IS NULL AND {D.prose('plain', c)} IS NOT NULL HAVING count(*) > 0" for c in vocab.PROSE_FIELDS)})
  SELECT * FROM rows""")
def feature_report(spark, sf_dir):
    """The consolidation report with raw records to repair from: they hold the same cells, so none is repaired."""
    df = listings(spark, sf_dir)
    keep = [c for c in df.columns if c in vocab.RAW_LISTING_COLUMNS]
    scraped = F.coalesce(F.contains("comodidades_imovel", F.lit("Piscina")), F.lit(False))
    master = df.select(*keep, "row_seq", scraped.alias("comodidade_piscina"), scraped.alias("piscina"))
    return pipelines.feature_matrix(master.drop("row_seq"), df.select(*keep, "row_seq"), ["row_seq"])[1]


_PROSE_CELLS = ", ".join(f"{D.prose('plain', c)} AS x_{c}" for c in vocab.PROSE_FIELDS)


@query("enrichment_diagnostics_whole", f"""{WITH_LISTINGS}, t AS (SELECT row_seq, {D.plain('descricao_completa')} AS plain, {', '.join(f'{_num(c)} AS {c}' for c in vocab.PROSE_FIELDS)} FROM listings),
  x AS (SELECT *, {_PROSE_CELLS} FROM t)
  SELECT 'usable' AS part, 'rows' AS key, count(*) FILTER (WHERE len(plain) > 40)::DOUBLE AS value FROM t
  {' '.join(f"UNION ALL SELECT 'compared', '{c}', count(*) FROM x WHERE {c} IS NOT NULL AND x_{c} IS NOT NULL HAVING count(*) > 0" for c in vocab.PROSE_FIELDS)}
  {' '.join(f"UNION ALL SELECT 'exact', '{c}', round(avg(({c} = x_{c})::INT), 9) FROM x WHERE {c} IS NOT NULL AND x_{c} IS NOT NULL HAVING count(*) > 0" for c in vocab.PROSE_FIELDS)}
  {' '.join(f"UNION ALL SELECT 'before', '{c}', count(*) FILTER (WHERE {c} IS NULL) FROM x UNION ALL SELECT 'after', '{c}', count(*) FILTER (WHERE {c} IS NULL AND x_{c} IS NULL) FROM x" for c in vocab.PROSE_FIELDS)}
  {' '.join(f"UNION ALL SELECT 'filled', '{c}', round(sum(coalesce({c}, x_{c}) * (1 + row_seq % 7)), 3) FROM x" for c in vocab.PROSE_FIELDS)}""")
def enrichment_diagnostics_whole(spark, sf_dir):
    """All outputs as (part, key, value); the filled frame by a sum that weighs its rows."""
    out = pipelines.enrichment_diagnostics(listings(spark, sf_dir))
    shape = "part string, key string, value double"
    parts = [
        out["usable"].select(F.lit("usable").alias("part"), F.lit("rows").alias("key"), F.col("usable").cast("double").alias("value")),
        out["precision"].select(F.lit("compared"), "campo", F.col("comparaveis").cast("double")),
        out["precision"].select(F.lit("exact"), "campo", F.round("exato", 9)),
        out["missingness"].select(F.lit("before"), "field", F.col("before").cast("double")),
        out["missingness"].select(F.lit("after"), "field", F.col("after").cast("double")),
    ]
    fields = list(vocab.PROSE_FIELDS)
    weighed = out["filled"].agg(*[F.round(F.sum(F.col(c) * (1 + F.col("row_seq") % 7)), 3).alias(c) for c in fields])
    parts.append(weighed.unpivot([], fields, "key", "value").select(F.lit("filled"), "key", "value"))
    whole = spark.createDataFrame([], shape)
    for part in parts:
        whole = whole.union(part)
    return whole


@query("boolean_columns", """WITH t AS (SELECT l_quantity > 10 AS big, CASE WHEN l_tax > 0.02 THEN CASE WHEN l_tax > 0.05 THEN 'True' ELSE 'false' END END AS told, l_returnflag FROM lineitem),
  c AS (SELECT 'l_is_big' AS "column", count(big) > 0 AS ok FROM t UNION ALL SELECT 'l_text_flag', bool_and(lower(told) IN ('true', 'false')) FROM t
    UNION ALL SELECT 'l_returnflag', bool_and(lower(l_returnflag) IN ('true', 'false')) FROM t UNION ALL SELECT 'l_empty', count(NULL::BOOLEAN) > 0 FROM t)
  SELECT "column" FROM c WHERE ok""")
def boolean_columns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", (F.col("l_quantity") > 10).alias("l_is_big"),
        F.when(F.col("l_tax") > 0.02, F.when(F.col("l_tax") > 0.05, "True").otherwise("false")).alias("l_text_flag"),
        "l_returnflag", F.lit(None).cast("boolean").alias("l_empty"), (F.col("l_linenumber") % 2).alias("l_zero_one"),
    )
    return spark.createDataFrame([(c,) for c in filters.boolean_columns(df, check_text=True)], "column string")


@query("drop_free_text", f"{WITH_LISTINGS} SELECT url_anuncio, quartos, bairro FROM listings")
def drop_free_text(spark, sf_dir):
    df = listings(spark, sf_dir).select("titulo", "quartos", "descricao_completa", "url_anuncio", "bairro")
    return filters.drop_free_text(df)


@query("cities", "SELECT 'Cidade' AS name, 'UF' AS state, count(*) AS listings FROM orders")
def cities(spark, sf_dir):
    out = pipelines.normalize_listings(listings(spark, sf_dir), "Cidade", "UF")
    return out.cities.withColumn("listings", out.properties.agg(F.count(F.lit(1))).scalar())


@query("legacy_card_records", """SELECT p_retailprice AS preco, -1.0::DOUBLE AS preco_condominio, p_size::DOUBLE AS preco_iptu, p_name AS titulo,
  p_size::BIGINT AS tamanho, CASE WHEN p_size > 20 THEN 3 ELSE -1 END::BIGINT AS quartos, -1::BIGINT AS banheiros, p_size::BIGINT AS suites, 2::BIGINT AS garagens,
  contains(lower(p_type), 'elevador') AS elevador, true AS piscina, false AS academia, true AS portaria_24h, p_size > 20 AS varanda, false AS quadra,
  p_brand AS endereco_completo, 'Bessa' AS bairro, 'Rua ' || p_brand AS rua, p_size::BIGINT AS numero, 'i.png' AS url_imagem, 'u' || p_partkey AS url_anuncio,
  'casa' AS tipo_imovel, year(current_date)::BIGINT AS ano_scraping, month(current_date)::BIGINT AS mes_scraping, 25::BIGINT AS fields FROM part""")
def legacy_card_records(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    big = F.col("p_size") > 20
    cards = part.select(
        F.concat(F.lit("R$ "), F.replace(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))).alias("preco"),
        F.lit(None).cast("string").alias("condominio"), F.concat(F.lit("R$ "), size).alias("iptu"), F.col("p_name").alias("titulo"),
        F.concat(F.lit("Rua "), "p_brand", F.lit(", "), size).alias("rua"), F.lit("Bessa, João Pessoa").alias("bairro"),
        F.array(F.concat(size, F.lit(" m² área útil")), F.when(big, "3 quartos").otherwise("0 quartos"), F.lit("2 garagens")).alias("rotulos"),
        F.lit("i.png").alias("imagem"), F.concat(F.lit("Endereço indisponível "), "p_brand").alias("endereco"),
        F.create_map(F.lit("Suites"), F.concat(size, F.lit(" suítes"))).alias("caracteristicas"),
        F.create_map(
            F.lit("area_comum"), F.concat(F.lit("Piscina, Portaria 24h, "), "p_type"),
            F.lit("area_privativa"), F.when(big, "Varanda").otherwise("Spa"),
        ).alias("secoes"),
        F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url_anuncio"),
    )
    out = legacy.card_records(cards, "casa")
    return out.drop("detalhes_completos_json").withColumn("fields", F.lit(len(out.columns)).cast("bigint"))


@query("legacy_records", """SELECT p_partkey, CASE WHEN p_size > 20 THEN p_size ELSE -1 END AS quartos, p_retailprice AS preco,
  'casa' AS tipo_imovel, year(current_date)::BIGINT AS ano_scraping, month(current_date)::BIGINT AS mes_scraping FROM part""")
def legacy_records(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") > 20, F.col("p_size")).alias("quartos"), F.col("p_retailprice").alias("preco")
    )
    return linkage.legacy_records(part, "casa")


