"""Listing-shaped projections of the given tables.

The tables hold no listings, so every query derives them. One text serves Spark and the SQL oracle;
the few functions that differ are picked by dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthlake.session import spread_small_scan

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are costly to process: parsed, matched or turned into vectors."""
    return spread_small_scan(table(spark, sf_dir, name))


def dots(x: str, spark: bool) -> str:
    """Whole number with dots between thousands."""
    grouped = f"format_number({x}, 0)" if spark else f"format('{{:,}}', {x})"
    return f"replace({grouped}, ',', '.')"


def listings_sql(spark: bool, orders="orders", customer="customer", nation="nation") -> str:
    """Raw portal listings: every cell is text or NULL."""
    def d(x: str) -> str:
        return dots(x, spark)

    return f"""
SELECT row_seq, portal,
  'https://listings.example/apartamento-venda-pb-joao-pessoa-' || slug || '-' || area || 'm2-rs' || price
    || '/id-' || row_seq AS url_anuncio,
  '  ' || seg || ' apartment ' AS titulo,
  CASE pr WHEN '1-URGENT' THEN 'R$ ' || {d('price')} WHEN '2-HIGH' THEN {d('price')} || ',50'
    WHEN '3-MEDIUM' THEN cast(price AS STRING) WHEN '5-LOW' THEN {d('price * 200')}
    ELSE CASE st WHEN 'F' THEN 'Nao informado' WHEN 'O' THEN '1.' || price ELSE '-' || price END END AS preco_venda,
  CASE seg WHEN 'BUILDING' THEN 'Rua das Flores, 12 - Bessa Norte' WHEN 'AUTOMOBILE' THEN 'Av. Epitácio, Tambaú'
    WHEN 'HOUSEHOLD' THEN 'Rua B_1, ' || place WHEN 'FURNITURE' THEN 'Água  Fria/Centro' END AS endereco_completo,
  CASE seg WHEN 'BUILDING' THEN area || ' m²' WHEN 'AUTOMOBILE' THEN area || ',5 m²' WHEN 'MACHINERY' THEN area || '.75'
    WHEN 'FURNITURE' THEN '1.' || lpad(cast(area AS STRING), 3, '0') || '.100' END AS area_util,
  (area + 10) || ' m²' AS area_total,
  CASE st WHEN 'F' THEN mon || ' quartos' WHEN 'O' THEN cast(mon AS STRING) END AS quartos,
  CASE WHEN pr < '3' THEN 'true' ELSE q || ' suítes' END AS suites,
  CASE st WHEN 'P' THEN 'False' ELSE q || ' banheiros' END AS banheiros,
  CASE WHEN pr > '2' THEN cast(dom AS STRING) END AS garagens,
  CASE WHEN pr > '3' THEN cast(q AS STRING) END AS vagas,
  CASE st WHEN 'F' THEN ' Isento ' WHEN 'O' THEN 'R$ ' || {d('dom * 1000')} ELSE '--' END AS condominio,
  CASE st WHEN 'P' THEN 'isento' WHEN 'O' THEN {d('dom * 50')} || ',25' ELSE 'nan' END AS iptu,
  CASE st WHEN 'F' THEN place WHEN 'O' THEN 'João Pessoa' END AS bairro,
  CASE seg WHEN 'BUILDING' THEN 'Piscina, Elevador(es), Sacada' WHEN 'AUTOMOBILE' THEN 'Vaga de garagem, Spa, Armário embutido'
    WHEN 'MACHINERY' THEN 'Academia, Varanda Gourmet, Carpete' WHEN 'HOUSEHOLD' THEN 'Mobiliado,, Interfone , Área de serviço' END
    AS comodidades_area_privativa,
  CASE pr WHEN '1-URGENT' THEN 'Salão de Festas, Portaria 24h, Piscina Infantil' WHEN '2-HIGH' THEN 'Quadra de Esporte, Cerca elétrica'
    WHEN '3-MEDIUM' THEN 'Churrasqueira(s) coletiva(s), Espaço Gourmet, Supermercados' WHEN '5-LOW' THEN '' END AS comodidades_area_comum,
  CASE seg WHEN 'BUILDING' THEN '85 m², 3 quartos, Piscina, Ar-condicionado' WHEN 'AUTOMOBILE' THEN 'Piscina, Salão de Festas, 2 vagas'
    WHEN 'FURNITURE' THEN 'Academia, 4º andar, Aceita pet, Academia' END AS comodidades_imovel,
  CASE st WHEN 'F' THEN mon || ' quartos, sendo ' || q || ' suítes e ' || dom || ' vagas. Elevador social.'
    WHEN 'O' THEN 'Dois dormitórios, ' || q || ' Banheiros, três vagas; aceita pet.'
    ELSE CASE pr WHEN '1-URGENT' THEN 'Descrição não encontrada.' WHEN '2-HIGH' THEN '   ' WHEN '3-MEDIUM' THEN 'Mobiliado'
      WHEN '5-LOW' THEN 'Apartamento mobiliado com varanda, uma suíte e sete quartos a 200 m da praia' END END AS descricao_completa,
  price AS raw_price, area AS raw_area, mon, q, dom, seg, st, pr, place
FROM (
  SELECT o_orderkey AS row_seq, o_orderpriority AS pr, o_orderstatus AS st, c_mktsegment AS seg, n_name AS place,
    lower(replace(n_name, '_', '-')) AS slug,
    CASE WHEN o_orderpriority < '3' THEN 'portal_a' ELSE 'portal_b' END AS portal,
    cast(floor(o_totalprice) AS BIGINT) AS price, cast(floor(abs(c_acctbal) / 40) AS BIGINT) AS area,
    cast(month(o_orderdate) AS BIGINT) AS mon, cast(quarter(o_orderdate) AS BIGINT) AS q,
    cast(day(o_orderdate) AS BIGINT) AS dom
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
) base"""


def units_sql(lineitem="lineitem") -> str:
    """Typed numeric listings with missing cells and 0/1 flags."""
    return f"""
SELECT cast(l_orderkey AS BIGINT) AS order_id,
  'https://units.example/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS url_anuncio,
  CASE WHEN l_discount < 0.09 THEN round(l_extendedprice * 10, 2) END AS preco_venda,
  CASE WHEN l_tax > 0.0 THEN l_quantity * 8 END AS area_util,
  CASE WHEN l_tax > 0.01 THEN l_quantity * 8 + 10 * l_linenumber END AS area_total,
  cast(l_linenumber AS DOUBLE) AS quartos,
  CASE WHEN l_linenumber < 6 THEN cast(l_linenumber - 1 AS DOUBLE) END AS suites,
  cast(floor(l_quantity / 10) AS DOUBLE) AS banheiros,
  CASE WHEN l_discount > 0.01 THEN cast(floor(l_discount * 100) AS DOUBLE) END AS garagens,
  CASE WHEN l_tax > 0.03 THEN l_tax * 100000 END AS condominio,
  CASE WHEN l_discount > 0.05 THEN l_extendedprice / 50 END AS iptu,
  cast(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS INT) AS com_piscina,
  cast(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS INT) AS com_elevador,
  cast(CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS INT) AS com_varanda,
  cast(1 AS INT) AS com_constante,
  cast(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS INT) AS origem_anuncio_portal_a,
  l_returnflag AS place, l_linestatus AS status
FROM {lineitem}"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {n: table(spark, sf_dir, n) for n in ("customer", "nation")}
    frames["orders"] = spread_table(spark, sf_dir, "orders")
    return spark.sql(listings_sql(True, "{orders}", "{customer}", "{nation}"), **frames)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(units_sql("{lineitem}"), lineitem=spread_table(spark, sf_dir, "lineitem"))


NUMERIC = ["area_util", "area_total", "quartos", "suites", "banheiros", "garagens", "condominio", "iptu"]
FLAGS = ["com_piscina", "com_elevador", "com_varanda", "origem_anuncio_portal_a"]
LISTINGS_CTE = f"listings AS ({listings_sql(False)})"
UNITS_CTE = f"units AS ({units_sql()})"
