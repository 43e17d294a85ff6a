"""Parsing, text and prose queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.catalog import duck as D
from hearthlake.catalog.fixtures import LISTINGS_CTE, UNITS_CTE, listings, spread_table, table, units
from hearthlake.catalog.registry import query
from hearthlake.functions import arrays, numbers, sql, text
from hearthlake.operators import enrichment, filters, repair

WITH_LISTINGS = D.with_ctes(LISTINGS_CTE)
WITH_UNITS = D.with_ctes(UNITS_CTE)


# --- number parsers ----------------------------------------------------------------------------

@query("parse_price_text", f"{WITH_LISTINGS} SELECT row_seq, {D.price('preco_venda')} AS price FROM listings")
def parse_price_text(spark, sf_dir):
    return listings(spark, sf_dir).select("row_seq", numbers.parse_price("preco_venda").alias("price"))


@query(
    "parse_number_text",
    f"""{WITH_LISTINGS} SELECT row_seq, {D.measure('area_util')} AS area, {D.measure('quartos')} AS bedrooms,
    {D.measure('suites')} IS NOT NULL AS suites_numeric FROM listings""",
)
def parse_number_text(spark, sf_dir):
    return listings(spark, sf_dir).select(
        "row_seq", numbers.parse_number("area_util").alias("area"),
        numbers.parse_number("quartos").alias("bedrooms"), numbers.is_numeric("suites").alias("suites_numeric"),
    )


@query("money_to_int", f"{WITH_LISTINGS} SELECT row_seq, {D.money('preco_venda')} AS amount FROM listings")
def money_to_int(spark, sf_dir):
    return listings(spark, sf_dir).select("row_seq", numbers.money_to_int("preco_venda").alias("amount"))


@query(
    "first_decimal_area",
    f"""{WITH_LISTINGS} SELECT row_seq, {D.decimal('area_util')} AS area,
    coalesce(nullif({D.decimal('area_util')}, 0), nullif({D.decimal('area_total')}, 0)) AS usable_area FROM listings""",
)
def first_decimal_area(spark, sf_dir):
    return listings(spark, sf_dir).select(
        "row_seq", numbers.first_decimal("area_util").alias("area"),
        numbers.usable_area("area_util", "area_total").alias("usable_area"),
    )


@query("first_int", f"{WITH_LISTINGS} SELECT row_seq, {D.integer('quartos')} AS bedrooms, {D.integer('suites')} AS suites FROM listings")
def first_int(spark, sf_dir):
    return listings(spark, sf_dir).select(
        "row_seq", numbers.first_int("quartos").alias("bedrooms"), numbers.first_int("suites").alias("suites")
    )


@query("fee_exempt_zero", f"{WITH_LISTINGS} SELECT row_seq, {D.fee('condominio')} AS condo, {D.fee('iptu')} AS iptu_year FROM listings")
def fee_exempt_zero(spark, sf_dir):
    return listings(spark, sf_dir).select(
        "row_seq", numbers.parse_fee("condominio").alias("condo"), numbers.parse_fee("iptu").alias("iptu_year")
    )


@query(
    "card_parsers",
    rf"""{WITH_LISTINGS}, c AS (SELECT row_seq, preco_venda, endereco_completo, suites,
      [area || ' m² área útil', quartos, q || ' banheiros', dom || ' garagens'] AS labels FROM (SELECT *, raw_area AS area FROM listings))
    SELECT row_seq,
      coalesce({D.number("replace(replace(regexp_replace(preco_venda, '[^0-9.,]', '', 'g'), '.', ''), ',', '.')", D.PLAIN)}, -1) AS price,
      coalesce(try_cast(nullif(regexp_extract(list_filter(labels, lambda x: contains(lower(x), 'área útil'))[-1], '^(\d+)', 1), '') AS BIGINT), -1) AS area,
      coalesce(try_cast(nullif(regexp_extract(list_filter(labels, lambda x: contains(lower(x), 'quarto'))[-1], '^(\d+)', 1), '') AS BIGINT), -1) AS bedrooms,
      coalesce(try_cast(nullif(regexp_extract(list_filter(labels, lambda x: contains(lower(x), 'banheiro'))[-1], '^(\d+)', 1), '') AS BIGINT), -1) AS bathrooms,
      coalesce(try_cast(nullif(regexp_extract(list_filter(labels, lambda x: contains(lower(x), 'garagens'))[-1], '^(\d+)', 1), '') AS BIGINT), -1) AS garages,
      {D.integer('suites')} AS suites_count
    FROM c""",
)
def card_parsers(spark, sf_dir):
    df = listings(spark, sf_dir).withColumn("labels", F.array(
        F.concat_ws("", "raw_area", F.lit(" m² área útil")), "quartos",
        F.concat_ws("", "q", F.lit(" banheiros")), F.concat_ws("", "dom", F.lit(" garagens")),
    ))
    routed = numbers.card_features("labels")
    return df.select(
        "row_seq", numbers.card_price("preco_venda").alias("price"), routed["area"].alias("area"),
        routed["quartos"].alias("bedrooms"), routed["banheiros"].alias("bathrooms"),
        routed["garagens"].alias("garages"), numbers.card_suites("suites").alias("suites_count"),
    )


@query(
    "numeric_columns",
    f"""{WITH_LISTINGS} SELECT row_seq, {D.price('preco_venda')} AS preco_venda, {D.measure('area_util')} AS area_util,
    {D.measure('quartos')} AS quartos, coalesce({D.measure('garagens')}, {D.measure('vagas')}) AS garagens,
    {D.fee('condominio')} AS condominio, {D.fee('iptu')} AS iptu FROM listings""",
)
def numeric_columns(spark, sf_dir):
    return repair.to_numeric_columns(listings(spark, sf_dir)).select(
        "row_seq", "preco_venda", "area_util", "quartos", "garagens", "condominio", "iptu"
    )


@query(
    "target_transforms",
    f"""{WITH_UNITS} SELECT url_anuncio, round(ln(preco_venda), 9) AS log_preco,
    CASE WHEN area_util > 0 THEN preco_venda / area_util END AS preco_m2,
    round(exp(ln(preco_venda)), 4) AS price_back FROM units WHERE preco_venda > 0""",
)
def target_transforms(spark, sf_dir):
    return filters.positive_target(units(spark, sf_dir)).select(
        "url_anuncio", F.round(numbers.log_price("preco_venda"), 9).alias("log_preco"),
        numbers.price_per_area("preco_venda", "area_util").alias("preco_m2"),
        F.round(F.exp(numbers.log_price("preco_venda")), 4).alias("price_back"),
    )


# --- normalisers -------------------------------------------------------------------------------

@query("fold_text", f"SELECT doc_id, {D.fold('text')} AS folded FROM documents")
def fold_text(spark, sf_dir):
    return spread_table(spark, sf_dir, "documents").select("doc_id", text.fold_text("text").alias("folded"))


@query("slug_text", f"SELECT doc_id, {D.slug('text')} AS slug FROM documents")
def slug_text(spark, sf_dir):
    return spread_table(spark, sf_dir, "documents").select("doc_id", text.slug_text("text").alias("slug"))


@query("plain_text", f"SELECT conv_id, turn, {D.plain('text')} AS plain FROM conversations")
def plain_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.plain_text("text").alias("plain"))


@query("place_from_url", f"{WITH_LISTINGS} SELECT row_seq, {D.title(D.place_url('url_anuncio'))} AS place FROM listings")
def place_from_url(spark, sf_dir):
    return listings(spark, sf_dir).select("row_seq", text.place_from_url("url_anuncio").alias("place"))


@query(
    "listing_id_from_url",
    rf"""{WITH_LISTINGS} SELECT url_anuncio, 'prop-' || regexp_extract(url_anuncio, '/id-(\d+)', 1) AS id FROM listings
    UNION ALL SELECT url, 'prop-' || coalesce(nullif(regexp_extract(url, '/id-(\d+)', 1), ''), sha256(url)) FROM pages""",
)
def listing_id_from_url(spark, sf_dir):
    pages = spread_table(spark, sf_dir, "pages").select(F.col("url").alias("url_anuncio"))
    both = listings(spark, sf_dir).select("url_anuncio").unionByName(pages)
    return both.select("url_anuncio", text.listing_id("url_anuncio").alias("id"))


@query(
    "resolve_place",
    f"""{WITH_LISTINGS} SELECT row_seq, {D.place('endereco_completo', 'bairro')} AS place,
    {D.place('endereco_completo')} AS from_address FROM listings""",
)
def resolve_place(spark, sf_dir):
    df = text.with_place(listings(spark, sf_dir), "place", "endereco_completo", "bairro")
    return text.with_place(df, "from_address", "endereco_completo").select("row_seq", "place", "from_address")


@query(
    "split_address",
    r"""SELECT o_orderkey, CASE WHEN contains(a, ',') AND (contains(a, 'Rua') OR contains(a, 'Avenida')) THEN trim(string_split(a, ',')[1])
      ELSE trim(a) END AS rua,
      CASE WHEN contains(a, ',') AND (contains(a, 'Rua') OR contains(a, 'Avenida')) AND regexp_full_match(trim(string_split(a, ',')[2]), '\d+')
      THEN trim(string_split(a, ',')[2])::BIGINT ELSE -1 END AS numero, string_split(p, ',')[1] AS bairro
    FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Rua ' || o_custkey || ', ' || o_orderkey
      WHEN 'O' THEN 'Avenida ' || o_custkey || ', s/n' ELSE 'Praça ' || o_custkey || ', 10' END AS a,
      'Bairro ' || o_custkey || ', Cidade' AS p FROM orders)""",
)
def split_address(spark, sf_dir):
    street = F.when(F.col("o_orderstatus") == "F", F.concat_ws("", F.lit("Rua "), "o_custkey", F.lit(", "), "o_orderkey")).when(
        F.col("o_orderstatus") == "O", F.concat_ws("", F.lit("Avenida "), "o_custkey", F.lit(", s/n"))
    ).otherwise(F.concat_ws("", F.lit("Praça "), "o_custkey", F.lit(", 10")))
    place = F.concat_ws("", F.lit("Bairro "), "o_custkey", F.lit(", Cidade"))
    parts = text.split_address(street, place)
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


@query(
    "contains_flags",
    """SELECT doc_id, contains(lower(text), 'que') AS has_que, contains(lower(text), 'the and') AS has_the_and FROM documents""",
)
def contains_flags(spark, sf_dir):
    return spread_table(spark, sf_dir, "documents").select(
        "doc_id", text.contains_flag("text", "QUE").alias("has_que"),
        text.contains_flag("text", "the and").alias("has_the_and"),
    )


@query(
    "label_values",
    r"""SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN p_size || ' ' WHEN 'LARGE' THEN p_size || ' m²' ELSE cast(p_size AS VARCHAR) END AS raw_value,
    cast(p_size AS VARCHAR) AS cleaned FROM part""",
)
def label_values(spark, sf_dir):
    part = spread_table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    raw = F.when(F.col("p_type") == "SMALL", F.concat(size, F.lit(" "))).when(
        F.col("p_type") == "LARGE", F.concat(size, F.lit(" m²"))
    ).otherwise(size)
    label = F.when(F.col("p_type") == "LARGE", "area-total").otherwise("Quartos")
    return part.select(
        "p_partkey", raw.alias("raw_value"),
        text.clean_label_value(F.concat(label, F.lit(" "), raw), F.lower(label)).alias("cleaned"),
    )


# --- predicates --------------------------------------------------------------------------------

@query(
    "usable_description",
    f"""{WITH_LISTINGS} SELECT row_seq, len({D.strip("coalesce(descricao_completa, '')")}) >= 10
      AND {D.strip("coalesce(descricao_completa, '')")} <> '{vocab.NO_DESCRIPTION}' AS usable,
      len({D.plain('descricao_completa')}) > 40 AS substantial FROM listings""",
)
def usable_description(spark, sf_dir):
    return listings(spark, sf_dir).select(
        "row_seq", text.usable_description("descricao_completa").alias("usable"),
        text.substantial_text("descricao_completa").alias("substantial"),
    )


RANGED = {c: vocab.PLAUSIBLE_RANGES[c] for c in ("preco_venda", "area_util", "area_total", "quartos", "garagens")}


@query(
    "plausibility_null",
    f"{WITH_UNITS} SELECT url_anuncio, " + ", ".join(
        f"CASE WHEN {c} >= {lo} AND {c} <= {hi} THEN {c} END AS {c}" for c, (lo, hi) in RANGED.items()
    ) + " FROM units",
)
def plausibility_null(spark, sf_dir):
    return filters.null_implausible(units(spark, sf_dir)).select("url_anuncio", *RANGED)


@query(
    "plausibility_counts",
    f"{WITH_UNITS} SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS out_of_range FROM units"
        for c, (lo, hi) in vocab.PLAUSIBLE_RANGES.items()
    ) + ") WHERE out_of_range > 0",
)
def plausibility_counts(spark, sf_dir):
    return filters.implausible_counts(units(spark, sf_dir))


# --- prose -------------------------------------------------------------------------------------

PLAIN = D.plain("descricao_completa")


@query(
    "extract_counts_from_prose",
    f"{WITH_LISTINGS} SELECT row_seq, " + ", ".join(
        f"{D.prose(PLAIN, c)} AS {c}" for c in vocab.PROSE_FIELDS
    ) + " FROM listings",
)
def extract_counts_from_prose(spark, sf_dir):
    df = listings(spark, sf_dir).withColumn("plain", text.plain_text("descricao_completa"))
    return df.select("row_seq", *[text.field_from_prose(F.col("plain"), c).alias(c) for c in vocab.PROSE_FIELDS])


CLEAN = ", ".join(f"{D.measure(c)} AS {c}" for c in ("quartos", "suites", "banheiros", "garagens"))
PROSE_CTES = f"""{WITH_LISTINGS}, typed AS (SELECT row_seq, {PLAIN} AS plain, {CLEAN} FROM listings)"""


def _typed(spark, sf_dir):
    df = listings(spark, sf_dir)
    return df.select("row_seq", "descricao_completa", *[
        numbers.parse_number(c).alias(c) for c in vocab.PROSE_FIELDS
    ])


@query(
    "fill_missing_from_prose",
    f"{PROSE_CTES} SELECT row_seq, " + ", ".join(
        f"coalesce({c}, {D.prose('plain', c)}) AS {c}" for c in vocab.PROSE_FIELDS
    ) + " FROM typed",
)
def fill_missing_from_prose(spark, sf_dir):
    return enrichment.fill_from_prose(_typed(spark, sf_dir)).select("row_seq", *vocab.PROSE_FIELDS)


@query(
    "fill_counts",
    f"{PROSE_CTES} SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) FILTER (WHERE {c} IS NULL AND {D.prose('plain', c)} IS NOT NULL) AS filled FROM typed"
        for c in vocab.PROSE_FIELDS
    ) + ") WHERE filled > 0",
)
def fill_counts(spark, sf_dir):
    return enrichment.fill_counts(_typed(spark, sf_dir))


@query(
    "extraction_precision",
    f"{PROSE_CTES} SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS campo, count(g) AS comparaveis, round(avg((g = 0)::INT::DOUBLE), 9) AS exato,
        round(avg((g <= 1)::INT::DOUBLE), 9) AS ate_1_de_diferenca
        FROM (SELECT abs({D.prose('plain', c)} - {c}) AS g FROM typed)"""
        for c in vocab.PROSE_FIELDS
    ) + ") WHERE comparaveis > 0",
)
def extraction_precision(spark, sf_dir):
    return enrichment.extraction_precision(_typed(spark, sf_dir)).select(
        "campo", "comparaveis", F.round("exato", 9).alias("exato"),
        F.round("ate_1_de_diferenca", 9).alias("ate_1_de_diferenca"),
    )


@query(
    "missingness_before_after",
    f"{PROSE_CTES} SELECT field, before, after, before - after AS recovered, round(CASE WHEN before > 0 THEN (before - after) / before ELSE 0 END, 9) AS ratio FROM (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS field, count(*) FILTER (WHERE {c} IS NULL) AS before,
        count(*) FILTER (WHERE {c} IS NULL AND {D.prose('plain', c)} IS NULL) AS after FROM typed"""
        for c in vocab.PROSE_FIELDS
    ) + ")",
)
def missingness_before_after(spark, sf_dir):
    return enrichment.missingness(_typed(spark, sf_dir)).withColumn("ratio", F.round("ratio", 9))


AREA_PATTERNS = {
    "rooms": r"(\d+)\s*quartos",
    "parking": r"(\d+)\s*vagas",
    "suites_after": r"sendo\s+(\d+)",
}


@query(
    "pattern_precision",
    f"{PROSE_CTES} " + " UNION ALL ".join(
        f"""SELECT '{n}' AS pattern, count(g) AS n, round(avg((g <= 0.1)::INT::DOUBLE), 9) AS within_share FROM (
        SELECT CASE WHEN quartos > 0 THEN abs(try_cast(nullif(regexp_extract(plain, '{p}', 1), '') AS DOUBLE) - quartos) / quartos END AS g FROM typed)"""
        for n, p in AREA_PATTERNS.items()
    ),
)
def pattern_precision(spark, sf_dir):
    return enrichment.pattern_precision(_typed(spark, sf_dir), AREA_PATTERNS, "quartos").withColumn(
        "within_share", F.round("within_share", 9)
    )


# --- arrays and JSON ---------------------------------------------------------------------------

@query(
    "json_array_union",
    """SELECT event_id, array_to_string(list_sort(list_distinct(list_concat(
      CASE WHEN event_type = 'error' THEN [] ELSE [event_type, 'k' || (props::JSON->>'k')] END, ['base', event_type]))), ',') AS merged
    FROM events""",
)
def json_array_union(spark, sf_dir):
    ev = spread_table(spark, sf_dir, "events")
    k = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    left = F.when(F.col("event_type") == "error", F.lit("[broken")).otherwise(F.to_json(F.array("event_type", k)))
    right = F.to_json(F.array(F.lit("base"), F.col("event_type")))
    union = arrays.union_sorted(arrays.json_string_array(left), arrays.json_string_array(right))
    return ev.select("event_id", F.array_join(union, ",").alias("merged"))


@query(
    "overlay_maps",
    """SELECT event_id, event_type AS kind, CASE WHEN event_type = 'view' THEN 'base' ELSE (props::JSON->>'k') END AS k,
    'fixed' AS extra FROM events""",
)
def overlay_maps(spark, sf_dir):
    ev = spread_table(spark, sf_dir, "events")
    base = F.create_map(F.lit("kind"), F.lit("none"), F.lit("k"), F.lit("base"), F.lit("extra"), F.lit("fixed"))
    update = F.when(
        F.col("event_type") == "view", F.create_map(F.lit("kind"), F.col("event_type"))
    ).otherwise(F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k")))
    merged = arrays.overlay(base, update)
    return ev.select("event_id", *[merged[n].alias(n) for n in ("kind", "k", "extra")])


@query(
    "records_as_json",
    """SELECT c_custkey, '{"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS record,
    '["' || c_name || '","' || c_mktsegment || '"]' AS pair FROM customer""",
)
def records_as_json(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_name", "c_mktsegment", "c_custkey")
    nested = df.withColumns({
        "record": F.struct("c_name", "c_mktsegment"), "pair": F.array("c_name", "c_mktsegment"),
    })
    return arrays.flat_for_text_sinks(nested).select("c_custkey", "record", "pair")


# --- the same for SQL users --------------------------------------------------------------------

_CLIPPED = D.strip("coalesce(descricao_completa, '')")


@query("sql_functions", f"""{WITH_LISTINGS} SELECT row_seq, {D.price('preco_venda')} AS price, {D.measure('area_util')} AS area, {D.money('preco_venda')} AS amount,
  {D.integer('quartos')} AS bedrooms, {D.fee('condominio')} AS condo, {D.fold('endereco_completo')} AS folded, {D.slug('endereco_completo')} AS slug,
  {D.place('endereco_completo', 'bairro')} AS place, {D.prose(D.plain('descricao_completa'), 'quartos')} AS told,
  CASE WHEN len({_CLIPPED}) >= 10 AND {_CLIPPED} <> '{vocab.NO_DESCRIPTION}' THEN {_CLIPPED} ELSE 'sem descricao disponivel' END AS clipped
  FROM listings WHERE {D.price('preco_venda')} > 0 OR {D.integer('quartos')} > 1""")
def sql_functions(spark, sf_dir):
    """Parsers and text rules called from SQL, in the select list and in the filter."""
    called = sql.register(spark, ["parse_price", "parse_number", "money_to_int", "first_int", "parse_fee", "fold_text", "slug_text", "resolve_place",
                                  "quartos_from_prose", "clip_text"], prefix="hl_")
    listings(spark, sf_dir).createOrReplaceTempView("hl_listings")
    price, number, money, integer, fee, fold, slug, place, prose, clip = called
    return spark.sql(f"""SELECT row_seq, {price}(preco_venda) AS price, {number}(area_util) AS area, {money}(preco_venda) AS amount,
      {integer}(quartos) AS bedrooms, {fee}(condominio) AS condo, {fold}(endereco_completo) AS folded, {slug}(endereco_completo) AS slug,
      {place}(endereco_completo, bairro) AS place, {prose}(descricao_completa) AS told, {clip}(descricao_completa) AS clipped
      FROM hl_listings WHERE {price}(preco_venda) > 0 OR {integer}(quartos) > 1""")
