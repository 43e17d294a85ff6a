"""Amenity, flag and encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.catalog import duck as D
from hearthlake.catalog.fixtures import LISTINGS_CTE, UNITS_CTE, listings, table, units
from hearthlake.catalog.registry import query
from hearthlake.functions import text
from hearthlake.operators import amenities, encoding, sparse
from hearthlake.plans import pipelines

WITH_LISTINGS = D.with_ctes(LISTINGS_CTE)
WITH_UNITS = D.with_ctes(UNITS_CTE)
TOKENS = D.tokens("comodidades_area_privativa", "comodidades_area_comum")
TOKENS_CTE = f"tokens AS (SELECT row_seq, unnest({TOKENS}) AS token FROM listings)"
VOCAB_CTE = "vocab(token, amenity, category) AS (VALUES " + ", ".join(
    f"({D.quoted(t)}, {D.quoted(a)}, {D.quoted(c)})" for t, (a, c) in vocab.AMENITY_TOKENS.items()
) + ")"
LISTS = pipelines.AMENITY_LISTS


def tokens(spark, sf_dir):
    return amenities.listing_tokens(listings(spark, sf_dir), "row_seq", *LISTS)


@query("comma_tokens", f"{WITH_LISTINGS}, {TOKENS_CTE} SELECT row_seq, token FROM tokens")
def comma_tokens(spark, sf_dir):
    return tokens(spark, sf_dir)


@query("synonym_canon", f"""SELECT p_partkey, {D.synonym(D.slug("p_name || ' ' || p_type"))} AS canon FROM part
  UNION ALL SELECT -row_seq, {D.synonym(D.slug('token'))} FROM ({WITH_LISTINGS}, {TOKENS_CTE} SELECT * FROM tokens)""")
def synonym_canon(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", text.slug_text(F.concat_ws(" ", "p_name", "p_type")).alias("slug")
    )
    words = tokens(spark, sf_dir).select((-F.col("row_seq")).alias("p_partkey"), text.slug_text("token").alias("slug"))
    return parts.unionByName(words).select("p_partkey", text.canonical_term(F.col("slug")).alias("canon"))


@query("flag_names", f"""{WITH_LISTINGS} SELECT DISTINCT 'comodidade_' || replace(replace(token, ' ', '_'), '-', '_') AS flag,
  {D.flag("'comodidade_' || replace(replace(token, ' ', '_'), '-', '_')")} AS canonical
  FROM (SELECT unnest({D.tokens('comodidades_imovel')}) AS token FROM listings)
  WHERE NOT (""" + " OR ".join(f"contains(token, '{w}')" for w in vocab.NON_AMENITY_WORDS) + ")")
def flag_names(spark, sf_dir):
    flags = listings(spark, sf_dir).select(F.explode(amenities.portal_b_flags("comodidades_imovel")).alias("flag")).distinct()
    return text.with_canonical_flag(flags, "flag")


def _flag_sql(name: str) -> str:
    words, keys = vocab.KEYWORD_FLAGS[name]
    has = " OR ".join(f"list_contains({TOKENS}, {D.quoted(w)})" for w in words)
    said = " OR ".join(f"contains(lower(coalesce(descricao_completa, '')), {D.quoted(k)})" for k in keys)
    return f"({has} OR {said}) AS {name}"


@query("keyword_flags", f"{WITH_LISTINGS} SELECT row_seq, " + ", ".join(_flag_sql(n) for n in vocab.KEYWORD_FLAGS) + " FROM listings")
def keyword_flags(spark, sf_dir):
    df = listings(spark, sf_dir).withColumn("tokens", text.comma_tokens(*LISTS))
    return df.select("row_seq", *[
        text.keyword_flag(F.col("tokens"), "descricao_completa", n).alias(n) for n in vocab.KEYWORD_FLAGS
    ])


@query("amenity_edges", f"""{WITH_LISTINGS}, {TOKENS_CTE}, {VOCAB_CTE}
  SELECT DISTINCT 'property' AS owner_kind, row_seq AS owner_key, amenity AS amenity_name FROM tokens JOIN vocab USING (token)""")
def amenity_edges(spark, sf_dir):
    return amenities.amenity_edges(tokens(spark, sf_dir), "row_seq")


@query("amenities_used", f"""{WITH_LISTINGS}, {TOKENS_CTE}, {VOCAB_CTE}
  SELECT DISTINCT amenity AS name, category FROM tokens JOIN vocab USING (token)""")
def amenities_used(spark, sf_dir):
    return amenities.amenities_used(amenities.amenity_edges(tokens(spark, sf_dir), "row_seq"))


FLAG_WORDS = [w for words, _ in vocab.KEYWORD_FLAGS.values() for w in words]


@query("top_dropped_tokens", f"""{WITH_LISTINGS}, {TOKENS_CTE}, {VOCAB_CTE}
  SELECT token, count(*) AS cnt FROM tokens WHERE token NOT IN (SELECT token FROM vocab) AND token NOT IN {D.in_list(FLAG_WORDS)}
  GROUP BY token ORDER BY cnt DESC, token LIMIT 15""")
def top_dropped_tokens(spark, sf_dir):
    return amenities.top_counts(amenities.dropped_tokens(tokens(spark, sf_dir)), "token", "cnt", 15)


CANON_CTE = f"""canon AS (SELECT DISTINCT row_seq, {D.synonym(D.slug('token'))} AS amenity FROM tokens WHERE {D.slug('token')} <> '')"""


@query("amenity_frequency", f"{WITH_LISTINGS}, {TOKENS_CTE}, {CANON_CTE} SELECT amenity, count(*) AS listings FROM canon GROUP BY 1")
def amenity_frequency(spark, sf_dir):
    df = listings(spark, sf_dir).select("row_seq", amenities.canonical_set(*LISTS).alias("set"))
    return amenities.amenity_frequency(df, "set")


MATRIX = ["piscina", "churrasqueira", "portaria_seguranca_24h", "permitido_pets", "interfone"]


@query("amenity_matrix", f"""{WITH_LISTINGS}, {TOKENS_CTE}, {CANON_CTE}, f AS (SELECT amenity FROM canon GROUP BY 1 HAVING count(*) >= 20)
  SELECT url_anuncio, """ + ", ".join(
    f"max(CASE WHEN amenity = '{a}' AND amenity IN (SELECT amenity FROM f) THEN 1 ELSE 0 END) AS comodidade_{a}" for a in MATRIX
) + ", (SELECT count(*) FROM f) AS columns FROM listings LEFT JOIN canon USING (row_seq) GROUP BY url_anuncio, row_seq")
def amenity_matrix(spark, sf_dir):
    matrix, _ = pipelines.amenity_matrix(listings(spark, sf_dir))
    return matrix.select(
        "url_anuncio", *[f"comodidade_{a}" for a in MATRIX], F.lit(len(matrix.columns) - 1).alias("columns")
    )


# --- flags -------------------------------------------------------------------------------------

# Set flags from two generators per listing: the text side and the scraped side.
SET_FLAGS_CTE = f"""setflags AS (SELECT row_seq, unnest(list_transform({D.tokens('comodidades_imovel')}, lambda t: 'comodidade_' || replace(t, ' ', '_'))) AS flag FROM listings
  UNION ALL SELECT row_seq, token FROM tokens)"""


def set_flags(spark, sf_dir):
    df = listings(spark, sf_dir)
    scraped = F.transform(text.comma_tokens("comodidades_imovel"), lambda t: F.concat(F.lit("comodidade_"), F.translate(t, " ", "_")))
    return df.select("row_seq", F.explode(scraped).alias("flag")).unionByName(
        amenities.listing_tokens(df, "row_seq", *LISTS).withColumnRenamed("token", "flag")
    )


FOLDED_CTE = f"folded AS (SELECT DISTINCT row_seq, {D.flag('flag')} AS canonical FROM setflags)"
WITH_FOLDED = f"{WITH_LISTINGS}, {TOKENS_CTE}, {SET_FLAGS_CTE}, {FOLDED_CTE}"


@query("flag_or_fold", f"{WITH_FOLDED} SELECT row_seq, canonical FROM folded")
def flag_or_fold(spark, sf_dir):
    return amenities.fold_flags_long(set_flags(spark, sf_dir), "row_seq")


@query("flag_or_fold_wide", """SELECT l_orderkey, l_linenumber, l_partkey,
  (coalesce(l_tax > 0.04, false) OR coalesce(l_discount > 0.05, false))::TINYINT AS com_piscina,
  (l_quantity > 40)::TINYINT AS com_suites, (CASE WHEN l_returnflag = 'A' THEN true ELSE false END)::TINYINT AS com_supermercados,
  l_quantity AS suites FROM lineitem""")
def flag_or_fold_wide(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("suites"),
        (F.col("l_tax") > 0.04).alias("piscina"), (F.col("l_discount") > 0.05).alias("comodidade_piscina_privativa"),
        (F.col("l_quantity") > 40).alias("comodidade_suites"),
        F.when(F.col("l_returnflag") == "A", F.lit(True)).alias("supermercados"),
    )
    return amenities.fold_flags(df, ["piscina", "comodidade_piscina_privativa", "comodidade_suites", "supermercados"])


@query("folded_groups", f"""{WITH_FOLDED}, d AS (SELECT DISTINCT flag, {D.flag('flag')} AS canonical FROM setflags)
  SELECT canonical, count(*) OVER (PARTITION BY canonical) AS sources, flag FROM d QUALIFY sources > 1""")
def folded_groups(spark, sf_dir):
    return amenities.folded_groups(set_flags(spark, sf_dir))


@query("frequency_band", f"""{WITH_FOLDED}, n AS (SELECT count(*) AS total FROM listings)
  SELECT canonical, count(*) AS listings, round(count(*) / any_value(total), 9) AS share FROM folded, n
  WHERE canonical NOT IN {D.in_list(vocab.GENERIC_FLAGS)} GROUP BY canonical
  HAVING count(*) / any_value(total) BETWEEN 0.01 AND 0.99""")
def frequency_band(spark, sf_dir):
    flags = amenities.without_generic(amenities.fold_flags_long(set_flags(spark, sf_dir), "row_seq"))
    shares = amenities.prevalence(flags, table(spark, sf_dir, "orders"))
    return amenities.share_band(shares, vocab.MIN_FLAG_SHARE, vocab.MAX_DUMMY_SHARE).withColumn("share", F.round("share", 9))


@query("frequency_floor", f"""{WITH_FOLDED}, n AS (SELECT count(*) AS total FROM listings)
  SELECT canonical, count(*) AS listings, round(count(*) / any_value(total), 9) AS share FROM folded, n
  GROUP BY canonical HAVING count(*) / any_value(total) >= 0.01""")
def frequency_floor(spark, sf_dir):
    flags = amenities.fold_flags_long(set_flags(spark, sf_dir), "row_seq")
    shares = amenities.prevalence(flags, table(spark, sf_dir, "orders"))
    return amenities.share_band(shares, vocab.MIN_FLAG_SHARE).withColumn("share", F.round("share", 9))


# --- categories --------------------------------------------------------------------------------

@query("rare_category_fold", """SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) < 12 THEN 'outros'
  ELSE c_mktsegment || c_nationkey END AS category FROM customer""")
def rare_category_fold(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("category")
    )
    return encoding.fold_rare(df, "category", 12)


PLACES_CTE = f"placed AS (SELECT row_seq, {D.place('endereco_completo', 'bairro')} AS place FROM listings)"


@query("place_fill_and_fold", f"""{WITH_LISTINGS}, {PLACES_CTE} SELECT row_seq,
  CASE WHEN count(*) OVER (PARTITION BY place) < 150 THEN 'outros' ELSE place END AS bairro FROM placed""")
def place_fill_and_fold(spark, sf_dir):
    filled = encoding.fill_place(listings(spark, sf_dir).select("row_seq", "endereco_completo", "bairro"))
    return encoding.fold_rare(filled, "bairro", 150).select("row_seq", "bairro")


SEGMENTS = ["automobile", "building", "furniture", "household", "machinery"]


@query("one_hot", "SELECT c_custkey, " + ", ".join(
    f"(lower(c_mktsegment) = '{s}')::TINYINT AS c_mktsegment_{s}" for s in SEGMENTS) + " FROM customer")
def one_hot(spark, sf_dir):
    df, _ = encoding.one_hot(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])
    return df


@query("dummy_band", f"""{WITH_UNITS} SELECT url_anuncio, quartos, (place = 'A')::TINYINT AS place_a, (place = 'N')::TINYINT AS place_n,
  (place = 'R')::TINYINT AS place_r FROM units""")
def dummy_band(spark, sf_dir):
    df = units(spark, sf_dir).select("url_anuncio", "quartos", "place", F.lit("same").alias("kind"))
    coded, names = encoding.one_hot(df, ["place", "kind"])
    return encoding.filter_dummies(coded, names)[0]


# --- open vocabularies: orders as listings, their parts as flags -------------------------------

_CELLS_CTE = """c AS (SELECT DISTINCT l_orderkey, 'part_' || l_partkey AS f FROM lineitem), words AS (SELECT f, count(*) AS n, row_number() OVER (ORDER BY f) - 1 AS i FROM c GROUP BY f)"""


def _order_cells(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.array(F.concat(F.lit("part_"), F.col("l_partkey").cast("string"))).alias("flags"))
    return sparse.feature_cells(items, "l_orderkey", sets=["flags"])


@query("sparse_matrix", f"""WITH {_CELLS_CTE} SELECT l_orderkey AS key, (SELECT count(*) FROM words) AS size, count(*) AS cells,
  string_agg(i, ',' ORDER BY i) AS indices FROM c JOIN words USING (f) GROUP BY l_orderkey""")
def sparse_matrix(spark, sf_dir):
    cells = _order_cells(spark, sf_dir)
    found = sparse.sparse_vectors(cells, sparse.vocabulary(cells))
    return found.select(
        "key", "size", F.size("values").cast("bigint").alias("cells"), F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices")
    )


@query("sparse_pearson", f"""WITH {_CELLS_CTE}, n AS (SELECT count(DISTINCT l_orderkey) AS n FROM c),
  p AS (SELECT x.f AS feature_a, y.f AS feature_b, count(*) AS together FROM c x JOIN c y ON x.l_orderkey = y.l_orderkey AND x.f < y.f GROUP BY ALL)
  SELECT feature_a, feature_b, together, round((n.n * together - a.n * b.n) / (sqrt(n.n * a.n - a.n * a.n) * sqrt(n.n * b.n - b.n * b.n)), 9) AS r
  FROM p JOIN words a ON a.f = feature_a JOIN words b ON b.f = feature_b, n""")
def sparse_pearson(spark, sf_dir):
    orders = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().count()
    return sparse.sparse_pearson(_order_cells(spark, sf_dir), orders).withColumn("r", F.round("r", 9))
