"""Sitemap, page and response queries."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.catalog import duck as D
from hearthlake.catalog.fixtures import LISTINGS_CTE, listings, spread_table, table
from hearthlake.catalog.registry import query
from hearthlake.operators import extraction, filters
from hearthlake.operators.amenities import portal_b_flags
from hearthlake.plans import pipelines
from hearthlake.session import ensure_checkpoint_dir
from hearthlake.sources import extraction_store, markup, readers

WITH_LISTINGS = D.with_ctes(LISTINGS_CTE)

# --- sitemaps: customers' adverts written as sitemap text ---------------------------------------

LINK_SQL = """'https://x.example/' || CASE c_mktsegment WHEN 'BUILDING' THEN 'apartamento-venda' WHEN 'MACHINERY' THEN 'apartamento-aluguel'
  WHEN 'HOUSEHOLD' THEN 'casa-venda' WHEN 'FURNITURE' THEN 'Apartamento-VENDA' ELSE 'apartamento-locacao' END || '-nation-' || c_nationkey || '/id-' || c_custkey"""
MAPS_CTE = f"""links AS (SELECT c_nationkey, {LINK_SQL} AS url FROM customer)"""


def sitemaps(spark, sf_dir):
    seg = F.col("c_mktsegment")
    kind = F.when(seg == "BUILDING", "apartamento-venda").when(seg == "MACHINERY", "apartamento-aluguel").when(
        seg == "HOUSEHOLD", "casa-venda").when(seg == "FURNITURE", "Apartamento-VENDA").otherwise("apartamento-locacao")
    link = F.concat_ws("", F.lit("https://x.example/"), kind, F.lit("-nation-"), "c_nationkey", F.lit("/id-"), "c_custkey")
    entry = F.concat(F.lit("<url><loc>"), link, F.lit("</loc></url>"))
    # One small document per customer and its twin: sitemaps repeat links.
    return table(spark, sf_dir, "customer").select("c_nationkey", F.concat(F.lit("<urlset>"), entry, entry, F.lit("</urlset>")).alias("xml"))


@query("sitemap_links", f"WITH {MAPS_CTE} SELECT url FROM links UNION ALL SELECT url FROM links")
def sitemap_links(spark, sf_dir):
    return markup.sitemap_links(sitemaps(spark, sf_dir), "xml")


@query("sitemap_shards", """SELECT 'https://x.example/sitemap-' || CASE WHEN c_nationkey < 10 THEN 'venda' ELSE 'aluguel' END || '-imoveis-' || c_custkey || '.xml' AS url
  FROM customer WHERE c_nationkey < 10""")
def sitemap_shards(spark, sf_dir):
    deal = F.when(F.col("c_nationkey") < 10, "venda").otherwise("aluguel")
    loc = F.concat_ws("", F.lit("<loc>https://x.example/sitemap-"), deal, F.lit("-imoveis-"), "c_custkey", F.lit(".xml</loc>"))
    index = table(spark, sf_dir, "customer").select(loc.alias("xml"))
    return markup.sitemap_shards(index, "xml", ["venda"])


@query("link_scope_filter", f"""WITH {MAPS_CTE} SELECT url, contains(lower(url), 'nation-1') AND contains(lower(url), 'apartamento')
   AND contains(lower(url), 'venda') AND NOT contains(lower(url), 'aluguel') AND NOT contains(lower(url), 'locacao') AS venda,
   contains(lower(url), 'nation-1') AND contains(lower(url), 'apartamento') AND (contains(lower(url), 'aluguel') OR contains(lower(url), 'locacao')) AS aluguel,
   contains(lower(url), 'nation-1') AND contains(lower(url), 'apartamento') AS ambos FROM links UNION ALL
   SELECT url, false, false, false FROM pages""")
def link_scope_filter(spark, sf_dir):
    links = markup.sitemap_links(sitemaps(spark, sf_dir), "xml").distinct()
    urls = links.unionByName(spread_table(spark, sf_dir, "pages").select("url"))
    return urls.select("url", *[
        filters.link_in_scope("url", "nation-1", "apartamento", d).alias(d) for d in ("venda", "aluguel", "ambos")
    ])


@query("plan_crawl", f"""WITH {MAPS_CTE} SELECT DISTINCT url FROM links WHERE contains(lower(url), 'nation-1') AND contains(lower(url), 'apartamento')
   AND contains(lower(url), 'venda') AND NOT contains(lower(url), 'aluguel') AND NOT contains(lower(url), 'locacao')
   AND regexp_extract(url, 'id-(.*)$', 1) NOT IN (SELECT o_custkey::VARCHAR FROM orders WHERE o_orderpriority = '5-LOW')""")
def plan_crawl(spark, sf_dir):
    maps = sitemaps(spark, sf_dir)
    done = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "5-LOW").select(F.col("o_custkey").cast("string").alias("id"))
    links = markup.sitemap_links(maps, "xml").distinct().withColumn("id", F.regexp_extract("url", "id-(.*)$", 1))
    seen = links.join(done.distinct(), "id", "left_semi").select("url")
    return pipelines.plan_crawl(maps, seen, "xml", "nation-1", "apartamento")[0]


@query("plan_crawl_first", f"""WITH {MAPS_CTE} SELECT DISTINCT url FROM links WHERE contains(lower(url), 'nation-1') AND contains(lower(url), 'apartamento')
   AND contains(lower(url), 'venda') AND NOT contains(lower(url), 'aluguel') AND NOT contains(lower(url), 'locacao') ORDER BY url LIMIT 7""")
def plan_crawl_first(spark, sf_dir):
    """The user's own limit: the first links in URL order."""
    none = spark.createDataFrame([], "url string")
    return pipelines.plan_crawl(sitemaps(spark, sf_dir), none, "xml", "nation-1", "apartamento", first=7)[0]


# --- pages -------------------------------------------------------------------------------------

VISIBLE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g')"


def _decoded(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"


@query("html_links", f"""SELECT page_id, href FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all({VISIBLE}, '<a\\b[^>]*?\\bhref="([^"]*)"', 1)) AS href FROM pages)""")
def html_links(spark, sf_dir):
    return markup.page_links(spread_table(spark, sf_dir, "pages"), "page_id")


@query("html_fields", f"""SELECT page_id, {D.strip(_decoded(r"regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)"))} AS titulo,
  {D.strip(_decoded(r"regexp_extract(html, '(?is)<footer>(.*?)</footer>', 1)"))} AS footer,
  {D.strip(_decoded(r"regexp_extract(html, '(?is)<div class=.ad.>(.*?)</div>', 1)"))} AS notice FROM pages""")
def html_fields(spark, sf_dir):
    pages = spread_table(spark, sf_dir, "pages").withColumn("s", markup.visible_source("html"))
    return pages.select(
        "page_id", markup.listing_title(F.col("s")).alias("titulo"),
        markup.inner_text(markup.first_element(F.col("s"), "footer")).alias("footer"),
        markup.inner_text(markup.first_element(F.col("s"), "div", markup.class_has("ad"))).alias("notice"),
    )


# A listing page around each part, in the markup the listing extractor reads.
def listing_pages(spark, sf_dir):
    part = spread_table(spark, sf_dir, "part")
    size, price = F.col("p_size").cast("string"), F.floor("p_retailprice").cast("bigint").cast("string")
    html = F.concat(
        F.lit("<html><!-- <h1>old</h1> --><body><h1> "), F.col("p_name"), F.lit(" &amp; co </h1><b>Venda<span class='x clampA'>R$ "),
        price, F.lit("</span></b><address>Endereço indisponível "), F.col("p_brand"),
        F.lit("</address><ul class='a listContent b'><li role='listitem'><p aria-label='quartos'>Quartos"), size,
        F.lit("</p><ul><li>inner</li></ul></li><li role='listitem'><p aria-label='area-total'><span>area-total</span> "), size,
        F.lit(" m²</p></li><li><p aria-label='x'>x 1</p></li></ul><div class='optionalItemsContainer'><div>x</div><span><b>Área comum</b><ul><li>Piscina&apos;s &#128512;</li><li>"),
        F.col("p_type"), F.lit("</li></ul></span></div><div><span><b>Links</b><ul><li>footer</li></ul></span></div><p aria-label='descrição'>"),
        F.col("p_name"), F.lit("<br> second&nbsp;&#x1F600;&NotEqualTilde; line </p></body></html>"),
    )
    url = F.concat(F.lit("https://x.example/id-"), F.col("p_partkey").cast("string"))
    return part.select(url.alias("url"), html.alias("html"))


@query("listing_page_fields", f"""SELECT 'https://x.example/id-' || p_partkey AS url_anuncio, p_name || ' & co' AS titulo, floor(p_retailprice)::BIGINT::VARCHAR AS preco_venda,
  p_brand AS endereco_completo, p_size::VARCHAR AS quartos, p_size::VARCHAR AS area_total, 'Piscina''s ' || chr(128512) || ', ' || p_type AS comum,
  p_name || chr(10) || 'second' || chr(160) || chr(128512) || chr(8770) || chr(824) || ' line' AS descricao_completa, 3 AS attrs FROM part""")
def listing_page_fields(spark, sf_dir):
    df = markup.listing_fields(listing_pages(spark, sf_dir))
    return df.select(
        "url_anuncio", "titulo", "preco_venda", "endereco_completo", F.col("attrs")["quartos"].alias("quartos"),
        F.col("attrs")["area_total"].alias("area_total"), F.col("attrs")["comodidades_area_comum"].alias("comum"),
        "descricao_completa", F.size("attrs").alias("attrs"),
    )


# Lists in lists, a heading without a list, quotes and signs inside values, comments that end at once, missing end tags.
def nested_pages(spark, sf_dir):
    part = spread_table(spark, sf_dir, "part")
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    html = F.concat(
        F.lit("<!--><h1 data-x=it's title='a>b'>"), name, F.lit("</h1><!--x--!><p>don't</p><ul class=\"x listContent\"><li role=listitem><p aria-label=quartos>"),
        size, F.lit("</p><li role='listitem' title=\"<li>\"><p aria-label='vagas'>vagas "), size,
        F.lit("</p><li><small>Andar</small><b>"), size, F.lit("</b><ul><li><small>x</small><b>y</b></ul></ul><div class='a optionalItemsContainer' hidden><span><b>Vazia</b><p>none"
              "</p></span><span><b>Área comum</b><ul><li>Sala "), size,
        F.lit("<ul><li>Varanda</li></ul></li><li title='</ul>'>Piscina</li></ul></span><div><span><b>Fora</b><ul><li>no</li></ul></span></div>"
              "<span><i><b>Lazer</b></i><ol><li>not in ul</li></ol><ul><li>Quadra<li>"), name,
        F.lit("</ul></span></div><div class='Description'>One <script>no</script><b>two</b>"),
    )
    return part.select("p_partkey", html.alias("html"))


@query("nested_page_sections", f"""SELECT 'p' || p_partkey AS url_anuncio, p_name AS titulo, p_size::VARCHAR AS quartos, p_size::VARCHAR AS vagas,
  'Sala ' || p_size || 'Varanda, Varanda, Piscina' AS comum, 'Quadra, ' || {D.strip('p_name')} AS lazer, 4 AS attrs, 'One' || chr(10) || 'two' AS descricao FROM part""")
def nested_page_sections(spark, sf_dir):
    pages = nested_pages(spark, sf_dir).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("url"), "html")
    attrs = F.col("attrs")
    return markup.listing_fields(pages).select(
        "url_anuncio", "titulo", attrs["quartos"].alias("quartos"), attrs["vagas"].alias("vagas"),
        attrs["comodidades_area_comum"].alias("comum"), attrs["comodidades_lazer"].alias("lazer"), F.size("attrs").alias("attrs"),
        F.col("descricao_completa").alias("descricao"),
    )


@query("nested_legacy_page", """SELECT p_partkey, 'Imagem não encontrada' AS imagem, p_name AS titulo, 'Andar=' || p_size AS pares,
  'Sala ' || p_size || 'Varanda, Varanda, Piscina' AS comum, 2 AS secoes FROM part""")
def nested_legacy_page(spark, sf_dir):
    df = markup.legacy_fields(nested_pages(spark, sf_dir))
    pairs = F.array_join(F.transform(F.map_entries("caracteristicas"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return df.select(
        "p_partkey", "imagem", "titulo", pairs.alias("pares"), F.col("secoes")["area_comum"].alias("comum"), F.size("secoes").alias("secoes")
    )


@query("description_text", f"""SELECT page_id, '{vocab.NO_DESCRIPTION}' AS described, {D.strip(_decoded(r"regexp_extract(html, '(?is)<footer>(.*?)</footer>', 1)"))} AS block FROM pages""")
def description_text(spark, sf_dir):
    pages = spread_table(spark, sf_dir, "pages").withColumn("s", markup.visible_source("html"))
    return pages.select(
        "page_id", markup.description(F.col("s")).alias("described"),
        markup.inner_text(markup.first_element(F.col("s"), "footer"), "\n").alias("block"),
    )


@query("legacy_page_fields", """SELECT p_partkey, 'img' || p_partkey || '.png' AS imagem, p_name AS titulo, p_size::VARCHAR AS area, p_type AS comum, 1 AS secoes FROM part""")
def legacy_page_fields(spark, sf_dir):
    part = spread_table(spark, sf_dir, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    html = F.concat(
        F.lit("<picture><img src='a.png'></picture><picture id='ssrImage'><img alt='' src='img"), key,
        F.lit(".png'></picture><h1>"), F.col("p_name"), F.lit("</h1><ul class='listContent'><li><small>Área útil</small><b>"), size,
        F.lit("</b></li></ul><div class='optionalItemsContainer'><span><b>Área comum</b><ul><li>"), F.col("p_type"),
        F.lit("</li></ul></span></div><footer><span><b>Links</b><ul><li>no</li></ul></span></footer>"),
    )
    df = markup.legacy_fields(part.select("p_partkey", html.alias("html")))
    return df.select(
        "p_partkey", "imagem", "titulo", F.col("caracteristicas")["Área útil"].alias("area"),
        F.col("secoes")["area_comum"].alias("comum"), F.size("secoes").alias("secoes"),
    )


# --- responses ---------------------------------------------------------------------------------

TERMS = ["piscina", "salão de festas", "k"]
# One result object per event, its values drawn from the event.
ITEM_SQL = """CASE event_type WHEN 'view' THEN '{"posicao_solar":" nascente ","distancia_praia_m":' || k || '.7,"piscina":"Sim","diferenciais_unicos":[" Vista Mar ","x",3]}'
  WHEN 'click' THEN '{"posicao_solar":"leste","distancia_praia_m":"120","tipo_unidade":"DUPLEX","salão_de_festas":true,"k":1}'
  WHEN 'error' THEN '{"status_construcao":"na planta","distancia_praia_m":-5,"salão de festas":"yes","piscina":"false"}'
  WHEN 'signup' THEN '[1,2' ELSE '{"tipo_unidade":null,"piscina":false,"k":"1"}' END"""


def _item():
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    return F.when(kind == "view", F.concat(
        F.lit('{"posicao_solar":" nascente ","distancia_praia_m":'), k,
        F.lit('.7,"piscina":"Sim","diferenciais_unicos":[" Vista Mar ","x",3]}'),
    )).when(kind == "click", '{"posicao_solar":"leste","distancia_praia_m":"120","tipo_unidade":"DUPLEX","salão_de_festas":true,"k":1}').when(
        kind == "error", '{"status_construcao":"na planta","distancia_praia_m":-5,"salão de festas":"yes","piscina":"false"}'
    ).when(kind == "signup", "[1,2").otherwise('{"tipo_unidade":null,"piscina":false,"k":"1"}')


@query("sanitize_response", f"""SELECT event_id, CASE event_type WHEN 'view' THEN 'Nascente' ELSE 'Nao informado' END AS posicao_solar,
  CASE WHEN event_type = 'view' THEN (props::JSON->>'k')::BIGINT END AS distancia_praia_m,
  CASE WHEN event_type = 'error' THEN 'Na planta' ELSE 'Nao informado' END AS status_construcao,
  CASE WHEN event_type = 'click' THEN 'Duplex' ELSE 'Apartamento tipo' END AS tipo_unidade,
  CASE WHEN event_type = 'view' THEN 'vista mar' ELSE '' END AS extras, event_type = 'view' AS piscina,
  event_type IN ('click', 'error') AS festas, event_type NOT IN ('view', 'click', 'error', 'signup') AS k FROM events""")
def sanitize_response(spark, sf_dir):
    df = spread_table(spark, sf_dir, "events").select("event_id", F.try_parse_json(_item()).alias("item"))
    record = df.select("event_id", extraction.sanitize(F.col("item"), TERMS).alias("r"))
    return record.select(
        "event_id", "r.posicao_solar", "r.distancia_praia_m", "r.status_construcao", "r.tipo_unidade",
        F.array_join("r.diferenciais_unicos", ",").alias("extras"), F.col("r.flags")["piscina"].alias("piscina"),
        F.col("r.flags")["salão_de_festas"].alias("festas"), F.col("r.flags")["k"].alias("k"),
    )


# Batches of three URLs per order: results that name their item, that do not, and that point outside.
def _answers(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    urls = F.array(*[F.concat(key, F.lit(f"-{i}")) for i in range(3)])
    status = F.col("o_orderstatus")
    response = F.when(status == "F", '{"resultados":[{"id_lote":2,"piscina":true},{"piscina":false},{"id_lote":0,"piscina":"sim"}]}').when(
        status == "O", '{"resultados":[{"id_lote":7,"piscina":true},{"id_lote":"1","piscina":true},{},{"piscina":true}]}'
    ).otherwise("not json")
    return table(spark, sf_dir, "orders").select(urls.alias("urls"), response.alias("response"))


@query("align_response", """SELECT o_orderkey || '-' || i AS url_anuncio,
  CASE o_orderstatus WHEN 'F' THEN i <> 1 WHEN 'O' THEN i < 2 ELSE false END AS piscina, o_orderstatus <> 'P' AS answered
  FROM orders, (VALUES (0), (1), (2)) t(i)""")
def align_response(spark, sf_dir):
    df = extraction.align_batches(_answers(spark, sf_dir), "urls", "response", ["piscina"])
    return df.select("url_anuncio", F.col("extraction.flags")["piscina"].alias("piscina"), "answered")


@query("batch_warnings", """SELECT count(*) AS batches, (3 * count(*))::BIGINT AS items, count(*) FILTER (WHERE o_orderstatus = 'P') AS empty_batches FROM orders""")
def batch_warnings(spark, sf_dir):
    return extraction.batch_warnings(_answers(spark, sf_dir), "urls", "response")


@query("term_ranking", """SELECT lower(trim(t)) AS term, count(*) AS cnt FROM (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS t FROM part)
  WHERE len(trim(t)) > 2 GROUP BY 1""")
def term_ranking(spark, sf_dir):
    words = spread_table(spark, sf_dir, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("term"))
    return extraction.term_ranking(words)


@query("vocabulary_terms", """SELECT lower(trim(t)) AS term FROM (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS t FROM part)
  WHERE len(trim(t)) > 2 GROUP BY 1 HAVING count(*) >= 5 ORDER BY count(*) DESC, 1 LIMIT 45""")
def vocabulary_terms(spark, sf_dir):
    terms = readers.vocabulary_terms(term_ranking(spark, sf_dir))
    return spark.createDataFrame([(t,) for t in terms], "term string")


@query("response_terms", """SELECT lower(trim(t)) AS term, count(*) AS cnt FROM (SELECT unnest([p_brand, p_name]) AS t FROM part) GROUP BY 1""")
def response_terms(spark, sf_dir):
    found = F.to_json(F.struct(F.array(F.struct(F.array("p_brand", F.concat(F.lit(" "), "p_name")).alias("atributos_encontrados"))).alias("resultados")))
    return extraction.term_ranking(extraction.response_terms(spread_table(spark, sf_dir, "part").select(found.alias("r")), "r"))


@query("discover_terms", f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array({D.plain('text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS t
    FROM documents WHERE len({D.strip('text')}) >= 10)
  SELECT term, count(*) AS cnt FROM (SELECT DISTINCT doc_id, unnest(list_concat(list_filter(t, lambda x: len(x) > 2),
      [t[i] || '_' || t[i + 1] FOR i IN range(1, len(t))])) AS term FROM w) GROUP BY 1""")
def discover_terms(spark, sf_dir):
    return extraction.discover_terms(spread_table(spark, sf_dir, "documents"), "text")


@query("resume_extractions", f"""WITH d AS (SELECT doc_id::VARCHAR AS url_anuncio, doc_id % 2 = 0 AS done,
    len({D.strip('text')}) >= 10 AND contains({D.plain('text')}, 'the and') AS the_and FROM documents)
  SELECT url_anuncio, the_and FROM d WHERE done UNION ALL
  SELECT url_anuncio, the_and FROM (SELECT * FROM d WHERE NOT done ORDER BY url_anuncio LIMIT 50)""")
def resume_extractions(spark, sf_dir):
    """Half of the texts are stored already; the job adds the first fifty of the rest."""
    return _resumed(spark, sf_dir, first=50)


def _resumed(spark, sf_dir, **how):
    docs = spread_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias(vocab.URL), F.col("text").alias(vocab.DESCRIPTION), "doc_id")
    stored = extraction.extract_attributes(docs.where("doc_id % 2 = 0").drop("doc_id"), ["the and"])
    out = pipelines.extraction_job(docs.drop("doc_id"), stored, ["the and"], **how)
    return out.select(vocab.URL, F.col("extraction.flags")["the_and"].alias("the_and"))


_THE_AND = f"""SELECT doc_id::VARCHAR AS url_anuncio, len({D.strip('text')}) >= 10 AND contains({D.plain('text')}, 'the and') AS the_and FROM documents"""


@query("resume_all_extractions", _THE_AND)
def resume_all_extractions(spark, sf_dir):
    """Half of the texts are stored already; the job adds all of the rest."""
    return _resumed(spark, sf_dir)


@query("reset_extractions", _THE_AND)
def reset_extractions(spark, sf_dir):
    """Half of the texts are stored already; the job starts over with all."""
    return _resumed(spark, sf_dir, reset=True)


# In the first run the extractor raises on some texts and answers others unreadably; the second run takes exactly those.
@query("failed_batches_stay_pending", f"""WITH d AS (SELECT doc_id::VARCHAR AS url_anuncio, len({D.strip('text')}) >= 10 AS usable, lower(text) AS t FROM documents)
  SELECT url_anuncio, usable AND contains(t, 'the and') AS the_and, CASE WHEN usable AND (contains(t, ' und ') OR contains(t, ' que ')) THEN 2 ELSE 1 END AS run FROM d""")
def failed_batches_stay_pending(spark, sf_dir):
    def flaky(texts, terms):
        if any(" und " in t.lower() for t in texts):
            raise RuntimeError("no answer")
        return "Service unavailable" if any(" que " in t.lower() for t in texts) else extraction.keyword_extractor(texts, terms)

    place = f"{ensure_checkpoint_dir(spark)}/extractions-{uuid4().hex}"
    docs = spread_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias(vocab.URL), F.col("text").alias(vocab.DESCRIPTION))
    for extractor in (flaky, extraction.keyword_extractor):
        extraction_store.extract_pending(docs, place, ["the and"], extractor, batch_size=1)
    return extraction_store.read(spark, place).select(vocab.URL, F.col("extraction.flags")["the_and"].alias("the_and"), F.col("run").cast("int").alias("run"))


@query("extract_attributes", f"""{WITH_LISTINGS} SELECT url_anuncio, usable AND contains(p, 'elevador') AS elevador,
  usable AND contains(p, 'aceita pet') AS aceita_pet, usable AND contains(p, 'varanda') AS varanda,
  CASE WHEN usable AND contains(p, '200 m da praia') THEN 200 END AS distancia_praia_m FROM (SELECT url_anuncio, {D.plain('descricao_completa')} AS p,
   len({D.strip("coalesce(descricao_completa, '')")}) >= 10 AND coalesce(descricao_completa, '') <> '{vocab.NO_DESCRIPTION}' AS usable FROM listings)""")
def extract_attributes(spark, sf_dir):
    out = extraction.extract_attributes(listings(spark, sf_dir), ["elevador", "aceita pet", "varanda"])
    flags = F.col("extraction.flags")
    return out.select(
        "url_anuncio", flags["elevador"].alias("elevador"), flags["aceita_pet"].alias("aceita_pet"),
        flags["varanda"].alias("varanda"), F.col("extraction.distancia_praia_m").alias("distancia_praia_m"),
    )


@query("extract_attributes_plugged", f"""SELECT cast(doc_id AS VARCHAR) AS url_anuncio, contains(lower(text), 'the and') AS the_and,
  contains(lower(text), 'que') AS que FROM documents WHERE len({D.strip('text')}) >= 10
  UNION ALL SELECT cast(doc_id AS VARCHAR), false, false FROM documents WHERE len({D.strip('text')}) < 10""")
def extract_attributes_plugged(spark, sf_dir):
    docs = spread_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url_anuncio"), "text")
    out = extraction.extract_attributes(docs, ["the and", "que"], extraction.keyword_extractor, "text")
    flags = F.col("extraction.flags")
    return out.select("url_anuncio", flags["the_and"].alias("the_and"), flags["que"].alias("que"))


@query("overlay_defaults", f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Sul' ELSE 'Nao informado' END AS posicao_solar,
  o_orderstatus = 'F' AS piscina FROM orders""")
def overlay_defaults(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("url_anuncio"), "o_orderkey", "o_orderstatus")
    said = F.try_parse_json(F.lit('{"posicao_solar":"sul","piscina":true}'))
    found = orders.where("o_orderstatus = 'F'").select("url_anuncio", extraction.sanitize(said, ["piscina"]).alias("extraction"))
    joined = extraction.with_extractions(orders, found, ["piscina"])
    return joined.select("o_orderkey", "extraction.posicao_solar", F.col("extraction.flags")["piscina"].alias("piscina"))


@query("guarded_flag_or", f"""{WITH_LISTINGS} SELECT row_seq, coalesce(contains(comodidades_imovel, 'Piscina'), false) OR p AS piscina,
  p AS suites FROM (SELECT *, st = 'F' AS p FROM listings)""")
def guarded_flag_or(spark, sf_dir):
    df = listings(spark, sf_dir)
    flags = F.create_map(F.lit("piscina"), F.col("st") == "F", F.lit("suites_flag"), F.col("st") == "F")
    scraped = F.col("_scraped")
    empty = F.array().cast("array<string>")
    out = df.withColumn("_scraped", F.coalesce(portal_b_flags("comodidades_imovel"), empty)).withColumn(
        "flags", extraction.or_scraped_flags(flags, scraped)
    )
    return out.select("row_seq", F.col("flags")["piscina"].alias("piscina"), F.col("flags")["suites_flag"].alias("suites"))


@query("build_master", f"""{WITH_LISTINGS} SELECT url_anuncio, preco_venda, coalesce(contains(comodidades_imovel, 'Piscina'), false) OR e AS piscina,
  coalesce(contains(comodidades_imovel, 'Piscina'), false) AS comodidade_piscina, 'Nao informado' AS posicao_solar
  FROM (SELECT *, st = 'O' AND contains({D.plain('descricao_completa')}, 'aceita pet') AS pet, false AS e FROM listings)""")
def build_master(spark, sf_dir):
    df = listings(spark, sf_dir).drop("mon", "q", "dom", "seg", "st", "pr", "place", "raw_price", "raw_area")
    terms = ["piscina", "aceita pet"]
    found = extraction.extract_attributes(df, terms)
    master = pipelines.build_master(df, found, terms, portal_b_flags("comodidades_imovel"))
    return master.select("url_anuncio", "preco_venda", "piscina", "comodidade_piscina", "posicao_solar")


