"""Ranks, joins, linkage, amenities, enrichment, correlation and extraction on small frames."""

import json
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.operators import amenities, correlation, enrichment, extraction, filters, joins, linkage, ranks, repair
from hearthlake.plans import pipelines


def test_ranks_match_brute_force(spark):
    rows = [(g, float(v)) for g in "ab" for v in [0, -1, 5, 5, 5, 1e9, 1e-12, -3e4, 2.5, 2.5, 1e300, -1e300][: 12 if g == "a" else 7]]
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    pdf["rank"] = pdf.groupby("g").v.rank()
    want = pdf.drop_duplicates(["g", "v"]).sort_values(["g", "v"])[["g", "v", "rank"]].values.tolist()
    df = spark.createDataFrame(rows, "g string, v double")
    got = ranks.average_ranks(df, ["g"], "v").orderBy("g", "v").select("g", "v", "avg_rank").collect()
    assert [list(r) for r in got] == want
    medians = {r.g: r.median for r in ranks.exact_medians(df, ["g"], "v").collect()}
    assert medians == {g: statistics.median([v for h, v in rows if h == g]) for g in "ab"}


def test_bracketed_medians_are_exact(spark):
    for n in (1, 2, 3, 4, 5, 1000, 1001):
        pdf = pd.DataFrame({"x": [float((i * 7919) % 997) for i in range(n)], "y": [None if i % 3 else float(i) for i in range(n)], "z": [1.0] * n})
        df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf.values.tolist()], "x double, y double, z double")
        assert ranks.bracketed_medians(df, ["x", "y", "z"]) == pdf.median().to_dict()
    empty = spark.createDataFrame([(None,)], "x double")
    assert ranks.bracketed_medians(empty, ["x"]) == {"x": None}


def test_one_value_may_hold_most_rows(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 < 7, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    assert ranks.exact_medians(df, [], "v").first().median == df.toPandas().v.median()


def test_row_numbers_slices_and_batches(spark):
    urls = [(f"u{i:03d}",) for i in range(101)]
    df = spark.createDataFrame(urls, "url string").repartition(7)
    slices = [sorted(r.url for r in ranks.exact_slice(df, ["url"], i, 3).collect()) for i in range(3)]
    names = sorted(u for u, in urls)
    assert slices == [names[i::3] for i in range(3)]
    got = ranks.batches(df, ["url"], 6).orderBy("url").select("batch_no", "item_no").collect()
    assert [tuple(r) for r in got] == [(i // 6, i % 6) for i in range(101)]


def test_row_numbers_sort_keys_only(spark):
    rows = [(i * 7 % 50 if i else None, f"k{i % 3}", "wide" * i) for i in range(50)]
    df = spark.createDataFrame(rows, "a int, b string, rest string").repartition(5)
    got = {(r.a, r.b): r.row_seq for r in ranks.row_numbers(df, ["a", "b"]).collect()}
    order = sorted(((a, b) for a, b, _ in rows), key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    assert got == {k: i for i, k in enumerate(order)}
    assert [f.name for f in ranks.row_numbers(df, ["a", "b"]).schema] == ["a", "b", "rest", "row_seq"]
    twice = df.unionByName(df)
    assert sorted(r.row_seq for r in ranks.row_numbers(twice, ["a", "b"]).collect()) == list(range(100))


def test_first_wins_is_idempotent(spark):
    rows = [("a", 0, 1, "x"), ("a", 1, 0, "y"), (None, 0, 2, "z"), ("", 0, 3, "w"), ("b", 1, 5, "p"), ("b", 1, 4, "q")]
    df = spark.createDataFrame(rows, "url string, prio int, seq int, v string")
    once = linkage.first_wins(df, "url", ["prio", "seq"])
    assert sorted((r.url, r.v) for r in once.collect()) == [("a", "x"), ("b", "q")]
    assert sorted(map(str, linkage.first_wins(once, "url", ["prio", "seq"]).collect())) == sorted(map(str, once.collect()))


def test_unit_key_and_signature(spark):
    df = spark.createDataFrame(
        [("u1", "bessa", 450050.0, 70.5, 3.9), ("u2", "bessa", 449990.0, 70.0, 3.0), ("u3", "bessa", 9000.0, 70.0, 3.0), (None, "bessa", None, 70.0, 3.0)],
        f"{vocab.URL} string, bairro_norm string, preco_norm double, area_norm double, quartos_norm double",
    )
    keys = [r[0] for r in df.select(linkage.unit_key(surrogate=F.lit("7"))).collect()]
    assert keys == ["bessa|450000|70|3", "bessa|450000|70|3", "unica|u3", "unica|#7"]
    cols = "url_anuncio string, preco_venda double, area_util double, quartos double, banheiros double, garagens double"
    rows = [("a", 450000.0, 70.0, 3.0, 2.0, 1.0)] * 3 + [("b", 300000.0, 50.0, 2.0, 1.0, None), ("c", 450000.0, 90.0, 3.0, 2.0, 1.0), ("d", None, None, 3.0, 2.0, 1.0)]
    signatures = [r[0] for r in spark.createDataFrame(rows, cols).select(linkage.unit_signature()).collect()]
    assert len(set(signatures)) == 4 and signatures[5] == "d"


def test_survivorship(spark):
    rows = [
        ("k", "portal_a", 0, None, None, "Nao informado", None, '["b"]'),
        ("k", "portal_b", 1, 500.0, True, "Sul", 200, '["a","b"]'),
        ("k", "portal_b", 2, 600.0, None, "Norte", 300, "[broken"),
        ("s", "portal_b", 3, 1.0, None, "Nao informado", None, None),
    ]
    df = spark.createDataFrame(
        rows, "key string, origem_portal string, seq int, preco_venda double, piscina boolean, posicao_solar string, distancia_praia_m int, diferenciais_unicos string"
    )
    merged = {r.key: r for r in linkage.merge_units(df, "key", ["seq"], ["piscina"]).collect()}
    k, s = merged["k"], merged["s"]
    assert (k.origem_anuncio, k.listings, k.preco_venda, k.piscina, k.posicao_solar, k.distancia_praia_m) == ("ambos", 3, 500.0, True, "Sul", 200)
    assert (s.origem_anuncio, s.piscina, s.posicao_solar) == ("portal_b", False, "Nao informado")
    extras = linkage.unit_extras(df, "key")
    assert sorted((r.key, r.extra) for r in extras.collect()) == [("k", "a"), ("k", "b")]


def test_no_extra_of_a_large_unit_is_lost(spark):
    rows = [(f"u{i}", '["' + '","'.join(f"x{i}-{k}" for k in range(1300)) + '"]') for i in range(2)]
    cells = "'R$ 500.000' AS preco_venda, '80 m²' AS area_util, '3' AS quartos, 'Rua A, 1 - Bessa' AS endereco_completo, 'Bessa' AS bairro"
    parts = [spark.createDataFrame([r], "url_anuncio string, diferenciais_unicos string").selectExpr("*", cells.split(", '")[0], *["'" + c for c in cells.split(", '")[1:]], "1 AS row_seq") for r in rows]
    out = pipelines.deduplicate_portals(*parts)
    assert out.extras.groupBy("unit_key").count().collect()[0]["count"] == 2600 and out.units.count() == 1


def test_repair_and_numeric_columns(spark):
    df = spark.createDataFrame(
        [("u1", "True", "70"), ("u2", "2", "x"), ("u3", None, "80,5"), ("u4", "False", "1")], "url_anuncio string, suites string, area_util string"
    )
    raw = spark.createDataFrame([("u1", "1", "9", 0), ("u1", "3 suítes", "9", 1), ("u2", "5", "sem", 0)], "url_anuncio string, suites string, area_util string, seq int")
    fixed = {r.url_anuncio: (r.suites, r.area_util) for r in repair.repair_numerics(df, raw, ["seq"]).collect()}
    assert fixed == {"u1": ("3 suítes", "70"), "u2": ("2", None), "u3": (None, "80,5"), "u4": (None, "1")}
    counts = {r["column"]: (r.broken, r.repaired) for r in repair.repair_counts(df, raw, ["seq"]).collect()}
    assert counts == {"suites": (2, 1), "area_util": (1, 0)}
    typed = repair.to_numeric_columns(spark.createDataFrame([("1.200", 70.125, None, "2")], "condominio string, area_util double, garagens string, vagas string"))
    assert tuple(typed.select("condominio", "area_util", "garagens").first()) == (1200.0, 70.125, 2.0) and "vagas" not in typed.columns


def test_plausibility(spark):
    df = spark.createDataFrame([(450000.0, 70.0, 1.0), (470000000.0, 58045100.0, 155560.0)], "preco_venda double, area_util double, garagens double")
    assert [tuple(r) for r in filters.null_implausible(df).collect()] == [(450000.0, 70.0, 1.0), (None, None, None)]
    assert {r["column"]: r.out_of_range for r in filters.implausible_counts(df).collect()} == {"preco_venda": 1, "area_util": 1, "garagens": 1}


def test_boolean_columns_and_flag_folding(spark):
    df = spark.createDataFrame([(True, 0, 2.0), (False, 1, 1.0), (None, 0, 3.0)], "piscina boolean, andar int, quartos double")
    assert filters.boolean_columns(df) == ["piscina"]
    df = spark.createDataFrame([(True, None, "u", 2.0, True), (False, True, "v", 1.0, False), (False, None, "w", 1.0, None), (False, False, "x", 1.0, None)],
                               "piscina boolean, comodidade_piscina boolean, url_anuncio string, suites double, comodidade_suites boolean")
    folded = amenities.fold_flags(df, ["piscina", "comodidade_piscina", "comodidade_suites"])
    assert [r.com_piscina for r in folded.collect()] == [1, 1, 0, 0]
    assert [r.suites for r in folded.collect()] == [2.0, 1.0, 1.0, 1.0] and "com_suites" in folded.columns


def test_amenity_matrix_keeps_listings_without_amenities(spark):
    df = spark.createDataFrame([("u1", "Piscina, Piscina Infantil", "Academia"), ("u2", None, None), (None, "Piscina", None)],
                               "url_anuncio string, comodidades_area_privativa string, comodidades_area_comum string")
    matrix, frequency = pipelines.amenity_matrix(df, at_least=1)
    assert {r.amenity: r.listings for r in frequency.collect()} == {"piscina": 1, "academia": 1}
    assert sorted(tuple(r) for r in matrix.collect()) == [("u1", 1, 1), ("u2", 0, 0)]


def test_prose_fill_and_precision(spark):
    df = spark.createDataFrame([("3 quartos e 2 vagas", 2.0, None), ("4 quartos", None, None)], "descricao_completa string, quartos double, garagens double")
    filled = enrichment.fill_from_prose(df).collect()
    assert [r.quartos for r in filled] == [2.0, 4.0] and filled[0].garagens == 2.0
    assert {r.field: r.filled for r in enrichment.fill_counts(df).collect()} == {"quartos": 1, "garagens": 1}
    bare = spark.createDataFrame([(None,)], "quartos double")
    assert enrichment.fill_from_prose(bare).first().quartos is None and enrichment.fill_counts(bare).count() == 0
    known = spark.createDataFrame([("3 quartos", 3.0), ("2 quartos", 2.0), ("5 quartos", 4.0)], "descricao_completa string, quartos double")
    report = enrichment.extraction_precision(known).collect()
    assert [(r.campo, r.comparaveis, round(r.exato, 6), r.ate_1_de_diferenca) for r in report] == [("quartos", 3, 0.666667, 1.0)]


def test_correlations_match_pandas(spark):
    pdf = pd.DataFrame({
        "x": [1.0, 2, 2, 5, 9, None, 4, 4], "y": [2.0, 1, None, 7, 7, 3, 1, 0], "f": [0, 1, 0, 1, 1, 0, 1, 0], "g": [1, 1, 0, 1, 0, 0, 1, 0], "k": [3.0] * 8,
    })
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "x double, y double, f int, g int, k double")
    for method in ("pearson", "spearman"):
        want = pdf.corr(method=method)
        for r in correlation.correlation_pairs(df, correlation.all_pairs(list(pdf.columns)), method).collect():
            expected = want.loc[r.feature_a, r.feature_b]
            assert r.r is None if pd.isna(expected) else r.r == pytest.approx(expected, abs=1e-9), (method, r)


def test_pruning(spark):
    pairs = spark.createDataFrame([("area", "total", 100, 0.92), ("area", "piscina", 100, 0.11)], correlation.PAIR_SCHEMA)
    ranking = spark.createDataFrame([("area", 0.70), ("total", 0.63), ("piscina", 0.2)], "feature string, forca double")
    names, log = correlation.prune_redundant(pairs, ranking, ["total", "area", "piscina"])
    assert names == ["area", "piscina"] and [(r.mantida, r.descartada) for r in log.collect()] == [("area", "total")]
    names, log = correlation.prune_redundant(pairs.where("r < 0.5"), ranking, ["area", "piscina"])
    assert names == ["area", "piscina"] and log.count() == 0


def test_extraction_with_a_plugged_extractor(spark):
    df = spark.createDataFrame([("u1", "Apartamento com piscina grande"), ("u2", vocab.NO_DESCRIPTION), ("u3", None), ("u4", "Casa com quintal enorme")], "url_anuncio string, descricao_completa string")

    def extractor(texts, terms):
        return json.dumps({"resultados": [{"piscina": "piscina" in t, "tipo_unidade": "cobertura"} for t in texts]})

    out = {r.url_anuncio: r.extraction for r in extraction.extract_attributes(df, ["piscina"], extractor, batch_size=2).collect()}
    assert out["u1"].flags == {"piscina": True} and out["u1"].tipo_unidade == "Cobertura"
    assert out["u4"].flags == {"piscina": False}
    assert out["u2"].flags == {"piscina": False} and out["u3"].tipo_unidade == "Apartamento tipo"
    native = {r.url_anuncio: r.extraction.flags for r in extraction.extract_attributes(df, ["piscina"]).collect()}
    assert native == {"u1": {"piscina": True}, "u2": {"piscina": False}, "u3": {"piscina": False}, "u4": {"piscina": False}}


def test_build_master_guards_numeric_columns(spark):
    listings = spark.createDataFrame([("u1", "2", "Piscina, Suites"), ("u2", "1", None)], "url_anuncio string, suites string, comodidades_imovel string")
    found = extraction.extract_attributes(listings.withColumn("descricao_completa", F.lit("com academia moderna")), ["academia", "piscina"])
    master = pipelines.build_master(listings, found, ["academia", "piscina"], F.coalesce(amenities.portal_b_flags("comodidades_imovel"), F.array().cast("array<string>")))
    rows = {r.url_anuncio: r for r in master.collect()}
    assert (rows["u1"].suites, rows["u1"].piscina, rows["u1"].academia, rows["u1"].comodidade_suites) == ("2", True, True, True)
    assert (rows["u2"].suites, rows["u2"].piscina, rows["u2"].comodidade_suites) == ("1", False, False)


def test_the_last_extraction_of_a_url_counts(spark):
    listings = spark.createDataFrame([("u",)], "url_anuncio string")
    records = spark.createDataFrame([("u", 1, False), ("u", 2, True), ("u", 3, False)], "url_anuncio string, seq int, k boolean")
    made = records.withColumn("extraction", extraction.default_record(["k"]).withField("flags", F.create_map(F.lit("k"), F.col("k"))))
    got = extraction.with_extractions(listings, made.where("seq < 3"), ["k"], ["seq"]).first()
    assert got.extraction.flags["k"] is True
    assert extraction.with_extractions(listings, made, ["k"], ["seq"]).first().extraction.flags["k"] is False


def test_exact_crawl_plan_counts_its_own_links(spark):
    urls = "".join(f"<loc>https://x.example/city/casa-venda-{i}</loc>" for i in range(40))
    maps = spark.createDataFrame([(urls,)], "xml string")
    seen = spark.createDataFrame([], "url string")
    for shard in range(3):
        for exact in (True, False):
            links, counts = pipelines.plan_crawl(maps, seen, "xml", "city", "casa", shards=3, shard=shard, exact=exact)
            assert links.count() == counts.first().pending_here
    assert pipelines.plan_crawl(maps, seen, "xml", "city", "casa", first=5)[0].count() == 5


def test_spearman_ranks_distinct_values_not_rows(spark, monkeypatch):
    rows = [
        (float(i % 7), None if i % 5 == 0 else float((i * 7919) % 101), None if i % 3 == 0 else float(i * i % 13) - 0.0, float(i % 2), float(i % 3 == 0), 4.0)
        for i in range(400)
    ] + [(None, float("nan"), -0.0, 1.0, 0.0, 4.0), (3.0, 5.0, 0.0, 0.0, 1.0, 4.0)]
    names = ["a", "b", "c", "f", "g", "flat"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    pdf = pd.DataFrame(rows, columns=names)
    pairs = correlation.all_pairs(names)
    for few in (50_000, 20, 0):  # all tables of ranks broadcast, some, none
        monkeypatch.setattr(correlation, "FEW_VALUES", few)
        got = {(r.feature_a, r.feature_b): (r.n, r.r) for r in correlation.spearman_pairs(df, pairs).collect()}
        assert set(got) == set(pairs)
        for a, b in pairs:
            both = pdf[[a, b]].dropna()
            want = both[a].rank().corr(both[b].rank()) if both[a].nunique() > 1 and both[b].nunique() > 1 else None
            assert got[a, b] == (len(both), want if want is None else pytest.approx(want, abs=1e-12))
    base = df.select(F.col("a").alias("c0"), F.nanvl("b", F.lit(None)).alias("c1"))
    table = correlation._Ranks(base, ["a", "b"], [("a", "b")], []).values
    assert table.count() == pdf.a.nunique() + pdf.b.nunique()


def test_grouped_medians_rank_few_values(spark, monkeypatch):
    ranked = []
    monkeypatch.setattr(ranks, "cumulative_counts", lambda counts, *a, whole=ranks.cumulative_counts: ranked.append(counts.count()) or whole(counts, *a))
    df = spark.range(40_000).selectExpr("id % 2 AS g", "double((id * 7919) % 40009) AS v")
    got = {r.g: r.median for r in ranks.grouped_medians(df, ["g"], "v").collect()}
    pdf = df.toPandas()
    assert got == pdf.groupby("g").v.median().to_dict() and ranked[0] < 200


def test_keyword_records_make_the_text_plain_once(spark):
    df = spark.createDataFrame([("Aceita PET, a 200 m da praia",)], "t string")

    def steps(column):
        return df.select(column)._jdf.queryExecution().analyzed().toString().count("lower(")

    assert steps(extraction.keyword_record("t", ["piscina", "aceita pet"])) == steps(extraction.plain_text("t")) > 0
    r = df.select(extraction.keyword_record("t", ["piscina", "aceita pet"]).alias("r")).first().r
    assert r.distancia_praia_m == 200 and r.flags == {"piscina": False, "aceita_pet": True}


@pytest.mark.parametrize("shared", [50_000, 1])
def test_flags_are_folded_once_a_name(spark, monkeypatch, shared):
    monkeypatch.setattr(amenities, "SHARED_NAMES", shared)
    rows = [(1, "comodidade_Piscina_Infantil"), (1, "piscina"), (2, "piscina"), (2, None), (2, None), (3, "Supermercados"), (None, "piscina")]
    out = amenities.fold_flags_long(spark.createDataFrame(rows, "k int, flag string"), "k")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "contains" not in plan.lower()  # the rows only look their names up
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "piscina"), (2, "piscina"), (2, ""), (3, "supermercados"), (None, "piscina")], key=str)


def test_one_join_repairs_and_counts(spark):
    rows = [("u", "x", 1), ("v", "3", 2), ("w", "y", 3), (None, "z", 4)]
    df = spark.createDataFrame(rows, "url_anuncio string, quartos string, row_seq int")
    raw = spark.createDataFrame([("u", "2", 1), ("u", "4", 2), ("w", "n", 1)], "url_anuncio string, quartos string, row_seq int")
    fixed, counts = repair.repair_and_count(df, raw, ["row_seq"])
    assert sorted(map(tuple, fixed.collect()), key=str) == sorted(map(tuple, repair.repair_numerics(df, raw, ["row_seq"]).collect()), key=str)
    assert [tuple(r) for r in counts.collect()] == [tuple(r) for r in repair.repair_counts(df, raw, ["row_seq"]).collect()] == [("quartos", 3, 1)]
    assert "Join" not in fixed._jdf.queryExecution().optimizedPlan().toString()
