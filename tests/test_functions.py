"""Parsers, normalisers and extractors on hand-made rows."""

from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.functions import arrays, numbers, text


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_price_and_number_parsers(spark):
    rows = [
        ("R$ 1.234.567", 1234567.0, 1234567.0, 1234567, None, 1),
        ("450.000,50", 450000.5, 450000.5, 450000, 450000.5, 450),
        ("1.23", 1.23, 1.23, 123, 1.23, 1),
        ("70.125", 70125.0, 70125.0, 70125, 70.125, 70),
        ("85,5 m²", None, 85.5, 85, 85.5, 85),
        ("58.045.100", 58045100.0, 58045100.0, 58045100, None, 58),
        ("-5", None, 5.0, 5, 5.0, 5),
        ("12d", None, 12.0, 12, 12.0, 12),
        ("Nao informado", None, None, None, None, 0),
        ("nan", None, None, None, None, 0),
        ("--", None, None, None, None, 0),
        ("", None, None, None, None, 0),
        (None, None, None, None, None, 0),
    ]
    got = values(
        spark, [(r[0],) for r in rows], "s string", "s", numbers.parse_price("s"), numbers.parse_number("s"),
        numbers.money_to_int("s"), numbers.first_decimal("s"), numbers.first_int("s"),
    )
    assert got == rows


def test_fees_and_areas(spark):
    got = values(spark, [(" Isento ", "0", "90"), ("R$ 1.200", "70,5", None), ("--", None, "x")],
                 "fee string, a string, b string", numbers.parse_fee("fee"), numbers.usable_area("a", "b"))
    assert got == [(0.0, 90.0), (1200.0, 70.5), (None, None)]


def test_card_parsers(spark):
    labels = ["70 m² área útil", "3 quartos", "2 banheiros", "1 garagens", "4 quartos", None]
    df = spark.createDataFrame([(labels,), ([],)], "l array<string>")
    got = [tuple(r) for r in df.select(*numbers.card_features("l").values()).collect()]
    assert got == [(70, 4, 2, 1), (-1, -1, -1, -1)]
    assert values(spark, [("R$ 1.500,00",), ("x",)], "s string", numbers.card_price("s")) == [(1500.0,), (-1.0,)]


def test_normalisers(spark):
    got = values(spark, [(" Água  Fria,Bessa-Norte ",), ("Salão (de) Festas 85 m²",), (None,)], "s string",
                 text.fold_text("s"), text.slug_text("s"), text.plain_text("s"))
    assert got == [
        ("agua fria bessa norte", "agua_friabessanorte", " agua fria,bessa-norte "),
        ("salao (de) festas 85 m²", "salao_de_festas_85_m²", "salao (de) festas 85 m²"),
        ("", "", ""),
    ]


def test_place_resolution(spark):
    rows = [("Rua X - Bessa Norte", None), ("Av. A", "João Pessoa"), ("Rua Y, Tambaú", "Jardim São Paulo"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r.p for r in text.with_place(df, "p", "a", "b").collect()] == ["bessa", "nao_informado", "jardim_sao_paulo", "nao_informado"]
    longest = text.with_place(df, "p", "a", "b", longest_match=True).collect()
    assert longest[0].p == "bessa_norte"


def test_place_and_id_from_url(spark):
    url = "https://x/apartamento-pb-joao-pessoa-alto-do-ceu-70m2-rs123/id-55"
    got = values(spark, [(url,), ("https://x/",)], "u string", text.place_from_url("u"), text.listing_id("u"))
    assert got[0] == ("Alto Do Ceu", "prop-55")
    assert got[1][0] is None and got[1][1].startswith("prop-")
    assert values(spark, [("d'agua 13x",)], "s string", text.title_case("s")) == [("D'Agua 13X",)]


def test_prose_fields(spark):
    rows = [
        ("3 quartos", 3, None, None, None), ("3 Dormitórios, sendo 1 suíte", 3, 1, None, None), ("2 Banheiros", None, None, 2, None),
        ("1 Vaga", None, None, None, 1), ("dois quartos", 2, None, None, None), ("três suítes", None, 3, None, None),
        ("2 sUíTeS", None, 2, None, None), ("03 quartos", 3, None, None, None), ("otimo apartamento", None, None, None, None),
        ("", None, None, None, None), (None, None, None, None, None), ("200 quartos", None, None, None, None),
        ("99 vagas", None, None, None, None), ("200 quartos ou 2 quartos", None, None, None, None),
    ]
    plain = text.plain_text("s")
    cols = [text.field_from_prose(plain, c) for c in ("quartos", "suites", "banheiros", "garagens")]
    got = values(spark, [(r[0],) for r in rows], "s string", "s", *cols)
    assert got == rows


def test_usable_description(spark):
    rows = [("Apartamento amplo e ventilado",), (vocab.NO_DESCRIPTION,), ("      ",), (None,)]
    got = values(spark, rows, "d string", text.usable_description("d"))
    assert got == [(True,), (False,), (False,), (False,)]


def test_clip_text_is_optional(spark):
    long = "a" * 3000
    got = values(spark, [(long,), ("x",)], "d string", F.length(text.clip_text("d")), F.length(text.clip_text("d", 1000)))
    assert got[0] == (3000, 1000) and got[1] == (24, 24)


def test_canonical_names(spark):
    names = ["piscina", "comodidade_piscina", "comodidade_piscina_privativa", "comodidade_salão_de_jogos", "salao_de_jogos",
             "comodidade_carpete", "supermercados", "varanda gourmet", "cerca elétrica", "carregador de carro elétrico", "tomada elétrica"]
    want = ["piscina", "piscina", "piscina", "salao_de_jogos", "salao_de_jogos", "carpete", "supermercados",
            "varanda_gourmet", "portaria_seguranca_24h", "carregador_carro_eletrico", "tomada_eletrica"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert [r.canonical for r in text.with_canonical_flag(df, "f").collect()] == want
    assert [text.canonical_flag_name(n) for n in names] == want


def test_split_address(spark):
    df = spark.createDataFrame([("Rua A, 12", "Centro, JP"), ("Praça B, 3", "Torre"), ("Endereço indisponível", "X"), (None, "Y")], "s string, p string")
    got = [tuple(r) for r in df.select(*text.split_address("s", "p").values()).collect()]
    assert got == [("Rua A", 12, "Centro"), ("Praça B, 3", -1, "Torre"), ("Não informado", -1, "X"), ("Não informado", -1, None)]


def test_json_and_overlay(spark):
    got = values(spark, [('["b","a"]',), ("[broken",), (None,)], "j string",
                 arrays.union_sorted(arrays.json_string_array("j"), F.array(F.lit("c"))))
    assert got == [(["a", "b", "c"],), (["c"],), (["c"],)]
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3}), ({"a": 1}, None)], "x map<string,int>, y map<string,int>")
    assert [r.m for r in df.select(arrays.overlay(F.col("x"), F.col("y")).alias("m")).collect()] == [{"a": 1, "b": 3}, {"a": 1}]
    flat = arrays.flat_for_text_sinks(spark.createDataFrame([(["x"], 1)], "l array<string>, n int")).first()
    assert tuple(flat) == ('["x"]', 1)
