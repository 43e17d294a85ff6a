"""The record of the older two-page crawl: a result card joined with its listing page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.functions.numbers import card_features, card_price, card_suites
from hearthlake.functions.text import clean_address, contains_flag, split_address
from hearthlake.operators.linkage import legacy_records

# Fixed names of the record's flags: where a flag is looked for, and by which words.
FLAGS = {
    "elevador": ("area_comum", ["elevador"]),
    "piscina": ("area_comum", ["piscina"]),
    "academia": ("area_comum", ["academia"]),
    "portaria_24h": ("area_comum", ["portaria", "24h"]),
    "varanda": ("area_privativa", ["varanda"]),
    "quadra": ("area_comum", ["quadra"]),
}


def card_records(cards: DataFrame, kind: str) -> DataFrame:
    """The 25 fields of each card and its page, numbers that are missing as -1.

    `cards` has the card's texts (preco, condominio, iptu, titulo, rua, bairro), its labels (rotulos
    ARRAY<STRING>) and the page's parts as `legacy_fields` gives them (imagem, caracteristicas and
    secoes MAP<STRING,STRING>), with endereco and url_anuncio.
    """
    sections, cells = F.col("secoes"), F.col("caracteristicas")
    place = split_address("rua", "bairro")
    features = card_features("rotulos")

    def given(value: Column) -> Column:
        """Zero counts as not given, as in the card parsers."""
        return F.when(value != 0, value)

    def flag(section: str, words: list[str]) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | contains_flag(F.try_element_at(sections, F.lit(section)), word)
        return found

    details = F.to_json(F.struct("titulo", "imagem", "endereco", "caracteristicas", "secoes"))
    row = cards.select(
        card_price("preco").alias("preco"),
        card_price("condominio").alias("preco_condominio"),
        card_price("iptu").alias("preco_iptu"),
        F.coalesce("titulo", F.lit("Título não encontrado")).alias("titulo"),
        given(features["area"]).alias("tamanho"),
        given(features["quartos"]).alias("quartos"),
        given(features["banheiros"]).alias("banheiros"),
        card_suites(F.try_element_at(cells, F.lit("Suites"))).alias("suites"),
        given(features["garagens"]).alias("garagens"),
        *[flag(section, words).alias(name) for name, (section, words) in FLAGS.items()],
        clean_address(F.coalesce("endereco", F.lit(""))).alias("endereco_completo"),
        place["bairro"].alias("bairro"),
        place["rua"].alias("rua"),
        place["numero"].alias("numero"),
        F.coalesce("imagem", F.lit("Imagem não encontrada")).alias("url_imagem"),
        "url_anuncio",
        details.alias("detalhes_completos_json"),
    )
    return legacy_records(row, kind)
