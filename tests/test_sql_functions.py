"""SQL functions give what the column functions give."""

import pytest
from pyspark.sql import functions as F

from hearthlake.functions import sql

TEXTS = [
    "R$ 1.234.567,89", "450.000", " 70,5 m² ", "12", "isento", "-0", "", None, "São José, Água Fria", "Rua A, 12", "Avenida B, x", "3 quartos e duas suítes, 1 vaga, dois banheiros",
    "Endereço indisponível Bessa", "https://x.example/pb-joao-pessoa-jardim-oceania-70m2-rs450000/id-77", "comodidade_piscina_privativa", "it's a \\ \"quote\"",
    "Piscina, Salão de Festas , ,Vaga", '["b","a"]', "área útil 70 m²", "a text that is long enough to say something about it", "Descrição não encontrada.",
]


@pytest.fixture(scope="module")
def data(spark):
    sql.register(spark, prefix="hl_")
    return spark.createDataFrame([(i, t, TEXTS[(i * 7 + 3) % len(TEXTS)]) for i, t in enumerate(TEXTS)], "i int, s string, t string")


@pytest.mark.parametrize("name", sql.FUNCTIONS)
def test_function(spark, data, name):
    function = sql.FUNCTIONS[name]
    texts = iter(["s", "t"])
    source = {
        "string": lambda: next(texts), "double": lambda: f"cast(length({next(texts)}) as double)",
        "array<string>": lambda: f"split({next(texts)}, ',')",
    }
    arguments = [source[kind]() for kind in function.parameters.values()]
    data.createOrReplaceTempView("texts")
    got = spark.sql(f"SELECT i, hl_{name}({', '.join(arguments)}) AS r FROM texts").orderBy("i").collect()
    want = data.select("i", function.body(*[F.expr(a) for a in arguments]).alias("r")).orderBy("i").collect()
    assert got == want
    assert len({str(r.r) for r in got}) > 1  # the texts tell something about each


def test_calls_are_inlined(spark, data):
    data.createOrReplaceTempView("texts")
    plan = spark.sql("SELECT hl_parse_price(s) AS p FROM texts WHERE hl_first_int(t) > 1")._jdf.queryExecution().optimizedPlan().toString()
    assert "hl_" not in plan and "regexp_extract" in plan
