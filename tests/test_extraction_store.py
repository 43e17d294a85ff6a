"""Failed batches stay pending, and the store only grows."""

import pytest
from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.operators import extraction
from hearthlake.sources import extraction_store as store


def extractors():
    """Functions made here travel to the workers by value."""
    def good(texts, terms):
        import json

        return json.dumps({"resultados": [{"id_lote": i, "piscina": "piscina" in t} for i, t in enumerate(texts)]})

    def flaky(texts, terms):
        if any("raise" in t for t in texts):
            raise ValueError("no answer today")
        if any("garbled" in t for t in texts):
            return "Service unavailable"
        return good(texts, terms)

    return good, flaky


@pytest.mark.parametrize(("answer", "want"), [
    ('{"resultados": [{"a": 1}]}', True), ('{"resultados": []}', True), ("{}", True), ('{"resultados": [{}, 3]}', False), ('{"resultados": null}', False),
    ('{"resultados": "x"}', False), ('{"resultados": {"a": 1}}', False), ("[1]", False), ("3", False), ("no json", False), ("", False), (None, False),
])
def test_readable_answers(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "r string")
    assert df.select(extraction.readable(F.col("r"))).first()[0] is want


def listings(spark):
    texts = ["a flat com piscina", "please raise this one", "a garbled text here", "plain text of a flat", "short", None]
    return spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)] + [(None, "a text without url")], f"{vocab.URL} string, {vocab.DESCRIPTION} string")


def test_failed_batches_stay_pending(spark, tmp_path):
    place, df = str(tmp_path / "store"), listings(spark)
    good, flaky = extractors()
    store.extract_pending(df, place, ["piscina"], flaky, batch_size=1)
    first = {r[0]: (r.extraction.flags["piscina"], r.run) for r in store.read(spark, place).collect()}
    assert first == {"u0": (True, 1), "u3": (False, 1), "u4": (False, 1), "u5": (False, 1)}
    errors = {r[0]: r.error for r in store.failures(spark, place).collect()}
    assert errors == {"u1": "ValueError: no answer today", "u2": "unreadable answer"}
    assert sorted(r[0] for r in store.pending(df, place).collect()) == ["u1", "u2"]

    (tmp_path / "store" / "run-00000002-more-half").mkdir()  # a run that was ended half-way
    asked = spark.sparkContext.accumulator(0)

    def counted(texts, terms):
        asked.add(len(texts))
        return good(texts, terms)

    store.extract_pending(df, place, ["piscina"], counted, batch_size=1)
    assert asked.value == 2 and store.failures(spark, place).count() == 0
    again = {r[0]: (r.extraction.flags["piscina"], r.run) for r in store.read(spark, place).collect()}
    assert again == {**first, "u1": (False, 3), "u2": (False, 3)}
    store.extract_pending(df, place, ["piscina"], good, reset=True, first=2)
    assert sorted(r[0] for r in store.read(spark, place).collect()) == ["u0", "u1"]
    assert len(store.runs(spark, place)) == 1


def test_a_whole_batch_fails_together(spark):
    df, flaky = listings(spark).coalesce(1), extractors()[1]
    rows = {r[0]: (r.extraction is None, r.error) for r in extraction.attempt_extractions(df, ["piscina"], flaky, batch_size=10).collect()}
    assert {u for u, (missing, _) in rows.items() if missing} == {"u0", "u1", "u2", "u3"}
    assert rows["u5"] == (False, None) and extraction.extract_attributes(df, ["piscina"], flaky, batch_size=10).count() == 2
