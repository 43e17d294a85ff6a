"""What the selection of features writes: numbers only, and no row with the ranks of other columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlake.operators import correlation
from hearthlake.plans import pipelines


@pytest.fixture(scope="module")
def listings(spark):
    rng = np.random.default_rng(5)
    area, tax = rng.normal(90, 20, 300).round(2), rng.normal(5, 1, 300).round(3)
    rows = [
        (f"https://x.example/{i}", float(round(a * 3000 + t * 900, 2)), None if i % 11 == 0 else float(a), None if i % 7 == 0 else float(t), float(i % 4), i % 2)
        for i, (a, t) in enumerate(zip(area, tax, strict=True))
    ]
    rows += [("https://x.example/none", None, 50.0, 1.0, 1.0, 1), ("https://x.example/less", -3.0, 50.0, 1.0, 1.0, 1)]
    return spark.createDataFrame(rows, "url_anuncio string, preco_venda double, area_util double, iptu double, quartos double, com_piscina int")


def ranks_of(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def spearman(a, b):
    both = ~(np.isnan(a) | np.isnan(b))
    return np.corrcoef(ranks_of(a[both]), ranks_of(b[both]))[0, 1]


def test_ranks_of_many_values_never_travel_with_the_rows(listings, monkeypatch):
    kept = []
    cut = correlation.cut_lineage
    monkeypatch.setattr(correlation, "FEW_VALUES", 20)
    monkeypatch.setattr(correlation, "cut_lineage", lambda df: kept.append(df.columns) or cut(df))
    names = ["preco_venda", "area_util", "iptu", "quartos"]
    df = listings.where("preco_venda > 0")
    found = {(r.feature_a, r.feature_b): (r.n, r.r) for r in correlation.spearman_pairs(df, correlation.all_pairs(names)).collect()}
    assert not [c for columns in kept for c in columns if c.startswith(("c", "r_"))]
    # the column of few values, then each of the three others alone, as wide as its own patterns; counts and ranks are cut
    assert len(kept) == 2 * 4 and {len([c for c in columns if c.startswith("w")]) for columns in kept} == {2, 3}
    table = df.select(*names).toPandas().to_numpy(dtype=float)
    for (a, b), (n, r) in found.items():
        x, y = table[:, names.index(a)], table[:, names.index(b)]
        assert n == (~(np.isnan(x) | np.isnan(y))).sum() and r == pytest.approx(spearman(x, y), abs=1e-12)


def test_selection_keeps_numbers_only(listings, monkeypatch):
    kept = []
    cut = pipelines.cut_lineage
    monkeypatch.setattr(pipelines, "cut_lineage", lambda df: kept.append(df) or cut(df))
    whole = pipelines.select_features(listings)
    assert kept[0].columns == ["preco_venda", "area_util", "iptu", "quartos", "com_piscina"] and kept[0].count() == 300
    assert {r.feature for r in whole.ranking.collect()} == {"area_util", "iptu", "quartos", "com_piscina"}
    told = {r.feature: r for r in whole.ranking.collect()}
    m2 = listings.where("preco_venda > 0").agg(F.corr("quartos", F.col("preco_venda") / F.col("area_util"))).first()[0]
    assert told["quartos"].pearson_preco_m2 == pytest.approx(m2, abs=1e-9)
