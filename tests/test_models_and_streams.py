"""Splits, preparation, models, sources and streams."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.catalog import registry
from hearthlake.models import estimators, preparation, scoring, search, splitting
from hearthlake.operators import extraction
from hearthlake.plans import pipelines
from hearthlake.sources import markup, readers, writers
from hearthlake.streaming import incremental


def test_fold_filling_is_the_greedy_rule():
    for sizes in ([(7, 1), (3, 5), (1, 40)], [(100, 1), (1, 13)], [(5, 3), (2, 1000), (1, 1)]):
        loads = [0] * 5
        for size, count in sizes:
            for _ in range(count):
                i = loads.index(min(loads))
                loads[i] += size
        runs = splitting._fill_folds(sizes, 5)
        got = [0] * 5
        for (size, count) in sizes:
            mine = sorted((first, f) for s, first, f in runs if s == size)
            ends = [first for first, _ in mine[1:]] + [count]
            for (first, f), end in zip(mine, ends):
                got[f] += (end - first) * size
        assert sorted(got) == sorted(loads)


def test_splits_keep_groups_together(spark):
    df = spark.range(2000).select((F.col("id") % 300).cast("string").alias("g"))
    marked = df.withColumn("is_test", splitting.in_test("g"))
    splitting.require_no_leak(marked, "g")
    assert 0.1 < marked.where("is_test").count() / 2000 < 0.3
    exact = splitting.exact_test_groups(df, "g")
    assert exact.where("is_test").count() == 60 and exact.count() == 300
    folds = splitting.balanced_folds(df, "g").groupBy("fold").agg(F.sum("size").alias("n")).collect()
    assert len(folds) == 5 and max(r.n for r in folds) - min(r.n for r in folds) <= 7
    with pytest.raises(RuntimeError):
        splitting.require_no_leak(df.withColumn("is_test", F.rand(1) < 0.5), "g")


def frame(spark, n=400):
    rng = np.random.default_rng(3)
    area = rng.uniform(30, 200, n)
    price = np.exp(10 + area / 100 + rng.normal(0, 0.1, n))
    rows = [(f"u{i}", float(p), None if i % 9 == 0 else float(a), float(i % 4), float(i % 3), float(i % 5), int(i % 2)) for i, (p, a) in enumerate(zip(price, area))]
    return spark.createDataFrame(rows, "url_anuncio string, preco_venda double, area_util double, quartos double, banheiros double, garagens double, com_piscina int")


def test_preparation_and_ridge(spark):
    df = frame(spark)
    data, features = preparation.modelling_frame(df)
    assert "preco_venda" not in features and "url_anuncio" not in features
    numeric, flags = preparation.column_roles(features)
    assert numeric == ["area_util", "quartos", "banheiros", "garagens"] and flags == ["com_piscina"]
    model = preparation.Preparation(numeric=numeric, flags=flags).fit(data)
    assert model.feature_names() == ["area_util", "quartos", "banheiros", "garagens", "missing_area_util", "com_piscina"]
    vectors = model.transform(data)
    rows = vectors.select("features", "label").collect()
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([r.label for r in rows])
    assert np.allclose(x[:, :5].mean(0), 0, atol=1e-9) and np.allclose(x[:, :5].std(0), 1, atol=1e-9)
    for alpha in (1.0, 50.0):
        fitted = estimators.Ridge(alpha=alpha).fit(vectors)
        centred = x - x.mean(0)
        want = np.linalg.solve(centred.T @ centred + alpha * np.eye(x.shape[1]), centred.T @ (y - y.mean()))
        assert np.allclose(fitted.coefficients.toArray(), want, atol=1e-4)


def test_training_report_and_grid(spark):
    matrix = frame(spark)
    report = {r.modelo: r for r in pipelines.train_models(matrix, ["baseline_mediana", "ridge"], folds=3).collect()}
    assert report["ridge"].cv_mae_log_media < report["baseline_mediana"].cv_mae_log_media
    assert all(math.isfinite(report["ridge"][c]) for c in ("mae_reais", "rmse_reais", "mae_log", "r2_log", "erro_percentual_mediano"))
    best, table = pipelines.tune_models(matrix, {
        "ridge": {"alpha": [0.1, 1.0, 1000.0]},
        "gradient_boosting": {"learning_rate": [0.1], "max_iter": [3], "max_leaf_nodes": [7, 31], "min_samples_leaf": [20], "l2_regularization": [0.0, 1.0]},
    }, folds=2)
    rows = table.collect()
    assert len(rows) == 3 + 4
    ridge = {r.alpha: r.mean_test_score for r in rows if r.modelo == "ridge"}
    assert ridge[1000.0] > ridge[1.0]
    assert search.default_score(table, "ridge") == ridge[1.0]
    assert math.isnan(search.default_score(table.where("max_leaf_nodes = 7"), "gradient_boosting"))
    assert best.count() == 2


def test_grid_contains_the_defaults():
    points = search.grid_points(vocab.BOOSTING_GRID)
    assert len(points) == 32
    default = {k: v for k, v in vocab.BOOSTING_DEFAULT.items() if k != "max_iter"}
    assert any(all(p[k] == v for k, v in default.items()) for p in points)
    assert 1.0 in vocab.RIDGE_ALPHAS


def test_metrics(spark):
    y, p = [1.0, 2.0, 3.0, 4.0], [1.1, 1.9, 3.2, 3.7]
    df = spark.createDataFrame(list(zip(y, p)), "label double, prediction double")
    got = scoring.regression_metrics(df).first()
    real, said = np.exp(y), np.exp(p)
    assert got.mae_reais == pytest.approx(np.abs(real - said).mean())
    assert got.rmse_reais == pytest.approx(np.sqrt(((real - said) ** 2).mean()))
    assert got.r2_log == pytest.approx(1 - sum((a - b) ** 2 for a, b in zip(y, p)) / (np.var(y) * 4))
    assert got.erro_percentual_mediano == pytest.approx(np.median(np.abs(said - real) / real) * 100)


def test_readers_tolerate_missing_and_broken_files(spark, tmp_path):
    good, bad = tmp_path / "x.json", tmp_path / "x.parte1.json"
    good.write_text(json.dumps([{"url_anuncio": "a", "titulo": "first"}, {"url_anuncio": "b", "titulo": "b"}]))
    bad.write_text("[{")
    (tmp_path / "x.parte2.json").write_text(json.dumps([{"url_anuncio": "a", "titulo": "late"}, {"url_anuncio": "c", "titulo": "c"}]))
    assert readers.read_listings(spark, str(tmp_path / "none.json")).count() == 0
    parts = readers.read_parts(spark, str(good), str(tmp_path / "x.parte*.json"))
    merged, new = pipelines.merge_parts(parts, readers.PART_ORDER)
    assert {r.url_anuncio: r.titulo for r in merged.collect()} == {"a": "first", "b": "b", "c": "c"}
    assert sorted((r.records, r.new) for r in new.collect()) == [(2, 1), (2, 2)]


def test_csv_round_trip_and_ranking_contract(spark, tmp_path):
    df = spark.createDataFrame([("u", 'line 1\nline "2"', ["x", "y"])], "url string, d string, l array<string>")
    writers.write_csv(df, str(tmp_path / "csv"))
    back = readers.read_csv(spark, str(tmp_path / "csv"), df.select("url", "d", F.lit("").alias("l")).schema).first()
    assert tuple(back) == ("u", 'line 1\nline "2"', '["x","y"]')
    (tmp_path / "rank.json").write_text(json.dumps({"ranking_frequencia": {"piscina": 120, "academia": 90, "tv": 80, "raro": 4}}))
    ranking = readers.read_term_ranking(spark, str(tmp_path / "rank.json"))
    assert readers.vocabulary_terms(ranking, min_count=5) == ["piscina", "academia"]
    assert len(readers.vocabulary_terms(None)) == 45


def test_portal_folders(spark, tmp_path):
    rows = [("a", "x", "portal_a"), ("b", "y", "portal_b")]
    df = spark.createDataFrame(rows, "url_anuncio string, titulo string, portal string")
    writers.write_parquet(df, str(tmp_path / "t"), ["portal"])
    schema = df.select("url_anuncio", "titulo").schema
    got = readers.read_portal(spark, str(tmp_path / "t"), "portal_b", schema).collect()
    assert [(r.url_anuncio, r.portal) for r in got] == [("b", "portal_b")]


def test_listing_page(spark):
    html = """<h1> Apto &amp; Cia </h1><!-- <h1>no</h1> --><b><i></i><span class="a clampX">R$ 450.000</span></b>
    <address>Endereço indisponível Bessa, João Pessoa</address>
    <ul class="x listContent"><li role="listitem"><p aria-label="quartos">quartos 3</p></li>
    <li role="listitem"><p aria-label="area-util">70 m²</p></li></ul>
    <div class="optionalItemsContainer"><span><b>Área comum</b><ul><li>Piscina</li><li>Sal&atilde;o</li></ul></span></div>
    <p aria-label="descrição">Linha 1<br/> Linha 2 </p>"""
    df = spark.createDataFrame([("u", html), ("v", "<p>nothing</p>")], "url string, html string")
    one, none = markup.listing_fields(df).orderBy("url_anuncio").collect()
    assert (one.titulo, one.preco_venda, one.endereco_completo) == ("Apto & Cia", "450.000", "Bessa, João Pessoa")
    assert one.attrs == {"quartos": "3", "area_util": "70", "comodidades_area_comum": "Piscina, Salão"}
    assert one.descricao_completa == "Linha 1\nLinha 2"
    assert (none.titulo, none.attrs, none.descricao_completa) == (None, {}, vocab.NO_DESCRIPTION)


def test_stream_ingest_and_extract_resume(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([{"url_anuncio": "a", "descricao_completa": "com piscina aquecida"}, {"url_anuncio": "a"}, {"url_anuncio": None}]))
    target, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    stream = lambda: incremental.listing_stream(spark, str(folder))
    incremental.ingest(stream(), target, mark).awaitTermination()
    (folder / "b.json").write_text(json.dumps([{"url_anuncio": "a"}, {"url_anuncio": "b", "descricao_completa": "sem nada por aqui"}]))
    incremental.ingest(stream(), target, mark).awaitTermination()
    assert sorted(r.url_anuncio for r in spark.read.parquet(target).collect()) == ["a", "b"]

    out, mark2 = str(tmp_path / "ex"), str(tmp_path / "mark2")
    incremental.extract_stream(stream(), out, mark2, ["piscina"]).awaitTermination()
    (folder / "c.json").write_text(json.dumps([{"url_anuncio": "b"}, {"url_anuncio": "c"}]))
    incremental.extract_stream(stream(), out, mark2, ["piscina"], extraction.keyword_extractor).awaitTermination()
    rows = spark.read.parquet(out).select("url_anuncio", F.col("extraction.flags")["piscina"].alias("p")).collect()
    assert sorted(tuple(r) for r in rows) == [("a", True), ("b", False), ("c", False)]


def test_a_saved_pipeline_scores_alike(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from hearthlake.models import estimators, preparation

    rows = [(float(i), None if i % 4 == 0 else float(i % 7), i % 2, 2.0 + 0.1 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, f int, label double")
    for last in (estimators.Ridge(alpha=1.0), estimators.MedianBaseline()):
        fitted = Pipeline(stages=[preparation.Preparation(numeric=["a", "b"], flags=["f"]), last]).fit(df)
        folder = str(tmp_path / type(last).__name__)
        fitted.write().save(folder)
        again = PipelineModel.load(folder)
        assert again.stages[0].feature_names() == ["a", "b", "missing_b", "f"]
        got, want = (m.transform(df).select("prediction").collect() for m in (again, fitted))
        assert got == want


def test_registered_resume_covers_all_pending_rows_and_reset(spark, tmp_path):
    registry.load()
    texts = [(i, f"a long text with {'the and' if i % 3 else 'nothing'} in it") for i in range(300)] + [(300, None), (301, "short")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((str(i), bool(t and "the and" in t)) for i, t in texts)
    for name in ("resume_all_extractions", "reset_extractions"):
        rows = registry.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted((r.url_anuncio, r.the_and) for r in rows) == want


def test_fold_fits_equal_fits_on_the_rows_outside(spark):
    from hearthlake.models import estimators, preparation, search
    from hearthlake.operators import ranks

    rng = np.random.default_rng(5)
    rows = [
        (float(x) if i % 5 else None, 3.0 if i % 4 else float(i), None if i % 3 else 7.0, i % 2, float(2 + 0.01 * x + (i % 4)), i % 3 if i % 11 else 1)
        for i, x in enumerate(rng.normal(50, 20, 301))
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, f int, label double, fold int").persist()
    columns = ["a", "b", "c"]
    stage = preparation.Preparation(numeric=columns, flags=["f"])
    told, models = ranks.fold_medians(df, columns, "fold", 3), stage.fit_folds(df, "fold", 3)
    baselines = estimators.MedianBaseline().fit_folds(df.withColumn("label", F.col("a")).where("a > 0"), "fold", 3)
    for k, parts in enumerate([df.where(F.col("fold") != k) for k in range(3)] + [df]):
        assert told[k] == ranks.bracketed_medians(parts, columns)
        assert np.allclose(models[k].getOrDefault("scales"), stage.fit(parts).getOrDefault("scales"), rtol=1e-12)
        assert baselines[k].getOrDefault("value") == np.median([r.a for r in parts.where("a > 0").select("a").collect()])
    assert ranks.fold_medians(df.where("a is null"), ["a"], "fold", 3) == [{"a": None}] * 4

    fitted, table = search.search(df, columns, ["f"], "ridge", {"alpha": [0.1, 100.0]}, folds=3)
    got = {r.alpha: (r.mean_test_score, r.std_test_score) for r in table.collect()}
    for alpha in (100.0,):
        scores = []
        for k in range(3):
            rest, held = df.where(F.col("fold") != k), df.where(F.col("fold") == k)
            prepared = stage.fit(rest)
            model = estimators.Ridge(alpha=alpha).fit(prepared.transform(rest))
            scores.append(model.transform(prepared.transform(held)).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0])
        assert got[alpha] == pytest.approx((np.mean(scores), np.std(scores)), rel=1e-7)
    assert fitted.stages[-1].numFeatures == 6


def test_all_folds_are_prepared_in_the_passes_of_one(spark, monkeypatch):
    from hearthlake.models import preparation

    monkeypatch.setattr(preparation.Preparation, "_fit", lambda *_: pytest.fail("a fold was prepared on its own"))
    matrix = frame(spark, 200)
    assert pipelines.train_models(matrix, ["baseline_mediana"], folds=3).count() == 1
    assert pipelines.tune_models(matrix, {"ridge": {"alpha": [1.0]}}, folds=2)[1].count() == 1
