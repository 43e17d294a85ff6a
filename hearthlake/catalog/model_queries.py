"""Split, fold, metric, model and streaming queries."""

from __future__ import annotations

from uuid import uuid4

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.catalog import duck as D
from hearthlake.catalog.fixtures import FLAGS, NUMERIC, UNITS_CTE, table, units
from hearthlake.catalog.link_queries import _signature_sql
from hearthlake.catalog.registry import query
from hearthlake.models import estimators, preparation, scoring, search, splitting
from hearthlake.plans import pipelines
from hearthlake.session import cut_lineage, ensure_checkpoint_dir
from hearthlake.streaming import incremental

WITH_UNITS = D.with_ctes(UNITS_CTE)
HASH = D.md5_number("g")
TEST_LIMIT = int(vocab.TEST_SHARE * 2**32)
GROUPS_CTE = "grouped AS (SELECT o_orderkey, o_custkey::VARCHAR AS g FROM orders)"


def grouped(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("g"))


# --- splits ------------------------------------------------------------------------------------

@query("group_split", f"WITH {GROUPS_CTE} SELECT o_orderkey, g, {HASH} < {TEST_LIMIT} AS is_test FROM grouped")
def group_split(spark, sf_dir):
    return grouped(spark, sf_dir).withColumn("is_test", splitting.in_test("g"))


@query("group_folds", f"WITH {GROUPS_CTE} SELECT o_orderkey, ({HASH} % 5)::INT AS fold FROM grouped")
def group_folds(spark, sf_dir):
    return grouped(spark, sf_dir).select("o_orderkey", splitting.group_fold("g").alias("fold"))


@query("exact_group_split", f"""WITH {GROUPS_CTE}, d AS (SELECT DISTINCT g, {HASH} AS h FROM grouped)
  SELECT g, row_number() OVER (ORDER BY h, g) - 1 < ceil((SELECT count(*) FROM d) * 0.2) AS is_test FROM d""")
def exact_group_split(spark, sf_dir):
    return splitting.exact_test_groups(grouped(spark, sf_dir), "g")


@query("balanced_fold_loads", f"""WITH {GROUPS_CTE}, s AS (SELECT g, count(*) AS size FROM grouped GROUP BY g)
  SELECT sum(size)::BIGINT AS n_rows, count(*) AS n_groups, 5::BIGINT AS folds, true AS balanced FROM s""")
def balanced_fold_loads(spark, sf_dir):
    """`balanced`: the fullest and the emptiest fold differ by one group's size at most."""
    folds = splitting.balanced_folds(grouped(spark, sf_dir), "g").where(F.col("fold").isNotNull())
    loads = folds.groupBy("fold").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("groups"), F.max("size").alias("largest"))
    return loads.agg(
        F.sum("load").alias("n_rows"), F.sum("groups").alias("n_groups"), F.count(F.lit(1)).alias("folds"),
        (F.max("load") - F.min("load") <= F.max("largest")).alias("balanced"),
    )


@query("balanced_folds", f"""WITH {GROUPS_CTE} SELECT g, count(*) AS size, true AS placed FROM grouped GROUP BY g""")
def balanced_folds(spark, sf_dir):
    """Every group once, in one of the folds; `balanced_fold_loads` compares the loads."""
    folds = splitting.balanced_folds(grouped(spark, sf_dir), "g")
    return folds.select("g", "size", F.col("fold").between(0, 4).alias("placed"))


SIGNED_CTE = f"signed AS (SELECT *, {_signature_sql()} AS g FROM units WHERE preco_venda > 0)"


@query("split_summary", f"""{WITH_UNITS}, {SIGNED_CTE}, f AS (SELECT g, {HASH} < {TEST_LIMIT} AS t FROM signed)
  SELECT count(*) FILTER (WHERE NOT t) AS train_rows, count(*) FILTER (WHERE t) AS test_rows, count(DISTINCT g) AS groups,
  count(DISTINCT g) FILTER (WHERE t) AS test_groups, 0 AS leaked_groups FROM f""")
def split_summary(spark, sf_dir):
    matrix = units(spark, sf_dir).select("url_anuncio", "preco_venda", *NUMERIC, *FLAGS)
    frame, _ = preparation.modelling_frame(matrix)
    return splitting.split_summary(frame, "group_key")


@query("leak_check", """SELECT DISTINCT o_custkey::VARCHAR AS g FROM orders WHERE o_custkey IN
  (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')""")
def leak_check(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("g"), (F.col("o_orderstatus") == "F").alias("is_test")
    )
    return splitting.leaked_groups(rows, "g")


# --- metrics -----------------------------------------------------------------------------------

SCORED_CTE = """scored AS (SELECT l_returnflag AS model, ln(l_extendedprice) AS y, ln(l_quantity * 2000) AS p FROM lineitem)"""
METRICS_SQL = """round(avg(abs(exp(p) - exp(y))), 3) AS mae_reais, round(sqrt(avg((exp(p) - exp(y)) ** 2)), 3) AS rmse_reais,
  round(avg(abs(p - y)), 6) AS mae_log, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2_log,
  round(quantile_cont(abs(exp(p) - exp(y)) / exp(y), 0.5) * 100, 6) AS erro_percentual_mediano"""
DIGITS = {"mae_reais": 3, "rmse_reais": 3, "mae_log": 6, "r2_log": 6, "erro_percentual_mediano": 6}


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.ln("l_extendedprice").alias("label"),
        F.ln(F.col("l_quantity") * 2000).alias("prediction"),
    )


@query("regression_metrics", f"WITH {SCORED_CTE} SELECT {METRICS_SQL} FROM scored")
def regression_metrics(spark, sf_dir):
    out = scoring.regression_metrics(_scored(spark, sf_dir))
    return out.select(*[F.round(c, d).alias(c) for c, d in DIGITS.items()])


@query("regression_metrics_by_model", f"WITH {SCORED_CTE} SELECT model, {METRICS_SQL} FROM scored GROUP BY model")
def regression_metrics_by_model(spark, sf_dir):
    out = scoring.regression_metrics(_scored(spark, sf_dir), by=["model"])
    return out.select("model", *[F.round(c, d).alias(c) for c, d in DIGITS.items()])


@query("score_in_currency", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(exp(ln(l_extendedprice)), 4) AS preco_previsto FROM lineitem")
def score_in_currency(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.ln("l_extendedprice").alias("prediction"))
    return scoring.in_currency(li).drop("prediction").withColumn("preco_previsto", F.round("preco_previsto", 4))


@query("baseline_median", """SELECT round(quantile_cont(ln(o_totalprice), 0.5), 6) AS prediction, round(avg(abs(ln(o_totalprice) - (SELECT quantile_cont(ln(o_totalprice), 0.5) FROM orders))), 6) AS mae_log
  FROM orders""")
def baseline_median(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.ln("o_totalprice").alias("label"))
    scored = estimators.MedianBaseline().fit(df).transform(df)
    return scored.agg(
        F.round(F.max("prediction"), 6).alias("prediction"),
        F.round(F.avg(F.abs(F.col("label") - F.col("prediction"))), 6).alias("mae_log"),
    )


FOLD_SCORES = f"""f AS (SELECT o_orderstatus AS model, ({D.md5_number('o_custkey::VARCHAR')} % 5) AS fold, o_totalprice AS v FROM orders),
  s AS (SELECT model, fold, avg(v) AS mae_log FROM f GROUP BY ALL)"""


@query("fold_summary", f"""WITH {FOLD_SCORES} SELECT model, round(avg(mae_log), 4) AS cv_mae_log_media, round(stddev_pop(mae_log), 4) AS cv_mae_log_desvio
  FROM s GROUP BY model""")
def fold_summary(spark, sf_dir):
    scores = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderstatus").alias("model"), splitting.group_fold(F.col("o_custkey")).alias("fold")
    ).agg(F.avg("o_totalprice").alias("mae_log"))
    out = scoring.fold_summary(scores, by=["model"])
    return out.withColumns({c: F.round(c, 4) for c in ("cv_mae_log_media", "cv_mae_log_desvio")})


@query("score_by_parameter", f"WITH {FOLD_SCORES} SELECT fold::INT AS fold, round(avg(mae_log), 4) AS mean_score, count(*) AS runs FROM s GROUP BY fold")
def score_by_parameter(spark, sf_dir):
    scores = table(spark, sf_dir, "orders").groupBy(
        "o_orderstatus", splitting.group_fold(F.col("o_custkey")).alias("fold")
    ).agg(F.avg("o_totalprice").alias("mae_log"))
    return scoring.mean_by_parameter(scores, "fold").withColumn("mean_score", F.round("mean_score", 4))


# --- preparation and models --------------------------------------------------------------------

def _frame(spark, sf_dir):
    matrix = units(spark, sf_dir).select("url_anuncio", "preco_venda", *NUMERIC, *FLAGS)
    frame, features = preparation.modelling_frame(matrix)
    numeric, flags = preparation.column_roles(features)
    # Fitting passes over the rows several times: build them once.
    kept = frame.select(*features, "label", "group_key", "is_test", "fold")
    return cut_lineage(kept), numeric, flags


PREP_SQL = f"""{WITH_UNITS}, m AS (SELECT quantile_cont(condominio, 0.5) AS md FROM units),
  v AS (SELECT url_anuncio, coalesce(condominio, md) AS x, (condominio IS NULL)::INT::DOUBLE AS gap, com_piscina FROM units, m)"""


@query("preparation_stage", f"""{PREP_SQL} SELECT url_anuncio, round((x - (SELECT avg(x) FROM v)) / (SELECT stddev_pop(x) FROM v), 6) AS scaled,
  round((gap - (SELECT avg(gap) FROM v)) / (SELECT stddev_pop(gap) FROM v), 6) AS gap_scaled, com_piscina::DOUBLE AS flag FROM v""")
def preparation_stage(spark, sf_dir):
    df = units(spark, sf_dir).select("url_anuncio", "condominio", "com_piscina")
    out = preparation.Preparation(numeric=["condominio"], flags=["com_piscina"]).fit(df).transform(df)
    cells = vector_to_array("features")
    return out.select(
        "url_anuncio", F.round(cells[0], 6).alias("scaled"), F.round(cells[1], 6).alias("gap_scaled"), cells[2].alias("flag")
    )


RIDGE_SQL = """d AS (SELECT ln(l_extendedprice) AS y, l_quantity AS x FROM lineitem),
  c AS (SELECT avg(y) AS my, avg(x) AS mx, stddev_pop(x) AS sx, count(*) AS n FROM d),
  w AS (SELECT sum((x - mx) / sx * (y - my)) / (any_value(n) + 1.0) AS w FROM d, c)"""


@query("ridge_single", f"WITH {RIDGE_SQL} SELECT round(w, 6) AS weight, round(my, 6) AS intercept FROM w, c")
def ridge_single(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        F.ln("l_extendedprice").alias("label"), F.col("l_quantity").alias("area_util")
    )
    stages = [preparation.Preparation(numeric=["area_util"], flags=[]), estimators.Ridge(alpha=1.0)]
    fitted = Pipeline(stages=stages).fit(df).stages[-1]
    return spark.createDataFrame([(round(float(fitted.coefficients[0]), 6), round(float(fitted.intercept), 6))], "weight double, intercept double")


@query("ridge_fit")
def ridge_fit(spark, sf_dir):
    frame, numeric, flags = _frame(spark, sf_dir)
    stages = [preparation.Preparation(numeric=numeric, flags=flags), estimators.Ridge(alpha=1.0)]
    fitted = Pipeline(stages=stages).fit(frame.where(~F.col("is_test")))
    return scoring.regression_metrics(fitted.transform(frame.where("is_test")))


@query("ridge_facts", f"""{WITH_UNITS}, {SIGNED_CTE}, f AS (SELECT g, {HASH} < {TEST_LIMIT} AS t FROM signed)
  SELECT count(*) FILTER (WHERE NOT t) AS train_rows, count(*) FILTER (WHERE t) AS test_rows, true AS solved, true AS beats_baseline FROM f""")
def ridge_facts(spark, sf_dir):
    """What must hold of a ridge fit: X'r = alpha * w on the training rows, and a lower error than the median's."""
    frame, numeric, flags = _frame(spark, sf_dir)
    train, test = frame.where(~F.col("is_test")), frame.where("is_test")
    prepared = preparation.Preparation(numeric=numeric, flags=flags).fit(train)
    vectors, held = prepared.transform(train), prepared.transform(test)
    fitted = estimators.Ridge(alpha=1.0).fit(vectors)
    rest = fitted.transform(vectors).select((F.col("label") - F.col("prediction")).alias("r"), vector_to_array("features").alias("x"))
    cross = rest.select("r", F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x") * F.col("r")).alias("xr"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(fitted.coefficients)], "i int, w double")
    solved = cross.join(weights, "i").agg(F.max(F.abs(F.col("xr") - F.col("w")) / (F.col("norm") + 1)).alias("gap"))
    median = estimators.MedianBaseline().fit(train)
    errors = median.transform(fitted.transform(held).withColumnRenamed("prediction", "ridge")).agg(
        F.count(F.lit(1)).alias("test_rows"), F.avg(F.abs(F.col("label") - F.col("ridge"))).alias("ridge"),
        F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("baseline"),
    )
    a, b = solved.first(), errors.first()
    return spark.createDataFrame(
        [(train.count(), b.test_rows, a.gap < 1e-3, b.ridge < b.baseline)],
        "train_rows bigint, test_rows bigint, solved boolean, beats_baseline boolean",
    )


@query("gbt_fit")
def gbt_fit(spark, sf_dir):
    """The default settings, stopping early."""
    frame, numeric, flags = _frame(spark, sf_dir)
    frame = frame.withColumn("stop", estimators.early_stop_rows("group_key"))
    stages = [
        preparation.Preparation(numeric=numeric, flags=flags),
        estimators.boosting(**vocab.BOOSTING_DEFAULT, stop_on="stop"),
    ]
    fitted = Pipeline(stages=stages).fit(frame.where(~F.col("is_test")))
    return scoring.regression_metrics(fitted.transform(frame.where("is_test")))


@query("ridge_grid_search")
def ridge_grid_search(spark, sf_dir):
    frame, numeric, flags = _frame(spark, sf_dir)
    train = frame.where(~F.col("is_test"))
    _, results = search.search(train, numeric, flags, "ridge")
    return results.select("modelo", "alpha", "mean_test_score", "std_test_score")


@query("train_models")
def train_models(spark, sf_dir):
    matrix = units(spark, sf_dir).select("url_anuncio", "preco_venda", *NUMERIC, *FLAGS)
    return pipelines.train_models(matrix, ["baseline_mediana", "ridge", "gradient_boosting", "gradient_boosting_ajustado"])


@query("train_baseline", f"""{WITH_UNITS}, {SIGNED_CTE}, f AS (SELECT ln(preco_venda) AS y, {HASH} < {TEST_LIMIT} AS held, {HASH} % 5 AS fold FROM signed),
  m AS (SELECT k, quantile_cont(y, 0.5) AS m FROM f, range(5) ks(k) WHERE NOT held AND fold <> k GROUP BY k),
  s AS (SELECT k, avg(abs(y - m)) AS e FROM f JOIN m ON fold = k WHERE NOT held GROUP BY k),
  scored AS (SELECT y, (SELECT quantile_cont(y, 0.5) FROM f WHERE NOT held) AS p FROM f WHERE held)
  SELECT 'baseline_mediana' AS modelo, round((SELECT avg(e) FROM s), 6) AS cv_mae_log_media, round((SELECT stddev_pop(e) FROM s), 6) AS cv_mae_log_desvio, {METRICS_SQL}
  FROM scored""")
def train_baseline(spark, sf_dir):
    """The whole training report of a model that SQL can fit: folds by group, their scores, and the metrics on held-out groups."""
    matrix = units(spark, sf_dir).select("url_anuncio", "preco_venda", *NUMERIC, *FLAGS)
    report = pipelines.train_models(matrix, ["baseline_mediana"])
    digits = {"cv_mae_log_media": 6, "cv_mae_log_desvio": 6, **DIGITS}
    return report.select("modelo", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("staged_boosting_facts", f"""{WITH_UNITS}, {SIGNED_CTE}, f AS (SELECT {HASH} < {TEST_LIMIT} AS held FROM signed)
  SELECT count(*) FILTER (WHERE NOT held) AS train_rows, true AS patience_kept, true AS prefix_scores_alike, true AS beats_baseline, 32::BIGINT AS points,
    16::BIGINT AS fits FROM f""")
def staged_boosting_facts(spark, sf_dir):
    """What must hold of a boosted fit with patience, and how many fits the whole grid takes per fold."""
    frame, numeric, flags = _frame(spark, sf_dir)
    train = frame.where(~F.col("is_test"))
    vectors = preparation.Preparation(numeric=numeric, flags=flags).fit(train).transform(train).withColumn(
        "stop", estimators.early_stop_rows("group_key")
    ).select("features", "label", "stop")
    held = vectors.where("stop").persist()
    patience, most = 3, 12
    model = estimators.StagedBoosting(stepSize=0.3, maxIter=most, maxDepth=3, patience=patience, step=6, stopCol="stop").fit(vectors)
    errors = model.evaluateEachIteration(held, "squared")
    stopped = estimators.rounds_until_patience(errors, patience, 1e-7)
    half = estimators.first_rounds(model, 4)
    row = half.transform(held).agg(F.avg((F.col("label") - F.col("prediction")) ** 2).alias("mse"), F.var_pop("label").alias("spread")).first()
    points = search.grid_points(vocab.BOOSTING_GRID)
    cores = {tuple(v for k, v in p.items() if k not in ("l2_regularization", "max_iter")) for p in points}
    facts = (
        train.count(), len(errors) == (stopped or most), abs(row.mse - errors[3]) <= 1e-9 * row.mse, min(errors) < row.spread, len(points), len(cores),
    )
    return spark.createDataFrame(
        [facts], "train_rows bigint, patience_kept boolean, prefix_scores_alike boolean, beats_baseline boolean, points bigint, fits bigint"
    )


#: A small grid for the registered query; the library's own grids are vocab.RIDGE_ALPHAS and vocab.BOOSTING_GRID.
SMALL_GRIDS = {
    "ridge": None,
    "gradient_boosting": {
        "learning_rate": [0.05, 0.1], "max_iter": [100], "max_leaf_nodes": [31], "min_samples_leaf": [20], "l2_regularization": [0.0],
    },
}


@query("tune_models")
def tune_models(spark, sf_dir):
    matrix = units(spark, sf_dir).select("url_anuncio", "preco_venda", *NUMERIC, *FLAGS)
    return pipelines.tune_models(matrix, SMALL_GRIDS)[0]


# --- streaming ---------------------------------------------------------------------------------

def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid4().hex}"


def _table_stream(spark, sf_dir, name):
    """A table as a stream, be it one file or a folder of part files: a stream takes a file only where its path is a pattern."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


@query("stream_ingest", """SELECT 'https://x.example/' || o_custkey AS url_anuncio, arg_min(o_totalprice, o_orderkey) AS o_totalprice, min(o_orderkey) AS o_orderkey
  FROM orders GROUP BY o_custkey""")
def stream_ingest(spark, sf_dir):
    place = _scratch(spark)
    stream = _table_stream(spark, sf_dir, "orders").select(
        F.concat(F.lit("https://x.example/"), F.col("o_custkey").cast("string")).alias(vocab.URL), "o_totalprice", "o_orderkey"
    )
    incremental.ingest(stream, f"{place}/table", f"{place}/checkpoint", order=["o_orderkey"]).awaitTermination()
    return spark.read.parquet(f"{place}/table").select(vocab.URL, "o_totalprice", "o_orderkey")


# Copies of a user's day compete by value; a day is written once the watermark, a day behind the latest event, has passed it by a day.
@query("stream_ingest_bounded", """SELECT user_id || '@' || ts::DATE AS url_anuncio, event_id, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY value, event_id) = 1
    AND epoch_ms(min(ts) OVER (PARTITION BY user_id, ts::DATE)) + 86400000 <= epoch_ms(max(ts) OVER ()) - 86400000""")
def stream_ingest_bounded(spark, sf_dir):
    place = _scratch(spark)
    stream = _table_stream(spark, sf_dir, "events").select(
        F.concat_ws("@", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias(vocab.URL), "event_id", "value",
        F.col("ts").cast("timestamp").alias("ts"),
    )
    query = incremental.ingest(
        stream, f"{place}/table", f"{place}/checkpoint", order=["value", "event_id"], event_time="ts", delay="1 day"
    )
    query.awaitTermination()
    return spark.read.parquet(f"{place}/table").select(vocab.URL, "event_id", "value")


@query("stream_extract", f"""SELECT (doc_id // 2)::VARCHAR AS url_anuncio, len({D.strip('text')}) >= 10 AND contains({D.plain('text')}, 'the and') AS the_and
  FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id) = 1""")
def stream_extract(spark, sf_dir):
    place = _scratch(spark)
    stream = _table_stream(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 2).cast("string").alias(vocab.URL), F.col("text").alias(vocab.DESCRIPTION), "doc_id"
    )
    incremental.extract_stream(stream, f"{place}/table", f"{place}/checkpoint", ["the and"], order=["doc_id"]).awaitTermination()
    out = incremental._sink(spark, f"{place}/table")
    return out.select(vocab.URL, F.col("extraction.flags")["the_and"].alias("the_and"))
