"""Correlation, selection, distribution and bias queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from hearthlake.catalog import duck as D
from hearthlake.catalog.fixtures import FLAGS, NUMERIC, UNITS_CTE, table, units
from hearthlake.catalog.registry import query
from hearthlake.operators import correlation, diagnostics, filters, ranks
from hearthlake.operators.enrichment import precision_of
from hearthlake.plans import pipelines

WITH_UNITS = D.with_ctes(UNITS_CTE)
FEATURES = NUMERIC + FLAGS
PRICED = "priced AS (SELECT *, ln(preco_venda) AS log_preco, CASE WHEN area_util > 0 THEN preco_venda / area_util END AS preco_m2 FROM units WHERE preco_venda > 0)"
TARGETS = ["preco_venda", "log_preco", "preco_m2"]


def _spearman_sql(a: str, b: str, source: str) -> str:
    return f"""(SELECT corr(ra, rb) FROM (SELECT {D.avg_rank('a')} AS ra, {D.avg_rank('b')} AS rb
      FROM (SELECT {a}::DOUBLE AS a, {b}::DOUBLE AS b FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)))"""


def _matrix_sql(kind: str, columns: list[str], source: str = "units") -> str:
    out = []
    for a, b in combinations(columns, 2):
        r = f"(SELECT corr({a}::DOUBLE, {b}::DOUBLE) FROM {source})" if kind == "pearson" else _spearman_sql(a, b, source)
        n = f"(SELECT count(*) FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        out.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {n} AS n, round({r}, 6) AS r")
    return " UNION ALL ".join(out)


def _rounded(df):
    return df.withColumn("r", F.round("r", 6))


@query("pearson_matrix_long", f"{WITH_UNITS} {_matrix_sql('pearson', FEATURES)}")
def pearson_matrix_long(spark, sf_dir):
    return _rounded(correlation.correlation_pairs(units(spark, sf_dir), correlation.all_pairs(FEATURES), "pearson"))


@query("corr_matrix_long", f"{WITH_UNITS} {_matrix_sql('spearman', FEATURES)}")
def corr_matrix_long(spark, sf_dir):
    return _rounded(correlation.correlation_pairs(units(spark, sf_dir), correlation.all_pairs(FEATURES), "spearman"))


def _ranking_sql() -> str:
    rows = []
    for f in FEATURES:
        cells = []
        for t in TARGETS:
            cells.append(f"round((SELECT corr({f}::DOUBLE, {t}) FROM priced), 6) AS pearson_{t}")
            cells.append(f"round({_spearman_sql(f, t, 'priced')}, 6) AS spearman_{t}")
        rows.append(f"""SELECT '{f}' AS feature, round((SELECT count({f}) / count(*) FROM priced), 9) AS cobertura,
          round((SELECT avg({f}::DOUBLE) FROM priced), 6) AS media, {', '.join(cells)}""")
    return f"SELECT *, abs(spearman_preco_venda) AS forca FROM ({' UNION ALL '.join(rows)})"


@query("feature_ranking", f"{WITH_UNITS}, {PRICED} {_ranking_sql()}")
def feature_ranking(spark, sf_dir):
    df, targets = correlation.with_targets(units(spark, sf_dir))
    ranking = correlation.strongest_first(correlation.rank_features(df, FEATURES, targets))
    digits = {c: F.round(c, 9 if c == "cobertura" else 6) for c in ranking.columns if c != "feature"}
    return ranking.withColumns(digits)


@query("source_artifacts", f"""{WITH_UNITS} SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, 'origem_anuncio_portal_a' AS origem, round(corr({f}::DOUBLE, origem_anuncio_portal_a::DOUBLE), 6) AS correlacao FROM units"
    for f in FEATURES if f != "origem_anuncio_portal_a"
) + ") WHERE abs(correlacao) >= 0.5")
def source_artifacts(spark, sf_dir):
    found = correlation.source_artifacts(units(spark, sf_dir), FEATURES, ["origem_anuncio_portal_a"])
    return found.withColumn("correlacao", F.round("correlacao", 6))


@query("redundant_pairs", f"{WITH_UNITS} SELECT feature_a, feature_b, abs(r) AS correlacao FROM ({_matrix_sql('spearman', NUMERIC)}) WHERE abs(r) >= 0.85")
def redundant_pairs(spark, sf_dir):
    pairs = correlation.spearman_pairs(units(spark, sf_dir), correlation.all_pairs(NUMERIC))
    return correlation.redundant_pairs(pairs).withColumn("correlacao", F.round("correlacao", 6))


def _strengths_sql(features: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS f, {i} AS pos, abs({_spearman_sql(f, 'preco_venda', 'priced')}) AS forca" for i, f in enumerate(features)
    )


def _walk_sql(features: list[str]) -> str:
    """The greedy walk over redundant pairs: each drops its weaker feature unless one of the two is gone."""
    return f"""pairs AS ({_matrix_sql('spearman', features, 'priced')}), s AS ({_strengths_sql(features)}),
  ordered AS (SELECT CASE WHEN a.forca < b.forca THEN feature_b ELSE feature_a END AS keep, CASE WHEN a.forca < b.forca THEN feature_a ELSE feature_b END AS lose,
      abs(r) AS c, greatest(a.forca, b.forca) AS fk, least(a.forca, b.forca) AS fl, row_number() OVER (ORDER BY abs(r) DESC, a.pos, b.pos) AS i
    FROM pairs JOIN s a ON a.f = feature_a JOIN s b ON b.f = feature_b WHERE abs(r) >= 0.85),
  walk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS gone, false AS hit UNION ALL
    SELECT o.i, CASE WHEN list_contains(gone, keep) OR list_contains(gone, lose) THEN gone ELSE list_append(gone, lose) END,
      NOT (list_contains(gone, keep) OR list_contains(gone, lose)) FROM walk w JOIN ordered o ON o.i = w.i + 1)"""


@query("select_features", f"""WITH RECURSIVE {UNITS_CTE}, {PRICED}, {_walk_sql(FEATURES)}, ranking AS ({_ranking_sql()})
  SELECT * FROM ranking WHERE NOT list_contains((SELECT gone FROM walk ORDER BY i DESC LIMIT 1), feature)""")
def select_features(spark, sf_dir):
    matrix = units(spark, sf_dir).drop("order_id", "place", "status")
    selected = pipelines.select_features(matrix).selected
    digits = {c: F.round(c, 9 if c == "cobertura" else 6) for c in selected.columns if c != "feature"}
    return selected.withColumns(digits)


@query("pruning_decisions", f"""WITH RECURSIVE {UNITS_CTE}, {PRICED}, {_walk_sql(NUMERIC)}
  SELECT keep AS mantida, lose AS descartada, c AS correlacao_entre_elas, round(fk, 6) AS forca_mantida, round(fl, 6) AS forca_descartada
  FROM walk JOIN ordered USING (i) WHERE hit""")
def pruning_decisions(spark, sf_dir):
    df, targets = correlation.with_targets(units(spark, sf_dir))
    pairs = correlation.spearman_pairs(df, correlation.all_pairs(NUMERIC))
    ranking = correlation.rank_features(df, NUMERIC, targets)
    _, log = correlation.prune_redundant(pairs, ranking, NUMERIC)
    return log.withColumns({c: F.round(c, 6) for c in ("correlacao_entre_elas", "forca_mantida", "forca_descartada")})


@query("constant_columns", f"""{WITH_UNITS} SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) > 1 AS varies FROM units" for c in [*FEATURES, "com_constante"]
) + ") WHERE varies")
def constant_columns(spark, sf_dir):
    kept = filters.varying_columns(units(spark, sf_dir), [*FEATURES, "com_constante"])
    return spark.createDataFrame([(c, True) for c in kept], "feature string, varies boolean")


@query("average_ranks", """SELECT DISTINCT event_type, value, count(*) OVER (PARTITION BY event_type, value) AS cnt,
  """ + D.avg_rank("value", "event_type") + " AS avg_rank FROM events")
def average_ranks(spark, sf_dir):
    return ranks.average_ranks(table(spark, sf_dir, "events"), ["event_type"], "value").select(
        "event_type", "value", "cnt", "avg_rank"
    )


@query("exact_percentiles", """SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1""")
def exact_percentiles(spark, sf_dir):
    out = ranks.exact_percentiles(
        table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    )
    return out.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p99")])


@query("column_medians", f"{WITH_UNITS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, round(quantile_cont({c}, 0.5), 6) AS median FROM units" for c in NUMERIC))
def column_medians(spark, sf_dir):
    return ranks.column_medians(units(spark, sf_dir), NUMERIC).withColumn("median", F.round("median", 6))


@query("bracketed_medians", f"{WITH_UNITS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 6) AS median FROM units" for c in FEATURES))
def bracketed_medians(spark, sf_dir):
    found = ranks.bracketed_medians(units(spark, sf_dir), FEATURES)
    return spark.createDataFrame([(c, round(m, 6)) for c, m in found.items()], "feature string, median double")


@query("skew_kurtosis", """SELECT count(*) AS n, round(skewness(x), 6) AS skew_raw, round(kurtosis(x), 6) AS kurtosis_raw,
  round(skewness(ln(x)), 6) AS skew_log, round(kurtosis(ln(x)), 6) AS kurtosis_log FROM (SELECT o_totalprice AS x FROM orders WHERE o_totalprice > 0)""")
def skew_kurtosis(spark, sf_dir):
    shape = diagnostics.target_shape(table(spark, sf_dir, "orders"), "o_totalprice")
    return shape.withColumns({c: F.round(c, 6) for c in shape.columns if c != "n"})


MW = f"""r AS (SELECT value, event_type = 'click' AS g, {D.avg_rank('value')} AS rk FROM events WHERE event_type IN ('click', 'view')),
  t AS (SELECT sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT count(*) AS c FROM r GROUP BY value)),
  s AS (SELECT count(*) FILTER (WHERE g) AS n1, count(*) FILTER (WHERE NOT g) AS n2, sum(rk) FILTER (WHERE g) AS rs FROM r),
  u AS (SELECT n1, n2, rs - n1 * (n1 + 1) / 2.0 AS u, n1 + n2 AS n FROM s)"""


@query("mann_whitney", f"""WITH {MW} SELECT n1::BIGINT AS n_first, n2::BIGINT AS n_second, u::DOUBLE AS u_first,
  round((abs(u - n1 * n2 / 2.0) - 0.5) / sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n::DOUBLE * (n - 1)))), 6) AS z,
  round((SELECT quantile_cont(value, 0.5) FROM r WHERE g), 6) AS median_first,
  round((SELECT quantile_cont(value, 0.5) FROM r WHERE NOT g), 6) AS median_second FROM u, t""")
def mann_whitney(spark, sf_dir):
    both = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    test = diagnostics.mann_whitney(both, "value", F.col("event_type") == "click")
    return test.withColumns({c: F.round(c, 6) for c in ("z", "median_first", "median_second")})


# The normal tail by the rational approximation 7.1.26 of Abramowitz and Stegun, good to 1.5e-7.
@query("mann_whitney_p", f"""WITH {MW}, z AS (SELECT n1::BIGINT AS n_first, n2::BIGINT AS n_second,
    (abs(u - n1 * n2 / 2.0) - 0.5) / sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n::DOUBLE * (n - 1)))) AS z FROM u, t),
  x AS (SELECT *, greatest(z, 0) / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * greatest(z, 0) / sqrt(2.0)) AS t FROM z)
  SELECT n_first, n_second, round(z, 6) AS z, round(exp(-x * x) * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741
    + t * (-1.453152027 + t * 1.061405429)))), 4) AS p_value FROM x""")
def mann_whitney_p(spark, sf_dir):
    both = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    test = diagnostics.mann_whitney(both, "value", F.col("event_type") == "click")
    return test.select("n_first", "n_second", F.round("z", 6).alias("z"), F.round(diagnostics.two_sided_p("z"), 4).alias("p_value"))


@query("text_quality_precision", """SELECT 'quality' AS campo, count(g) AS comparaveis, round(avg((g = 0)::INT::DOUBLE), 9) AS exato,
  round(avg((g <= 1)::INT::DOUBLE), 9) AS ate_1_de_diferenca FROM (SELECT abs((length(text) > 400)::INT::DOUBLE - quality) AS g
  FROM documents LEFT JOIN labels USING (doc_id))""")
def text_quality_precision(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    both = docs.join(labels, "doc_id", "left").select(
        F.abs((F.length("text") > 400).cast("double") - F.col("quality")).alias("gap")
    )
    out = precision_of(both, {"quality": F.col("gap")})
    return out.withColumns({c: F.round(c, 9) for c in ("exato", "ate_1_de_diferenca")})


