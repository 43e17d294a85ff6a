"""Pairwise-complete Pearson and Spearman, target ranking, artefact detection and pruning.

Results are long tables (feature_a, feature_b, n, r) whose size depends on the columns only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.functions.numbers import log_price, price_per_area
from hearthlake.session import cut_lineage, drop_unreachable

#: Variance below this share of the second moment is rounding noise of a constant.
FLAT = 1e-12
#: Distinct values up to which a column's table of ranks is broadcast.
FEW_VALUES = 50_000
PAIR_SCHEMA = "feature_a string, feature_b string, n bigint, r double"
MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _ratio(cross: Column, var_x: Column, var_y: Column) -> Column:
    """cross / sqrt(var_x * var_y), NULL where either side does not vary."""
    return F.when((var_x > 0) & (var_y > 0), cross / (F.sqrt(var_x) * F.sqrt(var_y)))


def all_pairs(columns: list[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


def _column_profile(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, bool]]:
    """Mean of each column and whether it is a complete 0/1 flag; one row comes back."""
    if not columns:
        return {}
    value = {c: F.col(f"`{c}`").cast("double") for c in columns}
    row = df.agg(*[
        F.struct(
            F.coalesce(F.avg(value[c]), F.lit(0.0)).alias("mean"),
            F.coalesce(F.bool_and(F.coalesce(value[c].isin(0.0, 1.0), F.lit(False))), F.lit(False)).alias("flag"),
        ).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]).first()
    return {c: (row[i]["mean"], row[i]["flag"]) for i, c in enumerate(columns)}


class Moments:
    """Counts, sums, squares and products of every pair of columns, over the rows that have both."""

    def __init__(self, size: int) -> None:
        self.n, self.sx, self.sxx, self.sxy = (np.zeros((size, size)) for _ in range(4))

    def add(self, values: np.ndarray) -> None:
        given = ~np.isnan(values)
        values = np.where(given, values, 0.0)
        given = given.astype(float)
        self.n += given.T @ given
        self.sx += values.T @ given
        self.sxx += (values * values).T @ given
        self.sxy += values.T @ values

    def of(self, left: np.ndarray, right: np.ndarray) -> dict[str, np.ndarray]:
        return {
            "pair": np.arange(len(left)), "n": self.n[left, right], "sx": self.sx[left, right], "sy": self.sx[right, left],
            "sxx": self.sxx[left, right], "syy": self.sxx[right, left], "sxy": self.sxy[left, right],
        }


MOMENT_SCHEMA = "pair bigint, " + ", ".join(f"{m} double" for m in MOMENTS)


def _correlated(moments: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """r of each pair from the tasks' moments, which are added first; NULL for a flat side."""
    sums = moments.groupBy("pair").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    var_x = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    var_y = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cross = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    moving = (F.col("n") > 1) & (var_x > FLAT * F.col("sxx")) & (var_y > FLAT * F.col("syy"))
    names = moments.sparkSession.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "pair bigint, feature_a string, feature_b string"
    )
    r = F.when(moving, _ratio(cross, var_x, var_y))
    return F.broadcast(names).join(sums, "pair", "left").select(
        "feature_a", "feature_b", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"), r.alias("r")
    )


def pearson_pairs(
    df: DataFrame, pairs: list[tuple[str, str]], means: dict[str, float] | None = None
) -> DataFrame:
    """Pearson r of each pair over the rows where both are present; NULL for a flat side.

    One scan: every task multiplies its batches into one set of moments, centred on the column
    means, and only those sums are shuffled.
    """
    spark = df.sparkSession
    columns = sorted({c for pair in pairs for c in pair})
    if not pairs:
        return spark.createDataFrame([], PAIR_SCHEMA)
    if means is None:
        means = {c: m for c, (m, _) in _column_profile(df, columns).items()}
    index = {c: i for i, c in enumerate(columns)}
    left = np.array([index[a] for a, _ in pairs])
    right = np.array([index[b] for _, b in pairs])
    shift = np.array([means[c] for c in columns])

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Moments(len(shift))
        for batch in batches:
            sums.add(batch.to_numpy(dtype=float) - shift)
        yield pd.DataFrame(sums.of(left, right))

    table = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    return _correlated(table.mapInPandas(moments, MOMENT_SCHEMA), pairs)


def _flag_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[str, str, int, float | None]]:
    """Pearson r of pairs of complete 0/1 flags, which is Spearman's too, from counts alone."""
    names = sorted({c for pair in pairs for c in pair})
    cell = {c: F.col(f"`{c}`").cast("double") for c in names}
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(cell.values())],
        *[F.sum(cell[a] * cell[b]).alias(f"x{i}") for i, (a, b) in enumerate(pairs)],
    ).first()
    n, total = row["n"], {c: row[f"s{i}"] for i, c in enumerate(names)}

    def r(a: str, b: str, both: float) -> float | None:
        spread = [total[c] - total[c] * total[c] / n for c in (a, b)]
        return (both - total[a] * total[b] / n) / (math.sqrt(spread[0]) * math.sqrt(spread[1])) if min(spread) > 0 else None

    return [(a, b, n, r(a, b, row[f"x{i}"])) for i, (a, b) in enumerate(pairs)]


class _Ranks:
    """Ranks of columns over the rows that a partner has too, as a table of their distinct values.

    The ranks of a column depend on the partner only through the rows that the partner lacks, so a column is
    ranked once for all partners that lack none of its rows (`patterns[c][partner]` is 0), and once more for each that does. Columns of many
    values are counted and ranked one after another, so that one's shuffle is gone before the next one's begins.
    """

    def __init__(self, base: DataFrame, columns: list[str], pairs: list[tuple[str, str]], flags: list[str]) -> None:
        self.base, self.columns, self.flags = base, columns, flags
        self.place = {c: F.col(f"c{i}") for i, c in enumerate(columns)}
        self.seen = base.agg(
            *[F.count(self.place[c]).alias(f"n{i}") for i, c in enumerate(columns)],
            *[F.approx_count_distinct(self.place[c]).alias(f"d{i}") for i, c in enumerate(columns)],
            *[F.count_if(self.place[a].isNotNull() & self.place[b].isNotNull()).alias(f"p{i}") for i, (a, b) in enumerate(pairs)],
        ).first()
        self.alone = {c: self.seen[f"n{i}"] for i, c in enumerate(columns)}
        self.both = {p: self.seen[f"p{i}"] for i, p in enumerate(pairs)}
        self.partners: dict[str, list[str | None]] = {c: [None] for c in columns}
        self.patterns: dict[str, dict[str, int]] = {c: {} for c in columns}
        for (a, b), both in self.both.items():
            for c, partner in ((a, b), (b, a)):
                if both == self.alone[c]:
                    self.patterns[c][partner] = 0
                else:
                    self.patterns[c][partner] = len(self.partners[c])
                    self.partners[c].append(partner)
        self.size = max((len(x) for x in self.partners.values()), default=0)
        many = [k for k in range(len(columns)) if self.seen[f"d{k}"] > FEW_VALUES]
        groups = [[k for k in range(len(columns)) if k not in many], *([k] for k in many)]
        self.values = reduce(DataFrame.unionByName, [self._kept(group) for group in groups if group])
        told = self.values.groupBy("k").agg(
            F.count(F.lit(1)).alias("distinct"),
            *[F.sum(F.col(f"w{i}") * F.col(f"r{i}") * F.col(f"r{i}")).alias(f"srr{i}") for i in range(self.size)],
            *[F.sum(f"f{j}").alias(f"s{j}") for j in range(len(flags))],
            *[F.sum(F.col(f"f{j}") * F.col("r0")).alias(f"rs{j}") for j in range(len(flags))],
        ).collect()
        self.told = {columns[r["k"]]: r for r in told}

    def _kept(self, group: list[int]) -> DataFrame:
        """Counts and ranks of the columns with these places: as many as their patterns, and none in the others."""
        size = max(len(self.partners[self.columns[k]]) for k in group)
        ranked = cut_lineage(self._ranked(self._counted(group, size), size))
        drop_unreachable(ranked.sparkSession)
        others = range(size, self.size)
        return ranked.select(
            "k", "v", *[f"w{i}" for i in range(size)], *[F.lit(0).cast("bigint").alias(f"w{i}") for i in others],
            *[f"f{j}" for j in range(len(self.flags))], *[f"r{i}" for i in range(size)], *[F.lit(0.0).alias(f"r{i}") for i in others],
        )

    def _counted(self, group: list[int], size: int) -> DataFrame:
        """Rows (k, v, w0, w1, ..., f0, f1, ...): a column's value, its copies in each pattern, and the flags' totals there."""
        def present(partner: str | None) -> Column:
            return F.lit(1) if partner is None else self.place[partner].isNotNull().cast("int")

        cells = F.array(*[
            F.struct(F.lit(k).alias("k"), self.place[c].alias("v"), *[
                (present(self.partners[c][i]) if i < len(self.partners[c]) else F.lit(0)).alias(f"w{i}") for i in range(size)
            ])
            for k, c in ((k, self.columns[k]) for k in group)
        ])
        totals = [f"f{j}" for j in range(len(self.flags))]
        long = self.base.select(*totals, F.inline(cells)).where(F.col("v").isNotNull())
        return long.groupBy("k", "v").agg(
            *[F.sum(f"w{i}").alias(f"w{i}") for i in range(size)], *[F.sum(f).alias(f) for f in totals]
        )

    def _ranked(self, counts: DataFrame, size: int) -> DataFrame:
        """`counts` with r0, r1, ...: the average rank of a value in each pattern, less their mean.

        A range sort deals the values out; what lies in earlier partitions is added from a table of one row per partition and column.
        """
        weights = [f"w{i}" for i in range(size)]
        placed = cut_lineage(counts.orderBy("k", "v").withColumn("_part", F.spark_partition_id()))
        earlier = Window.partitionBy("k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        smaller = Window.partitionBy("_part", "k").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        starts = placed.groupBy("_part", "k").agg(*[F.sum(w).alias(w) for w in weights]).select(
            "_part", "k", *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"_s{w}") for w in weights],
            *[F.sum(w).over(Window.partitionBy("k")).alias(f"_n{w}") for w in weights],
        )
        inside = placed.withColumns({f"_b{w}": F.coalesce(F.sum(w).over(smaller), F.lit(0)) for w in weights})
        ranks = [
            (F.col(f"_s{w}") + F.col(f"_b{w}") + (F.col(w) + 1) / 2.0 - (F.col(f"_n{w}") + 1) / 2.0).alias(f"r{i}")
            for i, w in enumerate(weights)
        ]
        return inside.join(F.broadcast(starts), ["_part", "k"]).select(*counts.columns, *ranks)

    def of(self, column: str) -> DataFrame:
        """Rows (v, r): the column's distinct values and their ranks by pattern."""
        ranks = F.array(*[F.col(f"r{i}") for i in range(len(self.partners[column]))])
        return self.values.where(F.col("k") == self.columns.index(column)).select("v", ranks.alias("r"))

    def few(self, column: str) -> bool:
        return column not in self.told or self.told[column]["distinct"] <= FEW_VALUES

    def rank(self, column: str, partner: str) -> Column:
        """The rank that a row with `joined` ranks has in `column` among the rows with `partner`."""
        return F.col(f"r_{self.columns.index(column)}")[self.patterns[column][partner]]

    def joined(self, rows: DataFrame, column: str) -> DataFrame:
        """`rows` with the ranks of a column of few values, NULL where it has no value."""
        k = self.columns.index(column)
        table = self.of(column).select(F.col("v").alias("_v"), F.col("r").alias(f"r_{k}"))
        return rows.join(F.broadcast(table), self.place[column] == F.col("_v"), "left").drop("_v")

    def cross_of_many(self, a: str, b: str) -> float | None:
        """Sum of the products of both ranks for two columns of many values: only the two cells of a row are shuffled."""
        rows = self.base.select(self.place[a].alias("_a"), self.place[b].alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
        first, second = (self.of(c).select(F.col("v").alias(n), F.col("r")[self.patterns[c][d]].alias(f"{n}r")) for c, d, n in ((a, b, "_a"), (b, a, "_b")))
        by_value = rows.join(first, "_a").groupBy("_b").agg(F.sum("_ar").alias("_x"))
        found = by_value.join(second, "_b").agg(F.sum(F.col("_x") * F.col("_br"))).first()[0]
        del by_value
        drop_unreachable(self.base.sparkSession)
        return found

    def crosses(self) -> dict[tuple[str, str], float]:
        """Sum of the products of both ranks for each pair of numbers.

        Columns of few values take their ranks from a broadcast table of these values. Rows are added up by the value of a column of many, which only
        then meets its ranks; where both have many values, the rows' two cells are joined with the ranks of one of them first.
        """
        many = [c for c in self.columns if not self.few(c)]
        found: dict[tuple[str, str], float] = {p: self.cross_of_many(*p) for p in self.both if not (self.few(p[0]) or self.few(p[1]))}
        rows = self.base.select(*self.place.values())
        for turned in [None, *many]:
            mine = [p for p in self.both if p not in found and (turned in p if turned else self.few(p[0]) and self.few(p[1]))]
            if not mine:
                continue
            met = rows
            for c in sorted({c for p in mine for c in p if c != turned}):
                met = self.joined(met, c)
            if turned is None:
                sums = met.agg(*[F.sum(self.rank(a, b) * self.rank(b, a)).alias(f"x{i}") for i, (a, b) in enumerate(mine)])
            else:
                others = [a if b == turned else b for a, b in mine]
                by_value = met.where(self.place[turned].isNotNull()).groupBy(self.place[turned].alias("_v0")).agg(
                    *[F.sum(self.rank(c, turned)).alias(f"x{i}") for i, c in enumerate(others)]
                )
                sums = by_value.join(self.of(turned), F.col("_v0") == F.col("v")).agg(
                    *[F.sum(F.col(f"x{i}") * F.col("r")[self.patterns[turned][c]]).alias(f"x{i}") for i, c in enumerate(others)]
                )
            row = sums.first()
            found.update({p: row[f"x{i}"] for i, p in enumerate(mine)})
            del met, sums
            if turned:
                by_value = None
                drop_unreachable(rows.sparkSession)
        return found


def _rank_pairs(df: DataFrame, numbers: list[tuple[str, str]], mixed: list[tuple[str, str]]) -> list[tuple[str, str, int, float | None]]:
    """Spearman of pairs of numbers, ranks taken over the rows where both are present, and of (number, complete flag) pairs.

    Values are counted before they are ranked, so the tables of ranks are as large as the columns' distinct values. A
    flag's ranks are a linear map of the flag, so r only needs, per number, the flag totals at each distinct value.
    """
    columns = sorted({c for pair in numbers for c in pair} | {c for c, _ in mixed})
    flags = sorted({f for _, f in mixed})
    number = {c: F.col(f"`{c}`").cast("double") for c in columns}
    base = df.select(
        *[F.when(~F.isnan(v), v + F.lit(0.0)).alias(f"c{i}") for i, v in enumerate(number.values())],
        *[F.col(f"`{f}`").cast("double").alias(f"f{j}") for j, f in enumerate(flags)],
    )
    ranks = _Ranks(base, columns, numbers, flags)
    cross = ranks.crosses() if numbers else {}
    out = []

    def r(product: float | None, one: float, other: float) -> float | None:
        return product / (math.sqrt(one) * math.sqrt(other)) if product is not None and one > 0 and other > 0 else None

    for a, b in numbers:
        spread = [ranks.told[x][f"srr{ranks.patterns[x][y]}"] if x in ranks.told else 0.0 for x, y in ((a, b), (b, a))]
        out.append((a, b, ranks.both[a, b], r(cross[a, b], *spread)))
    for a, f in mixed:
        if a in ranks.told:  # a number without any value has no row, as before
            row, j, n = ranks.told[a], flags.index(f), ranks.alone[a]
            out.append((a, f, n, r(row[f"rs{j}"], row["srr0"], row[f"s{j}"] - row[f"s{j}"] * row[f"s{j}"] / n)))
    return out


def spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Spearman rho of each pair over the rows where both are present.

    Two complete flags need no ranks; a number against a flag needs the number's ranks only; two
    numbers need the ranks of the rows they share.
    """
    columns = sorted({c for pair in pairs for c in pair})
    profile = _column_profile(df, columns)
    flag = {c: profile[c][1] for c in columns}
    both_flags = [p for p in pairs if flag[p[0]] and flag[p[1]]]
    both_numbers = [p for p in pairs if not flag[p[0]] and not flag[p[1]]]
    mixed = [p for p in pairs if flag[p[0]] != flag[p[1]]]

    parts = []
    if both_flags:
        parts.append(df.sparkSession.createDataFrame(_flag_pairs(df, both_flags), PAIR_SCHEMA))
    if both_numbers or mixed:
        turned = {(a, b) if flag[b] else (b, a): (a, b) for a, b in mixed}
        found = _rank_pairs(df, both_numbers, list(turned))
        parts.append(df.sparkSession.createDataFrame([(*turned.get((a, b), (a, b)), n, r) for a, b, n, r in found], PAIR_SCHEMA))
    out = parts[0] if parts else df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def correlation_pairs(df: DataFrame, pairs: list[tuple[str, str]], method: str) -> DataFrame:
    if method == "pearson":
        return pearson_pairs(df, pairs)
    if method == "spearman":
        return spearman_pairs(df, pairs)
    raise ValueError(f"unknown method: {method}")


# --- target ranking and selection --------------------------------------------------------------

def with_targets(df: DataFrame, price: str = vocab.PRICE, area: str = vocab.AREA) -> tuple[DataFrame, list[str]]:
    """Rows with a positive price, plus log price and price per area."""
    priced = df.where(F.col(price) > 0).withColumns({
        "log_preco": log_price(price), "preco_m2": price_per_area(price, area),
    })
    return priced, [price, "log_preco", "preco_m2"]


def rank_features(
    df: DataFrame, features: list[str], targets: list[str], strength_target: str = vocab.PRICE,
    same_order: dict[str, str] | None = None,
) -> DataFrame:
    """Coverage, mean, Pearson and Spearman against each target, and strength = |Spearman|.

    `same_order` maps a target to another one it is a rising function of, as log price is of price;
    their ranks agree, so only one is ranked.
    """
    pairs = [(f, t) for f in features for t in targets]
    same_order = {"log_preco": strength_target} if same_order is None else same_order
    twin = {t: same_order.get(t, t) if same_order.get(t) in targets else t for t in targets}
    ranked = [(f, t) for f in features for t in targets if twin[t] == t]
    links = pearson_pairs(df, pairs).withColumn("kind", F.lit("pearson")).unionByName(
        spearman_pairs(df, ranked).withColumn("kind", F.lit("spearman"))
    )
    stats = df.agg(*[
        F.struct(
            (F.count(F.col(f"`{c}`")) / F.count(F.lit(1))).alias("cobertura"),
            F.avg(F.col(f"`{c}`").cast("double")).alias("media"),
        ).alias(c)
        for c in features
    ]).unpivot([], [F.col(f"`{c}`") for c in features], "feature", "m").select("feature", "m.*")
    cells = [
        F.max(F.when((F.col("kind") == kind) & (F.col("feature_b") == source), F.col("r"))).alias(f"{kind}_{t}")
        for t in targets for kind, source in (("pearson", t), ("spearman", twin[t]))
    ]
    wide = links.groupBy(F.col("feature_a").alias("feature")).agg(*cells)
    return stats.join(wide, "feature").withColumn("forca", F.abs(F.col(f"spearman_{strength_target}")))


def strongest_first(ranking: DataFrame) -> DataFrame:
    return ranking.orderBy(F.desc_nulls_last("forca"), "feature")


def source_artifacts(
    df: DataFrame, features: list[str], origins: list[str],
    threshold: float = vocab.ARTIFACT_CORRELATION,
) -> DataFrame:
    """Features that track the source: (feature, origem, correlacao), |Pearson| at or above."""
    pairs = [(f, o) for f in features if f not in origins for o in origins]
    return pearson_pairs(df, pairs).where(F.abs("r") >= threshold).select(
        F.col("feature_a").alias("feature"), F.col("feature_b").alias("origem"),
        F.col("r").alias("correlacao"),
    )


def redundant_pairs(pairs: DataFrame, threshold: float = vocab.REDUNDANT_CORRELATION) -> DataFrame:
    return pairs.where(F.abs("r") >= threshold).select(
        "feature_a", "feature_b", F.abs("r").alias("correlacao")
    )


def prune_redundant(
    pairs: DataFrame, ranking: DataFrame, features: list[str],
    threshold: float = vocab.REDUNDANT_CORRELATION,
) -> tuple[list[str], DataFrame]:
    """Drop the weaker feature of each redundant pair, strongest pairs first; a tie drops the second.

    The loop runs over the redundant pairs of columns, never over rows of data.
    """
    position = {f: i for i, f in enumerate(features)}
    rows = redundant_pairs(pairs, threshold).collect()
    strength = {
        r["feature"]: r["forca"] or 0.0
        for r in ranking.select("feature", "forca").where(F.col("feature").isin(features)).collect()
    }
    rows = sorted(rows, key=lambda r: (-r["correlacao"], position[r["feature_a"]], position[r["feature_b"]]))
    gone: set[str] = set()
    log = []
    for row in rows:
        pair = sorted((row["feature_a"], row["feature_b"]), key=position.__getitem__)
        if gone & set(pair):
            continue
        keep, drop = sorted(pair, key=lambda f: -strength.get(f, 0.0))
        gone.add(drop)
        log.append((keep, drop, row["correlacao"], strength.get(keep, 0.0), strength.get(drop, 0.0)))
    schema = (
        "mantida string, descartada string, correlacao_entre_elas double, "
        "forca_mantida double, forca_descartada double"
    )
    decisions = pairs.sparkSession.createDataFrame(log, schema)
    return [f for f in features if f not in gone], decisions


def selected_ranking(ranking: DataFrame, selected: list[str]) -> DataFrame:
    names = ranking.sparkSession.createDataFrame([(f,) for f in selected], "feature string")
    return strongest_first(F.broadcast(names).join(ranking, "feature", "left"))
