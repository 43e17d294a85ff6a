"""Group-safe train/test splits and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.operators.ranks import cumulative_counts


def group_hash(group: Column | str, seed: int = vocab.SEED) -> Column:
    """32-bit number from md5(seed|group): the same in every engine and on every run."""
    group = F.col(group) if isinstance(group, str) else group
    digest = F.md5(F.concat(F.lit(f"{seed}|"), group.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def in_test(group: Column | str, share: float = vocab.TEST_SHARE, seed: int = vocab.SEED) -> Column:
    """True for the groups whose hash falls in the test share. Row-local: no shuffle."""
    return group_hash(group, seed) < F.lit(int(share * 2**32))


def group_fold(group: Column | str, folds: int = vocab.FOLDS, seed: int = vocab.SEED) -> Column:
    """Fold number from the group hash. Row-local: no shuffle."""
    return F.pmod(group_hash(group, seed), F.lit(folds)).cast("int")


def _hash_order(groups: DataFrame, group: str, within: list[str], seed: int) -> DataFrame:
    """Zero-based position of each distinct group by (hash, group)."""
    keyed = groups.withColumns({"_h": group_hash(group, seed), "_one": F.lit(1)})
    return cumulative_counts(keyed, within, "_h", weight="_one", before="position", total="groups", tie=group)


def exact_test_groups(
    df: DataFrame, group: str, share: float = vocab.TEST_SHARE, seed: int = vocab.SEED
) -> DataFrame:
    """Rows (group, is_test) with exactly ceil(share * groups) test groups."""
    ranked = _hash_order(df.select(group).distinct(), group, [], seed)
    return ranked.select(group, (F.col("position") < F.ceil(F.col("groups") * share)).alias("is_test"))


def _fill_folds(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int]]:
    """Runs (size, first position, fold), from (size, groups) in descending size.

    The next group always goes to the lightest fold. Folds less than one group apart take turns, so
    whole rounds among them are handed out at once; the cost depends on the folds, not the groups.
    """
    loads = [(0, f) for f in range(folds)]
    runs = []
    for size, left in sizes:
        given = [0] * folds
        while left:
            loads.sort()
            level = sum(load - loads[0][0] < size for load, _ in loads)
            rounds = left // level
            if level < folds:
                rounds = min(rounds, (loads[level][0] - loads[level - 1][0]) // size)
            if not rounds:
                level, rounds = 1, 1
            for i in range(level):
                load, f = loads[i]
                loads[i] = (load + rounds * size, f)
                given[f] += rounds
            left -= rounds * level
        start = 0
        for f, groups in enumerate(given):
            if groups:
                runs.append((size, start, f))
                start += groups
    return runs


def balanced_folds(
    df: DataFrame, group: str, folds: int = vocab.FOLDS, seed: int = vocab.SEED
) -> DataFrame:
    """Rows (group, size, fold): largest groups to the lightest folds.

    Groups of one size are interchangeable, so only the histogram of sizes is read back: distinct
    sizes add up to at most the rows, so there are at most sqrt(2 * rows) of them. Inside a size,
    groups take their fold by hash order.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    histogram = (
        sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
        .orderBy(F.desc("size")).collect()
    )
    runs = _fill_folds([(r["size"], r["groups"]) for r in histogram], folds)
    starts = df.sparkSession.createDataFrame(
        [(s, a, f) for s, a, f in runs] or [(0, 0, 0)], "size bigint, first bigint, fold int"
    ).groupBy("size").agg(F.array_sort(F.collect_list(F.struct("first", "fold"))).alias("_runs"))
    ranked = _hash_order(sizes, group, ["size"], seed)
    run = F.try_element_at(F.filter("_runs", lambda r: r["first"] <= F.col("position")), F.lit(-1))
    return ranked.join(F.broadcast(starts), "size").select(group, "size", run["fold"].alias("fold"))


def leaked_groups(df: DataFrame, group: str, is_test: str = "is_test") -> DataFrame:
    """Groups present on both sides; must be empty."""
    sides = df.groupBy(group).agg(F.min(is_test).alias("_lo"), F.max(is_test).alias("_hi"))
    return sides.where(F.col("_lo") != F.col("_hi")).select(group)


def require_no_leak(df: DataFrame, group: str, is_test: str = "is_test") -> None:
    leaked = leaked_groups(df, group, is_test).count()
    if leaked:
        raise RuntimeError(f"{leaked} groups are in both train and test")


def split_summary(df: DataFrame, group: str, is_test: str = "is_test") -> DataFrame:
    """One row: rows and groups per side, and groups on both sides."""
    sides = df.groupBy(group).agg(
        F.count_if(F.col(is_test)).alias("_test"), F.count_if(~F.col(is_test)).alias("_train")
    )
    return sides.agg(
        F.sum("_train").alias("train_rows"),
        F.sum("_test").alias("test_rows"),
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("_test") > 0).alias("test_groups"),
        F.count_if((F.col("_test") > 0) & (F.col("_train") > 0)).alias("leaked_groups"),
    )
