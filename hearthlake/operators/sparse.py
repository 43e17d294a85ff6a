"""Feature matrices over open vocabularies: cells, a vocabulary table, sparse vectors and Pearson moments, none of them on the driver.

A wide frame has its column names on the driver, which suits some hundred flags. Here a feature is a row of a table, so their number
may grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.operators.ranks import row_numbers
from hearthlake.session import cut_lineage

#: Pairs that a task holds, as arrays of 32 bytes a pair, before it adds them up, and then before it hands them on.
HELD = 500_000


def feature_cells(df: DataFrame, key: str, numbers: list[str] | None = None, sets: list[str] | None = None) -> DataFrame:
    """Rows (key, feature, value): a number's column and value, and 1 for each name in an array column. Missing cells and zeros have no row.

    A feature that a key has twice counts once, with its largest value.
    """
    entry = "array<struct<feature:string,value:double>>"
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in numbers or []]
    parts = [F.array(*cells).cast(entry)] if cells else []
    parts += [
        F.coalesce(F.transform(F.col(f"`{c}`"), lambda x: F.struct(x.cast("string").alias("feature"), F.lit(1.0).alias("value"))), F.array()).cast(entry)
        for c in sets or []
    ]
    long = df.select(F.col(f"`{key}`").alias("key"), F.inline(F.concat(*parts)))
    told = long.where(F.col("key").isNotNull() & F.col("feature").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != 0))
    return told.groupBy("key", "feature").agg(F.max("value").alias("value"))


def vocabulary(cells: DataFrame, at_least: int = 1) -> DataFrame:
    """Rows (feature, n, total, squares, number) of the features of `at_least` keys, numbered from 0 in order of their names."""
    stats = cells.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares")
    )
    return row_numbers(stats.where(F.col("n") >= at_least), ["feature"], "number")


def sparse_vectors(cells: DataFrame, words: DataFrame) -> DataFrame:
    """Rows (key, size, indices, values): one sparse vector per key that has any feature of the vocabulary.

    `size` is the vocabulary's. Cells join the vocabulary by feature, where adaptive execution splits a feature of very many keys.
    """
    size = words.agg(F.count(F.lit(1)).cast("bigint")).scalar()
    numbered = cells.join(words.select("feature", "number"), "feature").groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("number", "value"))).alias("_cells")
    )
    return numbered.select(
        "key", size.alias("size"), F.transform("_cells", lambda c: c["number"]).alias("indices"), F.transform("_cells", lambda c: c["value"]).alias("values")
    )


def _products(vectors: DataFrame, held: int) -> DataFrame:
    """Rows (a, b, together, product) of the pairs of features that a task's vectors have in common, added up in the task."""
    def pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """The pairs of a batch's vectors in parts of at most `held`: every cell with all that come after it in its vector."""
        lists = batch.column(0)
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        at, x = lists.flatten().to_numpy(), batch.column(1).flatten().to_numpy()
        after = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(at)) - 1
        upto = np.append(0, np.cumsum(after, dtype=np.int64))
        for start in range(0, int(upto[-1]), held):
            place = np.arange(start, min(start + held, int(upto[-1])))
            left = np.searchsorted(upto, place, "right") - 1
            right = left + 1 + place - upto[left]
            yield at[left], at[right], np.ones(len(place), np.int64), x[left] * x[right]

    def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        a, b, n, xy = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(a):
            return a, b, n, xy
        order = np.lexsort((b, a))
        a, b, n, xy = a[order], b[order], n[order], xy[order]
        starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return a[starts], b[starts], np.add.reduceat(n, starts), np.add.reduceat(xy, starts)

    def told(found: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        whole = pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "together", "product"])
        yield from (whole.slice(i, 1 << 16) for i in range(0, len(whole), 1 << 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for part in pairs(batch):
                parts.append(part)
                size += len(part[0])
                if size >= held:
                    found = added(parts)
                    parts, size = [found], len(found[0])
                    if size > held // 2:
                        yield from told(found)
                        parts, size = [], 0
        if parts:
            yield from told(added(parts))

    return vectors.select("indices", "values").mapInArrow(run, "a bigint, b bigint, together bigint, product double")


def sparse_pearson(cells: DataFrame, rows: int, words: DataFrame | None = None, held: int = HELD) -> DataFrame:
    """Rows (feature_a, feature_b, together, r): Pearson of features that some key has both of, over `rows` keys, absent cells being 0.

    Pairs that no key has both of need no rows: their r is -sqrt(s_a s_b), s being total^2 / (rows squares - total^2) of the vocabulary. A feature
    without variance has r NULL. Pairs of a key never leave its task alone: they are added up there first.
    """
    words = cut_lineage(vocabulary(cells) if words is None else words)
    sums = _products(sparse_vectors(cells, words), held).groupBy("a", "b").agg(
        F.sum("together").alias("together"), F.sum("product").alias("product")
    )
    side = {s: words.select(F.col("number").alias(s), F.col("feature").alias(f"feature_{s}"), F.col("total").alias(f"t{s}"), F.col("squares").alias(f"q{s}")) for s in "ab"}
    met = sums.join(side["a"], "a").join(side["b"], "b")
    spread = {s: rows * F.col(f"q{s}") - F.col(f"t{s}") * F.col(f"t{s}") for s in "ab"}
    cross = rows * F.col("product") - F.col("ta") * F.col("tb")
    r = F.when((spread["a"] > 0) & (spread["b"] > 0), cross / (F.sqrt(spread["a"]) * F.sqrt(spread["b"])))
    return met.select("feature_a", "feature_b", "together", r.alias("r"))
