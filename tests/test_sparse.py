"""Sparse matrices and their correlations, against dense ones."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from hearthlake.operators import sparse


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = []
    for i in range(300):
        flags = [f"f{j:03}" for j in rng.choice(60, rng.integers(0, 9), False)]
        out.append((f"k{i}", None if i % 7 == 0 else float(rng.integers(0, 5)), flags if i % 11 else None))
    return out + [("k0", 3.0, ["f001", "f001"]), (None, 1.0, ["f002"]), ("odd", float("nan"), [None, ""])]


def dense(rows):
    cells = {}
    for key, number, flags in rows:
        if key is None:
            continue
        mine = cells.setdefault(key, {})
        if number and not np.isnan(number):
            mine["size"] = max(number, mine.get("size", 0.0))
        mine.update(dict.fromkeys((f for f in flags or [] if f is not None), 1.0))
    return pd.DataFrame.from_dict(cells, orient="index").fillna(0.0).sort_index(axis=1)


def test_vectors_and_correlations_match_a_dense_matrix(spark, rows):
    df = spark.createDataFrame(rows, "key string, size double, flags array<string>").repartition(4)
    cells = sparse.feature_cells(df, "key", ["size"], ["flags"])
    words = sparse.vocabulary(cells)
    want = dense(rows)
    named = {r.feature: (r.number, r.n, r.total) for r in words.collect()}
    assert named == {f: (i, int((want[f] > 0).sum()), want[f].sum()) for i, f in enumerate(want.columns)}
    for r in sparse.sparse_vectors(cells, words).collect():
        x = np.zeros(r.size)
        x[r["indices"]] = r["values"]
        assert r.size == len(want.columns) and (x == want.loc[r.key].to_numpy()).all()
    corr = want.corr()
    for held in (2_000_000, 20):
        got = {(r.feature_a, r.feature_b): (r.together, r.r) for r in sparse.sparse_pearson(cells, len(want), held=held).collect()}
        both = {(a, b) for i, a in enumerate(want.columns) for b in want.columns[i + 1 :] if ((want[a] != 0) & (want[b] != 0)).any()}
        assert set(got) == both
        for (a, b), (together, r) in got.items():
            assert together == ((want[a] != 0) & (want[b] != 0)).sum() and r == pytest.approx(corr.loc[a, b], abs=1e-9)
    few = sparse.vocabulary(cells, 20)
    assert {r.feature for r in few.collect()} == {f for f in want.columns if (want[f] > 0).sum() >= 20}
    assert sparse.sparse_pearson(cells.limit(0), 5).count() == 0


def test_pairs_are_held_as_flat_arrays():
    class Caught:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    n = 100_000
    ends = pa.array(np.arange(n + 1) * 2, pa.int32())
    batch = pa.RecordBatch.from_arrays([
        pa.ListArray.from_arrays(ends, pa.array(np.arange(2 * n))), pa.ListArray.from_arrays(ends, pa.array(np.full(2 * n, 2.0))),
    ], names=["indices", "values"])
    tracemalloc.start()
    got = pa.Table.from_batches(sparse._products(Caught(), n)(iter([batch.slice(0, 10), batch.slice(10)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["a"].to_pylist() == list(range(0, 2 * n, 2)) and set(got["product"].to_pylist()) == {4.0} and peak < 40e6
