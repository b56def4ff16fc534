"""Quantiles by rank, skylines and block distances against numpy and plain loops, on sizes that one group or one task should not hold."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import blocks, skyline
from tidemark.functions.kernels import inversions, kendall_tau
from tidemark.functions.order import quantiles, value_grid
from tidemark.operators.combos import unrank

POINTS = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


def test_quantiles_of_a_million_distinct_values(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("v").alias("variable"), (F.col("id") * 7919 % n).cast("double").alias("value"), F.lit(1).alias("n"))
    q = quantiles(value_grid(df), POINTS).first()["q"]
    assert q == pytest.approx([p * (n - 1) for p in POINTS])


def test_quantiles_with_repeats_nulls_and_small_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v), int(c)) for g, size in (("a", 1), ("b", 2), ("c", 40), (None, 7)) for v, c in zip(rng.integers(-5, 5, size), rng.integers(1, 9, size))]
    got = {r["variable"]: r["q"] for r in quantiles(value_grid(spark.createDataFrame(rows, "variable string, value double, n long"), few=False), POINTS).collect()}
    for g in ("a", "b", "c", None):
        assert got[g] == pytest.approx(np.quantile([v for name, v, c in rows if name == g for _ in range(c)], POINTS).tolist()), g
    assert quantiles(value_grid(spark.createDataFrame([], "variable string, value double, n long")), POINTS).count() == 0


def test_grid_places_and_counts(spark):
    df = spark.createDataFrame([("a", 2.0, 3), ("a", 1.0, 1), ("a", 2.0, 1), ("b", 5.0, 2)], "variable string, value double, n long")
    got = sorted(tuple(r) for r in value_grid(df).collect())
    assert got == [("a", 1.0, 1, 0, 0, 5), ("a", 2.0, 4, 1, 1, 5), ("b", 5.0, 2, 0, 0, 2)]


def points(spark, x):
    table = pd.DataFrame(x, columns=[f"c{k}" for k in range(x.shape[1])])
    table.insert(0, "id", np.arange(len(x)))
    return spark.createDataFrame(table).repartition(6), list(table.columns[1:])


@pytest.mark.parametrize(("dims", "n", "digits"), [(1, 300, 1), (2, 900, 2), (3, 900, 1), (5, 700, 2), (8, 300, 1)])
def test_skyline_both_ways(spark, monkeypatch, dims, n, digits):
    monkeypatch.setattr(skyline, "BLOCK", 50)
    monkeypatch.setattr(skyline, "GROUP", 2)
    x = np.random.default_rng(dims).random((n, dims)).round(digits)
    x[: n // 4] = x[n // 4 : n // 2] + 5e-10  # nearly equal rows dominate each other by nothing
    df, columns = points(spark, x)
    want = {i for i in range(n) if not ((x <= x[i] + 1e-9).all(1) & (x < x[i] - 1e-9).any(1)).any()}
    for few in (0, 1 << 20):
        assert {r["id"] for r in skyline.undominated(df, columns, 1e-9, few).collect()} == want


def test_skyline_of_over_a_hundred_thousand_rows(spark):
    x = np.random.default_rng(3).random((130_000, 3))
    x[:110_000] /= x[:110_000].sum(1, keepdims=True)  # on a plane none dominates
    x[110_000:] += 1.0
    df, columns = points(spark, x)
    left = skyline.undominated(df, columns)
    assert left.agg(F.count("*"), F.max("id")).first() == (110_000, 109_999)


def test_minimal_keeps_one_of_equal_points():
    x = np.random.default_rng(4).integers(0, 5, (1_500, 3)).astype(float)
    kept = x[skyline.minimal(x)]
    assert len(np.unique(kept, axis=0)) == len(kept) and all((kept <= p).all(axis=1).any() for p in x)
    assert len(skyline.minimal(np.zeros((0, 3)))) == 0


def all_distances(x, metric):
    off = x[:, None] - x[None]
    if metric == "cosine":
        norms = np.linalg.norm(x, axis=1)
        return np.maximum(1 - (x @ x.T) / np.outer(norms, norms), 0)
    return {"euclidean": np.sqrt((off**2).sum(2)), "sqeuclidean": (off**2).sum(2), "manhattan": np.abs(off).sum(2), "chebyshev": np.abs(off).max(2)}[metric]


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "manhattan", "chebyshev", "cosine"])
def test_block_distances(spark, monkeypatch, metric):
    monkeypatch.setattr(blocks, "BLOCK", 7)
    x = np.random.default_rng(5).standard_normal((40, 3))
    d = all_distances(x, metric)
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "slice_id int, x array<double>, part int")
    got = {(r["i"], r["j"]): r["d"] for r in blocks.pairs(df, metric).collect()}
    assert got == pytest.approx({(i, j): d[i, j] for i in range(40) for j in range(40)}, abs=1e-9)
    sums = {r["slice_id"]: r["s"] for r in blocks.sums_by_slice(df, metric, lambda d: d * d).collect()}
    assert sums == pytest.approx(dict(enumerate((d * d).sum(0))))
    within = {r["slice_id"]: r["s"] for r in blocks.sums_by_slice(df, metric, within="part").collect()}
    assert within == pytest.approx({j: sum(d[i, j] for i in range(40) if i % 3 == j % 3) for j in range(40)})


def test_kendall_by_inversions():
    rng = np.random.default_rng(6)
    for n, values in ((0, 3), (1, 3), (2, 2), (30, 4), (60, 1000)):
        x, y = rng.integers(0, values, (2, n)).astype(float)
        assert inversions(x) == sum(x[i] > x[j] for i in range(n) for j in range(i + 1, n))
        sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        with np.errstate(invalid="ignore"):
            want = (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum()) if n else np.nan
        assert kendall_tau(x, y) == pytest.approx(want, nan_ok=True)
    x = rng.standard_normal(200_000)
    assert kendall_tau(x, x) == pytest.approx(1) and kendall_tau(x, -x) == pytest.approx(-1)


@pytest.mark.parametrize(("n", "k"), [(1, 1), (5, 1), (6, 3), (9, 4), (7, 7)])
def test_unranked_sets_are_those_of_itertools(n, k):
    want = list(itertools.combinations(range(n), k))
    assert [tuple(r) for r in unrank(np.arange(len(want)), n, k)] == want


def test_unranking_far_out():
    import math

    last = math.comb(2_000, 4) - 1
    assert unrank(np.array([0, last]), 2_000, 4).tolist() == [[0, 1, 2, 3], [1996, 1997, 1998, 1999]]
