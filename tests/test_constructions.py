"""Searches, features and weights that SQL cannot state, against plain loops on small series."""

from __future__ import annotations

import itertools
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.kernels import dtw_abs, dtw_multivariate, nonnegative_weights, simplex_weights
from tidemark.functions.order import numbered_in_order
from tidemark.operators import diagnostics as diag
from tidemark.operators.combos import ExhaustiveCombiGen, members_of
from tidemark.operators.features import DirectProfileFeatureEngineer, FeaturePipeline, PCAFeatureEngineer, StandardStatsFeatureEngineer
from tidemark.functions.skyline import minimal
from tidemark.operators.policies import ObjectiveSet, ParetoUtopiaPolicy, WeightedSumPolicy, with_front
from tidemark.operators.represent import BlendedRepresentationModel, KMedoidsClustersizeRepresentation, UniformRepresentationModel, aggregated
from tidemark.operators.scores import CorrelationFidelity, DiurnalDTWFidelity, DurationCurveFidelity, NRMSEFidelity, WassersteinFidelity
from tidemark.operators.search import CTPCSearch, HullClusteringSearch, KMedoidsSearch, OptimizationSearch, SnippetSearch, merged_runs
from tidemark.plans.context import ProblemContext, TimeSlicer
from tidemark.plans.experiment import RepSetExperiment, Workflow

N, P = 14, 3


def series(spark, values: np.ndarray, names=("a", "b", "c")):
    """One row per hour."""
    start = datetime(2024, 3, 1)
    rows = [(start + timedelta(hours=i), *map(float, r)) for i, r in enumerate(values)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, " + ", ".join(f"{n} double" for n in names[: values.shape[1]]))


@pytest.fixture(scope="module")
def points() -> np.ndarray:
    return np.random.default_rng(4).standard_normal((N, P)).round(3)


@pytest.fixture(scope="module")
def context(spark, points) -> ProblemContext:
    """N days of one row each; the features are that row."""
    start = datetime(2024, 3, 1)
    rows = [(start + timedelta(days=i), *map(float, r)) for i, r in enumerate(points)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, a double, b double, c double")
    return DirectProfileFeatureEngineer().run(ProblemContext(df, TimeSlicer("day")))


def number(labels) -> list[int]:
    return [int(s[8:]) - 1 for s in labels]


def distances(x: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    off = x[:, None] - x[None]
    return {"euclidean": np.sqrt((off**2).sum(2)), "manhattan": np.abs(off).sum(2), "chebyshev": np.abs(off).max(2), "sqeuclidean": (off**2).sum(2)}[metric]


def alternate(d: np.ndarray, medoids: list[int]) -> list[int]:
    while True:
        near = [min(medoids, key=lambda m: (d[i, m], m)) for i in range(len(d))]
        new = sorted(min((i for i in range(len(d)) if near[i] == m), key=lambda i: (sum(d[i, j] for j in range(len(d)) if near[j] == m), i)) for m in medoids)
        if new == medoids:
            return new
        medoids = new


def pam(d: np.ndarray, medoids: list[int]) -> list[int]:
    while True:
        cost = lambda s: d[:, s].min(axis=1).sum()
        swaps = [(cost([*(set(medoids) - {m}), h]), m, h) for m in medoids for h in range(len(d)) if h not in medoids]
        best = min(swaps)
        if best[0] >= cost(medoids) - 1e-12:
            return sorted(medoids)
        medoids = sorted([*(set(medoids) - {best[1]}), best[2]])


def farthest(d: np.ndarray, k: int) -> list[int]:
    chosen = [int(d.sum(1).argmin())]
    while len(chosen) < k:
        left = d[:, chosen].min(axis=1)
        left[chosen] = -1
        chosen.append(int(left.argmax()))
    return sorted(chosen)


@pytest.mark.parametrize(("metric", "method", "init"), [("euclidean", "alternate", "k-medoids++"), ("manhattan", "alternate", "heuristic"), ("euclidean", "pam", "build"), ("chebyshev", "pam", "k-medoids++")])
def test_k_medoids(context, points, metric, method, init):
    d, k = distances(points, metric), 3
    if init == "heuristic":
        start = sorted(np.argsort(d.sum(1), kind="stable")[:k].tolist())
    elif init == "build":
        start = []
        while len(start) < k:
            start.append(min((h for h in range(N) if h not in start), key=lambda h: (d[:, [*start, h]].min(axis=1).sum(), h)))
    else:
        start = farthest(d, k)
    expected = (alternate if method == "alternate" else pam)(d, sorted(start))
    result = KMedoidsSearch(k, metric, method, init).find_selection(context)
    assert number(result.selection) == expected
    near = [min(expected, key=lambda m: (d[i, m], m)) for i in range(N)]
    assert result.diagnostics["inertia"] == pytest.approx(sum(d[i, m] for i, m in enumerate(near)))
    wcss = sum(((points[[i for i in range(N) if near[i] == m]] - points[[i for i in range(N) if near[i] == m]].mean(0)) ** 2).sum() for m in expected)
    assert result.scores["wcss"] == pytest.approx(wcss)
    assert {r["rep_slice_id"]: r["weight"] for r in result.weights.collect()} == pytest.approx({m: near.count(m) / N for m in expected})


def test_k_medoids_seeds_and_bounds(context):
    one, two = (KMedoidsSearch(3, random_state=7).find_selection(context).selection for _ in range(2))
    assert one == two and len(set(one)) == 3
    assert len(set(KMedoidsSearch(3, init="random", random_state=1).find_selection(context).selection)) == 3
    everything = KMedoidsSearch(N).find_selection(context)
    assert len(everything.selection) == N and everything.diagnostics["inertia"] == pytest.approx(0)
    for k in (0, N + 1):
        with pytest.raises(ValueError):
            KMedoidsSearch(k).find_selection(context)
    for wrong in ({"metric": "x"}, {"method": "x"}, {"init": "x"}):
        with pytest.raises(ValueError):
            KMedoidsSearch(2, **wrong)


def chained(x: np.ndarray, k: int, linkage: str) -> list[int]:
    runs = [[i] for i in range(len(x))]

    def cost(a, b):
        if linkage == "ward":
            gap = x[a].mean(0) - x[b].mean(0)
            return len(a) * len(b) / (len(a) + len(b)) * gap @ gap
        d = [float(np.linalg.norm(x[i] - x[j])) for i in a for j in b]
        return max(d) if linkage == "complete" else sum(d) / len(d)

    while len(runs) > k:
        i = min(range(len(runs) - 1), key=lambda i: (cost(runs[i], runs[i + 1]), i))
        runs[i : i + 2] = [runs[i] + runs[i + 1]]
    return [r[0] for r in runs]


@pytest.mark.parametrize("linkage", ["ward", "complete", "average"])
def test_chronological_clusters(context, points, linkage):
    rng = np.random.default_rng(8)
    for n in (5, 30):
        x = rng.standard_normal((n, 2))
        for k in (1, 2, n - 1, n):
            assert merged_runs(x, k, linkage) == chained(x, k, linkage)
    starts = chained(points, 4, linkage)
    result = CTPCSearch(4, linkage).find_selection(context)
    runs = [list(range(a, b)) for a, b in zip(starts, [*starts[1:], N], strict=True)]
    reps = [min(r, key=lambda i: (((points[i] - points[r].mean(0)) ** 2).sum(), i)) for r in runs]
    assert number(result.selection) == reps and result.selection_space == "chronological"
    assert result.scores["wcss"] == pytest.approx(sum(((points[r] - points[r].mean(0)) ** 2).sum() for r in runs))
    assert {r["rep_slice_id"]: r["weight"] for r in result.weights.collect()} == pytest.approx({m: len(r) / N for m, r in zip(reps, runs, strict=True)})


def test_chronological_bounds(context):
    for k in (0, N + 1):
        with pytest.raises(ValueError):
            CTPCSearch(k).segments(context)
    assert CTPCSearch(N, "single").segments(context).select("cluster").distinct().count() == N
    with pytest.raises(ValueError):
        CTPCSearch(2, "x")


def nearest(z: np.ndarray, vertices: np.ndarray, convex: bool) -> float:
    """Distance of z from the hull of vertices: the least over all faces of the exact solution there."""
    best = np.linalg.norm(z) if not convex else np.inf
    for size in range(1, len(vertices) + 1):
        for face in itertools.combinations(range(len(vertices)), size):
            a = vertices[list(face)].T
            if convex:
                gram = np.block([[a.T @ a, np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
                w = np.linalg.lstsq(gram, np.append(a.T @ z, 1.0), rcond=None)[0][:size]
            else:
                w = np.linalg.lstsq(a, z, rcond=None)[0]
            if (w >= -1e-9).all():
                best = min(best, float(np.linalg.norm(z - a @ w)))
    return best


@pytest.mark.parametrize("hull", ["convex", "conic"])
def test_hull(context, points, hull):
    convex = hull == "convex"
    chosen = [int(((points - points.mean(0)) ** 2).sum(1).argmax())]
    while len(chosen) < 4:
        errors = [-1.0 if i in chosen else nearest(points[i], points[chosen], convex) for i in range(N)]
        chosen.append(int(np.argmax(errors)))
    result = HullClusteringSearch(4, hull).find_selection(context)
    assert number(result.selection) == chosen
    left = sum(nearest(points[i], points[chosen], convex) for i in range(N) if i not in chosen)
    assert result.scores["projection_error"] == pytest.approx(left, abs=1e-5)
    with pytest.raises(ValueError):
        HullClusteringSearch(2, "x")
    with pytest.raises(ValueError):
        HullClusteringSearch(N + 1).find_selection(context)


def test_blended_weights(context, points):
    labels = tuple(f"2024-03-{i + 1:02d}" for i in (0, 4, 9))
    vertices = points[[0, 4, 9]]
    model = BlendedRepresentationModel()
    model.fit(context)
    weights = model.weigh(labels)
    found = np.zeros((N, 3))
    for r in weights.collect():
        found[r["slice_id"], [0, 4, 9].index(r["rep_slice_id"])] = r["weight"]
    assert np.allclose(found.sum(1), 1) and (found >= 0).all()
    for i in range(N):
        assert np.linalg.norm(points[i] - found[i] @ vertices) == pytest.approx(nearest(points[i], vertices, True), abs=1e-5)
    total = {r["rep_slice_id"]: r["weight"] for r in aggregated(weights).collect()}
    assert [total[i] for i in (0, 4, 9)] == pytest.approx(found.mean(0).tolist())
    with pytest.raises(ValueError):
        model.weigh(("2025-01-01",))
    with pytest.raises(NotImplementedError):
        BlendedRepresentationModel("x")


def test_kernels():
    rng = np.random.default_rng(3)

    def plain(cost):
        n, m = cost.shape
        total = np.full((n, m), np.inf)
        for i in range(n):
            for j in range(m):
                before = 0.0 if i == j == 0 else min([total[a, b] for a, b in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if a >= 0 and b >= 0])
                total[i, j] = cost[i, j] + before
        return total[-1, -1]

    for n, m in ((1, 1), (1, 5), (6, 4), (9, 9)):
        x, y = rng.standard_normal(n), rng.standard_normal(m)
        assert dtw_abs(x, y) == pytest.approx(plain(np.abs(x[:, None] - y)))
        a, b = rng.standard_normal((n, 3)), rng.standard_normal((m, 3))
        assert dtw_multivariate(a, b) == pytest.approx(np.sqrt(plain(((a[:, None] - b) ** 2).sum(2))))
    assert dtw_abs([], [1.0]) == float("inf") and dtw_abs([1.0, 2.0], [1.0, 2.0]) == 0
    for _ in range(50):
        vertices, z = rng.standard_normal((int(rng.integers(1, 5)), 3)), rng.standard_normal(3)
        assert np.linalg.norm(z - simplex_weights(z, vertices) @ vertices) == pytest.approx(nearest(z, vertices, True), abs=1e-5)
        assert np.linalg.norm(z - nonnegative_weights(z, vertices) @ vertices) == pytest.approx(nearest(z, vertices, False), abs=1e-5)


def test_pca(context, points):
    values, vectors = np.linalg.eigh(np.cov(points.T))
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order].T
    vectors *= np.sign(vectors[np.arange(P), np.abs(vectors).argmax(1)])[:, None]
    scores = (points - points.mean(0)) @ vectors.T
    for components, k in ((None, 3), (2, 2), (float(values[0] / values.sum()) - 1e-6, 1), (float(values[:2].sum() / values.sum()) - 1e-6, 2)):
        engineer = PCAFeatureEngineer(components)
        rows = engineer.calc_and_get_features_df(context).orderBy("slice_id").collect()
        assert np.allclose([[r[f"pc_{j}"] for j in range(k)] for r in rows], scores[:, :k]) and f"pc_{k}" not in rows[0]
        assert np.allclose(engineer.explained_variance_ratio_, values[:k] / values.sum())
    white = PCAFeatureEngineer(whiten=True).calc_and_get_features_df(context).orderBy("slice_id").collect()
    assert np.allclose(np.cov(np.array([[r[f"pc_{j}"] for j in range(P)] for r in white]).T), np.eye(P))
    engineer = PCAFeatureEngineer()
    with pytest.raises(ValueError):
        diag.pca_variance(context, engineer)
    engineer.calc_and_get_features_df(context)
    table = diag.pca_variance(context, engineer).orderBy("component").collect()
    assert np.allclose([r["cumulative"] for r in table], np.cumsum(values) / values.sum())
    with pytest.raises(ValueError):
        PCAFeatureEngineer().calc_and_get_features_df(ProblemContext(context.df, context.slicer))


@pytest.mark.parametrize("components", [None, 3, 0.6])
def test_pca_of_more_features_than_slices(spark, monkeypatch, components):
    """Block products of 9 slices with 40 features give the singular vectors of the centred table."""
    x = np.random.default_rng(8).standard_normal((9, 40))
    features = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "slice_id int, " + ", ".join(f"f{j} double" for j in range(40))).repartition(3)
    given = SimpleNamespace(df_features=features, features=features, feature_columns=[f"f{j}" for j in range(40)])
    monkeypatch.setattr("tidemark.functions.blocks.BLOCK", 4)
    _, sizes, vectors = np.linalg.svd(x - x.mean(0), full_matrices=False)
    share = sizes**2 / (sizes**2).sum()
    k = {None: 9, 3: 3, 0.6: int(np.searchsorted(np.cumsum(share), 0.6)) + 1}[components]
    vectors *= np.sign(vectors[np.arange(9), np.abs(vectors).argmax(1)])[:, None]
    engineer = PCAFeatureEngineer(components)
    rows = engineer.calc_and_get_features_df(given).orderBy("slice_id").collect()
    scores = (x - x.mean(0)) @ vectors.T
    assert np.allclose([[r[f"pc_{j}"] for j in range(k)] for r in rows], scores[:, :k]) and f"pc_{k}" not in rows[0]
    assert np.allclose(engineer.explained_variance_ratio_, share[:k]) and np.allclose(engineer.explained_variance_, sizes[:k] ** 2 / 8)
    assert np.allclose(engineer.components_[:8], vectors[: min(k, 8)])


def brute_wasserstein(whole: np.ndarray, part: np.ndarray) -> float:
    grid = np.unique(whole)
    cdf = lambda v: np.searchsorted(np.sort(v), grid, side="right") / len(v)
    q = np.quantile(whole, 0.75) - np.quantile(whole, 0.25)
    return float((np.abs(cdf(whole) - cdf(part))[:-1] * np.diff(grid)).sum() / (q or 1.0))


def brute_nrmse(whole: np.ndarray, part: np.ndarray) -> float:
    f, o = np.sort(whole), np.sort(part)
    at = np.linspace(0, len(o) - 1, len(f))
    return float(np.sqrt(((np.interp(at, np.arange(len(o)), o) - f) ** 2).mean()) / (f.mean() + 1e-12))


def brute_duration(whole: np.ndarray, part: np.ndarray) -> float:
    points = np.linspace(0, 1, 101)
    q = np.quantile(whole, 0.75) - np.quantile(whole, 0.25)
    return float(np.sqrt(((np.quantile(part, points) - np.quantile(whole, points)) ** 2).mean()) / (q or 1.0))


@pytest.mark.parametrize(("chunk", "group"), [(4096, 512), (5, 2), (1, 1)])
def test_distribution_scores_in_chunks(spark, monkeypatch, chunk, group):
    """Scores do not depend on how values and candidates are cut; ties, nulls and a constant variable included."""
    rng = np.random.default_rng(6)
    values = np.column_stack([rng.integers(0, 9, 24 * 5), rng.standard_normal(24 * 5) + 5, np.full(24 * 5, 2.0)]).astype(float)
    values[3, 1] = np.nan
    context = ProblemContext(series(spark, values), TimeSlicer("day"), chunk=chunk)
    combos = ExhaustiveCombiGen(2).generate(context).collect()
    for kind, brute in ((WassersteinFidelity, brute_wasserstein), (NRMSEFidelity, brute_nrmse), (DurationCurveFidelity, brute_duration)):
        component = kind(variable_weights={"a": 1.0, "b": 2.0})
        monkeypatch.setattr(component, "GROUP", group)
        component.prepare(context)
        found = {r["combo_id"]: r["score"] for r in component.score_all(members_of(ExhaustiveCombiGen(2).generate(context))).collect()}
        for r in combos:
            own = np.concatenate([values[24 * i : 24 * i + 24] for i in r["slice_ids"]])
            known = lambda v: v[~np.isnan(v)]
            assert found[r["combo_id"]] == pytest.approx(brute(known(values[:, 0]), known(own[:, 0])) + 2 * brute(known(values[:, 1]), known(own[:, 1])))


def test_whole_selection_and_empty_selection(spark):
    """Everything selected scores 0; nothing selected is infinite where a curve is missing, and otherwise no number."""
    context = ProblemContext(series(spark, np.random.default_rng(1).standard_normal((72, 2)) + 3, ("a", "b")), TimeSlicer("day"))
    days = tuple(context.get_unique_slices())
    for component in (WassersteinFidelity(), NRMSEFidelity(), DurationCurveFidelity(), DiurnalDTWFidelity(), CorrelationFidelity()):
        component.prepare(context)
        assert component.score(days) == pytest.approx(0, abs=1e-9)
        empty = component.score(())
        assert empty == float("inf") if component.name in ("nrmse", "nrmse_duration_curve", "diurnal_dtw") else np.isnan(empty)


def test_statistics_of_odd_series(spark):
    """A constant column, a slice of one row, a single slice and missing values scale to 0 and break nothing."""
    values = np.column_stack([np.full(49, 3.0), np.arange(49.0)])
    context = ProblemContext(series(spark, values, ("a", "b")), TimeSlicer("day"))
    rows = StandardStatsFeatureEngineer().run(context).features.orderBy("slice_id").collect()
    assert len(rows) == 3 and all(r["std__a"] == r["mean__a"] == r["corr__a__b"] == 0 for r in rows)
    assert all(np.isfinite(v) for r in rows for v in r[1:])
    one = ProblemContext(series(spark, values, ("a", "b")), TimeSlicer("year"))
    assert set(StandardStatsFeatureEngineer().run(one).features.drop("slice_id").first()) == {0.0}
    with pytest.raises(NotImplementedError):
        StandardStatsFeatureEngineer(scale="x").run(context)
    missing = values.copy()
    missing[:24, 1] = np.nan
    gaps = StandardStatsFeatureEngineer().run(ProblemContext(series(spark, missing, ("a", "b")), TimeSlicer("day"))).features.where("slice_id = 0").first()
    assert gaps["mean__b"] == 0 and gaps["corr__a__b"] == 0


def test_front_is_exact(spark):
    rng = np.random.default_rng(5)
    points = rng.integers(0, 6, (120, 3)).astype(float)
    rows = [(i, bool(i % 7), *p) for i, p in enumerate(points.tolist())] + [(500, True, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "combo_id long, feasible_mask boolean, _y_p double, _y_q double, _y_r double").repartition(5)
    found = {r["combo_id"] for r in with_front(df, ["p", "q", "r"]).where("pareto_mask").collect()}
    usable = [i for i in range(120) if i % 7]
    front = {i for i in usable if not any((points[j] <= points[i] + 1e-9).all() and (points[j] < points[i] - 1e-9).any() for j in usable)}
    assert found == front | {500}
    kept = points[minimal(points)]
    assert len(np.unique(kept, axis=0)) == len(kept) and all((kept <= p).all(axis=1).any() for p in points)
    none = with_front(df.withColumn("feasible_mask", F.lit(False)), ["p"])
    assert none.where("pareto_mask").count() == 0


def test_policies_without_feasible_or_with_ties(spark):
    objectives = ObjectiveSet({"w": (1.0, WassersteinFidelity()), "c": (1.0, CorrelationFidelity())})
    scores = spark.createDataFrame([(0, "a", 0.5, 0.5), (1, "b", 0.1, 0.9), (2, "c", 0.1, 0.9)], "combo_id long, label string, wasserstein double, correlation double")
    none = ParetoUtopiaPolicy(fairness_constraints={"wasserstein": -1.0})
    assert none.select_best(scores, objectives).first()["label"] in ("a", "b") and {r["pareto_mask"] for r in none.rank_all(scores, objectives).collect()} == {False}
    assert WeightedSumPolicy().select_best(scores.where("combo_id > 0"), objectives).first()["label"] == "b"
    with pytest.raises(ValueError):
        ParetoUtopiaPolicy(distance="x")
    with pytest.raises(ValueError):
        ParetoUtopiaPolicy(fairness_constraints={"unknown": 1.0}).rank_all(scores, objectives)


def test_experiment_and_stubs(spark, context):
    search = KMedoidsSearch(2)
    with pytest.raises(ValueError):
        RepSetExperiment(context, Workflow(DirectProfileFeatureEngineer(), search, UniformRepresentationModel())).run()
    with pytest.raises(ValueError):
        RepSetExperiment(context, Workflow(DirectProfileFeatureEngineer(), HullClusteringSearch(2))).run()
    result = RepSetExperiment(context, Workflow(DirectProfileFeatureEngineer(), HullClusteringSearch(2), KMedoidsClustersizeRepresentation())).run()
    assert sum(r["weight"] for r in result.weights.collect()) == pytest.approx(1)
    assert result.representatives.count() == 2
    with pytest.raises(ValueError):
        RepSetExperiment(ProblemContext(context.df, context.slicer), Workflow(DirectProfileFeatureEngineer(), search)).feature_context  # noqa: B018
    workflow = Workflow(DirectProfileFeatureEngineer(), search)
    for call in (lambda: workflow.save("x"), lambda: Workflow.load("x"), lambda: OptimizationSearch().find_selection(context), lambda: context.get_sliced_data("x")):
        with pytest.raises(NotImplementedError):
            call()
    with pytest.raises(ValueError):
        SnippetSearch(2, period_length_days=N).find_selection(context)
    with pytest.raises(ValueError):
        SnippetSearch(1).find_selection(ProblemContext(context.df, TimeSlicer("week"), df_features=context.features))
    with pytest.raises(ValueError):
        TimeSlicer("decade").slice_start(F.col("ts"))
    with pytest.raises(ValueError):
        FeaturePipeline({}).calc_and_get_features_df(context)


def test_numbers_in_order(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("v"), F.col("id").alias("n"), (F.col("id") / 2).alias("h"))
    rows = sorted(numbered_in_order(df, ["v", "n"], "place", {"n": "before", "h": "half"}).collect(), key=lambda r: (r["v"], r["n"]))
    total = half = 0
    for at, r in enumerate(rows):
        assert (r["place"], r["before"]) == (at, total) and r["half"] == pytest.approx(half)
        total, half = total + r["n"], half + r["h"]
    assert numbered_in_order(df.limit(0), ["v"], "place").count() == 0


def test_hull_errors_fall_with_k_and_conic_is_no_worse(context):
    errors = {kind: [HullClusteringSearch(k, kind).find_selection(context).scores["projection_error"] for k in (1, 2, 4)] for kind in ("convex", "conic")}
    for found in errors.values():
        assert all(b <= a + 1e-9 for a, b in zip(found, found[1:]))
    same = HullClusteringSearch(4, "convex").find_selection(context).selection == HullClusteringSearch(4, "conic").find_selection(context).selection
    assert not same or errors["conic"][-1] <= errors["convex"][-1] + 1e-9


@pytest.mark.parametrize("linkage", ["ward", "single", "complete", "average"])
def test_segments_are_contiguous(context, linkage):
    cluster = [r["cluster"] for r in CTPCSearch(5, linkage).segments(context).orderBy("slice_id").collect()]
    assert cluster == sorted(cluster) and set(cluster) == set(range(5))


def test_february_of_a_leap_year(spark):
    start = datetime(2024, 2, 1)
    rows = [(start + timedelta(hours=i), float(i)) for i in range(24 * 31)]
    slices = TimeSlicer("month").unique_slices(spark.createDataFrame(rows, "ts timestamp_ntz, a double")).orderBy("slice_id").collect()
    assert [(r["slice_label"], r["n_rows"]) for r in slices] == [("2024-02", 29 * 24), ("2024-03", 2 * 24)]
