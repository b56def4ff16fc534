"""Further queries: options of the operators, charts, warped distances and whole experiments, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import diagnostics as diag
from tidemark.operators.combos import ExhaustiveCombiGen, GroupQuotaHierarchicalCombiGen
from tidemark.operators.features import DirectProfileFeatureEngineer, FeaturePipeline, PCAFeatureEngineer, StandardStatsFeatureEngineer
from tidemark.operators.policies import ObjectiveSet, ParetoUtopiaPolicy, WeightedSumPolicy
from tidemark.operators.represent import BlendedRepresentationModel, aggregated
from tidemark.operators.scores import CentroidBalance, CorrelationFidelity, CoverageBalance, DiurnalDTWFidelity, DiurnalFidelity, DiversityReward, DTWFidelity, DurationCurveFidelity, NRMSEFidelity, WassersteinFidelity
from tidemark.operators.search import SnippetSearch
from tidemark.plans.catalog import _DAILY, _FEATURES, _HOURLY, _NORMAL, _OBJECTIVES, _POINTS, _SOURCES, _STATS, _SUPPLIERS, DAYS, ORACLES, QUERIES, _events, _long, _means, _profiled, _query, _r, _scored, _shipments, _suppliers, months_experiment
from tidemark.plans.context import ProblemContext, TimeSlicer
from tidemark.sources.series import EVENT_TYPES, daily_shipments, hourly_events, read_csv_series
from tidemark.sources.tables import shared_folder, stored

# Sources and context


@_query("csv_series", ORACLES["hourly_pivot"])
def csv_series(spark: SparkSession, d: str) -> DataFrame:
    """The hourly series, written as CSV and loaded again."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    hourly_events(spark, d).write.csv(path, header=True)
    return read_csv_series(spark, path).select("ts", *[_r(v).alias(v) for v in EVENT_TYPES])


@_query("numeric_projection", """SELECT o_orderdate AS ts, CAST(dense_rank() OVER (ORDER BY date_trunc('month', o_orderdate)) - 1 AS INTEGER) AS slice_id,
    CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice FROM orders""")
def numeric_projection(spark, d):
    """A context leaves columns out that are not numeric."""
    return ProblemContext(spark.read.parquet(f"{d}/orders.parquet"), TimeSlicer("month"), "o_orderdate").rows


# Features

_query("profile_weighted", f"WITH {_HOURLY} SELECT slice_id, 't' || f AS feature, round(v * CASE f % 5 WHEN 0 THEN 0.5 WHEN 4 THEN 2.0 ELSE 1.0 END, 6) AS value FROM x")(
    lambda spark, d: _long(DirectProfileFeatureEngineer({"click": 0.5, "view": 2.0}).calc_and_get_features_df(_events(spark, d)))
)
_query("feature_pipeline", f"""{_STATS}, z AS (
        SELECT slice_id, feature, coalesce((value - avg(value) OVER w) / CASE WHEN stddev_samp(value) OVER w = 0 THEN 1.0 ELSE stddev_samp(value) OVER w END, 0.0) AS value FROM features WINDOW w AS (PARTITION BY feature))
    SELECT slice_id, feature, round(value, 6) AS value FROM z UNION ALL SELECT slice_id, 't' || f, round(v, 6) FROM x""")(
    lambda spark, d: _long(FeaturePipeline({"stats": StandardStatsFeatureEngineer(), "profile": DirectProfileFeatureEngineer()}).calc_and_get_features_df(_events(spark, d)))
)

# Scores


def _wasserstein_sql(name: str = "score", weight: str = "1.0", series: str = _DAILY, candidates: str = "three") -> str:
    """combo_id and a score by Wasserstein distance, as a chain of common tables that ends in w1."""
    return f"""WITH {series},
    grid AS (SELECT variable, value, count(*) AS n FROM obs GROUP BY 1, 2),
    full_cdf AS (SELECT variable, value, sum(n) OVER (PARTITION BY variable ORDER BY value) / sum(n) OVER (PARTITION BY variable) AS cdf, coalesce(lead(value) OVER (PARTITION BY variable ORDER BY value) - value, 0.0) AS gap FROM grid),
    cells AS (SELECT c.combo_id, g.variable, g.value, g.cdf, g.gap, coalesce(o.n, 0) AS n FROM {candidates} c CROSS JOIN full_cdf g
        LEFT JOIN (SELECT combo_id, variable, value, count(*) AS n FROM own GROUP BY 1, 2, 3) o ON o.combo_id = c.combo_id AND o.variable = g.variable AND o.value = g.value),
    steps AS (SELECT combo_id, variable, abs(sum(n) OVER (PARTITION BY combo_id, variable ORDER BY value) / sum(n) OVER (PARTITION BY combo_id, variable) - cdf) * gap AS s FROM cells),
    w1 AS (SELECT combo_id, sum({weight} * s / w) AS {name} FROM steps JOIN spread USING (variable) GROUP BY combo_id)"""


_CORRELATION = """pairs AS (SELECT a.slice_id, a.ts, a.variable AS v, b.variable AS w, a.value AS x, b.value AS y FROM obs a JOIN obs b ON a.ts = b.ts AND a.variable < b.variable),
    f AS (SELECT v, w, corr(x, y) AS r FROM pairs GROUP BY 1, 2),
    o AS (SELECT combo_id, v, w, corr(x, y) AS r FROM members JOIN pairs USING (slice_id) GROUP BY 1, 2, 3),
    c1 AS (SELECT combo_id, sqrt(2 * sum((o.r - f.r) * (o.r - f.r))) / (sqrt(3 + 2 * sum(f.r * f.r)) + 1e-12) AS correlation FROM o JOIN f USING (v, w) GROUP BY combo_id)"""

_query("score_weighted", _wasserstein_sql(weight="CASE variable WHEN 'qty' THEN 2.0 WHEN 'disc' THEN 0.5 ELSE 0.0 END") + " SELECT combo_id, round(score, 6) AS score FROM w1")(
    lambda spark, d: _scored(WassersteinFidelity({"qty": 2.0, "disc": 0.5}), _shipments(spark, d), 3)  # a variable left out weighs 0
)


@_query("objective_set", f"{_wasserstein_sql('wasserstein')}, {_CORRELATION} SELECT combo_id, round(wasserstein, 6) AS wasserstein, round(correlation, 6) AS correlation FROM w1 JOIN c1 USING (combo_id)")
def objective_set(spark, d):
    context = _shipments(spark, d)
    objectives = ObjectiveSet({"w": (1.0, WassersteinFidelity()), "c": (0.5, CorrelationFidelity())})
    objectives.prepare(context)
    return objectives.evaluate_all(ExhaustiveCombiGen(3).generate(context)).select("combo_id", _r("wasserstein").alias("wasserstein"), _r("correlation").alias("correlation"))


#: Warping, one cell of the table of all pairs per round: costs is the row-major list of n x n costs.
_WARPED = """cells AS (
        SELECT key, costs, n, 0 AS t, CAST([] AS DOUBLE[]) AS before, CAST([] AS DOUBLE[]) AS now FROM warp
        UNION ALL
        SELECT key, costs, n, t + 1, CASE WHEN (t + 1) % n = 0 THEN grown ELSE before END, CASE WHEN (t + 1) % n = 0 THEN [] ELSE grown END
        FROM (SELECT *, list_append(now, costs[t + 1] + CASE WHEN t = 0 THEN 0.0 ELSE least(coalesce(before[t % n + 1], 'inf'::DOUBLE), coalesce(CASE WHEN t % n > 0 THEN before[t % n] END, 'inf'::DOUBLE), coalesce(CASE WHEN t % n > 0 THEN now[t % n] END, 'inf'::DOUBLE)) END) AS grown
              FROM cells WHERE t < n * n)),
    warped AS (SELECT key, before[n] AS d FROM cells WHERE t = n * n)"""

_query("score_diurnal_dtw", f"""WITH RECURSIVE {_HOURLY}, f AS (SELECT variable, hour(ts) AS h, avg(value) AS a FROM obs GROUP BY 1, 2),
    o AS (SELECT combo_id, variable, hour(ts) AS h, avg(value) AS b FROM members JOIN obs USING (slice_id) GROUP BY 1, 2, 3),
    warp AS (SELECT {{'c': combo_id, 'v': o.variable}} AS key, list(abs(f.a - o.b) ORDER BY f.h, o.h) AS costs, 24 AS n FROM o JOIN f USING (variable) GROUP BY combo_id, o.variable),
    {_WARPED}, dev AS (SELECT variable, CASE WHEN coalesce(stddev_samp(a), 0) = 0 THEN 1.0 ELSE stddev_samp(a) END AS dev FROM f GROUP BY variable)
    SELECT key.c AS combo_id, round(sum(d / dev), 6) AS score FROM warped JOIN dev ON variable = key.v GROUP BY key.c""")(lambda spark, d: _scored(DiurnalDTWFidelity(), _events(spark, d), 2))

_query("score_dtw", f"""WITH RECURSIVE {_HOURLY}, n AS (SELECT slice_id, ts, variable, value, hour(ts) AS h FROM obs),
    c AS (SELECT a.slice_id AS i, b.slice_id AS j, a.h AS p, b.h AS q, sum((a.value - b.value) * (a.value - b.value)) AS c FROM n a JOIN n b ON a.slice_id < b.slice_id AND a.variable = b.variable GROUP BY ALL),
    warp AS (SELECT {{'i': i, 'j': j}} AS key, list(c ORDER BY p, q) AS costs, 24 AS n FROM c GROUP BY i, j), {_WARPED},
    sides AS (SELECT key.i AS i, key.j AS j, sqrt(d) AS d FROM warped UNION ALL SELECT key.j, key.i, sqrt(d) FROM warped),
    near AS (SELECT combo_id, b.i, min(d) AS d FROM two JOIN sides b ON b.j IN (two.i, two.j) WHERE b.i NOT IN (two.i, two.j) GROUP BY 1, 2)
    SELECT combo_id, round(avg(d), 6) AS score FROM near GROUP BY combo_id""")(lambda spark, d: _scored(DTWFidelity(), _events(spark, d), 2))

# Candidates, policies and experiments

_SEASON = "m AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS label, ['winter', 'spring', 'summer', 'fall'][month(l_shipdate) % 12 // 3 + 1] AS season FROM lineitem WHERE year(l_shipdate) = 1996)"


@_query("combos_four_seasons", f"""WITH {_SEASON}, s AS (SELECT list_sort([a.label, b.label, c.label, e.label]) AS l FROM m a, m b, m c, m e WHERE a.season = 'winter' AND b.season = 'spring' AND c.season = 'summer' AND e.season = 'fall')
    SELECT CAST(row_number() OVER (ORDER BY l) - 1 AS BIGINT) AS combo_id, array_to_string(l, ', ') AS label FROM s""")
def combos_four_seasons(spark, d):
    """One month of each season: 81 candidates of a year."""
    df = daily_shipments(spark, d, 1996)
    generator = GroupQuotaHierarchicalCombiGen.from_slicers_with_seasons(4, df, TimeSlicer("month"), {"winter": 1, "spring": 1, "summer": 1, "fall": 1})
    return generator.generate(ProblemContext(df, TimeSlicer("month"))).select("combo_id", "label")


@_query("combos_quota_hierarchical", """WITH c AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS label, strftime(l_shipdate, '%Y') AS parent FROM lineitem),
    p AS (SELECT DISTINCT parent FROM c), s AS (SELECT a.parent AS a, b.parent AS b FROM p a JOIN p b ON a.parent < '1998' AND b.parent >= '1998')
    SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS BIGINT) AS combo_id, string_agg(label, ', ' ORDER BY label) AS label FROM s JOIN c ON c.parent IN (a, b) GROUP BY a, b""")
def combos_quota_hierarchical(spark, d):
    """All months of one early and one late year."""
    df = daily_shipments(spark, d)
    years = TimeSlicer("year").unique_slices(df)
    groups = {r["slice_label"]: "early" if r["slice_label"] < "1998" else "late" for r in years.collect()}
    generator = GroupQuotaHierarchicalCombiGen.from_slicers(2, df, TimeSlicer("month"), TimeSlicer("year"), groups, {"early": 1, "late": 1})
    return generator.generate(ProblemContext(df, TimeSlicer("month"))).select("combo_id", "label")


@_query("policy_tie_breakers", f"WITH {_SUPPLIERS} SELECT combo_id FROM y ORDER BY round(y3, 2) DESC, y1, combo_id LIMIT 1")
def policy_tie_breakers(spark, d):
    """All candidates tie in the weighted sum; the tax, rounded, decides, then the discount."""
    policy = WeightedSumPolicy({"discount": 0.0, "quantity": 0.0, "tax": 0.0}, tie_breakers=("level", "discount"), tie_dirs=("max", "min"))
    return policy.select_best(_suppliers(spark, d).withColumn("level", F.round("tax", 2)), _OBJECTIVES).select("combo_id")


_query("policy_pareto_euclidean", f"WITH {_SUPPLIERS}, {_NORMAL}, ideal AS (SELECT min(z1) AS i1, min(z2) AS i2, min(z3) AS i3 FROM z WHERE feasible) SELECT combo_id, round(sqrt((z1 - i1) ** 2 + (z2 - i2) ** 2 + (z3 - i3) ** 2), 6) AS policy_score FROM z, ideal")(
    lambda spark, d: ParetoUtopiaPolicy(fairness_constraints={"discount": 0.06}, distance="euclidean").rank_all(_suppliers(spark, d), _OBJECTIVES).select("combo_id", _r("policy_score").alias("policy_score"))
)


@_query("diag_pareto_selected", f"""WITH {_SUPPLIERS}, {_NORMAL}, ideal AS (SELECT min(z1) AS i1, min(z2) AS i2, min(z3) AS i3 FROM z WHERE feasible),
    best AS (SELECT combo_id FROM z, ideal WHERE combo_id IN (SELECT combo_id FROM front) ORDER BY greatest(abs(z1 - i1), abs(z2 - i2), abs(z3 - i3)), combo_id LIMIT 1)
    SELECT combo_id, CASE WHEN combo_id IN (SELECT combo_id FROM best) THEN 'Selected' WHEN NOT feasible THEN 'Infeasible' WHEN combo_id IN (SELECT combo_id FROM front) THEN 'Pareto' ELSE 'Dominated' END AS category FROM y""")
def diag_pareto_selected(spark, d):
    policy, table = ParetoUtopiaPolicy(fairness_constraints={"discount": 0.06}), _suppliers(spark, d).persist()
    best = policy.select_best(table, _OBJECTIVES).first()["combo_id"]
    return diag.pareto_categories(policy.rank_all(table, _OBJECTIVES), _OBJECTIVES, best).select("combo_id", "category")


_MONTHLY = _DAILY.replace("date_trunc('year', ts)", "date_trunc('month', ts)").replace(_DAILY[_DAILY.index("    three AS (") : _DAILY.index("    spread AS")], """    three AS (SELECT CAST(row_number() OVER (ORDER BY a.slice_id, b.slice_id) - 1 AS BIGINT) AS combo_id, a.slice_id AS i, b.slice_id AS j FROM years a JOIN years b ON a.slice_id < b.slice_id),
    members AS (SELECT combo_id, i AS slice_id FROM three UNION ALL SELECT combo_id, j FROM three),
""")
QUERIES["experiment_months"] = months_experiment
ORACLES["experiment_months"] = f"""{_wasserstein_sql('wasserstein', series=_MONTHLY)}, {_CORRELATION},
    best AS (SELECT combo_id FROM w1 JOIN c1 USING (combo_id) ORDER BY wasserstein + correlation, combo_id LIMIT 1)
    SELECT slice_id AS rep_slice_id, any_value(strftime(ts, '%Y-%m')) AS slice_label, 0.5 AS weight FROM members JOIN best USING (combo_id) JOIN obs USING (slice_id) GROUP BY slice_id"""


def _candidates_scored(spark: SparkSession, d: str, k: int, quota: dict[str, int] | None) -> DataFrame:
    """Wasserstein and correlation of month sets of 1996."""
    df = daily_shipments(spark, d, 1996)
    context = ProblemContext(df, TimeSlicer("month"))
    generator = GroupQuotaHierarchicalCombiGen.from_slicers_with_seasons(k, df, TimeSlicer("month"), quota) if quota else ExhaustiveCombiGen(k)
    objectives = ObjectiveSet({"w": (1.0, WassersteinFidelity()), "c": (1.0, CorrelationFidelity())})
    objectives.prepare(context)
    return objectives.evaluate_all(generator.generate(context)).select("combo_id", _r("wasserstein").alias("wasserstein"), _r("correlation").alias("correlation"))


_YEAR = _MONTHLY.replace("FROM lineitem GROUP BY 1", "FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1")
_FOUR = _YEAR.replace(_YEAR[_YEAR.index("    three AS (") : _YEAR.index("    spread AS")], """    three AS (SELECT CAST(row_number() OVER (ORDER BY a.slice_id, b.slice_id, c.slice_id, e.slice_id) - 1 AS BIGINT) AS combo_id, [a.slice_id, b.slice_id, c.slice_id, e.slice_id] AS l
        FROM years a JOIN years b ON a.slice_id < b.slice_id JOIN years c ON b.slice_id < c.slice_id JOIN years e ON c.slice_id < e.slice_id),
    members AS (SELECT combo_id, unnest(l) AS slice_id FROM three),
""")
_query("months_exhaustive", f"{_wasserstein_sql('wasserstein', series=_FOUR)}, {_CORRELATION} SELECT combo_id, round(wasserstein, 6) AS wasserstein, round(correlation, 6) AS correlation FROM w1 JOIN c1 USING (combo_id)")(lambda spark, d: _candidates_scored(spark, d, 4, None))
_SEASONAL = _FOUR.replace("JOIN years e ON c.slice_id < e.slice_id)", "JOIN years e ON c.slice_id < e.slice_id WHERE list_sort([(a.slice_id + 1) % 12 // 3, (b.slice_id + 1) % 12 // 3, (c.slice_id + 1) % 12 // 3, (e.slice_id + 1) % 12 // 3]) = [0, 1, 2, 3])")
_query("months_seasonal", f"{_wasserstein_sql('wasserstein', series=_SEASONAL)}, {_CORRELATION} SELECT combo_id, round(wasserstein, 6) AS wasserstein, round(correlation, 6) AS correlation FROM w1 JOIN c1 USING (combo_id)")(
    lambda spark, d: _candidates_scored(spark, d, 4, {"winter": 1, "spring": 1, "summer": 1, "fall": 1})
)

# Searches and weights


@_query("snippet_best", f"""WITH {_HOURLY}, w AS (SELECT unnest(range(24)) AS w), dw AS (SELECT i, w, min(d * d) AS d FROM dist JOIN w ON j BETWEEN w AND w + 6 GROUP BY i, w),
    one AS (SELECT w FROM dw GROUP BY w ORDER BY sum(d), w LIMIT 1), now AS (SELECT i, d FROM dw JOIN one USING (w)),
    second AS (SELECT dw.w FROM dw JOIN now USING (i) WHERE dw.w NOT IN (SELECT w FROM one) GROUP BY dw.w ORDER BY sum(least(dw.d, now.d)), dw.w LIMIT 1),
    c AS (SELECT w, 0 AS pos FROM one UNION ALL SELECT w, 1 FROM second)
    SELECT i, CAST(arg_min(dw.w, {{'d': d, 'p': pos}}) AS INTEGER) AS w, round(min(d), 4) AS d FROM dw JOIN c USING (w) GROUP BY i""")
def snippet_best(spark, d):
    return SnippetSearch(2, first_pick="best").find_selection(_profiled(spark, d)).diagnostics["assignment"].select("i", "w", _r("d", 4).alias("d"))


@_query("snippet_k3", f"""WITH {_HOURLY}, w AS (SELECT unnest(range(24)) AS w), dw AS (SELECT i, w, min(d * d) AS d FROM dist JOIN w ON j BETWEEN w AND w + 6 GROUP BY i, w),
    now AS (SELECT i, d FROM dw WHERE w = 0), second AS (SELECT dw.w FROM dw JOIN now USING (i) WHERE w > 0 GROUP BY dw.w ORDER BY sum(least(dw.d, now.d)), dw.w LIMIT 1),
    later AS (SELECT i, min(d) AS d FROM dw WHERE w = 0 OR w IN (SELECT w FROM second) GROUP BY i),
    third AS (SELECT dw.w FROM dw JOIN later USING (i) WHERE dw.w > 0 AND dw.w NOT IN (SELECT w FROM second) GROUP BY dw.w ORDER BY sum(least(dw.d, later.d)), dw.w LIMIT 1),
    c AS (SELECT 0 AS w, 0 AS pos UNION ALL SELECT w, 1 FROM second UNION ALL SELECT w, 2 FROM third)
    SELECT i, CAST(arg_min(dw.w, {{'d': d, 'p': pos}}) AS INTEGER) AS w, round(min(d), 4) AS d FROM dw JOIN c USING (w) GROUP BY i""")
def snippet_k3(spark, d):
    return SnippetSearch(3).find_selection(_profiled(spark, d)).diagnostics["assignment"].select("i", "w", _r("d", 4).alias("d"))


_BLENDED = ORACLES["weights_blended_k2"]


def _blended_k2(spark: SparkSession, d: str) -> DataFrame:
    model = BlendedRepresentationModel()
    model.fit(_profiled(spark, d))
    return model.weigh(DAYS[:2])


_query("weights_aggregated", f"SELECT rep_slice_id, round(sum(weight) / 30, 3) AS weight FROM ({_BLENDED}) GROUP BY rep_slice_id")(lambda spark, d: aggregated(_blended_k2(spark, d)).select("rep_slice_id", _r("weight", 3).alias("weight")))
_query("diag_responsibility", f"SELECT rep_slice_id, round(sum(weight), 2) AS weight, 0.5 AS uniform FROM ({_BLENDED}) GROUP BY rep_slice_id")(lambda spark, d: diag.responsibility(_blended_k2(spark, d)).select("rep_slice_id", _r("weight", 2).alias("weight"), "uniform"))

# Charts

for _n in (2, 3, 5):
    _names = [f"mean__{v}" for v in EVENT_TYPES[:_n]]
    _query(f"diag_scatter_{_n}", f"{_FEATURES} SELECT m.slice_id, label AS slice_label, " + ", ".join(f"round(max(value) FILTER (WHERE feature = '{n}'), 6) AS \"{n}\"" for n in _names) + f", label IN {DAYS} AS is_selected FROM m JOIN labels USING (slice_id) GROUP BY m.slice_id, label")(
        lambda spark, d, names=_names: diag.feature_scatter(_means(spark, d), names, DAYS).select("slice_id", "slice_label", *[_r(n).alias(n) for n in names], "is_selected")
    )
_query("diag_selection_comparison", f"""{_FEATURES}, named AS (SELECT 'one' AS selection, unnest({list(DAYS)}) AS label UNION ALL SELECT 'two', unnest({list(DAYS[:2])}))
    SELECT selection, label AS slice_label, round(max(value) FILTER (WHERE feature = 'mean__click'), 6) AS mean__click, round(max(value) FILTER (WHERE feature = 'mean__view'), 6) AS mean__view FROM named JOIN labels USING (label) JOIN m USING (slice_id) GROUP BY 1, 2""")(
    lambda spark, d: diag.selection_comparison(_means(spark, d), ["mean__click", "mean__view"], {"one": DAYS, "two": DAYS[:2]}).select("selection", "slice_label", _r("mean__click").alias("mean__click"), _r("mean__view").alias("mean__view"))
)
_query("diag_kendall", f"""{_FEATURES}, p AS (SELECT a.feature AS a, b.feature AS b, sign(a.value - c.value) AS x, sign(b.value - e.value) AS y
        FROM m a JOIN m b ON a.slice_id = b.slice_id AND a.feature > b.feature JOIN m c ON c.feature = a.feature AND c.slice_id > a.slice_id JOIN m e ON e.feature = b.feature AND e.slice_id = c.slice_id)
    SELECT a, b, round(sum(x * y) / sqrt(sum(abs(x)) * sum(abs(y))), 6) AS r FROM p GROUP BY a, b""")(lambda spark, d: diag.feature_correlation(_means(spark, d), method="kendall", lower=True).select("a", "b", _r("r").alias("r")))
_query("diag_feature_distributions", f"""{_FEATURES}, b AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM m GROUP BY 1)
    SELECT feature, CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS height FROM m JOIN b USING (feature) GROUP BY 1, 2""")(lambda spark, d: diag.feature_distributions(_means(spark, d)).select("feature", "bin", "height"))
for _norm, _height in (("percent", "100 * count(*) / any_value(n)"), ("density", "count(*) / any_value(n) / any_value((hi - lo) / 20)"), ("", "CAST(count(*) AS DOUBLE)")):
    _query(f"diag_histogram_{_norm or 'count'}", f"""{_SOURCES}, b AS (SELECT source, variable, min(value) AS lo, max(value) AS hi, count(*) AS n FROM src GROUP BY 1, 2)
        SELECT source, variable, CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, round({_height}, 6) AS height FROM src JOIN b USING (source, variable) GROUP BY 1, 2, 3""")(
        lambda spark, d, norm=_norm: diag.distribution_histogram(_events(spark, d), DAYS, norm=norm).select("source", "variable", "bin", _r("height").alias("height"))
    )
_query("diag_score_contributions", f"{_wasserstein_sql('wasserstein')}, {_CORRELATION}, s AS (SELECT wasserstein AS w, correlation AS c FROM w1 JOIN c1 USING (combo_id) WHERE combo_id = 0) SELECT 'wasserstein' AS score, round(w, 6) AS value, round(w / (w + c), 6) AS share FROM s UNION ALL SELECT 'correlation', round(c, 6), round(c / (w + c), 6) FROM s")(
    lambda spark, d: diag.score_contributions(spark, _first_scores(spark, d)).select("score", _r("value").alias("value"), _r("share").alias("share"))
)


def _first_scores(spark: SparkSession, d: str) -> dict[str, float]:
    """Scores of the first three years, by the components' own evaluation of one selection."""
    context = _shipments(spark, d)
    objectives = ObjectiveSet({"w": (1.0, WassersteinFidelity()), "c": (1.0, CorrelationFidelity())})
    objectives.prepare(context)
    return objectives.evaluate(tuple(context.get_unique_slices()[:3]))


@_query("diag_pca_variance")
def diag_pca_variance(spark, d):
    """Shares of variance of the components of the days' statistics."""
    context, engineer = _events(spark, d), PCAFeatureEngineer()
    FeaturePipeline({"stats": StandardStatsFeatureEngineer(), "pca": engineer}).run(context)
    return diag.pca_variance(context, engineer)


#: Eight scores of all sets of three days, each in a WITH of its own.
_ALL_SCORES = f"""
    WITH {_HOURLY.replace("members AS", "pair_members AS")},
    three AS (
        SELECT CAST(row_number() OVER (ORDER BY a.slice_id, b.slice_id, c.slice_id) - 1 AS BIGINT) AS combo_id, [a.slice_id, b.slice_id, c.slice_id] AS ids, a.label || ', ' || b.label || ', ' || c.label AS label
        FROM labels a JOIN labels b ON a.slice_id < b.slice_id JOIN labels c ON b.slice_id < c.slice_id),
    members AS (SELECT combo_id, unnest(ids) AS slice_id FROM three),
    own AS (SELECT combo_id, variable, hour(ts) AS h, ts, value FROM members JOIN obs USING (slice_id)),
    spread AS (SELECT variable, CASE WHEN quantile_cont(value, 0.75) = quantile_cont(value, 0.25) THEN 1.0 ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS w FROM obs GROUP BY 1),
    wasserstein AS (
        WITH f AS (SELECT variable, value, sum(count(*)) OVER (PARTITION BY variable ORDER BY value) / sum(count(*)) OVER (PARTITION BY variable) AS cdf, coalesce(lead(value) OVER (PARTITION BY variable ORDER BY value) - value, 0.0) AS gap FROM obs GROUP BY variable, value),
        n AS (SELECT combo_id, variable, value, count(*) AS n FROM own GROUP BY 1, 2, 3),
        steps AS (SELECT c.combo_id, f.variable, abs(sum(coalesce(n, 0)) OVER (PARTITION BY c.combo_id, f.variable ORDER BY f.value) / 72 - cdf) * gap AS s FROM three c CROSS JOIN f LEFT JOIN n ON n.combo_id = c.combo_id AND n.variable = f.variable AND n.value = f.value)
        SELECT combo_id, sum(s / w) AS score FROM steps JOIN spread USING (variable) GROUP BY combo_id),
    correlation AS (
        WITH p AS (SELECT a.slice_id, a.variable AS v, b.variable AS u, a.value AS x, b.value AS y FROM obs a JOIN obs b ON a.ts = b.ts AND a.variable < b.variable),
        f AS (SELECT v, u, corr(x, y) AS r FROM p GROUP BY 1, 2),
        o AS (SELECT combo_id, v, u, corr(x, y) AS r FROM members JOIN p USING (slice_id) GROUP BY 1, 2, 3)
        SELECT combo_id, sqrt(2 * sum((o.r - f.r) * (o.r - f.r))) / (sqrt(5 + 2 * sum(f.r * f.r)) + 1e-12) AS score FROM o JOIN f USING (v, u) GROUP BY combo_id),
    nrmse AS (
        WITH f AS (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY variable) AS n, avg(value) OVER (PARTITION BY variable) AS mean FROM obs),
        o AS (SELECT combo_id, variable, list(value ORDER BY value) AS v FROM own GROUP BY 1, 2),
        e AS (SELECT o.combo_id, f.variable, any_value(f.n) AS n, any_value(f.mean) AS mean, sum(power(v[1 + CAST(floor(i * 71.0 / (n - 1)) AS BIGINT)] + (i * 71.0 / (n - 1) - floor(i * 71.0 / (n - 1))) * (v[least(2 + CAST(floor(i * 71.0 / (n - 1)) AS BIGINT), 72)] - v[1 + CAST(floor(i * 71.0 / (n - 1)) AS BIGINT)]) - value, 2)) AS q FROM o JOIN f USING (variable) GROUP BY 1, 2)
        SELECT combo_id, sum(sqrt(q / n) / (mean + 1e-12)) AS score FROM e GROUP BY combo_id),
    curve AS (
        WITH f AS (SELECT variable, unnest(quantile_cont(value, {_POINTS})) AS q, unnest(range(21)) AS i FROM obs GROUP BY variable),
        o AS (SELECT combo_id, variable, unnest(quantile_cont(value, {_POINTS})) AS q, unnest(range(21)) AS i FROM own GROUP BY combo_id, variable),
        e AS (SELECT combo_id, variable, sqrt(sum((o.q - f.q) * (o.q - f.q)) / 21) AS e FROM o JOIN f USING (variable, i) GROUP BY 1, 2)
        SELECT combo_id, sum(e / w) AS score FROM e JOIN spread USING (variable) GROUP BY combo_id),
    diurnal AS (
        WITH f AS (SELECT variable, hour(ts) AS h, avg(value) AS a FROM obs GROUP BY 1, 2),
        o AS (SELECT combo_id, variable, h, avg(value) AS b FROM own GROUP BY 1, 2, 3),
        e AS (SELECT combo_id, variable, avg((a - b) * (a - b)) AS e, avg(a * a) AS s FROM o JOIN f USING (variable, h) GROUP BY 1, 2)
        SELECT combo_id, avg(e) / (avg(s) + 1e-12) AS score FROM e GROUP BY combo_id),
    diversity AS (SELECT a.combo_id, avg(d) AS score FROM members a JOIN members b ON a.combo_id = b.combo_id AND a.slice_id < b.slice_id JOIN dist ON i = a.slice_id AND j = b.slice_id GROUP BY 1),
    centroid AS (WITH c AS (SELECT combo_id, f, avg(v) AS m FROM members JOIN x USING (slice_id) GROUP BY 1, 2) SELECT combo_id, sqrt(sum(m * m)) AS score FROM c GROUP BY combo_id),
    coverage AS (
        WITH mass AS (SELECT j AS slice_id, sum(exp(-1e-7 * d * d)) AS mass FROM dist GROUP BY j),
        h AS (SELECT combo_id, mass / sum(mass) OVER (PARTITION BY combo_id) - 1.0 / 3 AS e FROM members JOIN mass USING (slice_id))
        SELECT combo_id, sqrt(sum(e * e)) AS score FROM h GROUP BY combo_id)
    SELECT combo_id, label, round(wasserstein.score, 4) AS wasserstein, round(correlation.score, 4) AS correlation, round(nrmse.score, 4) AS nrmse, round(curve.score, 4) AS nrmse_duration_curve,
           round(diurnal.score, 4) AS diurnal, round(diversity.score, 4) AS diversity, round(centroid.score, 4) AS centroid_balance, round(coverage.score, 4) AS coverage_balance
    FROM three JOIN wasserstein USING (combo_id) JOIN correlation USING (combo_id) JOIN nrmse USING (combo_id) JOIN curve USING (combo_id)
    JOIN diurnal USING (combo_id) JOIN diversity USING (combo_id) JOIN centroid USING (combo_id) JOIN coverage USING (combo_id)"""


@_query("scores_all", _ALL_SCORES)
def scores_all(spark, d):
    """All additive scores of all 4,060 sets of three days."""
    scores, objectives = _scores_of_days(spark, d), _all_additive()
    return scores.select("combo_id", "label", *[_r(n, 4).alias(n) for n in objectives.specs])


def _scores_of_days(spark, d):
    context = _profiled(spark, d)
    objectives = _all_additive()
    objectives.prepare(context)
    return objectives.evaluate_all(ExhaustiveCombiGen(3).generate(context)).drop("slice_ids")


def _all_additive() -> ObjectiveSet:
    parts = (WassersteinFidelity(), CorrelationFidelity(), NRMSEFidelity(), DurationCurveFidelity(21), DiurnalFidelity(), DiversityReward(), CentroidBalance(), CoverageBalance(1e-7))
    return ObjectiveSet({c.name: (1.0, c) for c in parts})


@_query("pareto_all")
def pareto_all(spark, d):
    """The Pareto front over these scores."""
    return ParetoUtopiaPolicy().rank_all(stored(_scores_of_days(spark, d), "scored"), _all_additive()).select("combo_id", "label", "pareto_mask", "policy_score")
