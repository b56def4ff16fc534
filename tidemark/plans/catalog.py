"""The library's queries over the star-schema tables, and the SQL that gives the same rows.

Series: hourly sums of events by type (slices: days or weeks) and daily shipments (slices:
years or months). Policies rank suppliers by their line items. Doubles are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import diagnostics as diag
from tidemark.operators.combos import ExhaustiveCombiGen, ExhaustiveHierarchicalCombiGen, GroupQuotaCombiGen, GroupQuotaHierarchicalCombiGen, members_of
from tidemark.operators.features import DirectProfileFeatureEngineer, FeaturePipeline, PCAFeatureEngineer, StandardStatsFeatureEngineer, slice_stats
from tidemark.operators.policies import ObjectiveSet, ParetoMaxMinStrategy, ParetoUtopiaPolicy, WeightedSumPolicy
from tidemark.operators.represent import BlendedRepresentationModel, KMedoidsClustersizeRepresentation, UniformRepresentationModel
from tidemark.operators.scores import CentroidBalance, CorrelationFidelity, CoverageBalance, DiurnalFidelity, DiversityReward, DurationCurveFidelity, NRMSEFidelity, ScoreComponent, WassersteinFidelity
from tidemark.operators.search import CTPCSearch, HullClusteringSearch, KMedoidsSearch, ObjectiveDrivenCombinatorialSearchAlgorithm, SnippetSearch, cluster_table
from tidemark.plans.context import UNITS, ProblemContext, TimeSlicer
from tidemark.plans.experiment import RepSetExperiment, Workflow, representatives_of
from tidemark.sources.series import EVENT_TYPES, daily_shipments, hourly_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAYS = ("2024-01-05", "2024-01-16", "2024-01-28")

_HOURLY = """
    span AS (SELECT CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS a, CAST(date_trunc('day', max(ts)) AS TIMESTAMP) + INTERVAL 23 HOUR AS b FROM events),
    spine AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM span),
    kinds AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS variable),
    sums AS (SELECT date_trunc('hour', ts) AS ts, event_type AS variable, sum(value) AS s FROM events GROUP BY 1, 2),
    obs AS (
        SELECT CAST(dense_rank() OVER (ORDER BY date_trunc('day', spine.ts)) - 1 AS INTEGER) AS slice_id, spine.ts, kinds.variable, coalesce(s, 0.0) AS value
        FROM spine CROSS JOIN kinds LEFT JOIN sums ON sums.ts = spine.ts AND sums.variable = kinds.variable),
    x AS (SELECT slice_id, row_number() OVER (PARTITION BY slice_id ORDER BY ts, variable) - 1 AS f, value AS v FROM obs),
    dist AS (SELECT a.slice_id AS i, b.slice_id AS j, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d FROM x a JOIN x b ON a.f = b.f GROUP BY 1, 2),
    labels AS (SELECT DISTINCT slice_id, strftime(ts, '%Y-%m-%d') AS label FROM obs),
    two AS (SELECT CAST(row_number() OVER (ORDER BY a.slice_id, b.slice_id) - 1 AS BIGINT) AS combo_id, a.slice_id AS i, b.slice_id AS j FROM labels a JOIN labels b ON a.slice_id < b.slice_id),
    members AS (SELECT combo_id, i AS slice_id FROM two UNION ALL SELECT combo_id, j FROM two)"""

_DAILY = """
    daily AS (SELECT date_trunc('day', l_shipdate) AS ts, sum(l_quantity) AS qty, sum(l_extendedprice) AS price, avg(l_discount) AS disc FROM lineitem GROUP BY 1),
    long AS (SELECT ts, 'qty' AS variable, qty AS value FROM daily UNION ALL SELECT ts, 'price', price FROM daily UNION ALL SELECT ts, 'disc', disc FROM daily),
    obs AS (SELECT CAST(dense_rank() OVER (ORDER BY date_trunc('year', ts)) - 1 AS INTEGER) AS slice_id, * FROM long),
    years AS (SELECT DISTINCT slice_id FROM obs),
    three AS (
        SELECT CAST(row_number() OVER (ORDER BY a.slice_id, b.slice_id, c.slice_id) - 1 AS BIGINT) AS combo_id, a.slice_id AS i, b.slice_id AS j, c.slice_id AS k
        FROM years a JOIN years b ON a.slice_id < b.slice_id JOIN years c ON b.slice_id < c.slice_id),
    members AS (SELECT combo_id, i AS slice_id FROM three UNION ALL SELECT combo_id, j FROM three UNION ALL SELECT combo_id, k FROM three),
    spread AS (SELECT variable, CASE WHEN quantile_cont(value, 0.75) = quantile_cont(value, 0.25) THEN 1.0 ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS w FROM obs GROUP BY 1),
    own AS (SELECT combo_id, variable, value FROM members JOIN obs USING (slice_id))"""

_SUPPLIERS = """
    scores AS (SELECT l_suppkey AS combo_id, avg(l_discount) AS discount, sum(l_quantity) AS quantity, avg(l_tax) AS tax FROM lineitem GROUP BY 1),
    y AS (SELECT combo_id, discount AS y1, -quantity AS y2, tax AS y3, discount <= 0.06 AS feasible FROM scores)"""

_NORMAL = """
    q AS (SELECT quantile_cont(y1, 0.05) AS l1, quantile_cont(y1, 0.95) AS h1, quantile_cont(y2, 0.05) AS l2, quantile_cont(y2, 0.95) AS h2, quantile_cont(y3, 0.05) AS l3, quantile_cont(y3, 0.95) AS h3 FROM y),
    z AS (SELECT y.*, greatest((y1 - l1) / (h1 - l1), 0.0) AS z1, greatest((y2 - l2) / (h2 - l2), 0.0) AS z2, greatest((y3 - l3) / (h3 - l3), 0.0) AS z3 FROM y, q),
    front AS (
        SELECT combo_id FROM y b WHERE feasible AND NOT EXISTS (
            SELECT 1 FROM y a WHERE a.feasible AND a.y1 <= b.y1 + 1e-9 AND a.y2 <= b.y2 + 1e-9 AND a.y3 <= b.y3 + 1e-9
            AND (a.y1 < b.y1 - 1e-9 OR a.y2 < b.y2 - 1e-9 OR a.y3 < b.y3 - 1e-9)))"""


def _query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def _r(column, digits: int = 6):
    return F.round(column, digits)


def _events(spark: SparkSession, d: str, unit: str = "day") -> ProblemContext:
    return ProblemContext(hourly_events(spark, d), TimeSlicer(unit))


def _profiled(spark: SparkSession, d: str) -> ProblemContext:
    return DirectProfileFeatureEngineer().run(_events(spark, d))


def _shipments(spark: SparkSession, d: str, unit: str = "year") -> ProblemContext:
    return ProblemContext(daily_shipments(spark, d), TimeSlicer(unit))


_FORMATS = {"year": "strftime(ts, '%Y')", "month": "strftime(ts, '%Y-%m')", "day": "strftime(ts, '%Y-%m-%d')", "hour": "strftime(ts, '%Y-%m-%d %H:00:00')", "week": "strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d')"}
for _unit in UNITS:
    _query(f"slice_labels_{_unit}", f"SELECT event_id, CAST(date_trunc('{_unit}', ts) AS TIMESTAMP) AS slice_start, {_FORMATS[_unit]} AS slice_label FROM events")(
        lambda spark, d, unit=_unit: TimeSlicer(unit).labels_for_index(spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts")).drop("ts")
    )


@_query("unique_slices", "SELECT CAST(row_number() OVER (ORDER BY date_trunc('day', ts)) - 1 AS INTEGER) AS slice_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS slice_start, strftime(date_trunc('day', ts), '%Y-%m-%d') AS slice_label, count(*) AS n_rows FROM events GROUP BY date_trunc('day', ts)")
def unique_slices(spark, d):
    return TimeSlicer("day").unique_slices(spark.read.parquet(f"{d}/events.parquet"))


@_query("slice_filter", f"SELECT ts FROM events WHERE strftime(ts, '%Y-%m-%d') IN {DAYS}")
def slice_filter(spark, d):
    return TimeSlicer("day").get_indices_for_slice_combi(spark.read.parquet(f"{d}/events.parquet"), DAYS)


@_query("hourly_pivot", f"WITH {_HOURLY} SELECT ts, " + ", ".join(f"round(max(CASE WHEN variable = '{v}' THEN value END), 6) AS \"{v}\"" for v in EVENT_TYPES) + " FROM obs GROUP BY ts")
def hourly_pivot(spark, d):
    return hourly_events(spark, d).select("ts", *[_r(v).alias(v) for v in EVENT_TYPES])


_STATS = f"""WITH {_HOURLY},
    ramps AS (SELECT *, value - lag(value) OVER (PARTITION BY slice_id, variable ORDER BY ts) AS ramp FROM obs),
    s AS (
        SELECT slice_id, variable, avg(value) AS mean, coalesce(stddev_samp(value), 0.0) AS std, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.9) AS q90,
               quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS iqr, count(*) FILTER (WHERE value < 0) / count(*) AS neg_share, coalesce(stddev_samp(ramp), 0.0) AS ramp_std
        FROM ramps GROUP BY 1, 2),
    c AS (
        SELECT a.slice_id, 'corr__' || a.variable || '__' || b.variable AS feature, corr(a.value, b.value) AS r
        FROM obs a JOIN obs b ON a.slice_id = b.slice_id AND a.ts = b.ts AND a.variable < b.variable GROUP BY a.slice_id, a.variable, b.variable),
    features AS (
        SELECT slice_id, stat || '__' || variable AS feature, value FROM (UNPIVOT s ON mean, std, q10, q50, q90, iqr, neg_share, ramp_std INTO NAME stat VALUE value)
        UNION ALL SELECT slice_id, feature, CASE WHEN abs(r) < 0.999 THEN atanh(r) ELSE sign(r) * 3.8 END FROM c)"""


def _long(features: DataFrame) -> DataFrame:
    names = [c for c in features.columns if c != "slice_id"]
    return features.unpivot(["slice_id"], names, "feature", "value").select("slice_id", "feature", _r("value").alias("value"))


for _stat in ("mean", "std", "q10", "q50", "q90", "iqr", "neg_share", "ramp_std"):
    _query(f"stats_{_stat}", f"{_STATS} SELECT slice_id, feature, round(value, 6) AS value FROM features WHERE feature LIKE '{_stat}\\_\\_%' ESCAPE '\\'")(
        lambda spark, d, stat=_stat: _long(slice_stats(_events(spark, d)).select("slice_id", *[f"{stat}__{v}" for v in EVENT_TYPES]))
    )


@_query("stats_corr_fisher", f"{_STATS} SELECT slice_id, feature, round(value, 6) AS value FROM features WHERE feature LIKE 'corr%'")
def stats_corr_fisher(spark, d):
    features = StandardStatsFeatureEngineer(scale="none").calc_and_get_features_df(_events(spark, d))
    return _long(features.select("slice_id", *[c for c in features.columns if c.startswith("corr")]))


@_query("stats_zscore", f"""{_STATS} SELECT slice_id, feature,
    round(coalesce((value - avg(value) OVER w) / CASE WHEN stddev_samp(value) OVER w = 0 THEN 1.0 ELSE stddev_samp(value) OVER w END, 0.0), 6) AS value
    FROM features WINDOW w AS (PARTITION BY feature)""")
def stats_zscore(spark, d):
    return _long(StandardStatsFeatureEngineer().calc_and_get_features_df(_events(spark, d)))


@_query("direct_profile_long", f"WITH {_HOURLY} SELECT slice_id, 't' || f AS feature, round(v, 6) AS value FROM x")
def direct_profile_long(spark, d):
    return _long(DirectProfileFeatureEngineer().calc_and_get_features_df(_events(spark, d)))


@_query("combos_exhaustive", f"WITH {_HOURLY} SELECT combo_id, a.label || ', ' || b.label AS label FROM two JOIN labels a ON a.slice_id = i JOIN labels b ON b.slice_id = j")
def combos_exhaustive(spark, d):
    return ExhaustiveCombiGen(2).generate(_events(spark, d)).select("combo_id", "label")


_MONTHS = "m AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS label, month(l_shipdate) AS mo FROM lineitem)"


@_query("combos_group_quota", f"""WITH {_MONTHS} SELECT CAST(row_number() OVER (ORDER BY least(a.label, b.label), greatest(a.label, b.label)) - 1 AS BIGINT) AS combo_id,
    least(a.label, b.label) || ', ' || greatest(a.label, b.label) AS label FROM m a, m b WHERE a.mo IN (12, 1, 2) AND b.mo IN (6, 7, 8)""")
def combos_group_quota(spark, d):
    context = _shipments(spark, d, "month")
    seasons = {s: {12: "winter", 1: "winter", 2: "winter", 6: "summer", 7: "summer", 8: "summer"}.get(int(s[5:]), "other") for s in context.get_unique_slices()}
    return GroupQuotaCombiGen(2, seasons, {"winter": 1, "summer": 1}).generate(context).select("combo_id", "label")


_CHILDREN = """
    c AS (SELECT date_trunc('month', ts) AS child, strftime(date_trunc('month', ts), '%Y-%m') AS label, max_by(strftime(ts, '%Y'), ts) AS parent FROM daily GROUP BY 1, 2),
    p AS (SELECT DISTINCT parent FROM c)"""


@_query("combos_hierarchical", f"""WITH {_DAILY}, {_CHILDREN},
    s AS (SELECT a.parent AS a, b.parent AS b FROM p a JOIN p b ON a.parent < b.parent)
    SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS BIGINT) AS combo_id, string_agg(label, ', ' ORDER BY child) AS label FROM s JOIN c ON c.parent IN (a, b) GROUP BY a, b""")
def combos_hierarchical(spark, d):
    df = daily_shipments(spark, d)
    generator = ExhaustiveHierarchicalCombiGen.from_slicers(2, df, TimeSlicer("month"), TimeSlicer("year"))
    return generator.generate(ProblemContext(df, TimeSlicer("month"))).select("combo_id", "label")


@_query("combos_seasonal", f"WITH {_MONTHS} SELECT least(a.label, b.label) || ', ' || greatest(a.label, b.label) AS label FROM m a, m b WHERE a.mo IN (3, 4, 5) AND b.mo IN (9, 10, 11)")
def combos_seasonal(spark, d):
    df = daily_shipments(spark, d)
    generator = GroupQuotaHierarchicalCombiGen.from_slicers_with_seasons(2, df, TimeSlicer("month"), {"winter": 0, "spring": 1, "summer": 0, "fall": 1})
    return generator.generate(ProblemContext(df, TimeSlicer("month"))).select("label")


@_query("combo_counts", f"WITH {_DAILY}, n AS (SELECT count(*) AS n FROM years) SELECT 1 AS k, n AS candidates FROM n UNION ALL SELECT 2, n * (n - 1) // 2 FROM n UNION ALL SELECT 3, n * (n - 1) * (n - 2) // 6 FROM n")
def combo_counts(spark, d):
    context = _shipments(spark, d)
    return spark.createDataFrame([(k, ExhaustiveCombiGen(k).count(context)) for k in (1, 2, 3)], "k int, candidates long")


def _scored(component: ScoreComponent, context: ProblemContext, k: int) -> DataFrame:
    component.prepare(context)
    return component.score_all(members_of(ExhaustiveCombiGen(k).generate(context))).select("combo_id", _r("score").alias("score"))


_query("score_wasserstein", f"""WITH {_DAILY},
    grid AS (SELECT variable, value, count(*) AS n FROM obs GROUP BY 1, 2),
    full_cdf AS (SELECT variable, value, sum(n) OVER (PARTITION BY variable ORDER BY value) / sum(n) OVER (PARTITION BY variable) AS cdf, coalesce(lead(value) OVER (PARTITION BY variable ORDER BY value) - value, 0.0) AS gap FROM grid),
    cells AS (SELECT c.combo_id, g.variable, g.value, g.cdf, g.gap, coalesce(o.n, 0) AS n FROM three c CROSS JOIN full_cdf g
        LEFT JOIN (SELECT combo_id, variable, value, count(*) AS n FROM own GROUP BY 1, 2, 3) o ON o.combo_id = c.combo_id AND o.variable = g.variable AND o.value = g.value),
    steps AS (SELECT combo_id, variable, abs(sum(n) OVER (PARTITION BY combo_id, variable ORDER BY value) / sum(n) OVER (PARTITION BY combo_id, variable) - cdf) * gap AS s FROM cells)
    SELECT combo_id, round(sum(s / w), 6) AS score FROM steps JOIN spread USING (variable) GROUP BY combo_id""")(lambda spark, d: _scored(WassersteinFidelity(), _shipments(spark, d), 3))

_query("score_correlation", f"""WITH {_DAILY}, pairs AS (SELECT a.slice_id, a.ts, a.variable AS v, b.variable AS w, a.value AS x, b.value AS y FROM obs a JOIN obs b ON a.ts = b.ts AND a.variable < b.variable),
    f AS (SELECT v, w, corr(x, y) AS r FROM pairs GROUP BY 1, 2),
    o AS (SELECT combo_id, v, w, corr(x, y) AS r FROM members JOIN pairs USING (slice_id) GROUP BY 1, 2, 3)
    SELECT combo_id, round(sqrt(2 * sum((o.r - f.r) * (o.r - f.r))) / (sqrt(3 + 2 * sum(f.r * f.r)) + 1e-12), 6) AS score FROM o JOIN f USING (v, w) GROUP BY combo_id""")(lambda spark, d: _scored(CorrelationFidelity(), _shipments(spark, d), 3))

_query("score_nrmse", f"""WITH {_DAILY},
    f AS (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY variable) AS n, avg(value) OVER (PARTITION BY variable) AS mean FROM obs),
    o AS (SELECT combo_id, variable, value, row_number() OVER (PARTITION BY combo_id, variable ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY combo_id, variable) AS m FROM own),
    sizes AS (SELECT DISTINCT combo_id, variable, m FROM o),
    places AS (SELECT s.combo_id, f.variable, f.value, f.n, f.mean, f.i * (s.m - 1.0) / (f.n - 1.0) AS p, s.m FROM f JOIN sizes s USING (variable)),
    e AS (SELECT a.combo_id, a.variable, any_value(a.n) AS n, any_value(a.mean) AS mean, sum(power(lo.value + (a.p - floor(a.p)) * (hi.value - lo.value) - a.value, 2)) AS q
        FROM places a JOIN o lo ON lo.combo_id = a.combo_id AND lo.variable = a.variable AND lo.i = floor(a.p)
        JOIN o hi ON hi.combo_id = a.combo_id AND hi.variable = a.variable AND hi.i = least(floor(a.p) + 1, a.m - 1) GROUP BY 1, 2)
    SELECT combo_id, round(sum(sqrt(q / n) / (mean + 1e-12)), 6) AS score FROM e GROUP BY combo_id""")(lambda spark, d: _scored(NRMSEFidelity(), _shipments(spark, d), 3))

_POINTS = "[" + ", ".join(f"{i / 20!r}" for i in range(21)) + "]"
_query("score_duration_curve", f"""WITH {_DAILY},
    f AS (SELECT variable, unnest(quantile_cont(value, {_POINTS})) AS q, unnest(range(21)) AS i FROM obs GROUP BY variable),
    o AS (SELECT combo_id, variable, unnest(quantile_cont(value, {_POINTS})) AS q, unnest(range(21)) AS i FROM own GROUP BY combo_id, variable),
    e AS (SELECT combo_id, variable, sqrt(sum((o.q - f.q) * (o.q - f.q)) / 21) AS e FROM o JOIN f USING (variable, i) GROUP BY 1, 2)
    SELECT combo_id, round(sum(e / w), 6) AS score FROM e JOIN spread USING (variable) GROUP BY combo_id""")(lambda spark, d: _scored(DurationCurveFidelity(21), _shipments(spark, d), 3))

_query("score_diurnal", f"""WITH {_HOURLY}, f AS (SELECT variable, hour(ts) AS h, avg(value) AS a FROM obs GROUP BY 1, 2),
    o AS (SELECT combo_id, variable, hour(ts) AS h, avg(value) AS b FROM members JOIN obs USING (slice_id) GROUP BY 1, 2, 3),
    e AS (SELECT combo_id, variable, avg((a - b) * (a - b)) AS e, avg(a * a) AS s FROM o JOIN f USING (variable, h) GROUP BY 1, 2)
    SELECT combo_id, round(avg(e) / (avg(s) + 1e-12), 6) AS score FROM e GROUP BY combo_id""")(lambda spark, d: _scored(DiurnalFidelity(), _events(spark, d), 2))
_query("score_diversity", f"WITH {_HOURLY} SELECT combo_id, round(d, 6) AS score FROM two JOIN dist USING (i, j)")(lambda spark, d: _scored(DiversityReward(), _profiled(spark, d), 2))
_query("score_centroid_balance", f"WITH {_HOURLY}, c AS (SELECT combo_id, f, avg(v) AS m FROM members JOIN x USING (slice_id) GROUP BY 1, 2) SELECT combo_id, round(sqrt(sum(m * m)), 6) AS score FROM c GROUP BY combo_id")(lambda spark, d: _scored(CentroidBalance(), _profiled(spark, d), 2))
_query("score_coverage_balance", f"""WITH {_HOURLY}, mass AS (SELECT j AS slice_id, sum(exp(-1e-7 * d * d)) AS mass FROM dist GROUP BY j),
    h AS (SELECT combo_id, mass / sum(mass) OVER (PARTITION BY combo_id) - 0.5 AS e FROM members JOIN mass USING (slice_id))
    SELECT combo_id, round(sqrt(sum(e * e)), 6) AS score FROM h GROUP BY combo_id""")(lambda spark, d: _scored(CoverageBalance(1e-7), _profiled(spark, d), 2))


class _Column(ScoreComponent):
    """A score that a table has already."""

    def __init__(self, name: str, direction: str = "min"):
        self.name, self.direction = name, direction

    def score_all(self, members):
        raise NotImplementedError("given by the table")


_OBJECTIVES = ObjectiveSet({"a": (1.0, _Column("discount")), "b": (2.0, _Column("quantity", "max")), "c": (0.5, _Column("tax"))})


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    table = items.groupBy(F.col("l_suppkey").alias("combo_id")).agg(F.avg("l_discount").alias("discount"), F.sum("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"))
    return table.withColumn("label", F.col("combo_id").cast("string"))


_query("policy_weighted_sum", f"WITH {_SUPPLIERS}, {_NORMAL} SELECT combo_id, round(z1 + 2 * z2 + 0.5 * z3, 6) AS policy_score FROM z")(
    lambda spark, d: WeightedSumPolicy(normalization="robust_minmax").rank_all(_suppliers(spark, d), _OBJECTIVES).select("combo_id", _r("policy_score").alias("policy_score"))
)
_query("norm_zscore_iqr", f"""WITH {_SUPPLIERS}, q AS (SELECT quantile_cont(y1, [0.25, 0.5, 0.75]) AS a, quantile_cont(y2, [0.25, 0.5, 0.75]) AS b, quantile_cont(y3, [0.25, 0.5, 0.75]) AS c FROM y)
    SELECT combo_id, round((y1 - a[2]) / (a[3] - a[1]) + 2 * (y2 - b[2]) / (b[3] - b[1]) + 0.5 * (y3 - c[2]) / (c[3] - c[1]), 6) AS policy_score FROM y, q""")(
    lambda spark, d: WeightedSumPolicy(normalization="zscore_iqr").rank_all(_suppliers(spark, d), _OBJECTIVES).select("combo_id", _r("policy_score").alias("policy_score"))
)


def _ranked(policy, spark, d) -> DataFrame:
    return policy.rank_all(_suppliers(spark, d), _OBJECTIVES).select("combo_id", "feasible_mask", "pareto_mask", _r("policy_score").alias("policy_score"))


_IDEAL = "ideal AS (SELECT min(z1) AS i1, min(z2) AS i2, min(z3) AS i3 FROM z WHERE feasible)"
for _name, _policy, _score in (
    ("policy_pareto_utopia", ParetoUtopiaPolicy, "greatest(abs(z1 - i1), abs(z2 - i2), abs(z3 - i3))"),
    ("policy_pareto_maxmin", ParetoMaxMinStrategy, "-least(1 - (z1 - i1), 1 - (z2 - i2), 1 - (z3 - i3))"),
):
    _query(_name, f"WITH {_SUPPLIERS}, {_NORMAL}, {_IDEAL} SELECT combo_id, feasible AS feasible_mask, combo_id IN (SELECT combo_id FROM front) AS pareto_mask, round({_score}, 6) AS policy_score FROM z, ideal")(
        lambda spark, d, policy=_policy: _ranked(policy(fairness_constraints={"discount": 0.06}), spark, d)
    )


@_query("diag_pareto_category", f"""WITH {_SUPPLIERS}, {_NORMAL} SELECT combo_id, CASE WHEN NOT feasible THEN 'Infeasible' WHEN combo_id IN (SELECT combo_id FROM front) THEN 'Pareto' ELSE 'Dominated' END AS category,
    CASE WHEN NOT feasible THEN 0 WHEN combo_id IN (SELECT combo_id FROM front) THEN 2 ELSE 1 END AS status FROM y""")
def diag_pareto_category(spark, d):
    ranked = ParetoUtopiaPolicy(fairness_constraints={"discount": 0.06}).rank_all(_suppliers(spark, d), _OBJECTIVES)
    return diag.pareto_categories(ranked, _OBJECTIVES).select("combo_id", "category", "status")


def _weighed(model, spark, d) -> DataFrame:
    model.fit(_profiled(spark, d))
    return model.weigh(DAYS)


_query("weights_uniform", f"WITH {_HOURLY} SELECT slice_id AS rep_slice_id, round(1.0 / 3, 6) AS weight FROM labels WHERE label IN {DAYS}")(lambda spark, d: _weighed(UniformRepresentationModel(), spark, d).select("rep_slice_id", _r("weight").alias("weight")))
_query("weights_cluster_size", f"""WITH {_HOURLY}, near AS (SELECT i, arg_min(j, d) AS j FROM dist WHERE j IN (SELECT slice_id FROM labels WHERE label IN {DAYS}) GROUP BY i)
    SELECT slice_id AS rep_slice_id, round(count(near.i) / 30.0, 6) AS weight FROM labels LEFT JOIN near ON near.j = slice_id WHERE label IN {DAYS} GROUP BY 1""")(
    lambda spark, d: _weighed(KMedoidsClustersizeRepresentation(), spark, d).select("rep_slice_id", _r("weight").alias("weight"))
)
_query("weights_blended")(lambda spark, d: _weighed(BlendedRepresentationModel(), spark, d))


@_query("weights_blended_k2", f"""WITH {_HOURLY}, a AS (SELECT f, v FROM x JOIN labels USING (slice_id) WHERE label = '{DAYS[0]}'), b AS (SELECT f, v FROM x JOIN labels USING (slice_id) WHERE label = '{DAYS[1]}'),
    t AS (SELECT slice_id, least(greatest(sum((x.v - b.v) * (a.v - b.v)) / sum((a.v - b.v) * (a.v - b.v)), 0.0), 1.0) AS t FROM x JOIN a USING (f) JOIN b USING (f) GROUP BY 1)
    SELECT t.slice_id, l.slice_id AS rep_slice_id, round(CASE WHEN label = '{DAYS[0]}' THEN t ELSE 1 - t END, 4) + 0.0 AS weight FROM t, labels l WHERE label IN ('{DAYS[0]}', '{DAYS[1]}')""")
def weights_blended_k2(spark, d):
    model = BlendedRepresentationModel()
    model.fit(_profiled(spark, d))
    return model.weigh(DAYS[:2]).select("slice_id", "rep_slice_id", _r("weight", 4).alias("weight"))


_query("snippet_distances", f"""WITH {_HOURLY}, w AS (SELECT unnest(range(24)) AS w) SELECT i, CAST(w AS INTEGER) AS w, round(min(d * d), 4) AS d FROM dist JOIN w ON j BETWEEN w AND w + 6 GROUP BY i, w""")(
    lambda spark, d: SnippetSearch(2).window_distances(_profiled(spark, d)).select("i", "w", _r("d", 4).alias("d"))
)


@_query("snippet_k2", f"""WITH {_HOURLY}, w AS (SELECT unnest(range(24)) AS w), dw AS (SELECT i, w, min(d * d) AS d FROM dist JOIN w ON j BETWEEN w AND w + 6 GROUP BY i, w),
    now AS (SELECT i, d FROM dw WHERE w = 0), second AS (SELECT dw.w FROM dw JOIN now USING (i) WHERE w > 0 GROUP BY dw.w ORDER BY sum(least(dw.d, now.d)), dw.w LIMIT 1)
    SELECT i, CAST(arg_min(w, d) AS INTEGER) AS w, round(min(d), 4) AS d FROM dw WHERE w = 0 OR w IN (SELECT w FROM second) GROUP BY i""")
def snippet_k2(spark, d):
    return SnippetSearch(2).find_selection(_profiled(spark, d)).diagnostics["assignment"].select("i", "w", _r("d", 4).alias("d"))


_GAPS = f"""WITH {_HOURLY}, gaps AS (SELECT slice_id, d AS gap FROM labels LEFT JOIN dist ON i = slice_id AND j = slice_id - 1),
    cuts AS (SELECT slice_id, CASE WHEN gap IS NOT NULL AND row_number() OVER (ORDER BY gap DESC NULLS LAST, slice_id) < 4 THEN 1 ELSE 0 END AS cut FROM gaps),
    segments AS (SELECT slice_id, CAST(sum(cut) OVER (ORDER BY slice_id) AS INTEGER) AS cluster FROM cuts)"""
_query("ctpc_gap_cut", f"{_GAPS} SELECT * FROM segments")(lambda spark, d: CTPCSearch(4, "single").segments(_profiled(spark, d)))


@_query("ctpc_summary", f"""{_GAPS}, m AS (SELECT cluster, f, avg(v) AS m FROM x JOIN segments USING (slice_id) GROUP BY 1, 2),
    o AS (SELECT cluster, slice_id, sum((v - m) * (v - m)) AS q FROM x JOIN segments USING (slice_id) JOIN m USING (cluster, f) GROUP BY 1, 2)
    SELECT cluster, count(*) AS size, min(slice_id) AS "first", max(slice_id) AS "last", round(sum(q), 3) AS wcss FROM o GROUP BY cluster""")
def ctpc_summary(spark, d):
    context = _profiled(spark, d)
    return cluster_table(context, CTPCSearch(4, "single").segments(context)).select("cluster", "size", "first", "last", _r("wcss", 3).alias("wcss"))


@_query("hull_convex_k2", f"""WITH {_HOURLY}, mean AS (SELECT f, avg(v) AS m FROM x GROUP BY f),
    one AS (SELECT slice_id FROM x JOIN mean USING (f) GROUP BY 1 ORDER BY sum((v - m) * (v - m)) DESC, slice_id LIMIT 1),
    two_ AS (SELECT j AS slice_id FROM dist JOIN one ON i = one.slice_id WHERE j <> i ORDER BY d DESC, j LIMIT 1)
    SELECT label, 0 AS pos FROM one JOIN labels USING (slice_id) UNION ALL SELECT label, 1 FROM two_ JOIN labels USING (slice_id)""")
def hull_convex_k2(spark, d):
    selection = HullClusteringSearch(2).find_selection(_profiled(spark, d)).selection
    return spark.createDataFrame([(s, i) for i, s in enumerate(selection)], "label string, pos int")


def _selected(search, context: ProblemContext) -> DataFrame:
    result = search.find_selection(context)
    rows = [(i, s, float(v)) for i, s in enumerate(result.selection) for v in list(result.scores.values())[:1]]
    return context.slices.sparkSession.createDataFrame(rows, "pos int, label string, score double")


_query("hull_conic")(lambda spark, d: _selected(HullClusteringSearch(3, "conic"), _profiled(spark, d)))
_query("kmedoids")(lambda spark, d: _selected(KMedoidsSearch(3), _profiled(spark, d)))
_query("ctpc_ward")(lambda spark, d: _selected(CTPCSearch(4), _profiled(spark, d)))
_query("pca")(lambda spark, d: _long(FeaturePipeline({"stats": StandardStatsFeatureEngineer(), "pca": PCAFeatureEngineer(3)}).calc_and_get_features_df(_events(spark, d))))

_query("representatives", f"WITH {_HOURLY} SELECT ts, label AS slice_label, " + ", ".join(f"round(max(CASE WHEN variable = '{v}' THEN value END), 6) AS \"{v}\"" for v in EVENT_TYPES) + f" FROM obs JOIN labels USING (slice_id) WHERE label IN {DAYS} GROUP BY ts, label")(
    lambda spark, d: representatives_of(_events(spark, d), DAYS).select("ts", "slice_label", *[_r(v).alias(v) for v in EVENT_TYPES])
)

_SOURCES = f"WITH {_HOURLY}, src AS (SELECT 'full' AS source, variable, ts, value FROM obs UNION ALL SELECT 'selection', variable, ts, value FROM obs JOIN labels USING (slice_id) WHERE label IN {DAYS})"
_query("diag_ecdf", f"{_SOURCES} SELECT source, variable, round(value, 6) AS value, round(row_number() OVER (PARTITION BY source, variable ORDER BY value) / count(*) OVER (PARTITION BY source, variable), 6) AS p FROM src")(
    lambda spark, d: diag.ecdf(_events(spark, d), DAYS).select("source", "variable", _r("value").alias("value"), _r("p").alias("p"))
)
_query("diag_histogram", f"""{_SOURCES}, b AS (SELECT source, variable, min(value) AS lo, max(value) AS hi, count(*) AS n FROM src GROUP BY 1, 2)
    SELECT source, variable, CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, round(count(*) / any_value(n), 6) AS height FROM src JOIN b USING (source, variable) GROUP BY 1, 2, 3""")(
    lambda spark, d: diag.distribution_histogram(_events(spark, d), DAYS).select("source", "variable", "bin", _r("height").alias("height"))
)
_query("diag_diurnal_overlay", f"{_SOURCES} SELECT source, variable, CAST(hour(ts) AS INTEGER) AS hour, round(avg(value), 6) AS mean FROM src GROUP BY 1, 2, 3")(
    lambda spark, d: diag.diurnal_profiles(_events(spark, d), DAYS).select("source", "variable", "hour", _r("mean").alias("mean"))
)
_query("diag_corr_diff", f"""WITH {_HOURLY}, p AS (SELECT a.variable AS a, b.variable AS b, a.value AS x, b.value AS y, label IN {DAYS} AS own FROM obs a JOIN obs b ON a.ts = b.ts JOIN labels l ON l.slice_id = a.slice_id)
    SELECT a, b, round(corr(x, y) FILTER (WHERE own) - corr(x, y), 6) + 0.0 AS difference FROM p GROUP BY a, b""")(
    lambda spark, d: diag.correlation_difference(_events(spark, d), DAYS).select("a", "b", (_r("difference") + 0.0).alias("difference"))
)
_FEATURES = f"{_STATS}, m AS (SELECT * FROM features WHERE feature LIKE 'mean%')"
_query("diag_feature_corr", f"{_FEATURES} SELECT p.feature AS a, q.feature AS b, round(corr(p.value, q.value), 6) AS r FROM m p JOIN m q USING (slice_id) GROUP BY 1, 2")(
    lambda spark, d: diag.feature_correlation(_means(spark, d)).select("a", "b", _r("r").alias("r"))
)
_query("diag_spearman", f"""{_FEATURES}, k AS (SELECT slice_id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS value FROM m)
    SELECT p.feature AS a, q.feature AS b, round(corr(p.value, q.value), 6) AS r FROM k p JOIN k q USING (slice_id) GROUP BY 1, 2""")(
    lambda spark, d: diag.feature_correlation(_means(spark, d), method="spearman").select("a", "b", _r("r").alias("r"))
)


def _means(spark: SparkSession, d: str) -> ProblemContext:
    context = _events(spark, d)
    return context.with_features(slice_stats(context).select("slice_id", *[f"mean__{v}" for v in EVENT_TYPES]))


def months_experiment(spark: SparkSession, d: str, k: int = 2) -> DataFrame:
    """All pairs of months of the shipments scored by Wasserstein and correlation; the best pair with its weights."""
    context = _shipments(spark, d, "month")
    objectives = ObjectiveSet({"w": (1.0, WassersteinFidelity()), "c": (1.0, CorrelationFidelity())})
    search = ObjectiveDrivenCombinatorialSearchAlgorithm(objectives, WeightedSumPolicy(), ExhaustiveCombiGen(k))
    result = RepSetExperiment(context, Workflow(StandardStatsFeatureEngineer(), search, UniformRepresentationModel())).run()
    named = context.slices.select(F.col("slice_id").alias("rep_slice_id"), "slice_label")
    return result.weights.join(named, "rep_slice_id").select("rep_slice_id", "slice_label", "weight")

