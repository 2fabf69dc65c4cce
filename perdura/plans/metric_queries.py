"""Registered queries of the metric layer, over facts made from the users' event series.

Records are the series by user; the truth is a Hurst proxy of 0.5; strata are lengths in
tens. Enrolled are the rescaled range and the variance ratio with three lengths required
(variants), one of which no series has.
Intervals are fixed offsets, so that both engines have the same ones. For the stress
test each series is also perturbed by a trend.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perdura.functions.columns import rounded
from perdura.operators import evaluate, native, uncertainty
from perdura.plans.catalog import MetricSpec, metric
from perdura.plans.registry import EstimatorSpec
from perdura.plans.series_queries import TREND_SQL, VIEW_SQL, Query
from perdura.sources.series import VIEWS

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

HURST = "hurst_scaling_proxy"
#: A length that no series has.
NEVER = 1 << 40
SPECS = [
    EstimatorSpec("RS", "time_domain", HURST),
    EstimatorSpec("VarianceRatio::short", "variance", HURST, params={"min_n": 32}, base="VarianceRatio", variant="short"),
    EstimatorSpec("VarianceRatio::long", "variance", HURST, params={"min_n": 60}, base="VarianceRatio", variant="long"),
    EstimatorSpec("VarianceRatio::never", "variance", HURST, params={"min_n": NEVER}, base="VarianceRatio", variant="never"),
]
CI = "array<struct<nominal:double,ci_low:double,ci_high:double>>"


def estimates_of(long: DataFrame) -> DataFrame:
    """Estimates of the enrolled estimators; the long variant has no intervals."""
    rs = native.rescaled_range(long).select("series_id", "n", F.col("point").alias("rs"))
    vr = native.variance_ratio(long, 32).select("series_id", F.col("point").alias("vr"))
    points = {"RS": F.col("rs"), "VarianceRatio::short": F.col("vr"), "VarianceRatio::long": F.when(F.col("n") >= 60, F.col("vr")), "VarianceRatio::never": F.when(F.col("n") >= NEVER, F.col("vr"))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("estimator_name"), v.alias("point")) for k, v in points.items()])).alias("e")
    every = rs.join(vr, "series_id").select("series_id", each).select("series_id", "e.*").withColumn("valid", F.col("point").isNotNull())
    p = F.col("point")
    cis = F.array(*[F.struct(F.lit(a).alias("nominal"), (p - lo).alias("ci_low"), (p + hi).alias("ci_high")) for a, lo, hi in ((0.8, 0.04, 0.06), (0.95, 0.08, 0.09))])
    has = F.col("valid") & (F.col("estimator_name") != "VarianceRatio::long")
    return every.select(
        F.col("series_id").alias("record_id"), "estimator_name", "point", "valid",
        F.when(has, p - 0.08).alias("ci_low"), F.when(has, p + 0.09).alias("ci_high"), F.when(has, cis).otherwise(F.array().cast(CI)).alias("bootstrap_cis"),
        F.lit(0.001).alias("runtime_seconds"), F.when(has, F.abs(p) / 10).alias("bootstrap_std"), F.when(has, p * 1.00005).alias("point_alt"),
    )


def records_of(long: DataFrame, role: str = "clean", operator: str = "clean") -> DataFrame:
    rows = long.groupBy(F.col("series_id").alias("record_id")).agg(F.count(F.lit(1)).alias("n"))
    stratum = F.concat(F.lit('{"contamination_operator":"' + operator + '","n":'), (F.floor(F.col("n") / 10) * 10).cast("string"), F.lit("}"))
    return rows.select("record_id", stratum.alias("stratum"), F.lit(HURST).alias("truth_estimand"), F.lit(0.5).alias("truth_value"), F.lit(role).alias("stress_role"), F.col("record_id").alias("clean_record_id"))


def clean_facts(spark: SparkSession, sf: str) -> DataFrame:
    long = VIEWS["EU"](spark, sf)
    return evaluate.facts(records_of(long), estimates_of(long), evaluate.spec_table(spark, SPECS))


def stress_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Clean records and, under their id with '~', the perturbed ones."""
    long = VIEWS["EU"](spark, sf)
    bent = native.polynomial_trend(long, 1, 0.5)
    mark = lambda df: df.withColumn("record_id", F.concat("record_id", F.lit("~")))
    records = records_of(long).unionByName(mark(records_of(bent, "contaminated", "polynomial_trend")))
    estimates = estimates_of(long).unionByName(mark(estimates_of(bent)))
    return evaluate.facts(records, estimates, evaluate.spec_table(spark, SPECS))


def est_sql(view: str, mark: str = "", role: str = "clean", operator: str = "clean") -> str:
    """Facts in SQL, from a series view."""
    return f"""(WITH s AS ({view}), p AS (SELECT series_id, t, v, v - avg(v) OVER (PARTITION BY series_id) AS x FROM s),
y AS (SELECT *, sum(x) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS y, v - lag(v) OVER (PARTITION BY series_id ORDER BY t) AS d FROM p),
g AS (SELECT series_id, count(*) AS n, CASE WHEN count(*) >= 16 AND stddev_pop(v) >= 1e-12 AND max(y) - min(y) >= 1e-12 THEN ln((max(y) - min(y)) / stddev_pop(v)) / ln(count(*)) END AS rs,
  CASE WHEN count(*) >= 32 AND var_pop(v) > 0 AND var_pop(d) > 0 THEN least(greatest(var_pop(v) / (var_pop(v) + var_pop(d)), 0), 1) END AS vr FROM y GROUP BY series_id),
e AS (SELECT series_id, n, 'RS' AS estimator_name, 0 AS ord, 'time_domain' AS family, 'RS' AS base, rs AS point FROM g
  UNION ALL SELECT series_id, n, 'VarianceRatio::short', 1, 'variance', 'VarianceRatio', vr FROM g
  UNION ALL SELECT series_id, n, 'VarianceRatio::long', 2, 'variance', 'VarianceRatio', CASE WHEN n >= 60 THEN vr END FROM g
  UNION ALL SELECT series_id, n, 'VarianceRatio::never', 3, 'variance', 'VarianceRatio', NULL::DOUBLE FROM g)
SELECT series_id || '{mark}' AS record_id, series_id AS clean_record_id, '{role}' AS stress_role, estimator_name, ord, family, base, point, point IS NOT NULL AS valid,
  '{{"contamination_operator":"{operator}","n":' || CAST((n // 10) * 10 AS VARCHAR) || '}}' AS stratum, 0.5::DOUBLE AS truth,
  point IS NOT NULL AND estimator_name <> 'VarianceRatio::long' AS has FROM e)"""


CLEAN_SQL = f"SELECT * FROM {est_sql(VIEW_SQL['EU'])}"
BENT = TREND_SQL.format(view=VIEW_SQL["EU"], strength=0.5, g="u")
STRESS_SQL = f"{CLEAN_SQL} UNION ALL SELECT * FROM {est_sql(BENT, '~', 'contaminated', 'polynomial_trend')}"
LEVELS = "(VALUES (0.8::DOUBLE, 0.04::DOUBLE, 0.06::DOUBLE), (0.95, 0.08, 0.09)) AS l(nominal, lo, hi)"
BOTH = {"levels": [0.8, 0.95]}


def long_row(name: str, value: str, source: str = "f", where: str = "valid", nominal: str = "NULL::DOUBLE", missing: str = "false", estimator: str = "estimator_name") -> str:
    return f"SELECT record_id, {estimator} AS estimator_name, '{name}' AS metric_name, {nominal} AS nominal, {value} AS value, {missing} AS missing_ci, stratum FROM {source} WHERE {where}"


PAIRS = "(SELECT a.record_id, a.stratum, a.estimator_name AS ea, b.estimator_name AS eb, a.family AS fa, b.family AS fb, abs(a.point - b.point) AS gap FROM f AS a JOIN f AS b ON a.record_id = b.record_id AND a.ord < b.ord WHERE a.valid AND b.valid)"
ENOUGH = "(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY record_id) AS k FROM f WHERE valid) WHERE k >= 2)"
CLASH = "(SELECT c.*, o.point AS q, o.valid AS qv, o.has AS qh FROM f AS c JOIN f AS o ON o.record_id = c.clean_record_id AND o.estimator_name = c.estimator_name WHERE c.stress_role = 'contaminated' AND o.stress_role = 'clean')"
HIT = "CASE WHEN {p} - lo <= truth AND truth <= {p} + hi THEN 1.0 ELSE 0.0 END"
ROWS_SQL = {
    "bias": long_row("bias", "point - truth"),
    "mae": long_row("mae", "abs(point - truth)"),
    "rmse": long_row("rmse", "(point - truth) * (point - truth)"),
    "coverage": long_row("coverage", f"CASE WHEN has THEN {HIT.format(p='point')} END", f"f, {LEVELS}", nominal="nominal", missing="NOT has"),
    "ci_width": long_row("ci_width", "CASE WHEN has THEN (point + hi) - (point - lo) END", f"f, {LEVELS}", nominal="nominal", missing="NOT has"),
    "validity_rate": long_row("validity_rate", "CAST(valid AS DOUBLE)", where="true"),
    "runtime": long_row("runtime", "0.001::DOUBLE", where="true"),
    "instability": long_row("instability", "abs(point) / 10", where="has"),
    "preprocessing_sensitivity": long_row("preprocessing_sensitivity", "CASE WHEN has THEN abs(point * 1.00005 - point) / 1e-4 END"),
    "false_positive_lrd_rate": long_row("false_positive_lrd_rate", "CASE WHEN point >= 0.6 THEN 1.0 ELSE 0.0 END::DOUBLE"),
    "cross_estimator_dispersion": f"SELECT record_id, '__all_estimators__' AS estimator_name, 'cross_estimator_dispersion' AS metric_name, NULL::DOUBLE AS nominal, stddev_pop(point) AS value, false AS missing_ci, stratum FROM {ENOUGH} GROUP BY record_id, stratum",
    "pairwise_estimator_disagreement": long_row("pairwise_estimator_disagreement", "gap", PAIRS, "true", estimator="ea || '__vs__' || eb"),
    "family_level_disagreement": f"""SELECT record_id, 'family:' || least(fa, fb) || CASE WHEN fa = fb THEN '' ELSE '__vs__' || greatest(fa, fb) END AS estimator_name, 'family_level_disagreement' AS metric_name, NULL::DOUBLE AS nominal, avg(gap) AS value, false AS missing_ci, stratum FROM {PAIRS} GROUP BY record_id, stratum, least(fa, fb), greatest(fa, fb), fa = fb""",
    "parameter_variant_sensitivity": "SELECT record_id, base AS estimator_name, 'parameter_variant_sensitivity' AS metric_name, NULL::DOUBLE AS nominal, stddev_pop(point) AS value, false AS missing_ci, stratum FROM f WHERE valid GROUP BY record_id, stratum, base HAVING count(*) >= 2",
    "max_variant_drift": "SELECT record_id, base AS estimator_name, 'max_variant_drift' AS metric_name, NULL::DOUBLE AS nominal, max(point) - min(point) AS value, false AS missing_ci, stratum FROM f WHERE valid GROUP BY record_id, stratum, base HAVING count(*) >= 2",
    "estimate_drift": long_row("estimate_drift", "abs(point - q)", CLASH, "valid AND qv"),
    "relative_degradation_ratio": long_row("relative_degradation_ratio", "abs(point - truth) / abs(q - truth)", CLASH, "valid AND qv AND abs(q - truth) >= 1e-12"),
    "validity_collapse": long_row("validity_collapse", "CAST(qv AND NOT valid AS DOUBLE)", CLASH, "true"),
    "coverage_collapse": long_row("coverage_collapse", f"CASE WHEN has AND qh THEN greatest(0.0, ({HIT.format(p='q')}) - ({HIT.format(p='point')})) END", f"{CLASH}, {LEVELS}", "true", "nominal", "NOT (has AND qh)"),
}
STRESS_NAMES = ("estimate_drift", "relative_degradation_ratio", "validity_collapse", "coverage_collapse")
LEVELLED = ("coverage", "ci_width", "coverage_collapse")
SHOWN = ["record_id", "estimator_name", "metric_name", "nominal", "value", "missing_ci", "stratum"]


def shown(df: DataFrame) -> DataFrame:
    return df.select(*[rounded("value").alias("value") if c == "value" else F.col(c) for c in SHOWN])


def series_query(name: str) -> Query:
    m = metric({"name": name, **BOTH} if name in LEVELLED else name)
    stress = name in STRESS_NAMES
    mode = "stress_test" if stress else "ground_truth"
    return lambda spark, sf: shown(evaluate.per_series((stress_facts if stress else clean_facts)(spark, sf), [m], mode))


for _name, _sql in ROWS_SQL.items():
    QUERIES[f"metric_{_name}"] = series_query(_name)
    SQL[f"metric_{_name}"] = f"WITH f AS ({STRESS_SQL if _name in STRESS_NAMES else CLEAN_SQL}) SELECT record_id, estimator_name, metric_name, nominal, round(value, 6) + 0.0 AS value, missing_ci, stratum FROM ({_sql})"

# Aggregation, calibration, leaderboard and report tables.
METRICS = [metric({"name": n, **BOTH} if n in ("coverage", "ci_width", "coverage_error") else n) for n in ("bias", "mae", "rmse", "coverage", "coverage_error", "ci_width", "validity_rate", "false_positive_lrd_rate", "cross_estimator_dispersion", "pairwise_estimator_disagreement", "family_level_disagreement", "parameter_variant_sensitivity", "max_variant_drift")]
ALL_ROWS = " UNION ALL ".join(ROWS_SQL[m.name] for m in METRICS if m.name in ROWS_SQL)
STEP = f"""WITH f AS ({CLEAN_SQL}), rows AS ({ALL_ROWS}),
b0 AS (SELECT estimator_name, metric_name, stratum, nominal, CASE WHEN metric_name = 'rmse' THEN sqrt(avg(value)) ELSE avg(value) END AS value FROM rows WHERE value IS NOT NULL GROUP BY estimator_name, metric_name, stratum, nominal),
b AS (SELECT * FROM b0 UNION ALL SELECT estimator_name, 'coverage_error', stratum, nominal, abs(value - nominal) FROM b0 WHERE metric_name = 'coverage'),
agg AS (SELECT estimator_name, metric_name, nominal, value, stratum, NULL::BIGINT AS n_strata FROM b
  UNION ALL SELECT estimator_name, metric_name, nominal, avg(value), '{evaluate.GLOBAL}', count(*) FROM b GROUP BY estimator_name, metric_name, nominal)
"""


def chosen(names: Iterable[str] | None) -> list[MetricSpec]:
    return [m for m in METRICS if names is None or m.name in names]


def clean_series(spark: SparkSession, sf: str, names: Iterable[str] | None = None) -> DataFrame:
    """Metric rows; of the named metrics only, so that no other is computed."""
    return evaluate.per_series(clean_facts(spark, sf), chosen(names), "ground_truth")


def aggregates(spark: SparkSession, sf: str, names: Iterable[str] | None = None) -> DataFrame:
    return evaluate.aggregate(clean_series(spark, sf, names), chosen(names))


def with_value(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("value", rounded("value", digits))


QUERIES["aggregate_strata_and_global"] = lambda spark, sf: with_value(aggregates(spark, sf)).withColumn("n_strata", F.coalesce("n_strata", F.lit(1)).cast("long"))
SQL["aggregate_strata_and_global"] = STEP + "SELECT estimator_name, metric_name, nominal, round(value, 6) + 0.0 AS value, stratum, coalesce(n_strata, 1) AS n_strata FROM agg"

CALIBRATION = ["coverage", "ci_width", "coverage_error"]
QUERIES["uncertainty_calibration"] = lambda spark, sf: with_value(aggregates(spark, sf, CALIBRATION)).drop("n_strata")
SQL["uncertainty_calibration"] = STEP + "SELECT estimator_name, metric_name, nominal, round(value, 6) + 0.0 AS value, stratum FROM agg WHERE metric_name IN ('coverage', 'ci_width', 'coverage_error')"

WEIGHTS = {"mae": 0.5, "coverage_error": 0.3, "validity_rate": 0.2}


def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    board = evaluate.leaderboard(with_value(aggregates(spark, sf, ["coverage", *WEIGHTS])), [s.name for s in SPECS], WEIGHTS)
    return board.select("estimator_name", F.col("rank").cast("long").alias("rank"), rounded("score").alias("score"), *[rounded(F.element_at("components", k), 5).alias(f"metric__{k}") for k in WEIGHTS])


QUERIES["leaderboard_weighted_rank"] = leaderboard
SQL["leaderboard_weighted_rank"] = STEP + f"""
, v AS (SELECT estimator_name, metric_name, avg(round(value, 6) + 0.0) AS value FROM agg WHERE stratum = '{evaluate.GLOBAL}' AND metric_name IN ('mae', 'coverage_error', 'validity_rate') AND estimator_name IN ('RS', 'VarianceRatio::short', 'VarianceRatio::long', 'VarianceRatio::never') GROUP BY ALL),
w(metric_name, weight, up) AS (VALUES ('mae', 0.5::DOUBLE, false), ('coverage_error', 0.3, false), ('validity_rate', 0.2, true)),
g AS (SELECT e.estimator_name, w.*, v.value FROM (SELECT DISTINCT estimator_name FROM v) AS e CROSS JOIN w LEFT JOIN v ON v.estimator_name = e.estimator_name AND v.metric_name = w.metric_name),
p AS (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY CASE WHEN up THEN -coalesce(value, 'infinity'::DOUBLE) ELSE coalesce(value, 'infinity'::DOUBLE) END, estimator_name) AS place FROM g),
b2 AS (SELECT estimator_name, sum(weight * place) AS score, max(value) FILTER (metric_name = 'mae') AS m1, max(value) FILTER (metric_name = 'coverage_error') AS m2, max(value) FILTER (metric_name = 'validity_rate') AS m3 FROM p GROUP BY estimator_name)
SELECT estimator_name, row_number() OVER (ORDER BY round(score, 9), estimator_name) AS rank, round(score, 6) + 0.0 AS score, round(m1, 5) + 0.0 AS metric__mae, round(m2, 5) + 0.0 AS metric__coverage_error, round(m3, 5) + 0.0 AS metric__validity_rate FROM b2"""


def failures(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.failures(clean_series(spark, sf)).withColumn("invalid_rate", rounded("invalid_rate")).withColumn("missing_value_rate", rounded("missing_value_rate"))


QUERIES["failures"] = failures
SQL["failures"] = STEP + """SELECT estimator_name, stratum, count(*) AS n_metric_rows, count(*) FILTER (value IS NULL) AS n_missing_values, count(*) FILTER (missing_ci) AS n_missing_uncertainty,
count(*) FILTER (metric_name = 'validity_rate') AS n_validity_observations, count(*) FILTER (metric_name = 'validity_rate' AND value = 0) AS n_invalid_estimates,
CASE WHEN count(*) FILTER (metric_name = 'validity_rate') > 0 THEN round(count(*) FILTER (metric_name = 'validity_rate' AND value = 0)::DOUBLE / count(*) FILTER (metric_name = 'validity_rate'), 6) + 0.0 END AS invalid_rate,
round(count(*) FILTER (value IS NULL)::DOUBLE / count(*), 6) + 0.0 AS missing_value_rate FROM rows GROUP BY estimator_name, stratum"""

MAP = [("mae", None), ("rmse", None), ("validity_rate", None), ("coverage", 0.8), ("coverage", 0.95)]
MAP_COLUMNS = [f"metric__{n}" + (f"__nominal_{a}" if a else "") for n, a in MAP]
QUERIES["failure_map"] = lambda spark, sf: evaluate.failure_map(with_value(aggregates(spark, sf)), MAP_COLUMNS)
SQL["failure_map"] = STEP + "SELECT estimator_name, stratum, " + ", ".join(f"""max(round(value, 6) + 0.0) FILTER (metric_name = '{n}' AND nominal IS NOT DISTINCT FROM {a if a else 'NULL'}) AS "{c}\"""" for (n, a), c in zip(MAP, MAP_COLUMNS, strict=True)) + f" FROM agg WHERE stratum <> '{evaluate.GLOBAL}' GROUP BY estimator_name, stratum"


def scoped(names: tuple[str, ...]) -> Query:
    """Rows of some metrics, per series and aggregated."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        one, two = clean_series(spark, sf, names), aggregates(spark, sf, names)
        columns = ["record_id", "estimator_name", "metric_name", "value", "stratum"]
        return with_value(one.select(F.lit("per_series").alias("scope"), *columns).unionByName(two.withColumn("record_id", F.lit(None).cast("string")).select(F.lit("aggregate").alias("scope"), *columns)))

    return query


for _table, _names in (("estimator_disagreement", ("cross_estimator_dispersion", "pairwise_estimator_disagreement", "family_level_disagreement")), ("scale_window_sensitivity", ("parameter_variant_sensitivity", "max_variant_drift"))):
    _in = ", ".join(f"'{n}'" for n in _names)
    QUERIES[_table] = scoped(_names)
    SQL[_table] = STEP + f"SELECT 'per_series' AS scope, record_id, estimator_name, metric_name, round(value, 6) + 0.0 AS value, stratum FROM rows WHERE metric_name IN ({_in}) UNION ALL SELECT 'aggregate', NULL, estimator_name, metric_name, round(value, 6) + 0.0, stratum FROM agg WHERE metric_name IN ({_in})"


def missing_estimators(spark: SparkSession, sf: str) -> DataFrame:
    """Enrolled estimators that have no valid estimate of a record."""
    fact = clean_facts(spark, sf)
    return fact.select("record_id", "estimator_name").join(fact.filter("ok").select("record_id", "estimator_name"), ["record_id", "estimator_name"], "left_anti")


QUERIES["missing_estimators"] = missing_estimators
SQL["missing_estimators"] = f"WITH f AS ({CLEAN_SQL}) SELECT record_id, estimator_name FROM f WHERE NOT valid"

# Bootstrap of benchmark values: by the counter index in both engines, by numpy as rows only.
PICK = [metric("mae"), metric("rmse")]
B = 60


def uncertainty_query(kind: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        series = evaluate.per_series(clean_facts(spark, sf), PICK, "ground_truth")
        if kind == "within":
            rows = uncertainty.within(series)
        elif kind == "strata":
            rows = uncertainty.over_strata(evaluate.aggregate(series, PICK))
        else:
            rows = uncertainty.paired(series, ["mae"])
        out = uncertainty.counter_bootstrap(rows, B, 0.9)
        return out.select("estimator_name", "metric_name", "stratum", "n", *[rounded(c, 5).alias(c) for c in ("value", "ci_low", "ci_high")])

    return query


RESAMPLE = """, k AS (SELECT *, row_number() OVER (PARTITION BY estimator_name, metric_name, stratum ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY estimator_name, metric_name, stratum) AS n FROM x),
z AS (SELECT k.estimator_name, k.metric_name, k.stratum, k.n, r.r, avg(o.value) AS mean FROM k CROSS JOIN range({b}) AS r(r) JOIN k AS o ON o.estimator_name = k.estimator_name AND o.metric_name = k.metric_name AND o.stratum = k.stratum AND o.i = (7919 * r.r + 104729 * k.i + 31 * r.r * k.i) % k.n GROUP BY ALL),
q AS (SELECT estimator_name, metric_name, stratum, quantile_cont(mean, 0.05::DOUBLE) AS lo, quantile_cont(mean, 0.95::DOUBLE) AS hi FROM z GROUP BY ALL)
SELECT q.estimator_name, q.metric_name, q.stratum, k.n, round(avg(k.value), 5) + 0.0 AS value, round(any_value(lo), 5) + 0.0 AS ci_low, round(any_value(hi), 5) + 0.0 AS ci_high FROM q JOIN k ON k.estimator_name = q.estimator_name AND k.metric_name = q.metric_name AND k.stratum = q.stratum GROUP BY q.estimator_name, q.metric_name, q.stratum, k.n""".format(b=B)
PICKED = f"WITH f AS ({CLEAN_SQL}), rows AS ({ROWS_SQL['mae']} UNION ALL {ROWS_SQL['rmse']})"
SOURCES = {
    "within": ", x AS (SELECT estimator_name, metric_name, stratum, record_id AS ord, value FROM rows)",
    "strata": f", x AS (SELECT estimator_name, metric_name, '{evaluate.GLOBAL}' AS stratum, stratum AS ord, CASE WHEN metric_name = 'rmse' THEN sqrt(avg(value)) ELSE avg(value) END AS value FROM rows GROUP BY estimator_name, metric_name, rows.stratum)",
    "paired": ", x AS (SELECT a.estimator_name || '__minus__' || b.estimator_name AS estimator_name, a.metric_name, a.stratum, a.record_id AS ord, a.value - b.value AS value FROM rows AS a JOIN rows AS b ON a.record_id = b.record_id AND a.metric_name = b.metric_name AND a.stratum = b.stratum AND a.estimator_name < b.estimator_name WHERE a.metric_name = 'mae')",
}
for _kind, _source in SOURCES.items():
    QUERIES[f"bench_uncertainty_{_kind}"] = uncertainty_query(_kind)
    SQL[f"bench_uncertainty_{_kind}"] = PICKED + _source + RESAMPLE


def seeded_uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    out = uncertainty.bootstrap(uncertainty.within(evaluate.per_series(clean_facts(spark, sf), PICK, "ground_truth")), 100, (0.9, 0.95), 11)
    return out.select("estimator_name", "metric_name", "stratum", "ci_level", "n", *[rounded(c, 5).alias(c) for c in ("value", "ci_low", "ci_high")])


QUERIES["bench_uncertainty_pcg64"] = seeded_uncertainty
