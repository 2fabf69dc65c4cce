"""Registered queries of sources, simulation and whole suites."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perdura.functions.columns import failure_class, rounded, severity_label
from perdura.kernels.estimators import KERNELS
from perdura.operators.estimate import estimate
from perdura.operators.simulate import generate
from perdura.plans import runner
from perdura.plans.catalog import METRICS
from perdura.plans.manifest import contamination_grid, generator_grid, manifest_of
from perdura.plans.registry import EstimatorSpec
from perdura.plans.series_queries import Query
from perdura.plans.suites import SUITES
from perdura.sources.records import grid_rows
from perdura.sources.series import VIEWS, pack

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """The generator grid of the medium stress suite."""
    rows = [(f, float(p["H"]), int(p["n"]), r) for f, p, r in generator_grid(SUITES["medium_stress"]["source"])]
    return spark.createDataFrame(rows, "family string, h double, n long, replicate long")


QUERIES["generator_grid"] = grid
SQL["generator_grid"] = "SELECT 'fGn' AS family, h, n, r AS replicate FROM (VALUES (0.5::DOUBLE), (0.7)) AS a(h), (VALUES (512::BIGINT), (1024)) AS b(n), range(3) AS c(r)"


def scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """The contamination grid of the medium stress suite with its severity labels, made by expressions."""
    rows = [(name, {k: str(v) for k, v in p.items()}) for name, p in contamination_grid(SUITES["medium_stress"]["contamination"])]
    df = spark.createDataFrame(rows, "operator string, params map<string,string>")
    return df.select("operator", severity_label(F.col("params")).alias("severity"))


QUERIES["contamination_grid"] = scenarios
SQL["contamination_grid"] = """SELECT 'level_shift' AS operator, 'shift=0.75' AS severity
UNION ALL SELECT 'outliers', 'amplitude=' || a || ';rate=' || r FROM (VALUES ('4.0'), ('8.0')) AS x(a), (VALUES ('0.01'), ('0.05')) AS y(r)
UNION ALL SELECT 'polynomial_trend', 'order=' || o || ';strength=' || s FROM (VALUES ('1'), ('2')) AS x(o), (VALUES ('0.5'), ('1.0')) AS y(s)
UNION ALL SELECT 'heavy_tail_noise', 'df=' || d || ';scale=' || s FROM (VALUES ('3.0'), ('5.0')) AS x(d), (VALUES ('0.5'), ('1.0')) AS y(s)"""


def variants(spark: SparkSession, sf: str) -> DataFrame:
    m = manifest_of(SUITES["small_sensitivity"])
    return spark.createDataFrame([(s.name, s.base, s.variant) for s in m.estimators], "estimator_name string, base string, variant string")


QUERIES["variant_expand"] = variants
SQL["variant_expand"] = "SELECT b || '::' || v AS estimator_name, b AS base, v AS variant FROM (VALUES ('DFA', 'short_scales'), ('DFA', 'long_scales'), ('DMA', 'short_windows'), ('DMA', 'long_windows'), ('WaveletOLS', 'broad_band'), ('WaveletOLS', 'upper_band')) AS t(b, v)"


def strata(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the small stress suite by stratum: counts of distinct ids."""
    rows = [(r[0], r[11], r[12]) for r in grid_rows(manifest_of(SUITES["small_stress"]))]
    df = spark.createDataFrame(rows, "record_id string, stratum string, stress_role string")
    return df.groupBy("stress_role").agg(F.countDistinct("stratum").alias("strata"), F.countDistinct("record_id").alias("records"))


QUERIES["record_strata"] = strata
SQL["record_strata"] = "SELECT * FROM (VALUES ('clean', 2::BIGINT, 4::BIGINT), ('contaminated', 10, 20)) AS t(stress_role, strata, records)"


def classes(spark: SparkSession, sf: str) -> DataFrame:
    reasons = ["insufficient_signal_for_rs", "exception:ValueError:x", "missing_uncertainty_for_rs", "other", None]
    df = spark.createDataFrame([(r,) for r in reasons], "reason string")
    return df.select("reason", failure_class(F.col("reason")).alias("code"))


QUERIES["failure_classes"] = classes
SQL["failure_classes"] = "SELECT * FROM (VALUES ('insufficient_signal_for_rs', 'insufficient_signal'), ('exception:ValueError:x', 'estimator_exception'), ('missing_uncertainty_for_rs', 'missing_uncertainty'), ('other', 'invalid_fit'), (NULL, 'invalid_fit')) AS t(reason, code)"


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(m.name, m.requires_truth, m.optimisation_direction) for m in METRICS.values()], "name string, requires_truth boolean, direction string").groupBy("direction", "requires_truth").count()


QUERIES["metric_catalogue"] = catalogue
SQL["metric_catalogue"] = "SELECT * FROM (VALUES ('minimise', true, 7::BIGINT), ('minimise', false, 11), ('maximise', true, 1), ('maximise', false, 1)) AS t(direction, requires_truth, count)"

#: Parameters with which each process is simulated here.
SIMULATED = {"fGn": {"H": 0.7, "n": 256}, "fBm": {"H": 0.7, "n": 256}, "ARFIMA": {"d": 0.3, "n": 256}, "MRW": {"H": 0.6, "n": 256, "lambda2": 0.04}, "fOU": {"H": 0.7, "n": 128, "theta": 0.2, "burnin": 256}}


def simulated(family: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = spark.createDataFrame([(f"{family}-{i}", family, json.dumps(SIMULATED[family]), 1000 + i) for i in range(8)], "record_id string, family string, params_json string, seed long")
        made = generate(rows).select("record_id", F.posexplode("values").alias("t", "v"))
        return made.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("v"), 5).alias("mean"), rounded(F.stddev_pop("v"), 5).alias("std"))

    return query


for _f in SIMULATED:
    QUERIES[f"generate_{_f.lower()}"] = simulated(_f)


def every_estimator(spark: SparkSession, sf: str) -> DataFrame:
    """All built-in estimators on the series by event type, with a few replicates."""
    rows = pack(VIEWS["E5"](spark, sf)).select(F.col("series_id").alias("record_id"), F.lit(3).cast("long").alias("seed"), "values")
    out = estimate(rows, [EstimatorSpec(n, params={"n_bootstrap": 8}) for n in KERNELS])
    return out.select("record_id", "estimator_name", rounded("point").alias("point"), "valid", "failure_reason")


QUERIES["estimate_all"] = every_estimator


def suite(name: str) -> Query:
    """A packaged suite's aggregates, without the measured times."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = runner.run(spark, name).aggregates.filter("metric_name != 'runtime'")
        return out.select("estimator_name", "metric_name", "nominal", rounded("value").alias("value"), "stratum", "n_strata")

    return query


for _s in ("smoke_ground_truth", "smoke_stress_test", "smoke_observational", "benchmark_rs_gph", "small_canonical", "small_stress", "small_null", "small_sensitivity", "medium_canonical", "medium_stress", "medium_null", "medium_sensitivity"):
    QUERIES[f"suite_{_s}"] = suite(_s)
