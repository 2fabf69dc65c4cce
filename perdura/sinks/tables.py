"""Report tables of a run, as DataFrames with the contract's columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perdura.operators import evaluate
from perdura.plans.catalog import DISAGREEMENT, SENSITIVITY, STRESS
from perdura.plans.runner import Run
from perdura.sources.records import STRATUM


def notes(*names: str) -> Column:
    """Metadata as JSON, of columns that may be null; keys in order."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]))


def metric_rows(run: Run) -> DataFrame:
    """scope, record_id, estimator_name, metric_name, value, stratum_json and metadata_json of all metric rows."""
    one = run.series.select(F.lit("per_series").alias("scope"), "record_id", "estimator_name", "metric_name", "nominal", "value", F.col("stratum").alias("stratum_json"), notes("missing_ci", "nominal", "note").alias("metadata_json"))
    two = run.aggregates.select(F.lit("aggregate").alias("scope"), F.lit(None).cast("string").alias("record_id"), "estimator_name", "metric_name", "nominal", "value", F.col("stratum").alias("stratum_json"), notes("n_strata", "nominal").alias("metadata_json"))
    out = one.unionByName(two)
    if run.uncertainty is not None:
        out = out.unionByName(run.uncertainty.select(F.lit("uncertainty").alias("scope"), F.lit(None).cast("string").alias("record_id"), "estimator_name", "metric_name", "nominal", "value", F.col("stratum").alias("stratum_json"), notes("aggregation", "ci_high", "ci_level", "ci_low", "n").alias("metadata_json")))
    return out


def strata_columns(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    for k in keys:
        df = df.withColumn(f"stratum__{k}", F.get_json_object(column, f"$.{k}"))
    return df


def strata_keys(run: Run) -> list[str]:
    """The keys that strata of this run have, out of those that any can have: one pass that yields one row."""
    known = sorted({*STRATUM, "target_estimand", "target_value"})
    there = run.records.agg(*[F.bool_or(F.array_contains(F.json_object_keys("stratum"), k)).alias(k) for k in known]).first()
    return [k for k in known if there[k]]


def tables(run: Run) -> dict[str, DataFrame]:
    """The tables by name."""
    m, spark = run.manifest, run.records.sparkSession
    every = metric_rows(run)
    show = ["estimator_name", "metric_name", "value", "stratum_json", "metadata_json"]
    scoped = lambda names: every.filter(F.col("metric_name").isin(list(names)) & F.col("scope").isin("per_series", "aggregate")).drop("nominal")
    aggregated = every.filter("scope = 'aggregate'")
    strata = strata_keys(run)
    fail = strata_columns(evaluate.failures(run.series).withColumnRenamed("stratum", "stratum_json"), "stratum_json", strata)
    by = strata_columns(evaluate.failure_map(run.aggregates).withColumnRenamed("stratum", "stratum_json"), "stratum_json", strata)
    specs = [(s.name, s.family, s.target_estimand, s.supports_ci, s.supports_diagnostics, json.dumps(list(s.assumptions)), json.dumps(s.params, sort_keys=True), s.version) for s in m.estimators]
    out = {
        "run_summary": spark.createDataFrame([(run.run_id, m.manifest_id, m.name, m.mode)], "run_id string, manifest_id string, benchmark_name string, mode string"),
        "estimator_metadata": spark.createDataFrame(specs, "estimator_name string, family string, target_estimand string, supports_ci boolean, supports_diagnostics boolean, assumptions_json string, params_json string, version string"),
        "per_stratum_metrics": aggregated.select(show),
        "failure_map": by,
        "failures": fail,
        "estimator_disagreement": scoped(DISAGREEMENT),
        "scale_window_sensitivity": scoped(SENSITIVITY),
        "uncertainty_calibration": aggregated.filter(F.col("metric_name").isin("coverage", "ci_width", "coverage_error")).select("estimator_name", "metric_name", "value", "nominal", "stratum_json"),
        "leaderboard": leaderboards(run),
    }
    uq = run.uncertainty
    shape = "estimator_name string, metric_name string, value double, uncertainty_type string, aggregation string, nominal double, ci_low double, ci_high double, stratum_json string, metadata_json string"
    out["benchmark_uncertainty"] = spark.createDataFrame([], shape) if uq is None else uq.select("estimator_name", "metric_name", "value", "uncertainty_type", "aggregation", F.coalesce("nominal", "ci_level").alias("nominal"), "ci_low", "ci_high", F.col("stratum").alias("stratum_json"), notes("ci_level", "n").alias("metadata_json"))
    if m.mode == "stress_test":
        rows = run.series.filter(F.col("metric_name").isin(list(STRESS))).join(run.records.select("record_id", F.col("operator").alias("contamination_operator"), "clean_record_id"), "record_id")
        out["stress_metrics"] = rows.select("record_id", "estimator_name", "metric_name", "value", F.col("stratum").alias("stratum_json"), "contamination_operator", "clean_record_id", "nominal")
    return out


def leaderboards(run: Run) -> DataFrame:
    spark = run.records.sparkSession
    out = spark.createDataFrame([], "estimator_name string, rank int, score double")
    for b in run.manifest.leaderboards:
        one = run.leaderboards[b.name].select("estimator_name", "rank", "score", *[F.element_at("components", k).alias(f"metric__{k}") for k in b.weights])
        out = out.unionByName(one, allowMissingColumns=True)
    return out


def raw_tables(run: Run) -> dict[str, DataFrame]:
    r = run.records
    out = {
        "records": r.select("record_id", "source_type", "source_name", F.size("values").alias("n"), F.lit("raw/values.parquet").alias("values_path"), "truth_family", F.col("truth_estimand").alias("target_estimand"), F.col("truth_value").alias("target_value"), "annotations_json"),
        "estimates": run.estimates.select("record_id", "estimator_name", "point", "ci_low", "ci_high", "stderr", "valid", "runtime_seconds", "failure_reason", F.coalesce(F.array_join("warnings", "|"), F.lit("")).alias("warnings"), F.to_json("bootstrap_cis").alias("bootstrap_cis_json")),
        "metrics": metric_rows(run).drop("nominal"),
    }
    if run.leaderboards:
        parts = [b.select("estimator_name", "rank", "score", F.to_json("components").alias("components_json")) for b in run.leaderboards.values()]
        boards = parts[0]
        for p in parts[1:]:
            boards = boards.unionByName(p)
        out["leaderboards"] = boards
    return out
