"""Metrics: per series, by stratum, over strata, with uncertainty, and ranked.

facts() joins records and estimates once; each metric is an expression over that or a
join of it with itself by record. Only the metrics asked for are planned.

records: record_id, record_ord, stratum (JSON), truth_estimand, truth_value, stress_role,
clean_record_id. estimates: record_id, estimator_name, point, ci_low, ci_high, valid,
runtime_seconds, bootstrap_cis, bootstrap_std, point_alt. specs: estimator_name, ord,
family, estimand, base, a small table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perdura.plans.catalog import DISAGREEMENT, METRICS, SENSITIVITY, STRESS, MetricSpec
from perdura.plans.registry import EstimatorSpec

GLOBAL = '{"level":"balanced_global"}'
ALL = "__all_estimators__"
ROW = ["record_id", "estimator_name", "metric_name", "nominal", "value", "missing_ci", "stratum", "note"]


def spec_table(spark: SparkSession, specs: list[EstimatorSpec]) -> DataFrame:
    rows = [(s.name, i, s.family, s.target_estimand, s.base) for i, s in enumerate(specs)]
    return spark.createDataFrame(rows, "estimator_name string, ord int, family string, estimand string, base string")


def facts(records: DataFrame, estimates: DataFrame, specs: DataFrame) -> DataFrame:
    """One row for each record and estimator. specs has a row per enrolled estimator: a few, so it is broadcast."""
    records = records.select("record_id", "stratum", "truth_estimand", "truth_value", "stress_role", "clean_record_id")
    usable = F.col("valid") & F.col("point").isNotNull() & ~F.isnan("point")
    fact = records.join(estimates, "record_id").join(F.broadcast(specs), "estimator_name")
    return fact.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("compatible", F.col("truth_estimand").isNull() | (F.col("truth_estimand") == F.col("estimand")))


CELL = "struct<estimator_name:string,metric_name:string,nominal:double,value:double,missing_ci:boolean,note:string>"


def cell(name: str, value: Column, nominal: float | None = None, missing: Column | None = None, note: Column | None = None, estimator: Column | None = None) -> Column:
    """One metric value as a struct."""
    return F.struct(
        (F.col("estimator_name") if estimator is None else estimator).alias("estimator_name"), F.lit(name).alias("metric_name"), F.lit(nominal).cast("double").alias("nominal"),
        value.cast("double").alias("value"), (F.lit(False) if missing is None else missing).alias("missing_ci"), (F.lit(None).cast("string") if note is None else note).alias("note"),
    ).cast(CELL)


def spread_out(df: DataFrame, cells: list[Column]) -> DataFrame:
    """ROW rows from columns that are cells (null for none) or arrays of cells: one pass over df for all metrics."""
    every = F.filter(F.flatten(F.array(*cells)), lambda c: c.isNotNull())
    return df.select("record_id", "stratum", F.explode(every).alias("c")).select("record_id", "c.estimator_name", "c.metric_name", "c.nominal", "c.value", "c.missing_ci", "stratum", "c.note")


def single(condition: Column, c: Column) -> Column:
    return F.array(F.when(condition, c))


def interval(level: float, prefix: str = "") -> Column:
    """The interval of a level; without one, for 0.95, the main interval; else null."""
    cis, low, high = F.col(prefix + "bootstrap_cis"), F.col(prefix + "ci_low"), F.col(prefix + "ci_high")
    found = F.get(F.filter(cis, lambda c: F.abs(c["nominal"] - level) < 1e-9), F.lit(0))
    own = F.when(found.isNotNull(), F.struct(found["ci_low"].alias("low"), found["ci_high"].alias("high")))
    main = F.when(low.isNotNull() & high.isNotNull(), F.struct(low.alias("low"), high.alias("high"))) if abs(level - 0.95) < 1e-9 else None
    return own if main is None else F.coalesce(own, main)


def false_positive(m: MetricSpec) -> tuple[Column, Column]:
    """Threshold and the largest truth that counts as none, by estimand."""
    hurst = F.col("truth_estimand") == "hurst_scaling_proxy"
    pick = lambda k, a, b: F.lit(float(m.parameters[k])) if m.parameters.get(k) is not None else F.when(hurst, a).otherwise(b)
    return pick("threshold", 0.6, 0.1), pick("null_max", 0.5, 0.0)


def per_series(fact: DataFrame, metrics: list[MetricSpec], mode: str) -> DataFrame:
    """Long metric rows for every record and estimator, and for pairs, families and variants of estimators."""
    names = {m.name: m for m in metrics}
    out: list[DataFrame] = []
    if cells := own_cells(metrics):
        out.append(spread_out(fact, cells))
    if mode == "stress_test" and names.keys() & set(STRESS):
        out.append(stress_rows(fact, names))
    if names.keys() & {*DISAGREEMENT, *SENSITIVITY}:
        out.append(group_rows(fact, names))
    return reduce(DataFrame.unionByName, out) if out else spread_out(fact, [single(F.lit(False), cell("", F.lit(0.0)))])


def own_cells(metrics: list[MetricSpec]) -> list[Column]:
    """Metrics of a record and estimator by themselves."""
    y, p, ok = F.col("truth_value"), F.col("point"), F.col("ok")
    true = ok & F.col("compatible") & y.isNotNull()
    out = []
    for m in metrics:
        if m.name in ("bias", "mae", "rmse"):
            out.append(single(true, cell(m.name, {"bias": p - y, "mae": F.abs(p - y), "rmse": (p - y) * (p - y)}[m.name])))
        elif m.name in ("coverage", "ci_width"):
            for level in m.nominal_levels:
                ci = interval(level)
                value = F.when((ci["low"] <= y) & (y <= ci["high"]), 1.0).otherwise(0.0) if m.name == "coverage" else ci["high"] - ci["low"]
                out.append(single(true if m.name == "coverage" else ok, cell(m.name, F.when(ci.isNotNull(), value), level, ci.isNull())))
        elif m.name == "validity_rate":
            out.append(single(F.lit(True), cell(m.name, F.col("valid"))))
        elif m.name == "runtime":
            out.append(single(F.lit(True), cell(m.name, F.coalesce("runtime_seconds", F.lit(0.0)))))
        elif m.name == "instability":
            out.append(single(F.col("bootstrap_std").isNotNull(), cell(m.name, F.col("bootstrap_std"))))
        elif m.name == "preprocessing_sensitivity":
            eps = max(float(m.parameters.get("eps", 1e-4)), 1e-12)
            out.append(single(ok, cell(m.name, F.abs(F.col("point_alt") - p) / eps, note=F.when(F.col("point_alt").isNull(), "missing_alt"))))
        elif m.name == "false_positive_lrd_rate":
            threshold, null_max = false_positive(m)
            out.append(single(true & (y <= null_max), cell(m.name, F.when(p >= threshold, 1.0).otherwise(0.0))))
    return out


def stress_rows(fact: DataFrame, names: dict[str, MetricSpec]) -> DataFrame:
    """Contaminated estimates against those of their clean records."""
    clean = fact.filter("stress_role = 'clean'").select(F.col("record_id").alias("clean_record_id"), "estimator_name", *[F.col(c).alias(f"clean_{c}") for c in ("ok", "valid", "point", "ci_low", "ci_high", "bootstrap_cis")])
    both = fact.filter("stress_role = 'contaminated'").join(clean, ["clean_record_id", "estimator_name"])
    y, p, q = F.col("truth_value"), F.col("point"), F.col("clean_point")
    valid, cells = F.col("ok") & F.col("clean_ok"), []
    if "estimate_drift" in names:
        cells.append(single(valid, cell("estimate_drift", F.abs(p - q))))
    if "relative_degradation_ratio" in names:
        cells.append(single(valid & (F.abs(q - y) >= 1e-12), cell("relative_degradation_ratio", F.try_divide(F.abs(p - y), F.abs(q - y)))))
    if "validity_collapse" in names:
        cells.append(single(F.lit(True), cell("validity_collapse", F.col("clean_valid") & ~F.col("valid"))))
    if "coverage_collapse" in names:
        hit = lambda ci: F.when((ci["low"] <= y) & (y <= ci["high"]), 1.0).otherwise(0.0)
        for level in names["coverage_collapse"].nominal_levels:
            a, b = interval(level, "clean_"), interval(level)
            known = a.isNotNull() & b.isNotNull()
            cells.append(single(y.isNotNull(), cell("coverage_collapse", F.when(known, F.greatest(F.lit(0.0), hit(a) - hit(b))), level, ~known)))
    return spread_out(both, cells)


def least(names: dict[str, MetricSpec], group: tuple[str, ...], key: str) -> int:
    return min((int(names[n].parameters.get(key, 2)) for n in group if n in names), default=2)


def mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))


def deviation(values: Column) -> Column:
    """Population standard deviation of an array."""
    m = mean(values)
    return F.sqrt(mean(F.transform(values, lambda v: (v - m) * (v - m))))


def group_rows(fact: DataFrame, names: dict[str, MetricSpec]) -> DataFrame:
    """Metrics over the valid estimates of a record, gathered in order of enrolment.

    A record has as many as there are enrolled estimators, whatever the number of records,
    so one grouping by record serves dispersion, pairs, families and variants.
    """
    rows = fact.filter("ok").groupBy("record_id", "stratum").agg(F.sort_array(F.collect_list(F.struct("ord", "estimator_name", "family", "base", "point"))).alias("g"))
    points = F.transform("g", lambda e: e["point"])
    gaps = F.flatten(F.transform("g", lambda a: F.transform(F.filter("g", lambda b: b["ord"] > a["ord"]), lambda b: F.struct(a["estimator_name"].alias("a"), b["estimator_name"].alias("b"), F.least(a["family"], b["family"]).alias("fa"), F.greatest(a["family"], b["family"]).alias("fb"), F.abs(a["point"] - b["point"]).alias("gap")))))
    rows = rows.withColumn("pairs", gaps)
    need = least(names, DISAGREEMENT, "min_estimators")
    enough, cells = F.size("g") >= need, []
    if "cross_estimator_dispersion" in names:
        cells.append(single(enough, cell("cross_estimator_dispersion", deviation(points), estimator=F.lit(ALL))))
    if "pairwise_estimator_disagreement" in names:
        cells.append(F.when(enough, F.transform("pairs", lambda x: cell("pairwise_estimator_disagreement", x["gap"], estimator=F.concat_ws("__vs__", x["a"], x["b"])))).otherwise(F.array().cast(f"array<{CELL}>")))
    if "family_level_disagreement" in names:
        kinds = F.array_distinct(F.transform("pairs", lambda x: F.struct(x["fa"].alias("fa"), x["fb"].alias("fb"))))
        large = F.filter(kinds, lambda k: (k["fa"] != k["fb"]) | (F.size(F.filter("g", lambda e: e["family"] == k["fa"])) >= max(2, need)))
        gap = lambda k: mean(F.transform(F.filter("pairs", lambda x: (x["fa"] == k["fa"]) & (x["fb"] == k["fb"])), lambda x: x["gap"]))
        name = lambda k: F.concat(F.lit("family:"), k["fa"], F.when(k["fa"] != k["fb"], F.concat(F.lit("__vs__"), k["fb"])).otherwise(""))
        cells.append(F.when(enough, F.transform(large, lambda k: cell("family_level_disagreement", gap(k), estimator=name(k)))).otherwise(F.array().cast(f"array<{CELL}>")))
    variants = least(names, SENSITIVITY, "min_variants")
    bases = F.array_distinct(F.transform("g", lambda e: e["base"]))
    of = lambda base: F.transform(F.filter("g", lambda e: e["base"] == base), lambda e: e["point"])
    several = F.filter(bases, lambda b: F.size(of(b)) >= variants)
    if "parameter_variant_sensitivity" in names:
        cells.append(F.transform(several, lambda b: cell("parameter_variant_sensitivity", deviation(of(b)), estimator=b)))
    if "max_variant_drift" in names:
        cells.append(F.transform(several, lambda b: cell("max_variant_drift", F.array_max(of(b)) - F.array_min(of(b)), estimator=b)))
    return spread_out(rows, cells)


def aggregate(series: DataFrame, metrics: list[MetricSpec]) -> DataFrame:
    """estimator_name, metric_name, nominal, value, stratum, n_strata: by stratum, and the mean over strata.

    The mean over strata is of strata, not of series, so it is no rollup of the first step.
    """
    named = series.filter("value is not null").groupBy("estimator_name", "metric_name", "stratum", "nominal").agg(F.avg("value").alias("value"))
    by = named.withColumn("value", F.when(F.col("metric_name") == "rmse", F.sqrt("value")).otherwise(F.col("value")))
    own = F.struct("metric_name", "value")
    error = F.struct(F.lit("coverage_error").alias("metric_name"), F.abs(F.col("value") - F.col("nominal")).alias("value"))
    wanted = any(m.name == "coverage_error" for m in metrics)
    each = F.when((F.col("metric_name") == "coverage") & F.lit(wanted), F.array(own, error)).otherwise(F.array(own))
    # Every row counts for its stratum, where it is alone, and for the mean over strata: one more grouping gives both.
    both = by.select("estimator_name", "nominal", "stratum", F.explode(each).alias("m")).select("estimator_name", "nominal", "m.*", F.explode(F.array("stratum", F.lit(GLOBAL))).alias("stratum"))
    out = both.groupBy("estimator_name", "metric_name", "nominal", "stratum").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("k"))
    return out.select("estimator_name", "metric_name", "nominal", "value", "stratum", F.when(F.col("stratum") == GLOBAL, F.col("k")).alias("n_strata"))


def leaderboard(aggregates: DataFrame, names: list[str], weights: dict[str, float]) -> DataFrame:
    """estimator_name, rank, score and components (map), by weighted ranks of the means over strata.

    Equal values rank by name; equal scores too. A missing value counts as infinite, so
    it ranks last where less is better, and first where more is.
    """
    spark = aggregates.sparkSession
    rows = aggregates.filter((F.col("stratum") == GLOBAL) & F.col("estimator_name").isin(names) & F.col("metric_name").isin(list(weights)))
    mean = rows.groupBy("estimator_name", "metric_name").agg(F.avg("value").alias("value"))
    seen = rows.select("estimator_name").distinct()
    parts = spark.createDataFrame([(k, float(w), METRICS[k].optimisation_direction == "maximise") for k, w in weights.items()], "metric_name string, weight double, up boolean")
    grid = seen.join(F.broadcast(parts)).join(mean, ["estimator_name", "metric_name"], "left")  # as many rows as weights for each estimator
    missing = F.lit(float("inf"))
    key = F.when(F.col("up"), -F.coalesce("value", missing)).otherwise(F.coalesce("value", missing))
    ranked = grid.withColumn("place", F.row_number().over(Window.partitionBy("metric_name").orderBy(key, "estimator_name")))
    board = ranked.groupBy("estimator_name").agg(F.sum(F.col("weight") * F.col("place")).alias("score"), F.map_from_entries(F.collect_list(F.struct("metric_name", "value"))).alias("components"))
    return board.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9), "estimator_name"))).select("estimator_name", "rank", "score", "components")


def failures(series: DataFrame) -> DataFrame:
    """Counts of missing and invalid results by estimator and stratum."""
    valid = F.col("metric_name") == "validity_rate"
    g = series.groupBy("estimator_name", "stratum").agg(
        F.count(F.lit(1)).alias("n_metric_rows"),
        F.sum(F.col("value").isNull().cast("long")).alias("n_missing_values"),
        F.sum(F.col("missing_ci").cast("long")).alias("n_missing_uncertainty"),
        F.sum(valid.cast("long")).alias("n_validity_observations"),
        F.sum((valid & (F.col("value") == 0)).cast("long")).alias("n_invalid_estimates"),
    )
    return g.withColumn("invalid_rate", F.try_divide("n_invalid_estimates", "n_validity_observations")).withColumn("missing_value_rate", F.try_divide("n_missing_values", "n_metric_rows"))


def metric_column(name: Column, nominal: Column) -> Column:
    return F.concat(F.lit("metric__"), name, F.when(nominal.isNotNull(), F.concat(F.lit("__nominal_"), nominal.cast("string"))).otherwise(""))


def failure_map(aggregates: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Estimator and stratum by metrics; give the columns to spare the job that finds them."""
    rows = aggregates.filter(F.col("stratum") != GLOBAL).withColumn("column", metric_column(F.col("metric_name"), F.col("nominal")))
    by = rows.groupBy("estimator_name", "stratum")
    return (by.pivot("column", columns) if columns else by.pivot("column")).agg(F.first("value"))
