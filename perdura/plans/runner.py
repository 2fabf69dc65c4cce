"""Runs a manifest: records, estimates, metrics, aggregates, uncertainty, leaderboards, as DataFrames."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perdura.interfaces import Evaluator, LeaderboardBuilder
from perdura.kernels.estimators import Kernel
from perdura.operators import evaluate, uncertainty
from perdura.operators.estimate import ESTIMATES, estimate, estimate_jobs
from perdura.plans.catalog import O
from perdura.plans.manifest import LeaderboardSpec, Manifest, manifest_of
from perdura.plans.registry import kernel_of
from perdura.plans.suites import resolve
from perdura.sources.records import records as records_of

VERSION = "1"


@dataclass
class Run:
    run_id: str
    manifest: Manifest
    records: DataFrame
    estimates: DataFrame
    series: DataFrame
    aggregates: DataFrame
    uncertainty: DataFrame | None
    leaderboards: dict[str, DataFrame] = field(default_factory=dict)
    kept: list[DataFrame] = field(default_factory=list)

    def close(self) -> None:
        """Frees what the run keeps in memory; its tables are then computed anew where they are used."""
        for df in self.kept:
            df.unpersist()
        self.kept = []

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def cached_estimates(rows: DataFrame, m: Manifest, eps: float | None, plugins: dict[str, Kernel] | None, kept: list[DataFrame]) -> DataFrame:
    """Estimates, read from and added to a Parquet cache if the manifest names one.

    A cache entry is keyed by record, values, and the estimator with its version and parameters (spec_hash, by which the
    cache is partitioned, so a run reads only its estimators' files). One join finds what is there and what is not, and
    one stage fits the rest, however many estimators there are. What is kept in memory is added to kept.
    """
    folder = m.execution.get("estimate_cache_dir")
    workers = m.execution.get("max_workers")
    if not folder:
        return estimate(rows, m.estimators, eps, plugins, workers)
    spark = rows.sparkSession
    hashes = [hashlib.sha1(json.dumps([s.name, s.version, VERSION, s.params, eps], sort_keys=True, default=str).encode()).hexdigest() for s in m.estimators]
    specs = F.array(*[F.struct(F.lit(i).alias("spec"), F.lit(s.name).alias("estimator_name"), F.lit(h).alias("spec_hash")) for i, (s, h) in enumerate(zip(m.estimators, hashes, strict=True))])
    marked = rows.withColumn("values_hash", F.sha2(F.to_json(F.struct("values", "seed")), 256))
    wanted = marked.select("record_id", "values_hash", F.inline(specs))
    stored = read_cache(spark, folder) if m.execution.get("cache_read", True) else None
    columns = [c.split()[0] for c in ESTIMATES.split(", ") if " " in c]
    if stored is None:
        missing, hits = wanted, None
    else:
        on = ["record_id", "estimator_name", "values_hash", "spec_hash"]
        there = stored.filter(F.col("spec_hash").isin(hashes)).dropDuplicates(on).withColumn("_hit", F.lit(True))
        both = wanted.join(there, on, "left").persist()
        kept.append(both)
        hits, missing = both.filter("_hit").select(*columns), both.filter("_hit is null").select(*wanted.columns)
    jobs = marked.select("record_id", "seed", "values").join(missing.groupBy("record_id").agg(F.sort_array(F.collect_list("spec")).alias("specs")), "record_id")
    keys = missing.select("record_id", "estimator_name", "values_hash", "spec_hash")
    fresh = estimate_jobs(jobs, m.estimators, eps, plugins, workers).join(keys, ["record_id", "estimator_name"]).persist()
    kept.append(fresh)
    if m.execution.get("cache_write", True):
        fresh.write.mode("append").partitionBy("spec_hash").parquet(folder)
    fresh = fresh.select(*columns)
    return fresh if hits is None else hits.unionByName(fresh)


def read_cache(spark: SparkSession, folder: str) -> DataFrame | None:
    """The cache's rows, or None if there is none yet."""
    try:
        return spark.read.schema(f"values_hash string, {ESTIMATES}, spec_hash string").parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def compact_cache(spark: SparkSession, folder: str, target: str) -> None:
    """Writes the cache's rows, each key once and a few files for each estimator, to another folder."""
    rows = read_cache(spark, folder)
    if rows is not None:
        rows.dropDuplicates(["record_id", "estimator_name", "values_hash", "spec_hash"]).repartition("spec_hash", F.pmod(F.xxhash64("record_id"), F.lit(8))).write.partitionBy("spec_hash").parquet(target)


def run(
    spark: SparkSession,
    manifest: Manifest | dict | str,
    base_dir: Path | None = None,
    plugins: dict[str, Kernel] | None = None,
    generators: dict | None = None,
    contaminations: dict | None = None,
    evaluator: Evaluator | None = None,
    leaderboard_builder: LeaderboardBuilder | None = None,
) -> Run:
    """Runs a manifest, a mapping, a path or a packaged suite's name. Records and estimates are computed once and kept until
    the run is closed.

    Own estimators, generators and contaminations are given by name and go before the built-in ones; an own evaluator or
    leaderboard builder takes the place of the built-in one.
    """
    m = manifest if isinstance(manifest, Manifest) else manifest_of(manifest) if isinstance(manifest, dict) else resolve(manifest)
    for s in m.estimators:
        kernel_of(s.base, plugins)
    rows = records_of(spark, m, base_dir, generators, contaminations).persist()
    eps = float(m.preprocessing.get("sensitivity_eps", 1e-4)) if m.mode == O else None
    work = rows.withColumn("seed", F.col("estimator_seed"))
    kept: list[DataFrame] = []
    estimates = cached_estimates(work, m, eps, plugins, kept).persist()
    fact = evaluate.facts(rows, estimates, evaluate.spec_table(spark, m.estimators))
    evaluator, builder = evaluator or CatalogueEvaluator(), leaderboard_builder or WeightedRank()
    series = evaluator.per_series(m, fact).persist()
    aggregates = evaluator.aggregate(m, series).persist()
    out = Run(uuid.uuid4().hex, m, rows, estimates, series, aggregates, benchmark_uncertainty(series, aggregates, m), kept=[rows, estimates, series, aggregates, *kept])
    for b in m.leaderboards:
        out.leaderboards[b.name] = builder.build(m, b, aggregates)
    return out


class CatalogueEvaluator(Evaluator):
    """The catalogue's metrics."""

    def per_series(self, manifest: Manifest, facts: DataFrame) -> DataFrame:
        return evaluate.per_series(facts, manifest.metrics, manifest.mode)

    def aggregate(self, manifest: Manifest, series: DataFrame) -> DataFrame:
        return evaluate.aggregate(series, manifest.metrics)


class WeightedRank(LeaderboardBuilder):
    """Weighted mean of the ranks by component."""

    def build(self, manifest: Manifest, board: LeaderboardSpec, aggregates: DataFrame) -> DataFrame:
        return evaluate.leaderboard(aggregates, [s.name for s in manifest.estimators], board.weights)


def benchmark_uncertainty(series: DataFrame, aggregates: DataFrame, m: Manifest) -> DataFrame | None:
    """Bootstrap rows of the manifest's uncertainty block, with type and aggregation; None if it is off."""
    u = m.uncertainty
    if not u or not u.get("enabled", True):
        return None
    names = list(u.get("metrics") or [x.name for x in m.metrics])
    levels = tuple(float(a) for a in u.get("ci_levels") or (0.95,))
    seed = int(u["seed"] if u.get("seed") is not None else m.seeds.get("global_seed", 0))
    n = int(u.get("n_bootstrap", 200))
    kept = lambda df: df.filter(F.col("metric_name").isin(names))
    label = lambda df, kind, how: df.withColumn("uncertainty_type", F.lit(kind)).withColumn("aggregation", F.lit(how))
    out = label(uncertainty.bootstrap(kept(uncertainty.within(series)), n, levels, seed), "bootstrap", "bootstrap_within_stratum")
    out = out.unionByName(label(uncertainty.bootstrap(kept(uncertainty.over_strata(aggregates)), n, levels, seed, root=False), "bootstrap", "bootstrap_over_strata"))
    if u.get("paired"):
        chosen = list(u.get("paired_metrics") or names)
        out = out.unionByName(label(uncertainty.bootstrap(uncertainty.paired(series, chosen), n, levels, seed, root=False), "paired_bootstrap", "paired_bootstrap_difference"))
    return out
