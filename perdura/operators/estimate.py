"""Estimates with bootstrap intervals, by Arrow kernels over packed series.

Every (record, estimator, range of replicates) is one job. A record's jobs are dealt in turn
to a few rows, each with the series once, and these to different tasks, so that a long series
takes several tasks and is not shuffled once for each job; replicates are brought together by
record and estimator. A record's seed is in the row, and a range's replicates are those that
the whole stream has there, which makes results independent of ranges, of partitioning and of
retries.
"""

from __future__ import annotations

import json
import math
import time
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura.kernels.estimators import Kernel
from perdura.kernels.resample import percentile_intervals, replicates
from perdura.plans.registry import EstimatorSpec, kernel_of

ESTIMATES = (
    "record_id string, estimator_name string, point double, ci_low double, ci_high double, stderr double, valid boolean, "
    "runtime_seconds double, failure_reason string, bootstrap_cis array<struct<nominal:double,ci_low:double,ci_high:double>>, "
    "bootstrap_std double, bootstrap_used int, point_alt double, warnings array<string>"
)


#: Replicates in one job, most and least; values that they have together where the least are not more; rows that a record's jobs are dealt to at most.
RANGE, LEAST, VALUES, ROWS = 50, 10, 200_000, 24
PARTS = "record_id string, spec int, part int, point double, point_alt double, runtime_seconds double, failure_reason string, replicates array<double>, warnings array<string>"


def fit_range(kernel: Kernel, params: dict, x: np.ndarray, seed: int | None, eps: float | None, first: int, count: int) -> dict:
    """Some replicates of a point, with the different warnings that the kernel gave; the first range has the point, its time and the refit."""
    out: dict = dict.fromkeys(("point", "point_alt", "runtime_seconds", "failure_reason")) | {"replicates": []}
    with warnings.catch_warnings(record=True) as given:
        warnings.simplefilter("always")
        began = time.perf_counter()
        try:
            if not first:
                point = float(kernel(x[None, :], params)[0]) if len(x) else math.nan
                out["runtime_seconds"] = time.perf_counter() - began
                out["point"] = point if math.isfinite(point) else None
            if len(x) and (first or out["point"] is not None):
                block = int(params.get("bootstrap_block_len", 0) or 0) or max(4, len(x) // 10)
                mask = ((seed or 0) + kernel.seed_offset if seed is not None else kernel.seed_offset) & 0xFFFFFFFF
                got = np.concatenate([kernel(r, params) for r in replicates(x, int(params.get("n_bootstrap", 200)), block, mask, first, count)])
                out["replicates"] = got[np.isfinite(got)].tolist()
                if eps is not None and not first:
                    again = float(kernel(x[None, :] * (1 + eps), params)[0])
                    out["point_alt"] = again if math.isfinite(again) else None
            else:
                out["failure_reason"] = f"insufficient_signal_for_{kernel.tag}"
        except Exception as e:  # an estimator of any kind may fail; its failure is the result
            out |= {"runtime_seconds": time.perf_counter() - began, "failure_reason": f"exception:{type(e).__name__}:{e}"}
    return out | {"warnings": list(dict.fromkeys(str(w.message) for w in given))}


def combined(parts: list[dict], params: dict) -> dict:
    """One estimate from its ranges in order; params may set n_bootstrap (200), bootstrap_block_len (a tenth) and ci_levels (0.95)."""
    out: dict = dict.fromkeys(("ci_low", "ci_high", "stderr", "bootstrap_std", "point_alt"))
    parts = parts[:1] if parts[0]["failure_reason"] else parts
    out |= {"valid": False, "point": None, "bootstrap_cis": [], "bootstrap_used": 0, "runtime_seconds": parts[0]["runtime_seconds"]}
    out["warnings"] = list(dict.fromkeys(w for p in parts for w in p["warnings"]))
    out["failure_reason"] = next((p["failure_reason"] for p in parts if p["failure_reason"]), None)
    if out["failure_reason"]:
        return out
    got = np.array([v for p in parts for v in p["replicates"]], dtype=float)
    levels = params.get("ci_levels")
    cis = percentile_intervals(got, (0.95,) if levels is None else levels) if len(got) >= 5 else []
    main = next((c for c in cis if abs(c[0] - 0.95) < 1e-9), cis[-1] if cis else None)
    if main:
        out["ci_low"], out["ci_high"] = main[1], main[2]
    out |= {"point": parts[0]["point"], "point_alt": parts[0]["point_alt"], "valid": True, "bootstrap_std": float(got.std()) if len(got) >= 2 else None, "bootstrap_used": len(got)}
    return out | {"bootstrap_cis": [{"nominal": a, "ci_low": lo, "ci_high": hi} for a, lo, hi in cis]}


def fit_one(kernel: Kernel, params: dict, x: np.ndarray, seed: int | None, eps: float | None) -> dict:
    """One estimate, all replicates at once."""
    return combined([fit_range(kernel, params, x, seed, eps, 0, max(1, int(params.get("n_bootstrap", 200))))], params)


def estimate(records: DataFrame, specs: list[EstimatorSpec], eps: float | None = None, plugins: dict[str, Kernel] | None = None, max_workers: int | None = None) -> DataFrame:
    """ESTIMATES for records (record_id, seed, values) and all specs, in at most max_workers tasks at once if given; eps adds the refit on scaled values."""
    every = F.array(*[F.lit(i) for i in range(len(specs))])
    return estimate_jobs(records.select("record_id", "seed", "values", every.alias("specs")), specs, eps, plugins, max_workers)


def estimate_jobs(wanted: DataFrame, specs: list[EstimatorSpec], eps: float | None = None, plugins: dict[str, Kernel] | None = None, max_workers: int | None = None) -> DataFrame:
    """ESTIMATES for rows of record_id, seed, values and specs, different places in specs; each record_id once."""
    own = [(s.name, kernel_of(s.base, plugins), dict(s.params)) for s in specs]
    counts = F.array(*[F.lit(max(1, int(params.get("n_bootstrap", 200)))) for _, _, params in own])
    tasks = max(1, int(max_workers or wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    length = F.greatest(F.coalesce(F.size("values"), F.lit(1)), F.lit(1))
    rows = wanted.withColumn("count", F.greatest(F.lit(LEAST), F.least(F.lit(RANGE), (F.lit(VALUES) / length).cast("int"))))
    ranges = lambda k: F.transform(F.sequence(F.lit(0), F.get(counts, k) - 1, F.col("count")), lambda at: F.struct(k.alias("spec"), at.alias("first")))
    rows = rows.withColumn("jobs", F.flatten(F.transform("specs", ranges))).filter(F.size("jobs") > 0)
    rows = rows.withColumn("among", F.least(F.size("jobs"), F.lit(min(tasks, ROWS)))).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("among") - 1)))
    rows = rows.withColumn("jobs", F.filter("jobs", lambda _, i: i % F.col("among") == F.col("row")))
    jobs = rows.repartitionById(tasks, F.pmod(F.hash("record_id") + F.col("row"), F.lit(tasks))).select("record_id", "seed", "values", "jobs", "count")
    part_schema, target = to_arrow(PARTS), to_arrow(ESTIMATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, seed, x, jobs, count in zip(b.column("record_id").to_pylist(), b.column("seed").to_pylist(), b.column("values"), b.column("jobs").to_pylist(), b.column("count").to_pylist(), strict=True):
                values = np.asarray(x.values, dtype=float) if x.is_valid else np.empty(0)
                rows = [{"record_id": i, "spec": j["spec"], "part": j["first"]} | fit_range(*own[j["spec"]][1:], values, seed, eps, j["first"], count) for j in jobs]
                yield pa.RecordBatch.from_pylist(rows, schema=part_schema)

    def gather(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        name, _, params = own[rows[0]["spec"]]
        return pa.Table.from_pylist([{"record_id": rows[0]["record_id"], "estimator_name": name} | combined(rows, params)], schema=target)

    return jobs.mapInArrow(run, PARTS).groupBy("record_id", "spec").applyInArrow(gather, ESTIMATES)


def to_arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def kernel_points(packed: DataFrame, name: str, params: dict | None = None, plugins: dict[str, Kernel] | None = None) -> DataFrame:
    """series_id, n, estimator_name, point, valid and failure_reason, without bootstrap. Narrow: no shuffle."""
    kernel, params = kernel_of(name, plugins), dict(params or {})
    schema = pa.schema([("series_id", pa.string()), ("n", pa.int64()), ("point", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = [float(kernel(np.asarray(x.values, dtype=float)[None, :], params)[0]) if x.is_valid and len(x.values) else math.nan for x in b.column("values")]
            yield pa.record_batch([b.column("series_id").cast(pa.string()), b.column("n").cast(pa.int64()), pa.array([p if math.isfinite(p) else None for p in points], pa.float64())], schema=schema)

    rows = packed.select("series_id", "n", "values").mapInArrow(run, "series_id string, n long, point double")
    from perdura.operators.native import result

    return result(rows, name, kernel.tag)


def canonical(params: dict) -> str:
    return json.dumps(params, sort_keys=True)
