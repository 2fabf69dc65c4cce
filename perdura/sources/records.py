"""Records of a manifest: grids of simulated series, perturbed copies, CSV files and inline values.

A grid is small and made on the driver; the series themselves are simulated on the
executors from seeds that are in the rows.
"""

from __future__ import annotations

import csv
import hashlib
import json
import math
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perdura.kernels.simulate import CONTAMINATIONS, GENERATORS
from perdura.operators.simulate import generate
from perdura.plans.catalog import S
from perdura.plans.manifest import Manifest, ManifestError, contamination_grid, generator_grid

RECORDS = "record_id string, record_ord long, source_type string, source_name string, family string, params_json string, seed long, estimator_seed long, truth_family string, truth_estimand string, truth_value double, stratum string, stress_role string, clean_record_id string, operator string, operator_params string, operator_seed long, annotations_json string"
#: Annotations that make up a stratum, besides the truth.
STRATUM = ("process_family", "n", "H", "d", "sigma", "stress_role", "contamination_operator", "contamination_family", "contamination_severity", "source_kind", "source_path", "series_index")


def short_hash(*parts: Any) -> str:
    return hashlib.sha1("|".join(map(str, parts)).encode()).hexdigest()[:20]


def stable_seed(*parts: Any) -> int:
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:4], "big") % (2**31 - 1)


def severity(params: dict[str, Any]) -> str:
    if params.get("severity") is not None:
        return str(params["severity"])
    return ";".join(f"{k}={v}" for k, v in sorted(params.items())) or "default"


def stratum_of(notes: dict[str, Any], truth: tuple[str, float | None] | None) -> str:
    kept = {k: notes[k] for k in STRATUM if k in notes}
    if truth:
        kept |= {"target_estimand": truth[0], "target_value": truth[1]}
    return json.dumps(kept, sort_keys=True)


def grid_rows(m: Manifest, generators: dict | None = None, contaminations: dict | None = None) -> list[tuple]:
    """Rows of RECORDS; own generators and contaminations, by name as in GENERATORS and CONTAMINATIONS, go before the built-in ones."""
    makers, benders = {**GENERATORS, **(generators or {})}, {**CONTAMINATIONS, **(contaminations or {})}
    rows: list[tuple] = []
    scenarios = contamination_grid(m.contamination) if m.mode == S else []
    for family, params, rep in generator_grid(m.source):
        if family not in makers:
            raise ManifestError(f"unknown generator {family!r}; known: {sorted(makers)}")
        _, estimand, key = makers[family]
        record_id = short_hash(m.manifest_id, family, sorted(params.items()), rep)
        seed, truth = stable_seed(m.manifest_id, family, params, rep), float(params[key])
        notes = {"process_family": family, **params}
        if m.mode == S:
            notes |= {"stress_role": "clean", "contamination_operator": "clean", "contamination_family": "clean", "contamination_severity": "clean"}
        common = (family, json.dumps(params), seed)
        rows.append((record_id, len(rows), "synthetic", family, *common, seed, family, estimand, truth, stratum_of(notes, (estimand, truth)), notes.get("stress_role"), record_id, None, None, None, json.dumps(notes, sort_keys=True)))
        for name, op in scenarios:
            if name not in benders:
                raise ManifestError(f"unknown contamination {name!r}; known: {sorted(benders)}")
            bent = notes | {"stress_role": "contaminated", "contamination_operator": name, "contamination_family": benders[name][1], "contamination_severity": severity(op)}
            own = short_hash(m.manifest_id, record_id, name, sorted(op.items()))
            op_seed = stable_seed(m.manifest_id, "contam", record_id, name, tuple(sorted(op.items())))
            # Perturbed records have no seed of their own, so their estimators draw from the fixed offsets.
            rows.append((own, len(rows), "contaminated", f"contaminated:{name}", *common, None, family, estimand, truth, stratum_of(bent, (estimand, truth)), "contaminated", record_id, name, json.dumps(op), op_seed, json.dumps(bent, sort_keys=True)))
    ids = [r[0] for r in rows]
    if len(set(ids)) != len(ids):
        raise ManifestError("generator blocks overlap: two grid points are the same")
    return rows


def grid_records(spark: SparkSession, m: Manifest, generators: dict | None = None, contaminations: dict | None = None) -> DataFrame:
    """Records with values; a perturbed record simulates its clean series from the same seed."""
    rows = spark.createDataFrame(grid_rows(m, generators, contaminations), RECORDS)
    made = generate(rows, generators)
    benders = {**CONTAMINATIONS, **(contaminations or {})}
    names = [f.name for f in made.schema]
    from collections.abc import Iterator

    import pyarrow as pa

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)

    def bend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, op, params, seed in zip(b.column("values"), b.column("operator").to_pylist(), b.column("operator_params").to_pylist(), b.column("operator_seed").to_pylist(), strict=True):
                values = np.asarray(x.values, dtype=float)
                out.append(benders[op][0](values, np.random.default_rng(seed), **json.loads(params)) if op else values)
            yield pa.record_batch([*(b.column(n) for n in names if n != "values"), pa.array(out, pa.list_(pa.float64()))], names=names)

    return made.mapInArrow(bend, schema)


def finite(values: list[Any], where: str) -> list[float]:
    out = [float(v) for v in values if v not in (None, "") and not math.isnan(float(v))]
    if len(out) < 2:
        raise ManifestError(f"{where}: a series needs at least two samples, at least two finite samples after missing ones are left out")
    return out


def observed_series(m: Manifest, base_dir: Path) -> list[tuple[str, str, dict[str, Any], list[float]]]:
    """(record_id, source_name, annotations, values) of the listed series."""
    out = []
    for i, s in enumerate(m.source["series"]):
        if m.source["type"] == "inline_table":
            values = finite(list(s["values"]), f"series {i}")
            out.append((str(s.get("record_id") or f"{m.manifest_id}_inline_{i}"), "inline_table", {"source_kind": "inline_table", "series_index": i}, values))
            continue
        path = Path(s["path"]) if Path(s["path"]).is_absolute() else base_dir / s["path"]
        if not path.is_file():
            raise FileNotFoundError(f"observational series file not found: {path}")
        column = str(s.get("value_column", "value"))
        with path.open(newline="", encoding="utf-8") as f:
            rows = csv.DictReader(f)
            if column not in (rows.fieldnames or []):
                raise ManifestError(f"{path}: no column {column!r}")
            values = finite([r[column] for r in rows], str(path))
        out.append((str(s.get("record_id") or path.stem), str(path), {"source_kind": "csv", "source_path": str(path), "series_index": i}, values))
    return out


def observed_records(spark: SparkSession, m: Manifest, base_dir: Path) -> DataFrame:
    rows = []
    for i, (rid, name, notes, values) in enumerate(observed_series(m, base_dir)):
        notes = notes | {"n": len(values)}
        seed = stable_seed(m.manifest_id, "observational", rid)
        rows.append((rid, i, "observational", name, None, None, seed, seed, None, None, None, stratum_of(notes, None), None, rid, None, None, None, json.dumps(notes, sort_keys=True), values))
    return spark.createDataFrame(rows, RECORDS + ", values array<double>")


def csv_series(spark: SparkSession, path: str, value_column: str = "value", order: list[str] | None = None) -> DataFrame:
    """Long series of CSV files read by Spark, one series for each file; rows keep the order of order columns or of the file."""
    rows = spark.read.option("header", True).csv(path).withColumn("_place", F.monotonically_increasing_id())
    rows = rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("key"), "*")
    from perdura.sources.series import table_to_series

    return table_to_series(rows.withColumn("_v", F.expr(f"try_cast(`{value_column}` as double)")).filter("not isnan(_v)"), "key", order or ["_place"], "_v")


def records(spark: SparkSession, m: Manifest, base_dir: Path | None = None, generators: dict | None = None, contaminations: dict | None = None) -> DataFrame:
    if m.source["type"] == "generator_grid":
        return grid_records(spark, m, generators, contaminations)
    return observed_records(spark, m, base_dir or Path.cwd())
