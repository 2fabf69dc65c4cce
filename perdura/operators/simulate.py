"""Simulated and perturbed series, by seeded Arrow kernels.

A row's seed decides its series, whatever task it runs in and however often.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from perdura.kernels.simulate import CONTAMINATIONS, GENERATORS


def generate(grid: DataFrame, generators: dict | None = None) -> DataFrame:
    """Adds values to rows with family, params_json and seed; rows of one family and parameters share factors."""
    known = {**GENERATORS, **(generators or {})}
    names = [f.name for f in grid.schema if f.name != "values"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grid.schema if f.name != "values") + ", values array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = []
            for family, params, seed in zip(b.column("family").to_pylist(), b.column("params_json").to_pylist(), b.column("seed").to_pylist(), strict=True):
                values.append(known[family][0](np.random.default_rng(seed), **json.loads(params)))
            arrays = [*(b.column(n) for n in names), pa.array(values, pa.list_(pa.float64()))]
            yield pa.record_batch(arrays, names=[*names, "values"])

    tasks = max(1, int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return grid.repartition(tasks, "family", "params_json", "seed").select(names).mapInArrow(run, schema)


#: Points in one batch of contaminated_points.
POINTS = 1 << 16


def contaminated_points(rows: DataFrame, name: str, params: dict) -> DataFrame:
    """series_id, n, t, v and contaminated, a row for each point of rows with series_id, n, values and seed. Narrow: no shuffle."""
    f = CONTAMINATIONS[name][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n, x, s in zip(b.column("series_id"), b.column("n"), b.column("values"), b.column("seed").to_pylist(), strict=True):
                v = np.asarray(x.values, dtype=float)
                changed = f(v, np.random.default_rng(s), **params)
                for at in range(0, len(v), POINTS):
                    own = v[at : at + POINTS]
                    k = len(own)
                    yield pa.record_batch({"series_id": pa.repeat(i, k), "n": pa.repeat(n, k), "t": pa.array(np.arange(at, at + k)), "v": pa.array(own), "contaminated": pa.array(changed[at : at + k])})

    return rows.select("series_id", "n", "values", "seed").mapInArrow(run, "series_id string, n long, t long, v double, contaminated double")


def contaminate(rows: DataFrame, name: str, params: dict) -> DataFrame:
    """Adds contaminated to rows with values and seed. Narrow: no shuffle."""
    f = CONTAMINATIONS[name][0]
    names = [x.name for x in rows.schema]
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema) + ", contaminated array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [f(np.asarray(x.values, dtype=float), np.random.default_rng(s), **params) for x, s in zip(b.column("values"), b.column("seed").to_pylist(), strict=True)]
            yield pa.record_batch([*(b.column(n) for n in names), pa.array(out, pa.list_(pa.float64()))], names=[*names, "contaminated"])

    return rows.mapInArrow(run, schema)
