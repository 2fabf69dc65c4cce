"""Estimators by name in SQL: grouped aggregates, and a table function that gives a row for each estimator."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, pandas_udf

from perdura.kernels.estimators import KERNELS, Kernel

PREFIX = "lrd_"


def point_of(kernel: Kernel, values: np.ndarray, params: dict | None = None) -> float | None:
    """One estimate; None where it is invalid or the series is empty."""
    point = float(kernel(values[None, :], params or {})[0]) if len(values) else math.nan
    return point if math.isfinite(point) else None


def aggregate(kernel: Kernel):
    """A grouped aggregate of (place, value): values in order of their places, those without a value left out."""

    def estimate(t: pd.Series, v: pd.Series) -> float:
        there = v.notna().to_numpy()
        values = v.to_numpy(dtype=float, na_value=np.nan)[there]
        return point_of(kernel, values[np.argsort(t.to_numpy()[there], kind="stable")])

    return pandas_udf(estimate, "double")


def table_function(kernels: dict[str, Kernel]):
    """Rows series_id, n, estimator_name and point for a table of (series_id, t, v), partitioned by series_id and ordered by t."""

    schema = pa.schema([("series_id", pa.string()), ("n", pa.int64()), ("estimator_name", pa.string()), ("point", pa.float64())])

    class Estimates:
        def __init__(self) -> None:
            self.series_id, self.values = None, []

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            if rows.num_rows:
                self.series_id = rows.column("series_id")[0].as_py()
                self.values.append(rows.column("v").drop_null().to_numpy(zero_copy_only=False).astype(float))
            yield from ()

        def terminate(self) -> Iterator[pa.Table]:
            if self.series_id is not None:
                x = np.concatenate(self.values)
                points = [point_of(kernel, x) for kernel in kernels.values()]
                yield pa.table([[self.series_id] * len(points), [len(x)] * len(points), list(kernels), points], schema=schema)

    return arrow_udtf(Estimates, returnType="series_id string, n long, estimator_name string, point double")


def register(spark: SparkSession, plugins: dict[str, Kernel] | None = None) -> list[str]:
    """Makes every estimator, built-in or own, an SQL aggregate lrd_<name>(t, v), and all of them lrd_estimates(TABLE ...); the names made."""
    known = {**KERNELS, **(plugins or {})}
    for name, kernel in known.items():
        spark.udf.register(PREFIX + name.lower(), aggregate(kernel))
    spark.udtf.register(f"{PREFIX}estimates", table_function(known))
    return sorted([PREFIX + name.lower() for name in known] + [f"{PREFIX}estimates"])
