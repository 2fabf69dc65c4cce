"""Rolling rescaled-range estimates over event streams: tumbling windows of event time.

An addition of this library. In the plain form a window's state keeps its values, as their
order is known only when it closes: events of a window and key must fit in a task. Late
events beyond the watermark are left out.

In the merged form a window is made of slots. A slot keeps its values only until the
watermark has passed it; then they are summarised by their number, their sums and the convex
hulls of their running sums, which is all that the range of the running sum needs, whatever
the window's mean will be. Summaries of neighbouring slots merge by shifting one hull and
joining both, so a window's state is a few points for each slot, not its values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perdura.functions.columns import rounded
from perdura.sources.series import read

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Values that a window needs for an estimate.
LEAST = 16


def windowed(events: DataFrame, size: str = "1 day", late: str | None = None, keep_window: bool = False) -> DataFrame:
    """event_type, window_start and the window's values in order of time; for batch and streaming frames."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id", "value").filter("value is not null")
    if late:
        rows = rows.withWatermark("ts", late)
    grouped = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("x"))
    return grouped.select("event_type", F.col("w") if keep_window else F.col("w.start").alias("window_start"), F.transform("x", lambda r: r["value"]).alias("values"))


def rescaled_range(windows: DataFrame) -> DataFrame:
    """n and h of each window, by expressions: h is null below LEAST values or without variation."""
    x, n = F.col("values"), F.size("values")
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    rows = windows.withColumn("n", n.cast("long")).withColumn("mean", mean)
    start = F.struct(F.lit(0.0).alias("y"), F.lit(float("-inf")).alias("top"), F.lit(float("inf")).alias("low"), F.lit(0.0).alias("ss"))

    def step(a, v):
        d = v - F.col("mean")
        y = a["y"] + d
        return F.struct(y.alias("y"), F.greatest(a["top"], y).alias("top"), F.least(a["low"], y).alias("low"), (a["ss"] + d * d).alias("ss"))

    rows = rows.withColumn("a", F.aggregate(x, start, step))
    r, s = F.col("a.top") - F.col("a.low"), F.sqrt(F.col("a.ss") / F.col("n"))
    ok = (F.col("n") >= LEAST) & (r >= 1e-12) & (s >= 1e-12)
    return rows.select("event_type", "window_start", "n", F.when(ok, F.log(r / s) / F.log(F.col("n").cast("double"))).alias("h"))


SUMMARY = "n long, total double, squares double, at array<long>, high array<double>, low_at array<long>, low array<double>"


def hull(t: np.ndarray, s: np.ndarray) -> tuple[list[int], list[float]]:
    """The points of (t, s), in order of t, where s - m t can be largest for some m: the upper convex hull."""
    at: list[int] = []
    top: list[float] = []
    for x, y in zip(t.tolist(), s.tolist(), strict=True):
        while len(at) > 1 and (top[-1] - top[-2]) * (x - at[-2]) <= (y - top[-2]) * (at[-1] - at[-2]):
            at.pop()
            top.pop()
        at.append(x)
        top.append(y)
    return at, top


def summary_of(t: np.ndarray, s: np.ndarray, low_t: np.ndarray, low_s: np.ndarray, n: int, total: float, squares: float) -> tuple:
    high, low = hull(t, s), hull(low_t, -low_s)
    return n, total, squares, *high, low[0], [-y for y in low[1]]


def summarised(values: np.ndarray) -> tuple:
    """SUMMARY of a run of values."""
    t, s = np.arange(1, len(values) + 1), np.cumsum(values)
    return summary_of(t, s, t, s, len(values), float(values.sum()), float(values @ values))


def merged(runs: list[tuple]) -> tuple:
    """SUMMARY of runs one after the other, from theirs."""
    n, total = 0, 0.0
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for k, s, _, at, high, low_at, low in runs:
        for part, x in zip(parts, (np.asarray(at) + n, np.asarray(high) + total, np.asarray(low_at) + n, np.asarray(low) + total), strict=True):
            part.append(x)
        n, total = n + k, total + s
    return summary_of(*map(np.concatenate, parts), n, total, sum(r[2] for r in runs))


def range_point(run: tuple) -> float | None:
    """The rescaled-range estimate from a summary."""
    n, total, squares, at, high, low_at, low = run
    mean = total / n
    r = float((np.asarray(high) - np.asarray(at) * mean).max() - (np.asarray(low) - np.asarray(low_at) * mean).min())
    s = float(np.sqrt(max(0.0, squares / n - mean * mean)))
    return float(np.log(r / s) / np.log(n)) if n >= LEAST and r >= 1e-12 and s >= 1e-12 else None


def summarise_slots(values: pd.Series) -> pd.DataFrame:
    """SUMMARY of each slot's values."""
    return pd.DataFrame([summarised(np.asarray(v, dtype=float)) for v in values], columns=[c.split()[0] for c in SUMMARY.split(", ")])


def merge_slots(slots: pd.Series) -> pd.DataFrame:
    """n and h of a window's slots, an array of (start, summary) for each window."""
    runs = [merged([tuple(r["run"].values()) for r in sorted(x, key=lambda r: r["start"])]) for x in slots]
    return pd.DataFrame([(r[0], range_point(r)) for r in runs], columns=["n", "h"])


def merged_windows(events: DataFrame, size: str, slot: str, late: str | None = None) -> DataFrame:
    """event_type, window_start, n and h as rescaled_range(windowed(...)) gives them, from summaries of slots; slot must divide size."""
    slots = windowed(events, slot, late, keep_window=True).select("event_type", "w", F.pandas_udf(summarise_slots, SUMMARY)("values").alias("run"))
    both = slots.groupBy(F.window("w", size).alias("wide"), "event_type").agg(F.collect_list(F.struct(F.col("w.start").alias("start"), "run")).alias("slots"))
    return both.select("event_type", F.col("wide.start").alias("window_start"), F.pandas_udf(merge_slots, "n long, h double")("slots").alias("x")).select("event_type", "window_start", "x.n", "x.h")


def rolling_hurst_merged(spark: SparkSession, sf: str) -> DataFrame:
    out = merged_windows(read(spark, sf, "events"), "7 days", "6 hours")
    return out.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "n", rounded("h").alias("h"))


def rolling_hurst(spark: SparkSession, sf: str) -> DataFrame:
    out = rescaled_range(windowed(read(spark, sf, "events"), "7 days"))
    return out.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "n", rounded("h").alias("h"))


def start_stream(spark: SparkSession, folder: str, table: str, size: str = "7 days", late: str = "1 day", checkpoint: str | None = None, slot: str | None = None):
    """Streams event files of a folder into a memory table, or a Parquet path if table has a slash; appends closed windows. With slot, in the merged form."""
    schema = spark.read.parquet(folder).schema
    events = spark.readStream.schema(schema).parquet(folder)
    stream = merged_windows(events, size, slot, late) if slot else rescaled_range(windowed(events, size, late))
    writer = stream.writeStream.outputMode("append").trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.format("parquet").option("path", table).start() if "/" in table else writer.format("memory").queryName(table).start()


QUERIES["rolling_hurst"] = rolling_hurst
SQL["rolling_hurst"] = f"""WITH e AS (SELECT event_type, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS w, ts, event_id, value FROM events),
p AS (SELECT *, value - avg(value) OVER (PARTITION BY event_type, w) AS x FROM e),
y AS (SELECT *, sum(x) OVER (PARTITION BY event_type, w ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS y FROM p)
SELECT event_type, strftime(w, '%Y-%m-%d') AS window_start, count(*) AS n, CASE WHEN count(*) >= {LEAST} AND max(y) - min(y) >= 1e-12 AND stddev_pop(value) >= 1e-12 THEN round(ln((max(y) - min(y)) / stddev_pop(value)) / ln(count(*)), 6) + 0.0 END AS h FROM y GROUP BY event_type, w"""
QUERIES["rolling_hurst_merged"] = rolling_hurst_merged
SQL["rolling_hurst_merged"] = SQL["rolling_hurst"]
