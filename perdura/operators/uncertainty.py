"""Bootstrap intervals of aggregated metrics: within strata, over strata, and of paired differences.

Groups have seeds of their own, from a hash of their key, so results depend neither on
the order of groups nor on partitioning. Two ways to draw: "pcg64" by numpy, and
"counter", whose index (7919 r + 104729 i + 31 r i) mod n is the same in any engine and
runs as expressions alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura.operators.evaluate import GLOBAL

KEYS = ["estimator_name", "metric_name", "stratum", "nominal"]
OUT = "value double, ci_level double, ci_low double, ci_high double, n long"
#: Values that one task draws from.
BLOCK_ROWS = 1_000_000
#: Tasks that the rows of one group are dealt to when they get their blocks.
SALTS = 64
#: Metrics that derive from others and have no values to resample.
DERIVED = ("coverage_error",)


def within(series: DataFrame) -> DataFrame:
    return series.filter("value is not null").select(*KEYS, F.col("record_id").alias("ord"), "value")


def over_strata(aggregates: DataFrame) -> DataFrame:
    rows = aggregates.filter(F.col("stratum") != GLOBAL)
    return rows.select("estimator_name", "metric_name", F.lit(GLOBAL).alias("stratum"), "nominal", F.col("stratum").alias("ord"), "value")


def paired(series: DataFrame, metrics: list[str]) -> DataFrame:
    """Differences of two estimators on the same record, named A__minus__B in order of names."""
    rows = series.filter(F.col("metric_name").isin(metrics) & F.col("value").isNotNull())
    left = rows.select("record_id", *KEYS, "value").alias("l")
    right = rows.select("record_id", *KEYS, "value").alias("r")
    same = (F.col("l.record_id") == F.col("r.record_id")) & (F.col("l.metric_name") == F.col("r.metric_name")) & (F.col("l.stratum") == F.col("r.stratum")) & F.col("l.nominal").eqNullSafe(F.col("r.nominal"))
    both = left.join(right, same & (F.col("l.estimator_name") < F.col("r.estimator_name")))
    return both.select(F.concat_ws("__minus__", "l.estimator_name", "r.estimator_name").alias("estimator_name"), "l.metric_name", "l.stratum", "l.nominal", F.col("l.record_id").alias("ord"), (F.col("l.value") - F.col("r.value")).alias("value"))


def bootstrap(rows: DataFrame, n_bootstrap: int = 200, levels: tuple[float, ...] = (0.95,), seed: int = 0, root: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """KEYS and OUT for rows of KEYS, ord and value.

    A group's rows are cut into blocks of about block_rows by a hash of ord. For each replicate
    a multinomial law says how many of the group's draws fall on each block, which every
    block's task finds from the group's seed; the draws inside a block are then made in its
    task, and only their sums, one for each replicate, move on. So a group of any size is
    drawn exactly, with no task that holds more than a block.
    """
    group = F.xxhash64(F.lit(seed), *KEYS)
    marked = rows.select(*KEYS, "ord", "value", group.alias("seed"))
    sizes = marked.groupBy("seed").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    # A group's rows are dealt to SALTS tasks, each with a copy of the group's one row of sizes.
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("ord", F.lit(1)), F.lit(SALTS)))
    copies = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    placed = salted.join(copies, ["seed", "salt"]).drop("salt").withColumn("block", F.pmod(F.xxhash64("ord"), F.col("blocks")).cast("int"))
    packed = placed.groupBy(*KEYS, "seed", "blocks", "block").agg(F.sort_array(F.collect_list(F.struct("ord", "value"))).alias("x"))
    packed = packed.select(*KEYS, "seed", "blocks", "block", F.transform("x", lambda r: r["value"]).alias("values"))
    counts = packed.select("seed", "blocks", "block", F.size("values").alias("n")).groupBy("seed", "blocks").agg(F.map_from_entries(F.collect_list(F.struct("block", "n"))).alias("m"))
    of_blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)))
    ready = packed.join(counts.select("seed", of_blocks.alias("sizes"), F.explode(F.map_keys("m")).alias("block")), ["seed", "block"])
    schema = "estimator_name string, metric_name string, stratum string, nominal double, n long, total double, sums array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                x, sizes = np.asarray(r.values, dtype=float), np.asarray(r.sizes, dtype=np.int64)
                n, own = int(sizes.sum()), int(r.seed) & 0xFFFFFFFFFFFFFFFF
                draws = np.random.default_rng(own).multinomial(n, sizes / n, size=n_bootstrap)[:, r.block]
                rng = np.random.default_rng([own, r.block])
                sums = [float(x[rng.integers(0, len(x), size=k)].sum()) for k in draws.tolist()]
                out.append((r.estimator_name, r.metric_name, r.stratum, r.nominal, len(x), float(x.sum()), sums))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    drawn = ready.mapInPandas(run, schema)
    add = lambda a, x: F.when(F.size(a) == 0, x).otherwise(F.zip_with(a, x, lambda p, q: p + q))
    sums = F.aggregate(F.sort_array(F.collect_list("sums")), F.array().cast("array<double>"), add)
    whole = drawn.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), sums.alias("sums"))
    centre = lambda mean: F.when(F.lit(root) & (F.col("metric_name") == "rmse"), F.sqrt(mean)).otherwise(mean)
    sorted_ = F.sort_array(F.transform("sums", lambda s: centre(s / F.col("n"))))
    done = whole.select(*KEYS, "n", centre(F.col("total") / F.col("n")).alias("value"), sorted_.alias("means"))

    def quantile(q: float):
        """Between the two nearest of the sorted means."""
        at = q * (n_bootstrap - 1)
        low, part = int(at), at - int(at)
        a, b = F.get("means", F.lit(low)), F.get("means", F.lit(min(low + 1, n_bootstrap - 1)))
        return a + part * (b - a)

    each = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("ci_level"), quantile((1 - v) / 2).alias("ci_low"), quantile(1 - (1 - v) / 2).alias("ci_high")) for v in levels])).alias("c")
    return done.select(*KEYS, "value", each, "n").select(*KEYS, "value", "c.*", "n")


def counter_bootstrap(rows: DataFrame, n_bootstrap: int, level: float) -> DataFrame:
    """The same with the counter index, as expressions."""
    packed = rows.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("ord", "value"))).alias("x")).withColumn("n", F.size("x").cast("long"))
    each = packed.select(*KEYS, "n", "x", F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1))).alias("r"))
    r, n, x = F.col("r").cast("long"), F.col("n"), F.col("x")
    drawn = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(x, F.pmod(7919 * r + 104729 * i + 31 * r * i, n).cast("int"))["value"])
    mean = F.aggregate(drawn, F.lit(0.0), lambda a, v: a + v) / n
    q = (1 - level) / 2
    done = each.select(*KEYS, "n", mean.alias("mean")).groupBy(*KEYS, "n").agg(F.percentile("mean", F.lit(q)).alias("ci_low"), F.percentile("mean", F.lit(1 - q)).alias("ci_high"))
    value = packed.select(*KEYS, (F.aggregate("x", F.lit(0.0), lambda a, v: a + v["value"]) / n).alias("value"))
    keys = ["estimator_name", "metric_name", "stratum"]
    return done.alias("d").join(value.alias("v"), [F.col(f"d.{k}") == F.col(f"v.{k}") for k in keys] + [F.col("d.nominal").eqNullSafe(F.col("v.nominal"))]).select("d.*", "v.value")
