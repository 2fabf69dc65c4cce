"""Estimators and perturbations as window and aggregate expressions over long series.

All start from series partitioned by series_id, so each costs the one shuffle that made
the series: running sums are windows over that partitioning, and grouping by series and
something else needs no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from perdura.functions.columns import clipped, reason
from perdura.kernels.estimators import HIGH, LOW
from perdura.sources.series import before_blocks


def whole() -> WindowSpec:
    return Window.partitionBy("series_id")


def so_far() -> WindowSpec:
    return whole().orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def profile(long: DataFrame) -> DataFrame:
    """Adds n, x (centred values) and y (their running sum). Series in blocks are summed block by block, and go on from the
    sums of their earlier blocks, so that no task gets a whole series."""
    if "block" in long.columns:
        of_series = long.groupBy("series_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
        all_blocks = Window.partitionBy("series_id")
        long = long.drop("n")
        table = of_series.select("series_id", "block", F.sum("n").over(all_blocks).alias("n"), (F.sum("s").over(all_blocks) / F.sum("n").over(all_blocks)).alias("mean"))
        rows = long.join(table, ["series_id", "block"]).withColumn("x", F.col("v") - F.col("mean")).drop("mean")
        inside = Window.partitionBy("series_id", "block").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = before_blocks(rows.withColumn("y", F.sum("x").over(inside)), F.sum("x").alias("carried"))
        return rows.withColumn("y", F.col("y") + F.col("carried")).drop("carried")
    rows = long.withColumn("n", F.count(F.lit(1)).over(whole())).withColumn("x", F.col("v") - F.avg("v").over(whole()))
    return rows.withColumn("y", F.sum("x").over(so_far()))


def described(long: DataFrame) -> DataFrame:
    return long.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))


def result(rows: DataFrame, name: str, tag: str) -> DataFrame:
    """series_id, n, estimator_name, point, valid and failure_reason from a nullable point."""
    valid = F.col("point").isNotNull()
    return rows.select("series_id", "n", F.lit(name).alias("estimator_name"), "point", valid.alias("valid"), reason(valid, tag).alias("failure_reason"))


def rescaled_range(long: DataFrame) -> DataFrame:
    rows = profile(long).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), (F.max("y") - F.min("y")).alias("r"), F.stddev_pop("v").alias("s"))
    ok = (F.col("n") >= 16) & (F.col("r") >= 1e-12) & (F.col("s") >= 1e-12)
    point = F.when(ok, F.log(F.col("r") / F.when(ok, F.col("s"))) / F.log(F.when(ok, F.col("n"))))
    return result(rows.withColumn("point", point), "RS", "rs")


def grid(first: int, most: int = 1 << 40) -> list[int]:
    """Scales from first on, each a quarter larger (halves to even), at least one more."""
    out = [first]
    while out[-1] < most:
        out.append(max(out[-1] + 1, round(out[-1] * 1.25)))
    return out


def scales(n, first: int, last: int | None):
    """The grid of scales up to a series' largest as an array: the grid is a constant, of which n takes the head."""
    top = F.least(F.greatest(F.lit(first + 4), F.floor(n / 4)) if last is None else F.lit(last), F.floor(n / 2))
    known = F.array(*[F.lit(s).cast("long") for s in grid(first)])
    return F.when(top > first, F.filter(known, lambda s: s <= top)).otherwise(F.array().cast("array<bigint>"))


#: Places over which DFA's running sums go on before they begin anew, which keeps their digits.
CHUNK = 1024


def box_sums(rows: DataFrame, usable: Column) -> DataFrame:
    """series_id, n, s, box and the sums sy, syy and suy (u the place in the box) of each box of each scale s of usable (an array by n).

    Sums run through a chunk of CHUNK places once for all scales and are kept as an array; what a chunk holds of a box
    is the difference of two of its entries. So a scale takes n / s + n / CHUNK rows.
    """
    parts = [*[c for c in ("series_id", "block") if c in rows.columns], "chunk"]
    rows = rows.withColumn("chunk", F.floor(F.col("t") / CHUNK))
    inside = Window.partitionBy(*parts).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = (F.col("t") - F.col("chunk") * CHUNK).cast("double")
    run = {"y": F.col("y"), "yy": F.col("y") * F.col("y"), "uy": place * F.col("y")}
    rows = rows.select(*parts, "n", "t", *(F.sum(x).over(inside).alias(k) for k, x in run.items()))
    chunks = rows.groupBy(*parts, "n").agg(F.sort_array(F.collect_list(F.struct("t", *run))).alias("at"))
    first, last = F.col("at")[0]["t"], F.col("at")[F.size("at") - 1]["t"]
    scaled = chunks.select("series_id", "n", "chunk", "at", first.alias("first"), last.alias("last"), F.explode(usable).alias("s"))
    s, box = F.col("s"), F.col("box")
    boxes = F.sequence(F.floor(F.col("first") / s), F.least(F.floor(F.col("last") / s), F.floor(F.col("n") / s) - 1))
    pieces = scaled.filter(F.floor(F.col("first") / s) < F.floor(F.col("n") / s)).select("*", F.explode(boxes).alias("box"))
    index = lambda t: (t - F.col("first")).cast("int")
    high = F.col("at")[index(F.least((box + 1) * s - 1, F.col("last")))]
    low = F.col("at")[F.greatest(index(box * s) - 1, F.lit(0))]
    held = {k: high[k] - F.when(box * s > F.col("first"), low[k]).otherwise(0.0) for k in run}
    pieces = pieces.select("series_id", "n", "s", "box", held["y"].alias("y"), held["yy"].alias("yy"), (held["uy"] + (F.col("chunk") * CHUNK - box * s) * held["y"]).alias("uy"))
    return pieces.groupBy("series_id", "n", "s", "box").agg(*(F.sum(k).alias(f"s{k}") for k in run))


def dfa(long: DataFrame, order: int = 1, min_scale: int = 16, max_scale: int | None = None) -> DataFrame:
    """Orders 0 and 1; residuals of a box follow from its sums.

    A box of s rows has known sums of places and their squares, so three sums are enough.
    """
    rows = profile(long)
    per_series = long.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    usable = F.filter(scales(F.col("n"), min_scale, max_scale), lambda s: (s >= order + 2) & (F.floor(F.col("n") / s) >= 2))
    each, s = box_sums(rows, usable), F.col("s")
    centred = F.col("syy") - F.col("sy") * F.col("sy") / s
    slope = F.col("suy") - (s - 1) / 2 * F.col("sy")
    rss = centred if order == 0 else centred - slope * slope * 12 / (s * (s.cast("double") * s - 1))
    by_scale = each.groupBy("series_id", "n", "s").agg((F.sum(F.greatest(rss, F.lit(0.0))) / (F.count(F.lit(1)) * F.first("s"))).alias("f2"))
    ok = F.col("f2") > 0
    fit = by_scale.groupBy("series_id").agg(F.count(F.when(ok, 1)).alias("k"), F.regr_slope(F.when(ok, F.log("f2") / 2), F.when(ok, F.log("s"))).alias("slope"))
    fit = per_series.join(fit, "series_id", "left")
    point = F.when((F.col("n") >= 64) & (F.col("k") >= 3), clipped(F.col("slope"), LOW, HIGH))
    return result(fit.withColumn("point", point), "DFA", "dfa")


def ghe(long: DataFrame, lags: list[int]) -> DataFrame:
    """Generalised Hurst exponent for given lags, all as lags of one sorted window."""
    order = Window.partitionBy("series_id").orderBy("t")
    rows = long.withColumn("n", F.count(F.lit(1)).over(whole()))
    for h in lags:
        rows = rows.withColumn(f"d{h}", F.col("v") - F.lag("v", h).over(order))
    sums = rows.groupBy("series_id", "n").agg(*[F.var_pop(f"d{h}").alias(f"v{h}") for h in lags])
    points = F.array(*[F.struct(F.lit(float(h)).alias("h"), F.greatest(F.col(f"v{h}"), F.lit(1e-30)).alias("v"), (F.lit(h) < F.floor(F.col("n") / 2)).alias("ok")) for h in lags])
    long_ = sums.select("series_id", "n", F.explode(points).alias("p")).select("series_id", "n", "p.*")
    ok = F.col("ok")
    fit = long_.groupBy("series_id", "n").agg(F.count(F.when(ok, 1)).alias("k"), F.regr_slope(F.when(ok, F.log("v")), F.when(ok, F.log("h"))).alias("slope"))
    point = F.when(F.abs("slope") < 0.08, 0.5).otherwise(clipped(F.col("slope") / 2, LOW, HIGH))
    return result(fit.withColumn("point", F.when((F.col("n") >= 128) & (F.col("k") >= 4), point)), "GHE", "ghe")


def variance_ratio(long: DataFrame, min_n: int = 32) -> DataFrame:
    step = F.col("v") - F.lag("v").over(Window.partitionBy("series_id").orderBy("t"))
    rows = long.withColumn("d", step).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.var_pop("v").alias("a"), F.var_pop("d").alias("b"))
    ok = (F.col("n") >= min_n) & (F.col("a") > 0) & (F.col("b") > 0)
    return result(rows.withColumn("point", F.when(ok, clipped(F.try_divide(F.col("a"), F.col("a") + F.col("b")), 0.0, 1.0))), "VarianceRatio", "variance_ratio")


def spread():
    return F.stddev_pop("v").over(whole()) + 1e-12


def level_shift(long: DataFrame, shift: float) -> DataFrame:
    return long.withColumn("v", F.col("v") + shift * spread())


def polynomial_trend(long: DataFrame, order: int, strength: float) -> DataFrame:
    rows = long.withColumn("n", F.count(F.lit(1)).over(whole())).withColumn("s", spread())
    u = F.coalesce(F.try_divide(2.0 * F.col("t"), F.col("n") - 1) - 1, F.lit(-1.0))
    rows = rows.withColumn("g", sum((F.pow(u, F.lit(float(k))) for k in range(1, order + 1)), F.lit(0.0)))
    rows = rows.withColumn("g0", F.col("g") - F.avg("g").over(whole())).withColumn("gs", F.stddev_pop("g").over(whole()) + 1e-12)
    return rows.select("series_id", "t", (F.col("v") + strength * F.col("s") * F.col("g0") / F.col("gs")).alias("v"))


def fixed_outliers(long: DataFrame, rate: float, amplitude: float, step: int = 37) -> DataFrame:
    """Outliers at the first k of the places 0, step, 2 step ... modulo n, with signs in turn: as many as the random operator sets.

    With g = gcd(step, n), a place t is among them if g divides it and its number, t / g times the inverse of step / g
    modulo n / g, is below k; the inverse is found by Euclid's algorithm, a few steps for each row and none across rows.
    """
    rows = long.withColumn("n", F.count(F.lit(1)).over(whole())).withColumn("s", spread())
    k = F.least(F.greatest(F.lit(1), F.bround(rate * F.col("n"), 0)), F.col("n"))
    # (a, b, x, y) with a = x * step and b = y * step modulo n; ends with a = gcd and x its inverse.
    begin = F.struct(F.lit(step).cast("long").alias("a"), F.col("n").alias("b"), F.lit(1).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    turn = lambda e, _: F.when(e["b"] == 0, e).otherwise(F.struct(e["b"].alias("a"), F.pmod(e["a"], F.when(e["b"] != 0, e["b"])).alias("b"), e["y"].alias("x"), (e["x"] - F.floor(e["a"] / F.when(e["b"] != 0, e["b"])) * e["y"]).alias("y")))
    rows = rows.withColumn("e", F.aggregate(F.sequence(F.lit(1), F.lit(2 * step.bit_length() + 4)), begin, turn))
    g, cycle = F.col("e.a"), F.floor(F.col("n") / F.col("e.a"))
    hit = (F.pmod("t", g) == 0) & (F.pmod(F.floor(F.col("t") / g) * F.pmod(F.col("e.x"), cycle), cycle) < k)
    sign = F.when(F.pmod("t", F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return rows.select("series_id", "t", F.when(hit, F.col("v") + sign * amplitude * F.col("s")).otherwise(F.col("v")).alias("v"))
