"""Estimators over series cut into blocks of places, so that no task ever holds a whole series.

Block b of a series holds the places from b * size on. What reaches over a block's end is
either copied (chunks of places that a lag needs, into the blocks where it needs them) or added up
(partial sums of each block, with the phase at which the block begins). A block's sums are
made by numpy; adding them up, and all that follows, are expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perdura.functions.columns import clipped
from perdura.kernels.estimators import HIGH, LOW, local_whittle_objective
from perdura.kernels.numeric import minimise, wavelet_filter, zoomed_dft
from perdura.operators.native import CHUNK, result, scales

#: Rows of a block where the caller gives none.
SIZE = 1 << 20


def even_blocks(long: DataFrame, size: int = SIZE) -> DataFrame:
    """series_id, block, t, v and n (the series' length). Each block's count is made first, so a series is a few rows when its length is added up."""
    rows = long.select("series_id", F.floor(F.col("t") / size).alias("block"), "t", "v")
    counts = rows.groupBy("series_id", "block").agg(F.count(F.lit(1)).alias("rows"))
    sizes = counts.select("series_id", "block", F.sum("rows").over(Window.partitionBy("series_id")).alias("n"))
    return rows.join(sizes, ["series_id", "block"])


def centred(long: DataFrame, size: int) -> DataFrame:
    """even_blocks with x, the value less the series' mean; lengths and sums come by one join."""
    rows = long.select("series_id", F.floor(F.col("t") / size).alias("block"), "t", "v")
    sums = rows.groupBy("series_id", "block").agg(F.count(F.lit(1)).alias("rows"), F.sum("v").alias("s"))
    series = Window.partitionBy("series_id")
    totals = sums.select("series_id", "block", F.sum("rows").over(series).alias("n"), F.sum("s").over(series).alias("total"))
    return rows.join(totals, ["series_id", "block"]).withColumn("x", F.col("v") - F.col("total") / F.col("n")).drop("total")


def in_chunks(long: DataFrame, size: int) -> DataFrame:
    """series_id, block, n, t and v: an array of the values from place t on, up to CHUNK of one block, with what goes before it.

    mean is the series', y the sum of centred values before t and c the sum of those sums; they come from each chunk's count,
    sum and covariance with the places, so no window is over places.
    """
    width = min(size, CHUNK)
    block = F.floor(F.col("t") / size)
    rows = long.select("series_id", block.alias("block"), (block * size + F.floor((F.col("t") - block * size) / width) * width).alias("first"), "t", "v")
    chunks, key = rows.groupBy("series_id", "block", "first"), ["series_id", "block", "first"]
    values = chunks.agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("at")).select(*key, F.col("at.v").alias("v"))
    series = Window.partitionBy("series_id")
    before = series.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    sums = chunks.agg(F.count(F.lit(1)).alias("k"), F.sum("v").alias("s"), F.covar_pop((F.col("t") - F.col("first")).cast("double"), "v").alias("cv"))
    sums = sums.withColumn("n", F.sum("k").over(series)).withColumn("mean", F.sum("s").over(series) / F.col("n")).withColumn("x", F.col("s") - F.col("k") * F.col("mean"))
    sums = sums.withColumn("y", F.coalesce(F.sum("x").over(before), F.lit(0.0)))
    inside = F.col("k") * (F.col("y") + F.col("x") - F.col("cv")) - (F.col("k") - 1) / 2 * F.col("x")
    sums = sums.select(*key, "n", "mean", "y", F.coalesce(F.sum(inside).over(before), F.lit(0.0)).alias("c"))
    return values.join(sums, key).withColumnRenamed("first", "t")


def with_halo(rows: DataFrame, lags: Column, size: int, wide: Column | None = None) -> DataFrame:
    """rows, each also copied to the later blocks where some row has it at one of its lags; own tells a block's rows from copies.

    Copies go only where they are needed: a few rows at a block's end for short lags, one copy of a row for a long one.
    They come without lags, which are many times as wide as a row. A row may be wide places from t on, all in one block.
    """
    own, last = F.col("block"), F.floor((F.col("n") - 1) / size)
    reach = F.transform(lags, lambda h: F.floor((F.col("t") + h) / size))
    if wide is not None:
        reach = F.array_union(reach, F.transform(lags, lambda h: F.floor((F.col("t") + wide - 1 + h) / size)))
    sent = rows.withColumn("to", F.explode(F.filter(F.array_union(F.array(own), reach), lambda b: b <= last))).withColumn("own", F.col("to") == own)
    return sent.withColumn("lags", F.when(F.col("own"), lags)).drop("block").withColumnRenamed("to", "block")


Terms = Callable[[int, np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]], tuple]
Seen = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def lag_sums(chunks: DataFrame, lags: Column, size: int, terms: Terms, given: tuple[str, ...] = (), see: Seen = dict) -> DataFrame:
    """series_id, n, h, part and sums of k, a and b over all pairs of places h apart, for each h of lags (an array by n).

    terms(h, places, now, before) gives arrays part, k, a and b for one block. It sees of both places what see makes of a
    chunk's values and its given columns. A lag of 0 pairs a place with itself.
    """
    schema = "series_id string, n long, h long, part long, k long, a double, b double"

    def block(group: pa.Table) -> pa.Table:
        first, own = group.column("t").to_numpy(), group.column("own").to_numpy()
        order = np.argsort(first)
        chunk = {c: group.column(c).to_numpy() for c in given}
        values = group.column("v").combine_chunks()
        parts = [see({"v": values[int(i)].values.to_numpy(zero_copy_only=False), **{c: x[i] for c, x in chunk.items()}}) for i in order]
        t = np.concatenate([np.arange(len(p["v"])) + first[i] for p, i in zip(parts, order, strict=True)])
        got = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        out = []
        if own.any():  # a block's places have no gaps, and neither has what a lag needs
            begin = int(np.searchsorted(t, first[own].min()))
            for h in group.column("lags")[int(own.argmax())].as_py():
                i = max(begin, int(np.searchsorted(t, h)))  # a place before the series' first is not there
                j = int(np.searchsorted(t, t[i] - h)) if i < len(t) else i
                if i < len(t):
                    many = len(t) - i
                    part, k, a, b = terms(h, t[i:], {c: x[i:] for c, x in got.items()}, {c: x[j : j + many] for c, x in got.items()})
                    out.append((np.full(len(part), h), part, k, a, b))
        found = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0)] * 5
        many = len(found[0])
        names = [group.column("series_id")[0].as_py()] * many
        return pa.table([pa.array(names, pa.string()), pa.array([group.column("n")[0].as_py()] * many, pa.int64()), *(pa.array(x, kind) for x, kind in zip(found, (pa.int64(),) * 3 + (pa.float64(),) * 2, strict=True))], names=["series_id", "n", "h", "part", "k", "a", "b"])

    sent = with_halo(chunks, lags, size, F.size("v")).select("series_id", "block", "n", "lags", "own", "t", "v", *given)
    return sent.groupBy("series_id", "block").applyInArrow(block, schema).groupBy("series_id", "n", "h", "part").agg(*(F.sum(c).alias(c) for c in ("k", "a", "b")))


def lengths(long: DataFrame) -> DataFrame:
    return long.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


def one(*sums: float) -> tuple:
    return (np.zeros(1, dtype=np.int64), *(np.array([x]) for x in sums))


def differences(h: int, _, now: dict, before: dict) -> tuple:
    d = now["v"] - before["v"]
    return one(len(d), float(d.sum()), float(d @ d))


def lag_grid(n: Column, count: int = 16) -> Column:
    """Lags from 1 to an eighth of a series, about evenly spaced by ratio, below half of it."""
    top = F.log(F.greatest(F.lit(3.0), F.floor(n / 8)))
    every = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(F.exp(top * i / (count - 1)), 0).cast("long"))
    return F.filter(F.array_distinct(every), lambda h: (h >= 1) & (h < F.floor(n / 2)))


def ghe(long: DataFrame, size: int = SIZE) -> DataFrame:
    """Generalised Hurst exponent from the variances of differences at a grid of lags."""
    lags = F.when(F.col("n") >= 128, lag_grid(F.col("n"))).otherwise(F.array().cast("array<bigint>"))
    v = F.greatest(F.col("b") / F.col("k") - (F.col("a") / F.col("k")) ** 2, F.lit(1e-30))
    fit = lag_sums(in_chunks(long, size), lags, size, differences).groupBy("series_id").agg(F.count(F.lit(1)).alias("k"), F.regr_slope(F.log(v), F.log("h")).alias("slope"))
    point = F.when(F.abs("slope") < 0.08, 0.5).otherwise(clipped(F.col("slope") / 2, LOW, HIGH))
    return result(lengths(long).join(fit, "series_id", "left").withColumn("point", F.when(F.col("k") >= 4, point)), "GHE", "ghe")


def variance_ratio(long: DataFrame, size: int = SIZE, min_n: int = 32) -> DataFrame:
    step = lag_sums(in_chunks(long, size), F.array(F.lit(1).cast("long")), size, differences).select("series_id", (F.col("b") / F.col("k") - (F.col("a") / F.col("k")) ** 2).alias("step"))
    own = long.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.var_pop("v").alias("own"))
    both = own.join(step, "series_id", "left")
    ok = (F.col("n") >= min_n) & (F.col("own") > 0) & (F.col("step") > 0)
    return result(both.withColumn("point", F.when(ok, clipped(F.try_divide(F.col("own"), F.col("own") + F.col("step")), 0.0, 1.0))), "VarianceRatio", "variance_ratio")


def curve_lengths(h: int, t: np.ndarray, now: dict, before: dict) -> tuple:
    """Sums of absolute differences by where in a step of h the curve begins."""
    part = t % h
    return np.arange(h), np.bincount(part, minlength=h), np.bincount(part, np.abs(now["v"] - before["v"]), h), np.zeros(h)


def higuchi(long: DataFrame, size: int = SIZE) -> DataFrame:
    """Higuchi's dimension as an exponent; steps up to 64, whose halo is 64 rows."""
    n = F.col("n")
    top = F.least(F.greatest(F.lit(8), F.least(F.lit(64), F.floor(n / 8))), F.floor(n / 4))
    steps = F.when(n >= 64, F.sequence(F.lit(1).cast("long"), top.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    sums = lag_sums(in_chunks(long, size), steps, size, curve_lengths).filter("k > 0")
    curves = sums.groupBy("series_id", "n", "h").agg(F.avg(F.col("a") * (F.col("n") - 1) / (F.col("k") * F.col("h"))).alias("length")).filter("length > 0")
    fit = curves.groupBy("series_id").agg(F.count(F.lit(1)).alias("k"), F.regr_slope(F.log("length"), -F.log("h")).alias("slope"))
    point = clipped(2 - clipped(F.col("slope"), 1 + 1e-4, 2 - 1e-4), LOW, HIGH)
    return result(lengths(long).join(fit, "series_id", "left").withColumn("point", F.when(F.col("k") >= 4, point)), "Higuchi", "higuchi")


def running(chunk: dict) -> dict:
    """A chunk's values with y, the running sum of the centred ones, and c, that of y; both go on from the sums before the chunk."""
    y = chunk["y"] + (chunk["v"] - chunk["mean"]).cumsum()
    return {"v": chunk["v"], "y": y, "c": chunk["c"] + y.cumsum()}


def fluctuations(h: int, t: np.ndarray, now: dict, before: dict) -> tuple:
    """Squared distances of the running sum from its mean over the last h + 1 places."""
    z = now["y"] - (now["c"] - before["c"] + before["y"]) / (h + 1)
    return one(len(z), float(z @ z), 0.0)


def dma(long: DataFrame, size: int = SIZE) -> DataFrame:
    """Detrending moving average over windows up to a quarter of a series: means are differences of running sums."""
    n = F.col("n")
    grid = F.filter(scales(n, 8, None), lambda w: (w >= 2) & (w <= n - 3))
    lags = F.when(n >= 64, F.transform(grid, lambda w: w - 1)).otherwise(F.array().cast("array<bigint>"))
    sums = lag_sums(in_chunks(long, size), lags, size, fluctuations, ("mean", "y", "c"), running)
    f2 = sums.select("series_id", (F.col("h") + 1).alias("w"), (F.col("a") / F.col("k")).alias("f2")).filter("f2 > 0")
    fit = f2.groupBy("series_id").agg(F.count(F.lit(1)).alias("k"), F.regr_slope(F.log("f2") / 2, F.log("w")).alias("slope"))
    return result(lengths(long).join(fit, "series_id", "left").withColumn("point", F.when(F.col("k") >= 3, clipped(F.col("slope"), LOW, HIGH))), "DMA", "dma")


def periodogram(long: DataFrame, m: Column, size: int = SIZE) -> DataFrame:
    """series_id, n, j and power at the frequencies j / n, j from 1 to m (an expression of n; none below 1).

    A block gives its cosine and sine sums at those frequencies by one zoomed transform, turned by the phase at which
    it begins; the blocks' sums add up to the series' transform. A block's rows out are m, its work size * log(size).
    """
    rows = centred(long, size).select("series_id", "block", "n", m.cast("long").alias("m"), "t", "x").filter("m >= 1")
    schema = "series_id string, n long, re array<double>, im array<double>"

    def block(group: pa.Table) -> pa.Table:
        t, x = group.column("t").to_numpy(), group.column("x").to_numpy()
        order = np.argsort(t)
        n, m = (group.column(c)[0].as_py() for c in ("n", "m"))
        z = zoomed_dft(x[order], int(t.min()), n, m)
        return pa.table({"series_id": group.column("series_id").slice(0, 1), "n": group.column("n").slice(0, 1), "re": pa.array([z.real]), "im": pa.array([z.imag])})

    parts = rows.groupBy("series_id", "block").applyInArrow(block, schema)
    each = parts.select("series_id", "n", F.posexplode(F.arrays_zip("re", "im")).alias("j", "z")).select("series_id", "n", (F.col("j") + 1).cast("long").alias("j"), "z.re", "z.im")
    sums = each.groupBy("series_id", "n", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return sums.select("series_id", "n", "j", F.greatest((F.col("re") ** 2 + F.col("im") ** 2) / F.col("n"), F.lit(1e-20)).alias("power"))


def log_spectrum(long: DataFrame, size: int, m: int | None) -> DataFrame:
    """series_id, n and d, minus half the slope of log power on the log of 4 sin^2 of half the frequency."""
    n = F.col("n")
    top = F.least(F.greatest(F.lit(2), F.floor(F.sqrt(n))) if m is None else F.lit(m), F.floor(n / 2) - 1)
    found = periodogram(long, F.when((n >= 64) & (top >= 2), top).otherwise(0), size)
    angle = F.sin(F.col("j") * (np.pi / F.col("n")))
    return found.groupBy("series_id").agg((-0.5 * F.regr_slope(F.log("power"), F.log(4 * angle * angle))).alias("d"))


def gph(long: DataFrame, size: int = SIZE) -> DataFrame:
    return result(lengths(long).join(log_spectrum(long, size, None), "series_id", "left").withColumn("point", F.col("d")), "GPH", "gph")


def log_periodogram(long: DataFrame, size: int = SIZE, m: int | None = None) -> DataFrame:
    point = clipped(F.col("d"), -0.499, 0.499)
    return result(lengths(long).join(log_spectrum(long, size, m), "series_id", "left").withColumn("point", F.when(F.col("d").isNotNull(), point)), "Periodogram", "periodogram")


def polynomial_trend(long: DataFrame, order: int, strength: float, size: int = SIZE) -> DataFrame:
    """The native perturbation: the trend's mean and spread, and the values', are sums of blocks."""
    rows = even_blocks(long, size)
    u = F.coalesce(F.try_divide(2.0 * F.col("t"), F.col("n") - 1) - 1, F.lit(-1.0))
    rows = rows.withColumn("g", sum((F.pow(u, F.lit(float(k))) for k in range(1, order + 1)), F.lit(0.0)))
    sums = rows.groupBy("series_id", "block").agg(*(F.sum(x).alias(k) for k, x in {"sv": F.col("v"), "svv": F.col("v") ** 2, "sg": F.col("g"), "sgg": F.col("g") ** 2}.items()), F.count(F.lit(1)).alias("k"))
    whole = Window.partitionBy("series_id")
    total = {c: F.sum(c).over(whole) for c in ("sv", "svv", "sg", "sgg", "k")}
    spread = lambda s, ss: F.sqrt(F.greatest(total[ss] / total["k"] - (total[s] / total["k"]) ** 2, F.lit(0.0))) + 1e-12
    table = sums.select("series_id", "block", spread("sv", "svv").alias("s"), (total["sg"] / total["k"]).alias("g0"), spread("sg", "sgg").alias("gs"))
    return rows.join(table, ["series_id", "block"]).select("series_id", "t", (F.col("v") + strength * F.col("s") * (F.col("g") - F.col("g0")) / F.col("gs")).alias("v"))


def round_of(size: int, taps: int) -> tuple[int, int]:
    """How many wavelet levels a block takes at once, and its places: a multiple of what makes one place of the last level."""
    levels = max(1, int(np.log2(max(2.0, size / (4 * taps)))))
    return levels, max(-(-2 * taps >> levels), size >> levels) << levels


STREAM = "series_id string, top long, len long, i long, x double, level long, c long, mean double, m2 double"


def wavelet_round(stream: DataFrame, h: tuple[float, ...], done: int, levels: int, size: int) -> DataFrame:
    """STREAM after the next levels: its values (level null) are places i of level done, the others summaries of levels.

    A place of the next level sees the places before twice its own, so a block gets what lies before it, about as many
    places as there are taps for each of its last level's, and the series' last block also makes those past the end.
    Only the last level's values and a summary of each level's coefficients move on; older summaries are merged on their way.
    """
    taps, low, high = len(h), np.array(h[::-1]), np.array([(-1) ** (k + 1) * c for k, c in enumerate(h)])
    halo = [(taps - 2) * ((1 << levels - k) - 1) for k in range(levels + 1)]
    end = F.when(F.col("level").isNull(), F.least(F.floor((F.col("i") + halo[0]) / size), F.floor((F.col("len") - 1) / size)))
    own = F.floor(F.col("i") / size)
    sent = stream.withColumn("block", F.explode(F.sequence(own, F.coalesce(end, own))))

    def block(group: pa.Table) -> pa.Table:
        b, top = group.column("block")[0].as_py(), group.column("top")[0].as_py()
        value = group.column("level").is_null().to_numpy()
        found: dict[int, list[tuple[float, float, float]]] = {}
        got = {c: group.column(c).filter(pa.array(~value)).to_numpy() for c in ("level", "c", "mean", "m2")}
        for level, *summary in zip(*got.values(), strict=True):
            found.setdefault(int(level), []).append(tuple(summary))
        places, x, n = np.empty(0, dtype=np.int64), np.empty(0), 0
        if value.any():
            places, x = (group.column(c).filter(pa.array(value)).to_numpy() for c in ("i", "x"))
            order = np.argsort(places)
            places, x = places[order], x[order]
            n, first = group.column("len").filter(pa.array(value))[0].as_py(), int(places[0])
            final = b == (n - 1) // size
            for k in range(1, min(levels, top - done) + 1):
                begin, wide = b * size >> k, (n + taps - 1) // 2
                o = np.arange(max(0, begin - halo[k]), wide if final else (b + 1) * size >> k)
                at = ((2 * o + 1)[:, None] - np.arange(taps)) % (2 * n)
                seen = x[np.where(at < n, at, 2 * n - 1 - at) - first]
                d = (seen @ high)[o >= begin]
                found.setdefault(done + k, []).append((len(d), d.mean(), ((d - d.mean()) ** 2).sum()))
                x, n, first, places = seen @ low, wide, int(o[0]), o
            mine = (places >= begin) if top > done + levels else np.zeros(len(places), dtype=bool)
            places, x = places[mine], x[mine]
        merged = []
        for level, parts in found.items():
            c, mean, m2 = np.array(parts, dtype=float).T
            middle = (c * mean).sum() / c.sum()
            merged.append((level, int(c.sum()), middle, (m2 + c * (mean - middle) ** 2).sum()))
        many, few = len(places), len(merged)
        columns = [[group.column("series_id")[0].as_py()] * (many + few), [top] * (many + few), [n] * (many + few), [*places.tolist(), *[b * size >> levels] * few], [*x.tolist(), *[None] * few]]
        columns += [[*[None] * many, *(m[j] for m in merged)] for j in range(4)]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=[c.split()[0] for c in STREAM.split(", ")])

    return sent.groupBy("series_id", "block").applyInArrow(block, STREAM)


def wavelet_levels(long: DataFrame, wavelet: str = "db4", size: int = SIZE) -> DataFrame:
    """series_id, top, j (1 the coarsest level), c (coefficients) and v (their variance), of series of at least 128 places.

    A round of blocks takes several levels, and leaves a place for every 2 ** levels; so the first round is nearly all of
    the work, and every round is one shuffle.
    """
    h = wavelet_filter(wavelet)
    levels, size = round_of(size, len(h))
    rows = centred(long, size).filter("n >= 128").withColumn("top", F.floor(F.log2(F.col("n") / (len(h) - 1))))
    none = {c: F.lit(None).cast(kind).alias(c) for c, kind in (("level", "long"), ("c", "long"), ("mean", "double"), ("m2", "double"))}
    stream = rows.select("series_id", "top", F.col("n").alias("len"), F.col("t").alias("i"), "x", *none.values())
    longest = long.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for done in range(0, max(1, int(np.log2(max(1.0, longest / (len(h) - 1))))), levels):
        stream = wavelet_round(stream, h, done, levels, size)
    of_level = Window.partitionBy("series_id", "top", "level")
    middle = F.sum(F.col("c") * F.col("mean")).over(of_level) / F.sum("c").over(of_level)
    parts = stream.filter("level is not null").withColumn("m2", F.col("m2") + F.col("c") * F.pow(F.col("mean") - middle, F.lit(2)))
    found = parts.groupBy("series_id", "top", "level").agg(F.sum("c").alias("c"), F.sum("m2").alias("m2")).filter("c >= 2")
    return found.select("series_id", "top", (F.col("top") - F.col("level") + 1).alias("j"), "c", F.greatest(F.col("m2") / (F.col("c") - 1), F.lit(1e-30)).alias("v"))


def wavelet_slope(long: DataFrame, name: str, tag: str, wavelet: str = "db4", drop_coarse: int = 1, drop_fine: int = 1, weighted: bool = False, size: int = SIZE) -> DataFrame:
    """The exponent from the slope of log variance on the level, over the levels that are not dropped; by counts if weighted."""
    kept = wavelet_levels(long, wavelet, size).filter((F.col("j") > drop_coarse) & (F.col("j") <= F.col("top") - drop_fine))
    w, y = (F.col("c") if weighted else F.lit(1)).cast("double"), F.log2("v")
    s = kept.groupBy("series_id").agg(F.count(F.lit(1)).alias("k"), *(F.sum(x).alias(c) for c, x in {"w": w, "wj": w * F.col("j"), "wy": w * y, "wjj": w * F.col("j") * F.col("j"), "wjy": w * F.col("j") * y}.items()))
    slope = F.try_divide(F.col("w") * F.col("wjy") - F.col("wj") * F.col("wy"), F.col("w") * F.col("wjj") - F.col("wj") * F.col("wj"))
    fit = s.select("series_id", "k", slope.alias("slope"))
    point = F.when(F.col("k") >= 3, clipped((F.col("slope") + 2) / 2, LOW, HIGH))
    return result(lengths(long).join(fit, "series_id", "left").withColumn("point", point), name, tag)


def local_whittle(long: DataFrame, size: int = SIZE) -> DataFrame:
    """Modified local Whittle: the n ** 0.55 lowest frequencies by blocks, then the minimum for many series at once."""
    n = F.col("n")
    m = F.least(F.greatest(F.lit(8), F.floor(F.pow(n, F.lit(0.55)))), F.floor(n / 3))
    found = periodogram(long, F.when((n >= 256) & (m >= 8), m).otherwise(0), size)
    spectra = found.groupBy("series_id", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "power"))), lambda x: x["power"]).alias("power"))

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = np.full(b.num_rows, np.nan)
            lengths_, counts = b.column("n").to_numpy(), b.column("power").value_lengths().to_numpy()
            for k in np.unique(np.stack([lengths_, counts], axis=1), axis=0):
                rows = np.flatnonzero((lengths_ == k[0]) & (counts == k[1]))
                power = b.column("power").take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1)
                frequency = 2 * np.pi * np.arange(1, k[1] + 1) / k[0]
                d, ok = minimise(lambda u, some, f=frequency, p=power: local_whittle_objective(u, f, p[some]), len(rows), -0.49, 0.49)
                points[rows] = np.where(ok, np.clip(d, -0.499, 0.499), np.nan)
            yield pa.record_batch({"series_id": b.column("series_id"), "point": pa.array(points, from_pandas=True)})

    fit = spectra.mapInArrow(batch, "series_id string, point double")
    return result(lengths(long).join(fit, "series_id", "left"), "ModifiedLocalWhittle", "mlw")
