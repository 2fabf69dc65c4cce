"""Registered queries over series, each with SQL for the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perdura.functions.columns import rounded
from perdura.kernels import estimators as K
from perdura.kernels.estimators import Kernel
from perdura.kernels.numeric import wavelet_filter
from perdura.operators import blocks, native
from perdura.operators.estimate import kernel_points
from perdura.sources.series import VIEWS, pack, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The series views in SQL.
VIEW_SQL = {
    "E5": "SELECT event_type AS series_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS t, value AS v FROM events",
    "EU": "SELECT CAST(user_id AS VARCHAR) AS series_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t, value AS v FROM events",
    "L3": "SELECT l_returnflag AS series_id, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate) - 1 AS BIGINT) AS t, v FROM (SELECT l_returnflag, l_shipdate, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY ALL)",
    "O": "SELECT o_orderpriority AS series_id, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) - 1 AS BIGINT) AS t, v FROM (SELECT o_orderpriority, o_orderdate, avg(o_totalprice) AS v FROM orders GROUP BY ALL)",
    "V": "SELECT CAST(vec_id AS VARCHAR) AS series_id, CAST(unnest(range(len(embedding))) AS BIGINT) AS t, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
}


def with_profile(view: str, body: str) -> str:
    """SQL with s (series), p (centred) and y (running sums) ahead of body; recursive CTEs are allowed."""
    return f"""WITH RECURSIVE s AS ({view}),
p AS (SELECT series_id, t, v, CAST(count(*) OVER w AS BIGINT) AS n, v - avg(v) OVER w AS x FROM s WINDOW w AS (PARTITION BY series_id)),
y AS (SELECT *, sum(x) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS y FROM p),
ns AS (SELECT series_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY series_id),
{body}"""


def finish(tag: str, name: str, digits: int = 6) -> str:
    """The last SELECT over r(series_id, n, point)."""
    return f"""SELECT series_id, n, '{name}' AS estimator_name, round(point, {digits}) + 0.0 AS point, point IS NOT NULL AS valid,
CASE WHEN point IS NULL THEN 'insufficient_signal_for_{tag}' END AS failure_reason FROM r"""


def clip(x: str, low: float = K.LOW, high: float = K.HIGH) -> str:
    return f"least(greatest({x}, {low!r}), {high!r})"


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("point", rounded("point", digits))


def native_query(view: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: shown(f(VIEWS[view](spark, sf)))


def kernel_query(view: str, name: str, params: dict | None = None, plugins: dict[str, Kernel] | None = None, digits: int = 6) -> Query:
    return lambda spark, sf: shown(kernel_points(pack(VIEWS[view](spark, sf)), name, params, plugins), digits)


# Descriptions of series, and the sources themselves.
for _v in ("E5", "EU", "L3", "O", "V"):

    def _profile(spark: SparkSession, sf: str, v: str = _v) -> DataFrame:
        d = native.described(VIEWS[v](spark, sf))
        return d.select("series_id", "n", *[rounded(c, 5).alias(c) for c in ("mean", "std", "low", "high")])

    add(f"series_profile_{_v.lower()}", _profile, f"SELECT series_id, count(*) AS n, round(avg(v), 5) + 0.0 AS mean, round(stddev_pop(v), 5) + 0.0 AS std, round(min(v), 5) + 0.0 AS low, round(max(v), 5) + 0.0 AS high FROM ({VIEW_SQL[_v]}) GROUP BY series_id")


def packed_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Long to packed to long."""
    from perdura.sources.series import unpack

    return unpack(pack(VIEWS["EU"](spark, sf))).select("series_id", "t", rounded("v").alias("v"))


add("packed_round_trip", packed_round_trip, f"SELECT series_id, t, round(v, 6) + 0.0 AS v FROM ({VIEW_SQL['EU']})")

# Rescaled range.
RS_BODY = """r AS (SELECT series_id, count(*) AS n, CASE WHEN count(*) >= 16 AND stddev_pop(v) >= 1e-12 AND max(y) - min(y) >= 1e-12
  THEN ln((max(y) - min(y)) / stddev_pop(v)) / ln(count(*)) END AS point FROM y GROUP BY series_id)
"""
for _v, _n in (("E5", "rs_hurst"), ("EU", "rs_validity"), ("L3", "rs_hurst_revenue"), ("O", "rs_hurst_price")):
    add(_n, native_query(_v, native.rescaled_range), with_profile(VIEW_SQL[_v], RS_BODY + finish("rs", "RS")))
add("rs_hurst_blocks", native_query("E5B", native.rescaled_range), with_profile(VIEW_SQL["E5"], RS_BODY + finish("rs", "RS")))


# Detrended fluctuation analysis.
def dfa_sql(view: str, order: int, first: int, last: int | None = None) -> str:
    top = f"greatest({first + 4}, n // 4)" if last is None else str(last)
    rss = "regr_syy(y, u)" if order == 0 else "regr_syy(y, u) - regr_sxy(y, u) * regr_sxy(y, u) / regr_sxx(y, u)"
    body = f"""sc(s) AS (SELECT CAST({first} AS BIGINT) UNION ALL SELECT greatest(s + 1, CAST(round_even(s * 1.25, 0) AS BIGINT)) FROM sc WHERE s < (SELECT max(n) FROM ns)),
g AS (SELECT series_id, n, s FROM ns, sc WHERE s <= least({top}, n // 2) AND least({top}, n // 2) > {first} AND n // s >= 2 AND s >= {order + 2}),
b AS (SELECT y.series_id, g.s, y.t // g.s AS box, CAST(y.t % g.s AS DOUBLE) AS u, y.y FROM y JOIN g ON y.series_id = g.series_id WHERE y.t < (g.n // g.s) * g.s),
f AS (SELECT series_id, s, sum(greatest(rss, 0)) / sum(k) AS f2 FROM (SELECT series_id, s, box, {rss} AS rss, count(*) AS k FROM b GROUP BY ALL) GROUP BY ALL),
m AS (SELECT series_id, count(*) AS k, CASE WHEN count(*) >= 3 THEN regr_slope(ln(f2) / 2, ln(s)) END AS slope FROM f WHERE f2 > 0 GROUP BY series_id),
r AS (SELECT ns.series_id, ns.n, CASE WHEN ns.n >= 64 AND k >= 3 THEN {clip('slope')} END AS point FROM ns LEFT JOIN m ON ns.series_id = m.series_id)
"""
    return with_profile(VIEW_SQL[view], body + finish("dfa", "DFA"))


add("dfa_order0", native_query("E5", lambda s: native.dfa(s, 0)), dfa_sql("E5", 0, 16))
add("dfa_order1", native_query("E5", native.dfa), dfa_sql("E5", 1, 16))
add("dfa_order1_blocks", native_query("E5B", native.dfa), dfa_sql("E5", 1, 16))
add("dfa_default_validity", native_query("EU", native.dfa), dfa_sql("EU", 1, 16))
add("dfa_embeddings", native_query("V", lambda s: native.dfa(s, 1, 4)), dfa_sql("V", 1, 4))
add("dfa_arrow", kernel_query("E5", "DFA"), dfa_sql("E5", 1, 16))
add("dfa_order2_arrow", kernel_query("E5", "DFA", {"detrend_order": 2}))

# Detrending moving average.
DMA_BODY = f"""sc(s) AS (SELECT CAST(8 AS BIGINT) UNION ALL SELECT greatest(s + 1, CAST(round_even(s * 1.25, 0) AS BIGINT)) FROM sc WHERE s < (SELECT max(n) FROM ns)),
g AS (SELECT series_id, n, s FROM ns, sc WHERE s <= least(greatest(12, n // 4), n // 2) AND least(greatest(12, n // 4), n // 2) > 8 AND n - s + 1 >= 4),
c AS (SELECT *, sum(y) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS cy FROM y),
z AS (SELECT c.series_id, g.s, c.y - (c.cy - coalesce(b.cy, 0)) / g.s AS z FROM c JOIN g ON c.series_id = g.series_id AND c.t >= g.s - 1 LEFT JOIN c AS b ON b.series_id = c.series_id AND b.t = c.t - g.s),
f AS (SELECT series_id, s, avg(z * z) AS f2 FROM z GROUP BY ALL),
m AS (SELECT series_id, count(*) AS k, CASE WHEN count(*) >= 3 THEN regr_slope(ln(f2) / 2, ln(s)) END AS slope FROM f WHERE f2 > 0 GROUP BY series_id),
r AS (SELECT ns.series_id, ns.n, CASE WHEN ns.n >= 64 AND k >= 3 THEN {clip('slope')} END AS point FROM ns LEFT JOIN m ON ns.series_id = m.series_id)
"""
add("dma_hurst", kernel_query("E5", "DMA"), with_profile(VIEW_SQL["E5"], DMA_BODY + finish("dma", "DMA")))
add("dma_validity", kernel_query("EU", "DMA"), with_profile(VIEW_SQL["EU"], DMA_BODY + finish("dma", "DMA")))


# Higuchi: the proxy, and the slope behind it.
def higuchi_sql(view: str, point: str, tag: str, name: str) -> str:
    body = f"""k AS (SELECT series_id, n, CAST(unnest(range(1, CAST(least(greatest(greatest(8, least(64, n // 8)), 4), n // 4) AS BIGINT) + 1)) AS BIGINT) AS k FROM ns WHERE n >= 64),
d AS (SELECT a.series_id, k.n, k.k, a.t % k.k AS m, abs(b.v - a.v) AS d FROM k JOIN s AS a ON a.series_id = k.series_id JOIN s AS b ON b.series_id = a.series_id AND b.t = a.t + k.k),
l AS (SELECT series_id, n, k, avg(l) AS l FROM (SELECT series_id, n, k, m, sum(d) * (n - 1) / (count(*) * k) AS l FROM d GROUP BY series_id, n, k, m) GROUP BY series_id, n, k),
m AS (SELECT series_id, count(*) AS k, CASE WHEN count(*) >= 4 THEN regr_slope(ln(l), ln(1.0 / k)) END AS slope FROM l WHERE l > 0 GROUP BY series_id),
r AS (SELECT ns.series_id, ns.n, CASE WHEN m.k >= 4 THEN {point} END AS point FROM ns LEFT JOIN m ON ns.series_id = m.series_id)
"""
    return with_profile(VIEW_SQL[view], body + finish(tag, name))


SLOPE_KERNEL = {"HiguchiSlope": Kernel(K.higuchi_slope, "higuchi", 0, ("k_max",))}
HIGUCHI_POINT = clip(f"2 - {clip('slope', 1 + 1e-4, 2 - 1e-4)}")
add("higuchi", kernel_query("E5", "Higuchi"), higuchi_sql("E5", HIGUCHI_POINT, "higuchi", "Higuchi"))
add("higuchi_embeddings", kernel_query("V", "Higuchi"), higuchi_sql("V", HIGUCHI_POINT, "higuchi", "Higuchi"))
add("higuchi_slope", kernel_query("E5", "HiguchiSlope", plugins=SLOPE_KERNEL), higuchi_sql("E5", "slope", "higuchi", "HiguchiSlope"))


# Generalised Hurst exponent.
def ghe_sql(view: str, fixed: list[int] | None = None) -> str:
    lags = f"SELECT series_id, n, unnest({fixed}) AS h FROM ns WHERE n >= 128" if fixed else "SELECT DISTINCT series_id, n, CAST(round_even(exp(ln(CAST(greatest(3, n // 8) AS DOUBLE)) * i / 15), 0) AS BIGINT) AS h FROM ns, range(16) AS q(i) WHERE n >= 128"
    body = f"""h AS ({lags}),
v AS (SELECT h.series_id, h.h, greatest(var_pop(b.v - a.v), 1e-30) AS v FROM h JOIN s AS a ON a.series_id = h.series_id JOIN s AS b ON b.series_id = a.series_id AND b.t = a.t + h.h WHERE h.h < h.n // 2 GROUP BY ALL),
m AS (SELECT series_id, count(*) AS k, CASE WHEN count(*) >= 4 THEN regr_slope(ln(v), ln(h)) END AS slope FROM v GROUP BY series_id),
r AS (SELECT ns.series_id, ns.n, CASE WHEN ns.n >= 128 AND k >= 4 THEN CASE WHEN abs(slope) < 0.08 THEN 0.5 ELSE {clip('slope / 2')} END END AS point FROM ns LEFT JOIN m ON ns.series_id = m.series_id)
"""
    return with_profile(VIEW_SQL[view], body + finish("ghe", "GHE"))


FIXED_LAGS = [1, 2, 3, 5, 8, 13, 21, 34]
add("ghe", kernel_query("E5", "GHE"), ghe_sql("E5"))
add("ghe_revenue", kernel_query("L3", "GHE"), ghe_sql("L3"))
add("ghe_validity", kernel_query("EU", "GHE"), ghe_sql("EU"))
add("ghe_native_lags", native_query("E5", lambda s: native.ghe(s, FIXED_LAGS)), ghe_sql("E5", FIXED_LAGS))


# Spectral: log-periodogram regressions, and Whittle objectives on a grid.
def spectrum(m: str, least: int) -> str:
    return f"""j AS (SELECT series_id, n, m, unnest(range(1, m + 1)) AS j FROM (SELECT series_id, n, CAST({m} AS BIGINT) AS m FROM ns) WHERE n >= {least} AND m >= 2),
i AS (SELECT j.series_id, j.n, j.m, j.j, 2 * pi() * j.j / j.n AS lam, greatest((pow(sum(p.x * cos(2 * pi() * j.j * p.t / j.n)), 2) + pow(sum(p.x * sin(2 * pi() * j.j * p.t / j.n)), 2)) / j.n, 1e-20) AS i FROM j JOIN p ON p.series_id = j.series_id GROUP BY j.series_id, j.n, j.m, j.j),
"""


def log_spectrum_sql(view: str, m: str, point: str, tag: str, name: str) -> str:
    body = spectrum(m, 64) + f"""m AS (SELECT series_id, regr_slope(ln(i), ln(4 * pow(sin(lam / 2), 2))) AS slope FROM i GROUP BY series_id),
r AS (SELECT ns.series_id, ns.n, {point} AS point FROM ns LEFT JOIN m ON ns.series_id = m.series_id)
"""
    return with_profile(VIEW_SQL[view], body + finish(tag, name))


ROOT_M = "least(greatest(2, floor(sqrt(n))), n // 2 - 1)"
PERIODOGRAM_POINT = "CASE WHEN slope IS NOT NULL THEN least(greatest(-0.5 * slope, -0.499), 0.499) END"
add("gph", kernel_query("E5", "GPH"), log_spectrum_sql("E5", ROOT_M, "-0.5 * slope", "gph", "GPH"))
add("gph_revenue", kernel_query("L3", "GPH"), log_spectrum_sql("L3", ROOT_M, "-0.5 * slope", "gph", "GPH"))
add("gph_validity", kernel_query("EU", "GPH"), log_spectrum_sql("EU", ROOT_M, "-0.5 * slope", "gph", "GPH"))
add("periodogram", kernel_query("E5", "Periodogram"), log_spectrum_sql("E5", ROOT_M, PERIODOGRAM_POINT, "periodogram", "Periodogram"))
add("periodogram_m", kernel_query("E5", "Periodogram", {"m": 24}), log_spectrum_sql("E5", "least(24, n // 2 - 1)", PERIODOGRAM_POINT, "periodogram", "Periodogram"))

GRID = [round(-0.48 + 0.02 * i, 2) for i in range(49)]


def on_grid(x: np.ndarray, m: int, least: int, objective: Callable) -> np.ndarray:
    """The grid value of d for which the objective is smallest."""
    n = x.shape[1]
    if n < least or m < 8:
        return K.invalid(x)
    frequency, power = K.periodogram(x, m)
    return np.array(GRID)[np.argmin([objective(np.full(len(x), d), frequency, power) for d in GRID], axis=0)]


GRID_KERNELS = {
    "WhittleGrid": Kernel(lambda x: on_grid(x, min(64, x.shape[1] // 2 - 1), 128, K.whittle_objective), "whittle"),
    "LocalWhittleGrid": Kernel(lambda x: on_grid(x, min(max(8, int(x.shape[1] ** 0.55)), x.shape[1] // 3), 256, K.local_whittle_objective), "mlw"),
}


def grid_sql(m: str, least: int, objective: str, tag: str, name: str) -> str:
    body = spectrum(m, least) + f"""q AS (SELECT unnest({GRID})::DOUBLE AS d),
o AS ({objective}),
m AS (SELECT series_id, arg_min(d, o) AS point FROM o GROUP BY series_id),
r AS (SELECT ns.series_id, ns.n, CASE WHEN ns.n >= {least} THEN point END AS point FROM ns LEFT JOIN m ON ns.series_id = m.series_id)
"""
    return with_profile(VIEW_SQL["E5"], body + finish(tag, name))


WHITTLE = """SELECT series_id, d, avg(ln(s2 / (2 * pi()) * h) + i / (s2 / (2 * pi()) * h)) AS o FROM (SELECT *, avg(i / h) OVER (PARTITION BY series_id, d) AS s2 FROM (SELECT i.series_id, i.i, q.d, greatest(pow(abs(2 * sin(lam / 2)), -2 * d), 1e-12) AS h FROM i, q)) GROUP BY ALL"""
LOCAL = "SELECT i.series_id, q.d, ln(avg(pow(lam, 2 * q.d) * i.i)) - 2 * q.d * avg(ln(lam)) AS o FROM i, q GROUP BY i.series_id, q.d"
add("whittle_grid", kernel_query("E5", "WhittleGrid", plugins=GRID_KERNELS), grid_sql("least(64, n // 2 - 1)", 128, WHITTLE, "whittle", "WhittleGrid"))
add("local_whittle_grid", kernel_query("E5", "LocalWhittleGrid", plugins=GRID_KERNELS), grid_sql("least(greatest(8, floor(pow(n, 0.55))), n // 3)", 256, LOCAL, "mlw", "LocalWhittleGrid"))


def brent_sql(source: str, objective: str, low: float, high: float, tolerance: float = 1e-5) -> str:
    """Common table expressions ending in least(series_id, d): Brent's bounded minimisation, a step for each recursion.

    source is SQL for series_id and lists; objective is an expression of its lists and of u.
    """
    golden, eps = (3 - math.sqrt(5)) / 2, math.sqrt(2.2e-16)
    return f"""src AS MATERIALIZED ({source}),
steps AS (
  SELECT *, u AS x, u AS w, u AS v, fu AS fx, fu AS fw, fu AS fv, 0.0::DOUBLE AS step, 0.0::DOUBLE AS before, false AS done
  FROM (SELECT *, ({objective})::DOUBLE AS fu FROM (SELECT *, {low!r}::DOUBLE AS a, {high!r}::DOUBLE AS b, ({low!r} + {golden!r} * ({high!r} - {low!r}))::DOUBLE AS u FROM src))
  UNION ALL
  SELECT * EXCLUDE (a, b, u, fu, x, w, v, fx, fw, fv, step, before, done, mid, tol, stop, r, q0, p0, q1, p, q, bow, e, s0, s1, better, second),
    CASE WHEN stop THEN a WHEN better AND u >= x THEN x WHEN NOT better AND u < x THEN u ELSE a END AS a,
    CASE WHEN stop THEN b WHEN better AND u < x THEN x WHEN NOT better AND u >= x THEN u ELSE b END AS b,
    u, fu, CASE WHEN NOT stop AND better THEN u ELSE x END AS x,
    CASE WHEN better THEN x WHEN second THEN u ELSE w END AS w,
    CASE WHEN better OR second THEN w WHEN fu <= fv OR v = x OR v = w THEN u ELSE v END AS v,
    CASE WHEN better THEN fu ELSE fx END AS fx, CASE WHEN better THEN fx WHEN second THEN fu ELSE fw END AS fw,
    CASE WHEN better OR second THEN fw WHEN fu <= fv OR v = x OR v = w THEN fu ELSE fv END AS fv, s1 AS step, e AS before, stop AS done
  FROM (SELECT *, fu <= fx AS better, fu > fx AND (fu <= fw OR w = x) AS second
  FROM (SELECT *, ({objective})::DOUBLE AS fu
  FROM (SELECT *, x + CASE WHEN abs(s1) >= tol THEN s1 WHEN s1 >= 0 THEN tol ELSE -tol END AS u
  FROM (SELECT *, CASE WHEN bow AND least(x + s0 - a, b - x - s0) < 2 * tol THEN CASE WHEN mid >= x THEN tol ELSE -tol END ELSE s0 END AS s1
  FROM (SELECT *, CASE WHEN bow THEN p / q ELSE {golden!r} * e END AS s0
  FROM (SELECT *, CASE WHEN bow THEN step ELSE CASE WHEN x >= mid THEN a ELSE b END - x END AS e
  FROM (SELECT *, abs(before) > tol AND abs(p) < abs(q * before / 2) AND q * (a - x) < p AND p < q * (b - x) AS bow
  FROM (SELECT *, CASE WHEN q1 > 0 THEN -p0 ELSE p0 END AS p, abs(q1) AS q
  FROM (SELECT *, (x - v) * q0 - (x - w) * r AS p0, 2 * (q0 - r) AS q1
  FROM (SELECT *, abs(x - mid) <= 2 * tol - (b - a) / 2 AS stop, (x - w) * (fx - fv) AS r, (x - v) * (fx - fw) AS q0
  FROM (SELECT * EXCLUDE (u, fu), (a + b) / 2 AS mid, {eps!r} * abs(x) + {tolerance / 3!r} AS tol FROM steps WHERE NOT done)))))))))))
),
least AS (SELECT series_id, x AS d FROM steps WHERE done)"""


def whittle_sql(m: str, least: int, objective: str, tag: str, name: str) -> str:
    source = "SELECT series_id, list(lam ORDER BY j) AS lams, list(i ORDER BY j) AS powers FROM i WHERE m >= 8 GROUP BY series_id"
    body = spectrum(m, least) + brent_sql(source, objective, -0.49, 0.49) + f""",
r AS (SELECT ns.series_id, ns.n, CASE WHEN d IS NOT NULL THEN {clip('d', -0.499, 0.499)} END AS point FROM ns LEFT JOIN least ON ns.series_id = least.series_id)
"""
    return with_profile(VIEW_SQL["E5"], body + finish(tag, name))


#: Shapes at u, the variance that fits them, and the mean of log density and power over density; the same in logarithms for the local form.
SHAPES = "list_transform(lams, lambda l: greatest(pow(abs(2 * sin(l / 2)), -2 * u), 1e-12))"
VARIANCE = f"list_avg(list_transform(list_zip(powers, {SHAPES}), lambda z: z[1] / z[2])) / (2 * pi())"
WHITTLE_AT = f"(SELECT list_avg(list_transform(list_zip(powers, sh), lambda z: ln(g * z[2]) + z[1] / (g * z[2]))) FROM (SELECT {SHAPES} AS sh, {VARIANCE} AS g))"
LOCAL_AT = "ln(list_avg(list_transform(list_zip(lams, powers), lambda z: pow(z[1], 2 * u) * z[2]))) - 2 * u * list_avg(list_transform(lams, lambda l: ln(l)))"
add("whittle_mle", kernel_query("E5", "WhittleMLE"), whittle_sql("least(greatest(8, n // 8), n // 2 - 1)", 128, WHITTLE_AT, "whittle", "WhittleMLE"))
add("modified_local_whittle", kernel_query("E5", "ModifiedLocalWhittle"), whittle_sql("least(greatest(8, floor(pow(n, 0.55))), n // 3)", 256, LOCAL_AT, "mlw", "ModifiedLocalWhittle"))


# Wavelets in SQL, level by level.
def levels_sql(wavelet: str, name: str, tag: str, body: str) -> str:
    """Each coefficient is a sum over the filter's taps of values at places mirrored at both ends."""
    h = wavelet_filter(wavelet)
    taps, filters = len(h), ", ".join(f"({j}, {h[len(h) - 1 - j]!r}::DOUBLE, {(-1) ** (j + 1) * c!r}::DOUBLE)" for j, c in enumerate(h))
    levels = f"""taps(j, lo, hi) AS (VALUES {filters}),
lv AS (
  SELECT series_id, CAST(0 AS BIGINT) AS k, t, x AS a, x AS d, CAST(n AS BIGINT) AS len, CAST(floor(log2(n / {taps - 1})) AS BIGINT) AS top FROM p WHERE n >= 128
  UNION ALL
  SELECT m.series_id, m.k + 1 AS k, m.o AS t, sum(m.lo * b.a) AS a, sum(m.hi * b.a) AS d, (m.len + {taps - 1}) // 2 AS len, m.top
  FROM (SELECT *, CASE WHEN place < len THEN place ELSE 2 * len - 1 - place END AS at FROM
    (SELECT o.*, lo, hi, ((2 * o - j) % (2 * len) + 2 * len + 1) % (2 * len) AS place FROM
      (SELECT series_id, k, len, top, unnest(range((len + {taps - 1}) // 2)) AS o FROM lv WHERE t = 0 AND k < top) AS o, taps)) AS m
  JOIN lv AS b ON b.series_id = m.series_id AND b.t = m.at GROUP BY m.series_id, m.k, m.o, m.len, m.top),
dv AS (SELECT series_id, top, k, count(*) AS c, greatest(var_samp(d), 1e-30) AS v FROM lv WHERE k > 0 GROUP BY series_id, top, k)"""
    tail = f"""j AS (SELECT series_id, top - k + 1 AS j, top, c, v FROM dv WHERE c >= 2),
{body}
"""
    return with_profile(VIEW_SQL["E5"], levels + ",\n" + tail + finish(tag, name))


def slope_of(rows: str, weighted: bool) -> str:
    """SQL for (series_id, slope, k) of log2 v on j."""
    if not weighted:
        return f"SELECT series_id, count(*) AS k, regr_slope(log2(v), j) AS slope FROM ({rows}) GROUP BY series_id"
    return f"SELECT series_id, count(*) AS k, sum(c * (j - jm) * (log2(v) - vm)) / sum(c * (j - jm) * (j - jm)) AS slope FROM (SELECT *, sum(c * j) OVER w / sum(c) OVER w AS jm, sum(c * log2(v)) OVER w / sum(c) OVER w AS vm FROM ({rows}) WINDOW w AS (PARTITION BY series_id)) GROUP BY series_id"


def haar_slope(coarse: int, fine: int, weighted: bool) -> str:
    rows = f"SELECT * FROM j WHERE j > {coarse} AND j <= top - {fine}"
    return f"""m AS ({slope_of(rows, weighted)}),
r AS (SELECT ns.series_id, ns.n, CASE WHEN k >= 3 THEN {clip('(slope + 2) / 2')} END AS point FROM ns LEFT JOIN m ON ns.series_id = m.series_id)"""


JENSEN = f"""m1 AS ({slope_of("SELECT * FROM j WHERE j BETWEEN 2 AND 4", True)}), m2 AS ({slope_of("SELECT * FROM j WHERE j BETWEEN 4 AND 6", True)}),
r AS (SELECT ns.series_id, ns.n, CASE WHEN ns.n >= 256 THEN {clip(f"2 * {clip('(m1.slope + 2) / 2')} - {clip('(m2.slope + 2) / 2')}")} END AS point FROM ns LEFT JOIN m1 ON ns.series_id = m1.series_id LEFT JOIN m2 ON ns.series_id = m2.series_id)"""
LEVELS_AT = "list_transform(js, lambda x: pow(2.0, (2 * u - 2) * x))"
WAVELET_AT = f"(SELECT list_sum(list_transform(list_zip(cs, vs, sh), lambda z: z[1] * (ln(g * z[3]) + z[2] / (g * z[3])))) FROM (SELECT {LEVELS_AT} AS sh, list_sum(list_transform(list_zip(cs, vs), lambda z: z[1] * z[2])) / list_sum(list_transform(list_zip(cs, {LEVELS_AT}), lambda z: z[1] * z[2])) AS g))"
WAVELET_WHITTLE = brent_sql("SELECT series_id, list(j::DOUBLE ORDER BY j) AS js, list(c::DOUBLE ORDER BY j) AS cs, list(v ORDER BY j) AS vs FROM j WHERE j > 1 AND j <= top - 1 GROUP BY series_id HAVING count(*) >= 3", WAVELET_AT, 0.06, 0.994) + f""",
r AS (SELECT ns.series_id, ns.n, CASE WHEN d IS NOT NULL THEN {clip('d')} END AS point FROM ns LEFT JOIN least ON ns.series_id = least.series_id)"""
WAVELET_BODIES = {"WaveletOLS": ("ols", "wavelet_ols", haar_slope(1, 1, False)), "WaveletAbryVeitch": ("abry_veitch", "wavelet_av", haar_slope(2, 2, False)), "WaveletBardet": ("bardet", "wavelet_bardet", haar_slope(1, 2, True)), "WaveletJensen": ("jensen", "wavelet_jensen", JENSEN), "WaveletWhittle": ("whittle", "wavelet_whittle", WAVELET_WHITTLE)}
for _n, (_short, _tag, _body) in WAVELET_BODIES.items():
    add(f"wavelet_haar_{_short}", kernel_query("E5", _n, {"wavelet": "haar"}), levels_sql("haar", _n, _tag, _body))
    add(f"wavelet_db4_{_n.lower().replace('wavelet', '')}", kernel_query("E5", _n), levels_sql("db4", _n, _tag, _body))

# The example plugin, native and as a registered kernel.
VR_BODY = """d AS (SELECT series_id, v, v - lag(v) OVER (PARTITION BY series_id ORDER BY t) AS d FROM s),
r AS (SELECT series_id, count(*) AS n, CASE WHEN count(*) >= 32 AND var_pop(v) > 0 AND var_pop(d) > 0 THEN least(greatest(var_pop(v) / (var_pop(v) + var_pop(d)), 0), 1) END AS point FROM d GROUP BY series_id)
"""
VARIANCE_RATIO = {"VarianceRatio": Kernel(K.variance_ratio, "variance_ratio", 0, ("min_n",))}
add("variance_ratio", native_query("EU", native.variance_ratio), with_profile(VIEW_SQL["EU"], VR_BODY + finish("variance_ratio", "VarianceRatio")))
add("variance_ratio_plugin", kernel_query("EU", "VarianceRatio", plugins=VARIANCE_RATIO), with_profile(VIEW_SQL["EU"], VR_BODY + finish("variance_ratio", "VarianceRatio")))

#: Rows of a block in the registered queries: small, so that also small tables have many.
BLOCK = 256


def block_of(spark: SparkSession, sf: str, view: str = "E5B") -> int:
    """Rows of a block: a BLOCKth of the events, if that is more than BLOCK, up to 65,536. With more rows, fewer of them are
    copied to other blocks; the result is the same. Series by user or day are short."""
    return min(max(BLOCK, read(spark, sf, "events").count() // BLOCK), 1 << 16) if view == "E5B" else BLOCK


def block_query(f: Callable[[DataFrame, int], DataFrame], view: str = "E5B") -> Query:
    return lambda spark, sf: shown(f(VIEWS[view](spark, sf), block_of(spark, sf, view)))


# The same estimators on series in blocks, against the same SQL.
for _n, _f in (("ghe", blocks.ghe), ("higuchi", blocks.higuchi), ("dma_hurst", blocks.dma), ("gph", blocks.gph), ("periodogram", blocks.log_periodogram)):
    add(f"{_n}_blocks", block_query(_f), SQL[_n])
add("periodogram_m_blocks", block_query(lambda s, size: blocks.log_periodogram(s, size, 24)), SQL["periodogram_m"])
add("ghe_revenue_blocks", block_query(blocks.ghe, "L3"), SQL["ghe_revenue"])
add("gph_validity_blocks", block_query(blocks.gph, "EU"), SQL["gph_validity"])
add("dma_validity_blocks", block_query(blocks.dma, "EU"), SQL["dma_validity"])
for _n, _short, _args in (("WaveletOLS", "ols", (1, 1, False)), ("WaveletAbryVeitch", "abryveitch", (2, 2, False)), ("WaveletBardet", "bardet", (1, 2, True))):
    add(f"wavelet_db4_{_short}_blocks", block_query(lambda s, size, n=_n, a=_args: blocks.wavelet_slope(s, n, WAVELET_BODIES[n][1], "db4", *a, size=size)), SQL[f"wavelet_db4_{_short}"])
add("modified_local_whittle_blocks", block_query(blocks.local_whittle), SQL["modified_local_whittle"])
add("variance_ratio_blocks", block_query(blocks.variance_ratio, "EU"), SQL["variance_ratio"])

# Perturbations.
SHIFT_SQL = "SELECT series_id, t, v + 0.75 * (stddev_pop(v) OVER (PARTITION BY series_id) + 1e-12) AS v FROM ({view})"
TREND_SQL = """SELECT series_id, t, v + {strength} * (sd + 1e-12) * (g - avg(g) OVER w) / (stddev_pop(g) OVER w + 1e-12) AS v FROM
(SELECT *, {g} AS g FROM (SELECT *, CASE WHEN n > 1 THEN 2.0 * t / (n - 1) - 1 ELSE -1 END AS u FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, stddev_pop(v) OVER (PARTITION BY series_id) AS sd FROM ({view})))) WINDOW w AS (PARTITION BY series_id)"""
OUTLIER_SQL = """SELECT a.series_id, a.t, CASE WHEN h.t IS NOT NULL THEN a.v + CASE WHEN a.t % 2 = 0 THEN 1.0 ELSE -1.0 END * 4.0 * (a.sd + 1e-12) ELSE a.v END AS v
FROM (SELECT *, stddev_pop(v) OVER (PARTITION BY series_id) AS sd FROM ({view})) AS a
LEFT JOIN (SELECT DISTINCT series_id, (i * 37) % n AS t FROM (SELECT series_id, n, unnest(range(CAST(least(greatest(1, round_even(0.02 * n, 0)), n) AS BIGINT))) AS i FROM (SELECT series_id, count(*) AS n FROM ({view}) GROUP BY series_id))) AS h ON h.series_id = a.series_id AND h.t = a.t"""


def points_of(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(VIEWS["E5"](spark, sf)).select("series_id", "t", rounded("v", 5).alias("v"))


def points_sql(sql: str) -> str:
    return f"SELECT series_id, t, round(v, 5) + 0.0 AS v FROM ({sql})"


E5_TREND = TREND_SQL.format(view=VIEW_SQL["E5"], strength=0.8, g="u + u * u")
add("level_shift", points_of(lambda s: native.level_shift(s, 0.75)), points_sql(SHIFT_SQL.format(view=VIEW_SQL["E5"])))
add("polynomial_trend", points_of(lambda s: native.polynomial_trend(s, 2, 0.8)), points_sql(E5_TREND))
add("polynomial_trend_blocks", lambda spark, sf: blocks.polynomial_trend(VIEWS["E5B"](spark, sf), 2, 0.8, block_of(spark, sf)).select("series_id", "t", rounded("v", 5).alias("v")), points_sql(E5_TREND))
add("outliers_fixed", points_of(lambda s: native.fixed_outliers(s, 0.02, 4.0)), points_sql(OUTLIER_SQL.format(view=VIEW_SQL["E5"])))
add("rs_after_trend", lambda spark, sf: shown(native.rescaled_range(native.polynomial_trend(VIEWS["E5"](spark, sf), 2, 0.8))), with_profile(E5_TREND, RS_BODY + finish("rs", "RS")))


def contaminated_arrow(name: str, params: dict, strength: Callable) -> Query:
    """A seeded perturbation by its kernel: how many points it changed, and how strongly, in the series' standard deviations."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        from perdura.operators.simulate import contaminated_points

        rows = pack(VIEWS["E5"](spark, sf)).withColumn("seed", F.xxhash64("series_id").bitwiseAND(F.lit(0x7FFFFFFF)))
        gap = F.col("contaminated") - F.col("v")
        each = contaminated_points(rows, name, params).groupBy("series_id", "n").agg(F.count(F.when(F.abs(gap) > 1e-12, 1)).alias("changed"), strength(gap).alias("gap"), F.stddev_pop("v").alias("spread"))
        return each.select("series_id", "n", "changed", rounded(F.col("gap") / F.col("spread"), 5).alias("strength"))

    return query


add("outliers_random", contaminated_arrow("outliers", {"rate": 0.02, "amplitude": 4.0}, lambda g: F.max(F.abs(g))), f"SELECT series_id, count(*) AS n, CAST(greatest(1, round_even(0.02 * count(*), 0)) AS BIGINT) AS changed, 4.0::DOUBLE AS strength FROM ({VIEW_SQL['E5']}) GROUP BY series_id")
add("heavy_tail_noise", contaminated_arrow("heavy_tail_noise", {"df": 5.0, "scale": 0.5}, F.stddev_pop), f"SELECT series_id, count(*) AS n, count(*) AS changed, 0.5::DOUBLE AS strength FROM ({VIEW_SQL['E5']}) GROUP BY series_id")


# Estimators by name in SQL.
def sql_query(text: str, view: str = "E5") -> Query:
    """A query over the view under the name series, with the estimators registered."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        from perdura.functions import sql

        sql.register(spark, VARIANCE_RATIO)
        return spark.sql(text, series=VIEWS[view](spark, sf))

    return query


def plain_points(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT series_id, estimator_name, point FROM ({SQL[n]})" for n in names)


for _n, _name in (("rs_hurst", "RS"), ("gph", "GPH"), ("dfa_order1", "DFA")):
    add(f"sql_{_name.lower()}", sql_query(f"SELECT series_id, '{_name}' AS estimator_name, round(lrd_{_name.lower()}(t, v), 6) + 0.0D AS point FROM {{series}} GROUP BY series_id"), plain_points(_n))
add("sql_plugin_validity", sql_query("SELECT series_id, 'VarianceRatio' AS estimator_name, round(lrd_varianceratio(t, v), 6) + 0.0D AS point FROM {series} GROUP BY series_id", "EU"), plain_points("variance_ratio"))
add("sql_estimates", sql_query("SELECT series_id, estimator_name, round(point, 6) + 0.0D AS point FROM lrd_estimates(TABLE(SELECT series_id, t, v FROM {series}) PARTITION BY series_id ORDER BY t) WHERE estimator_name IN ('RS', 'GPH', 'DMA', 'WaveletOLS', 'WhittleMLE')"), plain_points("rs_hurst", "gph", "dma_hurst", "wavelet_db4_ols", "whittle_mle"))


def block_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Points with circular block bootstrap intervals of 200 replicates, for all built-in estimators; not valid where a series is too short."""
    from perdura.operators.estimate import estimate
    from perdura.plans.registry import EstimatorSpec

    records = pack(VIEWS["E5"](spark, sf)).select(F.col("series_id").alias("record_id"), F.lit(7).cast("long").alias("seed"), "values")
    specs = [EstimatorSpec(n, params={"n_bootstrap": 200}) for n in K.KERNELS]
    out = estimate(records, specs)
    return out.select("record_id", "estimator_name", rounded("point").alias("point"), rounded("ci_low").alias("ci_low"), rounded("ci_high").alias("ci_high"), "valid", "bootstrap_used")


add("block_bootstrap", block_bootstrap)
