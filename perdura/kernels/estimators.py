"""Point statistics of the estimators, for all rows of a matrix at once; nan marks an invalid estimate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from perdura.kernels.numeric import details, half_chirp, largest_factor, low_frequencies, minimise, slopes

LOW, HIGH = 1e-4, 1 - 1e-4
#: Length from which series have ways of their own: few frequencies without the whole transform, DFA's wide boxes from running sums.
LONG = 1 << 16
#: A plain transform is slow for lengths with a prime factor above this.
ROUGH = 64
#: Values that DFA takes at once, few enough to stay in a core's cache; places of a row of its running sums; scales that use them.
PIECE, CHUNK, WIDE = 1 << 15, 64, 256
#: Values that are taken at once for all lags, or for all windows.
SPAN = 1 << 16


def centred(x: np.ndarray) -> np.ndarray:
    return x - x.mean(axis=1, keepdims=True)


def invalid(x: np.ndarray) -> np.ndarray:
    return np.full(len(x), np.nan)


def scale_grid(first: int, n: int, last: int | None) -> list[int]:
    """Scales from first, each a quarter larger (halves to even) and at least one more; empty if the range is."""
    top = min(max(first + 4, n // 4) if last is None else int(last), n // 2)
    grid, s = [], first
    while top > first and s <= top:
        grid.append(s)
        s = max(s + 1, round(s * 1.25))
    return grid


def lag_grid(n: int, count: int = 16, first: int = 1) -> list[int]:
    top = max(first + 2, n // 8)
    return [int(h) for h in np.unique(np.round(np.geomspace(first, top, max(6, int(count)))).astype(int)) if 1 <= h < n // 2]


def pieces(x: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of places in which all rows together have about SPAN values."""
    step = max(1, SPAN // max(1, len(x)))
    return [(at, min(at + step, x.shape[1])) for at in range(0, x.shape[1], step)]


def log_positive(v: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(v > 0, np.log(v), np.nan)


def rescaled_range(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    if n < 16:
        return invalid(x)
    y = centred(x).cumsum(axis=1)
    r, s = y.max(axis=1) - y.min(axis=1), x.std(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((s >= 1e-12) & (r >= 1e-12), np.log(r / s) / np.log(n), np.nan)


def sums_of(part: np.ndarray, first: np.ndarray, count: np.ndarray | int) -> np.ndarray:
    """Sums of y, place * y and y * y over the first count values of each row of part, which begins at place first; in long
    doubles, with rows taken about their first value."""
    u, start = np.arange(part.shape[1]), part[:, 0].astype(np.longdouble)
    z = np.where(u < np.reshape(count, (-1, 1)), part - part[:, :1], 0.0)
    z0, total = z.sum(axis=1), np.asarray(count, dtype=np.longdouble)
    s0 = z0 + total * start
    return np.stack([s0, first * s0 + z @ u + start * (total * (total - 1) / 2), np.einsum("ij,ij->i", z, z) + 2 * start * z0 + total * start**2])


def running_moments(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """y in rows of CHUNK places (the last filled up), and sums_of all rows before each."""
    rows = np.pad(y, (0, -len(y) % CHUNK + CHUNK)).reshape(-1, CHUNK)
    out = np.zeros((3, len(rows) + 1), dtype=np.longdouble)
    for at in range(0, len(rows), PIECE // CHUNK):
        part = rows[at : at + PIECE // CHUNK]
        out[:, at + 1 : at + 1 + len(part)] = sums_of(part, np.arange(at, at + len(part), dtype=np.longdouble) * CHUNK, CHUNK)
    return rows, out.cumsum(axis=1)


def box_residuals(rows: np.ndarray, before: np.ndarray, n: int, s: int, order: int) -> float:
    """Mean square about a constant or line in boxes of s places, from differences of running sums; nan if they leave too few digits."""
    edges = np.arange(n // s + 1) * s
    row, inside = np.divmod(edges, CHUNK)
    s0, s1, s2 = np.diff(before[:, row] + sums_of(rows[row], row.astype(np.longdouble) * CHUNK, inside), axis=1)
    rest = s2 - s0**2 / s
    if order == 1:
        rest = rest - (s1 - (edges[:-1] + np.longdouble(s - 1) / 2) * s0) ** 2 * 12 / (np.longdouble(s) * (s * s - 1))
    return float(rest.sum() / edges[-1]) if rest.sum() > s2.sum() * 1e-10 else np.nan


def dfa(x: np.ndarray, detrend_order: int = 1, min_scale: int = 16, max_scale: int | None = None) -> np.ndarray:
    n, order = x.shape[1], max(0, int(detrend_order))
    grid = [s for s in scale_grid(int(min_scale), n, max_scale) if s >= order + 2 and n // s >= 2]
    if n < 64 or len(grid) < 3:
        return invalid(x)
    y = centred(x).cumsum(axis=1)
    f = np.empty((len(x), len(grid)))
    moments = [running_moments(row) for row in y] if order <= 1 and n >= LONG else []
    for i, s in enumerate(grid):
        if moments and s >= WIDE:
            f[:, i] = [box_residuals(*m, n, s, order) for m in moments]
            if np.isfinite(f[:, i]).all():
                continue
        # What is orthogonal to polynomials is left; one basis serves all boxes of a scale.
        q = np.linalg.qr(np.vander(np.linspace(-1, 1, s), order + 1))[0]
        end, step, total = n // s * s, max(1, PIECE // (s * len(x))) * s, np.zeros(len(x))
        for at in range(0, end, step):
            boxes = y[:, at : min(at + step, end)].reshape(-1, s)
            rest = (boxes - boxes @ q @ q.T).reshape(len(x), -1)
            total += np.einsum("ij,ij->i", rest, rest)
        f[:, i] = total / end
    return np.clip(slopes(np.log(grid), log_positive(f) / 2, 3), LOW, HIGH)


def dma(x: np.ndarray, min_scale: int = 8, max_scale: int | None = None) -> np.ndarray:
    n = x.shape[1]
    grid = [w for w in scale_grid(int(min_scale), n, max_scale) if 2 <= w <= n - 3]
    if n < 64 or len(grid) < 3:
        return invalid(x)
    y = centred(x).cumsum(axis=1)
    sums = np.concatenate([np.zeros((len(x), 1)), y.cumsum(axis=1)], axis=1)
    f = np.zeros((len(x), len(grid)))
    for at, end in pieces(x):
        for i, w in enumerate(grid):
            first = max(at, w - 1)
            if first >= end:
                break
            gap = sums[:, first + 1 : end + 1] - sums[:, first + 1 - w : end + 1 - w]
            gap *= 1 / w
            np.subtract(y[:, first:end], gap, out=gap)
            f[:, i] += np.vecdot(gap, gap)
    f /= n + 1 - np.array(grid)
    return np.clip(slopes(np.log(grid), log_positive(f) / 2, 3), LOW, HIGH)


def higuchi_slope(x: np.ndarray, k_max: int | None = None) -> np.ndarray:
    """Slope of log curve length on log 1/k, before it is clipped to a dimension."""
    n = x.shape[1]
    if n < 64:
        return invalid(x)
    top = int(np.clip(max(8, min(64, n // 8)) if k_max is None else int(k_max), 4, n // 4))
    sums = [np.zeros((len(x), k)) for k in range(1, top + 1)]
    for at, end in pieces(x):
        for k, total in enumerate(sums, 1):
            step = x[:, at + k : end + k] - x[:, at : min(end, n - k)]
            np.abs(step, out=step)
            # Rows of about 256 places are added up first, as a sum over many short rows is slow.
            wide = -(-256 // k) * k
            whole = step.shape[1] // wide * wide
            folded = step[:, :whole].reshape(len(x), -1, wide).sum(axis=1)
            folded[:, : step.shape[1] - whole] += step[:, whole:]
            folded, turn = folded.reshape(len(x), -1, k).sum(axis=1), at % k
            total[:, turn:] += folded[:, : k - turn]
            total[:, :turn] += folded[:, k - turn :]
    length = np.empty((len(x), top))
    for k, total in enumerate(sums, 1):
        length[:, k - 1] = (total / ((n - np.arange(k) - 1) // k)).mean(axis=1) * (n - 1) / k
    return slopes(-np.log(np.arange(1, top + 1)), log_positive(length), 4)


def higuchi(x: np.ndarray, k_max: int | None = None) -> np.ndarray:
    return np.clip(2 - np.clip(higuchi_slope(x, k_max), 1 + 1e-4, 2 - 1e-4), LOW, HIGH)


def ghe(x: np.ndarray, n_scales: int = 16, h_min: int = 1, flat_slope_tol: float = 0.08) -> np.ndarray:
    n = x.shape[1]
    grid = lag_grid(n, n_scales, int(h_min)) if n >= 128 else []
    if len(grid) < 4:
        return invalid(x)
    # About the mean step, which is known from the ends.
    mean = np.stack([(x[:, -h:].sum(axis=1) - x[:, :h].sum(axis=1)) / (n - h) for h in grid], axis=1)
    left, v = np.zeros(mean.shape), np.zeros(mean.shape)
    for at, end in pieces(x):
        for i, h in enumerate(grid):
            if at >= n - h:
                break
            step = x[:, at + h : end + h] - x[:, at : min(end, n - h)]
            step -= mean[:, i : i + 1]
            left[:, i] += step.sum(axis=1)
            v[:, i] += np.vecdot(step, step)
    count = n - np.array(grid)
    v = v / count - (left / count) ** 2
    s = slopes(np.log(grid), np.log(np.maximum(v, 1e-30)), 4)
    return np.where(np.abs(s) < flat_slope_tol, 0.5, np.clip(s / 2, LOW, HIGH))


def periodogram(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    n = x.shape[1]
    if n >= LONG and m <= n // 256:
        z = low_frequencies(centred(x), m)
    elif n >= LONG and largest_factor(n) > ROUGH:
        z = half_chirp(x, m)
    else:
        z = np.fft.rfft(centred(x), axis=1)[:, 1 : m + 1]
    power = np.abs(z) ** 2 / n
    return 2 * np.pi * np.arange(1, m + 1) / n, np.maximum(power, 1e-20)


def log_periodogram_d(x: np.ndarray, m: int | None) -> np.ndarray:
    n = x.shape[1]
    m = min(max(2, int(n**0.5)) if m is None else int(m), n // 2 - 1)
    if n < 64 or m < 2:
        return invalid(x)
    frequency, power = periodogram(x, m)
    return -0.5 * slopes(np.log(4 * np.sin(frequency / 2) ** 2), np.log(power), 2)


def gph(x: np.ndarray) -> np.ndarray:
    return log_periodogram_d(x, None)


def log_periodogram(x: np.ndarray, m: int | None = None) -> np.ndarray:
    return np.clip(log_periodogram_d(x, m), -0.499, 0.499)


def whittle_objective(d: np.ndarray, frequency: np.ndarray, power: np.ndarray, bend: np.ndarray | None = None) -> np.ndarray:
    """Of one d for each row of power; bend is log_bend of the frequencies."""
    log_shape = np.multiply.outer(-2 * np.asarray(d), log_bend(frequency) if bend is None else bend)
    np.maximum(log_shape, np.log(1e-12), out=log_shape)
    level = log_shape.mean(axis=1)
    variance = np.mean(power * np.exp(np.negative(log_shape, out=log_shape), out=log_shape), axis=1)
    ok = (variance > 0) & np.isfinite(variance)
    # The mean of power / f, for f the shape times variance / (2 pi), is 2 pi.
    return np.where(ok, np.log(np.where(ok, variance, 1.0) / (2 * np.pi)) + level + 2 * np.pi, 1e12)


def log_bend(frequency: np.ndarray) -> np.ndarray:
    return np.log(2 * np.sin(frequency / 2))


def local_whittle_objective(d: np.ndarray, frequency: np.ndarray, power: np.ndarray) -> np.ndarray:
    d = np.asarray(d)
    g = np.mean(frequency ** (2 * d[:, None]) * power, axis=1)
    ok = (g > 0) & np.isfinite(g)
    return np.where(ok, np.log(np.where(ok, g, 1.0)) - 2 * d * np.mean(np.log(frequency)), 1e12)


def minimised_d(x: np.ndarray, m: int, objective: Callable, *once: Callable) -> np.ndarray:
    """The minimum for each series, all searched at once; once are functions of the frequencies that the objective takes besides."""
    frequency, power = periodogram(x, m)
    given = [f(frequency) for f in once]
    d, ok = minimise(lambda u, rows: objective(u, frequency, power[rows], *given), len(x), -0.49, 0.49)
    return np.where(ok, np.clip(d, -0.499, 0.499), np.nan)


def whittle(x: np.ndarray, m: int | None = None) -> np.ndarray:
    n = x.shape[1]
    m = min(max(8, n // 8) if m is None else int(m), n // 2 - 1)
    return invalid(x) if n < 128 or m < 8 else minimised_d(x, m, whittle_objective, log_bend)


def local_whittle(x: np.ndarray, m: int | None = None) -> np.ndarray:
    n = x.shape[1]
    m = min(max(8, int(n**0.55)) if m is None else int(m), n // 3)
    return invalid(x) if n < 256 or m < 8 else minimised_d(x, m, local_whittle_objective)


def levels(x: np.ndarray, wavelet: str, drop_coarse: int, drop_fine: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Level numbers (1 the coarsest), variances by row, and counts; None with fewer than three levels."""
    if x.shape[1] < 128:
        return None
    d = details(centred(x), wavelet)[::-1]
    if len(d) < 3:
        return None
    kept = [(j, c) for j, c in enumerate(d, 1) if drop_coarse < j <= len(d) - drop_fine and c.shape[1] >= 2]
    if len(kept) < 3:
        return None
    return np.array([float(j) for j, _ in kept]), np.stack([np.maximum(c.var(axis=1, ddof=1), 1e-30) for _, c in kept], axis=1), np.array([float(c.shape[1]) for _, c in kept])


def from_level_slope(s: np.ndarray) -> np.ndarray:
    return np.clip((s + 2) / 2, LOW, HIGH)


def wavelet_slope(x: np.ndarray, wavelet: str, drop_coarse: int, drop_fine: int, weighted: bool) -> np.ndarray:
    got = levels(x, wavelet, drop_coarse, drop_fine)
    if got is None:
        return invalid(x)
    j, v, n = got
    return from_level_slope(slopes(j, np.log2(v), 1, n / n.sum() if weighted else None))


def wavelet_abry_veitch(x: np.ndarray, wavelet: str = "db4", j_drop_high: int = 2, j_drop_low: int = 2) -> np.ndarray:
    return wavelet_slope(x, wavelet, int(j_drop_high), int(j_drop_low), False)


def wavelet_bardet(x: np.ndarray, wavelet: str = "db4", j_drop_high: int = 1, j_drop_low: int = 2) -> np.ndarray:
    return wavelet_slope(x, wavelet, int(j_drop_high), int(j_drop_low), True)


def wavelet_ols(x: np.ndarray, wavelet: str = "db4", j_drop_high: int = 1, j_drop_low: int = 1) -> np.ndarray:
    return wavelet_slope(x, wavelet, int(j_drop_high), int(j_drop_low), False)


def wavelet_jensen(x: np.ndarray, wavelet: str = "db4", fine_band: tuple = (2, 4), coarse_band: tuple = (4, 6)) -> np.ndarray:
    got = levels(x, wavelet, 0, 0) if x.shape[1] >= 256 else None
    if got is None:
        return invalid(x)
    j, v, n = got

    def band(low: float, high: float) -> np.ndarray:
        k = (j >= low) & (j <= high)
        if k.sum() < 2:
            return invalid(x)
        return from_level_slope(slopes(j[k], np.log2(v[:, k]), 2, n[k] / n[k].sum()))

    return np.clip(2 * band(*fine_band) - band(*coarse_band), LOW, HIGH)


def wavelet_whittle(x: np.ndarray, wavelet: str = "db4", j_drop_high: int = 1, j_drop_low: int = 1) -> np.ndarray:
    got = levels(x, wavelet, int(j_drop_high), int(j_drop_low))
    if got is None:
        return invalid(x)
    j, v, n = got

    def cost(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        shape = 2.0 ** ((2 * h[:, None] - 2) * j)
        expected = ((n * v[rows]).sum(axis=1) / (n * shape).sum(axis=1))[:, None] * shape
        return (n * (np.log(expected) + v[rows] / expected)).sum(axis=1)

    h, ok = minimise(cost, len(x), 0.06, 0.994)
    return np.where(ok, np.clip(h, LOW, HIGH), np.nan)


def variance_ratio(x: np.ndarray, min_n: int = 32) -> np.ndarray:
    """Variance against variance plus that of first differences."""
    if x.shape[1] < int(min_n):
        return invalid(x)
    a, b = x.var(axis=1), np.diff(x, axis=1).var(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((a > 0) & (b > 0), np.clip(a / (a + b), 0, 1), np.nan)


@dataclass(frozen=True)
class Kernel:
    """A statistic with the tag of its failures, its seed offset and the parameters that it takes."""

    statistic: Callable[..., np.ndarray]
    tag: str
    seed_offset: int = 0
    parameters: tuple[str, ...] = field(default=())

    def __call__(self, x: np.ndarray, params: dict) -> np.ndarray:
        return self.statistic(x, **{k: params[k] for k in self.parameters if k in params})


#: The built-in estimators, with the reported tags and seed offsets (fixed values).
KERNELS: dict[str, Kernel] = {
    "RS": Kernel(rescaled_range, "rs", 0),
    "DFA": Kernel(dfa, "dfa", 0, ("detrend_order", "min_scale", "max_scale")),
    "DMA": Kernel(dma, "dma", 17, ("min_scale", "max_scale")),
    "Higuchi": Kernel(higuchi, "higuchi", 919, ("k_max",)),
    "GHE": Kernel(ghe, "ghe", 1021, ("n_scales", "h_min", "flat_slope_tol")),
    "GPH": Kernel(gph, "gph", 7919),
    "Periodogram": Kernel(log_periodogram, "periodogram", 101, ("m",)),
    "WhittleMLE": Kernel(whittle, "whittle", 203, ("m",)),
    "ModifiedLocalWhittle": Kernel(local_whittle, "mlw", 307, ("m",)),
    "WaveletAbryVeitch": Kernel(wavelet_abry_veitch, "wavelet_av", 401, ("wavelet", "j_drop_high", "j_drop_low")),
    "WaveletBardet": Kernel(wavelet_bardet, "wavelet_bardet", 503, ("wavelet", "j_drop_high", "j_drop_low")),
    "WaveletOLS": Kernel(wavelet_ols, "wavelet_ols", 607, ("wavelet", "j_drop_high", "j_drop_low")),
    "WaveletJensen": Kernel(wavelet_jensen, "wavelet_jensen", 709, ("wavelet", "fine_band", "coarse_band")),
    "WaveletWhittle": Kernel(wavelet_whittle, "wavelet_whittle", 811, ("wavelet", "j_drop_high", "j_drop_low")),
}
