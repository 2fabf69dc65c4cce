"""Regression slopes over rows, bounded minimisation and Daubechies filters."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from math import comb, sqrt

import numpy as np


def slopes(u: np.ndarray, v: np.ndarray, least: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Least-squares slope of each row of v on u; entries that are nan in v are left out.

    nan where fewer than least points remain, or where u does not vary.
    """
    ok = np.isfinite(v)
    w = ok * (1.0 if weights is None else weights)
    total = w.sum(axis=1)
    x = np.where(ok, v, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        um, vm = (w * u).sum(axis=1) / total, (w * x).sum(axis=1) / total
        du = (u - um[:, None]) * ok
        scale = (w * du * du).sum(axis=1)
        out = (w * du * (x - vm[:, None])).sum(axis=1) / scale
    return np.where((ok.sum(axis=1) >= least) & (scale >= 1e-20), out, np.nan)


def minimise(f: Callable[[np.ndarray, np.ndarray], np.ndarray], count: int, low: float, high: float, tolerance: float = 1e-5, most: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Brent's bounded minimisation (golden sections and parabolas) of count functions at once; the places, and which converged.

    f(u, rows) gives the values at u, one place for each of the functions rows that are still open.
    """
    golden, eps = (3 - sqrt(5)) / 2, sqrt(2.2e-16)
    place, done = np.full(count, low + golden * (high - low)), np.zeros(count, dtype=bool)
    rows = np.arange(count)
    a, b, x = np.full(count, low), np.full(count, high), place.copy()
    w, v = x.copy(), x.copy()
    fx = f(x, rows) if count else np.zeros(0)
    fw, fv = fx.copy(), fx.copy()
    step, before = np.zeros(count), np.zeros(count)
    for _ in range(most):
        mid, tol = (a + b) / 2, eps * np.abs(x) + tolerance / 3
        stop = np.abs(x - mid) <= 2 * tol - (b - a) / 2
        place[rows] = x
        if stop.any():
            done[rows[stop]] = True
            rows, a, b, x, w, v, fx, fw, fv, step, before, mid, tol = (z[~stop] for z in (rows, a, b, x, w, v, fx, fw, fv, step, before, mid, tol))
        if not len(rows):
            break
        r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
        p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
        p, q = np.where(q > 0, -p, p), np.abs(q)
        parabola = (np.abs(before) > tol) & (np.abs(p) < np.abs(q * before / 2)) & (q * (a - x) < p) & (p < q * (b - x))
        before = np.where(parabola, step, np.where(x >= mid, a, b) - x)
        step = np.where(parabola, np.divide(p, q, out=np.zeros_like(p), where=parabola), golden * before)
        near_end = parabola & (np.minimum(x + step - a, b - x - step) < 2 * tol)
        step = np.where(near_end, np.where(mid >= x, tol, -tol), step)
        u = x + np.where(np.abs(step) >= tol, step, np.where(step >= 0, tol, -tol))
        fu = f(u, rows)
        better = fu <= fx
        right = u >= x
        a, b = np.where(better & right, x, np.where(~better & ~right, u, a)), np.where(better & ~right, x, np.where(~better & right, u, b))
        second = ~better & ((fu <= fw) | (w == x))
        third = ~better & ~second & ((fu <= fv) | (v == x) | (v == w))
        v, fv = np.where(better | second, w, np.where(third, u, v)), np.where(better | second, fw, np.where(third, fu, fv))
        w, fw = np.where(better, x, np.where(second, u, w)), np.where(better, fx, np.where(second, fu, fw))
        x, fx = np.where(better, u, x), np.where(better, fu, fx)
    place[rows] = x
    return place, done


@cache
def daubechies(order: int) -> tuple[float, ...]:
    """Scaling filter with `order` vanishing moments, minimum phase, by spectral factorisation."""
    if order == 1:
        return (1 / sqrt(2), 1 / sqrt(2))
    # P(y) = sum C(order-1+k, k) y^k with y = (2 - z - 1/z) / 4: keep the roots inside the unit circle.
    roots = np.roots([comb(order - 1 + k, k) for k in range(order - 1, -1, -1)])
    inside = []
    for y in roots:
        z = np.roots([1.0, 4 * y - 2, 1.0])
        inside.append(z[np.argmin(np.abs(z))])
    h = np.real(np.poly([*inside, *([-1.0] * order)]))
    return tuple(float(x) for x in h * sqrt(2) / h.sum())


def wavelet_filter(name: str) -> tuple[float, ...]:
    if name in ("haar", "db1"):
        return daubechies(1)
    if name.startswith("db") and name[2:].isdigit() and 1 < int(name[2:]) <= 10:
        return daubechies(int(name[2:]))
    raise ValueError(f"unknown wavelet {name!r}")


def details(x: np.ndarray, wavelet: str) -> list[np.ndarray]:
    """Detail coefficients of each row, finest level first; half-sample symmetric extension at the ends."""
    h = np.array(wavelet_filter(wavelet))
    taps = len(h)
    level = int(np.floor(np.log2(x.shape[1] / (taps - 1)))) if x.shape[1] >= taps - 1 and taps > 1 else 0
    low, high = h[::-1], np.array([(-1) ** (k + 1) * c for k, c in enumerate(h)])
    out = []
    for _ in range(level):
        k = (x.shape[1] + taps - 1) // 2
        wide = np.pad(x, ((0, 0), (taps - 2, taps - 1)), mode="symmetric")
        # A tap is a run of the even or of the odd places: sums of runs, so no place is copied for each tap.
        halves = [np.ascontiguousarray(wide[:, p::2]) for p in (0, 1)]
        del wide
        d, x, term = np.zeros((len(x), k)), np.zeros((len(x), k)), np.empty((len(x), k))
        for j in range(taps):
            first, half = divmod(taps - 1 - j, 2)
            run = halves[half][:, first : first + k]
            d += np.multiply(run, high[j], out=term)
            x += np.multiply(run, low[j], out=term)
        out.append(d)
    return out


def zoomed_dft(x: np.ndarray, first: int, n: int, m: int) -> np.ndarray:
    """Sums of x[t] * exp(-2 pi i j (first + t) / n) for j from 1 to m, by one convolution with a chirp.

    With 2 j t = j^2 + t^2 - (j - t)^2, all m frequencies take the work of three transforms of about len(x) + m
    places. Squares are taken modulo 2 n, so angles stay exact however long the series is.
    """
    size, j = len(x), np.arange(1, m + 1)
    chirp = lambda k: np.exp(-1j * np.pi * ((k * k) % (2 * n)) / n)
    wide = 1 << int(np.ceil(np.log2(size + m)))
    kernel = np.zeros(wide, dtype=complex)
    kernel[: m + size - 1] = np.conj(chirp(np.arange(2 - size, m + 1)))  # j - t from its least on
    z = np.fft.ifft(np.fft.fft(x * chirp(np.arange(size)), wide) * np.fft.fft(kernel))[size - 1 : size - 1 + m]
    return z * chirp(j) * np.exp(-2j * np.pi * ((j * first) % n) / n)


def largest_factor(n: int) -> int:
    """Largest prime factor."""
    p = 2
    while p * p <= n:
        if n % p:
            p += 1
        else:
            n //= p
    return n


def smooth_size(least: int) -> int:
    """Smallest product of powers of 2, 3 and 5 that is not below least."""
    odd = [3**b * 5**c for b in range(least.bit_length()) for c in range(least.bit_length()) if 3**b * 5**c < 2 * least]
    return min(k << max(0, (-(-least // k) - 1).bit_length()) for k in odd)


def half_chirp(x: np.ndarray, m: int) -> np.ndarray:
    """Sums of x[:, t] * exp(-2 pi i j t / n) for j from 1 to m, of real rows of any length n.

    Even and odd places are the parts of one complex series of half the length; its sums at j and -j, by one
    convolution with a chirp as in zoomed_dft, give those of both.
    """
    rows, n = x.shape
    half, k = (n + 1) // 2, np.arange((n + 1) // 2 + m)
    angle = k * k % n * (2 * np.pi / n)
    chirp = np.empty(len(k), dtype=complex)
    chirp.real, chirp.imag = np.cos(angle), -np.sin(angle)
    del angle, k
    wide = smooth_size(half + 2 * m)
    kernel = np.zeros(wide, dtype=complex)  # of j - t from its least on
    np.conj(chirp[::-1], out=kernel[: half + m])
    np.conj(chirp[1 : m + 1], out=kernel[half + m : half + 2 * m])
    z = np.zeros((rows, wide), dtype=complex)
    mean = x.mean(axis=1, keepdims=True)  # adds nothing to these sums but rounding
    np.subtract(x[:, ::2], mean, out=z.real[:, :half])
    np.subtract(x[:, 1::2], mean, out=z.imag[:, : n // 2])
    z[:, :half] *= chirp[:half]
    np.fft.fft(kernel, out=kernel)
    np.fft.fft(z, axis=1, out=z)
    z *= kernel
    del kernel
    np.fft.ifft(z, axis=1, out=z)
    j, turn = np.arange(1, m + 1), chirp[1 : m + 1]
    plus, minus = z[:, half + m : half + 2 * m] * turn, np.conj(z[:, half - 1 : half + m - 1][:, ::-1] * turn)
    # plus = even + i odd, minus = even - i odd
    return ((plus + minus) + (plus - minus) * (-1j * np.exp(-2j * np.pi * j / n))) / 2


#: Powers of the phase inside a run, and the most that it may be there: what is left out is below 1e-16 of a run's sum.
POWERS, PHASE = 12, np.pi / 16


def low_frequencies(x: np.ndarray, m: int) -> np.ndarray:
    """Sums of x[:, t] * exp(-2 pi i j t / n) for j from 1 to m, for m far below n, without a transform of all n places.

    Places are cut into runs so short that the phase moves little inside; there it is a power series about the run's
    middle. So a run is a few moments, and the transform goes over the runs' moments alone.
    """
    rows, n = x.shape
    run = max(1, int(n * PHASE / (np.pi * m)))
    runs = -(-n // run)
    offset = np.arange(run) - (run - 1) / 2
    powers = (offset[:, None] * (2 * np.pi * m / n)) ** np.arange(POWERS)
    whole = n // run * run
    moments = np.zeros((rows, runs, POWERS))
    moments[:, : n // run] = x[:, :whole].reshape(rows, -1, run) @ powers
    moments[:, n // run :] = (x[:, whole:] @ powers[: n - whole])[:, None] if whole < n else 0
    j = np.arange(1, m + 1)
    # exp(-2 pi i j (run c + middle) / n) over runs c, by convolution with a chirp as in zoomed_dft.
    chirp = lambda k: np.exp(-1j * np.pi * ((k * k * run) % (2 * n)) / n)
    wide = 1 << int(np.ceil(np.log2(runs + m)))
    kernel = np.zeros(wide, dtype=complex)
    kernel[: m + runs - 1] = np.conj(chirp(np.arange(2 - runs, m + 1)))
    kernel, start = np.fft.fft(kernel), chirp(np.arange(runs))
    out = np.zeros((rows, m), dtype=complex)
    factor = np.ones(m, dtype=complex)
    for p in range(POWERS):
        out += factor * np.fft.ifft(np.fft.fft(moments[:, :, p] * start, wide, axis=1) * kernel, axis=1)[:, runs - 1 : runs - 1 + m]
        factor = factor * (-1j * j / m) / (p + 1)
    return out * chirp(j) * np.exp(-1j * np.pi * j * (run - 1) / n)
