"""Seeded simulation of long-memory processes, and perturbations of series."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=8)
def noise_factor(h: float, n: int) -> np.ndarray:
    """Lower factor of the covariance of unit fractional Gaussian noise."""
    k = np.arange(n, dtype=float)
    gamma = (np.abs(k + 1) ** (2 * h) - 2 * k ** (2 * h) + np.abs(k - 1) ** (2 * h)) / 2
    at = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])
    return np.linalg.cholesky(gamma[at] + 1e-10 * np.eye(n))


@lru_cache(maxsize=8)
def motion_factor(h: float, n: int) -> np.ndarray:
    t = np.arange(1, n, dtype=float)
    p = t ** (2 * h)
    cov = (p[:, None] + p[None, :] - np.abs(t[:, None] - t[None, :]) ** (2 * h)) / 2
    return np.linalg.cholesky(cov + 1e-10 * np.eye(n - 1))


def need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def fgn(rng: np.random.Generator, H: float, n: int, sigma: float = 1.0) -> np.ndarray:
    need(0 < H < 1 and int(n) >= 2, "fGn needs H in (0, 1) and n >= 2")
    return float(sigma) * (noise_factor(float(H), int(n)) @ rng.standard_normal(int(n)))


def fbm(rng: np.random.Generator, H: float, n: int, sigma: float = 1.0) -> np.ndarray:
    need(0 < H < 1 and int(n) >= 2, "fBm needs H in (0, 1) and n >= 2")
    return np.concatenate([[0.0], float(sigma) * (motion_factor(float(H), int(n)) @ rng.standard_normal(int(n) - 1))])


def arfima(rng: np.random.Generator, d: float, n: int, sigma: float = 1.0, p: int = 0, q: int = 0) -> np.ndarray:
    need(int(p) == 0 and int(q) == 0, "ARFIMA is (0, d, 0)")
    need(abs(d) < 0.5 and int(n) >= 2, "ARFIMA needs |d| < 0.5 and n >= 2")
    n = int(n)
    reach = min(10 * n, 50_000)
    j = np.arange(1, reach + 1, dtype=float)
    psi = np.concatenate([[1.0], np.cumprod((d + j - 1) / j)])
    eps = float(sigma) * rng.standard_normal(n + reach)
    size = 1 << int(np.ceil(np.log2(len(eps) + len(psi))))
    both = np.fft.irfft(np.fft.rfft(eps, size) * np.fft.rfft(psi, size), size)
    return both[reach : reach + n]


def mrw(rng: np.random.Generator, H: float, n: int, sigma: float = 1.0, lambda2: float = 0.02, integral_scale: int | None = None, intermittency: float | None = None) -> np.ndarray:
    n = int(n)
    strength = float(lambda2 if intermittency is None else intermittency)
    need(strength >= 0, "MRW needs lambda2 >= 0")
    base = fgn(rng, H, n, sigma)
    if strength == 0:
        return base
    reach = int(np.clip(max(8, n // 4) if integral_scale is None else int(integral_scale), 2, n))
    kernel = np.arange(1, reach + 1, dtype=float) ** -0.5
    kernel /= np.sqrt((kernel**2).sum())
    field = np.convolve(rng.standard_normal(n + reach - 1), kernel, mode="valid")
    field = (field - field.mean()) / (field.std() + 1e-12)
    return base * np.exp(np.sqrt(strength) * field - strength / 2)


def fou(rng: np.random.Generator, H: float, n: int, theta: float, sigma: float = 1.0, dt: float = 1.0, burnin: int | None = None) -> np.ndarray:
    n = int(n)
    need(theta > 0 and dt > 0, "fOU needs theta > 0 and dt > 0")
    lead = min(max(4 * n, 64), 4096) if burnin is None else int(burnin)
    noise = fgn(rng, H, n + lead, float(sigma) * float(dt) ** float(H))
    a = float(np.exp(-float(theta) * float(dt)))
    x = np.empty(n + lead)
    level = 0.0
    for i, e in enumerate(noise.tolist()):
        level = a * level + e
        x[i] = level
    x = x[lead:]
    return x - x.mean()


#: name -> (function, estimand, parameter that is the truth)
GENERATORS = {
    "fGn": (fgn, "hurst_scaling_proxy", "H"),
    "fBm": (fbm, "hurst_scaling_proxy", "H"),
    "ARFIMA": (arfima, "long_memory_parameter", "d"),
    "MRW": (mrw, "hurst_scaling_proxy", "H"),
    "fOU": (fou, "hurst_scaling_proxy", "H"),
}


def spread(x: np.ndarray) -> float:
    return float(x.std()) + 1e-12


def level_shift(x: np.ndarray, rng: np.random.Generator, shift: float = 1.0, **_: object) -> np.ndarray:
    """The same offset everywhere, in standard deviations."""
    return x + float(shift) * spread(x)


def polynomial_trend(x: np.ndarray, rng: np.random.Generator, order: int = 1, strength: float = 1.0, **_: object) -> np.ndarray:
    t = np.linspace(-1, 1, len(x))
    trend = sum(t**k for k in range(1, int(order) + 1)) if int(order) >= 1 else np.zeros(len(x))
    trend = trend - trend.mean()
    return x + float(strength) * spread(x) * trend / spread(trend)


def outliers(x: np.ndarray, rng: np.random.Generator, rate: float = 0.01, amplitude: float = 5.0, **_: object) -> np.ndarray:
    k = max(1, int(round(float(rate) * len(x))))
    at = rng.choice(len(x), size=min(k, len(x)), replace=False)
    out = x.copy()
    out[at] += rng.choice([-1.0, 1.0], size=len(at)) * float(amplitude) * spread(x)
    return out


def heavy_tail_noise(x: np.ndarray, rng: np.random.Generator, df: float | None = None, scale: float = 0.5, alpha: float | None = None, **_: object) -> np.ndarray:
    noise = rng.standard_t(float(df if df is not None else alpha if alpha is not None else 5.0), len(x))
    return x + float(scale) * spread(x) * noise / spread(noise)


#: name -> (function, family)
CONTAMINATIONS = {
    "level_shift": (level_shift, "level"),
    "polynomial_trend": (polynomial_trend, "trend"),
    "outliers": (outliers, "impulsive"),
    "heavy_tail_noise": (heavy_tail_noise, "heavy_tail"),
}
