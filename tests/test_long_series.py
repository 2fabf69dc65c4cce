"""Kernels on long series: the same values as the plain ways, with less time and memory."""

import tracemalloc

import numpy as np
import pytest

from perdura.kernels import estimators as K
from perdura.kernels import numeric, resample


def walk(n, rows=2):
    rng = np.random.default_rng(5)
    return rng.standard_normal((rows, n)).cumsum(axis=1) * 0.1 + rng.standard_normal((rows, n)) + 50


@pytest.mark.parametrize("n", [70_001, 65_536, 99_990])
def test_few_frequencies_need_no_whole_transform(monkeypatch, n):
    x, m = walk(n), int(n**0.5)
    want = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)[:, 1 : m + 1]) ** 2 / n
    monkeypatch.setattr(np.fft, "rfft", None)
    assert np.allclose(K.periodogram(x, m)[1], want, rtol=1e-9)


def test_wide_boxes_come_from_running_sums(monkeypatch):
    n = 70_001
    series = {"walk": walk(n, 1)[0], "twice summed": np.random.default_rng(6).standard_normal(n).cumsum().cumsum(), "ramp": np.arange(n) * 1.0}
    for name, x in series.items():
        y = (x - x.mean()).cumsum()
        for s in (256, 1001, 17_500):
            for order in (0, 1):
                q = np.linalg.qr(np.vander(np.linspace(-1, 1, s), order + 1))[0]
                boxes = y[: n // s * s].reshape(-1, s)
                got = K.box_residuals(*K.running_moments(y), n, s, order)
                if np.isfinite(got):
                    assert got == pytest.approx(((boxes - boxes @ q @ q.T) ** 2).mean(), rel=1e-6), (name, s, order)
    fast = K.dfa(walk(n))
    monkeypatch.setattr(K, "WIDE", 1 << 60)
    assert fast == pytest.approx(K.dfa(walk(n)), abs=1e-10)


@pytest.mark.parametrize(("n", "block"), [(5003, 500), (5003, 5003), (1000, 256)])
def test_replicates_of_long_blocks_are_runs(monkeypatch, n, block):
    x = np.random.default_rng(2).standard_normal(n)
    runs = np.concatenate(list(resample.replicates(x, 9, block, 7, 2, 5)))
    monkeypatch.setattr(resample, "RUN", 1 << 60)
    assert np.array_equal(runs, np.concatenate(list(resample.replicates(x, 9, block, 7, 2, 5))))


@pytest.mark.parametrize("call", [lambda x: numeric.details(x, "db4"), K.dfa, lambda x: list(resample.replicates(x[0], 1, x.shape[1] // 10, 7))])
def test_memory_is_a_few_times_a_series(call):
    x = walk(1 << 19, 1)
    call(x)
    tracemalloc.start()
    call(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 7 * x.nbytes


def test_a_block_of_replicates_is_one_where_a_series_is_long():
    x = np.random.default_rng(3).standard_normal(1_200_000)
    assert [len(r) for r in resample.replicates(x, 3, 120_000, 7)] == [1, 1, 1]


@pytest.mark.parametrize("n", [70_001, 2 * 33_791, 3 * 23_333])
def test_lengths_of_large_prime_factors_need_no_whole_transform(monkeypatch, n):
    x = walk(n)
    assert numeric.largest_factor(n) > K.ROUGH and numeric.largest_factor(numeric.smooth_size(n)) <= 5 and n <= numeric.smooth_size(n) < 1.1 * n
    for m in (n // 8, n // 2):
        want = np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)[:, 1 : m + 1]
        assert np.allclose(numeric.half_chirp(x - x.mean(axis=1, keepdims=True), m), want, rtol=1e-8, atol=1e-12 * np.abs(want).max())
    plain = K.periodogram(x, n // 8)[1], K.whittle(x)
    monkeypatch.setattr(K, "half_chirp", lambda z, m: np.fft.rfft(z, axis=1)[:, 1 : m + 1])
    assert np.allclose(plain[0], K.periodogram(x, n // 8)[1], rtol=1e-8) and plain[1] == pytest.approx(K.whittle(x), abs=1e-8)


@pytest.mark.parametrize("span", [130, 1000, 1 << 20])
def test_lags_and_windows_are_taken_in_pieces(monkeypatch, span):
    x, n = np.random.default_rng(5).standard_normal((3, 5003)) * [[1], [5], [0.2]] + walk(5003, 3), 5003
    monkeypatch.setattr(K, "SPAN", span)
    y = (x - x.mean(axis=1, keepdims=True)).cumsum(axis=1)
    grid = K.scale_grid(8, n, None)
    sums = np.pad(y.cumsum(axis=1), ((0, 0), (1, 0)))
    f = np.stack([((y[:, w - 1 :] - (sums[:, w:] - sums[:, :-w]) / w) ** 2).mean(axis=1) for w in grid], axis=1)
    assert K.dma(x) == pytest.approx(np.clip(numeric.slopes(np.log(grid), np.log(f) / 2, 3), K.LOW, K.HIGH), abs=1e-9)
    lags = K.lag_grid(n)
    v = np.stack([(x[:, h:] - x[:, :-h]).var(axis=1) for h in lags], axis=1)
    assert K.ghe(x, flat_slope_tol=0) == pytest.approx(numeric.slopes(np.log(lags), np.log(v), 4) / 2, abs=1e-9)
    length = [[np.mean([np.abs(np.diff(row[r::k])).sum() / ((n - 1 - r) // k) for r in range(k)]) * (n - 1) / k for k in range(1, 65)] for row in x]
    assert K.higuchi_slope(x) == pytest.approx(numeric.slopes(-np.log(np.arange(1, 65)), np.log(length), 4), abs=1e-9)
    assert (K.ghe(np.tile(np.arange(300.0), (2, 1))) == 0.5).all()
