"""Numpy kernels against direct formulas and known values."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perdura.kernels import estimators as K
from perdura.kernels import numeric, resample, simulate

RNG = np.random.default_rng(5)
X = RNG.standard_normal((3, 512)).cumsum(axis=1) * 0.1 + RNG.standard_normal((3, 512))


def test_rescaled_range_and_guards():
    x = X[0]
    y = np.cumsum(x - x.mean())
    assert K.rescaled_range(X)[0] == pytest.approx(np.log((y.max() - y.min()) / x.std()) / np.log(512))
    assert np.isnan(K.rescaled_range(np.zeros((1, 100))))[0] and np.isnan(K.rescaled_range(X[:, :15])).all()


@pytest.mark.parametrize("order", [0, 1, 2])
def test_dfa_by_polynomial_fits(order):
    y, n = np.cumsum(X[1] - X[1].mean()), 512
    xs, ys = [], []
    for s in K.scale_grid(16, n, None):
        rss = 0.0
        for a in range(n // s):
            seg, t = y[a * s : (a + 1) * s], np.arange(s)
            rss += ((seg - np.polyval(np.polyfit(t, seg, order), t)) ** 2).sum()
        xs.append(np.log(s))
        ys.append(np.log(np.sqrt(rss / (n // s * s))))
    assert K.dfa(X, order)[1] == pytest.approx(np.clip(np.polyfit(xs, ys, 1)[0], K.LOW, K.HIGH))


def test_dma_by_convolution():
    y = np.cumsum(X[2] - X[2].mean())
    grid = K.scale_grid(8, 512, None)
    f = [np.sqrt(((y[w - 1 :] - np.convolve(y, np.ones(w) / w, "valid")) ** 2).mean()) for w in grid]
    assert K.dma(X)[2] == pytest.approx(np.clip(np.polyfit(np.log(grid), np.log(f), 1)[0], K.LOW, K.HIGH))


def test_higuchi_by_loops():
    x, n = X[0], 512
    length = []
    for k in range(1, 65):
        one = []
        for m in range(k):
            terms = (n - m - 1) // k
            one.append(sum(abs(x[m + i * k] - x[m + (i - 1) * k]) for i in range(1, terms + 1)) * (n - 1) / (terms * k))
        length.append(np.mean(one))
    assert K.higuchi_slope(X)[0] == pytest.approx(np.polyfit(-np.log(np.arange(1, 65)), np.log(length), 1)[0])


def test_white_noise_and_flat_slopes():
    noise = RNG.standard_normal((8, 2048))
    assert abs(K.gph(noise).mean()) < 0.15 and abs(K.whittle(noise).mean()) < 0.05 and abs(K.local_whittle(noise).mean()) < 0.1
    assert (K.ghe(noise) == 0.5).all()
    assert np.isnan(K.local_whittle(noise[:, :255])).all() and np.isnan(K.ghe(noise[:, :127])).all()


def test_brent_finds_the_minima_of_many_functions_at_once():
    c = np.array([-0.3, 0.0, 0.41, -0.49, 0.6])
    seen = []

    def f(v, rows):
        seen.append(len(rows))
        return (v - c[rows]) ** 2 + 0.1 * (v - c[rows]) ** 4

    at, ok = numeric.minimise(f, len(c), -0.49, 0.49)
    assert ok.all() and at == pytest.approx(np.clip(c, -0.49, 0.49), abs=1e-4) and seen[0] == 5 and seen[-1] < 5
    for i in range(len(c)):  # each as by itself
        assert numeric.minimise(lambda v, _, i=i: (v - c[i]) ** 2 + 0.1 * (v - c[i]) ** 4, 1, -0.49, 0.49)[0][0] == at[i]
    at, ok = numeric.minimise(lambda v, _: np.cos(v), 1, 0.0, 6.0)
    assert ok.all() and at == pytest.approx([np.pi], abs=1e-4)
    assert len(numeric.minimise(f, 0, 0.0, 1.0)[0]) == 0
    assert not numeric.minimise(lambda v, _: np.cos(v), 1, 0.0, 6.0, most=3)[1].any()


@pytest.mark.parametrize("order", [1, 2, 4])
def test_daubechies_filters(order):
    h = np.array(numeric.daubechies(order))
    assert h.sum() == pytest.approx(np.sqrt(2)) and (h**2).sum() == pytest.approx(1)
    for k in range(1, order):
        assert (h[2 * k :] * h[: -2 * k]).sum() == pytest.approx(0, abs=1e-9)
    if order == 2:  # known values
        assert h == pytest.approx([0.48296291, 0.8365163, 0.22414387, -0.12940952], abs=1e-7)


def test_details_have_the_usual_lengths_and_kill_constants():
    d = numeric.details(np.ones((1, 200)), "db4")
    assert [c.shape[1] for c in d] == [103, 55, 31, 19] and all(np.abs(c).max() < 1e-9 for c in d)
    haar = numeric.details(np.array([[1.0, 3.0, 2.0, 2.0]]), "haar")
    assert np.abs(haar[0][0]) == pytest.approx([np.sqrt(2), 0])


def test_wavelet_estimates_are_bounded():
    for f in (K.wavelet_abry_veitch, K.wavelet_bardet, K.wavelet_ols, K.wavelet_jensen, K.wavelet_whittle):
        got = f(X, wavelet="db2")
        assert ((got >= K.LOW) & (got <= K.HIGH)).all()
    assert np.isnan(K.wavelet_jensen(X[:, :200])).all()


def test_percentile_intervals():
    assert resample.percentile_intervals(np.arange(101.0), (0.95,))[0] == pytest.approx((0.95, 2.5, 97.5))
    got = resample.percentile_intervals(np.arange(11.0), (0.8, 1, 0.5, 0.8, -0.1))
    assert [pytest.approx(x) for x in got] == [(0.5, 2.5, 7.5), (0.8, 1.0, 9.0)]


def test_replicates_are_blocks_of_one_stream():
    x, rng = np.arange(50.0), np.random.default_rng(4)
    got = np.concatenate(list(resample.replicates(x, 7, 8, 4)))
    for row in got:
        want = np.concatenate([(rng.integers(0, 50) + np.arange(8)) % 50 for _ in range(7)])[:50]
        assert (row == want).all()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=64, max_size=200), st.floats(0.1, 10))
def test_scale_free(values, scale):
    x = np.array([values])
    for k in (K.rescaled_range, K.dfa, K.dma):
        a, b = k(x)[0], k(x * scale)[0]
        assert (np.isnan(a) and np.isnan(b)) or a == pytest.approx(b, abs=1e-5) or x.std() < 1e-6


def test_perturbations():
    x, rng = np.linspace(-2, 2, 64), np.random.default_rng(0)
    assert simulate.level_shift(x, rng, 0.75) - x == pytest.approx(np.full(64, 0.75 * x.std()))
    y = RNG.standard_normal(100)
    assert (simulate.outliers(y, np.random.default_rng(1), 0.07, 4.0) != y).sum() == 7
    trend = simulate.polynomial_trend(y, rng, 2, 0.8) - y
    t = np.linspace(-1, 1, 100)
    assert abs(trend.mean()) < 1e-12 and np.corrcoef(trend, t + t**2)[0, 1] > 0.99
    noise = simulate.heavy_tail_noise(y, np.random.default_rng(2), 5.0, 0.5) - y
    assert noise.std() == pytest.approx(0.5 * y.std(), rel=0.1)


def test_processes_are_seeded_and_scale():
    for name, params in (("fGn", {"H": 0.8, "n": 256}), ("fBm", {"H": 0.6, "n": 64}), ("ARFIMA", {"d": 0.3, "n": 128}), ("MRW", {"H": 0.6, "n": 128}), ("fOU", {"H": 0.7, "n": 64, "theta": 0.5, "burnin": 64})):
        f = simulate.GENERATORS[name][0]
        a, b = (f(np.random.default_rng(3), **params) for _ in range(2))
        assert len(a) == params["n"] and (a == b).all() and np.isfinite(a).all()
    with pytest.raises(ValueError):
        simulate.arfima(np.random.default_rng(0), 0.6, 64)


def test_arfima_equals_direct_convolution():
    n, d = 40, 0.3
    rng = np.random.default_rng(9)
    eps = rng.standard_normal(n + 10 * n)
    j = np.arange(1, 10 * n + 1)
    psi = np.concatenate([[1], np.cumprod((d + j - 1) / j)])
    assert simulate.arfima(np.random.default_rng(9), d, n) == pytest.approx(np.convolve(eps, psi, "valid")[:n])


@pytest.mark.parametrize("h", [0.4, 0.7])
def test_long_memory_is_seen(h):
    x = np.stack([simulate.fgn(np.random.default_rng(i), h, 1024) for i in range(6)])
    assert abs(K.dfa(x, 1, 8, 128).mean() - h) < 0.12


def test_bootstrap_of_groups_in_one_and_in_many_blocks(spark):
    """Intervals of means near those of the normal law, whatever the blocks; a group of one value has no width."""
    from perdura.operators.uncertainty import bootstrap

    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, 4000)
    rows = [("A", "mae", "s", 0.5, f"r{i}", float(v)) for i, v in enumerate(x)] + [("A", "rmse", "s", None, f"r{i}", float(v * v)) for i, v in enumerate(x)] + [("B", "mae", "s", None, "r0", 7.0)]
    df = spark.createDataFrame(rows, "estimator_name string, metric_name string, stratum string, nominal double, ord string, value double")
    for block_rows in (1_000_000, 300):
        got = {(r.estimator_name, r.metric_name, r.ci_level): r for r in bootstrap(df, 400, (0.8, 0.95), 1, block_rows=block_rows).collect()}
        assert len(got) == 6
        for level, z in ((0.8, 1.2816), (0.95, 1.96)):
            r, half = got["A", "mae", level], z * x.std() / np.sqrt(len(x))
            assert r.n == 4000 and r.value == pytest.approx(x.mean()) and r.ci_low == pytest.approx(x.mean() - half, abs=half / 4) and r.ci_high == pytest.approx(x.mean() + half, abs=half / 4)
            assert got["A", "rmse", level].value == pytest.approx(np.sqrt((x**2).mean())) and got["A", "rmse", level].ci_low < got["A", "rmse", level].value < got["A", "rmse", level].ci_high
            assert (got["B", "mae", level].ci_low, got["B", "mae", level].ci_high, got["B", "mae", level].n) == (7.0, 7.0, 1)


@pytest.mark.parametrize("n", [1, 7, 100, 3000])
def test_ranges_of_replicates_are_those_of_the_whole_stream(n, monkeypatch):
    x = RNG.standard_normal(n)
    whole = np.concatenate(list(resample.replicates(x, 23, 8, 4)))
    for values in (1, 5 * n, 4_000_000):
        monkeypatch.setattr(resample, "BLOCK_VALUES", values)
        parts = [np.concatenate(list(resample.replicates(x, 23, 8, 4, a, 10))) for a in (0, 10, 20)]
        assert (np.concatenate(parts) == whole).all() and [len(p) for p in parts] == [10, 10, 3]


def test_an_estimate_from_ranges_is_the_estimate():
    from perdura.operators.estimate import combined, fit_one, fit_range

    kernel, params, x = K.KERNELS["GPH"], {"n_bootstrap": 23, "ci_levels": [0.5, 0.95]}, RNG.standard_normal(400)
    whole = fit_one(kernel, params, x, 5, 1e-3)
    parts = combined([fit_range(kernel, params, x, 5, 1e-3, a, 10) for a in (0, 10, 20)], params)
    drop = lambda d: {k: v for k, v in d.items() if k != "runtime_seconds"}
    assert drop(whole) == drop(parts) and parts["bootstrap_used"] == 23 and parts["point_alt"] is not None
    few = combined([fit_range(kernel, params, x[:10], 5, None, a, 10) for a in (0, 10, 20)], params)
    assert few["failure_reason"] == "insufficient_signal_for_gph" and few["bootstrap_used"] == 0
