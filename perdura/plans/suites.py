"""The packaged suites. Grids, parameters, metrics and weights are fixed values."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from perdura.plans.manifest import Manifest, load_manifest, manifest_of

HURST, MEMORY = "hurst_scaling_proxy", "long_memory_parameter"
BASIC = ["validity_rate", "runtime", "cross_estimator_dispersion", "pairwise_estimator_disagreement"]
CALIBRATION = [{"name": n, "levels": [0.95]} for n in ("coverage", "ci_width", "coverage_error")]
ACCURACY = ["bias", "mae", "rmse"]
STRESS = ["bias", "mae", "estimate_drift", "relative_degradation_ratio"]
SENSITIVITY = ["parameter_variant_sensitivity", "max_variant_drift"]


def estimator(name: str, family: str, estimand: str = HURST, variants: dict[str, dict] | None = None, **params: Any) -> dict[str, Any]:
    out: dict[str, Any] = {"name": name, "family": family, "target_estimand": estimand, "supports_ci": "n_bootstrap" in params, "params": params}
    return out | ({"variants": [{"name": k, "params": v} for k, v in variants.items()]} if variants else {})


def boot(n: int) -> dict[str, Any]:
    return {"n_bootstrap": n, "bootstrap_block_len": 32, "ci_levels": [0.95]}


def fgn(h: list[float], n: list[int], replicates: int) -> dict[str, Any]:
    return {"family": "fGn", "params": {"H": h, "n": n, "sigma": [1.0]}, "replicates": replicates}


def arfima(d: list[float], n: list[int], replicates: int) -> dict[str, Any]:
    return {"family": "ARFIMA", "params": {"d": d, "n": n, "sigma": [1.0]}, "replicates": replicates}


def operator(name: str, **params: list) -> dict[str, Any]:
    return {"name": name, "params": params}


def suite(name: str, mode: str, source: Any, estimators: list, metrics: list, weights: dict[str, float] | None = None, uncertainty: dict | None = None, contamination: list | None = None) -> dict[str, Any]:
    out: dict[str, Any] = {"manifest_id": f"{name}_v1", "name": name, "mode": mode, "source": source if isinstance(source, dict) else {"type": "generator_grid", "generators": source}, "estimators": estimators, "metrics": metrics}
    if weights:
        out["leaderboards"] = [{"name": f"{name}_board", "mode": mode, "component_metrics": list(weights), "weights": weights}]
    if uncertainty:
        out["uncertainty"] = {"enabled": True, "ci_levels": [0.95]} | uncertainty
    if contamination:
        out["contamination"] = {"operators": contamination}
    return out


def bands(*names: str, middle: bool) -> list[dict[str, Any]]:
    """DFA, DMA and wavelet variants of the sensitivity suites."""
    far = 256 if middle else 160
    scales = {"short": (8, 96), **({"balanced": (12, 160)} if middle else {}), "long": (16, far)}
    of = lambda what: {f"{k}_{what}": {"min_scale": a, "max_scale": b} for k, (a, b) in scales.items()}
    wave = {"broad_band": {"wavelet": "db2", "j_drop_low": 1, "j_drop_high": 1}, "upper_band": {"wavelet": "db2", "j_drop_low": 2, "j_drop_high": 1}}
    if middle:
        wave["conservative_band"] = {"wavelet": "db4", "j_drop_low": 1, "j_drop_high": 2}
    return [estimator("DFA", "time_domain", variants=of("scales"), detrend_order=1), estimator("DMA", "time_domain", variants=of("windows")), estimator("WaveletOLS", "wavelet", variants=wave)]


RS = lambda n: estimator("RS", "time_domain", **boot(n))
GPH = lambda n: estimator("GPH", "spectral", MEMORY, **boot(n))
DFA = lambda top: estimator("DFA", "time_domain", min_scale=8, max_scale=top, detrend_order=1)
DMA = lambda top: estimator("DMA", "time_domain", min_scale=8, max_scale=top)
WAVE = estimator("WaveletOLS", "wavelet", wavelet="db2", j_drop_low=1, j_drop_high=1)
CANONICAL = {"mae": 0.45, "coverage_error": 0.2, "validity_rate": 0.25, "runtime": 0.1}
ROBUST = {"mae": 0.35, "estimate_drift": 0.35, "validity_rate": 0.2, "runtime": 0.1}
NULL = {"false_positive_lrd_rate": 0.6, "validity_rate": 0.3, "runtime": 0.1}
SENSITIVE = {"mae": 0.6, "validity_rate": 0.25, "runtime": 0.15}
COLLAPSE = [{"name": "coverage_collapse", "levels": [0.95]}]
DRIFTS = ["mae", "estimate_drift", "relative_degradation_ratio", "validity_rate"]
PERIODOGRAM = estimator("Periodogram", "spectral", MEMORY, m_power=0.5)

SUITES: dict[str, dict[str, Any]] = {
    s["name"]: s
    for s in (
        suite("smoke_ground_truth", "ground_truth", [fgn([0.5], [128], 1)], [estimator("RS", "time_domain", n_bootstrap=48, bootstrap_block_len=12)], [*ACCURACY, *CALIBRATION, "validity_rate"], {"mae": 1.0}),
        suite("smoke_stress_test", "stress_test", [fgn([0.5], [128], 1)], [estimator("RS", "time_domain", n_bootstrap=48, bootstrap_block_len=12)], ["mae", "estimate_drift", "validity_rate"], {"mae": 1.0}, contamination=[operator("level_shift", shift=[0.25])]),
        suite("smoke_observational", "observational", {"type": "inline_table", "series": [{"values": [float(i % 7 - 3) for i in range(128)]}]}, [estimator("RS", "time_domain", n_bootstrap=48, bootstrap_block_len=12)], ["validity_rate", "instability", "preprocessing_sensitivity"], {"validity_rate": 1.0}),
        suite("benchmark_rs_gph", "ground_truth", [fgn([0.4, 0.5, 0.6], [512], 2), arfima([0.25, 0.4], [512], 2)], [RS(96), GPH(96)], [*ACCURACY, *CALIBRATION, "validity_rate"], {"mae": 1.0}),
        suite("small_canonical", "ground_truth", [fgn([0.4, 0.6, 0.8], [512], 2)], [RS(48), DFA(128), DMA(128)], [*ACCURACY, *BASIC, *CALIBRATION], CANONICAL, {"n_bootstrap": 100, "seed": 20260426, "metrics": ["mae", "validity_rate"]}),
        suite("small_stress", "stress_test", [fgn([0.5, 0.7], [512], 2)], [RS(32), DFA(128), DMA(128)], [*STRESS, *BASIC, *CALIBRATION, *COLLAPSE], ROBUST, {"n_bootstrap": 100, "seed": 20260427, "metrics": DRIFTS}, [operator("level_shift", shift=[0.75]), operator("outliers", rate=[0.02, 0.05], amplitude=[4.0]), operator("polynomial_trend", order=[1, 2], strength=[0.5])]),
        suite("small_null", "ground_truth", [fgn([0.5], [512], 5), arfima([0.0], [512], 5)], [RS(32), GPH(32), PERIODOGRAM], [*ACCURACY, "false_positive_lrd_rate", *BASIC, *CALIBRATION], NULL, {"n_bootstrap": 100, "seed": 20260428, "metrics": ["false_positive_lrd_rate", "validity_rate"]}),
        suite("small_sensitivity", "ground_truth", [fgn([0.5, 0.7], [512], 2)], bands(middle=False), [*ACCURACY, *BASIC, *SENSITIVITY], SENSITIVE, {"n_bootstrap": 100, "seed": 20260429, "metrics": ["mae", *SENSITIVITY]}),
        suite("medium_canonical", "ground_truth", [fgn([0.35, 0.5, 0.65, 0.8], [512, 1024], 3)], [RS(64), DFA(256), DMA(256), estimator("GHE", "geometric", n_scales=18), WAVE], [*ACCURACY, *BASIC, *CALIBRATION], CANONICAL, {"n_bootstrap": 200, "seed": 20260430, "metrics": ["mae", "validity_rate"], "paired": True, "paired_metrics": ["mae"]}),
        suite("medium_stress", "stress_test", [fgn([0.5, 0.7], [512, 1024], 3)], [RS(48), DFA(256), DMA(256), WAVE], [*STRESS, *BASIC, *CALIBRATION, *COLLAPSE], ROBUST, {"n_bootstrap": 200, "seed": 20260501, "metrics": DRIFTS}, [operator("level_shift", shift=[0.75]), operator("outliers", rate=[0.01, 0.05], amplitude=[4.0, 8.0]), operator("polynomial_trend", order=[1, 2], strength=[0.5, 1.0]), operator("heavy_tail_noise", df=[3.0, 5.0], scale=[0.5, 1.0])]),
        suite("medium_null", "ground_truth", [fgn([0.5], [512, 1024], 12), arfima([0.0], [512, 1024], 12)], [RS(48), GPH(48), PERIODOGRAM, estimator("ModifiedLocalWhittle", "spectral", MEMORY)], [*ACCURACY, "false_positive_lrd_rate", *BASIC, *CALIBRATION], NULL, {"n_bootstrap": 200, "seed": 20260502, "metrics": ["false_positive_lrd_rate", "validity_rate"]}),
        suite("medium_sensitivity", "ground_truth", [fgn([0.4, 0.6, 0.8], [512, 1024], 3)], bands(middle=True), [*ACCURACY, *BASIC, *SENSITIVITY], SENSITIVE, {"n_bootstrap": 200, "seed": 20260503, "metrics": ["mae", *SENSITIVITY]}),
    )
}


def list_suites() -> list[str]:
    return sorted(SUITES)


def resolve(name: str | Path) -> Manifest:
    """A manifest file's, or a packaged suite's by name."""
    if Path(name).is_file():
        return load_manifest(name)
    if str(name) in SUITES:
        return manifest_of(SUITES[str(name)])
    raise FileNotFoundError(f"no manifest file or packaged suite {str(name)!r}; suites: {', '.join(list_suites())}")
