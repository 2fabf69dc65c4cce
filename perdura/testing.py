"""Helpers for authors of estimators: a spec, one fit without Spark, and what to expect of it."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from perdura.kernels.estimators import Kernel
from perdura.operators.estimate import fit_one
from perdura.plans.registry import EstimatorSpec


def estimator_spec(name: str = "CandidateEstimator", **given: Any) -> EstimatorSpec:
    """A spec with the fields that a test does not care about filled in."""
    return EstimatorSpec(name, **{"family": "external", "target_estimand": "hurst_scaling_proxy", "supports_diagnostics": True, **given})


def fit(kernel: Kernel, values: Sequence[float], seed: int | None = 0, **params: Any) -> dict[str, Any]:
    """One estimate of one series, as a run would make it; few bootstrap replicates unless asked for more."""
    import numpy as np

    return fit_one(kernel, {"n_bootstrap": 8, **params}, np.asarray(values, dtype=float), seed, None)


def assert_valid(result: dict[str, Any], low: float | None = None, high: float | None = None) -> None:
    assert result["valid"], result["failure_reason"]
    assert result["point"] is not None
    assert low is None or result["point"] >= low, (result["point"], low)
    assert high is None or result["point"] <= high, (result["point"], high)


def assert_invalid(result: dict[str, Any], reason: str | None = None) -> None:
    assert not result["valid"] and result["point"] is None
    assert result["failure_reason"] is not None
    assert reason is None or reason in result["failure_reason"], result["failure_reason"]


def smoke_fit(kernel: Kernel, values: Sequence[float], low: float | None = None, high: float | None = None, **params: Any) -> dict[str, Any]:
    """fit() that must be valid and, if given, between low and high."""
    result = fit(kernel, values, **params)
    assert_valid(result, low, high)
    return result
