"""The metrics, as data."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

G, S, O = "ground_truth", "stress_test", "observational"  # noqa: E741
MODES = (G, S, O)


@dataclass(frozen=True)
class MetricSpec:
    name: str
    symbol: str
    requires_truth: bool
    admissible_modes: tuple[str, ...]
    aggregation_rule: str
    optimisation_direction: str
    unit: str | None = None
    null_policy: str = "explicit_null"
    nominal_levels: tuple[float, ...] = ()
    parameters: dict[str, Any] = field(default_factory=dict)


def spec(name: str, symbol: str, truth: bool, modes: tuple[str, ...], direction: str = "minimise", unit: str | None = None, nulls: str | None = None) -> MetricSpec:
    found = MetricSpec(name, symbol, truth, modes, "mean_over_stratum", direction, unit)
    return found if nulls is None else replace(found, null_policy=nulls)


#: Names, symbols, whether truth is needed, admissible modes, direction, unit and null policy of the metrics.
METRICS: dict[str, MetricSpec] = {
    m.name: m
    for m in (
        spec("bias", "bias", True, (G, S)),
        spec("mae", "MAE", True, (G, S)),
        spec("rmse", "RMSE", True, (G, S)),
        spec("coverage", "Cov", True, (G, S), "maximise", "1"),
        spec("coverage_error", "CErr", True, (G, S), unit="1"),
        spec("ci_width", "MW", False, (G, S, O), unit="1"),
        spec("validity_rate", "VR", False, (G, S, O), "maximise", "1"),
        spec("runtime", "RT", False, (G, S, O), unit="s"),
        spec("instability", "Instab", False, (O,)),
        spec("preprocessing_sensitivity", "PSens", False, (O,)),
        spec("estimate_drift", "Drift", False, (S,)),
        spec("relative_degradation_ratio", "RDR", True, (S,), unit="1"),
        spec("validity_collapse", "VCol", False, (S,), unit="1"),
        spec("coverage_collapse", "CCol", True, (S,), unit="1"),
        spec("false_positive_lrd_rate", "FPR", True, (G, S), unit="1", nulls="skip_non_null_truth"),
        spec("cross_estimator_dispersion", "XDisp", False, (G, S, O)),
        spec("pairwise_estimator_disagreement", "PairDis", False, (G, S, O)),
        spec("family_level_disagreement", "FamDis", False, (G, S, O)),
        spec("parameter_variant_sensitivity", "VarSens", False, (G, S, O)),
        spec("max_variant_drift", "MaxVarDrift", False, (G, S, O)),
    )
}
#: Metrics with a value for each nominal level.
LEVELLED = ("coverage", "coverage_error", "ci_width", "coverage_collapse")
DISAGREEMENT = ("cross_estimator_dispersion", "pairwise_estimator_disagreement", "family_level_disagreement")
SENSITIVITY = ("parameter_variant_sensitivity", "max_variant_drift")
STRESS = ("estimate_drift", "relative_degradation_ratio", "validity_collapse", "coverage_collapse")


def metric(entry: str | dict[str, Any]) -> MetricSpec:
    """A metric of a manifest: a name, or a mapping with name, levels and parameters."""
    given = {"name": entry} if isinstance(entry, str) else dict(entry)
    name = str(given.pop("name"))
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}")
    levels = given.pop("levels", None)
    chosen = tuple(float(a) for a in levels) if levels is not None else (0.95,) if name in LEVELLED else ()
    return replace(METRICS[name], nominal_levels=chosen, parameters=given)
