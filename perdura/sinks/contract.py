"""The contract of a run's files: which there are, and the columns that they must have (fixed values)."""

from __future__ import annotations

import csv
from pathlib import Path

VERSION = "1.0.0"
METRIC = ["estimator_name", "metric_name", "value", "stratum_json", "metadata_json"]
SCOPED = ["scope", "record_id", *METRIC]
ARTEFACTS = ["artefact_id", "run_id", "artefact_type", "format", "path", "hash", "created_at", "depends_on_json"]
#: Required files with their columns; None where a file has no header.
REQUIRED: dict[str, list[str] | None] = {
    "tables/run_summary.csv": ["run_id", "manifest_id", "benchmark_name", "mode"],
    "tables/per_stratum_metrics.csv": METRIC,
    "tables/leaderboard.csv": ["estimator_name", "rank", "score"],
    "tables/estimator_metadata.csv": ["estimator_name", "family", "target_estimand", "supports_ci", "supports_diagnostics", "assumptions_json", "params_json", "version"],
    "tables/failures.csv": ["estimator_name", "stratum_json", "n_metric_rows", "n_missing_values", "n_missing_uncertainty", "n_validity_observations", "n_invalid_estimates", "invalid_rate", "missing_value_rate"],
    "tables/failure_map.csv": ["estimator_name", "stratum_json"],
    "tables/uncertainty_calibration.csv": ["estimator_name", "metric_name", "value", "nominal"],
    "tables/benchmark_uncertainty.csv": ["estimator_name", "metric_name", "value", "uncertainty_type", "aggregation", "nominal", "ci_low", "ci_high", "stratum_json", "metadata_json"],
    "tables/estimator_disagreement.csv": SCOPED,
    "tables/scale_window_sensitivity.csv": SCOPED,
    "html/report.html": None,
    "manifest/environment.json": None,
    "artefacts/artefact_index.csv": ARTEFACTS,
    "raw/records.csv": ["record_id", "source_type", "source_name", "n", "values_path", "truth_family", "target_estimand", "target_value", "annotations_json"],
    "raw/estimates.csv": ["record_id", "estimator_name", "point", "ci_low", "ci_high", "stderr", "valid", "runtime_seconds", "failure_reason", "warnings", "bootstrap_cis_json"],
    "raw/metrics.csv": SCOPED,
    "raw/artefacts.csv": ARTEFACTS,
}
#: Checked only if they are there.
OPTIONAL: dict[str, list[str]] = {
    "tables/stress_metrics.csv": ["record_id", "estimator_name", "metric_name", "value", "stratum_json", "contamination_operator", "clean_record_id", "nominal"],
    "raw/leaderboards.csv": ["estimator_name", "rank", "score", "components_json"],
}


def header(path: Path) -> list[str]:
    with path.open(newline="", encoding="utf-8") as f:
        return next(csv.reader(f), [])


def validate_output(root: str | Path) -> list[str]:
    """What a run's folder lacks."""
    root, errors = Path(root), []
    for name, columns in (REQUIRED | OPTIONAL).items():
        path = root / name
        if not path.is_file():
            if name in REQUIRED:
                errors.append(f"missing required file: {name}")
            continue
        if columns is None:
            continue
        try:
            got = header(path)
        except (UnicodeDecodeError, csv.Error) as e:
            errors.append(f"unreadable CSV file: {name} ({e})")
            continue
        if not got:
            errors.append(f"missing CSV header: {name}")
        elif lost := [c for c in columns if c not in got]:
            errors.append(f"missing columns in {name}: {', '.join(lost)}")
    return errors
