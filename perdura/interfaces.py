"""What a user's own parts of a run must offer. All take and give DataFrames, so they run on Spark like the built-in ones."""

from __future__ import annotations

from abc import ABC, abstractmethod
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from perdura.plans.manifest import LeaderboardSpec, Manifest
    from perdura.plans.runner import Run


class Evaluator(ABC):
    """Metric rows from facts, and aggregates from metric rows."""

    @abstractmethod
    def per_series(self, manifest: Manifest, facts: DataFrame) -> DataFrame:
        """record_id, estimator_name, metric_name, nominal, value, missing_ci, note and stratum."""

    @abstractmethod
    def aggregate(self, manifest: Manifest, series: DataFrame) -> DataFrame:
        """estimator_name, metric_name, nominal, value, stratum and n_strata."""


class LeaderboardBuilder(ABC):
    @abstractmethod
    def build(self, manifest: Manifest, board: LeaderboardSpec, aggregates: DataFrame) -> DataFrame:
        """estimator_name, rank, score and components (map of metric to value)."""


class Reporter(ABC):
    """Renders a run from its report tables, which are small."""

    @abstractmethod
    def render(self, run: Run, tables: dict, folder: Path) -> list[Path]:
        """Writes files below folder and returns them."""


class ResultStore(ABC):
    """Keeps a run's results."""

    @abstractmethod
    def write(self, name: str, df: DataFrame) -> None:
        """One of the run's tables, of any size."""

    @abstractmethod
    def finalise(self) -> str:
        """Called after all tables; where the results are."""
