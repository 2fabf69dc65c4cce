"""Estimator specs and the registries that plugins extend."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from perdura.kernels.estimators import KERNELS, Kernel
from perdura.kernels.simulate import CONTAMINATIONS, GENERATORS


@dataclass(frozen=True)
class EstimatorSpec:
    name: str
    family: str = "unknown"
    target_estimand: str = ""
    assumptions: tuple[str, ...] = ()
    supports_ci: bool = False
    supports_diagnostics: bool = False
    params: dict[str, Any] = field(default_factory=dict)
    version: str | None = None
    base: str = ""
    variant: str | None = None

    def __post_init__(self) -> None:
        if not self.base:
            object.__setattr__(self, "base", self.name)


def kernel_of(name: str, plugins: dict[str, Kernel] | None = None) -> Kernel:
    found = (plugins or {}).get(name) or KERNELS.get(name)
    if found is None:
        raise KeyError(f"unknown estimator {name!r}; known: {sorted({*KERNELS, *(plugins or {})})}")
    return found


class Registry:
    """Names of one kind of operator, built-in and added."""

    def __init__(self, builtin: dict[str, Any]):
        self.entries = dict(builtin)

    def register(self, name: str, entry: Any) -> None:
        self.entries[name] = entry

    def get(self, name: str) -> Any:
        if name not in self.entries:
            raise KeyError(f"unknown name {name!r}; known: {self.list()}")
        return self.entries[name]

    def list(self) -> list[str]:
        return sorted(self.entries)


def estimator_registry() -> Registry:
    return Registry(KERNELS)


def generator_registry() -> Registry:
    return Registry(GENERATORS)


def contamination_registry() -> Registry:
    return Registry(CONTAMINATIONS)


def estimator(tag: str, *parameters: str, seed_offset: int = 0) -> Callable[[Callable[..., np.ndarray]], Kernel]:
    """Decorator that makes a plugin of a function from a matrix of series to one value per row."""
    return lambda f: Kernel(f, tag, seed_offset, parameters)
