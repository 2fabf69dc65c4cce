"""Column expressions shared by the plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, digits) + F.lit(0.0)).alias("rounded")


def clipped(c: Column, low: float, high: float) -> Column:
    """Within bounds; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def reason(valid: Column, tag: str) -> Column:
    return F.when(~valid, F.lit(f"insufficient_signal_for_{tag}"))


def failure_class(reason_: Column) -> Column:
    """The class of a failure reason; also for none, invalid_fit."""
    return F.when(reason_.startswith("insufficient_signal_for_"), "insufficient_signal").when(reason_.startswith("exception:"), "estimator_exception").when(reason_.startswith("missing_uncertainty"), "missing_uncertainty").otherwise("invalid_fit")


def severity_label(params: Column) -> Column:
    """k=v pairs of a string map in order of keys, parted by ';'; 'default' without any."""
    pairs = F.transform(F.sort_array(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.element_at(params, "severity").isNotNull(), F.element_at(params, "severity")).when(F.size(params) == 0, "default").otherwise(F.array_join(pairs, ";"))
