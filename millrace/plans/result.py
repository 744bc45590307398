"""What a step returns, and how it fails."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

HARD_STOP, SOFT_FAIL, WARN = "hard_stop", "soft_fail", "warn"


class HardStop(ValueError):
    """The step can't be taken; the table stays as it is."""


@dataclass
class StepResult:
    df: DataFrame
    quarantine: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)
    failure: str | None = None
    error: str | None = None
