"""All thresholds in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    year: int | None = None
    """Analysis year of needs and allocations; None takes all years together."""

    # coverage and need
    overlooked_coverage_pct: float = 40.0
    overlooked_min_severity: int = 3
    coverage_cap: float = 1.5
    coverage_floor: float = 0.01
    money_floor_musd: float = 0.001
    strict_nulls: bool = False
    """False: a null input is skipped by the floors and caps, so null
    received money counts as capped coverage. True: the metric is null."""

    # project efficiency
    outlier_z: float = 1.5
    strong_outlier_z: float = 2.0
    std_floor: float = 0.001
    efficiency_band_pct: float = 10.0

    # pooled funds
    pooled_target_share: float = 0.15
    low_engagement_pct: float = 10.0

    # project groups
    groups: int = 6
    seed: int = 42
    max_iter: int = 50
    tol: float = 1e-4

    # nearest comparables
    neighbours: int = 5
    efficiency_weight: float = 0.5
    coverage_weight: float = 0.3
    budget_weight: float = 5.0
    leaf_rows: int = 1024
    """Most places one search cell may hold before it is split."""
