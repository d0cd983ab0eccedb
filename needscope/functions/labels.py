"""Label texts and their thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label texts and cut points of the result contract.
FUNDING_CATEGORY = (
    (100, "Fully Funded (≥100%)"),
    (70, "Mostly Funded (70–99%)"),
    (40, "Partially Funded (40–69%)"),
    (20, "Critically Underfunded (20–39%)"),
)
FUNDING_CATEGORY_ELSE = "Severely Underfunded (<20%)"

ATTENTION_PRIORITY = (
    (3, "🔴 CRITICAL — Immediate attention required"),
    (7, "🟠 HIGH — Significant funding gap"),
    (12, "🟡 MEDIUM — Monitor closely"),
)
ATTENTION_PRIORITY_ELSE = "🟢 LOW — Relatively well funded"

POOLED_ADEQUACY = (
    (5, "🔴 No Pooled Fund Engagement"),
    (15, "🟠 Minimal Pooled Fund Support"),
    (30, "🟡 Some Pooled Fund Support"),
)
POOLED_ADEQUACY_ELSE = "✅ Adequate Pooled Fund Support"

PROJECT_FUNDING = (
    (30, "Critically Underfunded Project"),
    (60, "Underfunded Project"),
    (90, "Mostly Funded Project"),
)
PROJECT_FUNDING_ELSE = "Fully Funded Project"

OUTLIER_STRONG_HIGH = "🟢 Highly Efficient — Investigate for scale-up"
OUTLIER_HIGH = "🟡 Above Average Efficiency — Monitor"
OUTLIER_STRONG_LOW = "🔴 Very Low Efficiency — Investigate bottleneck"
OUTLIER_LOW = "🟠 Below Average Efficiency — Review methodology"
OUTLIER_NONE = "✅ Within Normal Range"

POOLED_TOO_LITTLE = "🔴 Overlooked Crisis — UNDERFUNDED by Pooled Funds"
POOLED_TOO_MUCH = "⚠️  Well-Funded Crisis — Receiving Pooled Funds"
POOLED_REASONABLE = "✅ Reasonable Allocation"

GROUP_LABELS = (
    "Group A: Small-Budget, High-Efficiency Projects",
    "Group B: Small-Budget, Low-Efficiency Projects",
    "Group C: Medium-Budget, Mixed Efficiency",
    "Group D: Large-Budget, High-Reach Projects",
    "Group E: Large-Budget, Specialist Projects",
    "Group F: Extra-Large or Logistics Projects",
)
# End of fixed values.

Steps = Sequence[tuple[float, str]]


def label_where(tests: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """Text of the first test that holds; a null test does not."""
    (test, text), *more = tests
    chain = F.when(test, text)
    for test, text in more:
        chain = chain.when(test, text)
    return chain.otherwise(otherwise)


def label_at_least(value: Column, steps: Steps, otherwise: str) -> Column:
    """First step whose cut point the value reaches; null gets the last label."""
    return label_where([(value >= cut, text) for cut, text in steps], otherwise)


def label_below(value: Column, steps: Steps, otherwise: str) -> Column:
    """First step whose cut point the value stays under; null gets the last label."""
    return label_where([(value < cut, text) for cut, text in steps], otherwise)


def label_at_most(value: Column, steps: Steps, otherwise: str) -> Column:
    return label_where([(value <= cut, text) for cut, text in steps], otherwise)
