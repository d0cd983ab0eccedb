"""Columns of the pooled-fund allocation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needscope.config import Config
from needscope.functions import labels
from needscope.functions.funding import MILLION, add_levels


def allocation_musd(kusd: Column) -> Column:
    return kusd / 1000


def cbpf_per_person_in_need_usd(cfg: Config) -> Column:
    people = F.greatest(F.col("people_in_need_millions") * MILLION, F.lit(1.0))
    return F.round(F.col("allocation_musd") * MILLION / people, 2)


def allocated_to_overlooked_crisis(cfg: Config) -> Column:
    return F.coalesce(F.col("coverage_rate_pct") < cfg.overlooked_coverage_pct, F.lit(False))


def cbpf_mismatch_type(cfg: Config) -> Column:
    score, amount = F.col("overlook_score"), F.col("allocation_musd")
    return labels.label_where(
        [
            ((score > 60) & (amount < 20), labels.POOLED_TOO_LITTLE),
            ((score < 30) & (amount > 30), labels.POOLED_TOO_MUCH),
        ],
        labels.POOLED_REASONABLE,
    )


ALLOCATION_LEVELS = (
    (cbpf_per_person_in_need_usd, allocated_to_overlooked_crisis, cbpf_mismatch_type),
)


def add_allocation_metrics(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    return add_levels(df, cfg, ALLOCATION_LEVELS)
