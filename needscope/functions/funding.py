"""Per-entity need and funding metrics.

A metric may read rounded results of an earlier level, so ``FUNDING_LEVELS``
lists them by dependency and each level is one projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needscope.config import Config
from needscope.functions import labels

MILLION = 1_000_000


def _nullable(value: Column, cfg: Config, *inputs: str) -> Column:
    """In strict mode a null input makes the metric null."""
    if not cfg.strict_nulls:
        return value
    known = F.lit(True)
    for name in inputs:
        known = known & F.col(name).isNotNull()
    return F.when(known, value)


def _percent_of(part: Column, whole: Column, cfg: Config) -> Column:
    return F.round(part / F.greatest(whole, F.lit(cfg.money_floor_musd)) * 100, 2)


def funding_gap_musd(cfg: Config) -> Column:
    """Asked minus received; negative when over-funded."""
    return F.round(F.col("required_funding_musd") - F.col("funding_received_musd"), 2)


def coverage_rate(cfg: Config) -> Column:
    asked = F.greatest(F.col("required_funding_musd"), F.lit(cfg.money_floor_musd))
    share = F.least(F.col("funding_received_musd") / asked, F.lit(cfg.coverage_cap))
    return _nullable(F.round(share, 4), cfg, "required_funding_musd", "funding_received_musd")


def coverage_rate_pct(cfg: Config) -> Column:
    return F.round(F.col("coverage_rate") * 100, 1)


def funding_per_person_in_need_usd(cfg: Config) -> Column:
    people = F.greatest(F.col("people_in_need_millions") * MILLION, F.lit(1.0))
    dollars = F.col("funding_received_musd") * MILLION
    return _nullable(F.round(dollars / people, 2), cfg, "people_in_need_millions")


def need_score(cfg: Config) -> Column:
    level = F.col("severity")
    return F.round(F.col("people_in_need_millions") * (level * level), 3)


def overlook_score_raw(cfg: Config) -> Column:
    covered = F.greatest(F.col("coverage_rate"), F.lit(cfg.coverage_floor))
    return _nullable(F.round(F.col("need_score") / covered, 4), cfg, "coverage_rate")


def cbpf_need_coverage_pct(cfg: Config) -> Column:
    value = _percent_of(F.col("cbpf_allocation_musd"), F.col("required_funding_musd"), cfg)
    return _nullable(value, cfg, "required_funding_musd")


def cbpf_gap_coverage_pct(cfg: Config) -> Column:
    gap = F.col("required_funding_musd") - F.col("funding_received_musd")
    value = _percent_of(F.col("cbpf_allocation_musd"), gap, cfg)
    return _nullable(value, cfg, "required_funding_musd", "funding_received_musd")


def is_overlooked(cfg: Config) -> Column:
    thin = F.col("coverage_rate_pct") < cfg.overlooked_coverage_pct
    severe = F.col("severity") >= cfg.overlooked_min_severity
    return F.coalesce(thin & severe, F.lit(False))


def funding_category(cfg: Config) -> Column:
    return labels.label_at_least(
        F.col("coverage_rate_pct"), labels.FUNDING_CATEGORY, labels.FUNDING_CATEGORY_ELSE
    )


def estimated_unfunded_people_millions(cfg: Config) -> Column:
    missing = F.greatest(1 - F.col("coverage_rate"), F.lit(0.0))
    value = F.round(F.col("people_in_need_millions") * missing, 2)
    return _nullable(value, cfg, "coverage_rate")


Builder = Callable[[Config], Column]

FUNDING_LEVELS: tuple[tuple[Builder, ...], ...] = (
    (
        funding_gap_musd, coverage_rate, funding_per_person_in_need_usd,
        need_score, cbpf_need_coverage_pct, cbpf_gap_coverage_pct,
    ),
    (coverage_rate_pct, overlook_score_raw, estimated_unfunded_people_millions),
    (is_overlooked, funding_category),
)


def add_levels(df: DataFrame, cfg: Config, levels: tuple[tuple[Builder, ...], ...]) -> DataFrame:
    for level in levels:
        df = df.withColumns({build.__name__: build(cfg) for build in level})
    return df


def add_funding_metrics(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    return add_levels(df, cfg, FUNDING_LEVELS)


# ---- columns of the ranking and pooled-fund tables ----

def attention_priority(cfg: Config) -> Column:
    return labels.label_at_most(
        F.col("global_overlook_rank"), labels.ATTENTION_PRIORITY, labels.ATTENTION_PRIORITY_ELSE
    )


def cbpf_adequacy(cfg: Config) -> Column:
    return labels.label_below(
        F.col("cbpf_gap_coverage_pct"), labels.POOLED_ADEQUACY, labels.POOLED_ADEQUACY_ELSE
    )


def key_insight(cfg: Config) -> Column:
    """One sentence; ``concat_ws`` leaves null parts out."""
    # The wording of the sentence.
    return F.concat_ws(
        " ",
        F.col("country"),
        F.lit("has"),
        F.round("people_in_need_millions", 1).cast("string"),
        F.lit("million people in need but only"),
        F.col("coverage_rate_pct").cast("string"),
        F.lit("% funded —"),
        F.round("estimated_unfunded_people_millions", 1).cast("string"),
        F.lit("million people without adequate support."),
    )
    # End of fixed values.


def mismatch_score(cfg: Config) -> Column:
    engaged = F.least(F.col("cbpf_gap_coverage_pct") / 100, F.lit(1.0))
    return F.round(F.col("overlook_score") * (1 - engaged), 2)


def recommended_additional_cbpf_musd(cfg: Config) -> Column:
    target = F.col("funding_gap_musd") * cfg.pooled_target_share
    return F.round(F.greatest(target - F.col("cbpf_allocation_musd"), F.lit(0.0)), 1)
