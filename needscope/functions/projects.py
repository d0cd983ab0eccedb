"""Per-project columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needscope.config import Config
from needscope.functions import labels
from needscope.functions.funding import add_levels
from needscope.functions.numbers import ratio


def project_code(iso3: Column, cluster: Column, number: Column) -> Column:
    """``ISO-CLU-0001``; the number is padded to four digits and never cut."""
    return F.format_string("%s-%s-%04d", iso3, F.upper(F.substring(cluster, 1, 3)), number)


def beneficiaries_per_1000(beneficiaries: Column, budget: Column) -> Column:
    return F.round(ratio(beneficiaries, budget / 1000), 3)


def project_coverage_pct(received: Column, budget: Column) -> Column:
    return F.round(ratio(received, budget) * 100, 1)


def budget_per_beneficiary_usd(cfg: Config) -> Column:
    return F.round(F.col("budget_usd") / F.greatest(F.col("target_beneficiaries"), F.lit(1)), 2)


def project_funding_gap_usd(cfg: Config) -> Column:
    return F.greatest(F.col("budget_usd") - F.col("funding_received_usd"), F.lit(0).cast("bigint"))


def ben_per_1000_usd(cfg: Config) -> Column:
    computed = beneficiaries_per_1000(F.col("target_beneficiaries"), F.col("budget_usd"))
    return F.coalesce(F.col("beneficiaries_per_1000_usd"), computed)


def funding_gap_flag(cfg: Config) -> Column:
    return labels.label_below(
        F.col("funding_coverage_pct"), labels.PROJECT_FUNDING, labels.PROJECT_FUNDING_ELSE
    )


def ben_ratio_zscore(cfg: Config) -> Column:
    spread = F.greatest(F.col("cluster_std_ben_ratio"), F.lit(cfg.std_floor))
    return F.round((F.col("ben_per_1000_usd") - F.col("cluster_avg_ben_ratio")) / spread, 3)


def is_efficiency_outlier(cfg: Config) -> Column:
    return F.abs("ben_ratio_zscore") > cfg.outlier_z


def outlier_classification(cfg: Config) -> Column:
    z = F.col("ben_ratio_zscore")
    return labels.label_where(
        [
            (z > cfg.strong_outlier_z, labels.OUTLIER_STRONG_HIGH),
            (z > cfg.outlier_z, labels.OUTLIER_HIGH),
            (z < -cfg.strong_outlier_z, labels.OUTLIER_STRONG_LOW),
            (z < -cfg.outlier_z, labels.OUTLIER_LOW),
        ],
        labels.OUTLIER_NONE,
    )


PROJECT_LEVELS = (
    (budget_per_beneficiary_usd, project_funding_gap_usd, ben_per_1000_usd, funding_gap_flag),
)
OUTLIER_LEVELS = (
    (ben_ratio_zscore,),
    (is_efficiency_outlier, outlier_classification),
)


def add_project_metrics(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    return add_levels(df, cfg, PROJECT_LEVELS)


def add_outlier_columns(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Needs ``ben_per_1000_usd`` and the sector mean and deviation columns."""
    return add_levels(df, cfg, OUTLIER_LEVELS)


def efficiency_vs_cluster(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Percent distance from the sector mean, with a verdict."""
    mean = F.col("cluster_avg_ben_ratio")
    diff = ratio(F.col("ben_per_1000_usd") - mean, mean) * 100
    verdict = (
        F.when(F.col("efficiency_diff_pct") > cfg.efficiency_band_pct, "MORE efficient")
        .when(F.col("efficiency_diff_pct") < -cfg.efficiency_band_pct, "LESS efficient")
        .when(F.col("efficiency_diff_pct").isNotNull(), "within normal range")
    )
    return df.withColumn("efficiency_diff_pct", diff).withColumn("efficiency_verdict", verdict)
