"""Reports on projects far from their sector mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needscope.functions.numbers import count_where, ratio


def outlier_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_projects"),
        count_where(F.col("is_efficiency_outlier")).alias("n_outliers"),
    )
    share = ratio(F.col("n_outliers") * 100.0, F.col("n_projects"))
    return counted.withColumn("outlier_pct", F.round(share, 1))


def _by_distance(df: DataFrame, n: int | None) -> DataFrame:
    """Farthest from the mean first; the project code settles ties."""
    ordered = df.orderBy(F.abs("ben_ratio_zscore").desc(), "project_code")
    return ordered if n is None else ordered.limit(n)


def outlier_report(df: DataFrame, n: int | None = None) -> DataFrame:
    return _by_distance(df.filter("is_efficiency_outlier"), n).select(
        "project_code",
        "country",
        "cluster",
        F.round(F.col("budget_usd") / 1_000_000, 2).alias("budget_musd"),
        "target_beneficiaries",
        F.round("ben_per_1000_usd", 1).alias("efficiency"),
        F.round("cluster_avg_ben_ratio", 1).alias("cluster_avg_efficiency"),
        F.round("ben_ratio_zscore", 2).alias("z_score"),
        F.col("outlier_classification").alias("finding"),
        F.round("funding_coverage_pct", 1).alias("coverage_pct"),
    )


def outlier_direction_split(df: DataFrame) -> DataFrame:
    flagged = F.col("is_efficiency_outlier")
    counts = df.agg(
        count_where(flagged).alias("total_outliers"),
        count_where(flagged & (F.col("ben_ratio_zscore") > 0)).alias("high_efficiency"),
    )
    return counts.withColumn("low_efficiency", F.col("total_outliers") - F.col("high_efficiency"))
