"""Plot-ready rows; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needscope.config import Config
from needscope.functions.numbers import count_where
from needscope.operators.rollups import top_n
from needscope.operators.scoring import join_null_safe


def _band(value: Column, high: float, low: float) -> Column:
    return F.when(value > high, "high").when(value > low, "medium").otherwise("low")


def _positive_gap() -> Column:
    return F.greatest(F.col("funding_gap_musd"), F.lit(0.0))


def chart_map_points(ranked: DataFrame) -> DataFrame:
    score = F.coalesce(F.col("overlook_score"), F.lit(50.0))
    covered = F.col("coverage_rate_pct")
    coverage_band = F.when(covered < 40, "low").when(covered < 70, "medium").otherwise("high")
    return ranked.select(
        "country", "iso3", "latitude", "longitude",
        score.alias("score"),
        _band(score, 60, 30).alias("score_band"),
        coverage_band.alias("coverage_band"),
        F.coalesce(F.col("global_overlook_rank") <= 5, F.lit(False)).alias("is_labelled"),
        _positive_gap().alias("gap_musd"),
        F.least(covered, F.lit(100.0)).alias("coverage_bar_pct"),
    )


def chart_bubble(ranked: DataFrame) -> DataFrame:
    covered, need = F.col("coverage_rate_pct"), F.col("people_in_need_millions")
    quadrant = (
        F.when((need >= 10) & (covered < 50), "OVERLOOKED")
        .when((need >= 10) & (covered >= 50), "VISIBLE")
        .when((need < 10) & (covered >= 50), "STABLE")
        .when((need < 10) & (covered < 50), "AT RISK")
    )
    return ranked.select(
        "country", "iso3", "coverage_rate_pct", "people_in_need_millions",
        ((_positive_gap() + 100) * 1.2).alias("bubble_size"),
        F.when(F.col("severity").isin(2, 3, 4), F.col("severity")).alias("severity_class"),
        quadrant.alias("quadrant"),
        F.coalesce(F.col("global_overlook_rank") <= 10, F.lit(False)).alias("is_labelled"),
    )


def chart_gap_bars(ranked: DataFrame, n: int = 12) -> DataFrame:
    bars = top_n(ranked, [F.desc_nulls_last("funding_gap_musd")], n, "iso3")
    return bars.select(
        "country", "iso3", "required_funding_musd", "funding_received_musd",
        "cbpf_allocation_musd", "coverage_rate_pct", "funding_category",
        _positive_gap().alias("gap_musd"),
    ).orderBy("gap_musd", "iso3")


def chart_pooled_scatter(mismatches: DataFrame) -> DataFrame:
    return mismatches.select(
        "country", "iso3", "overlook_score", "country_cbpf_total_musd",
        (F.col("people_in_need_millions") * 8).alias("marker_size"),
        "coverage_rate_pct",
    )


def chart_pooled_bars(mismatches: DataFrame, cfg: Config = Config(), n: int = 12) -> DataFrame:
    covered = F.col("cbpf_gap_coverage_pct")
    return top_n(mismatches, [F.desc_nulls_last("mismatch_score")], n, "iso3").select(
        "country", "iso3", "mismatch_score", "cbpf_gap_coverage_pct",
        _band(covered, 40, 20).alias("coverage_band"),
        (covered < cfg.pooled_target_share * 100).alias("is_below_target"),
    )


def _normal(projects: DataFrame) -> DataFrame:
    return projects.filter(~F.col("is_efficiency_outlier")).select("cluster", "ben_per_1000_usd")


def efficiency_ranges(projects: DataFrame) -> DataFrame:
    """Least and greatest efficiency of the normal projects of each sector."""
    value = F.col("ben_per_1000_usd")
    ranges = _normal(projects).groupBy("cluster").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    # a single value gets a bin range of width one around it
    flat = F.col("lo") == F.col("hi")
    return ranges.select(
        "cluster",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )


def chart_efficiency_hist(projects: DataFrame, bins: int = 12, ranges: DataFrame | None = None) -> DataFrame:
    """Equal-width bins of the normal projects of each sector, empty ones too.

    Each row finds its bin from the sector range, so only one count per
    sector and bin is shuffled. Pass written ``efficiency_ranges`` where the
    data is large: they are used twice, and the planner then sees their size.
    """
    normal, value = _normal(projects), F.col("ben_per_1000_usd")
    ranges = efficiency_ranges(projects) if ranges is None else ranges
    position = F.floor((value - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    filled = (
        join_null_safe(normal, ranges, ["cluster"])
        .select("cluster", F.least(position, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("cluster", "bin")
        .agg(F.count(F.lit(1)).alias("n_projects"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    grid = ranges.select("cluster", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return join_null_safe(grid, filled, ["cluster", "bin"], "left").select(
        "cluster", "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_from"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_to"),
        F.coalesce("n_projects", F.lit(0).cast("bigint")).alias("n_projects"),
    )


def chart_efficiency_limits(projects: DataFrame, cfg: Config = Config()) -> DataFrame:
    flagged = F.col("is_efficiency_outlier")
    mean, reach = F.col("mean_efficiency"), F.col("__std") * cfg.outlier_z
    per_sector = projects.groupBy("cluster").agg(
        count_where(~flagged).alias("n_normal"),
        count_where(flagged).alias("n_outliers"),
        F.max("cluster_avg_ben_ratio").alias("mean_efficiency"),
        F.max("cluster_std_ben_ratio").alias("__std"),
    )
    return per_sector.select(
        "cluster", "n_normal", "n_outliers", "mean_efficiency",
        (mean + reach).alias("upper_limit"),
        F.when(reach.isNotNull(), F.greatest(mean - reach, F.lit(0.0))).alias("lower_limit"),
    )


def chart_outlier_marks(projects: DataFrame) -> DataFrame:
    side = F.when(F.col("ben_ratio_zscore") > 0, "high").otherwise("low")
    return projects.filter("is_efficiency_outlier").select(
        "cluster", "project_code", "ben_per_1000_usd", side.alias("direction")
    )
