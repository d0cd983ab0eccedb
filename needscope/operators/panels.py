"""Dashboard tables over the ranking, rollup and project tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needscope.functions.numbers import count_where, exact_avg
from needscope.operators.rollups import key_figures, top_n


def _rounded(name: str, places: int, alias: str | None = None):
    return F.round(name, places).alias(alias or name)


def panel_kpis(ranked: DataFrame) -> DataFrame:
    return key_figures(ranked).select(
        _rounded("total_people_in_need_millions", 0),
        "num_crises",
        _rounded("avg_coverage_pct", 1),
        "overlooked_crises",
        _rounded("total_gap_musd", 0),
    )


def panel_top15(ranked: DataFrame, n: int = 15) -> DataFrame:
    return top_n(ranked, [F.col("global_overlook_rank")], n, "iso3").select(
        "global_overlook_rank", "country", "region", "primary_cluster",
        _rounded("people_in_need_millions", 1),
        _rounded("required_funding_musd", 0),
        _rounded("funding_received_musd", 0),
        _rounded("funding_gap_musd", 0),
        "coverage_rate_pct",
        _rounded("cbpf_allocation_musd", 1),
        _rounded("overlook_score", 1),
        "attention_priority", "severity",
    )


def panel_regional(regional: DataFrame) -> DataFrame:
    return regional.select(
        "region", "num_crises",
        _rounded("total_people_in_need_M", 0),
        _rounded("total_required_MUSD", 0),
        _rounded("total_received_MUSD", 0),
        _rounded("total_gap_MUSD", 0),
        "avg_coverage_pct",
        _rounded("gap_per_person_in_need_usd", 2),
        "overlooked_crisis_count",
    ).orderBy("avg_coverage_pct", "region")


def panel_cluster(cluster: DataFrame) -> DataFrame:
    return cluster.select(
        "cluster", "num_crises",
        _rounded("total_pin_millions", 1),
        "avg_coverage_pct",
        _rounded("total_gap_musd", 0),
        "avg_cbpf_coverage_pct",
        _rounded("avg_overlook_score", 1),
    ).orderBy(F.desc("avg_overlook_score"), "cluster")


def panel_mismatch(mismatches: DataFrame, n: int = 15) -> DataFrame:
    positive = mismatches.filter("mismatch_score > 0")
    return top_n(positive, [F.desc("mismatch_score")], n, "iso3").select(
        "country", "global_overlook_rank",
        _rounded("overlook_score", 1),
        "coverage_rate_pct",
        _rounded("funding_gap_musd", 0),
        _rounded("country_cbpf_total_musd", 1),
        _rounded("cbpf_gap_coverage_pct", 1),
        "cbpf_adequacy",
        _rounded("mismatch_score", 1),
        _rounded("recommended_additional_cbpf_musd", 1),
        "attention_priority",
    )


def panel_outliers(projects: DataFrame, n: int = 20) -> DataFrame:
    flagged = projects.filter("is_efficiency_outlier")
    return top_n(flagged, [F.abs("ben_ratio_zscore").desc()], n, "project_code").select(
        "project_code", "country", "cluster", "organization",
        F.round(F.col("budget_usd") / 1_000_000, 2).alias("budget_musd"),
        "target_beneficiaries",
        _rounded("ben_per_1000_usd", 1),
        _rounded("cluster_avg_ben_ratio", 1),
        _rounded("ben_ratio_zscore", 2),
        "outlier_classification",
        _rounded("funding_coverage_pct", 1),
    )


def panel_groups(benchmarks: DataFrame) -> DataFrame:
    groups = benchmarks.groupBy("benchmark_label").agg(
        F.count(F.lit(1)).alias("num_projects"),
        F.round(exact_avg(F.col("budget_usd")) / 1_000_000, 2).alias("avg_budget_musd"),
        F.round(exact_avg(F.col("target_beneficiaries")), 0).alias("avg_beneficiaries"),
        F.round(exact_avg(F.col("ben_per_1000_usd")), 1).alias("avg_efficiency"),
        F.round(exact_avg(F.col("funding_coverage_pct")), 1).alias("avg_coverage_pct"),
        count_where(F.col("is_efficiency_outlier")).alias("outlier_projects"),
    )
    return groups.orderBy("avg_budget_musd", "benchmark_label")


def panel_watch_list(ranked: DataFrame) -> DataFrame:
    severe = ranked.filter(F.col("severity") == 4)
    return severe.orderBy(F.desc("overlook_score"), "iso3").select(
        "global_overlook_rank", "country",
        _rounded("people_in_need_millions", 1),
        _rounded("estimated_unfunded_people_millions", 1),
        "coverage_rate_pct",
        _rounded("funding_gap_musd", 0),
        _rounded("funding_per_person_in_need_usd", 0),
        "cbpf_adequacy", "key_insight",
    )
