"""Rankings, regional and sector rollups, mismatch table and key figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needscope.config import Config
from needscope.functions import funding
from needscope.functions.numbers import count_where, exact_avg, exact_sum, ratio
from needscope.operators.scoring import rank_within

# Column order of the ranking and mismatch tables.
RANKING_COLUMNS = (
    "global_overlook_rank", "regional_overlook_rank", "country", "iso3", "region",
    "primary_cluster", "latitude", "longitude", "year", "severity",
    "people_in_need_millions", "population_millions", "required_funding_musd",
    "funding_received_musd", "cbpf_allocation_musd", "funding_gap_musd",
    "coverage_rate_pct", "cbpf_need_coverage_pct", "cbpf_gap_coverage_pct",
    "funding_per_person_in_need_usd", "need_score", "overlook_score",
    "estimated_unfunded_people_millions", "is_overlooked", "funding_category",
    "attention_priority", "cbpf_adequacy", "key_insight",
)
MISMATCH_COLUMNS = (
    "country", "iso3", "region", "global_overlook_rank", "overlook_score",
    "coverage_rate_pct", "funding_gap_musd", "country_cbpf_total_musd",
    "cbpf_gap_coverage_pct", "cbpf_adequacy", "people_in_need_millions",
    "severity", "attention_priority", "mismatch_score",
    "recommended_additional_cbpf_musd",
)


def rankings(silver: DataFrame, cfg: Config = Config(), regional_ranks: DataFrame | None = None) -> DataFrame:
    """Ranking table; the global rank comes with the scored input."""
    ranked = rank_within(silver, ["region"], "overlook_score", "regional_overlook_rank", regional_ranks)
    levels = ((funding.attention_priority, funding.cbpf_adequacy, funding.key_insight),)
    return funding.add_levels(ranked, cfg, levels).select(*RANKING_COLUMNS)


def top_n(df: DataFrame, order: Sequence[Column], n: int, tie: str) -> DataFrame:
    """First ``n`` rows; ``tie`` makes the choice repeatable."""
    return df.orderBy(*order, F.col(tie)).limit(n)


def by_rank(df: DataFrame) -> DataFrame:
    """Sorted by rank; the key splits a rank shared by very many rows."""
    return df.orderBy("global_overlook_rank", "iso3")


def regional_summary(df: DataFrame) -> DataFrame:
    gap, need = F.col("funding_gap_musd"), F.col("people_in_need_millions")
    return df.groupBy("region").agg(
        F.count(F.lit(1)).alias("num_crises"),
        F.round(exact_sum(need), 1).alias("total_people_in_need_M"),
        F.round(exact_sum(F.col("required_funding_musd")), 0).alias("total_required_MUSD"),
        F.round(exact_sum(F.col("funding_received_musd")), 0).alias("total_received_MUSD"),
        F.round(exact_sum(gap), 0).alias("total_gap_MUSD"),
        F.round(exact_avg(F.col("coverage_rate_pct")), 1).alias("avg_coverage_pct"),
        F.round(F.min("coverage_rate_pct"), 1).alias("min_coverage_pct"),
        F.round(exact_sum(F.col("cbpf_allocation_musd")), 1).alias("total_cbpf_MUSD"),
        F.round(exact_avg(F.col("overlook_score")), 1).alias("avg_overlook_score"),
        F.round(ratio(exact_sum(gap), exact_sum(need)), 2).alias("gap_per_person_in_need_usd"),
        count_where(F.col("is_overlooked")).alias("overlooked_crisis_count"),
    )


def cluster_summary(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("primary_cluster").alias("cluster")).agg(
        F.count(F.lit(1)).alias("num_crises"),
        F.round(exact_sum(F.col("people_in_need_millions")), 1).alias("total_pin_millions"),
        F.round(exact_avg(F.col("coverage_rate_pct")), 1).alias("avg_coverage_pct"),
        F.round(exact_sum(F.col("funding_gap_musd")), 0).alias("total_gap_musd"),
        F.round(exact_avg(F.col("cbpf_need_coverage_pct")), 1).alias("avg_cbpf_coverage_pct"),
        F.round(exact_avg(F.col("overlook_score")), 1).alias("avg_overlook_score"),
        F.round(exact_sum(F.col("cbpf_allocation_musd")), 1).alias("total_cbpf_musd"),
        count_where(F.col("is_overlooked")).alias("overlooked_count"),
    )


def mismatch(ranked: DataFrame, cfg: Config = Config()) -> DataFrame:
    scored = funding.add_levels(
        ranked, cfg, ((funding.mismatch_score, funding.recommended_additional_cbpf_musd),)
    )
    return scored.withColumnRenamed("cbpf_allocation_musd", "country_cbpf_total_musd").select(*MISMATCH_COLUMNS)


def _first_place(rank: str, *fields: str) -> Column:
    """The row of rank 1 as a struct; ties go to the smallest key."""
    return F.min_by(F.struct(*fields), F.struct(rank, "iso3"))


def key_figures(df: DataFrame) -> DataFrame:
    """Totals shown as counters, from one aggregate."""
    gap = F.col("funding_gap_musd")
    return df.agg(
        exact_sum(F.col("people_in_need_millions")).alias("total_people_in_need_millions"),
        F.count(F.lit(1)).alias("num_crises"),
        exact_avg(F.col("coverage_rate_pct")).alias("avg_coverage_pct"),
        count_where(F.col("is_overlooked")).alias("overlooked_crises"),
        F.coalesce(exact_sum(F.when(gap > 0, gap)), F.lit(0.0)).alias("total_gap_musd"),
        _first_place(
            "global_overlook_rank", "country", "people_in_need_millions", "coverage_rate_pct"
        ).alias("__top"),
    )


def executive_summary(ranked: DataFrame, projects: DataFrame) -> DataFrame:
    """One row of headline numbers; each table is read once."""
    outliers = projects.agg(count_where(F.col("is_efficiency_outlier")).alias("n"))
    return key_figures(ranked).select(
        F.round("total_people_in_need_millions", 0).alias("total_people_in_need_millions"),
        "num_crises",
        F.round("total_gap_musd", 0).alias("total_gap_musd"),
        F.round("avg_coverage_pct", 1).alias("avg_coverage_pct"),
        "overlooked_crises",
        F.col("__top.country").alias("top_country"),
        F.round("__top.people_in_need_millions", 1).alias("top_people_in_need_millions"),
        F.round("__top.coverage_rate_pct", 1).alias("top_coverage_pct"),
        outliers.scalar().alias("outlier_projects"),
    )


def top_findings(ranked: DataFrame, cfg: Config = Config(), n: int = 3) -> DataFrame:
    """The most overlooked entities with the flag for thin pooled funding."""
    barely = F.coalesce(F.col("cbpf_gap_coverage_pct") < cfg.low_engagement_pct, F.lit(False))
    return top_n(ranked, [F.col("global_overlook_rank")], n, "iso3").select(
        "global_overlook_rank", "country", "region", "people_in_need_millions", "severity",
        "coverage_rate_pct", "funding_received_musd", "required_funding_musd",
        F.greatest(F.col("funding_gap_musd"), F.lit(0.0)).alias("funding_gap_musd"),
        "estimated_unfunded_people_millions", "cbpf_gap_coverage_pct",
        F.when(barely, F.lit("⚠️ Pooled funds barely engaged")).otherwise("").alias("pooled_note"),
    )


def low_engagement(mismatches: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Entities below the engagement limit and the most misallocated one."""
    order = F.struct((-F.col("mismatch_score")).alias("score"), F.col("iso3"))
    worst = F.min_by("country", F.when(F.col("mismatch_score").isNotNull(), order))
    return mismatches.agg(
        count_where(F.col("cbpf_gap_coverage_pct") < cfg.low_engagement_pct).alias("n_low_engagement"),
        worst.alias("most_misallocated"),
    )
