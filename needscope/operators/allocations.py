"""Pooled-fund allocations with the need context of their entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needscope.functions.numbers import count_where, exact_sum

# Need columns that an allocation carries.
CONTEXT = (
    "overlook_score", "coverage_rate_pct", "funding_gap_musd",
    "people_in_need_millions", "funding_category",
)


def enrich_allocations(
    allocations: DataFrame, funding: DataFrame, keys: Sequence[str] = ("iso3", "year")
) -> DataFrame:
    """Left join on entity and year; allocations of unknown entities stay.

    Both sides grow with the data, so neither is forced to be broadcast. The
    preserved left side may be skewed: adaptive execution splits it. A key
    that ``funding`` holds twice would repeat its allocations, so the job fails
    where an allocation meets one.
    """
    once = funding.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.first(name).alias(name) for name in CONTEXT])
    named = F.concat_ws(" ", F.lit("several funding rows for"), *keys)
    joined = allocations.join(once, list(keys), "left")
    return joined.withColumns(
        {name: F.when(F.col("__n") > 1, F.raise_error(named)).otherwise(F.col(name)) for name in CONTEXT}
    ).drop("__n")


def allocations_by(allocations: DataFrame, by: str = "country") -> DataFrame:
    totals = allocations.groupBy(by).agg(
        F.round(exact_sum(F.col("allocation_musd")), 2).alias("total_cbpf_musd"),
        F.count("cluster").alias("num_clusters_funded"),
    )
    return totals.orderBy(F.desc("total_cbpf_musd"), by)


def allocation_mismatch_count(allocations: DataFrame) -> DataFrame:
    """Allocations labelled as too little for an overlooked entity."""
    return allocations.agg(
        count_where(F.col("cbpf_mismatch_type").contains("Overlooked")).alias("n_mismatched")
    )
