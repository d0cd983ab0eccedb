"""Group statistics kept as a table and merged with those of new rows.

A state has one row per group: the row count and, per value column, a struct
of the filled count, the sum and the sum of squares as decimals, the least and
the greatest value. Decimals add exactly, so states of parts merge to the very
figures of one run over all rows, in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needscope.functions.numbers import EXACT
from needscope.sources import sinks


def _named(by: Sequence[str], values: Sequence[str]) -> None:
    names = [name.lower() for name in ["n_rows", "batch", *by, *values]]
    if len(set(names)) < len(names):
        raise ValueError(f"n_rows, batch, groups and values need names of their own: {[*by, *values]}")


def group_state(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(by..., n_rows, values...): combined before the shuffle. Null keys are a group."""
    _named(by, values)

    def state(name: str) -> Column:
        value = F.col(name)
        return F.struct(
            F.count(value).alias("n"),
            F.sum(value.cast(EXACT)).alias("total"),
            F.sum((value * value).cast(EXACT)).alias("squares"),
            F.min(value).alias("least"),
            F.max(value).alias("most"),
        ).alias(name)

    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[state(name) for name in values])


def merge_states(states: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One state per group of ``by``, which may be coarser than that of ``states``."""
    _named(by, values)

    def merged(name: str) -> Column:
        added = [F.sum(f"{name}.{part}").alias(part) for part in ("n", "total", "squares")]
        return F.struct(*added, F.min(f"{name}.least").alias("least"), F.max(f"{name}.most").alias("most")).alias(name)

    return states.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), *[merged(name) for name in values])


def update_states(
    df: DataFrame, table: str, batch: str, by: Sequence[str], values: Sequence[str], path: str | None = None
) -> DataFrame:
    """Take the rows of ``batch`` into the saved states and return them merged.

    The table keeps the states of each batch, so a batch that is run again
    replaces its own rows instead of counting twice. Only new rows are read,
    and the old states, whose size is batches times groups. Batches are updated
    one after the other. An empty batch leaves the figures as they are.
    """
    spark = df.sparkSession
    states = group_state(df, by, values).select(F.lit(batch).alias("batch"), "*")
    if spark.catalog.tableExists(table):
        states = spark.table(table).filter(F.col("batch") != batch).unionByName(states)
    sinks.save_table(states, table, path=path)
    return merge_states(spark.table(table), by, values)


def state_avg(name: str) -> Column:
    """The figure that ``exact_avg`` has on the rows behind the state."""
    return F.col(f"{name}.total").cast("double") / F.nullif(F.col(f"{name}.n"), F.lit(0))


def state_stddev(name: str) -> Column:
    """The figure that ``exact_stddev`` has on the rows behind the state."""
    n, total = F.col(f"{name}.n"), F.col(f"{name}.total").cast("double")
    spread = F.col(f"{name}.squares").cast("double") - total * total / F.nullif(n, F.lit(0))
    return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / F.nullif(n - 1, F.lit(0))))


def sector_stats(states: DataFrame, value: str = "ben_per_1000_usd", by: Sequence[str] = ("cluster",)) -> DataFrame:
    """``scoring.sector_stats`` from merged states, for the z-scores of new rows."""
    return states.select(
        *by,
        F.round(state_avg(value), 3).alias("cluster_avg_ben_ratio"),
        F.round(state_stddev(value), 3).alias("cluster_std_ben_ratio"),
    )


def score_bounds(states: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``scoring.score_bounds`` from merged states, for the scores of new rows."""
    return states.select(*by, F.struct(F.col(f"{value}.least").alias("least"), F.col(f"{value}.most").alias("most")).alias("__range"))
