"""Normalised scores, ranks and sector z-scores without single-task steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from needscope.config import Config
from needscope.functions.numbers import EXACT, exact_avg, exact_stddev
from needscope.functions.projects import add_outlier_columns


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the right key columns are dropped."""
    renamed = right.withColumnsRenamed({key: f"__{key}" for key in keys})
    test: Column | None = None
    for key in keys:
        same = F.col(key).eqNullSafe(F.col(f"__{key}"))
        test = same if test is None else test & same
    return left.join(renamed, test, how).drop(*[f"__{key}" for key in keys])


def min_max_score(
    df: DataFrame, value: str, out: str, lo: float = 0, hi: float = 100, by: Sequence[str] = (),
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Rescale ``value`` to [lo, hi], two places; equal values all get ``lo``.

    The bounds are one aggregate. Over the whole table they come back as a
    scalar subquery, so no row is joined; with ``by`` they join on the keys.
    Pass written ``score_bounds`` where the data is large.
    """
    if by:
        df = join_null_safe(df, score_bounds(df, value, by) if bounds is None else bounds, by, "left")
    else:
        df = df.withColumn("__range", df.agg(_range_of(value)).scalar())
    least, most = F.col("__range.least"), F.col("__range.most")
    share = (F.col(value) - least) / F.nullif(most - least, F.lit(0.0))
    level = F.when(F.col(value).isNotNull(), F.coalesce(share, F.lit(0.0)))
    return df.withColumn(out, F.round(level * (hi - lo) + lo, 2)).drop("__range")


def score_bounds(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Least and greatest value per group."""
    return df.groupBy(*by).agg(_range_of(value).alias("__range"))


def _range_of(value: str) -> Column:
    return F.struct(F.min(value).alias("least"), F.max(value).alias("most"))


def rank_table(df: DataFrame, score: str, out: str, by: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """(by..., score, rank): one row per distinct score.

    ``rank()`` over all rows would put them through one task, and over a
    region all rows of the region. Rows are first counted per distinct score,
    combined before the shuffle. The distinct values are cut into ranges at
    quantiles and ranked range by range. ``bounded=True`` is for scores with
    few values: a two-place score from 0 to 100 leaves at most 10,001 values
    and null per group, and one window runs over those.
    """
    counts = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("__n"))
    if bounded:
        return counts.withColumn(out, _rows_above(score, by) + 1).drop("__n")

    cuts = counts.agg(F.percentile_approx(score, [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).scalar()
    reached = F.size(F.filter("__cuts", lambda cut: cut <= F.col(score)))
    # null scores come last and so form the lowest range
    number = F.when(F.col(score).isNull(), F.lit(-1)).otherwise(reached)
    ranged = counts.withColumn("__cuts", cuts).withColumn("__range", number).drop("__cuts")
    sizes = ranged.groupBy(*by, "__range").agg(F.sum("__n").alias("__n"))
    starts = sizes.withColumn("__above", _rows_above("__range", by)).drop("__n")
    placed = join_null_safe(ranged, starts, [*by, "__range"])
    inside = _rows_above(score, [*by, "__range"])
    return placed.withColumn(out, F.col("__above") + inside + 1).drop("__n", "__range", "__above")


RANGES = 500


def _rows_above(order: str, by: Sequence[str]) -> Column:
    """Rows counted in ``__n`` with a greater value of ``order``."""
    window = (Window.partitionBy(*by) if by else Window).orderBy(F.desc_nulls_last(order))
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("__n").over(before), F.lit(0).cast("bigint"))


def global_rank(df: DataFrame, score: str, out: str, ranks: DataFrame | None = None) -> DataFrame:
    """Equal to ``rank() over (order by score desc)``.

    Pass a written rank table where the data is large: the planner then sees
    its true size and broadcasts it, and no row of ``df`` is shuffled.
    """
    ranks = rank_table(df, score, out) if ranks is None else ranks
    return join_null_safe(df, ranks, [score])


def rank_within(
    df: DataFrame, by: Sequence[str], score: str, out: str, ranks: DataFrame | None = None
) -> DataFrame:
    """Equal to ``rank() over (partition by ... order by score desc)``.

    The join is left to the planner: broadcast when the rank table is small,
    else a skew-aware join on group and score.
    """
    ranks = rank_table(df, score, out, by) if ranks is None else ranks
    return join_null_safe(df, ranks, [*by, score])


def sector_stats(df: DataFrame, value: str = "ben_per_1000_usd", by: Sequence[str] = ("cluster",)) -> DataFrame:
    """Mean and sample deviation per sector, three places."""
    return df.groupBy(*by).agg(
        F.round(exact_avg(F.col(value)), 3).alias("cluster_avg_ben_ratio"),
        F.round(exact_stddev(F.col(value)), 3).alias("cluster_std_ben_ratio"),
    )


def _exact_avg_over(value: str, window: WindowSpec) -> Column:
    total = F.sum(F.col(value).cast(EXACT)).over(window).cast("double")
    return total / F.nullif(F.count(value).over(window), F.lit(0))


def zscore(
    df: DataFrame,
    cfg: Config = Config(),
    value: str = "ben_per_1000_usd",
    by: Sequence[str] = ("cluster",),
    method: str = "agg_join",
    stats: DataFrame | None = None,
) -> DataFrame:
    """Add the sector mean and deviation, the z-score, the flag and its label.

    ``agg_join`` combines before the shuffle and joins a few rows back, so a
    sector of any share is harmless. ``window`` is for evenly sized sectors.
    """
    if method == "agg_join":
        df = join_null_safe(df, sector_stats(df, value, by) if stats is None else stats, by)
    elif method == "window":
        whole = Window.partitionBy(*by)
        df = df.withColumns(
            {
                "cluster_avg_ben_ratio": F.round(_exact_avg_over(value, whole), 3),
                "cluster_std_ben_ratio": F.round(F.stddev_samp(value).over(whole), 3),
            }
        )
    else:
        raise ValueError(f"unknown method {method!r}")
    return add_outlier_columns(df, cfg)
