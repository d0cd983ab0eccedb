"""The nearest comparable projects of one project, or of all of them.

Comparable means: same benchmark group and same sector. The distance adds
the weighted differences in efficiency, coverage and log budget.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needscope.config import Config
from needscope.operators.quality import drop_null_features

BLOCK = ("benchmark_group", "cluster")
AXES = ("ben_per_1000_usd", "funding_coverage_pct", "budget_usd")
PLACE = (*BLOCK, *AXES)

Settle = Callable[[DataFrame, str], DataFrame]

# Order compares distances after rounding to nine places, where engines agree;
# the shown figure has three. A candidate can tie with the n-th one although it
# is up to 1e-9 farther, and far coordinates carry rounding errors of their own.
PLACES = 9
SLACK = 1.1e-9
ROUNDING = 4e-15
MOST_GAPS = 1 << 20  # distances between places of cells that a task takes together


MEASURES = ("ben_per_1000_usd", "funding_coverage_pct", "log_budget")


def _with_log(df: DataFrame) -> DataFrame:
    return df.withColumn("log_budget", F.ln(F.greatest(F.col("budget_usd"), F.lit(1))))


def distance(other: str, cfg: Config) -> Column:
    """Unrounded distance to the row whose columns carry the prefix ``other``."""
    def apart(name: str) -> Column:
        return F.abs(F.col(name) - F.col(f"{other}{name}"))

    return (
        apart("ben_per_1000_usd") * cfg.efficiency_weight
        + apart("funding_coverage_pct") * cfg.coverage_weight
        + apart("log_budget") * cfg.budget_weight
    )


def _prefixed(df: DataFrame, prefix: str, *names: str) -> DataFrame:
    return df.select(*[F.col(name).alias(f"{prefix}{name}") for name in names])


def comparables_for(benchmarks: DataFrame, code: str, n: int | None = None, cfg: Config = Config()) -> DataFrame:
    """The nearest ``n`` projects of one project; empty if it is unknown.

    The code is compared as a value and never becomes part of a SQL text.
    """
    target = benchmarks.filter(F.col("project_code") == F.lit(code)).limit(1)
    return comparables_of(benchmarks, target, n, cfg)


def comparables_of(benchmarks: DataFrame, target: DataFrame, n: int | None = None, cfg: Config = Config()) -> DataFrame:
    """Same for a one-row table holding the project."""
    one = _prefixed(_with_log(target.limit(1)), "t_", "project_code", *BLOCK, *MEASURES)
    same = (F.col("benchmark_group") == F.col("t_benchmark_group")) & (F.col("cluster") == F.col("t_cluster"))
    others = _with_log(benchmarks).join(F.broadcast(one), same).filter("project_code != t_project_code")
    apart = distance("t_", cfg)
    return (
        others.withColumn("__order", F.round(apart, PLACES))
        .orderBy("__order", "project_code")
        .limit(cfg.neighbours if n is None else n)
        .select(
            "project_code", "country", "cluster",
            F.round(F.col("budget_usd") / 1_000_000, 2).alias("budget_musd"),
            "target_beneficiaries",
            F.round("ben_per_1000_usd", 1).alias("efficiency"),
            F.round("funding_coverage_pct", 1).alias("coverage_pct"),
            F.col("outlier_classification").alias("status"),
            F.round(apart, 3).alias("similarity_distance"),
        )
    )


def benchmark_report(benchmarks: DataFrame, code: str) -> DataFrame:
    """Header figures of one project; no row when the code is unknown."""
    return report_columns(benchmarks.filter(F.col("project_code") == F.lit(code)))


def report_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "project_code", "country", "cluster", "budget_usd", "target_beneficiaries",
        F.round("ben_per_1000_usd", 1).alias("efficiency"),
        F.round("funding_coverage_pct", 1).alias("coverage_pct"),
        F.round("cluster_avg_ben_ratio", 1).alias("cluster_avg_efficiency"),
        F.round("ben_ratio_zscore", 2).alias("z_score"),
        F.col("outlier_classification").alias("status"),
        "benchmark_label",
    )


def demo_projects(benchmarks: DataFrame, ranked: DataFrame, n: int = 2, top_rank: int = 3) -> DataFrame:
    """First projects of the most overlooked entities, by rank, then code."""
    top = ranked.filter(F.col("global_overlook_rank") <= top_rank).select("iso3", "global_overlook_rank")
    codes = benchmarks.select("project_code", "iso3").join(top, "iso3")
    best = codes.groupBy("project_code").agg(F.min("global_overlook_rank").alias("best_rank"))
    return best.orderBy("best_rank", "project_code").limit(n)


# ---- all projects in one job ----

def comparables_all(
    benchmarks: DataFrame, settle: Settle, n: int | None = None, cfg: Config = Config()
) -> DataFrame:
    """(project_code, comparable_rank, comparable_code, similarity_distance)
    with the nearest ``n`` of every project: exact, and without pairing all
    projects of a block.

    Order goes by the distance to nine places, then by code; the shown distance
    has three.

    1. Projects with equal figures are one *place* that keeps its first n + 1
       codes; no project can need more of them.
    2. Crowded blocks are split at quantiles until no cell holds more than
       ``cfg.leaf_rows`` places.
    3. Inside its cell each place finds a distance that surely covers its
       nearest n + 1 codes.
    4. The place visits the cells within that distance, and only those.
    """
    n = cfg.neighbours if n is None else n
    clean = drop_null_features(benchmarks, ["project_code", *PLACE]).select("project_code", *PLACE)
    places = settle(_places(clean, n, cfg), "places")
    cells, splits = _split_cells(places.drop("codes"), settle, max(cfg.leaf_rows, n + 1))
    visits = _visits(_with_reach(cells, n), cells, splits)
    # the code lists stay out of the split rounds, which rewrite every row
    hosts = cells.join(places.select("place_id", "codes"), "place_id") if splits else places
    nearest = _nearest_codes(visits, hosts, n, cfg)

    # a place may stand for very many projects: this join is left to the
    # skew handling of adaptive execution
    own = clean.join(nearest, list(PLACE))
    others = F.slice(F.filter("near", lambda c: c["code"] != F.col("project_code")), 1, n)
    listed = own.select("project_code", F.posexplode(others).alias("pos", "found"))
    return listed.select(
        "project_code",
        (F.col("pos") + 1).alias("comparable_rank"),
        F.col("found.code").alias("comparable_code"),
        F.round("found.dist", 3).alias("similarity_distance"),
    )


def _places(clean: DataFrame, n: int, cfg: Config) -> DataFrame:
    """Distinct figures with their first n + 1 codes and search coordinates.

    The row_number filter is applied per task before the shuffle, so a place
    shared by a third of all projects sends n + 1 rows per task.
    """
    order = Window.partitionBy(*PLACE).orderBy("project_code")
    first = clean.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= n + 1)
    merged = first.groupBy(*PLACE).agg(F.sort_array(F.collect_list("project_code")).alias("codes"))
    return _with_log(merged).withColumns(
        {
            "x0": F.col("ben_per_1000_usd") * cfg.efficiency_weight,
            "x1": F.col("funding_coverage_pct") * cfg.coverage_weight,
            "x2": F.col("log_budget") * cfg.budget_weight,
            # fixed once the table is written; a number sorts faster than a code
            "place_id": F.monotonically_increasing_id(),
            "n_codes": F.size("codes"),
            "cell": F.lit("c"),
            "around": F.lit("c"),
            "reach": F.lit(float("inf")),
        }
    )


CELL = (*BLOCK, "cell")
AROUND = (*BLOCK, "around")
SEARCH = ("x0", "x1", "x2")
WAYS = 8
MOST_AROUND = 1024  # places of a cell whose distances are all compared


def _split_cells(places: DataFrame, settle: Settle, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Split cells with more than ``most`` places, eight ways per round.

    Places are distinct, so some coordinate always separates two of them and
    the loop ends. One round divides a cell by about eight: ten rounds reach
    a billion cells. A round counts and rewrites only what the round before
    split. Only the question whether a crowded cell is left comes back to the
    driver.
    """
    splits: list[DataFrame] = []
    finished: list[DataFrame] = []
    while True:
        crowded = settle(_cuts(places, most), "splits")
        if crowded.isEmpty():
            return reduce(DataFrame.unionByName, finished, places), splits
        splits.append(crowded)
        finished.append(places.join(crowded.select(*CELL), list(CELL), "left_anti").select(*places.columns))
        joined = places.join(crowded, list(CELL))
        child = _child(_slot(_on_axis(), F.lit(0.0)))
        far = sum(
            (F.greatest(F.col(x) - F.col(f"{x}_lo"), F.col(f"{x}_hi") - F.col(x)) for x in SEARCH), F.lit(0.0)
        )
        places = settle(
            joined.withColumns(
                {
                    # every place of the cell before the split is this near
                    "reach": far,
                    "cell": child,
                    # a cell of few places tells little of the distance to the next ones
                    "around": F.when(F.col("n_places") <= MOST_AROUND, F.col("cell")).otherwise(child),
                }
            ).select(*places.columns),
            "places",
        )


def _cuts(places: DataFrame, most: int) -> DataFrame:
    """Bounds, axis and cut points of every crowded cell."""
    at = [i / WAYS for i in range(1, WAYS)]
    stats = [F.count(F.lit(1)).alias("n_places")]
    for x in SEARCH:
        stats += [
            F.min(x).alias(f"{x}_lo"),
            F.max(x).alias(f"{x}_hi"),
            F.percentile_approx(x, at, 1000).alias(f"{x}_q"),
        ]
    cells = places.groupBy(*CELL).agg(*stats).filter(F.col("n_places") > most)

    # prefer the axis whose middle is widest, then the one with the widest ends
    rated = F.array(
        *[
            F.struct(
                (F.element_at(f"{x}_q", WAYS - 1) - F.element_at(f"{x}_q", 1)).alias("middle"),
                (F.col(f"{x}_hi") - F.col(f"{x}_lo")).alias("full"),
                F.lit(i).alias("axis"),
                F.col(f"{x}_lo").alias("lo"),
                F.col(f"{x}_hi").alias("hi"),
                F.col(f"{x}_q").alias("q"),
            )
            for i, x in enumerate(SEARCH)
        ]
    )
    chosen = cells.withColumn("best", F.array_max(rated))
    lo, hi = F.col("best.lo"), F.col("best.hi")
    above = F.array_distinct(F.filter("best.q", lambda q: q > F.col("best.lo")))
    half = (lo + hi) / 2
    fallback = F.array(F.when(half > lo, half).otherwise(hi))
    return chosen.select(
        *CELL,
        "n_places",
        F.col("best.axis").alias("axis"),
        F.when(F.size(above) > 0, above).otherwise(fallback).alias("cuts"),
        *[f"{x}_{end}" for x in SEARCH for end in ("lo", "hi")],
    )


def _on_axis() -> Column:
    return F.element_at(F.array(*SEARCH), F.col("axis") + 1)


def _slot(value: Column, shift: Column) -> Column:
    """Child number of a coordinate: how many cut points it reaches."""
    moved = value + shift
    return F.size(F.filter("cuts", lambda cut: cut <= moved))


def _child(slot: Column) -> Column:
    return F.concat(F.col("cell"), F.lit("."), slot.cast("string"))


def _with_reach(places: DataFrame, n: int) -> DataFrame:
    """Lower ``reach`` to the distance of the (n + 1)-th code in the own cell.

    Children of a cell of at most ``MOST_AROUND`` places are taken together:
    alone they often hold fewer than n + 1 codes.
    """
    df = places.select("place_id", *PLACE, "log_budget", *SEARCH, "n_codes", "cell", "around", "reach")
    # The rows compared with each other are bounded. The work per byte is high,
    # so the partitions must not be merged for being small.
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartition(partitions, *AROUND).sortWithinPartitions(*AROUND)
    return ordered.mapInArrow(_cover_cells(n), df.schema).drop("around")


def _cover_cells(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lowers ``reach`` in rows ordered by ``AROUND``, many cells at a time, as cells
    may be small and very many. Its steps are inside, so that they travel to
    the tasks by value.
    """

    def starts_of(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        begins = np.zeros(batch.num_rows, bool)
        begins[0] = True
        for name in AROUND:
            values = batch.column(name)
            begins[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(begins)

    def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and any(held[-1].column(name)[-1] != batch.column(name)[0] for name in AROUND):
                yield pa.Table.from_batches(held)
                held = []
            last = int(starts_of(batch)[-1])
            if last:
                yield pa.Table.from_batches([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield pa.Table.from_batches(held)

    def inside(rows: np.ndarray, codes: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
        """Distance of the (n + 1)-th code, by cell and place; ``rows`` are those of cells of one size."""
        size = rows.shape[1]
        gaps = np.zeros((*rows.shape, size))
        for x in at:
            gaps += np.abs(x[rows][:, :, None] - x[rows][:, None, :])
        # every place has at least one code, so n + 1 places always suffice
        k = min(n, size - 1)
        close = np.argpartition(gaps, k, axis=2)[:, :, : k + 1]
        gaps = np.take_along_axis(gaps, close, axis=2)
        order = np.argsort(gaps, axis=2)
        near = rows[:, :1, None] + np.take_along_axis(close, order, axis=2)
        covered = np.cumsum(codes[near], axis=2) > n
        sorted_gaps = np.take_along_axis(gaps, order, axis=2)
        return np.take_along_axis(sorted_gaps, covered.argmax(axis=2)[:, :, None], axis=2)[:, :, 0]

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in whole_cells(batches):
            codes, old, *at = (cells[name].to_numpy() for name in ("n_codes", "reach", *SEARCH))
            reach, starts = old.copy(), starts_of(cells)
            sizes = np.diff(np.r_[starts, len(codes)])
            enough = np.add.reduceat(codes.astype(np.int64), starts) > n
            for size in np.unique(sizes[enough]).tolist():
                same, step = starts[enough & (sizes == size)], max(1, MOST_GAPS // size**2)
                for low in range(0, len(same), step):
                    rows = same[low : low + step, None] + np.arange(size)
                    reach[rows] = np.minimum(old[rows], inside(rows, codes, at))
            field = cells.schema.get_field_index("reach")
            yield from cells.set_column(field, cells.schema.field(field), pa.array(reach)).to_batches()

    return cover


def _visits(seekers: DataFrame, places: DataFrame, splits: list[DataFrame]) -> DataFrame:
    """One row per place and cell that its reach touches.

    A cell that is split again is left where its box is out of reach, so a
    place does not carry the children of such cells through the rounds.
    """
    error = sum((F.abs(x) for x in SEARCH), F.col("reach")) * ROUNDING
    reach = F.col("reach") + SLACK + error
    visits = seekers.withColumns({"cell": F.lit("c"), "reach": reach}).drop("n_codes")
    for split in splits:
        whole = F.col("cuts").isNull()
        joined = visits.join(split, list(CELL), "left").filter(whole | (_away() <= F.col("reach")))
        touched = F.sequence(_slot(_on_axis(), -F.col("reach")), _slot(_on_axis(), F.col("reach")))
        cells = F.when(whole, F.array("cell")).otherwise(F.transform(touched, _child))
        visits = joined.withColumn("cell", F.explode(cells)).select(*visits.columns)
    if not splits:
        return visits
    boxes = places.groupBy(*CELL).agg(
        *[end(x).alias(f"{x}_{name}") for x in SEARCH for name, end in (("lo", F.min), ("hi", F.max))]
    )
    return visits.join(boxes, list(CELL)).filter(_away() <= F.col("reach")).select(*visits.columns)


def _away() -> Column:
    """Distance of a place from the box of a cell."""
    return sum(
        (F.greatest(F.col(f"{x}_lo") - F.col(x), F.col(x) - F.col(f"{x}_hi"), F.lit(0.0)) for x in SEARCH), F.lit(0.0)
    )


def _pairs_in_reach(visits: DataFrame, hosts: DataFrame, cfg: Config) -> DataFrame:
    lists = hosts.select(*CELL, *[F.col(name).alias(f"h_{name}") for name in MEASURES], "codes")
    pairs = visits.join(lists, list(CELL))
    return pairs.withColumn("dist", distance("h_", cfg)).filter(F.col("dist") <= F.col("reach"))


def _nearest_codes(visits: DataFrame, hosts: DataFrame, n: int, cfg: Config) -> DataFrame:
    """Per place the first n + 1 codes by rounded distance, then by code.

    The place number stands for the five key columns, so ranking and
    collecting share one shuffle.
    """
    near = _pairs_in_reach(visits, hosts, cfg)
    found = near.select("place_id", *PLACE, F.round("dist", PLACES).alias("dist"), F.explode("codes").alias("code"))
    order = Window.partitionBy("place_id").orderBy("dist", "code")
    first = found.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= n + 1)
    return first.groupBy("place_id").agg(
        *[F.first(name).alias(name) for name in PLACE],
        F.sort_array(F.collect_list(F.struct("dist", "code"))).alias("near"),
    ).drop("place_id")
