"""The nearest comparables of one project, from files kept for such lookups.

The places of all projects are cut into search cells once. Neighbouring cells
lie in one folder, and a table of their bounds tells which cells a lookup can
need. It opens the folders of these cells alone, so its cost follows the
neighbourhood of the project and not the table; nothing else is listed.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from needscope.config import Config
from needscope.operators import comparables
from needscope.operators.comparables import BLOCK, CELL, MEASURES, PLACE, ROUNDING, SLACK, Settle
from needscope.operators.quality import drop_null_features

PART_PLACES = 65_536  # places in a folder, about
DETAILS = ("country", "target_beneficiaries", "outlier_classification")


def write_index(
    benchmarks: DataFrame, path: str, settle: Settle, most: int = 20, cfg: Config = Config(), part_places: int = PART_PLACES
) -> ComparableIndex:
    """Write the lookup files of ``benchmarks`` into the new folder ``path``.

    ``most`` is the largest number of comparables that a lookup may ask for:
    projects with equal figures keep their first ``most`` + 1 codes, so a place
    shared by a third of all rows stays small. Projects without a code, block or
    figure are left out, a code that recurs counts once with its least figures,
    and an empty table gives an index that knows no project. Extra columns are
    ignored.
    """
    spark = benchmarks.sparkSession
    clean = drop_null_features(benchmarks, ["project_code", *PLACE])
    least = clean.groupBy("project_code").agg(F.min(F.struct(*PLACE, *DETAILS)).alias("least"))
    known = settle(least.select("project_code", "least.*"), "known")
    order = Window.partitionBy(*PLACE).orderBy("project_code")
    first = known.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= most + 1).drop("__k")
    members = settle(first, "members")
    places = settle(comparables._places(members.select("project_code", *PLACE), most, cfg), "places")
    cells, _ = comparables._split_cells(places.drop("codes"), settle, max(cfg.leaf_rows, most + 1))

    # rows of a cell share their range, so a cell lies in one part
    parts = 1 + places.count() // part_places
    ranged = cells.repartitionByRange(parts, *CELL).withColumn("part", F.spark_partition_id())
    placed = settle(ranged.select("part", "cell", "n_codes", "log_budget", *PLACE), "placed")

    rows = members.join(placed.drop("n_codes"), list(PLACE))
    by_cell = rows.repartition("part").sortWithinPartitions("part", *CELL)
    shown = by_cell.select("project_code", "cell", *PLACE, "log_budget", *DETAILS, "part")
    shown.write.partitionBy("part").parquet(f"{path}/rows")
    spark.createDataFrame([], shown.drop("part").schema).write.parquet(f"{path}/kinds")

    ends = [end(x).alias(f"{x}_{name}") for x in MEASURES for name, end in (("lo", F.min), ("hi", F.max))]
    bounds = placed.groupBy("part", *CELL).agg(F.sum("n_codes").alias("n_codes"), *ends)
    bounds.repartitionByRange(*BLOCK).sortWithinPartitions(*BLOCK).write.parquet(f"{path}/cells")

    buckets = 1 + known.count() // part_places
    dealt = known.select("project_code", *PLACE).withColumn("bucket", F.pmod(F.crc32("project_code"), F.lit(buckets)))
    dealt.repartition("bucket").sortWithinPartitions("bucket", "project_code").write.partitionBy("bucket").parquet(f"{path}/codes")
    # written last: an index whose job was lost can't be opened
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(most).alias("most")).write.parquet(f"{path}/facts")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> ComparableIndex:
    buckets, most = spark.read.parquet(f"{path}/facts").first()
    return ComparableIndex(spark, path, buckets, most)


@dataclass(frozen=True)
class ComparableIndex:
    spark: SparkSession
    path: str
    buckets: int
    most: int

    def nearest(self, code: str, n: int | None = None, cfg: Config = Config()) -> DataFrame:
        """What ``comparables.comparables_for`` returns, from the cells that the project can need.

        ``cfg`` may carry other weights than the index was written with. An
        unknown project gives no rows. What passes through the driver is one
        project, n + 1 distances and the names of the cells within reach.
        """
        n = cfg.neighbours if n is None else n
        if not 0 <= n <= self.most:
            raise ValueError(f"this index answers up to {self.most} comparables")
        target = self._target(code)
        found = target and target.first()
        if not found:
            none = self._rows([])
            return comparables.comparables_of(none, none, n, cfg)
        cells = self._cells_in_reach(found.asDict(), n, cfg)
        rows = self._rows(sorted({part for part, _ in cells}))
        return comparables.comparables_of(rows.filter(F.col("cell").isin([cell for _, cell in cells])), target, n, cfg)

    def _target(self, code: str) -> DataFrame | None:
        """The project with its figures, from the folder of its code."""
        folder = f"{self.path}/codes/bucket={crc32(code.encode()) % self.buckets}"
        try:
            found = self.spark.read.parquet(folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return comparables._with_log(found.filter(F.col("project_code") == F.lit(code)))

    def _cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def _rows(self, parts: list[int]) -> DataFrame:
        """Projects of some parts; no rows without parts."""
        folders = [f"{self.path}/rows/part={part}" for part in parts]
        kinds = self.spark.read.parquet(f"{self.path}/kinds").schema
        return self.spark.read.schema(kinds).parquet(*folders) if folders else self.spark.createDataFrame([], kinds)

    def _cells_in_reach(self, figures: dict, n: int, cfg: Config) -> list[tuple[int, str]]:
        """(part, cell) of the cells that may hold one of the nearest n + 1 codes."""
        weights = dict(zip(MEASURES, (cfg.efficiency_weight, cfg.coverage_weight, cfg.budget_weight)))

        def apart(least: bool) -> Column:
            out = F.lit(0.0)
            for x, weight in weights.items():
                lo, hi, at = F.col(f"{x}_lo"), F.col(f"{x}_hi"), F.lit(figures[x])
                out = out + (F.greatest(lo - at, at - hi, F.lit(0.0)) if least else F.greatest(at - lo, hi - at)) * weight
            return out

        same = (F.col(BLOCK[0]) == F.lit(figures[BLOCK[0]])) & (F.col(BLOCK[1]) == F.lit(figures[BLOCK[1]]))
        cells = self._cells().filter(same).withColumns({"away": apart(True), "far": apart(False)})
        # the cells whose far ends are nearest hold the codes for sure
        reach, held = float("inf"), 0
        for row in cells.orderBy("far").select("n_codes", "far").limit(n + 1).collect():
            held += row.n_codes
            if held > n:
                reach = row.far
                break
        own = cells.orderBy("away", "far", "cell").select("part", "cell").first()
        inside = self._rows([own.part]).filter(same & (F.col("cell") == own.cell))
        gap = sum((F.abs(F.col(x) - F.lit(figures[x])) * weight for x, weight in weights.items()), F.lit(0.0))
        near = [row.gap for row in inside.select(gap.alias("gap")).orderBy("gap").limit(n + 1).collect()]
        if len(near) > n:
            reach = min(reach, near[-1])
        error = (sum(abs(figures[x]) * weight for x, weight in weights.items()) + reach) * ROUNDING
        within = cells.filter(F.col("away") <= F.lit(reach + SLACK + error))
        return [tuple(row) for row in within.select("part", "cell").collect()]
