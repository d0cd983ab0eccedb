"""Writing tables and reporting on them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ensure_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create the database if it is missing and make it current."""
    quoted = _quoted(name)
    if location:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted} LOCATION :at", args={"at": location})
    else:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted}")
    spark.sql(f"USE {quoted}")


def _quoted(*parts: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def _split(spark: SparkSession, name: str) -> tuple[str, str]:
    """(database, table) of ``name``; without a database it is the current one."""
    database, _, table = name.replace("`", "").rpartition(".")
    return database or spark.catalog.currentDatabase(), table


def versions(spark: SparkSession, name: str) -> list[str]:
    """Tables that hold the complete versions of ``name``, oldest first."""
    database, table = _split(spark, name)
    rows = spark.sql(f"SHOW TABLES IN {_quoted(database)}").collect()
    form = re.compile(re.escape(table.lower()) + r"__v[0-9]{6,}_[0-9a-f]{8}")
    found = [row.tableName for row in rows if form.fullmatch(row.tableName.lower())]
    return sorted(found, key=lambda version: (int(version.rsplit("__v", 1)[1].split("_")[0]), version))


def save_table(
    df: DataFrame, name: str, partition_by: Sequence[str] = (), path: str | None = None
) -> None:
    """Replace a table, its schema included, without a moment in which it is missing.

    The rows go into a table of their own, a version; then the view ``name`` is
    turned to it in one step of the catalog. A job that is lost before that
    leaves the former version in place, readers of the former version finish,
    and ``df`` may read ``name`` itself. Without ``path`` versions are managed
    tables in the warehouse folder; with ``path`` they are external ones in
    folders below it. ``drop_versions`` removes former ones. A plain table of
    that name is dropped once the first version is complete.
    """
    spark = df.sparkSession
    database, table = _split(spark, name)
    former = versions(spark, name)
    number = int(former[-1].rsplit("__v", 1)[1].split("_")[0]) + 1 if former else 1
    version = f"{table}__v{number:06d}_{uuid4().hex[:8]}"
    writer = df.write.format("parquet").mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", f"{path}/{version}")
    writer.saveAsTable(_quoted(database, version))
    target = _quoted(database, table)
    if spark.catalog.tableExists(target) and spark.catalog.getTable(target).tableType != "VIEW":
        spark.sql(f"DROP TABLE {target}")
    spark.sql(f"CREATE OR REPLACE VIEW {target} AS SELECT * FROM {_quoted(database, version)}")


def drop_versions(spark: SparkSession, name: str, keep: int = 1) -> list[str]:
    """Drop all but the newest ``keep`` versions of ``name``; their names are returned.

    The version that ``name`` shows is always kept. Files of external versions
    stay in their folders. Call it when no job reads the dropped versions.
    """
    if keep < 1:
        raise ValueError("keep at least one version")
    database, table = _split(spark, name)
    shown = spark.sql(f"SHOW CREATE TABLE {_quoted(database, table)}").first()[0]
    dropped = [version for version in versions(spark, name)[:-keep] if version not in shown]
    for version in dropped:
        spark.sql(f"DROP TABLE {_quoted(database, version)}")
    return dropped


YEAR = "analysis_year"


def replace_year(df: DataFrame, path: str, year: int) -> None:
    """Replace the partition of one analysis year below ``path``; other years stay.

    The rows are staged beside the partition and take its place when all of
    them are there, so a job that is lost in between leaves the former rows,
    and ``df`` may read ``path`` itself. Who reads that year meanwhile has to
    read it again: use ``save_table`` where readers must finish. A table without
    rows empties the partition. ``df`` must not have a column called ``analysis_year``.
    """
    if YEAR in df.columns:
        raise ValueError(f"a table by year has no column {YEAR} of its own")
    seen = Observation()
    marked = df.observe(seen, F.count(F.lit(1)).alias("n_rows")).withColumn(YEAR, F.lit(year))
    writer = marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(YEAR).parquet(path)
    if not seen.get["n_rows"]:
        # an overwrite of the partitions that have rows would leave the former ones
        nothing = df.sparkSession.createDataFrame([], df.schema)
        nothing.write.mode("overwrite").parquet(f"{path}/{YEAR}={year}")


def read_year(spark: SparkSession, path: str, year: int, schema: StructType | None = None) -> DataFrame:
    """One analysis year of a table; no other partition is listed."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/{YEAR}={year}")


def read_years(spark: SparkSession, path: str) -> DataFrame:
    """All years of a table with the column ``analysis_year``."""
    return spark.read.parquet(path)


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, n_cols) per table and one TOTAL row."""
    counts: DataFrame | None = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols")
        )
        counts = row if counts is None else counts.unionByName(row)
    if counts is None:
        raise ValueError("no tables given")
    summed = counts.rollup("table_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_cols").alias("n_cols"))
    return summed.withColumn("table_name", F.coalesce("table_name", F.lit("TOTAL")))


def schema_report(df: DataFrame) -> DataFrame:
    """(position, column_name, type_name, n_values): types with filled counts."""
    names = df.columns
    counted = df.agg(*[F.count(F.col(name)).alias(name) for name in names])
    rows = counted.unpivot([], list(names), "column_name", "n_values")
    kinds = F.create_map(*[F.lit(part) for name, kind in df.dtypes for part in (name, kind)])
    order = F.array(*[F.lit(name) for name in names])
    return rows.select(
        F.array_position(order, F.col("column_name")).alias("position"),
        "column_name",
        kinds[F.col("column_name")].alias("type_name"),
        "n_values",
    )
