"""The table builds: inputs, enriched tables, business tables.

Each table is written once and read by everything behind it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needscope import schemas
from needscope.config import Config
from needscope.functions.allocations import add_allocation_metrics
from needscope.functions.funding import add_funding_metrics
from needscope.functions.projects import add_project_metrics
from needscope.operators import clustering, comparables, quality, rollups, scoring
from needscope.operators.allocations import enrich_allocations
from needscope.sources import readers, sinks
from needscope.sources.scratch import settle


def scored_needs(needs: DataFrame, cfg: Config = Config()) -> DataFrame:
    return scoring.min_max_score(add_funding_metrics(needs, cfg), "overlook_score_raw", "overlook_score")


def global_ranks(needs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Rank per distinct score as a written table of known size."""
    return settle(scoring.rank_table(scored_needs(needs, cfg), "overlook_score", "global_overlook_rank", bounded=True), "ranks")


def silver_funding(needs: DataFrame, cfg: Config = Config(), ranks: DataFrame | None = None) -> DataFrame:
    """Needs with metrics, normalised score and global rank."""
    return scoring.global_rank(scored_needs(needs, cfg), "overlook_score", "global_overlook_rank", ranks)


def silver_projects(projects: DataFrame, cfg: Config = Config(), stats: DataFrame | None = None) -> DataFrame:
    return scoring.zscore(add_project_metrics(projects, cfg), cfg, stats=stats)


def silver_allocations(allocations: DataFrame, funding: DataFrame, cfg: Config = Config()) -> DataFrame:
    return add_allocation_metrics(enrich_allocations(allocations, funding), cfg)


def project_stats(projects: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Sector means and deviations as a written table of known size."""
    return settle(scoring.sector_stats(add_project_metrics(projects, cfg)), "sector-stats")


def regional_ranks(silver: DataFrame) -> DataFrame:
    ranks = scoring.rank_table(silver, "overlook_score", "regional_overlook_rank", ["region"], bounded=True)
    return settle(ranks, "regional-ranks")


def gold_benchmarks(projects: DataFrame, cfg: Config = Config(), groups: clustering.GroupModel | None = None) -> DataFrame:
    """Projects with KMeans group and label; fitted on them unless a model is given."""
    return (groups or clustering.fit_group_model(projects, cfg)).benchmarks(projects)


Tables = dict[str, DataFrame]
Sink = Callable[[DataFrame, str], DataFrame]


def table_sink(spark: SparkSession, database: str, location: str | None = None) -> Sink:
    """Write into a database and read back from there."""
    sinks.ensure_database(spark, database, location)

    def save(df: DataFrame, name: str) -> DataFrame:
        sinks.save_table(df, f"{database}.{name}", path=f"{location}/{name}" if location else None)
        return spark.table(f"{database}.{name}")

    return save


def year_sink(spark: SparkSession, root: str, year: int) -> Sink:
    """Write into the partition of an analysis year below ``root`` and read back from it."""

    def save(df: DataFrame, name: str) -> DataFrame:
        sinks.replace_year(df, f"{root}/{name}", year)
        return sinks.read_year(spark, f"{root}/{name}", year, df.schema)

    return save


def of_year(df: DataFrame, cfg: Config) -> DataFrame:
    """Rows of the analysis year; of a table partitioned by year only its files are read."""
    return df if cfg.year is None else df.filter(F.col("year") == cfg.year)


def load_files(spark: SparkSession, paths: Mapping[str, str]) -> tuple[Tables, DataFrame]:
    """(needs, projects and allocations from headed CSV files, (source, file, encoding, n_rows, n_bad)).

    Headers are normalised and renamed to the contract, text that does not
    parse becomes null. Records with too few or too many fields stay out and
    are counted.
    """
    contracts = {"needs": (schemas.NEEDS, schemas.NEEDS_FILE_NAMES), "projects": (schemas.PROJECTS, {}), "allocations": (schemas.ALLOCATIONS, {})}
    tables, files = {}, []
    for name, (schema, rename) in contracts.items():
        found = readers.read_csv(spark, paths[name])
        tables[name] = readers.conform(readers.normalise_columns(found.rows), schema, rename)
        files.append(found.files.select(F.lit(name).alias("source"), "*"))
    return tables, reduce(DataFrame.unionByName, files)


def run_files(spark: SparkSession, paths: Mapping[str, str], sink: Sink = settle, cfg: Config = Config()) -> Tables:
    """From CSV files to all tables, with ``input_files``, ``quality_report`` and ``inventory``."""
    sources, files = load_files(spark, paths)
    done = run(sources, sink, cfg, rules={"needs": quality.needs_rules(sources["needs"])})
    done["inventory"] = sink(sinks.table_inventory(done), "inventory")
    done["input_files"] = sink(files, "input_files")
    return done


def run(
    sources: Tables,
    sink: Sink = settle,
    cfg: Config = Config(),
    groups: clustering.GroupModel | None = None,
    rules: Mapping[str, Sequence[quality.Rule]] | None = None,
) -> Tables:
    """All tables from ``needs``, ``projects`` and ``allocations``.

    Give ``groups`` to put the projects into the groups of an earlier fit.
    ``rules`` by source are counted while that source is read: the run returns
    ``quality_report`` and ``<source>_aside``, goes on with the rows that break
    no ``set_aside`` rule, and stops before any table is replaced if one breaks
    a ``fail`` rule. With ``cfg.year`` needs and allocations are those of that
    year, so scores and ranks are within it; projects are those of all years.
    """
    done: Tables = {}

    def write(name: str, df: DataFrame) -> DataFrame:
        done[name] = sink(df, name)
        return done[name]

    sources = {name: df if name == "projects" else of_year(df, cfg) for name, df in sources.items()}
    unknown = set(rules or {}) - {"needs", "projects", "allocations"}
    if unknown:
        raise ValueError(f"rules for unknown sources: {sorted(unknown)}")
    gated = {name: quality.gate(sources[name], given, name) for name, given in (rules or {}).items()}
    sources = {**sources, **{name: each.kept for name, each in gated.items()}}
    for name, each in gated.items():
        write(f"{name}_aside", each.aside)
    if gated:
        reports = [each.report.select(F.lit(name).alias("source"), "*") for name, each in gated.items()]
        write("quality_report", reduce(DataFrame.unionByName, reports))

    done |= run_funding(sources, sink, cfg)
    projects = write("projects", sources["projects"])
    silver = write("silver_projects", silver_projects(projects, cfg, project_stats(projects, cfg)))
    benchmarks = write("gold_benchmarks", gold_benchmarks(silver, cfg, groups))
    write("gold_comparables", comparables.comparables_all(benchmarks, settle, cfg=cfg))
    return done


def run_funding(sources: Tables, sink: Sink = settle, cfg: Config = Config()) -> Tables:
    """The tables of needs and allocations alone.

    With ``cfg.year`` and a ``year_sink`` of that year a rerun reads the
    partition of the year from sources partitioned by year, and replaces that
    partition of each table; the other years stay as they are.
    """
    done: Tables = {}

    def write(name: str, df: DataFrame) -> DataFrame:
        done[name] = sink(df, name)
        return done[name]

    needs = write("needs", of_year(sources["needs"], cfg))
    allocations = write("allocations", of_year(sources["allocations"], cfg))
    funding = write("silver_funding", silver_funding(needs, cfg, global_ranks(needs, cfg)))
    write("silver_allocations", silver_allocations(allocations, funding, cfg))
    ranked = write("gold_rankings", rollups.rankings(funding, cfg, regional_ranks(funding)))
    write("gold_regional", rollups.regional_summary(ranked))
    write("gold_cluster", rollups.cluster_summary(ranked))
    write("gold_mismatch", rollups.mismatch(ranked, cfg))
    return done
