"""The tables of one star-schema folder, each written on first use.

Building needs from the order lines is the expensive part. It is done once
per application and folder; all queries read the written tables.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property
from uuid import uuid4

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from needscope.config import Config
from needscope.functions.funding import add_funding_metrics
from needscope.functions.projects import add_project_metrics
from needscope.operators import charts, clustering, lookup, rollups, scoring
from needscope.plans import medallion
from needscope.sources import star
from needscope.sources.readers import scan
from needscope.sources.scratch import scratch_dir, settle


class Store:
    def __init__(self, spark: SparkSession, folder: str, cfg: Config = Config()):
        self.spark, self.folder, self.cfg = spark, folder, cfg

    def raw(self, name: str) -> DataFrame:
        return scan(self.spark, self.folder, name)

    # inputs

    @cached_property
    def entity_lines(self) -> DataFrame:
        return settle(star.entity_lines(self.raw("orders"), self.raw("lineitem")), "entity-lines")

    @cached_property
    def needs(self) -> DataFrame:
        built = star.needs(
            self.raw("customer"), self.raw("nation"), self.raw("region"), self.raw("orders"), self.entity_lines
        )
        return settle(built, "needs")

    @cached_property
    def projects(self) -> DataFrame:
        built = star.projects(self.raw("part"), self.raw("lineitem"), self.raw("orders"), self.raw("customer"))
        return settle(built, "projects")

    @cached_property
    def allocations(self) -> DataFrame:
        return settle(star.allocations(self.raw("customer"), self.entity_lines, self.needs), "allocations")

    # enriched, lazily: for queries that show one operator at work

    @property
    def metrics(self) -> DataFrame:
        return add_funding_metrics(self.needs, self.cfg)

    @property
    def project_metrics(self) -> DataFrame:
        return add_project_metrics(self.projects, self.cfg)

    # small tables that large ones are joined with, written so that the planner knows their size

    @cached_property
    def global_ranks(self) -> DataFrame:
        return medallion.global_ranks(self.needs, self.cfg)

    @cached_property
    def regional_ranks(self) -> DataFrame:
        return medallion.regional_ranks(self.silver_funding)

    @cached_property
    def regional_bounds(self) -> DataFrame:
        return settle(scoring.score_bounds(self.metrics, "overlook_score_raw", ["region"]), "regional-bounds")

    @cached_property
    def sector_stats(self) -> DataFrame:
        return medallion.project_stats(self.projects, self.cfg)

    @cached_property
    def efficiency_ranges(self) -> DataFrame:
        return settle(charts.efficiency_ranges(self.silver_projects), "efficiency-ranges")

    # enriched, written

    @cached_property
    def silver_funding(self) -> DataFrame:
        return settle(medallion.silver_funding(self.needs, self.cfg, self.global_ranks), "silver-funding")

    @cached_property
    def silver_projects(self) -> DataFrame:
        return settle(medallion.silver_projects(self.projects, self.cfg, self.sector_stats), "silver-projects")

    @cached_property
    def silver_allocations(self) -> DataFrame:
        built = medallion.silver_allocations(self.allocations, self.silver_funding, self.cfg)
        return settle(built, "silver-allocations")

    # business tables

    @cached_property
    def rankings(self) -> DataFrame:
        return settle(rollups.rankings(self.silver_funding, self.cfg, self.regional_ranks), "rankings")

    @property
    def mismatch(self) -> DataFrame:
        return rollups.mismatch(self.rankings, self.cfg)

    @cached_property
    def fixed_benchmarks(self) -> DataFrame:
        """Benchmark table over the fixed budget groups."""
        grouped = star.fixed_groups(clustering.clean_features(self.silver_projects))
        return settle(clustering.benchmarks(clustering.label_groups(grouped, self.cfg)), "fixed-benchmarks")

    @cached_property
    def comparable_index(self) -> lookup.ComparableIndex:
        """Lookup files with small cells, so that blocks are split in several rounds."""
        path = f"{scratch_dir(self.spark)}/comparables-{uuid4().hex}"
        cfg = replace(self.cfg, leaf_rows=64)
        return lookup.write_index(self.fixed_benchmarks, path, settle, cfg=cfg, part_places=256)

    @cached_property
    def clustered(self) -> DataFrame:
        """Projects with KMeans group, scaled features kept for evaluation."""
        return settle(clustering.assign_groups(self.group_model, self.indexed_projects), "clustered")

    @cached_property
    def indexed_projects(self) -> DataFrame:
        return settle(clustering.index_category(clustering.clean_features(self.silver_projects)), "indexed")

    @cached_property
    def group_model(self) -> PipelineModel:
        return clustering.fit_groups(self.indexed_projects, cfg=self.cfg)

    TABLES = (
        "entity_lines", "needs", "projects", "allocations", "silver_funding", "silver_projects",
        "silver_allocations", "rankings", "fixed_benchmarks",
        "comparable_index",
    )


_stores: dict[tuple[str, str], Store] = {}


def store_of(spark: SparkSession, folder: str) -> Store:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _stores:
        _stores[key] = Store(spark, folder)
    return _stores[key]
