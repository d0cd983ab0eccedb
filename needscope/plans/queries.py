"""Every operator as a named query over a star-schema folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needscope import schemas
from needscope.functions import allocations as allocation_columns
from needscope.functions import funding, projects
from needscope.operators import (
    allocations, charts, clustering, comparables, outliers, panels, quality, rollups, scoring,
    states,
)
from needscope.plans import medallion
from needscope.plans.store import Store, store_of
from needscope.sources import readers, sinks, star
from needscope.sources.scratch import scratch_dir, settle

Query = Callable[[Store], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: build(store_of(spark, folder))

    return {name: bind(build) for name, build in QUERIES.items()}


# ---- sources and sinks ----

@query
def scan_table(s: Store) -> DataFrame:
    return s.raw("orders")


@query
def scan_csv(s: Store) -> DataFrame:
    path = f"{scratch_dir(s.spark)}/needs-csv-{uuid4().hex}"
    s.needs.write.option("header", True).csv(path)
    return readers.scan_csv(s.spark, path, schemas.NEEDS)


@query
def normalise_columns(s: Store) -> DataFrame:
    return readers.normalise_columns(
        s.needs.select(
            F.col("iso3").alias(" ISO3 "),
            F.col("people_in_need_millions").alias("People In  Need (M)"),
            F.col("required_funding_musd").alias("Required-Funding $M"),
            F.col("primary_cluster").alias("Primary\tCluster"),
        )
    )


@query
def conform_schema(s: Store) -> DataFrame:
    """Text columns under file names, with an unreadable year in one region."""
    back = {new: old for old, new in schemas.NEEDS_FILE_NAMES.items()}
    text = s.needs.select(*[F.col(name).cast("string").alias(old) for name, old in back.items()])
    broken = F.when(F.col("region") == "ASIA", F.concat(F.col("year"), F.lit("?"))).otherwise(F.col("year"))
    return readers.conform(text.withColumn("year", broken), schemas.NEEDS, schemas.NEEDS_FILE_NAMES)


@query
def load_or_fallback(s: Store) -> DataFrame:
    """Urgent needs exist, needs of severity 9 do not: 4 once, all once."""
    severe = s.needs.filter("severity = 4")
    nothing = s.needs.filter("severity = 9")
    first = readers.load_or_fallback(severe, s.needs).withColumn("taken", F.lit("primary"))
    second = readers.load_or_fallback(nothing, s.needs).withColumn("taken", F.lit("fallback"))
    return first.unionByName(second).select("iso3", "severity", "taken")


@query
def inline_rows(s: Store) -> DataFrame:
    """Literal severity rows with the number of needs of each."""
    levels = readers.inline_rows(
        s.spark, [(1, "minimal"), (2, "stressed"), (3, "crisis"), (4, "emergency")], "severity int, meaning string"
    )
    counts = s.needs.groupBy("severity").agg(F.count(F.lit(1)).alias("n_rows"))
    return levels.join(counts, "severity", "left")


@query
def save_table(s: Store) -> DataFrame:
    """Written into a database of its own, replaced once, and read back."""
    name = f"needscope_{uuid4().hex[:8]}"
    home = f"{scratch_dir(s.spark)}/{name}"
    before = s.spark.catalog.currentDatabase()
    sinks.ensure_database(s.spark, name, home)
    s.spark.catalog.setCurrentDatabase(before)
    table = f"{name}.needs"
    sinks.save_table(s.needs.select("iso3", "year"), table, path=f"{home}/narrow")
    sinks.save_table(s.needs, table, partition_by=["region"], path=f"{home}/needs")
    return s.spark.table(table)


@query
def ensure_database(s: Store) -> DataFrame:
    """Rows of a table found through the database made current."""
    name = f"needscope_{uuid4().hex[:8]}"
    before = s.spark.catalog.currentDatabase()
    try:
        sinks.ensure_database(s.spark, name, f"{scratch_dir(s.spark)}/{name}")
        sinks.save_table(s.allocations, "allocations", path=f"{scratch_dir(s.spark)}/{name}/allocations")
        found = s.spark.table("allocations")
    finally:
        s.spark.catalog.setCurrentDatabase(before)
    return found.groupBy("allocation_type").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def table_inventory(s: Store) -> DataFrame:
    return sinks.table_inventory({"needs": s.needs, "projects": s.projects, "allocations": s.allocations})


@query
def schema_report(s: Store) -> DataFrame:
    return sinks.schema_report(s.needs)


# ---- source columns ----

@query
def project_code(s: Store) -> DataFrame:
    number = F.element_at(F.split("project_code", "-"), -1).cast("bigint")
    return s.projects.select(
        "iso3", "cluster", projects.project_code(F.col("iso3"), F.col("cluster"), number).alias("project_code")
    )


@query
def beneficiaries_per_1000(s: Store) -> DataFrame:
    value = projects.beneficiaries_per_1000(F.col("target_beneficiaries"), F.col("budget_usd"))
    return s.projects.select("project_code", value.alias("beneficiaries_per_1000_usd"))


@query
def project_coverage_pct(s: Store) -> DataFrame:
    value = projects.project_coverage_pct(F.col("funding_received_usd"), F.col("budget_usd"))
    return s.projects.select("project_code", value.alias("funding_coverage_pct"))


@query
def allocation_musd(s: Store) -> DataFrame:
    return s.allocations.select(
        "iso3", "allocation_type", allocation_columns.allocation_musd(F.col("allocation_kusd")).alias("allocation_musd")
    )


@query
def sector_stats_merged(s: Store) -> DataFrame:
    """Sector figures from the states of every country and sector."""
    value = "ben_per_1000_usd"
    parts = states.group_state(s.silver_projects, ["country", "cluster"], [value])
    merged = states.merge_states(parts, ["cluster"], [value])
    return states.sector_stats(merged).join(
        merged.select("cluster", "n_rows", F.col(f"{value}.least").alias("least"), F.col(f"{value}.most").alias("most")),
        "cluster",
    )


# ---- data quality ----

@query
def dq_null_counts(s: Store) -> DataFrame:
    return quality.null_counts(s.needs)


@query
def dq_impossible_rows(s: Store) -> DataFrame:
    return quality.impossible_rows(s.needs)


@query
def dq_required_columns(s: Store) -> DataFrame:
    return quality.required_columns(s.needs.drop("severity"))


@query
def dq_contract_checks(s: Store) -> DataFrame:
    return quality.contract_checks(s.needs)


@query
def dq_gate(s: Store) -> DataFrame:
    """The report observed while needs are written, and the kept and set-aside rows by severity."""
    gated = quality.gate(s.needs, [
        *quality.needs_rules(s.needs),
        quality.Rule("own", "more_received_than_required", F.col("funding_received_musd") > F.col("required_funding_musd")),
        quality.Rule("own", "severity_of_one", F.col("severity") == 1, "set_aside"),
        quality.Rule("own", "few_people", F.col("people_in_need_millions") < 1, "set_aside"),
    ])
    report = gated.report.select(F.concat_ws(".", "check", "rule", "action").alias("item"), F.col("n_bad").alias("n_rows"))
    kept = gated.kept.groupBy(F.concat(F.lit("kept.severity."), "severity").alias("item"))
    aside = gated.aside.groupBy(F.concat(F.lit("aside."), F.concat_ws("+", "broken_rules")).alias("item"))
    rows = F.count(F.lit(1)).alias("n_rows")
    return report.unionByName(kept.agg(rows)).unionByName(aside.agg(rows))


@query
def dq_duplicate_keys(s: Store) -> DataFrame:
    return quality.duplicate_keys(s.allocations, ["iso3"])


@query
def drop_null_features(s: Store) -> DataFrame:
    return quality.dropped_report(s.silver_projects, [*clustering.FEATURES, clustering.CATEGORY])


# ---- funding metrics ----

def _metric(name: str) -> None:
    def build(s: Store) -> DataFrame:
        return s.metrics.select("iso3", name)

    QUERIES[name] = build


for _level in funding.FUNDING_LEVELS:
    for _build in _level:
        _metric(_build.__name__)


@query
def overlook_score(s: Store) -> DataFrame:
    return scoring.min_max_score(s.metrics, "overlook_score_raw", "overlook_score").select(
        "iso3", "overlook_score_raw", "overlook_score"
    )


@query
def regional_overlook_score(s: Store) -> DataFrame:
    """The same normalisation inside each region."""
    return scoring.min_max_score(s.metrics, "overlook_score_raw", "regional_score", by=["region"], bounds=s.regional_bounds).select(
        "iso3", "region", "regional_score"
    )


@query
def silver_funding(s: Store) -> DataFrame:
    return s.silver_funding


# ---- projects and outliers ----

def _project_column(name: str, source: Callable[[Store], DataFrame]) -> None:
    QUERIES[name] = lambda s: source(s).select("project_code", name)


for _build in projects.PROJECT_LEVELS[0]:
    _project_column(_build.__name__, lambda s: s.project_metrics)


def _scored(s: Store) -> DataFrame:
    return scoring.zscore(s.project_metrics, s.cfg, stats=s.sector_stats)


for _name in (
    "cluster_avg_ben_ratio", "cluster_std_ben_ratio", "ben_ratio_zscore",
    "is_efficiency_outlier", "outlier_classification",
):
    _project_column(_name, _scored)


@query
def silver_projects(s: Store) -> DataFrame:
    return s.silver_projects


@query
def outlier_count_share(s: Store) -> DataFrame:
    return outliers.outlier_counts(s.silver_projects)


@query
def outlier_count_share_by_cluster(s: Store) -> DataFrame:
    return outliers.outlier_counts(s.silver_projects, ["cluster"])


@query
def outlier_report(s: Store) -> DataFrame:
    return outliers.outlier_report(s.fixed_benchmarks)


@query
def outlier_direction_split(s: Store) -> DataFrame:
    return outliers.outlier_direction_split(s.fixed_benchmarks)


# ---- allocations ----

@query
def allocations_enriched(s: Store) -> DataFrame:
    return allocations.enrich_allocations(s.allocations, s.silver_funding)


def _allocation_column(name: str) -> None:
    QUERIES[name] = lambda s: allocation_columns.add_allocation_metrics(
        allocations.enrich_allocations(s.allocations, s.silver_funding), s.cfg
    ).select("iso3", "allocation_type", name)


for _build in allocation_columns.ALLOCATION_LEVELS[0]:
    _allocation_column(_build.__name__)


@query
def silver_allocations(s: Store) -> DataFrame:
    return s.silver_allocations


@query
def allocation_mismatch_count(s: Store) -> DataFrame:
    return allocations.allocation_mismatch_count(s.silver_allocations)


@query
def allocations_by_country(s: Store) -> DataFrame:
    return allocations.allocations_by(s.allocations)


# ---- rankings and business tables ----

@query
def global_overlook_rank(s: Store) -> DataFrame:
    scores = s.silver_funding.select("iso3", "overlook_score")
    return scoring.global_rank(scores, "overlook_score", "global_overlook_rank", s.global_ranks)


@query
def regional_overlook_rank(s: Store) -> DataFrame:
    scores = s.silver_funding.select("iso3", "region", "overlook_score")
    return scoring.rank_within(scores, ["region"], "overlook_score", "regional_overlook_rank", s.regional_ranks)


def _ranking_column(build: funding.Builder) -> None:
    QUERIES[build.__name__] = lambda s: s.silver_funding.select(
        "iso3", build(s.cfg).alias(build.__name__)
    )


for _build in (funding.attention_priority, funding.cbpf_adequacy, funding.key_insight):
    _ranking_column(_build)


def _mismatch_column(build: funding.Builder) -> None:
    QUERIES[build.__name__] = lambda s: s.rankings.select("iso3", build(s.cfg).alias(build.__name__))


for _build in (funding.mismatch_score, funding.recommended_additional_cbpf_musd):
    _mismatch_column(_build)


@query
def gold_rankings_of_year(s: Store) -> DataFrame:
    """The last year of needs by itself, from sources and into tables partitioned by year."""
    home = f"{scratch_dir(s.spark)}/by-year-{uuid4().hex}"
    sources = {name: settle(df, name, partition_by=["year"]) for name, df in (("needs", s.needs), ("allocations", s.allocations))}
    year = s.needs.agg(F.max("year")).first()[0]
    medallion.run_funding(sources, medallion.year_sink(s.spark, home, year), replace(s.cfg, year=year))
    return sinks.read_years(s.spark, f"{home}/gold_rankings")


@query
def gold_rankings(s: Store) -> DataFrame:
    return rollups.by_rank(s.rankings)


@query
def top_overlooked(s: Store) -> DataFrame:
    return rollups.top_n(s.rankings, [F.col("global_overlook_rank")], 10, "iso3").select(
        "global_overlook_rank", "country", "people_in_need_millions", "required_funding_musd",
        "funding_received_musd", "coverage_rate_pct", "overlook_score", "attention_priority",
    )


@query
def top5_overlooked(s: Store) -> DataFrame:
    return rollups.top_n(s.silver_funding, [F.col("global_overlook_rank")], 5, "iso3").select(
        "global_overlook_rank", "country", "severity", "people_in_need_millions",
        "coverage_rate_pct", "funding_gap_musd", "overlook_score", "funding_category",
    )


@query
def regional_summary(s: Store) -> DataFrame:
    return rollups.regional_summary(s.rankings).orderBy(F.desc("avg_overlook_score"), "region")


@query
def cluster_summary(s: Store) -> DataFrame:
    return rollups.cluster_summary(s.rankings).orderBy(F.desc("avg_overlook_score"), "cluster")


@query
def gold_mismatch(s: Store) -> DataFrame:
    return s.mismatch.orderBy(F.desc("mismatch_score"), "iso3")


@query
def executive_summary(s: Store) -> DataFrame:
    return rollups.executive_summary(s.rankings, s.silver_projects)


@query
def top_findings(s: Store) -> DataFrame:
    return rollups.top_findings(s.rankings, s.cfg)


@query
def low_engagement_count(s: Store) -> DataFrame:
    return rollups.low_engagement(s.mismatch, s.cfg)


# ---- groups and comparables ----

@query
def index_category(s: Store) -> DataFrame:
    return clustering.index_category(s.silver_projects.select("project_code", "cluster"))


@query
def assemble_features(s: Store) -> DataFrame:
    columns = [*clustering.FEATURES]
    vectors = clustering.assemble_features(s.silver_projects.select("project_code", *columns), columns)
    values = clustering.vector_to_array("raw_features")
    return vectors.select("project_code", *[values[i].alias(f"feature_{i}") for i in range(len(columns))])


@query
def scale_features(s: Store) -> DataFrame:
    columns = list(clustering.FEATURES)
    scaled = clustering.scale_features(s.silver_projects.select("project_code", *columns), columns)
    wide = clustering.scaled_columns(scaled, columns)
    return wide.select("project_code", *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in columns])


@query
def kmeans_groups(s: Store) -> DataFrame:
    """Whether each project is in the group whose centre is nearest; ids are arbitrary."""
    return clustering.in_nearest_group(s.clustered, s.group_model).select("project_code", "in_nearest_group")


@query
def silhouette(s: Store) -> DataFrame:
    """Of the fixed budget groups, which SQL can form too."""
    scaled = clustering.scale_features(s.fixed_benchmarks, clustering.FEATURES)
    return clustering.quality(scaled, s.cfg).withColumn("silhouette", F.round("silhouette", 6))


@query
def kmeans_sweep(s: Store) -> DataFrame:
    """What holds for any fit: all projects in a group, figures within bounds, one best k."""
    found = clustering.sweep(clustering.clean_features(s.silver_projects), range(4, 10), s.cfg)
    k, n = F.col("k"), F.col("n_projects")
    return found.select(
        "k", "n_projects",
        F.col("silhouette").between(-1, 1).alias("silhouette_in_bounds"),
        ((F.col("min_size") * k <= n) & (F.col("max_size") * k >= n)).alias("sizes_in_bounds"),
        found.agg(F.count_if("is_best")).scalar().alias("n_best"),
    )


@query
def gold_benchmarks(s: Store) -> DataFrame:
    """The benchmark table; of the fitted group only that it is there, its id is arbitrary."""
    table = clustering.benchmarks(clustering.label_groups(s.clustered, s.cfg))
    return table.select(
        *[name for name in table.columns if name not in ("benchmark_group", "benchmark_label")],
        F.col("benchmark_group").isNotNull().alias("has_group"),
        F.col("benchmark_label").isNotNull().alias("has_label"),
    )


@query
def fixed_benchmarks(s: Store) -> DataFrame:
    return s.fixed_benchmarks


@query
def group_sizes(s: Store) -> DataFrame:
    return clustering.group_sizes(s.fixed_benchmarks)


@query
def group_profiles(s: Store) -> DataFrame:
    return clustering.group_profiles(s.fixed_benchmarks).orderBy("avg_budget_musd", "benchmark_group")


@query
def group_labels(s: Store) -> DataFrame:
    grouped = star.fixed_groups(s.silver_projects).select("project_code", "budget_usd", "benchmark_group")
    return clustering.label_groups(grouped, s.cfg).select("project_code", "benchmark_group", "benchmark_label")


def _strongest_outlier(s: Store) -> DataFrame:
    return rollups.top_n(s.fixed_benchmarks, [F.abs("ben_ratio_zscore").desc()], 1, "project_code")


@query
def comparables_for_project(s: Store) -> DataFrame:
    """For the project farthest from its sector mean."""
    return comparables.comparables_of(s.fixed_benchmarks, _strongest_outlier(s), cfg=s.cfg)


@query
def comparables_lookup(s: Store) -> DataFrame:
    """The same from the files of an index, of which it opens the folders that it needs."""
    return s.comparable_index.nearest(_strongest_outlier(s).first()["project_code"], cfg=s.cfg)


@query
def comparables_all(s: Store) -> DataFrame:
    return comparables.comparables_all(s.fixed_benchmarks, settle, cfg=s.cfg)


@query
def comparables_fitted(s: Store) -> DataFrame:
    """What holds for any fit: projects put into saved groups, and their comparables."""
    home = f"{scratch_dir(s.spark)}/group-model-{uuid4().hex}"
    clustering.save_group_model(clustering.fit_group_model(s.silver_projects, s.cfg), home)
    table = settle(clustering.load_group_model(s.spark, home).benchmarks(s.silver_projects), "fitted-benchmarks")
    found = comparables.comparables_all(table, settle, cfg=s.cfg)
    block = [*comparables.BLOCK]
    own = table.select("project_code", *block, "benchmark_label")
    other = own.select(F.col("project_code").alias("comparable_code"), *[F.col(c).alias(f"other_{c}") for c in block])
    paired = found.join(own.drop("benchmark_label"), "project_code").join(other, "comparable_code")
    same = F.col("benchmark_group").eqNullSafe(F.col("other_benchmark_group")) & (F.col("cluster") == F.col("other_cluster"))
    told = paired.groupBy("project_code").agg(
        F.count(F.lit(1)).alias("n"), F.max("comparable_rank").alias("last"), F.count_distinct("comparable_code").alias("codes"),
        F.every(same & (F.col("comparable_code") != F.col("project_code"))).alias("fits"),
    )
    sizes = table.groupBy(*block).agg(F.count(F.lit(1)).alias("size"))
    n = F.coalesce("n", F.lit(0))
    return own.join(sizes, block).join(told, "project_code", "left").select(
        "project_code",
        F.coalesce("fits", F.lit(True)).alias("in_same_block"),
        (n == F.least(F.col("size") - 1, F.lit(s.cfg.neighbours))).alias("as_many_as_there_are"),
        F.coalesce((F.col("last") == n) & (F.col("codes") == n), F.lit(True)).alias("ranks_without_gap"),
        F.col("benchmark_label").isNotNull().alias("has_label"),
    )


@query
def comparables_all_split(s: Store) -> DataFrame:
    """The same over small cells, so that blocks are split in several rounds."""
    return comparables.comparables_all(s.fixed_benchmarks, settle, cfg=replace(s.cfg, leaf_rows=16))


@query
def efficiency_vs_cluster(s: Store) -> DataFrame:
    return projects.efficiency_vs_cluster(s.silver_projects, s.cfg).select(
        "project_code", F.round("efficiency_diff_pct", 6).alias("efficiency_diff_pct"), "efficiency_verdict"
    )


@query
def benchmark_report(s: Store) -> DataFrame:
    return comparables.report_columns(_strongest_outlier(s))


@query
def demo_projects(s: Store) -> DataFrame:
    return comparables.demo_projects(s.fixed_benchmarks, s.rankings)


# ---- dashboard tables ----

@query
def panel_kpis(s: Store) -> DataFrame:
    return panels.panel_kpis(s.rankings)


@query
def panel_top15(s: Store) -> DataFrame:
    return panels.panel_top15(s.rankings)


@query
def panel_regional(s: Store) -> DataFrame:
    return panels.panel_regional(rollups.regional_summary(s.rankings))


@query
def panel_cluster(s: Store) -> DataFrame:
    return panels.panel_cluster(rollups.cluster_summary(s.rankings))


@query
def panel_mismatch(s: Store) -> DataFrame:
    return panels.panel_mismatch(s.mismatch)


@query
def panel_outliers(s: Store) -> DataFrame:
    return panels.panel_outliers(s.fixed_benchmarks)


@query
def panel_groups(s: Store) -> DataFrame:
    return panels.panel_groups(s.fixed_benchmarks)


@query
def panel_watch_list(s: Store) -> DataFrame:
    return panels.panel_watch_list(s.rankings)


# ---- chart data ----

@query
def chart_map_points(s: Store) -> DataFrame:
    return charts.chart_map_points(s.rankings)


@query
def chart_bubble(s: Store) -> DataFrame:
    return charts.chart_bubble(s.rankings)


@query
def chart_gap_bars(s: Store) -> DataFrame:
    return charts.chart_gap_bars(s.rankings)


@query
def chart_pooled_scatter(s: Store) -> DataFrame:
    return charts.chart_pooled_scatter(s.mismatch)


@query
def chart_pooled_bars(s: Store) -> DataFrame:
    return charts.chart_pooled_bars(s.mismatch, s.cfg)


@query
def chart_efficiency_hist(s: Store) -> DataFrame:
    return charts.chart_efficiency_hist(s.silver_projects, ranges=s.efficiency_ranges)


@query
def chart_efficiency_limits(s: Store) -> DataFrame:
    return charts.chart_efficiency_limits(s.silver_projects, s.cfg)


@query
def chart_outlier_marks(s: Store) -> DataFrame:
    return charts.chart_outlier_marks(s.silver_projects)


# ---- small operators ----

@query
def distinct_values(s: Store) -> DataFrame:
    return s.projects.select("cluster").distinct()


@query
def distinct_count(s: Store) -> DataFrame:
    return s.projects.agg(F.count_distinct("country").alias("n_countries"))


@query
def top_efficient_projects(s: Store) -> DataFrame:
    return rollups.top_n(s.projects, [F.desc("beneficiaries_per_1000_usd")], 5, "project_code")
