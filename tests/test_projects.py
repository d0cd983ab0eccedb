import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from needscope.config import Config
from needscope.functions import projects as columns
from needscope.functions.projects import add_project_metrics, efficiency_vs_cluster
from needscope.operators import charts, clustering, comparables, lookup, outliers, quality, scoring, states
from needscope.plans import medallion
from needscope.sources import sinks
from needscope.sources.scratch import settle
from tests import golden


def random_projects(seed, n, clusters=("Food", "Health")):
    rng = random.Random(seed)
    return [
        (f"SDN-{i:05d}", rng.choice(clusters), rng.randint(200_000, 3_000_000),
         rng.randint(1_000, 400_000), rng.randint(0, 3_000_000))
        for i in range(n)
    ]


def test_project_code_is_padded_and_never_cut(spark):
    df = spark.createDataFrame([("SDN", "wash", 7), ("SDN", "wash", 123456)], "i string, c string, n long")
    codes = [r[0] for r in df.select(columns.project_code(F.col("i"), F.col("c"), F.col("n"))).collect()]
    assert codes == ["SDN-WAS-0007", "SDN-WAS-123456"]


def test_given_ratio_wins_over_computed(spark):
    df = golden.projects(spark, [("a", "x", 1000, 50, 100), ("b", "x", 0, 50, 100)])
    given = df.withColumn("beneficiaries_per_1000_usd", F.when(F.col("project_code") == "a", 7.0))
    rows = {r.project_code: r.ben_per_1000_usd for r in add_project_metrics(given).collect()}
    assert rows == {"a": 7.0, "b": None}


def test_zscore_methods_agree(spark):
    df = add_project_metrics(golden.projects(spark, random_projects(1, 400))).cache()
    joined, windowed = scoring.zscore(df), scoring.zscore(df, method="window")
    assert joined.select(windowed.columns).exceptAll(windowed).isEmpty()
    means = joined.groupBy("cluster").agg(F.avg("ben_ratio_zscore")).collect()
    assert all(abs(r[1]) < 0.01 for r in means)
    with pytest.raises(ValueError):
        scoring.zscore(df, method="other")


def test_lonely_and_constant_sectors(spark):
    rows = [("a", "alone", 1000, 50, 0), ("b", "same", 1000, 20, 0), ("c", "same", 1000, 20, 0)]
    silver = medallion.silver_projects(golden.projects(spark, rows))
    found = {r.project_code: r for r in silver.collect()}
    assert found["a"].cluster_std_ben_ratio is None and found["a"].ben_ratio_zscore == 0.0
    assert found["b"].cluster_std_ben_ratio == 0.0 and not found["b"].is_efficiency_outlier
    assert len(silver.columns) == 20
    hist = charts.chart_efficiency_hist(silver).filter("cluster = 'same'").collect()
    assert len(hist) == 12 and sum(r.n_projects for r in hist) == 2


def test_outlier_labels(spark):
    df = spark.createDataFrame([(2.1,), (2.0,), (1.5,), (-1.6,), (-2.1,), (None,)], "ben_ratio_zscore double")
    labels = [r[0] for r in df.select(columns.outlier_classification(Config())).collect()]
    assert [label.split(" ", 1)[1] for label in labels] == [
        "Highly Efficient — Investigate for scale-up", "Above Average Efficiency — Monitor",
        "Within Normal Range", "Below Average Efficiency — Review methodology",
        "Very Low Efficiency — Investigate bottleneck", "Within Normal Range",
    ]


def test_outlier_reports_add_up(spark):
    silver = medallion.silver_projects(golden.projects(spark, random_projects(2, 300))).cache()
    split = outliers.outlier_direction_split(silver).first()
    assert split.total_outliers == split.high_efficiency + split.low_efficiency
    assert outliers.outlier_report(silver).count() == split.total_outliers
    assert outliers.outlier_report(silver, 3).count() == min(3, split.total_outliers)
    hist = charts.chart_efficiency_hist(silver).agg(F.sum("n_projects")).first()[0]
    assert hist == 300 - split.total_outliers
    limits = charts.chart_efficiency_limits(silver).collect()
    assert sum(r.n_outliers for r in limits) == split.total_outliers
    verdicts = efficiency_vs_cluster(silver).groupBy("efficiency_verdict").count().collect()
    assert sum(r["count"] for r in verdicts) == 300


# ---- groups ----

def test_kmeans_end_to_end(spark):
    silver = medallion.silver_projects(golden.projects(spark, random_projects(3, 200))).cache()
    gold = medallion.gold_benchmarks(silver).cache()
    assert gold.columns == list(clustering.BENCHMARK_COLUMNS) and gold.count() == 200
    assert gold.select("benchmark_group").distinct().count() == 6
    by_label = clustering.group_profiles(gold.withColumn("benchmark_group", F.col("benchmark_label"))).orderBy(
        "benchmark_group"
    )
    budgets = [r.avg_budget_musd for r in by_label.collect()]
    assert budgets == sorted(budgets)
    places = clustering.category_places(silver)
    indexed = clustering.index_category(silver, places=places)
    model = clustering.fit_groups(indexed)
    assigned = clustering.assign_groups(model, indexed)
    assert clustering.in_nearest_group(assigned, model).filter("not in_nearest_group").isEmpty()
    row = clustering.quality(assigned).first()
    assert -1 <= row.silhouette <= 1 and row.verdict in ("good", "acceptable", "weak")
    unseen = clustering.index_category(silver.limit(3).withColumn("cluster", F.lit("never seen")), places=places)
    assert {r.cluster_index for r in unseen.collect()} == {2.0}
    assert clustering.assign_groups(model, unseen).count() == 3
    single = clustering.quality(assigned.withColumn("benchmark_group", F.lit(0))).first()
    assert single.silhouette is None and single.verdict == "single group"


def test_sweep_names_one_best(spark):
    silver = medallion.silver_projects(golden.projects(spark, random_projects(4, 120)))
    rows = clustering.sweep(silver, [2, 3, 4]).collect()
    assert [r.k for r in rows] == [2, 3, 4] and sum(r.is_best for r in rows) == 1
    best = max(rows, key=lambda r: r.silhouette)
    assert best.is_best


def sweep_points(spark, n=300):
    silver = medallion.silver_projects(golden.projects(spark, random_projects(4, n)))
    scaled = clustering.scale_features(clustering.clean_features(silver), clustering.FEATURES)
    return scaled.select("project_code", "features", clustering.vector_to_array("features").alias("x")).cache()


def test_sweep_figures_equal_those_of_the_evaluator(spark):
    rows = sweep_points(spark)
    points, cfg = rows.select("x"), Config()
    centres = clustering.move_centres(points, clustering.first_centres(points, [2, 5], cfg), cfg)
    sums = clustering.group_sums(points, centres)
    scores = clustering.silhouettes(points, centres, sums)
    x = np.array([r.x for r in points.collect()])
    for k in (2, 5):
        own = ((x[:, None] - centres[k]) ** 2).sum(2).argmin(1)
        means = np.array([x[own == g].mean(0) for g in range(k)])
        assert np.bincount(own, minlength=k).tolist() == sums[k][:, -1].tolist()
        assert np.abs(means - centres[k]).max() < 1e-3  # at rest
        numbered = spark.createDataFrame([(list(map(float, p)), int(g)) for p, g in zip(x, own)], "x array<double>, benchmark_group int")
        vectors = numbered.select(array_to_vector("x").alias("features"), "benchmark_group")
        assert scores[k] == pytest.approx(clustering._silhouette(vectors), abs=1e-9)


def test_sweep_scans_do_not_grow_with_the_number_of_k(spark):
    points = sweep_points(spark).select("x")
    cfg, context = Config(max_iter=4, tol=0.0), spark.sparkContext
    jobs = []
    for ks in ([6], [3, 4, 5, 6, 7, 8]):
        context.setJobGroup(f"sweep-{len(ks)}", "")
        clustering.move_centres(points, clustering.first_centres(points, ks, cfg), cfg)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"sweep-{len(ks)}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[1] <= jobs[0]  # each k alone would take its own


def test_sweep_of_few_distinct_projects(spark):
    rows = [(f"p{i}", "A", 1000 * (1 + i % 2), 5, 1) for i in range(8)]
    found = {r.k: r for r in clustering.sweep(medallion.silver_projects(golden.projects(spark, rows)), [1, 2, 3]).collect()}
    assert found[1].silhouette is None and found[2].silhouette == pytest.approx(1) and found[3].min_size == 0
    assert all(r.n_projects == 8 for r in found.values())


def test_group_model_is_kept_by_version(spark, tmp_path):
    old = medallion.silver_projects(golden.projects(spark, random_projects(3, 200))).cache()
    new = medallion.silver_projects(golden.projects(spark, [*random_projects(9, 50), ("new", "Unseen sector", 500_000, 1_000, 1)])).cache()
    folder = str(tmp_path / "models")
    with pytest.raises(LookupError):
        clustering.load_group_model(spark, folder)
    first = clustering.fit_group_model(old)
    assert clustering.save_group_model(first, folder) == 1
    assert clustering.save_group_model(clustering.fit_group_model(old, Config(groups=3)), folder) == 2
    (tmp_path / "models" / "fit-of-a-lost-job").mkdir()
    told = lambda df: sorted((r.project_code, r.benchmark_group, r.benchmark_label) for r in df.collect())
    again = clustering.load_group_model(spark, folder, 1)
    assert told(again.benchmarks(new)) == told(first.benchmarks(new)) and len(told(again.benchmarks(new))) == 51
    assert told(again.benchmarks(old)) == told(medallion.gold_benchmarks(old, groups=first))
    assert {g for _, g, _ in told(clustering.load_group_model(spark, folder).benchmarks(old))} == {0, 1, 2}
    pairs = comparables.comparables_all(settle(again.benchmarks(new), "b"), settle).collect()
    group = {code: g for code, g, _ in told(again.benchmarks(new))}
    assert pairs and all(group[r.project_code] == group[r.comparable_code] and r.project_code != r.comparable_code for r in pairs)


def test_dominant_sector_and_index_ties_go_by_name(spark):
    rows = [("a", "B", 1000, 5, 1), ("b", "A", 1000, 5, 1), ("c", "A", 1000, 5, 1), ("d", "B", 1000, 5, 1)]
    df = medallion.silver_projects(golden.projects(spark, rows)).withColumn("benchmark_group", F.lit(0))
    assert clustering.group_profiles(df).first().dominant_cluster == "A"
    index = {r.cluster: r.cluster_index for r in clustering.index_category(df).collect()}
    assert index == {"A": 0.0, "B": 1.0}


def test_any_number_of_categories(spark):
    n = 120_000
    names = F.format_string("c%06d", F.lit(n - 1) - F.col("id"))
    df = spark.range(n).select(names.alias("cluster")).union(spark.sql("select 'c000007' union all select null"))
    got = clustering.index_category(df)
    wide = F.col("cluster_index").cast("long")
    assert got.select(wide).distinct().count() == n + 1
    # the repeated one comes first, the others by name, null last
    number = F.substring("cluster", 2, 6).cast("long")
    expected = F.when(number == 7, 0).when(number < 7, number + 1).when(number > 7, number).otherwise(n)
    assert got.filter(wide != expected).isEmpty()


def test_labels_follow_the_budget_and_then_run_out(spark):
    """Any ids; places beyond the six texts get a plain label."""
    df = spark.createDataFrame([(g, 100.0 - g) for g in range(1, 9)], "benchmark_group int, budget_usd double")
    labels = {r.benchmark_group: r.benchmark_label for r in clustering.label_groups(df).collect()}
    assert [labels[g][:7] for g in range(8, 2, -1)] == [f"Group {letter}" for letter in "ABCDEF"]
    assert labels[2] == "Group 2" and labels[1] == "Group 1"


# ---- comparables ----

def benchmark_rows(spark, rows):
    silver = medallion.silver_projects(golden.projects(spark, rows))
    grouped = silver.withColumns({"benchmark_group": F.expr("cast(budget_usd > 1500000 as int)"),
                                  "benchmark_label": F.lit("x")})
    return clustering.benchmarks(grouped)


def brute_force(bench, n):
    """All pairs with the same Spark distance expression as a single lookup."""
    other = bench.select(*[F.col(c).alias(f"o_{c}") for c in bench.columns])
    pairs = bench.join(other, (F.col("cluster") == F.col("o_cluster"))
                       & (F.col("benchmark_group") == F.col("o_benchmark_group"))
                       & (F.col("project_code") != F.col("o_project_code")))
    logs = F.abs(F.ln(F.greatest("budget_usd", F.lit(1))) - F.ln(F.greatest("o_budget_usd", F.lit(1))))
    dist = F.round(
        F.abs(F.col("ben_per_1000_usd") - F.col("o_ben_per_1000_usd")) * 0.5
        + F.abs(F.col("funding_coverage_pct") - F.col("o_funding_coverage_pct")) * 0.3 + logs * 5, 9)
    best: dict[str, list] = {}
    shown = F.round("d", 3).alias("shown")
    for r in pairs.select("project_code", dist.alias("d"), F.col("o_project_code").alias("o")).select("*", shown).collect():
        best.setdefault(r.project_code, []).append((r.d, r.o, r.shown))
    return {code: [(shown, o) for _, o, shown in sorted(found)[:n]] for code, found in best.items()}


def all_in_one_job(bench, n, leaf_rows):
    rows = comparables.comparables_all(bench, settle, n, Config(leaf_rows=leaf_rows)).collect()
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r.comparable_rank):
        found.setdefault(r.project_code, []).append((r.similarity_distance, r.comparable_code))
    return found


@pytest.mark.parametrize("leaf_rows", [6, 25, 1000])
def test_comparables_all_equals_brute_force(spark, leaf_rows):
    bench = benchmark_rows(spark, random_projects(5, 500)).cache()
    assert all_in_one_job(bench, 5, leaf_rows) == brute_force(bench, 5)


def test_comparables_with_a_third_of_equal_projects(spark):
    """One hot place, a tight crowd, a far outlier and a tiny block."""
    rng = random.Random(6)
    rows = [(f"HOT-{i:04d}", "Food", 1_000_000, 50_000, 500_000) for i in range(120)]
    rows += [(f"TIE-{i:04d}", "Food", 1_000_000 + i, 50_000, 500_000) for i in range(120)]
    rows += [(f"RND-{i:04d}", "Food", rng.randint(200_000, 1_400_000), rng.randint(1, 900_000), 7) for i in range(120)]
    rows += [("FAR-0001", "Food", 1_400_000, 1_400_000_000, 0), ("O'K-0001", "Logistics", 900, 5, 1),
             ("O'K-0002", "Logistics", 800, 5, 1)]
    bench = benchmark_rows(spark, rows).cache()
    expected = brute_force(bench, 4)
    assert all_in_one_job(bench, 4, 8) == expected
    assert len(expected["O'K-0001"]) == 1


def test_a_tight_crowd_is_not_paired(spark):
    """Budgets one dollar apart around ten billion: pairs grow with the places."""
    cfg = Config(leaf_rows=64)
    for n in (4_000, 16_000):
        crowd = spark.range(n).select(
            F.format_string("P-%06d", "id").alias("project_code"), F.lit(0).alias("benchmark_group"),
            F.lit("Food").alias("cluster"), F.lit(1.0).alias("ben_per_1000_usd"),
            F.lit(50.0).alias("funding_coverage_pct"), (F.col("id") + 10_000_000_000).alias("budget_usd"),
        )
        places = settle(comparables._places(crowd, 5, cfg), "places")
        cells, splits = comparables._split_cells(places.drop("codes"), settle, cfg.leaf_rows)
        assert cells.count() == n and cells.select("place_id").distinct().count() == n
        visits = comparables._visits(comparables._with_reach(cells, 5), cells, splits)
        hosts = cells.join(places.select("place_id", "codes"), "place_id")
        assert comparables._pairs_in_reach(visits, hosts, cfg).count() < 50 * n


def test_children_of_small_cells_share_their_search(spark):
    """Cells of two or three places: the reach is that of the cell they were split from,
    and one call of Python takes many cells, however batches cut them."""
    rng, n, cfg = random.Random(16), 3_000, Config(leaf_rows=16)
    rows = [(f"P-{i:05d}", i % 3, "Food", 40 * rng.random(), 100 * rng.random(), rng.randint(1, 10**6)) for i in range(n)]
    bench = spark.createDataFrame(rows, ["project_code", "benchmark_group", "cluster", *comparables.AXES])
    places = settle(comparables._places(bench, 5, cfg), "places")
    cells, splits = comparables._split_cells(places.drop("codes"), settle, cfg.leaf_rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        reached = comparables._with_reach(cells, 5)
        assert "FlatMapGroups" not in reached._jdf.queryExecution().executedPlan().toString()
        found = {r.place_id: r.reach for r in reached.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    around: dict[tuple, list] = {}
    for r in cells.collect():
        around.setdefault((r.benchmark_group, r.around), []).append(r)
    assert len(found) == n and len(around) < cells.select(*comparables.CELL).distinct().count() / 2
    for near in around.values():
        for r in near:
            gaps = sorted(abs(r.x0 - o.x0) + abs(r.x1 - o.x1) + abs(r.x2 - o.x2) for o in near)
            assert found[r.place_id] == pytest.approx(min(r.reach, gaps[5]) if len(near) > 5 else r.reach)

    visits = comparables._visits(comparables._with_reach(cells, 5), cells, splits)
    hosts = cells.join(places.select("place_id", "codes"), "place_id")
    assert comparables._pairs_in_reach(visits, hosts, cfg).count() < 25 * n


def test_single_lookup_agrees_with_all(spark):
    rows = random_projects(7, 80, ("Food",)) + [("it's \"quoted\"", "Food", 500_000, 2_000, 100)]
    bench = benchmark_rows(spark, rows).cache()
    expected = brute_force(bench, 5)
    for code in ("SDN-00003", "it's \"quoted\""):
        found = comparables.comparables_for(bench, code).collect()
        assert [(r.similarity_distance, r.project_code) for r in found] == expected[code]
        assert comparables.benchmark_report(bench, code).count() == 1
    assert comparables.comparables_for(bench, "unknown").count() == 0
    assert comparables.benchmark_report(bench, "unknown").count() == 0


def test_deviation_is_the_same_in_any_row_order(spark):
    rows = [(i, "a", 0.1 * i * i + 1 / (i + 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, cluster string, ben_per_1000_usd double")
    found = set()
    for parts in (1, 3, 7, 16):
        found.add(scoring.sector_stats(df.repartition(parts, "id")).first()["cluster_std_ben_ratio"])
    assert len(found) == 1


def test_nan_rows_are_dropped_and_reported(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert quality.drop_null_features(df, ["x"]).count() == 1
    assert tuple(quality.dropped_report(df, ["x"]).first()) == (3, 1, 2)


def test_merged_states_have_the_bits_of_one_run(spark, tmp_path):
    sectors = ("Food", "Health", None)
    rows = [(code, cluster, None if i % 17 == 0 else budget, people, received)
            for i, (code, cluster, budget, people, received) in enumerate(random_projects(21, 400, sectors))]
    whole = add_project_metrics(golden.projects(spark, rows)).withColumn("part", F.crc32("project_code") % 2).cache()
    value, by = "ben_per_1000_usd", ["cluster"]
    told = lambda df: sorted(map(str, df.collect()))
    expected = told(scoring.sector_stats(whole))
    states_of = lambda df: states.merge_states(df, by, [value])
    assert told(states.sector_stats(states_of(states.group_state(whole, ["part", *by], [value])))) == expected
    bounds = states.score_bounds(states.group_state(whole, by, [value]), value, by)
    assert told(bounds) == told(scoring.score_bounds(whole, value, by))

    before = spark.catalog.currentDatabase()
    sinks.ensure_database(spark, "states_test", str(tmp_path / "db"))
    spark.catalog.setCurrentDatabase(before)
    take = lambda df, batch: states.update_states(df, "states_test.sectors", batch, by, [value], str(tmp_path / "files"))
    first, second = whole.filter("part = 0"), whole.filter("part = 1")
    assert told(states.sector_stats(take(first, "a"))) == told(scoring.sector_stats(first))
    take(second.limit(3), "b")
    for batch, df in (("b", second), ("a", first), ("nothing", whole.limit(0))):
        assert told(states.sector_stats(take(df, batch))) == expected
    assert take(first, "a").agg(F.sum("n_rows")).first()[0] == 400
    again = medallion.silver_projects(whole.drop("part"), stats=states.sector_stats(take(first, "a")))
    assert told(again.select("project_code", "ben_ratio_zscore")) == told(
        medallion.silver_projects(whole.drop("part")).select("project_code", "ben_ratio_zscore"))
    for clash in ([["batch"], ["x"]], [["x"], ["n_rows"]], [["x"], ["X"]]):
        with pytest.raises(ValueError, match="names of their own"):
            states.group_state(whole, *clash)


# ---- lookups from files ----

def nearest_of(index, code, n=5, cfg=Config()):
    return [(r.similarity_distance, r.project_code) for r in index.nearest(code, n, cfg).collect()]


def test_lookup_files_agree_with_brute_force(spark, tmp_path):
    """Random projects, a hot place, a far outlier, a tiny block, quotes in a code."""
    rows = random_projects(11, 400) + [(f"HOT-{i:04d}", "Food", 1_000_000, 50_000, 500_000) for i in range(200)]
    rows += [("FAR-0001", "Food", 1_400_000, 1_400_000_000, 0), ("O'K-1", "Logistics", 900, 5, 1), ("O'K-2", "Logistics", 800, 5, 1)]
    bench = benchmark_rows(spark, rows).cache()
    expected = brute_force(bench, 5)
    lookup.write_index(bench.withColumn("cell", F.lit("x")), f"{tmp_path}/index", settle, most=6, cfg=Config(leaf_rows=16), part_places=64)
    index = lookup.open_index(spark, f"{tmp_path}/index")
    for code in ("SDN-00000", "SDN-00123", "HOT-0000", "HOT-0199", "FAR-0001", "O'K-1"):
        assert nearest_of(index, code) == expected[code], code
    assert index.nearest("unknown").columns == comparables.comparables_for(bench, "x").columns
    assert nearest_of(index, "unknown") == [] == nearest_of(index, "HOT-0000", 0)
    other = Config(efficiency_weight=3.0, coverage_weight=0.01, budget_weight=0.5)
    for code in ("SDN-00123", "HOT-0007"):
        by_scan = comparables.comparables_for(bench, code, 6, other).collect()
        assert index.nearest(code, 6, other).collect() == by_scan
    with pytest.raises(ValueError):
        index.nearest("SDN-00000", 7)


def test_lookup_reads_the_folders_within_reach(spark, tmp_path):
    bench = benchmark_rows(spark, random_projects(12, 1_500, ("Food",)))
    index = lookup.write_index(bench, f"{tmp_path}/index", settle, cfg=Config(leaf_rows=16), part_places=32)
    folders = len(list((tmp_path / "index" / "rows").glob("part=*")))
    assert folders > 25
    for code in ("SDN-00001", "SDN-00222"):
        read = {file.rsplit("/", 2)[1] for file in index.nearest(code).inputFiles() if "/rows/" in file}
        assert 0 < len(read) < folders / 4
        codes = {file.rsplit("/", 2)[1] for file in index.nearest(code).inputFiles() if "/codes/" in file}
        assert len(codes) == 1


def test_lookup_of_an_empty_table_and_of_gaps(spark, tmp_path):
    bench = benchmark_rows(spark, random_projects(13, 30)).cache()
    empty = lookup.write_index(bench.limit(0), f"{tmp_path}/empty", settle)
    assert nearest_of(empty, "SDN-00001") == []
    gaps = bench.withColumn("budget_usd", F.when(F.col("project_code") > "SDN-00020", F.col("budget_usd")))
    index = lookup.write_index(gaps.unionByName(gaps), f"{tmp_path}/gaps", settle)
    assert nearest_of(index, "SDN-00001") == []
    assert nearest_of(index, "SDN-00025") == brute_force(gaps.dropna(), 5)["SDN-00025"]
