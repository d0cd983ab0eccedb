import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from needscope.config import Config
from needscope.functions.funding import add_funding_metrics
from needscope.operators import allocations, charts, quality, rollups, scoring
from needscope.plans import medallion
from tests import golden

# rank, iso3, gap, coverage %, raw score, score, gap coverage %, overlooked, mismatch, additional
GOLDEN = [
    (1, "SDN", 1988.0, 22.7, 1269.8413, 100.0, 1.72, True, 98.28, 264.0),
    (2, "COD", 1665.0, 37.1, 1009.1644, 79.25, 6.77, True, 73.88, 137.1),
    (3, "AFG", 1665.0, 48.5, 934.1861, 73.29, 5.36, False, 69.36, 160.6),
    (4, "YEM", 1935.0, 55.4, 623.9393, 48.6, 3.48, False, 46.91, 223.0),
    (5, "MMR", 646.0, 34.1, 464.7887, 35.93, 4.43, True, 34.34, 68.3),
    (13, "UKR", 394.0, 90.8, 144.7137, 10.46, 3.07, False, 10.14, 47.0),
    (17, "HTI", 366.0, 49.2, 100.6711, 6.95, 18.33, False, 5.68, 0.0),
    (23, "MOZ", 144.0, 48.2, 17.4274, 0.33, 13.75, False, 0.28, 1.8),
    (24, "LBY", 143.0, 42.1, 13.2985, 0.0, 13.08, False, 0.0, 2.8),
]


def counts(df, column):
    return {row[0]: row[1] for row in df.groupBy(column).count().collect()}


def test_golden_rows(spark):
    silver = medallion.silver_funding(golden.needs(spark))
    assert len(silver.columns) == 26
    ranked = rollups.rankings(silver)
    assert len(ranked.columns) == 28 and ranked.count() == 25
    mismatch = rollups.mismatch(ranked).select("iso3", "mismatch_score", "recommended_additional_cbpf_musd")
    found = silver.join(mismatch, "iso3").select(
        "global_overlook_rank", "iso3", "funding_gap_musd", "coverage_rate_pct", "overlook_score_raw",
        "overlook_score", "cbpf_gap_coverage_pct", "is_overlooked", "mismatch_score",
        "recommended_additional_cbpf_musd",
    )
    assert set(GOLDEN) <= {tuple(row) for row in found.collect()}


def test_golden_totals_and_labels(spark):
    ranked = rollups.rankings(medallion.silver_funding(golden.needs(spark))).cache()
    row = rollups.key_figures(ranked).first()
    assert row.total_people_in_need_millions == 255.5
    assert row.total_gap_musd == 19366.0
    assert round(row.avg_coverage_pct, 3) == 45.428
    assert (row.overlooked_crises, row.num_crises) == (10, 25)
    by_priority = counts(ranked, "attention_priority")
    assert sorted(by_priority.values()) == [3, 4, 5, 13]
    adequacy = counts(ranked, "cbpf_adequacy")
    assert sorted(adequacy.values()) == [2, 7, 16]
    category = counts(ranked, "funding_category")
    assert category == {
        "Mostly Funded (70–99%)": 1, "Partially Funded (40–69%)": 14, "Critically Underfunded (20–39%)": 10,
    }
    low = rollups.low_engagement(rollups.mismatch(ranked)).first()
    assert tuple(low) == (18, "SDN")
    bubble = charts.chart_bubble(ranked).filter("iso3 = 'SDN'").first()
    assert bubble.quadrant == "OVERLOOKED" and bubble.is_labelled


def test_golden_allocations(spark):
    silver = medallion.silver_funding(golden.needs(spark))
    enriched = medallion.silver_allocations(golden.allocations(spark), silver)
    assert enriched.count() == 29 and len(enriched.columns) == 15
    assert sorted(counts(enriched, "cbpf_mismatch_type").values()) == [2, 3, 24]
    assert allocations.allocation_mismatch_count(enriched).first().n_mismatched == 3
    first = allocations.allocations_by(golden.allocations(spark)).first()
    assert tuple(first) == ("COD", 102.7, 3)


def test_unknown_entity_keeps_its_allocation(spark):
    silver = medallion.silver_funding(golden.needs(spark))
    lost = golden.allocations(spark).limit(1).withColumn("iso3", F.lit("XXX"))
    row = medallion.silver_allocations(lost, silver).first()
    assert row.overlook_score is None and row.allocated_to_overlooked_crisis is False
    assert row.cbpf_per_person_in_need_usd == row.allocation_musd * 1e6


def test_allocations_meet_their_year_once(spark):
    silver = medallion.silver_funding(golden.needs(spark))
    given = golden.allocations(spark)
    later = silver.withColumns({"year": F.col("year") + 1, "overlook_score": F.lit(-1.0)})
    both = medallion.silver_allocations(given, silver.unionByName(later))
    assert both.count() == given.count() and both.filter("overlook_score = -1").isEmpty()
    with pytest.raises(Exception, match="several funding rows for"):
        medallion.silver_allocations(given, silver.unionByName(silver)).collect()


def one_need(spark, **change):
    base = dict(required_funding_musd=100.0, funding_received_musd=50.0, people_in_need_millions=2.0,
                cbpf_allocation_musd=1.0, severity=3)
    row = {**base, **change}
    schema = ("required_funding_musd double, funding_received_musd double, people_in_need_millions double, "
              "cbpf_allocation_musd double, severity int")
    return spark.createDataFrame([tuple(row[name] for name in base)], schema)


def test_null_received_counts_as_capped_unless_strict(spark):
    df = one_need(spark, funding_received_musd=None)
    loose = add_funding_metrics(df).first()
    assert loose.coverage_rate == 1.5 and loose.funding_category == "Fully Funded (≥100%)"
    assert loose.funding_gap_musd is None
    strict = add_funding_metrics(df, Config(strict_nulls=True)).first()
    assert strict.coverage_rate is None and strict.overlook_score_raw is None
    assert strict.is_overlooked is False


def test_money_floors(spark):
    zero = add_funding_metrics(one_need(spark, required_funding_musd=0.0)).first()
    assert zero.coverage_rate == 1.5
    negative = add_funding_metrics(one_need(spark, required_funding_musd=-5.0)).first()
    assert negative.coverage_rate == 1.5 and negative.funding_gap_musd == -55.0
    over = add_funding_metrics(one_need(spark, funding_received_musd=400.0)).first()
    assert over.coverage_rate == 1.5 and over.cbpf_gap_coverage_pct == 100000.0
    assert over.estimated_unfunded_people_millions == 0.0
    empty = add_funding_metrics(one_need(spark, funding_received_musd=0.0)).first()
    assert empty.overlook_score_raw == 1800.0


def test_min_max(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", None)], "g string, v double")
    scored = {r.v: r.s for r in scoring.min_max_score(df, "v", "s").collect()}
    assert scored == {1.0: 0.0, 3.0: 50.0, 5.0: 100.0, None: None}
    grouped = {r.v: r.s for r in scoring.min_max_score(df, "v", "s", by=["g"]).collect()}
    assert grouped == {1.0: 0.0, 3.0: 100.0, 5.0: 0.0, None: None}
    equal = scoring.min_max_score(df.filter("v = 1"), "v", "s").first()
    assert equal.s == 0.0


def test_rank_equals_window_rank(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 4).cast("string").alias("region"),
        F.when(F.col("id") % 97 != 0, F.round(F.rand(7) * 3, 1)).alias("score"),
    ).withColumn("region", F.when(F.col("region") != "3", F.col("region"))).cache()
    for by in ([], ["region"]):
        window = (Window.partitionBy(*by) if by else Window).orderBy(F.desc_nulls_last("score"))
        expected = rows.withColumn("r", F.rank().over(window).cast("bigint"))
        if by:
            found = scoring.rank_within(rows, by, "score", "r")
        else:
            found = scoring.global_rank(rows, "score", "r")
        assert found.count() == 3000
        assert found.select("region", "score", "r").exceptAll(expected).isEmpty()


def test_unbounded_rank_equals_window_rank(spark, monkeypatch):
    monkeypatch.setattr(scoring, "RANGES", 7)
    rows = spark.range(2000).select(
        (F.col("id") % 3).alias("region"),
        F.when(F.col("id") % 89 != 0, F.round(F.rand(3) * 1e6, F.lit(0)) % 1500 / 7).alias("score"),
    ).withColumn("region", F.when(F.col("region") != 2, F.col("region"))).cache()
    for by in ([], ["region"]):
        window = (Window.partitionBy(*by) if by else Window).orderBy(F.desc_nulls_last("score"))
        expected = rows.withColumn("r", F.rank().over(window).cast("bigint"))
        ranks = scoring.rank_table(rows, "score", "r", by, bounded=False)
        found = scoring.join_null_safe(rows, ranks, [*by, "score"])
        assert found.count() == 2000
        assert found.select("region", "score", "r").exceptAll(expected).isEmpty()


def test_score_reaches_both_ends(spark):
    low, high = medallion.silver_funding(golden.needs(spark)).agg(
        F.min("overlook_score"), F.max("overlook_score")
    ).first()
    assert (low, high) == (0.0, 100.0)


def test_quality(spark):
    needs = golden.needs(spark)
    assert {r.iso3: r.n_rows for r in quality.duplicate_keys(needs, ["iso3"]).collect()} == {"LBY": 2}
    assert all(r.passed for r in quality.null_counts(needs).collect())
    assert all(r.passed for r in quality.contract_checks(needs).collect())
    bad = needs.limit(2).withColumns({"severity": F.lit(5), "funding_received_musd": F.lit(None).cast("double")})
    assert quality.impossible_rows(bad).first().n_bad == 2
    assert {r.rule: r.n_bad for r in quality.null_counts(bad).collect()}["funding_received_musd"] == 2
    assert quality.impossible_rows(needs.limit(1).withColumn("severity", F.lit(0))).first().n_bad == 1
    missing = {r.rule: r.passed for r in quality.required_columns(needs.drop("year")).collect()}
    assert missing.pop("year") is False and all(missing.values())
