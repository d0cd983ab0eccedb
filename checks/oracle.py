"""Independent DuckDB SQL for every query that SQL can express.

The strings are written out from the metric definitions, not rendered from
the package. ``ROUND`` of a double is half-up on its decimal text in Spark
and binary in DuckDB, so ``r`` rounds the text as a decimal here. It keeps 24
places: a double just under a tie, like 0.5499999999999999, must not reach the
tie by being cut to fewer places first.
"""

from __future__ import annotations


def r(value: str, places: int) -> str:
    return f"CAST(ROUND(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,24)), {places}) AS DOUBLE)"


def total(value: str) -> str:
    """Order-independent sum of doubles."""
    return f"CAST(SUM(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,9))) AS DOUBLE)"


def mean(value: str) -> str:
    return f"({total(value)} / NULLIF(COUNT({value}), 0))"


NEEDS = f"""
order_money AS (
  SELECT o_custkey, MAX(YEAR(o_orderdate)) AS yr,
    SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS asked,
    COALESCE(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) FILTER (WHERE o_orderstatus = 'F'), 0) AS received,
    COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent
  FROM orders GROUP BY o_custkey),
line_money AS (
  SELECT o_custkey, SUM(CAST(l_quantity AS BIGINT)) AS quantity,
    SUM(CAST(ROUND(l_extendedprice * l_discount * 10000) AS BIGINT)) AS discount_units
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
needs AS (
  SELECT c_name AS country, CAST(c_custkey AS VARCHAR) AS iso3, CAST(yr AS INTEGER) AS year,
    CAST(COALESCE(quantity, 0) AS DOUBLE) / 100 AS people_in_need_millions,
    CAST(asked AS DOUBLE) / 100000 AS required_funding_musd,
    CAST(received AS DOUBLE) / 100000 AS funding_received_musd,
    CAST(COALESCE(discount_units, 0) AS DOUBLE) / 10000000 AS cbpf_allocation_musd,
    CAST(1 + LEAST(3, urgent) AS INTEGER) AS severity,
    c_mktsegment AS primary_cluster, r_name AS region,
    CAST(c_nationkey * 5 - 60 AS DOUBLE) AS latitude,
    CAST(c_nationkey * 14 - 170 AS DOUBLE) AS longitude,
    ABS(c_acctbal) / 100 AS population_millions
  FROM customer JOIN order_money m ON c_custkey = m.o_custkey
  LEFT JOIN line_money l ON c_custkey = l.o_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

METRICS = f"""
metrics_1 AS (
  SELECT *,
    {r('required_funding_musd - funding_received_musd', 2)} AS funding_gap_musd,
    {r('LEAST(funding_received_musd / GREATEST(required_funding_musd, 0.001::DOUBLE), 1.5::DOUBLE)', 4)} AS coverage_rate,
    {r('(funding_received_musd * 1000000) / GREATEST(people_in_need_millions * 1000000, 1::DOUBLE)', 2)}
      AS funding_per_person_in_need_usd,
    {r('people_in_need_millions * (severity * severity)', 3)} AS need_score,
    {r('(cbpf_allocation_musd / GREATEST(required_funding_musd, 0.001::DOUBLE)) * 100', 2)} AS cbpf_need_coverage_pct,
    {r('(cbpf_allocation_musd / GREATEST(required_funding_musd - funding_received_musd, 0.001::DOUBLE)) * 100', 2)}
      AS cbpf_gap_coverage_pct
  FROM needs),
metrics_2 AS (
  SELECT *,
    {r('coverage_rate * 100', 1)} AS coverage_rate_pct,
    {r('need_score / GREATEST(coverage_rate, 0.01::DOUBLE)', 4)} AS overlook_score_raw,
    {r('people_in_need_millions * GREATEST(1 - coverage_rate, 0::DOUBLE)', 2)} AS estimated_unfunded_people_millions
  FROM metrics_1),
metrics AS (
  SELECT *,
    COALESCE(coverage_rate_pct < 40 AND severity >= 3, FALSE) AS is_overlooked,
    CASE WHEN coverage_rate_pct >= 100 THEN 'Fully Funded (≥100%)'
      WHEN coverage_rate_pct >= 70 THEN 'Mostly Funded (70–99%)'
      WHEN coverage_rate_pct >= 40 THEN 'Partially Funded (40–69%)'
      WHEN coverage_rate_pct >= 20 THEN 'Critically Underfunded (20–39%)'
      ELSE 'Severely Underfunded (<20%)' END AS funding_category
  FROM metrics_2)"""

FUNDING = f"""
scored AS (
  SELECT m.*,
    {r('''COALESCE((overlook_score_raw - MIN(overlook_score_raw) OVER ())
      / NULLIF(MAX(overlook_score_raw) OVER () - MIN(overlook_score_raw) OVER (), 0), 0) * 100''', 2)} AS overlook_score
  FROM metrics m),
funding AS (
  SELECT *, RANK() OVER (ORDER BY overlook_score DESC NULLS LAST) AS global_overlook_rank FROM scored)"""

RANKINGS = f"""
rankings AS (
  SELECT global_overlook_rank,
    RANK() OVER (PARTITION BY region ORDER BY overlook_score DESC NULLS LAST) AS regional_overlook_rank,
    country, iso3, region, primary_cluster, latitude, longitude, year, severity,
    people_in_need_millions, population_millions, required_funding_musd, funding_received_musd,
    cbpf_allocation_musd, funding_gap_musd, coverage_rate_pct, cbpf_need_coverage_pct,
    cbpf_gap_coverage_pct, funding_per_person_in_need_usd, need_score, overlook_score,
    estimated_unfunded_people_millions, is_overlooked, funding_category,
    CASE WHEN global_overlook_rank <= 3 THEN '🔴 CRITICAL — Immediate attention required'
      WHEN global_overlook_rank <= 7 THEN '🟠 HIGH — Significant funding gap'
      WHEN global_overlook_rank <= 12 THEN '🟡 MEDIUM — Monitor closely'
      ELSE '🟢 LOW — Relatively well funded' END AS attention_priority,
    CASE WHEN cbpf_gap_coverage_pct < 5 THEN '🔴 No Pooled Fund Engagement'
      WHEN cbpf_gap_coverage_pct < 15 THEN '🟠 Minimal Pooled Fund Support'
      WHEN cbpf_gap_coverage_pct < 30 THEN '🟡 Some Pooled Fund Support'
      ELSE '✅ Adequate Pooled Fund Support' END AS cbpf_adequacy,
    CONCAT_WS(' ', country, 'has', CAST({r('people_in_need_millions', 1)} AS VARCHAR),
      'million people in need but only', CAST(coverage_rate_pct AS VARCHAR), '% funded —',
      CAST({r('estimated_unfunded_people_millions', 1)} AS VARCHAR),
      'million people without adequate support.') AS key_insight
  FROM funding)"""

MISMATCH = f"""
mismatch AS (
  SELECT country, iso3, region, global_overlook_rank, overlook_score, coverage_rate_pct, funding_gap_musd,
    cbpf_allocation_musd AS country_cbpf_total_musd, cbpf_gap_coverage_pct, cbpf_adequacy,
    people_in_need_millions, severity, attention_priority,
    {r('overlook_score * (1 - LEAST(cbpf_gap_coverage_pct / 100, 1::DOUBLE))', 2)} AS mismatch_score,
    {r('GREATEST(funding_gap_musd * 0.15::DOUBLE - cbpf_allocation_musd, 0::DOUBLE)', 1)}
      AS recommended_additional_cbpf_musd
  FROM rankings)"""

REGIONAL = f"""
regional AS (
  SELECT region, COUNT(*) AS num_crises,
    {r(total('people_in_need_millions'), 1)} AS total_people_in_need_M,
    {r(total('required_funding_musd'), 0)} AS total_required_MUSD,
    {r(total('funding_received_musd'), 0)} AS total_received_MUSD,
    {r(total('funding_gap_musd'), 0)} AS total_gap_MUSD,
    {r(mean('coverage_rate_pct'), 1)} AS avg_coverage_pct,
    {r('MIN(coverage_rate_pct)', 1)} AS min_coverage_pct,
    {r(total('cbpf_allocation_musd'), 1)} AS total_cbpf_MUSD,
    {r(mean('overlook_score'), 1)} AS avg_overlook_score,
    {r(total('funding_gap_musd') + ' / ' + total('people_in_need_millions'), 2)}
      AS gap_per_person_in_need_usd,
    COUNT(*) FILTER (WHERE is_overlooked) AS overlooked_crisis_count
  FROM rankings GROUP BY region)"""

CLUSTER = f"""
sectors AS (
  SELECT primary_cluster AS cluster, COUNT(*) AS num_crises,
    {r(total('people_in_need_millions'), 1)} AS total_pin_millions,
    {r(mean('coverage_rate_pct'), 1)} AS avg_coverage_pct,
    {r(total('funding_gap_musd'), 0)} AS total_gap_musd,
    {r(mean('cbpf_need_coverage_pct'), 1)} AS avg_cbpf_coverage_pct,
    {r(mean('overlook_score'), 1)} AS avg_overlook_score,
    {r(total('cbpf_allocation_musd'), 1)} AS total_cbpf_musd,
    COUNT(*) FILTER (WHERE is_overlooked) AS overlooked_count
  FROM rankings GROUP BY primary_cluster)"""

PROJECTS = f"""
part_sales AS (
  SELECT l_partkey, SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) // 100 AS budget,
    SUM(CAST(l_quantity AS BIGINT)) AS quantity,
    COALESCE(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) FILTER (WHERE l_linestatus = 'F'), 0) // 100 AS received,
    MIN(l_orderkey) AS first_order
  FROM lineitem GROUP BY l_partkey),
projects AS (
  SELECT c_custkey || '-' || UPPER(SUBSTRING(p_type, 1, 3)) || '-' || PRINTF('%04d', p_partkey) AS project_code,
    c_name AS country, CAST(c_custkey AS VARCHAR) AS iso3, p_type AS cluster, p_brand AS organization,
    CAST(YEAR(o_orderdate) AS INTEGER) AS year, CAST(budget AS BIGINT) AS budget_usd,
    CAST(quantity AS BIGINT) AS target_beneficiaries, CAST(received AS BIGINT) AS funding_received_usd,
    {r('quantity::DOUBLE / NULLIF(budget::DOUBLE / 1000, 0)', 3)} AS beneficiaries_per_1000_usd,
    {r('received::DOUBLE / NULLIF(budget::DOUBLE, 0) * 100', 1)} AS funding_coverage_pct
  FROM part JOIN part_sales ON p_partkey = l_partkey JOIN orders ON first_order = o_orderkey
  JOIN customer ON o_custkey = c_custkey)"""

PROJECT_METRICS = f"""
project_metrics AS (
  SELECT *,
    {r('budget_usd::DOUBLE / GREATEST(target_beneficiaries, 1)', 2)} AS budget_per_beneficiary_usd,
    GREATEST(budget_usd - funding_received_usd, 0) AS project_funding_gap_usd,
    COALESCE(beneficiaries_per_1000_usd,
      {r('target_beneficiaries::DOUBLE / NULLIF(budget_usd::DOUBLE / 1000, 0)', 3)}) AS ben_per_1000_usd,
    CASE WHEN funding_coverage_pct < 30 THEN 'Critically Underfunded Project'
      WHEN funding_coverage_pct < 60 THEN 'Underfunded Project'
      WHEN funding_coverage_pct < 90 THEN 'Mostly Funded Project'
      ELSE 'Fully Funded Project' END AS funding_gap_flag
  FROM projects),
project_stats AS (
  SELECT *,
    {r('CAST(SUM(CAST(CAST(ben_per_1000_usd AS VARCHAR) AS DECIMAL(38,9))) OVER w AS DOUBLE) / COUNT(ben_per_1000_usd) OVER w', 3)}
      AS cluster_avg_ben_ratio,
    {r('STDDEV_SAMP(ben_per_1000_usd) OVER w', 3)} AS cluster_std_ben_ratio
  FROM project_metrics WINDOW w AS (PARTITION BY cluster)),
project_z AS (
  SELECT *,
    {r('(ben_per_1000_usd - cluster_avg_ben_ratio) / GREATEST(cluster_std_ben_ratio, 0.001::DOUBLE)', 3)}
      AS ben_ratio_zscore
  FROM project_stats),
silver AS (
  SELECT *, ABS(ben_ratio_zscore) > 1.5 AS is_efficiency_outlier,
    CASE WHEN ben_ratio_zscore > 2.0 THEN '🟢 Highly Efficient — Investigate for scale-up'
      WHEN ben_ratio_zscore > 1.5 THEN '🟡 Above Average Efficiency — Monitor'
      WHEN ben_ratio_zscore < -2.0 THEN '🔴 Very Low Efficiency — Investigate bottleneck'
      WHEN ben_ratio_zscore < -1.5 THEN '🟠 Below Average Efficiency — Review methodology'
      ELSE '✅ Within Normal Range' END AS outlier_classification
  FROM project_z)"""

BENCHMARKS = f"""
grouped AS (
  SELECT *, CAST(CASE WHEN budget_usd < 1270000 THEN 0 WHEN budget_usd < 1430000 THEN 1
    WHEN budget_usd < 1580000 THEN 2 WHEN budget_usd < 1720000 THEN 3
    WHEN budget_usd < 1900000 THEN 4 ELSE 5 END AS INTEGER) AS benchmark_group
  FROM silver),
group_order AS (
  SELECT benchmark_group, ROW_NUMBER() OVER (ORDER BY AVG(budget_usd), benchmark_group) AS place
  FROM grouped GROUP BY benchmark_group),
labels_of AS (
  SELECT benchmark_group, CASE place
    WHEN 1 THEN 'Group A: Small-Budget, High-Efficiency Projects'
    WHEN 2 THEN 'Group B: Small-Budget, Low-Efficiency Projects'
    WHEN 3 THEN 'Group C: Medium-Budget, Mixed Efficiency'
    WHEN 4 THEN 'Group D: Large-Budget, High-Reach Projects'
    WHEN 5 THEN 'Group E: Large-Budget, Specialist Projects'
    WHEN 6 THEN 'Group F: Extra-Large or Logistics Projects' END AS benchmark_label
  FROM group_order),
benchmarks AS (
  SELECT project_code, country, iso3, cluster, organization, year, budget_usd, target_beneficiaries,
    funding_received_usd, ben_per_1000_usd, funding_coverage_pct, budget_per_beneficiary_usd,
    project_funding_gap_usd, ben_ratio_zscore, is_efficiency_outlier, outlier_classification,
    cluster_avg_ben_ratio, cluster_std_ben_ratio, benchmark_group, benchmark_label
  FROM grouped JOIN labels_of USING (benchmark_group))"""

ALLOCATIONS = """
allocations AS (
  SELECT c_name AS country, CAST(c_custkey AS VARCHAR) AS iso3, c_mktsegment AS cluster,
    CAST(units AS DOUBLE) / 10000 AS allocation_kusd, needs.year AS year, l_returnflag AS allocation_type,
    CAST(units AS DOUBLE) / 10000 / 1000 AS allocation_musd
  FROM (SELECT o_custkey, l_returnflag, SUM(CAST(ROUND(l_extendedprice * l_discount * 10000) AS BIGINT)) AS units
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_returnflag) u
  JOIN customer ON u.o_custkey = c_custkey JOIN needs ON needs.iso3 = CAST(c_custkey AS VARCHAR))"""

ENRICHED = f"""
enriched AS (
  SELECT a.*, overlook_score, coverage_rate_pct, funding_gap_musd, people_in_need_millions, funding_category
  FROM allocations a LEFT JOIN funding USING (iso3)),
silver_allocations AS (
  SELECT *,
    {r('allocation_musd * 1000000 / GREATEST(people_in_need_millions * 1000000, 1::DOUBLE)', 2)}
      AS cbpf_per_person_in_need_usd,
    COALESCE(coverage_rate_pct < 40, FALSE) AS allocated_to_overlooked_crisis,
    CASE WHEN overlook_score > 60 AND allocation_musd < 20 THEN '🔴 Overlooked Crisis — UNDERFUNDED by Pooled Funds'
      WHEN overlook_score < 30 AND allocation_musd > 30 THEN '⚠️  Well-Funded Crisis — Receiving Pooled Funds'
      ELSE '✅ Reasonable Allocation' END AS cbpf_mismatch_type
  FROM enriched)"""

_TO_METRICS = (NEEDS, METRICS)
_TO_FUNDING = (*_TO_METRICS, FUNDING)
_TO_RANKINGS = (*_TO_FUNDING, RANKINGS)
_TO_MISMATCH = (*_TO_RANKINGS, MISMATCH)
_TO_SILVER = (PROJECTS, PROJECT_METRICS)
_TO_BENCHMARKS = (*_TO_SILVER, BENCHMARKS)
_TO_ENRICHED = (*_TO_FUNDING, ALLOCATIONS, ENRICHED)


_LAST_YEAR = """
last_year AS (SELECT * FROM needs WHERE year = (SELECT MAX(year) FROM needs))"""


def _sql(ctes: tuple[str, ...], body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


ORACLE: dict[str, str] = {}


def _add(ctes: tuple[str, ...], **bodies: str) -> None:
    for name, body in bodies.items():
        ORACLE[name] = _sql(ctes, body)


# ---- one analysis year ----

_add(
    (NEEDS, _LAST_YEAR, METRICS.replace("FROM needs)", "FROM last_year)"), FUNDING, RANKINGS),
    gold_rankings_of_year="SELECT *, year AS analysis_year FROM rankings",
)

# ---- sources and sinks ----

ORACLE["scan_table"] = "SELECT * FROM orders"

_add(
    (NEEDS,),
    scan_csv="SELECT * FROM needs",
    save_table="SELECT * FROM needs",
    normalise_columns="""SELECT iso3, people_in_need_millions AS people_in_need_m,
        required_funding_musd AS requiredfunding_m, primary_cluster FROM needs""",
    conform_schema="""SELECT * REPLACE (CASE WHEN region = 'ASIA' THEN NULL ELSE year END AS year,
        CAST(NULL AS DOUBLE) AS population_millions) FROM needs""",
    load_or_fallback="""SELECT iso3, severity, 'primary' AS taken FROM needs WHERE severity = 4
        UNION ALL SELECT iso3, severity, 'fallback' FROM needs""",
    inline_rows="""SELECT l.severity, meaning, n_rows
        FROM (VALUES (1, 'minimal'), (2, 'stressed'), (3, 'crisis'), (4, 'emergency')) l(severity, meaning)
        LEFT JOIN (SELECT severity, COUNT(*) AS n_rows FROM needs GROUP BY severity) c ON l.severity = c.severity""",
    schema_report=" UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS position, '{name}' AS column_name, '{kind}' AS type_name, "
        f"COUNT({name}) AS n_values FROM needs"
        for i, (name, kind) in enumerate(
            [
                ("country", "string"), ("iso3", "string"), ("year", "int"),
                ("people_in_need_millions", "double"), ("required_funding_musd", "double"),
                ("funding_received_musd", "double"), ("cbpf_allocation_musd", "double"),
                ("severity", "int"), ("primary_cluster", "string"), ("region", "string"),
                ("latitude", "double"), ("longitude", "double"), ("population_millions", "double"),
            ],
            start=1,
        )
    ),
    dq_null_counts=" UNION ALL ".join(
        f"SELECT '{c}' AS rule, COUNT(*) - COUNT({c}) AS n_bad, COUNT(*) = COUNT({c}) AS passed FROM needs"
        for c in ("country", "people_in_need_millions", "required_funding_musd", "funding_received_musd")
    ),
    dq_impossible_rows="""SELECT 'impossible_rows' AS rule, COUNT(*) AS n_bad, COUNT(*) = 0 AS passed FROM needs
        WHERE required_funding_musd <= 0 OR people_in_need_millions <= 0 OR severity < 1 OR severity > 4""",
    dq_required_columns=" UNION ALL ".join(
        f"SELECT '{c}' AS rule, {'COUNT(*)' if c == 'severity' else 'CAST(0 AS BIGINT)'} AS n_bad, "
        f"{'FALSE' if c == 'severity' else 'TRUE'} AS passed FROM {'needs' if c == 'severity' else '(SELECT 1)'}"
        for c in (
            "country", "iso3", "year", "people_in_need_millions", "required_funding_musd",
            "funding_received_musd", "severity",
        )
    ),
    dq_contract_checks=" UNION ALL ".join(
        f"SELECT '{rule}' AS rule, COUNT(*) FILTER (WHERE NOT ({ok})) AS n_bad, "
        f"COUNT(*) FILTER (WHERE NOT ({ok})) = 0 AS passed FROM needs"
        for rule, ok in {
            "people_in_need_positive": "people_in_need_millions > 0",
            "required_funding_positive": "required_funding_musd > 0",
            "severity_between_1_and_4": "severity BETWEEN 1 AND 4",
            "iso3_has_3_characters": "LENGTH(iso3) = 3",
        }.items()
    ),
)

GATE_RULES = {
    "null_counts.country": "country IS NULL",
    "null_counts.people_in_need_millions": "people_in_need_millions IS NULL",
    "null_counts.required_funding_musd": "required_funding_musd IS NULL",
    "null_counts.funding_received_musd": "funding_received_musd IS NULL",
    "impossible_rows.impossible_rows":
        "required_funding_musd <= 0 OR people_in_need_millions <= 0 OR severity < 1 OR severity > 4",
    **{
        f"required_columns.{name}": "FALSE"
        for name in (
            "country", "iso3", "year", "people_in_need_millions", "required_funding_musd",
            "funding_received_musd", "severity",
        )
    },
    "contract_checks.people_in_need_positive": "people_in_need_millions <= 0",
    "contract_checks.required_funding_positive": "required_funding_musd <= 0",
    "contract_checks.severity_between_1_and_4": "severity IS NULL OR severity NOT BETWEEN 1 AND 4",
    "contract_checks.iso3_has_3_characters": "iso3 IS NULL OR LENGTH(iso3) <> 3",
    "own.more_received_than_required": "funding_received_musd > required_funding_musd",
}
SET_ASIDE = {"severity_of_one": "severity = 1", "few_people": "people_in_need_millions < 1"}
_aside = " OR ".join(f"COALESCE({bad}, FALSE)" for bad in SET_ASIDE.values())
_broken = ", ".join(f"CASE WHEN {bad} THEN '{rule}' END" for rule, bad in SET_ASIDE.items())

_add(
    (NEEDS,),
    dq_gate=" UNION ALL ".join(
        [f"SELECT '{rule}.report' AS item, COUNT(*) FILTER (WHERE {bad}) AS n_rows FROM needs" for rule, bad in GATE_RULES.items()]
        + [f"SELECT 'own.{rule}.set_aside', COUNT(*) FILTER (WHERE {bad}) FROM needs" for rule, bad in SET_ASIDE.items()]
        + [f"SELECT 'kept.severity.' || severity, COUNT(*) FROM needs WHERE NOT ({_aside}) GROUP BY severity"]
        + [f"SELECT 'aside.' || CONCAT_WS('+', {_broken}) AS item, COUNT(*) FROM needs WHERE {_aside} GROUP BY item"]
    ),
)

ORACLE["table_inventory"] = _sql(
    (NEEDS, PROJECTS, ALLOCATIONS),
    """, counts AS (
      SELECT 'needs' AS table_name, COUNT(*) AS n_rows, 13 AS n_cols FROM needs
      UNION ALL SELECT 'projects', COUNT(*), 11 FROM projects
      UNION ALL SELECT 'allocations', COUNT(*), 7 FROM allocations)
    SELECT COALESCE(table_name, 'TOTAL') AS table_name, CAST(SUM(n_rows) AS BIGINT) AS n_rows,
      CAST(SUM(n_cols) AS BIGINT) AS n_cols FROM counts GROUP BY ROLLUP (table_name)""",
)

_add(
    (NEEDS, ALLOCATIONS),
    ensure_database="SELECT allocation_type, COUNT(*) AS n_rows FROM allocations GROUP BY allocation_type",
    allocation_musd="SELECT iso3, allocation_type, allocation_kusd / 1000 AS allocation_musd FROM allocations",
    dq_duplicate_keys="SELECT iso3, COUNT(*) AS n_rows FROM allocations GROUP BY iso3 HAVING COUNT(*) > 1",
    allocations_by_country=f"""SELECT country, {r(total('allocation_musd'), 2)} AS total_cbpf_musd,
        COUNT(cluster) AS num_clusters_funded FROM allocations GROUP BY country""",
)

_add(
    (PROJECTS,),
    project_code="SELECT iso3, cluster, project_code FROM projects",
    beneficiaries_per_1000="SELECT project_code, beneficiaries_per_1000_usd FROM projects",
    project_coverage_pct="SELECT project_code, funding_coverage_pct FROM projects",
    distinct_values="SELECT DISTINCT cluster FROM projects",
    distinct_count="SELECT COUNT(DISTINCT country) AS n_countries FROM projects",
    top_efficient_projects="SELECT * FROM projects ORDER BY beneficiaries_per_1000_usd DESC, project_code LIMIT 5",
)

# ---- funding metrics ----

for _name in (
    "funding_gap_musd", "coverage_rate", "funding_per_person_in_need_usd", "need_score",
    "cbpf_need_coverage_pct", "cbpf_gap_coverage_pct", "coverage_rate_pct", "overlook_score_raw",
    "estimated_unfunded_people_millions", "is_overlooked", "funding_category",
):
    ORACLE[_name] = _sql(_TO_METRICS, f"SELECT iso3, {_name} FROM metrics")

_add(
    _TO_METRICS,
    regional_overlook_score=f"""SELECT iso3, region, {r('''COALESCE(
        (overlook_score_raw - MIN(overlook_score_raw) OVER w)
        / NULLIF(MAX(overlook_score_raw) OVER w - MIN(overlook_score_raw) OVER w, 0), 0) * 100''', 2)} AS regional_score
        FROM metrics WINDOW w AS (PARTITION BY region)""",
)

_add(
    _TO_FUNDING,
    overlook_score="SELECT iso3, overlook_score_raw, overlook_score FROM funding",
    silver_funding="SELECT * FROM funding",
    global_overlook_rank="SELECT iso3, overlook_score, global_overlook_rank FROM funding",
    top5_overlooked="""SELECT global_overlook_rank, country, severity, people_in_need_millions, coverage_rate_pct,
        funding_gap_musd, overlook_score, funding_category FROM funding
        ORDER BY global_overlook_rank, iso3 LIMIT 5""",
)

# ---- projects and outliers ----

for _name in (
    "budget_per_beneficiary_usd", "project_funding_gap_usd", "ben_per_1000_usd", "funding_gap_flag",
    "cluster_avg_ben_ratio", "cluster_std_ben_ratio", "ben_ratio_zscore", "is_efficiency_outlier",
    "outlier_classification",
):
    ORACLE[_name] = _sql(_TO_SILVER, f"SELECT project_code, {_name} FROM silver")

_COUNTS = f"""COUNT(*) AS n_projects, COUNT(*) FILTER (WHERE is_efficiency_outlier) AS n_outliers,
    {r('COUNT(*) FILTER (WHERE is_efficiency_outlier) * 100.0::DOUBLE / COUNT(*)', 1)} AS outlier_pct"""

_add(
    _TO_SILVER,
    drop_null_features="""SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE kept) AS n_kept,
        COUNT(*) - COUNT(*) FILTER (WHERE kept) AS n_dropped
        FROM (SELECT budget_usd IS NOT NULL AND target_beneficiaries IS NOT NULL AND ben_per_1000_usd IS NOT NULL
          AND funding_coverage_pct IS NOT NULL AND cluster IS NOT NULL AS kept FROM silver)""",
    silver_projects="SELECT * FROM silver",
    sector_stats_merged="""SELECT cluster, MAX(cluster_avg_ben_ratio) AS cluster_avg_ben_ratio,
        MAX(cluster_std_ben_ratio) AS cluster_std_ben_ratio, COUNT(*) AS n_rows,
        MIN(ben_per_1000_usd) AS least, MAX(ben_per_1000_usd) AS most FROM silver GROUP BY cluster""",
    outlier_count_share=f"SELECT {_COUNTS} FROM silver",
    outlier_count_share_by_cluster=f"SELECT cluster, {_COUNTS} FROM silver GROUP BY cluster",
    outlier_report=f"""SELECT project_code, country, cluster, {r('budget_usd / 1000000::DOUBLE', 2)} AS budget_musd,
        target_beneficiaries, {r('ben_per_1000_usd', 1)} AS efficiency,
        {r('cluster_avg_ben_ratio', 1)} AS cluster_avg_efficiency, {r('ben_ratio_zscore', 2)} AS z_score,
        outlier_classification AS finding, {r('funding_coverage_pct', 1)} AS coverage_pct
        FROM silver WHERE is_efficiency_outlier""",
    outlier_direction_split="""SELECT COUNT(*) AS total_outliers,
        COUNT(*) FILTER (WHERE ben_ratio_zscore > 0) AS high_efficiency,
        COUNT(*) FILTER (WHERE NOT ben_ratio_zscore > 0) AS low_efficiency FROM silver WHERE is_efficiency_outlier""",
    index_category="""SELECT project_code, cluster, cluster_index FROM silver JOIN (
        SELECT cluster, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, cluster) - 1 AS DOUBLE) AS cluster_index
        FROM silver GROUP BY cluster) USING (cluster)""",
    assemble_features="""SELECT project_code, CAST(budget_usd AS DOUBLE) AS feature_0,
        CAST(target_beneficiaries AS DOUBLE) AS feature_1, ben_per_1000_usd AS feature_2,
        funding_coverage_pct AS feature_3 FROM silver""",
    scale_features="SELECT project_code, " + ", ".join(
        r(f"({c} - AVG({c}) OVER ()) / STDDEV_SAMP({c}) OVER ()", 6) + f" AS {c}_scaled"
        for c in ("budget_usd", "target_beneficiaries", "ben_per_1000_usd", "funding_coverage_pct")
    ) + " FROM silver",
    efficiency_vs_cluster=f"""SELECT project_code, {r('diff', 6)} AS efficiency_diff_pct,
        CASE WHEN diff > 10 THEN 'MORE efficient' WHEN diff < -10 THEN 'LESS efficient'
          ELSE 'within normal range' END AS efficiency_verdict
        FROM (SELECT project_code,
          (ben_per_1000_usd - cluster_avg_ben_ratio) / cluster_avg_ben_ratio * 100 AS diff FROM silver)""",
    chart_efficiency_hist="""
        , normal AS (SELECT cluster, ben_per_1000_usd AS v FROM silver WHERE NOT is_efficiency_outlier),
        ranges AS (SELECT cluster, CASE WHEN MIN(v) = MAX(v) THEN MIN(v) - 0.5 ELSE MIN(v) END AS lo,
          CASE WHEN MIN(v) = MAX(v) THEN MAX(v) + 0.5 ELSE MAX(v) END AS hi FROM normal GROUP BY cluster),
        filled AS (SELECT n.cluster, CAST(LEAST(FLOOR((v - lo) / (hi - lo) * 12), 11) AS INTEGER) AS bin,
          COUNT(*) AS n FROM normal n JOIN ranges r ON n.cluster = r.cluster GROUP BY 1, 2)
        SELECT r.cluster, CAST(b.bin AS INTEGER) AS bin, lo + b.bin * ((hi - lo) / 12) AS bin_from,
          lo + (b.bin + 1) * ((hi - lo) / 12) AS bin_to, COALESCE(n, 0) AS n_projects
        FROM ranges r JOIN RANGE(12) b(bin) ON TRUE LEFT JOIN filled f ON f.cluster = r.cluster AND f.bin = b.bin""",
    chart_efficiency_limits="""SELECT cluster, COUNT(*) FILTER (WHERE NOT is_efficiency_outlier) AS n_normal,
        COUNT(*) FILTER (WHERE is_efficiency_outlier) AS n_outliers, MAX(cluster_avg_ben_ratio) AS mean_efficiency,
        MAX(cluster_avg_ben_ratio) + MAX(cluster_std_ben_ratio) * 1.5::DOUBLE AS upper_limit,
        GREATEST(MAX(cluster_avg_ben_ratio) - MAX(cluster_std_ben_ratio) * 1.5::DOUBLE, 0) AS lower_limit
        FROM silver GROUP BY cluster""",
    chart_outlier_marks="""SELECT cluster, project_code, ben_per_1000_usd,
        CASE WHEN ben_ratio_zscore > 0 THEN 'high' ELSE 'low' END AS direction
        FROM silver WHERE is_efficiency_outlier""",
)

# ---- allocations ----

_add(
    _TO_ENRICHED,
    allocations_enriched="SELECT * FROM enriched",
    silver_allocations="SELECT * FROM silver_allocations",
    cbpf_per_person_in_need_usd="SELECT iso3, allocation_type, cbpf_per_person_in_need_usd FROM silver_allocations",
    allocated_to_overlooked_crisis="""SELECT iso3, allocation_type, allocated_to_overlooked_crisis
        FROM silver_allocations""",
    cbpf_mismatch_type="SELECT iso3, allocation_type, cbpf_mismatch_type FROM silver_allocations",
    allocation_mismatch_count="""SELECT COUNT(*) AS n_mismatched FROM silver_allocations
        WHERE cbpf_mismatch_type LIKE '%Overlooked%'""",
)

# ---- rankings, rollups, mismatch ----

_KPI = f"""{r(total('people_in_need_millions'), 0)} AS total_people_in_need_millions, COUNT(*) AS num_crises,
    {r(mean('coverage_rate_pct'), 1)} AS avg_coverage_pct,
    COUNT(*) FILTER (WHERE is_overlooked) AS overlooked_crises,
    {r(total('CASE WHEN funding_gap_musd > 0 THEN funding_gap_musd ELSE 0::DOUBLE END'), 0)} AS total_gap_musd"""

_add(
    _TO_RANKINGS,
    regional_overlook_rank="SELECT iso3, region, overlook_score, regional_overlook_rank FROM rankings",
    attention_priority="SELECT iso3, attention_priority FROM rankings",
    cbpf_adequacy="SELECT iso3, cbpf_adequacy FROM rankings",
    key_insight="SELECT iso3, key_insight FROM rankings",
    gold_rankings="SELECT * FROM rankings",
    top_overlooked="""SELECT global_overlook_rank, country, people_in_need_millions, required_funding_musd,
        funding_received_musd, coverage_rate_pct, overlook_score, attention_priority
        FROM rankings ORDER BY global_overlook_rank, iso3 LIMIT 10""",
    top_findings="""SELECT global_overlook_rank, country, region, people_in_need_millions, severity,
        coverage_rate_pct, funding_received_musd, required_funding_musd,
        GREATEST(funding_gap_musd, 0) AS funding_gap_musd, estimated_unfunded_people_millions, cbpf_gap_coverage_pct,
        CASE WHEN cbpf_gap_coverage_pct < 10 THEN '⚠️ Pooled funds barely engaged' ELSE '' END AS pooled_note
        FROM rankings ORDER BY global_overlook_rank, iso3 LIMIT 3""",
    panel_kpis=f"SELECT {_KPI} FROM rankings",
    panel_top15=f"""SELECT global_overlook_rank, country, region, primary_cluster,
        {r('people_in_need_millions', 1)} AS people_in_need_millions,
        {r('required_funding_musd', 0)} AS required_funding_musd,
        {r('funding_received_musd', 0)} AS funding_received_musd, {r('funding_gap_musd', 0)} AS funding_gap_musd,
        coverage_rate_pct, {r('cbpf_allocation_musd', 1)} AS cbpf_allocation_musd,
        {r('overlook_score', 1)} AS overlook_score, attention_priority, severity
        FROM rankings ORDER BY global_overlook_rank, iso3 LIMIT 15""",
    panel_watch_list=f"""SELECT global_overlook_rank, country,
        {r('people_in_need_millions', 1)} AS people_in_need_millions,
        {r('estimated_unfunded_people_millions', 1)} AS estimated_unfunded_people_millions, coverage_rate_pct,
        {r('funding_gap_musd', 0)} AS funding_gap_musd,
        {r('funding_per_person_in_need_usd', 0)} AS funding_per_person_in_need_usd, cbpf_adequacy, key_insight
        FROM rankings WHERE severity = 4""",
    chart_map_points="""SELECT country, iso3, latitude, longitude, COALESCE(overlook_score, 50) AS score,
        CASE WHEN COALESCE(overlook_score, 50) > 60 THEN 'high'
          WHEN COALESCE(overlook_score, 50) > 30 THEN 'medium' ELSE 'low' END AS score_band,
        CASE WHEN coverage_rate_pct < 40 THEN 'low' WHEN coverage_rate_pct < 70 THEN 'medium' ELSE 'high' END
          AS coverage_band,
        global_overlook_rank <= 5 AS is_labelled, GREATEST(funding_gap_musd, 0) AS gap_musd,
        LEAST(coverage_rate_pct, 100) AS coverage_bar_pct FROM rankings""",
    chart_bubble="""SELECT country, iso3, coverage_rate_pct, people_in_need_millions,
        (GREATEST(funding_gap_musd, 0) + 100) * 1.2::DOUBLE AS bubble_size,
        CASE WHEN severity IN (2, 3, 4) THEN severity END AS severity_class,
        CASE WHEN people_in_need_millions >= 10 AND coverage_rate_pct < 50 THEN 'OVERLOOKED'
          WHEN people_in_need_millions >= 10 THEN 'VISIBLE'
          WHEN coverage_rate_pct >= 50 THEN 'STABLE' ELSE 'AT RISK' END AS quadrant,
        global_overlook_rank <= 10 AS is_labelled FROM rankings""",
    chart_gap_bars="""SELECT country, iso3, required_funding_musd, funding_received_musd, cbpf_allocation_musd,
        coverage_rate_pct, funding_category, GREATEST(funding_gap_musd, 0) AS gap_musd
        FROM rankings ORDER BY funding_gap_musd DESC, iso3 LIMIT 12""",
)

ORACLE["executive_summary"] = _sql(
    (*_TO_RANKINGS, *_TO_SILVER),
    f"""SELECT k.*, country AS top_country, {r('people_in_need_millions', 1)} AS top_people_in_need_millions,
      {r('coverage_rate_pct', 1)} AS top_coverage_pct,
      (SELECT COUNT(*) FROM silver WHERE is_efficiency_outlier) AS outlier_projects
    FROM (SELECT {_KPI} FROM rankings) k,
      (SELECT * FROM rankings ORDER BY global_overlook_rank, iso3 LIMIT 1) t""",
)

_add(
    (*_TO_RANKINGS, REGIONAL),
    regional_summary="SELECT * FROM regional",
    panel_regional=f"""SELECT region, num_crises, {r('total_people_in_need_M', 0)} AS total_people_in_need_M,
        {r('total_required_MUSD', 0)} AS total_required_MUSD, {r('total_received_MUSD', 0)} AS total_received_MUSD,
        {r('total_gap_MUSD', 0)} AS total_gap_MUSD, avg_coverage_pct,
        {r('gap_per_person_in_need_usd', 2)} AS gap_per_person_in_need_usd, overlooked_crisis_count FROM regional""",
)

_add(
    (*_TO_RANKINGS, CLUSTER),
    cluster_summary="SELECT * FROM sectors",
    panel_cluster=f"""SELECT cluster, num_crises, {r('total_pin_millions', 1)} AS total_pin_millions,
        avg_coverage_pct, {r('total_gap_musd', 0)} AS total_gap_musd, avg_cbpf_coverage_pct,
        {r('avg_overlook_score', 1)} AS avg_overlook_score FROM sectors""",
)

_add(
    _TO_MISMATCH,
    mismatch_score="SELECT iso3, mismatch_score FROM mismatch",
    recommended_additional_cbpf_musd="SELECT iso3, recommended_additional_cbpf_musd FROM mismatch",
    gold_mismatch="SELECT * FROM mismatch",
    low_engagement_count="""SELECT COUNT(*) FILTER (WHERE cbpf_gap_coverage_pct < 10) AS n_low_engagement,
        (SELECT country FROM mismatch ORDER BY mismatch_score DESC, iso3 LIMIT 1) AS most_misallocated
        FROM mismatch""",
    panel_mismatch=f"""SELECT country, global_overlook_rank, {r('overlook_score', 1)} AS overlook_score,
        coverage_rate_pct, {r('funding_gap_musd', 0)} AS funding_gap_musd,
        {r('country_cbpf_total_musd', 1)} AS country_cbpf_total_musd,
        {r('cbpf_gap_coverage_pct', 1)} AS cbpf_gap_coverage_pct, cbpf_adequacy,
        {r('mismatch_score', 1)} AS mismatch_score,
        {r('recommended_additional_cbpf_musd', 1)} AS recommended_additional_cbpf_musd, attention_priority
        FROM (SELECT * FROM mismatch WHERE mismatch_score > 0 ORDER BY mismatch_score DESC, iso3 LIMIT 15)""",
    chart_pooled_scatter="""SELECT country, iso3, overlook_score, country_cbpf_total_musd,
        people_in_need_millions * 8 AS marker_size, coverage_rate_pct FROM mismatch""",
    chart_pooled_bars="""SELECT country, iso3, mismatch_score, cbpf_gap_coverage_pct,
        CASE WHEN cbpf_gap_coverage_pct > 40 THEN 'high' WHEN cbpf_gap_coverage_pct > 20 THEN 'medium' ELSE 'low' END
          AS coverage_band, cbpf_gap_coverage_pct < 15 AS is_below_target
        FROM mismatch ORDER BY mismatch_score DESC, iso3 LIMIT 12""",
)

# ---- groups and comparables on fixed groups ----

_APART = """ABS(a.ben_per_1000_usd - b.ben_per_1000_usd) * 0.5::DOUBLE
      + ABS(a.funding_coverage_pct - b.funding_coverage_pct) * 0.3::DOUBLE
      + ABS(LN(GREATEST(a.budget_usd, 1)) - LN(GREATEST(b.budget_usd, 1))) * 5"""
_DISTANCE, _ORDER = r(_APART, 3), r(_APART, 9)
_ALL_COMPARABLES = f"""SELECT project_code, CAST(k AS INTEGER) AS comparable_rank, comparable_code, similarity_distance
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_code ORDER BY apart, comparable_code) AS k
      FROM (SELECT a.project_code, b.project_code AS comparable_code, {_DISTANCE} AS similarity_distance,
          {_ORDER} AS apart
        FROM benchmarks a JOIN benchmarks b ON a.benchmark_group = b.benchmark_group
          AND a.cluster = b.cluster AND a.project_code <> b.project_code))
    WHERE k <= 5"""
_SCALED = ", ".join(
    f"({c} - AVG({c}) OVER ()) / STDDEV_SAMP({c}) OVER () AS f{i}"
    for i, c in enumerate(("budget_usd", "target_beneficiaries", "ben_per_1000_usd", "funding_coverage_pct"))
)
_NORM = "(f0 * f0 + f1 * f1 + f2 * f2 + f3 * f3)"
_STRONGEST = "(SELECT * FROM benchmarks ORDER BY ABS(ben_ratio_zscore) DESC, project_code LIMIT 1)"

_ONE_COMPARABLES = f"""SELECT a.project_code, a.country, a.cluster,
  {r('a.budget_usd / 1000000::DOUBLE', 2)} AS budget_musd, a.target_beneficiaries,
  {r('a.ben_per_1000_usd', 1)} AS efficiency, {r('a.funding_coverage_pct', 1)} AS coverage_pct,
  a.outlier_classification AS status, {_DISTANCE} AS similarity_distance
  FROM benchmarks a JOIN {_STRONGEST} b
    ON a.benchmark_group = b.benchmark_group AND a.cluster = b.cluster AND a.project_code <> b.project_code
  ORDER BY {_ORDER}, a.project_code LIMIT 5"""

_add(
    _TO_BENCHMARKS,
    fixed_benchmarks="SELECT * FROM benchmarks",
    group_sizes="SELECT benchmark_group, COUNT(*) AS num_projects FROM benchmarks GROUP BY benchmark_group",
    group_labels="SELECT project_code, benchmark_group, benchmark_label FROM benchmarks",
    group_profiles=f"""SELECT p.*, dominant_cluster FROM (
        SELECT benchmark_group, COUNT(*) AS num_projects,
          {r(mean('budget_usd') + ' / 1000000', 2)} AS avg_budget_musd,
          {r(mean('target_beneficiaries'), 0)} AS avg_beneficiaries,
          {r(mean('ben_per_1000_usd'), 1)} AS avg_efficiency,
          {r(mean('funding_coverage_pct'), 1)} AS avg_coverage_pct
        FROM benchmarks GROUP BY benchmark_group) p
        JOIN (SELECT benchmark_group, cluster AS dominant_cluster,
          ROW_NUMBER() OVER (PARTITION BY benchmark_group ORDER BY COUNT(*) DESC, cluster) AS k
          FROM benchmarks GROUP BY benchmark_group, cluster) d
        ON p.benchmark_group = d.benchmark_group AND k = 1""",
    panel_groups=f"""SELECT benchmark_label, COUNT(*) AS num_projects,
        {r(mean('budget_usd') + ' / 1000000', 2)} AS avg_budget_musd,
        {r(mean('target_beneficiaries'), 0)} AS avg_beneficiaries,
        {r(mean('ben_per_1000_usd'), 1)} AS avg_efficiency,
        {r(mean('funding_coverage_pct'), 1)} AS avg_coverage_pct,
        COUNT(*) FILTER (WHERE is_efficiency_outlier) AS outlier_projects
        FROM benchmarks GROUP BY benchmark_label""",
    panel_outliers=f"""SELECT project_code, country, cluster, organization,
        {r('budget_usd / 1000000::DOUBLE', 2)} AS budget_musd, target_beneficiaries,
        {r('ben_per_1000_usd', 1)} AS ben_per_1000_usd, {r('cluster_avg_ben_ratio', 1)} AS cluster_avg_ben_ratio,
        {r('ben_ratio_zscore', 2)} AS ben_ratio_zscore, outlier_classification,
        {r('funding_coverage_pct', 1)} AS funding_coverage_pct
        FROM (SELECT * FROM benchmarks WHERE is_efficiency_outlier
          ORDER BY ABS(ben_ratio_zscore) DESC, project_code LIMIT 20)""",
    comparables_for_project=_ONE_COMPARABLES,
    comparables_lookup=_ONE_COMPARABLES,
    comparables_all=_ALL_COMPARABLES,
    comparables_all_split=_ALL_COMPARABLES,
    gold_benchmarks="""SELECT * EXCLUDE (benchmark_group, benchmark_label), TRUE AS has_group, TRUE AS has_label
        FROM benchmarks""",
    kmeans_groups="SELECT project_code, TRUE AS in_nearest_group FROM benchmarks",
    comparables_fitted="""SELECT project_code, TRUE AS in_same_block, TRUE AS as_many_as_there_are,
        TRUE AS ranks_without_gap, TRUE AS has_label FROM benchmarks""",
    kmeans_sweep="""SELECT CAST(k AS INTEGER) AS k, COUNT(*) AS n_projects, TRUE AS silhouette_in_bounds,
        TRUE AS sizes_in_bounds, CAST(1 AS BIGINT) AS n_best FROM benchmarks, RANGE(4, 10) ks(k) GROUP BY k""",
    silhouette=f"""
        , scaled AS (SELECT ROW_NUMBER() OVER () AS id, benchmark_group AS g, {_SCALED} FROM benchmarks),
        middles AS (SELECT g, COUNT(*) AS n, SUM({_NORM}) AS norm, SUM(f0) AS y0, SUM(f1) AS y1, SUM(f2) AS y2,
          SUM(f3) AS y3 FROM scaled GROUP BY g),
        apart AS (SELECT id, s.g = m.g AS own, n,
            {_NORM} + norm / n - 2 * (f0 * y0 + f1 * y1 + f2 * y2 + f3 * y3) / n AS d
          FROM scaled s, middles m),
        sides AS (SELECT id, MAX(n) FILTER (WHERE own) AS n, MAX(d * n / NULLIF(n - 1, 0)) FILTER (WHERE own) AS a,
          MIN(d) FILTER (WHERE NOT own) AS b FROM apart GROUP BY id),
        score AS (SELECT {r('AVG(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END)', 6)}
          AS silhouette FROM sides)
        SELECT silhouette, CASE WHEN silhouette > 0.5 THEN 'good' WHEN silhouette > 0.3 THEN 'acceptable'
          ELSE 'weak' END AS verdict FROM score""",
    benchmark_report=f"""SELECT project_code, country, cluster, budget_usd, target_beneficiaries,
        {r('ben_per_1000_usd', 1)} AS efficiency, {r('funding_coverage_pct', 1)} AS coverage_pct,
        {r('cluster_avg_ben_ratio', 1)} AS cluster_avg_efficiency, {r('ben_ratio_zscore', 2)} AS z_score,
        outlier_classification AS status, benchmark_label FROM {_STRONGEST}""",
)

ORACLE["demo_projects"] = _sql(
    (*_TO_BENCHMARKS, *_TO_RANKINGS),
    """SELECT project_code, MIN(global_overlook_rank) AS best_rank
    FROM benchmarks JOIN rankings USING (iso3) WHERE global_overlook_rank <= 3
    GROUP BY project_code ORDER BY best_rank, project_code LIMIT 2""",
)
