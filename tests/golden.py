"""Small input tables with results that can be checked by hand."""

from needscope import schemas
from needscope.sources.readers import conform

# The 25-row needs table.
# iso3, region, people in need, required, received, pooled, severity
NEEDS = """
AFG,Asia,28.3,3231,1566,89.2,4
SYR,Middle East,15.3,5426,3044,45.1,4
YEM,Middle East,21.6,4338,2403,67.3,4
ETH,East Africa,20.1,2571,1089,78.4,3
SDN,East Africa,18.0,2571,583,34.2,4
UKR,Europe,14.6,4284,3890,12.1,3
SOM,East Africa,7.8,2597,1089,91.3,4
COD,Central Africa,23.4,2647,982,112.7,4
MMR,Asia,17.6,980,334,28.6,3
HTI,Americas,5.5,720,354,67.1,3
CAF,Central Africa,3.4,528,196,45.2,3
TCD,West Africa,6.9,680,267,38.1,3
NER,West Africa,4.3,459,169,29.4,3
MLI,West Africa,8.8,578,213,31.2,3
LBY,North Africa,1.4,247,104,18.7,2
VEN,Americas,7.1,185,78,8.3,2
IRQ,Middle East,5.5,573,352,42.1,3
PSE,Middle East,2.7,1200,710,15.4,4
PAK,Asia,14.6,816,492,23.2,3
MOZ,East Africa,2.1,278,134,19.8,2
SSD,East Africa,9.4,1736,623,87.3,4
LBY,North Africa,1.4,247,104,18.7,2
NGA,West Africa,7.1,922,438,38.4,3
BFA,West Africa,4.7,672,198,22.1,3
CMR,West Africa,3.9,479,187,19.3,3
"""

# Pooled-fund allocations in thousand dollars, iso3 and amounts.
ALLOCATIONS = """
AFG,32100,28400,18700
YEM,19300,13800,12000
ETH,34200,23100
SDN,15600,12400
COD,42100,38700,21900
SOM,38200,31400,21700
SSD,35100,28900
MMR,16300,12300
SYR,18400,15700
HTI,22100,21800
CAF,19800
NER,12400
TCD,16700
MLI,14200
NGA,15900
"""


def needs(spark):
    names = (
        "iso3", "region", "people_in_need_millions", "required_funding_musd",
        "funding_received_musd", "cbpf_allocation_musd", "severity",
    )
    rows = [tuple(line.split(",")) for line in NEEDS.strip().splitlines()]
    text = spark.createDataFrame(rows, ", ".join(f"{name} string" for name in names))
    full = text.selectExpr("*", "iso3 AS country", "2023 AS year", "'Food Security' AS primary_cluster")
    return conform(full, schemas.NEEDS)


def allocations(spark):
    lines = [line.split(",") for line in ALLOCATIONS.strip().splitlines()]
    rows = [(code, i, float(amount)) for code, *amounts in lines for i, amount in enumerate(amounts)]
    df = spark.createDataFrame(rows, "iso3 string, i int, allocation_kusd double")
    full = df.selectExpr(
        "iso3", "iso3 AS country", "concat('Sector ', i) AS cluster", "2023 AS year",
        "'Standard' AS allocation_type", "allocation_kusd", "allocation_kusd / 1000 AS allocation_musd",
    )
    return conform(full, schemas.ALLOCATIONS)


def projects(spark, rows):
    """(code, cluster, budget, beneficiaries, received) to project rows."""
    df = spark.createDataFrame(rows, "project_code string, cluster string, budget_usd long, "
                                     "target_beneficiaries long, funding_received_usd long")
    full = df.selectExpr(
        "*", "'SDN' AS iso3", "'SDN' AS country", "'Org' AS organization", "2023 AS year",
        "round(target_beneficiaries / (nullif(budget_usd, 0) / 1000), 3) AS beneficiaries_per_1000_usd",
        "round(funding_received_usd / nullif(budget_usd, 0) * 100, 1) AS funding_coverage_pct",
    )
    return conform(full, schemas.PROJECTS)
