"""Needs, projects and allocations derived from an order-entry star schema.

An entity is a customer, a project is a part with sales, a pooled-fund
allocation is a customer's discount per return flag. Money has two places,
so it is added as whole cents: exact, in any order, in one machine word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needscope import schemas
from needscope.functions.allocations import allocation_musd
from needscope.functions.numbers import money_cents
from needscope.functions.projects import beneficiaries_per_1000, project_code, project_coverage_pct

# Budget edges of the fixed project groups, in dollars.
GROUP_EDGES = (1.27e6, 1.43e6, 1.58e6, 1.72e6, 1.90e6)


def _whole(value: Column) -> Column:
    return F.rint(value).cast("bigint")


def entity_lines(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Quantity and discount per customer and return flag.

    The only join of the two large tables. Needs and allocations both start
    from this much smaller result.
    """
    lines = lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"),
        "l_returnflag",
        _whole(F.col("l_quantity")).alias("quantity"),
        # price has two places, discount two: units of 1/10000
        _whole(F.col("l_extendedprice") * F.col("l_discount") * 10_000).alias("discount_units"),
    )
    owned = lines.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    return owned.groupBy("o_custkey", "l_returnflag").agg(
        F.sum("quantity").alias("quantity"), F.sum("discount_units").alias("discount_units")
    )


def needs(
    customer: DataFrame, nation: DataFrame, region: DataFrame, orders: DataFrame, entity_lines: DataFrame
) -> DataFrame:
    """One row per customer with orders."""
    cents = money_cents(F.col("o_totalprice"))
    asked = orders.groupBy("o_custkey").agg(
        F.max(F.year("o_orderdate")).alias("year"),
        F.sum(cents).alias("asked"),
        F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", cents)), F.lit(0)).alias("received"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    moved = entity_lines.groupBy("o_custkey").agg(
        F.sum("quantity").alias("quantity"), F.sum("discount_units").alias("discount_units")
    )
    facts = asked.join(moved, "o_custkey", "left")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    joined = customer.join(facts, F.col("c_custkey") == F.col("o_custkey")).join(
        places, F.col("c_nationkey") == F.col("n_nationkey")
    )
    zero = F.lit(0)
    values = {
        "country": F.col("c_name"),
        "iso3": F.col("c_custkey").cast("string"),
        "year": F.col("year"),
        "people_in_need_millions": F.coalesce("quantity", zero) / 100,
        "required_funding_musd": F.col("asked") / 100_000,
        "funding_received_musd": F.col("received") / 100_000,
        "cbpf_allocation_musd": F.coalesce("discount_units", zero) / 10_000_000,
        "severity": 1 + F.least(F.lit(3), F.col("urgent")),
        "primary_cluster": F.col("c_mktsegment"),
        "region": F.col("r_name"),
        "latitude": F.col("c_nationkey") * 5 - 60,
        "longitude": F.col("c_nationkey") * 14 - 170,
        "population_millions": F.abs("c_acctbal") / 100,
    }
    return _contract(joined, values, schemas.NEEDS)


def projects(part: DataFrame, lineitem: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame:
    """One row per sold part; its entity is the customer of the first order."""
    cents = money_cents(F.col("l_extendedprice"))
    sold = lineitem.groupBy("l_partkey").agg(
        F.sum(cents).alias("budget"),
        F.sum(_whole(F.col("l_quantity"))).alias("quantity"),
        F.coalesce(F.sum(F.when(F.col("l_linestatus") == "F", cents)), F.lit(0)).alias("received"),
        F.min("l_orderkey").alias("first_order"),
    )
    dated = orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    joined = (
        part.select("p_partkey", "p_brand", "p_type")
        .join(sold, F.col("p_partkey") == F.col("l_partkey"))
        .join(dated, F.col("first_order") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
        .withColumns(
            {
                "budget_usd": F.expr("budget div 100"),
                "funding_received_usd": F.expr("received div 100"),
                "iso3": F.col("c_custkey").cast("string"),
            }
        )
    )
    budget = F.col("budget_usd")
    values = {
        "project_code": project_code(F.col("iso3"), F.col("p_type"), F.col("p_partkey")),
        "country": F.col("c_name"),
        "iso3": F.col("iso3"),
        "cluster": F.col("p_type"),
        "organization": F.col("p_brand"),
        "year": F.col("year"),
        "budget_usd": budget,
        "target_beneficiaries": F.col("quantity"),
        "funding_received_usd": F.col("funding_received_usd"),
        "beneficiaries_per_1000_usd": beneficiaries_per_1000(F.col("quantity"), budget),
        "funding_coverage_pct": project_coverage_pct(F.col("funding_received_usd"), budget),
    }
    return _contract(joined, values, schemas.PROJECTS)


def allocations(customer: DataFrame, entity_lines: DataFrame, needs: DataFrame) -> DataFrame:
    """One row per customer and return flag, in the year of the need."""
    kusd = F.col("discount_units") / 10_000
    years = needs.select("iso3", "year")
    joined = (
        entity_lines.join(customer.select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("iso3", F.col("c_custkey").cast("string"))
        .join(years, "iso3")
    )
    values = {
        "country": F.col("c_name"),
        "iso3": F.col("iso3"),
        "cluster": F.col("c_mktsegment"),
        "allocation_kusd": kusd,
        "year": F.col("year"),
        "allocation_type": F.col("l_returnflag"),
        "allocation_musd": allocation_musd(kusd),
    }
    return _contract(joined, values, schemas.ALLOCATIONS)


def fixed_groups(projects: DataFrame) -> DataFrame:
    """Group 0 to 5 by budget band: stable groups to check lookups against."""
    reached = [F.when(F.col("budget_usd") >= edge, 1).otherwise(0) for edge in GROUP_EDGES]
    band = reached[0]
    for step in reached[1:]:
        band = band + step
    return projects.withColumn("benchmark_group", band.cast("int"))


def _contract(df: DataFrame, values: dict[str, Column], schema) -> DataFrame:
    return df.select(*[values[field.name].cast(field.dataType).alias(field.name) for field in schema.fields])
