"""Connected components of an edge table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needscope.sources.scratch import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component: least node.

    Alternates large-star and small-star steps until only stars are left. Each
    step takes minima with a combining aggregate and joins them back, so no
    neighbourhood is gathered in one task. Every round is written to the
    shared folder. Nulls and self links are ignored; repeated rows count once.
    """
    pairs = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while not _only_stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", "m"))
        pairs = settle(small.distinct(), "edges")
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _only_stars(pairs: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    up, down = F.lit(1), F.lit(0)
    ends = pairs.select(F.col("u").alias("node"), up.alias("up"), down.alias("down")).union(pairs.select("v", down, up))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").agg(F.count("*")).first()[0] == 0
