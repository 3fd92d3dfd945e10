"""Scopes: rollups over a hierarchy, subtrees, and walks with depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hierarchy_rollup(region: DataFrame, nation: DataFrame, customer: DataFrame, orders: DataFrame) -> DataFrame:
    """(r_name, n_name, n, total, gid) at every level. Orders are summed by nation first, so
    that the rollup expands tens of rows, not orders."""
    by_nation = (
        orders.select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("x"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.count("*").alias("n"), F.sum("x").alias("x"))
    )
    named = by_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.rollup("r_name", "n_name").agg(F.sum("n").cast("long").alias("n"), F.sum("x").cast("decimal(38,2)").alias("total"), F.grouping_id().cast("long").alias("gid"))


def scope_filter(region_name: str, region: DataFrame, nation: DataFrame, customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders below one region, by semi joins: no row is multiplied."""
    nations = nation.join(region.where(F.col("r_name") == region_name), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    customers = customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


WALK = """
WITH RECURSIVE edges(parent, child) AS (
  SELECT 'region:' || r_name, 'nation:' || n_name FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'world', 'region:' || r_name FROM region
), walk(id, depth) AS (
  SELECT 'world', 0 UNION ALL SELECT child, depth + 1 FROM walk JOIN edges ON parent = id
) SELECT id, CAST(depth AS BIGINT) AS depth FROM walk
"""
