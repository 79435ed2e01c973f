"""Derived tables that put the star-schema test tables into the shapes the operators work on.

The expressions are plain SQL, so that the same text serves the DataFrames here and the SQL that checks them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STREETS = [
    "s_suppkey * 2 AS id", "s_name AS name",
    "-4.64e1 + ((s_suppkey * 37) % 100) * 1e-2 AS x1", "-2.40e1 + ((s_suppkey * 53) % 100) * 1e-2 AS y1",
    "-4.64e1 + ((s_suppkey * 37) % 100) * 1e-2 + ((s_suppkey % 7) + 1) * 1e-3 AS x2", "-2.40e1 + ((s_suppkey * 53) % 100) * 1e-2 + ((s_suppkey % 5) - 2) * 1e-3 AS y2",
]
PTS = ["c_custkey AS cid", "-4.64e1 + ((c_custkey * 7919) % 1000) * 1e-3 AS lon", "-2.40e1 + ((c_custkey * 104729) % 1000) * 1e-3 AS lat"]
NODES = ["p_partkey AS node_id", "-4.64e1 + ((p_partkey * 7919) % 1000) * 1e-3 AS lon", "-2.40e1 + ((p_partkey * 104729) % 1000) * 1e-3 AS lat"]
REGION_BOUNDS = ["r_regionkey * 2 + 1 AS id", "2 AS level", "r_name AS name", "-4.64e1 + r_regionkey * 2e-1 AS minx", "-4.62e1 + r_regionkey * 2e-1 AS maxx", "-2.41e1 AS miny", "-2.29e1 AS maxy"]
NATION_BOUNDS = [
    "n_nationkey * 2 + 101 AS id", "4 AS level", "n_name AS name", "-4.64e1 + n_regionkey * 2e-1 AS minx", "-4.62e1 + n_regionkey * 2e-1 AS maxx",
    "-2.40e1 + floor(n_nationkey / 5e0) * 2e-1 AS miny", "-2.40e1 + floor(n_nationkey / 5e0) * 2e-1 + 2e-1 AS maxy",
]
NUMBER = """CASE c_custkey % 6 WHEN 0 THEN concat('', c_custkey % 400) WHEN 1 THEN concat(' ', c_custkey % 400, ' a ') WHEN 2 THEN concat(c_custkey % 400, '-b')
 WHEN 3 THEN concat(c_custkey % 400, 'c') WHEN 4 THEN 'S/N' ELSE concat(c_custkey % 400, '-', c_custkey % 400 + 2) END"""
TAGGED = [
    "o_orderkey AS way_id", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS name",
    "CASE o_orderkey % 11 WHEN 0 THEN 'neighbourhood' WHEN 1 THEN 'suburb' END AS place",
    "CASE o_orderkey % 11 WHEN 2 THEN 'residential' WHEN 3 THEN 'primary' WHEN 4 THEN 'secondary' WHEN 5 THEN 'tertiary' WHEN 6 THEN 'unclassified' WHEN 7 THEN 'living_street' WHEN 1 THEN 'residential' END AS highway",
    "CASE o_orderkey % 11 WHEN 8 THEN 'park' END AS leisure", "CASE o_orderkey % 11 WHEN 9 THEN 'yes' END AS building", "CASE o_orderkey % 11 WHEN 10 THEN 'river' END AS waterway",
]


def cte(name: str, columns: list[str], source: str) -> str:
    return f"{name} AS (SELECT {', '.join(columns)} FROM {source})"


BOUNDS_SQL = f"bounds AS (SELECT {', '.join(REGION_BOUNDS)} FROM region UNION ALL SELECT {', '.join(NATION_BOUNDS)} FROM nation)"
HN_SQL = f"hn AS (SELECT c_custkey AS node_id, {NUMBER} AS number, {PTS[1]}, {PTS[2]}, CASE WHEN c_custkey % 3 = 0 THEN s_name END AS addr_street FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier))"


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def streets(self) -> DataFrame:
        return self.table("supplier").selectExpr(*STREETS)

    def points(self) -> DataFrame:
        return self.table("customer").selectExpr(*PTS)

    def nodes(self) -> DataFrame:
        return self.table("part").selectExpr(*NODES)

    def bounds(self) -> DataFrame:
        return self.table("region").selectExpr(*REGION_BOUNDS).unionByName(self.table("nation").selectExpr(*NATION_BOUNDS))

    def tagged(self) -> DataFrame:
        return self.table("orders").selectExpr(*TAGGED)

    def house_nodes(self) -> DataFrame:
        n = self.table("supplier").count()
        names = self.table("supplier").selectExpr("s_suppkey", "s_name")
        c = self.table("customer").selectExpr("c_custkey", "c_custkey AS node_id", f"{NUMBER} AS number", *PTS[1:], f"c_custkey % {n} AS k")
        return c.join(names, c.k == names.s_suppkey, "left").selectExpr("node_id", "number", "lon", "lat", "CASE WHEN c_custkey % 3 = 0 THEN s_name END AS addr_street")
