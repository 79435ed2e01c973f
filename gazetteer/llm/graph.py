"""Connected components of a graph given as a table of links.

Large-star and small-star rounds: each node hangs its larger neighbours, then its smaller ones, on the smallest node it
knows, until each component is a star.  A round is two joins of links with one minimum a node; the minima are combined
before they are shuffled, and the only skewed side of a join is the one that adaptive plans split.  Nothing is gathered
on the driver but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for each node of `links` (a, b); links may repeat, in either
    direction.  Loops count as nothing, so a node with no other link has no row."""
    links = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        seen = Observation()
        old, links = links, written(small.where(F.col("u") != F.col("v")).distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
        discard(old)
        now = (seen.get["n"], seen.get["sum"])
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
