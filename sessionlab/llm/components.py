"""Connected components of a link table as Spark joins: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlab.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(
        least.select("a", F.col("m").alias("b")))


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``links(a, b)``; the component is the smallest node reachable.

    Each round replaces the links by stars around smaller nodes (no group is ever gathered: minimum per node and a join
    back, which adaptive execution splits where a node has very many links), and is written to the shared folder. Rounds
    end when a round changes nothing, which takes about the logarithm of the longest path. Self links and repeated
    links are ignored, null ends dropped. A node that has only a self link is not returned.
    """
    now = links.where("a is not null and b is not null and a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = stored(now, "links"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        now = stored(_small_star(_large_star(now)).distinct(), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
