"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from drygrid.llm.common import sized, written


def _star(edges: DataFrame, larger: bool, within: DataFrame) -> DataFrame:
    """Link the larger (or smaller) neighbours of every node to the least of its neighbourhood. Edges are (u, v) with u > v, no more than ``within`` has twice."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(turned) if larger else edges
    least = sized(around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), within)
    if larger:
        moved = turned.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.filter("u > v").distinct()
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``id``, ``component`` for every node of ``links``: the least id that can be reached. Self-links and NULLs are ignored.

    Each round is written to the shared folder; only a count and a checksum reach the driver, which stops when a round changes nothing.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    seen = None
    while True:
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first()
        state = (row[0], row[1])
        if state == seen or not row[0]:
            break
        seen = state
        edges = written(_star(_star(edges, True, edges), False, edges))
    both = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")))
    return written(both.distinct())
