"""Connected components of an edge table, by alternating stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or smaller) neighbours move to its least one."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    both = edges.unionByName(turned) if large else (
        edges.filter("v <= u").unionByName(turned.filter("v <= u")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("u", "m"))
    rows = both.join(least, "u")
    if large:
        moved = rows.filter("v > u").select(F.col("v").alias("u"),
                                            F.col("m").alias("v"))
    else:
        moved = (rows.filter("v < u").select(F.col("v").alias("u"),
                                             F.col("m").alias("v"))
                 .unionByName(rows.select("u", F.col("m").alias("v"))))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every id with an edge.

    edges: long columns u, v. The number of rounds grows with the logarithm of
    the longest path; every round is written to the shared folder. Joins are
    split where one node has very many neighbours.
    """
    seen = None
    edges = stored(edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(), "edges")
    while True:
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(
            F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias(
                "h")).first()
        if now == seen:
            break
        seen = now
        edges = stored(star(star(edges, True), False), "edges")
    return edges.groupBy(F.col("u").alias("id")).agg(
        F.min("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component"))
        .distinct())
