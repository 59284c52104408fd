"""Reachability over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import checkpoint


def reachability(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, depth): ids reached from ``start`` (id) along edges (source, target), each
    with its least depth. Every step joins the newest ids only; steps go on until none is new."""
    edges = edges.filter("source is not null and target is not null").select("source", "target").distinct()
    seen = checkpoint(start.select("id").distinct().withColumn("depth", F.lit(0)))
    newest, depth = seen, 0
    while True:
        depth += 1
        step = newest.join(edges, newest["id"] == edges["source"]).select(F.col("target").alias("id")).distinct()
        newest = checkpoint(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if newest.limit(1).count() == 0:
            return seen
        seen = checkpoint(seen.unionByName(newest))


def scope(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(source, target) edges of what ``start`` reaches forwards and backwards."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    ids = reachability(edges, start).select("id").union(reachability(back, start).select("id")).distinct()
    return edges.select("source", "target").distinct().join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi")


def missing_parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source): sources of edges that are no nodes (id)."""
    return edges.select("source").distinct().join(nodes, F.col("source") == F.col("id"), "left_anti")
