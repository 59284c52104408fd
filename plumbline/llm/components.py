"""Connected components of an edge table, by Spark joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``edges`` (a long, b long): the smallest id that
    can be reached. Edges with a null end are left out; an empty table gives none.

    In each round every id points to the smallest among itself and its neighbours, then
    to where that one points until nothing moves; edges are drawn anew between what their
    ends point to, and those within one point vanish. What is left are ids smaller than
    all their neighbours, half of the ids at most, so the rounds together see few more
    edges than the first. Minima are combined
    before the shuffle, so an id with very many neighbours is no burden. No links or
    labels reach the driver, not for a broadcast either.
    """
    ends = edges.filter("a is not null and b is not null and a <> b")
    left = common.checkpoint(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    for _ in range(max_rounds):
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = common.checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to")))
        moved = True
        while moved:
            onward = common.merged(point.select(F.col("id").alias("_i"), F.col("to").alias("_to")))
            point = common.checkpoint(point.join(onward, point["to"] == onward["_i"]).select("id", F.col("to").alias("was"), F.col("_to").alias("to")))
            moved = point.filter("was <> to").limit(1).count() > 0
        point = point.select("id", "to")
        if labels is None:
            labels = point.select("id", F.col("to").alias("component"))
        else:
            step = common.merged(point.select(F.col("id").alias("_i"), F.col("to").alias("_to")))
            labels = common.checkpoint(labels.join(step, labels["component"] == step["_i"], "left").select("id", F.coalesce("_to", "component").alias("component")))
        x = common.merged(point.select(F.col("id").alias("a"), F.col("to").alias("x")))
        y = common.merged(point.select(F.col("id").alias("b"), F.col("to").alias("y")))
        drawn = left.join(x, "a").join(y, "b").filter("x <> y")
        left = common.checkpoint(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if not left.limit(1).count():
            return labels
    raise RuntimeError("components did not settle")
