"""Quantiles: exact, or from a summary of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import checkpoint

ACCURACY = 10_000
"""The summary's rank error is at most one part in this."""


def summary_quantile(c: Column | str, q: float) -> Column:
    """A quantile from a summary of bounded size."""
    return F.percentile_approx(c, q, ACCURACY)


def group_quantiles(df: DataFrame, group: str, value: str, qs: dict[str, float]) -> DataFrame:
    """(group, distinct_count, a column of each of ``qs``): exact quantiles of the non-null
    values of each group, interpolated linearly between ranks.

    Values are counted where they stand, sorted by ranges over all tasks, and ranks are
    running sums of the counts; only one count per range meets in one task, so neither a
    column nor a group has to fit in one. Groups without values give no row.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ordered = checkpoint(counts.repartitionByRange(F.asc_nulls_first("_g"), "_v").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("_part").agg(F.sum("_n").alias("_s")).select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    run = Window.partitionBy("_part").orderBy(F.asc_nulls_first("_g"), "_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumn("_in", F.coalesce(F.sum("_n").over(run), F.lit(0))).join(F.broadcast(offsets), "_part")  # a row per range
    placed = placed.select("_g", "_v", "_n", (F.col("_off") + F.col("_in")).alias("_at"))
    totals = placed.groupBy(F.col("_g").alias("_h")).agg(F.min("_at").alias("_start"), F.sum("_n").alias("_total"))
    met = placed.join(totals, F.col("_g").eqNullSafe(F.col("_h"))).withColumn("_at", F.col("_at") - F.col("_start"))

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("_at") <= k) & (k < F.col("_at") + F.col("_n")), F.col("_v")))

    rank = {name: F.lit(q) * (F.col("_total") - 1) for name, q in qs.items()}
    found = met.groupBy("_g", "_total").agg(F.count("*").alias("distinct_count"), *[at(f(r)).alias(f"{name}_{k}") for name, r in rank.items() for k, f in (("low", F.floor), ("high", F.ceil))])
    low, high = (lambda name, k=k: F.col(f"{name}_{k}") for k in ("low", "high"))
    between = [F.when(low(name) == high(name), low(name)).otherwise(low(name) + (high(name) - low(name)) * (r - F.floor(r))).alias(name) for name, r in rank.items()]
    return found.select(F.col("_g").alias(group), "distinct_count", *between)


def row_quantiles(df: DataFrame, values: dict[str, Column], qs: dict[str, float], approx: bool = False) -> DataFrame:
    """One row with a column ``<value>_<q>`` for each of the values and quantiles (null
    where there are no values): all columns at once by ``group_quantiles``, or from
    summaries."""
    if approx:
        return df.agg(*[summary_quantile(v, q).alias(f"{n}_{k}") for n, v in values.items() for k, q in qs.items()])
    long = df.select(*[v.cast("double").alias(n) for n, v in values.items()]).unpivot([], list(values), "_c", "_x")
    found = group_quantiles(long, "_c", "_x", qs)
    return found.agg(*[F.max(F.when(F.col("_c") == n, F.col(k))).alias(f"{n}_{k}") for n in values for k in qs])
