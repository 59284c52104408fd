"""Global order without one task: exact ranks, samples and quotas."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what the
    session set. Only a local session without one is given a temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir
    if not known().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return known().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


RANGE_ROWS = 1 << 20
"""Rows of a range of a global order, about: large tables have more ranges than the session
has shuffle partitions, so that what a task reads does not grow with the table."""


def global_index(df: DataFrame, *order: Column | str, name: str = "index") -> DataFrame:
    """Add the row's place (from 0) in the order given, which should have no ties.

    Rows are sorted by ranges over all tasks; only a count per range meets in one.
    """
    ranges = -(-df.count() // RANGE_ROWS)
    dealt = (ranges, *order) if ranges > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else order
    ordered = checkpoint(df.repartitionByRange(*dealt).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.call_function("shiftright", F.col("_at"), F.lit(33))
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # a row per range
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def hash_of(keys: list[str], seed: int) -> Column:
    return F.xxhash64(*keys, F.lit(seed))


def hash_index(df: DataFrame, keys: list[str], seed: int, name: str = "index") -> DataFrame:
    """A random order that depends on the rows' keys (which should be unique) and seed alone."""
    return global_index(df.withColumn("_h", hash_of(keys, seed)), "_h", *keys, name=name).drop("_h")


def sample_n(df: DataFrame, n: int, keys: list[str], seed: int) -> DataFrame:
    """Exactly min(n, rows) rows, by the order of a hash of their keys."""
    return df.withColumn("_h", hash_of(keys, seed)).orderBy("_h", *keys).limit(n).drop("_h")


def per_group(df: DataFrame, group: str, keys: list[str], seed: int, name: str = "rank") -> DataFrame:
    """Add the row's random rank (from 1) within its group.

    Ranks come from one order over all rows, by group and then by hash, so that a group
    which holds most rows is spread over many tasks.
    """
    placed = global_index(df.withColumn("_h", hash_of(keys, seed)), F.asc_nulls_first(group), "_h", *keys, name="_place").drop("_h")
    starts = checkpoint(placed.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_start")))
    met = placed.join(starts, placed[group].eqNullSafe(starts["_group"]))
    return met.withColumn(name, F.col("_place") - F.col("_start") + 1).drop("_place", "_group", "_start")


def first_per_group(df: DataFrame, group: str, k: int, keys: list[str], seed: int) -> DataFrame:
    """At most k random rows of each group; Spark keeps k of a group in each task before
    the groups meet."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(hash_of(keys, seed), *keys)))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def quotas(sizes: DataFrame, total: int, order: str) -> DataFrame:
    """Largest-remainder quotas: add quota to rows (order, n) so that they sum to ``total``.
    Equal remainders go by ``order``. However many rows there are, no task ranks them all."""
    sizes = checkpoint(sizes)
    whole = sizes.agg(F.sum("n").alias("_whole"))
    share = F.col("n") * F.lit(total) / F.col("_whole")
    out = sizes.join(F.broadcast(whole)).withColumn("_floor", F.floor(share)).withColumn("_rest", F.round(share - F.col("_floor"), 9)).drop("_whole")  # one row
    left = out.agg((F.lit(total) - F.sum("_floor")).alias("_left"))
    ranked = global_index(out, F.desc("_rest"), order, name="_rank").join(F.broadcast(left))  # one row
    return ranked.withColumn("quota", (F.col("_floor") + (F.col("_rank") < F.col("_left")).cast("long")).cast("long")).drop("_floor", "_rest", "_rank", "_left")
