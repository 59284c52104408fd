"""Splits, samples and assignments of exact size, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import build_derived
from ..functions.filters import FilterSpec, exclude_any, filter_all
from ..functions.order import first_per_group, global_index, hash_index, per_group, quotas, sample_n


def split_random(df: DataFrame, fraction: float, keys: list[str], seed: int) -> DataFrame:
    """Add part: ceil(n * fraction) rows are "val", the others "train"."""
    ranked = hash_index(df, keys, seed, "_i")
    n = df.agg(F.count("*").alias("_n"))
    return ranked.join(F.broadcast(n)).withColumn("part", F.when(F.col("_i") < F.ceil(F.round(F.col("_n") * fraction, 9)), "val").otherwise("train")).drop("_i", "_n")


def split_time(df: DataFrame, fraction: float, time: str, keys: list[str]) -> DataFrame:
    """Add part: the first floor(n * (1 - fraction)) rows in time are "train"; nulls last."""
    ranked = global_index(df, F.asc_nulls_last(time), *keys, name="_i")
    n = df.agg(F.count("*").alias("_n"))
    return ranked.join(F.broadcast(n)).withColumn("part", F.when(F.col("_i") < F.floor(F.round(F.col("_n") * (1 - fraction), 9)), "train").otherwise("val")).drop("_i", "_n")


def split_stratified(df: DataFrame, fraction: float, label: str, keys: list[str], seed: int) -> DataFrame:
    """Add part: ceil(n * fraction) rows in all are "val", by largest remainders per class."""
    total = df.count()
    wanted = -(-round(total * fraction * 1e9) // 10**9)
    plan = quotas(df.groupBy(label).agg(F.count("*").alias("n")), wanted, label).select(F.col(label).alias("_l"), "quota")
    ranked = per_group(df, label, keys, seed, "_r")
    return ranked.join(plan, ranked[label].eqNullSafe(F.col("_l"))).withColumn("part", F.when(F.col("_r") <= F.col("quota"), "val").otherwise("train")).drop("_r", "_l", "quota")


def split(df: DataFrame, fraction: float, keys: list[str], method: str = "random", seed: int = 0, time: str | None = None, label: str | None = None) -> DataFrame:
    """By time where a time column is given, stratified where a label is, else at random."""
    if method == "time":
        if not time:
            raise ValueError("a split by time needs a time column")
        return split_time(df, fraction, time, keys)
    if method == "stratified":
        if not label:
            raise ValueError("a stratified split needs a class label")
        return split_stratified(df, fraction, label, keys, seed)
    return split_random(df, fraction, keys, seed)


def sample_per_group(df: DataFrame, group: str, k: int, keys: list[str], seed: int) -> DataFrame:
    """At most k rows of each group, chosen at random."""
    return first_per_group(df, group, k, keys, seed)


def sample_frac(df: DataFrame, group: str, fraction: float, keys: list[str], seed: int) -> DataFrame:
    """round(n * fraction) rows of each group."""
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    ranked = per_group(df, group, keys, seed, "_r")
    return ranked.join(sizes, ranked[group].eqNullSafe(F.col("_g"))).filter(F.col("_r") <= F.bround(F.col("_n") * fraction)).drop("_r", "_n", "_g")


def sample_balanced(df: DataFrame, group: str, keys: list[str], seed: int) -> DataFrame:
    """As many rows of each group as the smallest has."""
    base = df.filter(F.col(group).isNotNull())
    least = base.groupBy(group).agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))
    return per_group(base, group, keys, seed, "_r").join(F.broadcast(least)).filter(F.col("_r") <= F.col("_least")).drop("_r", "_least")


def named_sample(df: DataFrame, columns: list[str], size: int | None, keys: list[str], seed: int, derived=(), filters: list[FilterSpec] = (), exclude: list[list[FilterSpec]] = ()) -> DataFrame:
    """Prune, sample (no ``size``: all rows), derive, filter, exclude: filters come after
    the sample and see what it derives."""
    out = df.select(*columns)
    out = out if size is None else sample_n(out, size, keys, seed)
    out = build_derived(out, list(derived)) if derived else out
    return exclude_any(filter_all(out, filters), exclude)


def assign_random(df: DataFrame, n: int, keys: list[str], seed: int) -> DataFrame:
    """Add treated: 1 for exactly n rows; n beyond the rows is an error."""
    total = df.count()
    if not 0 <= n <= total:
        raise ValueError(f"cannot assign {n} of {total} rows")
    return hash_index(df, keys, seed, "_i").withColumn("treated", (F.col("_i") < n).cast("int")).drop("_i")


def assignment_quotas(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """(stratum, n, quota) by largest remainders."""
    return quotas(df.groupBy(stratum).agg(F.count("*").alias("n")), n, stratum)


def assign_stratified(df: DataFrame, stratum: str, n: int, keys: list[str], seed: int) -> DataFrame:
    """Add treated: 1 for exactly n rows, in proportion to the strata."""
    total = df.count()
    if not 0 <= n <= total:
        raise ValueError(f"cannot assign {n} of {total} rows")
    plan = assignment_quotas(df, stratum, n).select(F.col(stratum).alias("_s"), "quota")
    ranked = per_group(df, stratum, keys, seed, "_r")
    return ranked.join(plan, ranked[stratum].eqNullSafe(F.col("_s"))).withColumn("treated", (F.col("_r") <= F.col("quota")).cast("int")).drop("_r", "_s", "quota")
