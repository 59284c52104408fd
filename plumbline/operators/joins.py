"""Lookup joins and their audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(df: DataFrame, lookup: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left equi-join; lookup columns whose names are taken get the suffix _lookup.

    Spark broadcasts the lookup where its size is known to be small, and else shuffles.
    """
    names = {c: f"{c}_lookup" if c in df.columns else c for c in lookup.columns}
    renamed = lookup.select(*[F.col(c).alias(n) for c, n in names.items()])
    return df.join(renamed, df[left_key] == renamed[names[right_key]], "left")


def lookup_joins(df: DataFrame, lookups: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Several, in order; later ones see the columns of those before."""
    return reduce(lambda d, x: lookup_join(d, *x), lookups, df)


def join_audit(df: DataFrame, lookup: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: rows_attempted, matched, null_keys, unmatched, unmatched_rate, duplicate_keys.

    Keys are counted before the join, so a hot key is one row.
    """
    counts = df.groupBy(F.col(left_key).alias("_k")).agg(F.count("*").alias("_n"))
    keys = lookup.filter(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("_r")).agg(F.count("*").alias("_m"))
    met = counts.join(keys, F.col("_k") == F.col("_r"), "left")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    one = met.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_attempted"), total(F.col("_r").isNotNull()).alias("matched"), total(F.col("_k").isNull()).alias("null_keys"), total(F.col("_k").isNotNull() & F.col("_r").isNull()).alias("unmatched"), F.count_if(F.col("_m") > 1).alias("duplicate_keys"))
    rate = F.coalesce(F.round(F.try_divide(F.col("unmatched"), F.col("matched") + F.col("unmatched")), 6), F.lit(0.0))
    return one.select("rows_attempted", "matched", "null_keys", "unmatched", rate.alias("unmatched_rate"), "duplicate_keys")


def lookup_value_audit(df: DataFrame, lookup: DataFrame, left_key: str, right_key: str, sentinels: list[str]) -> DataFrame:
    """Per lookup column, over the matched rows: nulls, sentinel values, affected rows and
    their rate, and the affected keys of the whole lookup (sorted texts)."""
    values = [c for c in lookup.columns if c != right_key]
    counts = df.groupBy(F.col(left_key).alias("_k")).agg(F.count("*").alias("_n"))
    met = lookup.join(counts, F.col(right_key) == F.col("_k"), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    long = met.select(F.col(right_key).cast("string").alias("_key"), "_n", *[F.col(c).cast("string").alias(c) for c in values]).unpivot(["_key", "_n"], values, "column", "value")
    bad_null, bad_text = F.col("value").isNull(), F.coalesce(F.col("value").isin(*sentinels), F.lit(False))
    affected = F.sum(F.when(bad_null | bad_text, F.col("_n")).otherwise(0))
    out = long.groupBy("column").agg(F.sum(F.when(bad_null, F.col("_n")).otherwise(0)).alias("null_count"), F.sum(F.when(bad_text, F.col("_n")).otherwise(0)).alias("sentinel_count"), affected.alias("affected_rows"), F.coalesce(F.round(F.try_divide(affected, F.sum("_n")), 6), F.lit(0.0)).alias("affected_rate"), F.sort_array(F.collect_set(F.when(bad_null | bad_text, F.col("_key")))).alias("affected_keys"))
    return out


def join_summary(audits: list[DataFrame]) -> DataFrame:
    """(lookups, matched_events, unmatched_events) over join audits, which must all have
    tried the same number of rows."""
    rows = reduce(DataFrame.unionByName, audits)
    same = F.min("rows_attempted") == F.max("rows_attempted")
    matched = F.when(same, F.sum("matched")).otherwise(F.raise_error(F.lit("audits of different row counts")).cast("long"))
    return rows.agg(F.count("*").alias("lookups"), matched.alias("matched_events"), F.sum("unmatched").alias("unmatched_events"))


def unmatched_rows(df: DataFrame, lookup: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows without a partner; those with a null key are among them."""
    return df.join(lookup, df[left_key] == lookup[right_key], "left_anti")


def matched_rows(df: DataFrame, lookup: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return df.join(lookup, df[left_key] == lookup[right_key], "left_semi")
