"""Contract and quality checks; each gives a table of what it found."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.filters import FilterSpec, predicate
from ..sources.tables import committed_sample, definition_hash, table_digest

LEVELS = ("PASS", "WARNING", "INCOMPLETE")


def check_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    """(column, level): missing ones are issues, extra ones warnings."""
    rows = [(c, "issue", "missing") for c in expected if c not in df.columns] + [(c, "warning", "extra") for c in df.columns if c not in expected]
    return df.sparkSession.createDataFrame(rows, "column string, level string, reason string")


def check_nulls(df: DataFrame, most: float) -> DataFrame:
    """(column, null_rate, ok) of all columns; a rate above ``most`` fails."""
    rates = df.agg(*[F.coalesce(F.avg(F.col(c).isNull().cast("int")), F.lit(0.0)).alias(c) for c in df.columns])
    return rates.unpivot([], df.columns, "column", "null_rate").withColumn("ok", F.col("null_rate") <= most)


def check_dtypes(df: DataFrame, schema: StructType) -> DataFrame:
    """(column, expected, found) where a column is absent or of another type."""
    found = dict(df.dtypes)
    rows = [(f.name, f.dataType.simpleString(), found.get(f.name)) for f in schema.fields if found.get(f.name) != f.dataType.simpleString()]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, found string")


def check_values(df: DataFrame, rules: list[FilterSpec], not_null: tuple[str, ...] = ()) -> DataFrame:
    """(column, rule, violations) of every rule, in one pass. Nulls break only not_null."""
    tests = [(s.column, f"{s.op} {s.value:g}", F.count_if(F.col(s.column).isNotNull() & ~predicate(s))) for s in rules]
    tests += [(c, "not null", F.count_if(F.col(c).isNull())) for c in not_null]
    found = df.agg(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), t.alias("violations")).alias(f"r{i}") for i, (c, r, t) in enumerate(tests)])
    return found.select(F.inline(F.array(*[f"r{i}" for i in range(len(tests))])))


def check_engineered(df: DataFrame, schema: StructType) -> DataFrame:
    """(column, rule, violations): wrong types, and nulls where the schema allows none."""
    wrong = check_dtypes(df, schema).select("column", F.lit("dtype").alias("rule"), F.lit(1).cast("long").alias("violations"))
    strict = tuple(f.name for f in schema.fields if not f.nullable and f.name in df.columns)
    return wrong.unionByName(check_values(df, [], strict)) if strict else wrong


def check_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, bad): null, NaN and infinite values."""
    bad = {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in columns}
    return df.agg(*[F.count_if(b).alias(c) for c, b in bad.items()]).unpivot([], columns, "column", "bad")


def require_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """df; raises if a value is missing or not finite."""
    bad = check_finite(df, columns).filter("bad > 0").collect()  # a row per column
    if bad:
        raise ValueError("not finite: " + ", ".join(f"{r['column']} ({r['bad']})" for r in bad))
    return df


def validate_groups(df: DataFrame, group: str, y: str) -> DataFrame:
    """(level, reason): errors for fewer than 2 groups, groups of fewer than 2, values that
    are not finite and no variance at all; a warning for one group without variance."""
    value = F.col(y).cast("double")
    stats = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.count_if(F.isnan(value) | (F.abs(value) == float("inf"))).alias("odd"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    one = stats.agg(F.count("*").alias("k"), F.count_if(F.col("n") < 2).alias("small"), F.coalesce(F.sum("odd"), F.lit(0)).alias("odd"), F.count_if(F.col("v") == 0).alias("flat"))
    tests = [("error", "fewer than 2 groups", F.col("k") < 2), ("error", "group of fewer than 2", F.col("small") > 0), ("error", "not finite", F.col("odd") > 0), ("error", "no variance", (F.col("k") > 0) & (F.col("flat") == F.col("k"))), ("warning", "group without variance", (F.col("flat") > 0) & (F.col("flat") < F.col("k")))]
    items = F.array(*[F.when(t, F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"))) for level, reason, t in tests])
    return one.select(F.explode(F.array_compact(items)).alias("x")).select("x.level", "x.reason")


def require_groups(df: DataFrame, group: str, y: str) -> DataFrame:
    """df; raises on the errors of validate_groups."""
    errors = [r["reason"] for r in validate_groups(df, group, y).filter("level = 'error'").collect()]  # 4 rows at most
    if errors:
        raise ValueError("; ".join(errors))
    return df


def readiness(checks: list[DataFrame]) -> DataFrame:
    """(checks, verdict) of tables (kind, status): the worst status decides."""
    rows = reduce(DataFrame.unionByName, checks)
    rank = F.max(F.when(F.col("status") == "PASS", 0).when(F.col("status") == "WARNING", 1).otherwise(2))
    return rows.agg(F.count("*").alias("checks"), rank.alias("r")).select("checks", F.when(F.col("r") == 0, "READY").when(F.col("r") == 1, "READY WITH WARNINGS").otherwise("INCOMPLETE").alias("verdict"))


def validate_sample(df: DataFrame, rows: int, digest: tuple[str, int], definition: str, expected_definition: str, schema: StructType, rules: list[FilterSpec] = ()) -> DataFrame:
    """(check, ok) of a stored sample against what was recorded when it was written."""
    now = table_digest(df).first()
    broken = check_values(df, list(rules)).filter("violations > 0").count() if rules else 0
    found = [("rows", now["rows"] == rows), ("digest", (now["digest_sum"], now["digest_xor"]) == tuple(digest)), ("definition", definition == expected_definition), ("schema", check_dtypes(df, schema).count() == 0), ("values", broken == 0)]
    return df.sparkSession.createDataFrame(found, "check string, ok boolean")


def validate_committed(spark: SparkSession, folder: str, name: str, version: int | str, definition: dict, rules: list[FilterSpec] = ()) -> DataFrame:
    """(check, ok) of a committed sample against its manifest, and of the manifest against
    the definition that is wanted now."""
    df, was = committed_sample(spark, folder, name, version)
    schema = StructType.fromJson(json.loads(was["schema"]))
    return validate_sample(df, was["rows"], (was["digest_sum"], was["digest_xor"]), was["definition_sha256"], definition_hash(definition), schema, rules)
