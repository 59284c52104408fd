"""Structural cleaning with accounts of what it changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import new_path
from .joins import lookup_join

# Tokens that stand for a missing value.
MISSING_TOKENS = ("", "NA", "N/A", "null", "None", "nan")


def dedup_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def standardize_missing(df: DataFrame, tokens=MISSING_TOKENS) -> DataFrame:
    """Null the tokens in all text columns."""
    return df.withColumns({n: F.when(~F.col(n).isin(*tokens), F.col(n)) for n, t in df.dtypes if t == "string"})


def observed_tokens(df: DataFrame, tokens=MISSING_TOKENS) -> DataFrame:
    """(column, tokens): which tokens each text column holds, sorted."""
    texts = [n for n, t in df.dtypes if t == "string"]
    found = df.agg(*[F.sort_array(F.collect_set(F.when(F.col(n).isin(*tokens), F.col(n)))).alias(n) for n in texts])
    return found.unpivot([], texts, "column", "tokens")


def as_datetime(c: str | Column, formats: tuple[str, ...] = ()) -> Column:
    """ISO text, or one of the formats, as a timestamp without zone; null if neither."""
    c = F.col(c) if isinstance(c, str) else c
    tries = [c.try_cast("timestamp_ntz"), *(F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats)]
    return F.coalesce(*tries)


def as_number(c: str | Column, kind: str = "double") -> Column:
    """Text as a number; "3.5" as a bigint is 3, as through a double."""
    c = F.col(c) if isinstance(c, str) else c
    number = c.try_cast("double")
    return number if kind == "double" else F.coalesce(c.try_cast(kind), number.try_cast(kind))


def parse_failures(df: DataFrame, parsed: dict[str, Column], examples: int = 5) -> DataFrame:
    """(column, failures, examples): values that are not null but parse to null."""
    names = list(parsed)
    wide = df.select(*[F.when(F.col(n).isNotNull() & parsed[n].isNull(), F.col(n).cast("string")).alias(n) for n in names])
    each = wide.unpivot([], names, "column", "x").filter("x is not null").groupBy("column", "x").agg(F.count("*").alias("n"))
    totals = each.groupBy("column").agg(F.sum("n").alias("failures"))
    # the first few only: each task keeps no more of a column
    first = each.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy("x"))).filter(F.col("k") <= examples)
    first = first.groupBy("column").agg(F.sort_array(F.collect_list("x")).alias("examples"))
    every = df.sparkSession.createDataFrame([(n,) for n in names], "column string")
    found = every.join(totals, "column", "left").join(first, "column", "left")
    return found.select("column", F.coalesce("failures", F.lit(0).cast("long")).alias("failures"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(F.col(target).isNotNull())


def canonicalize(df: DataFrame, target: str, datetimes: dict[str, tuple[str, ...]] | None = None, numbers: dict[str, str] | None = None, tokens=MISSING_TOKENS) -> DataFrame:
    """Duplicates, then missing tokens, datetimes, numbers, and rows without a target."""
    df = standardize_missing(dedup_rows(df), tokens)
    parsed = {c: as_datetime(c, f) for c, f in (datetimes or {}).items()} | {c: as_number(c, k) for c, k in (numbers or {}).items()}
    return drop_null_target(df.withColumns(parsed) if parsed else df, target)


def simple_clean(df: DataFrame, target: str) -> DataFrame:
    """Rows without a target first, then duplicates."""
    return dedup_rows(drop_null_target(df, target))


def transform_audit(df: DataFrame, target: str, cleaned: DataFrame, tokens=MISSING_TOKENS) -> DataFrame:
    """One row: rows_in, rows_out, dropped, duplicates, null_target, unexplained.

    The table is read once, as counts of its distinct rows, and ``cleaned`` once.
    """
    kept = standardize_missing(_counted(df), tokens).agg(*_sums(target))
    one = kept.join(cleaned.agg(F.count("*").alias("rows_out")))  # one row each
    duplicates = F.col("rows_in") - F.col("distinct_rows")
    dropped = F.col("rows_in") - F.col("rows_out")
    return one.select("rows_in", "rows_out", dropped.alias("dropped"), duplicates.alias("duplicates"), "null_target", F.greatest(F.lit(0), dropped - duplicates - F.col("null_target")).alias("unexplained"))


def _counted(df: DataFrame) -> DataFrame:
    """The distinct rows, with _rows: how often each comes."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("_rows"))


def _sums(target: str) -> list[Column]:
    return [F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows_in"), F.count("*").alias("distinct_rows"), F.count_if(F.col(target).isNull()).alias("null_target")]


def audited_canonicalize(df: DataFrame, target: str, datetimes: dict[str, tuple[str, ...]] | None = None, numbers: dict[str, str] | None = None, tokens=MISSING_TOKENS, lookup: DataFrame | None = None, keys: tuple[str, str] | None = None, drop: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(cleaned, audit): a lookup joined by its keys (of the table, of the lookup), then what
    ``canonicalize`` does, then columns dropped; and one row of rows_before_join,
    duplicate_keys (keys that the lookup holds more than once), rows_in, rows_out, dropped,
    duplicates, null_target, unexplained, columns_added and columns_dropped (sorted).

    One job reads the table and writes its distinct rows with their counts; the cleaned
    rows and all counts come from what it wrote. Counts are data, not observed metrics,
    which would count a stage twice that runs again after an executor is lost. Of the rows
    that one row meets in the lookup one is marked, so the marks count the rows before the
    join. Without a lookup rows_before_join is rows_in and duplicate_keys 0. An empty table
    gives zeros. Names with a leading underscore are reserved.
    """
    given, spark = df.columns, df.sparkSession
    missing = set(drop) - {*df.columns, *(lookup.columns if lookup is not None else ())}
    if missing or (lookup is None) != (keys is None):
        raise ValueError(f"unknown columns: {', '.join(sorted(missing))}" if missing else "a lookup and its keys come together")
    repeated = spark.range(1).select(F.lit(0).cast("long").alias("duplicate_keys"))
    if lookup is not None:
        within = Window.partitionBy(keys[1]).orderBy(F.xxhash64(*lookup.columns))
        df = lookup_join(df, lookup.withColumn("_first", F.row_number().over(within) == 1), *keys)
        held = lookup.filter(F.col(keys[1]).isNotNull()).groupBy(keys[1]).agg(F.count("*").alias("_m"))
        repeated = held.agg(F.count_if(F.col("_m") > 1).alias("duplicate_keys"))
    first = F.coalesce(F.col("_first"), F.lit(True)) if lookup is not None else F.lit(True)
    names = [c for c in df.columns if c != "_first"]
    counted = df.groupBy(*names).agg(F.count("*").alias("_rows"), F.count_if(first).alias("_before"))
    parsed = {c: as_datetime(c, f) for c, f in (datetimes or {}).items()} | {c: as_number(c, k) for c, k in (numbers or {}).items()}
    clean = standardize_missing(counted, tokens)
    path = new_path(spark, "audited")
    (clean.withColumns(parsed) if parsed else clean).write.parquet(path)
    kept = spark.read.parquet(path)
    cleaned = drop_null_target(kept, target).drop("_rows", "_before", *drop)
    one = kept.agg(F.coalesce(F.sum("_before"), F.lit(0)).alias("rows_before_join"), *_sums(target)).join(repeated)  # one row each
    out = F.col("distinct_rows") - F.col("null_target")
    names_of = lambda x: F.array(*map(F.lit, sorted(x))).cast("array<string>")
    audit = one.select(
        "rows_before_join", "duplicate_keys", "rows_in", out.alias("rows_out"), (F.col("rows_in") - out).alias("dropped"), (F.col("rows_in") - F.col("distinct_rows")).alias("duplicates"), "null_target",
        F.lit(0).alias("unexplained"), names_of(set(cleaned.columns) - set(given)).alias("columns_added"), names_of(set(given) - set(cleaned.columns)).alias("columns_dropped"),
    )
    return cleaned, audit


def guard_drops(audit: DataFrame, most: float) -> DataFrame:
    """The audit; raises if the unexplained share of the rows is above ``most``."""
    row = audit.first()
    if row["rows_in"] > 0 and row["unexplained"] / row["rows_in"] > most:
        raise ValueError(f"{row['unexplained']} of {row['rows_in']} rows vanished")
    return audit


def cap_rows(df: DataFrame, n: int | None, keys: list[str], seed: int = 0) -> DataFrame:
    """At most n rows, as for a trial run."""
    from ..functions.order import sample_n

    return df if n is None else sample_n(df, n, keys, seed)
