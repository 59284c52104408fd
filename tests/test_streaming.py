"""Row-wise operators run on streams unchanged."""

from pyspark.sql import functions as F

from plumbline.functions import features
from plumbline.functions.filters import FilterSpec, exclude_any, filter_all
from plumbline.operators import clean, encode, joins
from plumbline.streaming.rowwise import run_once

SCHEMA = "id long, g string, x double, t string"


def test_families(spark, tmp_path):
    rows = [(i, "NA" if i % 5 == 0 else f"g{i % 3}", float(i), f"2024-01-{i % 28 + 1:02d}") for i in range(100)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).write.parquet(source)
    lookup = spark.createDataFrame([("g0", "zero"), ("g1", "one")], "k string, name string")
    train = spark.createDataFrame([("g0", 1.0), ("g1", 2.0)], "g string, y double")

    def work(df):
        df = clean.standardize_missing(df).withColumn("t", clean.as_datetime("t"))
        df = exclude_any(filter_all(df, [FilterSpec("x", ">", 3)]), [[FilterSpec("x", ">", 90)]])
        df = features.build_derived(df, [("w", "weekday", ("t",)), ("l", "log1p", ("x",))])
        df = joins.lookup_join(df, lookup, "g", "k")
        return encode.target_encode(train, df, ["g"], "y", 1.0)

    out = str(tmp_path / "out")
    run_once(spark, source, SCHEMA, work, out, str(tmp_path / "cp"))
    batch = work(spark.read.parquet(source))
    stream = spark.read.parquet(out).select(batch.columns)
    assert stream.count() == batch.count() == 87
    assert stream.exceptAll(batch).count() == 0
    assert stream.filter(F.col("g").isNull()).count() == 18
