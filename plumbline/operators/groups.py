"""Group summaries, baselines and robust transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import row_quantiles


def k_rows():
    """A window of all rows of a small result (one per group) together."""
    return Window.partitionBy(F.lit(0))


def group_stats(df: DataFrame, group: str, y: str) -> DataFrame:
    """(group, n, mean, var) of the values that are present: one shuffle of partial sums."""
    v = F.col(y).cast("double")
    base = df.filter(F.col(group).isNotNull() & v.isNotNull() & ~F.isnan(v))
    return base.groupBy(F.col(group).cast("string").alias("group")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))


def group_describe(df: DataFrame, group: str, y: str, groups: list[str]) -> DataFrame:
    """(group, n, mean, std, proportion, absent, imbalance_ratio) of the configured groups."""
    spine = df.sparkSession.createDataFrame([(g,) for g in groups], "group string")
    total = df.agg(F.count("*").alias("_total"))
    out = spine.join(group_stats(df, group, y), "group", "left").join(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    present = F.when(n > 0, n)
    ratio = F.when(F.count(present).over(k_rows()) < 2, 0.0).otherwise(F.round(F.max(present).over(k_rows()) / F.min(present).over(k_rows()), 4))
    return out.select("group", n.alias("n"), "mean", F.sqrt("var").alias("std"), (n / F.col("_total")).alias("proportion"), (n == 0).alias("absent"), ratio.alias("imbalance_ratio"))


def attrition(df: DataFrame, group: str, y: str, groups: list[str]) -> DataFrame:
    """One row: n_total, n_used, excluded, null_group, null_target, unlisted."""
    g, listed = F.col(group), F.coalesce(F.col(group).isin(*groups), F.lit(False))
    one = df.agg(F.count("*").alias("n_total"), F.count_if(listed & F.col(y).isNotNull()).alias("n_used"), F.count_if(g.isNull()).alias("null_group"), F.count_if(listed & F.col(y).isNull()).alias("null_target"), F.count_if(g.isNotNull() & ~listed).alias("unlisted"))
    return one.select("n_total", "n_used", (F.col("n_total") - F.col("n_used")).alias("excluded"), "null_group", "null_target", "unlisted")


def group_imbalance(df: DataFrame, group: str) -> DataFrame:
    """(imbalance): greatest by least group size; 1 for fewer than two groups."""
    sizes = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    return sizes.agg(F.when(F.count("*") < 2, 1.0).otherwise(F.max("n") / F.min("n")).alias("imbalance"))


def baseline_group_range(df: DataFrame, group: str, y: str) -> DataFrame:
    """(value): greatest less least group mean; no group is an error."""
    return group_stats(df, group, y).agg(F.max("mean").alias("hi"), F.min("mean").alias("lo")).select(F.when(F.col("hi").isNull(), F.raise_error(F.lit("no group"))).otherwise(F.col("hi") - F.col("lo")).alias("value"))


def baseline_regression(df: DataFrame, y: str, approx: bool = False) -> DataFrame:
    """(mean, median, mae_mean, mae_median): errors of two constant predictions."""
    median = row_quantiles(df, {"y": F.col(y)}, {"q": 0.5}, approx).select(F.col("y_q").alias("median"))
    one = df.agg(F.avg(y).alias("mean")).join(F.broadcast(median))  # one row
    met = df.select(F.col(y).alias("_y")).join(F.broadcast(one))
    return met.groupBy("mean", "median").agg(F.avg(F.abs(F.col("_y") - F.col("mean"))).alias("mae_mean"), F.avg(F.abs(F.col("_y") - F.col("median"))).alias("mae_median"))


def baseline_majority(df: DataFrame, y: str) -> DataFrame:
    """(label, support, accuracy) of the commonest label; the smallest on a tie."""
    counts = df.filter(F.col(y).isNotNull()).groupBy(y).agg(F.count("*").alias("n"))
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(y).alias("label"))).alias("b"), F.sum("n").alias("total"))
    return best.select("b.label", (-F.col("b.m")).alias("support"), (-F.col("b.m") / F.col("total")).alias("accuracy"))


def improvement(df: DataFrame, baseline: str, candidate: str, task: str = "regression") -> DataFrame:
    """Add improvement: the share of the baseline that the candidate gains (null at 0)."""
    gain = F.col(baseline) - F.col(candidate) if task == "regression" else F.col(candidate) - F.col(baseline)
    return df.withColumn("improvement", F.when(F.col(baseline) != 0, gain / F.col(baseline)))


def modified_zscores(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """Add <c>_mz: 0.6745 times the distance from the median in units of the median
    absolute deviation; 0 where that is 0."""
    medians = row_quantiles(df, {f"_m_{c}": F.col(c) for c in columns}, {"q": 0.5}, approx).toDF(*[f"_m_{c}" for c in columns])
    met = df.join(F.broadcast(medians))  # one row
    spreads = row_quantiles(met, {f"_d_{c}": F.abs(F.col(c) - F.col(f"_m_{c}")) for c in columns}, {"q": 0.5}, approx).toDF(*[f"_d_{c}" for c in columns])
    out = met.join(F.broadcast(spreads))
    z = {f"{c}_mz": F.when(F.col(f"_d_{c}") > 0, 0.6745 * (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_d_{c}")).when(F.col(c).isNotNull(), 0.0) for c in columns}
    return out.withColumns(z).drop(*[f"_{k}_{c}" for k in "md" for c in columns])


def outlier_mask(df: DataFrame, columns: list[str], threshold: float = 3.5, approx: bool = False) -> DataFrame:
    """Add outlier: whether any column's modified z-score is beyond the threshold."""
    out, test = modified_zscores(df, columns, approx), F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.abs(F.col(f"{c}_mz")) > threshold, F.lit(False))
    return out.withColumn("outlier", test).drop(*[f"{c}_mz" for c in columns])


def winsorize(df: DataFrame, columns: list[str], q: float, approx: bool = False) -> DataFrame:
    """Clip columns at their upper quantile; null stays null."""
    caps = row_quantiles(df, {f"_q_{c}": F.col(c) for c in columns}, {"q": q}, approx).toDF(*[f"_q_{c}" for c in columns])
    met = df.join(F.broadcast(caps))
    return met.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.col(c).cast("double"), F.col(f"_q_{c}"))) for c in columns}).drop(*[f"_q_{c}" for c in columns])
