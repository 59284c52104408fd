"""Encodings fitted on one table and applied to any, without leakage."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import build_derived


def _apply(df: DataFrame, table: DataFrame, columns: list[str], value: str, fill) -> DataFrame:
    """Left join of an encoding by its columns (null meets nothing)."""
    renamed = table.select(*[F.col(c).alias(f"_k_{c}") for c in columns], F.col(value).alias("_v"))
    on = [df[c] == renamed[f"_k_{c}"] for c in columns]
    return df.join(renamed, on, "left").withColumn(value, F.coalesce("_v", F.lit(fill))).drop("_v", *[f"_k_{c}" for c in columns])


def fit_target(train: DataFrame, columns: list[str], target: str, smoothing: float, name: str) -> tuple[DataFrame, float]:
    """((columns, name), global mean): smoothed means of the target."""
    g = train.agg(F.avg(target)).first()[0] or 0.0
    stats = train.dropna(subset=columns).groupBy(*columns).agg(F.count(target).alias("n"), F.avg(target).alias("m"))
    return stats.select(*columns, ((F.col("n") * F.coalesce("m", F.lit(0.0)) + smoothing * g) / (F.col("n") + smoothing)).alias(name)), g


def target_encode(train: DataFrame, df: DataFrame, columns: list[str], target: str, smoothing: float = 20.0, name: str | None = None) -> DataFrame:
    """Add the smoothed mean; what was not seen in training gets the global mean."""
    name = name or f"{'_'.join(columns)}_target_enc"
    table, g = fit_target(train, columns, target, smoothing, name)
    return _apply(df, table, columns, name, g)


def fit_frequency(train: DataFrame, column: str, name: str) -> DataFrame:
    counts = train.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.join(F.broadcast(total)).select(column, (F.col("n") / F.col("t")).alias(name))


def freq_encode(train: DataFrame, df: DataFrame, column: str, fill: float = -1.0) -> DataFrame:
    """Add the share among the training rows; what was not seen gets ``fill``."""
    name = f"{column}_freq_enc"
    return _apply(df, fit_frequency(train, column, name), [column], name, fill)


def count_encode(train: DataFrame, df: DataFrame, columns: list[str], fill: int = 0, name: str | None = None) -> DataFrame:
    """Add the number of training rows of the same columns, as an int."""
    name = name or f"{'_'.join(columns)}_count_enc"
    table = train.dropna(subset=columns).groupBy(*columns).agg(F.count("*").cast("int").alias(name))
    out = _apply(df, table, columns, name, fill)
    return out.withColumn(name, F.col(name).cast("int"))


@dataclass
class FeaturePipeline:
    """Derived features, then frequency and target encodings fitted on training rows."""

    target: str
    derived: list[tuple[str, str, tuple[str, ...]]] = field(default_factory=list)
    frequencies: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    smoothing: float = 20.0
    tables: dict[str, tuple[DataFrame, list[str], float]] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> FeaturePipeline:
        train = build_derived(train, self.derived) if self.derived else train
        for c in self.frequencies:
            self.tables[f"{c}_freq_enc"] = (fit_frequency(train, c, f"{c}_freq_enc"), [c], -1.0)
        for c in self.targets:
            table, g = fit_target(train, [c], self.target, self.smoothing, f"{c}_target_enc")
            self.tables[f"{c}_target_enc"] = (table, [c], g)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        df = build_derived(df, self.derived) if self.derived else df
        for name, (table, columns, fill) in self.tables.items():
            df = _apply(df, table, columns, name, fill)
        return df

    def save(self, folder: str) -> None:
        """The mapping tables as Parquet, and the settings as one line of JSON."""
        for name, (table, _, _) in self.tables.items():
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
            spark = table.sparkSession
        if not self.tables:
            raise ValueError("fit the pipeline before it is saved")
        settings = {k: getattr(self, k) for k in ("target", "derived", "frequencies", "targets", "smoothing")}
        settings["tables"] = {name: [columns, fill] for name, (_, columns, fill) in self.tables.items()}
        spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/settings")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> FeaturePipeline:
        """A fitted pipeline as ``save`` wrote it."""
        settings = json.loads(spark.read.text(f"{folder}/settings").first()[0])
        tables = {name: (spark.read.parquet(f"{folder}/{name}"), columns, fill) for name, (columns, fill) in settings.pop("tables").items()}
        derived = [(name, builder, tuple(inputs)) for name, builder, inputs in settings.pop("derived")]
        return cls(derived=derived, tables=tables, **settings)


def auto_features(inferred: DataFrame, target: str) -> DataFrame:
    """(column, feature): what an experiment starts with, from infer_columns' rows."""
    other = F.col("column") != target
    kinds = F.when(F.col("kind") == "datetime", F.array(F.lit("hour"), F.lit("weekday"), F.lit("month"))).when(F.col("kind") == "categorical", F.array(F.lit("target_enc"), F.lit("freq_enc"))).otherwise(F.array(F.lit("include")))
    return inferred.filter(other & (F.col("role") != "ignore")).select("column", F.explode(kinds).alias("feature"))
