"""Model training on Spark ML, predictions, metrics and comparisons."""

from __future__ import annotations

import itertools
import math
import random
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import checkpoint, global_index, hash_index, stored
from ..functions.quantiles import group_quantiles, row_quantiles
from .regress import fit, fit_sums, fold_sums, predicted

REGRESSORS = ("linear", "random_forest", "boosted_trees", "knn")
CLASSIFIERS = ("logistic", "random_forest_classifier", "boosted_trees_classifier", "knn_classifier")
MODELS = REGRESSORS + CLASSIFIERS
MOST_LABELS = 100
"""Labels are part of a fitted classifier, so more than these are an error."""


def _estimator(model: str, y: str, params: dict):
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    forest, boosted = {"numTrees": 20, "seed": 0}, {"maxIter": 10, "seed": 0}
    kinds = {
        "linear": (LinearRegression, {"solver": "normal"}),
        "random_forest": (RandomForestRegressor, forest),
        "boosted_trees": (GBTRegressor, boosted),
        "logistic": (LogisticRegression, {}),
        "random_forest_classifier": (RandomForestClassifier, forest),
        "boosted_trees_classifier": (GBTClassifier, boosted),
    }
    if model not in kinds:
        raise ValueError(f"unknown model: {model}")
    make, defaults = kinds[model]
    unknown = set(params) - {p.name for p in make().params}
    if unknown:
        raise ValueError(f"unknown parameters of {model}: {', '.join(sorted(unknown))}")
    if model in CLASSIFIERS:
        return make(featuresCol="features", labelCol=y, predictionCol="_index", **(defaults | params)).setProbabilityCol("_chance").setRawPredictionCol("_raw")
    return make(featuresCol="features", labelCol=y, predictionCol="prediction", **(defaults | params))


def train_model(df: DataFrame, features: list[str], y: str, model: str = "linear", params: dict | None = None):
    """A fitted model: ``transform`` adds prediction to rows whose features are complete.

    Regressors (and ``knn_classifier``, given numbers) predict numbers. Classifiers take
    labels of any type and predict them as text; all but the neighbours' vote add
    probability, an array in the order of the fitted ``labels``. Rows without a label do
    not count.
    """
    params, numeric = params or {}, dict(df.dtypes)[y] not in ("string", "boolean")
    if model in CLASSIFIERS and not (model == "knn_classifier" and numeric):
        return _train_classifier(df.filter(F.col(y).isNotNull()), features, y, model, params)
    if model in ("knn", "knn_classifier"):
        rows = df.dropna(subset=[*features, y]).select(*features, F.col(y).cast("double").alias(y))
        return Neighbours(checkpoint(rows.withColumn("_t", -1 - F.monotonically_increasing_id())), features, y, vote=model == "knn_classifier", **_checked(model, params))
    df = df.withColumn(y, F.col(y).cast("double")).dropna(subset=[y])
    return _fit_trees(df, features, y, model, params) if _by_cells(model, params) else _fit_pipeline(df, features, y, model, params)


def _by_cells(model: str, params: dict) -> bool:
    """Whether trees see only weights and means of rows with equal features. They do unless
    parameters count or sample rows, or measure another loss than the squared one."""
    return (
        model in ("random_forest", "boosted_trees")
        and params.get("minInstancesPerNode", 1) == 1
        and params.get("lossType", "squared") == "squared"
        and not {"weightCol", "validationIndicatorCol"} & set(params)
        and (params.get("subsamplingRate", 1.0) == 1.0 or model == "random_forest" and params.get("bootstrap", True))
    )


def _fit_trees(df: DataFrame, features: list[str], y: str, model: str, params: dict):
    """Tree regressors, fitted on cells: one weighted row, with the mean of y, for all rows
    of equal features. What rows of a cell differ by is the same on all sides of a split, so
    gains, splits and leaves are those of the rows, but tables of few different features
    are read once and nothing of their length is kept.

    A bootstrap draws rows, not cells: each row's count in each tree is drawn (Poisson) in
    the pass that makes the cells, which hold a weight and a mean for each tree.
    """
    estimator = _estimator(model, y, params)
    trees = estimator.getNumTrees() if model == "random_forest" and estimator.getBootstrap() else 0
    uniform = {f"_u{t}": F.rand(estimator.getSeed() + 7919 * (t + 1)) for t in range(trees)}
    drawn = df.dropna(subset=[*features, y]).select(*features, y).withColumns(uniform)
    counts = [_poisson(F.col(u), estimator.getSubsamplingRate()) for u in uniform] or [F.lit(1)]
    cells = checkpoint(drawn.groupBy(*features).agg(*[x for t, c in enumerate(counts) for x in (F.sum(c).cast("double").alias(f"_n{t}"), F.try_divide(F.sum(c * F.col(y)), F.sum(c)).alias(f"_y{t}"))]))

    def fitted(t: int, changed: dict):
        weighted = cells.filter(F.col(f"_n{t}") > 0).select(*features, F.col(f"_y{t}").alias(y), F.col(f"_n{t}").alias("_weight"))
        return _fit_pipeline(weighted, features, y, model, params | {"weightCol": "_weight"} | changed)

    if not trees:
        return fitted(0, {})
    some = estimator.getFeatureSubsetStrategy()
    some = ("onethird" if trees > 1 else "all") if some == "auto" else some
    return Trees([fitted(t, {"numTrees": 1, "bootstrap": False, "subsamplingRate": 1.0, "featureSubsetStrategy": some, "seed": estimator.getSeed() + t}) for t in range(trees)])


def _poisson(u: Column, mean: float) -> Column:
    """A Poisson count from a uniform number in [0, 1)."""
    p = math.exp(-mean)
    reached, k, found = p, 0, F.when(u < p, 0)
    while reached + p * mean / (k + 1) > reached:
        k += 1
        p *= mean / k
        reached += p
        found = found.when(u < reached, k)
    return found.otherwise(k + 1)


@dataclass
class Trees:
    """A forest of trees fitted one by one: the mean of what they predict."""

    trees: list

    @property
    def featureImportances(self) -> list[float]:  # noqa: N802
        total = np.sum([t.stages[-1].featureImportances.toArray() for t in self.trees], axis=0)
        return (total / (total.sum() or 1.0)).tolist()

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.trees[0].stages[0].transform(df)
        for i, t in enumerate(self.trees):
            out = t.stages[1].setPredictionCol(f"_p{i}").transform(out)
        mean = reduce(lambda x, z: x + z, [F.col(f"_p{i}") for i in range(len(self.trees))]) / len(self.trees)
        return out.withColumn("prediction", mean).drop(*[f"_p{i}" for i in range(len(self.trees))])


def _fit_pipeline(df: DataFrame, features: list[str], y: str, model: str, params: dict):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), _estimator(model, y, params)]).fit(df)


def _train_classifier(df: DataFrame, features: list[str], y: str, model: str, params: dict) -> Classified:
    label = F.col(y).cast("string")
    found = df.select(label.alias("label")).distinct().orderBy("label").limit(MOST_LABELS + 1).collect()
    labels = [r["label"] for r in found]
    most = 2 if model == "boosted_trees_classifier" else MOST_LABELS
    if not 2 <= len(labels) <= most:
        raise ValueError(f"{model} takes 2 to {most} labels")
    numbered = df.select(*features, (F.array_position(F.array(*map(F.lit, labels)), label) - 1).cast("double").alias("_label"))
    if model == "knn_classifier":
        return Classified(train_model(numbered, features, "_label", model, params), labels, "prediction")
    return Classified(_fit_pipeline(numbered, features, "_label", model, params), labels, "_index")


@dataclass
class Classified:
    """A fitted classifier over numbered labels; it gives their texts back."""

    fitted: object
    labels: list[str]
    index: str

    @property
    def stages(self):
        return self.fitted.stages

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        scored = self.fitted.transform(df)
        if "_chance" in scored.columns:
            scored = scored.withColumn("probability", vector_to_array("_chance")).drop("_chance", "_raw", "features")
        text = F.element_at(F.array(*map(F.lit, self.labels)), F.col(self.index).cast("int") + 1)
        return scored.withColumn("prediction", text).drop("_index")

    def chance(self, scored: DataFrame, label: str) -> Column:
        """The probability of one label in rows that ``transform`` returned."""
        if "probability" not in scored.columns or label not in self.labels:
            raise ValueError(f"no probability of {label}")
        return scored["probability"][self.labels.index(label)]


def _checked(model: str, params: dict) -> dict:
    unknown = set(params) - {"k", "p", "weights"}
    if unknown:
        raise ValueError(f"unknown parameters of {model}: {', '.join(sorted(unknown))}")
    return params


@dataclass
class Neighbours:
    """Nearest neighbours on numeric features, of numbers; ``Classified`` gives a vote texts."""

    train: DataFrame
    features: list[str]
    y: str
    k: int = 5
    p: int = 2
    weights: str = "uniform"
    vote: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        rows = checkpoint(df.dropna(subset=self.features).withColumn("_q", F.monotonically_increasing_id()))
        vector = F.array(*[F.col(c).cast("double") for c in self.features]).alias("_v")
        found = knn_predict(self.train.select("_t", vector, F.col(self.y).alias("_y")), rows.select("_q", vector), "_v", "_y", "_q", self.k, self.p, self.vote, "_t", weights=self.weights)
        return rows.join(found, "_q").drop("_q")


def holdout_table(model, df: DataFrame, y: str, keys: list[str]) -> DataFrame:
    """(keys, actual, predicted) of rows the model has not seen: numbers, or texts of a
    classifier."""
    scored = model.transform(df)
    kind = dict(scored.dtypes)["prediction"]
    return scored.select(*keys, F.col(y).cast(kind).alias("actual"), F.col("prediction").alias("predicted"))


def _importances(model) -> list[float]:
    """A number for each feature: coefficients of a line, gains of trees, and of a logistic
    model the length of its coefficients over the labels."""
    last = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(last, "coefficientMatrix"):
        return np.sqrt((last.coefficientMatrix.toArray() ** 2).sum(0)).tolist()
    values = getattr(last, "featureImportances", getattr(last, "coefficients", None))
    if values is None:
        raise ValueError("the model has no importances")
    return [float(v) for v in values]


def feature_importances(model, features: list[str], spark) -> DataFrame:
    """(feature, importance) of a fitted line, tree model or logistic model."""
    values = _importances(model)
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def knn_predict(train: DataFrame, queries: DataFrame, vector: str, y: str, query_id: str, k: int = 5, p: int = 2, vote: bool = False, train_id: str | None = None, block: int = 4096, weights: str = "uniform") -> DataFrame:
    """(query_id, prediction): the mean (or the commonest, then smallest) y of the k
    nearest training rows; a row is not its own neighbour where both tables share an id.

    Distances are rounded to 12 places first, for order and weights alike. Weights
    "distance": neighbours count by one over their distance; where some are at distance
    zero, those alone count.

    The queries are a stated set. They and the training rows are dealt into blocks, each
    pair of blocks is searched by numpy in one task, and the k best are merged.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError("weights: uniform, distance")
    n_train, n_query = train.count(), queries.count()
    tb, qb = max(1, math.ceil(n_train / block)), max(1, math.ceil(n_query / block))
    own = train_id or query_id
    # both sides need keys of one type: cogroup casts none, and equal numbers of two types hash apart
    t = train.select(F.col(own).alias("_t"), F.col(vector).cast("array<double>").alias("_v"), F.col(y).cast("double").alias("_y"), F.pmod(F.xxhash64(own), F.lit(tb)).cast("int").alias("_tb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("_qb"))
    q = queries.select(F.col(query_id).alias("_q"), F.col(vector).cast("array<double>").alias("_w"), F.pmod(F.xxhash64(query_id), F.lit(qb)).cast("int").alias("_qb"), F.explode(F.sequence(F.lit(0), F.lit(tb - 1))).alias("_tb"))

    def near(a, b):
        import numpy as np
        import pandas as pd

        out = {"_q": [], "_t": [], "_d": [], "_y": []}
        if len(a) and len(b):
            m, ids, ys = np.ascontiguousarray(np.array(a["_v"].tolist()).T), a["_t"].to_numpy(), a["_y"].to_numpy()
            for i, w in zip(b["_q"], b["_w"]):
                apart = m - np.asarray(w)[:, None]  # summed a component after another, as SQL sums
                d = (np.abs(apart).sum(0) if p == 1 else np.sqrt((apart**2).sum(0))) * 1e12
                d = (np.floor(d) + (d - np.floor(d) >= 0.5)) / 1e12
                ok = np.flatnonzero(ids != i)
                best = ok[np.lexsort((ids[ok], d[ok]))[:k]]
                out["_q"] += [i] * len(best)
                out["_t"] += ids[best].tolist()
                out["_d"] += d[best].tolist()
                out["_y"] += ys[best].tolist()
        return pd.DataFrame(out).astype({"_q": "int64", "_t": "int64", "_d": "float64", "_y": "float64"})

    found = t.groupBy("_tb", "_qb").cogroup(q.groupBy("_tb", "_qb")).applyInPandas(near, "_q long, _t long, _d double, _y double")
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("_q").orderBy("_d", "_t"))).filter(F.col("_r") <= k)
    if weights == "distance":
        zero, near_by = F.col("_d") == 0, F.when(F.col("_d") > 0, 1 / F.col("_d"))
        if vote:
            tally = ranked.groupBy("_q", "_y").agg(F.count_if(zero).alias("_z"), F.sum(near_by).alias("_w"))
            best = F.max_by("_y", F.struct("_z", F.when(F.col("_z") > 0, 0.0).otherwise(F.round("_w", 9)), -F.col("_y")))
            return tally.groupBy(F.col("_q").alias(query_id)).agg(best.alias("prediction"))
        mean = F.coalesce(F.avg(F.when(zero, F.col("_y"))), F.sum(near_by * F.col("_y")) / F.sum(near_by))
        return ranked.groupBy(F.col("_q").alias(query_id)).agg(mean.alias("prediction"))
    value = F.mode("_y", True) if vote else F.avg("_y")
    return ranked.groupBy(F.col("_q").alias(query_id)).agg(value.alias("prediction"))


def _if_finite(value: Column, *columns: str) -> Column:
    """An aggregate that raises if a value of the columns is missing or not finite."""
    bad = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in columns]
    return F.when(F.count_if(bad[0] | bad[-1]) == 0, value).otherwise(F.raise_error(F.lit("values must be finite")).cast("double"))


def regression_metrics(df: DataFrame, actual: str, predicted_: str, digits: int = 4, approx: bool = False) -> DataFrame:
    """One row: mae, rmse, r2, mape, max_error, median_ae, explained_var."""
    a, p = F.col(actual).cast("double"), F.col(predicted_).cast("double")
    e = a - p
    sst = F.var_pop(a) * F.count("*")
    one = df.agg(_if_finite(F.avg(F.abs(e)), actual, predicted_).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), sst)).alias("r2"), F.avg(F.abs(e) / F.greatest(F.abs(a), F.lit(2.220446049250313e-16))).alias("mape"), F.max(F.abs(e)).alias("max_error"), (1 - F.try_divide(F.var_pop(e), F.var_pop(a))).alias("explained_var"))
    one = one.join(F.broadcast(row_quantiles(df, {"e": F.abs(e)}, {"q": 0.5}, approx).select(F.col("e_q").alias("median_ae"))))  # one row
    return one.select(*[F.round(c, digits).alias(c) for c in ("mae", "rmse", "r2", "mape", "max_error", "median_ae", "explained_var")])


def binary_metrics(df: DataFrame, actual: str, score: str, threshold: float, digits: int = 4) -> DataFrame:
    """(positives, negatives, roc_auc, average_precision), with ties, from the counts of
    distinct scores, summed up in blocks of their order."""
    y = (F.col(actual) >= threshold).cast("long")
    cells = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q"))
    placed = global_index(cells, F.desc("s")).withColumn("_b", F.floor(F.col("index") / 65536))
    sums = placed.groupBy("_b").agg(F.sum("p").alias("bp"), F.sum("q").alias("bq"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_b", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("bq").over(before), F.lit(0)).alias("q0"))
    inside = Window.partitionBy("_b").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.join(F.broadcast(sums), "_b").withColumn("cp", F.col("p0") + F.sum("p").over(inside)).withColumn("cq", F.col("q0") + F.sum("q").over(inside))
    # a negative is outranked by all positives before it, and half of those beside it
    one = run.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum(F.col("q") * (F.col("cp") - F.col("p") / 2)).alias("u"), F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cq"))).alias("ap"))
    return one.select("positives", "negatives", F.round(F.try_divide(F.col("u"), F.col("positives") * F.col("negatives")), digits).alias("roc_auc"), F.round(F.try_divide(F.col("ap"), F.col("positives")), digits).alias("average_precision"))


def tail_mae(df: DataFrame, actual: str, predicted_: str, q: float, approx: bool = False) -> DataFrame:
    """(mae, rmse, tail_mae): the last on rows from the q quantile of the actual values."""
    cut = row_quantiles(df, {"y": F.col(actual)}, {"q": q}, approx).toDF("_cut")
    e = F.abs(F.col(actual) - F.col(predicted_))
    return df.join(F.broadcast(cut)).agg(F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.when(F.col(actual) >= F.col("_cut"), e)).alias("tail_mae"))


def residual_summary(df: DataFrame, actual: str, predicted_: str) -> DataFrame:
    """(mean_residual, std_residual, max_residual): mean and greatest of the absolute ones."""
    e = F.col(actual) - F.col(predicted_)
    return df.agg(F.avg(F.abs(e)).alias("mean_residual"), F.stddev_pop(e).alias("std_residual"), F.max(F.abs(e)).alias("max_residual"))


def _dealt(df: DataFrame, features: list[str], y: str, keys: list[str], k: int, seed: int, fold: Column | None) -> DataFrame:
    """Complete rows (features, y, _fold): dealt evenly by a random order of the keys, or
    by the column ``fold``."""
    base = df.dropna(subset=[*features, y])
    if fold is not None:
        return base.select(*features, y, fold.cast("int").alias("_fold"))
    return hash_index(base.select(*dict.fromkeys([*features, y, *keys])), keys, seed, "_i").select(*features, y, (F.col("_i") % k).cast("int").alias("_fold"))


def _without(sums: dict[int, tuple], fold: int | None) -> tuple:
    """The sums of all folds but one."""
    return tuple(reduce(lambda a, b: a + b, [v[i] for f, v in sums.items() if f != fold]) for i in range(3))


def _by_fold(values: dict[int, Column]) -> Column:
    return reduce(lambda c, kv: c.when(F.col("_fold") == kv[0], kv[1]), values.items(), F.when(F.lit(False), F.lit(None).cast("double")))


REGRESSION_METRICS = ("mae", "rmse", "r2", "mape", "max_error", "median_ae", "explained_var")


def kfold_cv(df: DataFrame, features: list[str] | str, y: str, keys: list[str], k: int = 5, seed: int = 0, digits: int = 4, fold: Column | None = None, model: str = "linear", params: dict | None = None, parallel: int = 2) -> DataFrame:
    """(folds, mae, rmse, r2, mape, max_error, median_ae, explained_var): a model is fitted
    without each fold and measured on it; means of the folds' rounded values. A classifier
    gives (folds, accuracy, precision, recall, f1), as ``classification_metrics``.

    The plain linear model takes one pass, which gathers the sums of each fold; every fit is
    those of the other folds. Any other ``model`` of the registry, or one with ``params``, is
    fitted once for each fold, ``parallel`` of them at a time. Two folds with rows are needed.
    """
    features = [features] if isinstance(features, str) else list(features)
    rows = _dealt(df, features, y, keys, k, seed, fold)
    if model != "linear" or params:
        scored = stored(_held_out(stored(rows, "dealt"), features, y, model, params, parallel), "held-out")
        if dict(scored.dtypes)["prediction"] == "string" or model in CLASSIFIERS:
            return _mean_of_folds(classification_metrics(scored, "actual", "prediction", digits, "_fold"), ("accuracy", "precision", "recall", "f1"), digits)
        return _mean_of_folds(_fold_errors(scored.select("_fold", F.col("actual").alias("_a"), (F.col("actual") - F.col("prediction")).alias("_e"))), REGRESSION_METRICS, digits)
    rows = checkpoint(rows) if fold is None else rows
    means, sums = fold_sums(rows, features, y)
    if len(sums) < 2:
        raise ValueError("two folds with rows are needed")
    fits = {f: predicted(fit_sums(features, features, means, *_without(sums, f))) for f in sums}
    a = F.col(y).cast("double")
    return _mean_of_folds(_fold_errors(rows.select("_fold", a.alias("_a"), (a - _by_fold(fits)).alias("_e"))), REGRESSION_METRICS, digits)


def _fold_errors(scored: DataFrame) -> DataFrame:
    """The regression metrics of each fold, from rows (_fold, _a actual, _e error)."""
    a, e = F.col("_a"), F.col("_e")
    per = scored.groupBy("_fold").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(a) * F.count("*"))).alias("r2"), F.avg(F.abs(e) / F.greatest(F.abs(a), F.lit(2.220446049250313e-16))).alias("mape"), F.max(F.abs(e)).alias("max_error"), (1 - F.try_divide(F.var_pop(e), F.var_pop(a))).alias("explained_var"))
    medians = group_quantiles(scored.select("_fold", F.abs(e).alias("_abs")), "_fold", "_abs", {"median_ae": 0.5}).select("_fold", "median_ae")
    return per.join(medians, "_fold")


def _mean_of_folds(per: DataFrame, names: tuple[str, ...], digits: int) -> DataFrame:
    return per.agg(F.count("*").alias("folds"), *[F.round(F.avg(F.round(c, digits)), digits).alias(c) for c in names])


def _fold_numbers(rows: DataFrame) -> list[int]:
    folds = [r[0] for r in rows.filter("_fold is not null").select("_fold").distinct().orderBy("_fold").limit(1001).collect()]
    if not 2 <= len(folds) <= 1000:
        raise ValueError("two folds with rows are needed, and 1,000 at most")
    return folds


def _held_out(rows: DataFrame, features: list[str], y: str, model: str, params: dict | None, parallel: int) -> DataFrame:
    """(_fold, actual, prediction) of every row, predicted by a model fitted on the other
    folds. Fits are Spark jobs of their own, started from a few threads."""

    def fit_without(f: int) -> DataFrame:
        fitted = train_model(rows.filter(F.col("_fold") != f), features, y, model, params)
        return holdout_table(fitted, rows.filter(F.col("_fold") == f), y, ["_fold"])

    folds = _fold_numbers(rows)
    with ThreadPool(max(1, min(parallel, len(folds)))) as pool:
        parts = pool.map(inheritable_thread_target(rows.sparkSession)(fit_without), folds)
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("predicted", "prediction")


def classification_metrics(df: DataFrame, actual: str, predicted_: str, digits: int = 4, *by: str) -> DataFrame:
    """(by, accuracy, precision, recall, f1): the last three are means over the labels that
    occur as actual or predicted; a label never predicted has precision 0, one that never
    occurs recall 0. Rows without either are left out.

    Only the counts of (actual, predicted) pairs are shuffled on.
    """
    cells = df.dropna(subset=[actual, predicted_]).groupBy(*by, F.col(actual).alias("_a"), F.col(predicted_).alias("_p")).agg(F.count("*").alias("_n"))
    sides = F.array(F.struct(F.col("_a").alias("l"), F.lit(1).alias("a"), F.lit(0).alias("p")), F.struct(F.col("_p").alias("l"), F.lit(0).alias("a"), F.lit(1).alias("p")))
    met = cells.withColumn("_s", F.explode(sides))
    right = F.when(F.col("_a") == F.col("_p"), F.col("_n") * F.col("_s.a"))
    per = met.groupBy(*by, F.col("_s.l").alias("_l")).agg(F.coalesce(F.sum(right), F.lit(0)).alias("r"), F.sum(F.col("_n") * F.col("_s.a")).alias("a"), F.sum(F.col("_n") * F.col("_s.p")).alias("p"))
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return per.groupBy(*by).agg(
        F.round(F.sum("r") / F.sum("a"), digits).alias("accuracy"),
        F.round(F.avg(share(F.col("r"), F.col("p"))), digits).alias("precision"),
        F.round(F.avg(share(F.col("r"), F.col("a"))), digits).alias("recall"),
        F.round(F.avg(share(2 * F.col("r"), F.col("a") + F.col("p"))), digits).alias("f1"),
    )


def compare_models(candidate: DataFrame, champion: DataFrame) -> DataFrame:
    """(metric, candidate, champion, delta, delta_pct) of rows (metric, value)."""
    met = candidate.select("metric", F.col("value").alias("candidate")).join(champion.select("metric", F.col("value").alias("champion")), "metric", "left")
    delta = F.col("candidate") - F.col("champion")
    return met.select("metric", "candidate", "champion", delta.alias("delta"), F.when(F.col("champion") != 0, delta / F.col("champion") * 100).alias("delta_pct"))


def promotion(compared: DataFrame, threshold: float = 0.05, higher_is_better: tuple[str, ...] = ()) -> DataFrame:
    """(metric, improvement, promote): without a champion, or better by over the threshold."""
    gain = F.col("champion") - F.col("candidate")
    gain = F.when(F.col("metric").isin(*higher_is_better), -gain).otherwise(gain) if higher_is_better else gain
    rate = F.when(F.col("champion") != 0, gain / F.abs("champion"))
    return compared.select("metric", rate.alias("improvement"), (F.col("champion").isNull() | F.coalesce(rate > threshold, F.lit(False))).alias("promote"))


def permutation_importance(df: DataFrame, features: list[str], y: str, keys: list[str], repeats: int = 3, seed: int = 0, model=None) -> DataFrame:
    """(feature, mean_drop, std_drop): how much the mean absolute error of a fitted model
    (none given: a linear one, fitted here) rises when a column is shuffled. Shuffling
    joins two random orders of the rows."""
    base = df.dropna(subset=[*features, y]).select(*dict.fromkeys([*keys, *features, y]))
    score = _scorer(base, features, y, model)
    error = F.avg(F.abs(F.col(y) - F.col("prediction"))).alias("_e")
    plain = score(base).agg(error.alias("_base"))
    place = hash_index(base, keys, seed, "_i")
    drops = None
    for r in range(repeats):
        other = hash_index(base, keys, seed + 1 + r, "_i").select("_i", *[F.col(c).alias(f"_s_{c}") for c in features])
        met = checkpoint(place.join(other, "_i"))
        for c in features:
            one = score(met.withColumn(c, F.col(f"_s_{c}"))).agg(error).join(F.broadcast(plain)).select(F.lit(c).alias("feature"), (F.col("_e") - F.col("_base")).alias("_drop"))
            drops = one if drops is None else drops.unionByName(one)
    return drops.groupBy("feature").agg(F.avg("_drop").alias("mean_drop"), F.stddev_pop("_drop").alias("std_drop"))


def _scorer(base: DataFrame, features: list[str], y: str, model):
    """A function that adds prediction: by the fitted model, or by a line fitted on base."""
    if model is not None:
        return model.transform
    b = fit(base, features, y)
    return lambda rows: rows.withColumn("prediction", predicted(b))


def _curves(df: DataFrame, features: list[str], y: str, feature: str, grid: int, model, keys: list[str] = ()) -> DataFrame:
    """(keys, point, value, prediction): each row meets the grid in place, without a join."""
    base = df.dropna(subset=[*features, y]).select(*dict.fromkeys([*features, y]), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)])
    ends = base.agg(F.min(feature).cast("double").alias("_lo"), F.max(feature).cast("double").alias("_hi"))
    points = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.struct(i.alias("point"), (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / F.lit(grid - 1)).alias("value")))
    met = base.join(F.broadcast(ends)).withColumn("_p", F.explode(points)).withColumn(feature, F.col("_p.value"))  # one row of ends
    scored = _scorer(base, features, y, model)(met)
    return scored.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keys)], F.col("_p.point").alias("point"), F.col("_p.value").alias("value"), "prediction")


def partial_dependence(df: DataFrame, features: list[str], y: str, feature: str, grid: int = 10, model=None) -> DataFrame:
    """(point, value, average): the mean prediction of a fitted model (none given: a linear
    one, fitted here) with the feature set to each of a few values."""
    return _curves(df, features, y, feature, grid, model).groupBy("point", "value").agg(F.avg("prediction").alias("average"))


def ice_curves(df: DataFrame, features: list[str], y: str, feature: str, keys: list[str], grid: int = 10, model=None) -> DataFrame:
    """(keys, point, value, prediction): what ``partial_dependence`` averages, row by row."""
    return _curves(df, features, y, feature, grid, model, keys)


def rfe_curve(df: DataFrame, features: list[str], y: str, keys: list[str], seed: int = 0, folds: int = 3, fold: Column | None = None, model: str = "linear", params: dict | None = None, parallel: int = 2) -> DataFrame:
    """(count, dropped, mae): the feature of the least importance (fitted on all rows) goes
    first; the error is the mean of the folds', each fitted on the others.

    Importance is the standardised coefficient of a line, and the gain of the splits of a
    forest or of boosted trees, which are fitted for each step and fold. For the plain
    linear model the rows are read three times, however many features there are: for means, for the
    sums of each fold, which give every fit, and for the errors of all steps at once.
    """
    kinds = dict(df.dtypes)
    texts = [c for c in features if kinds[c] in ("string", "boolean")]
    if texts:
        raise ValueError(f"not numeric: {', '.join(texts)}")
    if model not in REGRESSORS or model == "knn":
        raise ValueError(f"no importances of {model}")
    rows = _dealt(df, features, y, keys, folds, seed, fold)
    if model != "linear" or params:
        return _eliminate(stored(rows, "dealt"), features, y, model, params, parallel)
    rows = checkpoint(rows) if fold is None else rows
    means, sums = fold_sums(rows, features, y)
    if len(sums) < 2:
        raise ValueError("two folds with rows are needed")
    total = _without(sums, None)
    spread = dict(zip(features, (total[2] - np.outer(total[1], total[1]) / total[0]).diagonal()))
    left, steps = list(features), []
    while left:
        b = fit_sums(features, left, means, *total)
        weakest = min(left, key=lambda c: (abs(b[c]) * max(0.0, spread[c]) ** 0.5, c))
        fits = {f: predicted(fit_sums(features, left, means, *_without(sums, f))) for f in sums}
        steps.append((len(left), weakest, F.avg(F.abs(F.col(y) - _by_fold(fits)))))
        left.remove(weakest)
    per = rows.groupBy("_fold").agg(*[e.alias(f"e{i}") for i, (_, _, e) in enumerate(steps)])
    errors = per.agg(*[F.avg(f"e{i}") for i in range(len(steps))]).first()
    return df.sparkSession.createDataFrame([(n, c, float(e)) for (n, c, _), e in zip(steps, errors)], "count int, dropped string, mae double")


def _eliminate(rows: DataFrame, features: list[str], y: str, model: str, params: dict | None, parallel: int) -> DataFrame:
    spread = rows.agg(*[F.stddev_pop(c).alias(c) for c in features]).first() if model == "linear" else None
    left, steps = list(features), []
    while left:
        weights = dict(zip(left, _importances(train_model(rows, left, y, model, params))))
        weakest = min(left, key=lambda c: (abs(weights[c]) * (spread[c] if spread else 1.0), c))
        per = _held_out(rows, left, y, model, params, parallel).groupBy("_fold").agg(F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("_e"))
        steps.append((len(left), weakest, float(per.agg(F.avg("_e")).first()[0])))
        left.remove(weakest)
    return rows.sparkSession.createDataFrame(steps, "count int, dropped string, mae double")


def trial_allocation(leaderboard: DataFrame, remaining: int, top: int) -> DataFrame:
    """(model, best, trials): further trials split evenly over the best models, what is
    left over one each from the best on."""
    ranked = leaderboard.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("best", "model"))).filter(F.col("_r") <= top)
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    return ranked.select("model", "best", (F.floor(F.lit(remaining) / n) + (F.col("_r") <= F.lit(remaining) % n).cast("long")).alias("trials"))


def leaderboard(trials: DataFrame) -> DataFrame:
    """(model, best, rank): the least finite objective of each model."""
    ok = ~F.isnan("objective") & (F.abs("objective") != float("inf"))
    best = trials.groupBy("model").agg(F.min(F.when(ok, F.col("objective"))).alias("best")).filter("best is not null")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("best", "model")))


def model_search(train: DataFrame, val: DataFrame, features: list[str], y: str, spaces: dict[str, dict[str, list]], initial: int, remaining: int, top: int, seed: int = 0, parallel: int = 4) -> DataFrame:
    """(round, model, trial, params, objective): random trials of each model, then more of
    the best ones; the objective is the mean absolute error on ``val``, and for labels as
    text the share of wrong ones. No point of a space is tried twice, so a space is searched
    whole once its trials reach its size. Each trial reads both tables, so what it needs of
    them is stored by columns first; the trials of a round run ``parallel`` at a time."""
    spark, rows = train.sparkSession, []
    train, val = (stored(t.select(*dict.fromkeys([*features, y])), "searched") for t in (train, val))
    rng = random.Random(seed)
    queues = {}
    for m, space in sorted(spaces.items()):
        grid = [dict(zip(space, v)) for v in itertools.product(*space.values())]
        rng.shuffle(grid)
        queues[m] = grid

    def objective(trial: tuple[str, dict]) -> float:
        model, params = trial
        fitted = train_model(train, features, y, model, params)
        a, e = F.col("actual"), F.col("predicted")
        scored = holdout_table(fitted, val, y, [])
        wrong = (a != e).cast("double") if dict(scored.dtypes)["predicted"] == "string" else F.abs(a - e)
        return float(scored.agg(F.avg(wrong)).first()[0])

    def attempt(stage: int, counts: dict[str, int]) -> None:
        drawn = [(m, queues[m].pop()) for m, n in counts.items() for _ in range(min(n, len(queues[m])))]
        with ThreadPool(max(1, min(parallel, len(drawn)))) as pool:
            found = pool.map(inheritable_thread_target(spark)(objective), drawn, 1)
        for (model, params), error in zip(drawn, found):
            rows.append((stage, model, len(rows), repr(sorted(params.items())), error))

    kinds = "round int, model string, trial int, params string, objective double"
    attempt(1, {m: initial for m in sorted(spaces)})
    plan = trial_allocation(leaderboard(spark.createDataFrame(rows, kinds)), remaining, top).collect()  # a row per model
    attempt(2, {r["model"]: r["trials"] for r in plan})
    return spark.createDataFrame(rows, kinds)
