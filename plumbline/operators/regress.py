"""Linear regression from sums of products, and diagnostics of residuals."""

from __future__ import annotations

import itertools
from functools import reduce
from operator import mul

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dist import chi2_tail, t_ppf
from ..functions.order import global_index


def _design(features: list[str]) -> dict[str, Column]:
    return {"intercept": F.lit(1.0)} | {c: F.col(c).cast("double") for c in features}


def _sums(df: DataFrame, x: dict[str, Column], weight: Column, names: list[str]) -> np.ndarray:
    """The matrix of sum(weight * xi * xj): one aggregate of a fixed number of sums."""
    cells = [F.sum(weight * x[a] * x[b]).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    row = df.agg(*cells).first()
    m = np.zeros((len(names), len(names)))
    for i in range(len(names)):
        for j in range(i, len(names)):
            m[i, j] = m[j, i] = row[f"s{i}_{j}"] or 0.0
    return m


def _complete(df: DataFrame, features: list[str], y: str) -> DataFrame:
    return df.dropna(subset=[*features, y])


def fit(df: DataFrame, features: list[str], y: str) -> dict[str, float]:
    """Coefficients by the normal equations of centred columns; only sums of products,
    as many as the square of the number of features, reach the driver."""
    base = _complete(df, features, y)
    means = base.agg(*[F.avg(c).alias(c) for c in [*features, y]]).first()
    x = {c: F.col(c).cast("double") - F.lit(float(means[c])) for c in [*features, y]}
    m = _sums(base, x, F.lit(1.0), [*features, y])
    b = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0] if features else np.zeros(0)
    return {"intercept": float(means[y] - sum(v * means[c] for v, c in zip(b, features)))} | dict(zip(features, b.tolist()))


def predicted(coefficients: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(v) if c == "intercept" else F.lit(v) * F.col(c) for c, v in coefficients.items()])


def with_residuals(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Add fitted and residual."""
    b = fit(df, features, y)
    return _complete(df, features, y).withColumn("fitted", predicted(b)).withColumn("residual", F.col(y) - F.col("fitted"))


def ols(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """(term, coefficient, r2, n)."""
    b = fit(df, features, y)
    r = _complete(df, features, y).withColumn("_e", F.col(y) - predicted(b)).agg(F.sum(F.col("_e") ** 2).alias("rss"), (F.var_pop(y) * F.count("*")).alias("tss"), F.count("*").alias("n"))
    terms = df.sparkSession.createDataFrame(list(b.items()), "term string, coefficient double")
    return terms.join(F.broadcast(r)).select("term", "coefficient", (1 - F.col("rss") / F.col("tss")).alias("r2"), "n")


WIDEST = 60
"""The most columns that the terms of a formula may give: sums grow with their square."""


def design(df: DataFrame, terms: list[str], y: str) -> tuple[DataFrame, dict[str, str]]:
    """(rows with a number column for each term and y, the terms' names by column).

    A term is a numeric column, ``C(g)`` for a category (a 0/1 column for each level but
    the least, named ``C(g)[level]``), or ``a:b`` for the products of terms. Rows with a
    null in any column named are left out. More than WIDEST columns are an error.
    """
    category = lambda t: t.startswith("C(") and t.endswith(")")
    single = list(dict.fromkeys(p for t in terms for p in t.split(":")))
    named = {t: t[2:-1] if category(t) else t for t in single}
    base = df.dropna(subset=[*named.values(), y])
    columns: dict[str, list[tuple[str, Column]]] = {}
    for t, c in named.items():
        columns[t] = [(t, F.col(c).cast("double"))]
        if category(t):
            levels = [r[0] for r in base.select(c).distinct().orderBy(c).limit(WIDEST + 2).collect()]
            columns[t] = [(f"{t}[{v}]", (F.col(c) == F.lit(v)).cast("double")) for v in levels[1:]]
    made = [(":".join(n for n, _ in parts), reduce(mul, [v for _, v in parts])) for t in terms for parts in itertools.product(*[columns[p] for p in t.split(":")])]
    if len(made) > WIDEST:
        raise ValueError(f"terms give more than {WIDEST} columns")
    return base.select(*[v.alias(f"_x{i}") for i, (_, v) in enumerate(made)], F.col(y).cast("double").alias("_y")), {f"_x{i}": n for i, (n, _) in enumerate(made)}


def ols_formula(df: DataFrame, terms: list[str], y: str) -> DataFrame:
    """(term, coefficient, r2, n) of a fit on the terms of ``design``."""
    rows, names = design(df, terms, y)
    name = F.create_map(*[F.lit(x) for kv in ({"intercept": "intercept"} | names).items() for x in kv])
    return ols(rows, list(names), "_y").withColumn("term", name[F.col("term")])


def fold_sums(df: DataFrame, features: list[str], y: str) -> tuple[np.ndarray, dict[int, tuple]]:
    """(means of features and y, per ``_fold`` the count, sums and products of centred
    columns): a row per fold reaches the driver."""
    names = [*features, y]
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(names)]).first()
    if means[0] is None:
        raise ValueError("no complete rows")
    x = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(names, means)]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    rows = df.groupBy("_fold").agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"m{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in rows:
        m = np.zeros((len(x), len(x)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        out[r["_fold"]] = (r["n"], np.array([r[f"s{i}"] for i in range(len(x))]), m)
    return np.array(means, dtype=float), out


def fit_sums(names: list[str], keep: list[str], means: np.ndarray, n: int, s: np.ndarray, m: np.ndarray) -> dict[str, float]:
    """Coefficients of the features ``keep`` out of ``names`` from sums of centred columns."""
    at = [names.index(c) for c in keep]
    c = m - np.outer(s, s) / n
    b = np.linalg.lstsq(c[np.ix_(at, at)], c[at, -1], rcond=None)[0]
    centre = means + s / n
    return {"intercept": float(centre[-1] - b @ centre[at])} | dict(zip(keep, b.tolist()))


def coef_table(df: DataFrame, features: list[str], y: str, level: float = 0.95) -> DataFrame:
    """(term, coefficient, hc3_se, low, high): the HC3 covariance in two passes, products
    of features first, then leverages and weighted products."""
    base = _complete(df, features, y)
    b = fit(df, features, y)
    x, names = _design(features), list(b)
    inverse = np.linalg.pinv(_sums(base, x, F.lit(1.0), names))
    leverage = reduce(lambda p, q: p + q, [F.lit(float(inverse[i, j])) * x[a] * x[c] for i, a in enumerate(names) for j, c in enumerate(names)])
    error = F.col(y) - predicted(b)
    meat = _sums(base, x, F.pow(error / (1 - leverage), F.lit(2)), names)
    se = np.sqrt(np.diag(inverse @ meat @ inverse))
    q = t_ppf((1 + level) / 2, max(1, base.count() - len(names)))
    rows = [(t, b[t], float(s), b[t] - q * float(s), b[t] + q * float(s)) for t, s in zip(names, se)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, hc3_se double, low double, high double")


def ols_hc3(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """(term, hc3_se)."""
    return coef_table(df, features, y).select("term", "hc3_se")


def breusch_pagan(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """(lm, df, p_value): n times R² of the squared residuals on the features."""
    squared = with_residuals(df, features, y).withColumn("_e2", F.col("residual") ** 2)
    row = ols(squared, features, "_e2").first()
    lm = row["n"] * row["r2"]
    return df.sparkSession.createDataFrame([(float(lm), len(features), chi2_tail(lm, len(features)))], "lm double, df int, p_value double")


def jarque_bera(df: DataFrame, y: str) -> DataFrame:
    """(n, skew, kurtosis, statistic, p_value); the kurtosis of a normal sample is 3."""
    one = df.agg(F.count(y).alias("n"), F.skewness(y).alias("skew"), (F.kurtosis(y) + 3).alias("kurtosis"))
    stat = F.col("n") / 6 * (F.pow("skew", F.lit(2)) + F.pow(F.col("kurtosis") - 3, F.lit(2)) / 4)
    return one.withColumn("statistic", stat).withColumn("p_value", F.exp(-F.col("statistic") / 2))


def durbin_watson(df: DataFrame, y: str, order: list[str]) -> DataFrame:
    """(statistic): squared steps by squared values, in the order given.

    Neighbours meet by their index, so no task sorts all rows.
    """
    placed = global_index(df.filter(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("_y"), *order), *order).select("index", "_y")
    before = placed.select((F.col("index") + 1).alias("index"), F.col("_y").alias("_b"))
    return placed.join(before, "index", "left").agg((F.sum(F.pow(F.col("_y") - F.col("_b"), F.lit(2))) / F.sum(F.col("_y") ** 2)).alias("statistic"))


def acf(df: DataFrame, y: str, order: list[str], lags: int = 48) -> DataFrame:
    """(lag, acf): autocorrelations with the denominator of lag 0.

    Values are dealt into blocks of their index, and each block meets the head of the next
    one, so that every pair of neighbours is in one task and rows move once or twice.
    """
    base = df.filter(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("_y"), *order)
    mean = base.agg(F.avg("_y").alias("_m"))
    placed = global_index(base, *order).join(F.broadcast(mean)).select("index", (F.col("_y") - F.col("_m")).alias("x"))
    size = max(4096, 4 * lags)
    block = F.floor(F.col("index") / size)
    own = placed.select(block.alias("b"), "index", "x", F.lit(True).alias("own"))
    head = placed.filter((F.col("index") % size < lags) & (F.col("index") >= size)).select((block - 1).alias("b"), "index", "x", F.lit(False).alias("own"))

    def sums(pdf):
        import pandas as pd

        pdf = pdf.sort_values("index")
        x, n = pdf["x"].to_numpy(), int(pdf["own"].sum())
        return pd.DataFrame({"lag": range(lags + 1), "s": [float((x[:n][: max(0, len(x) - k)] * x[k : k + n][: max(0, len(x) - k)]).sum()) for k in range(lags + 1)]})

    total = own.unionByName(head).groupBy("b").applyInPandas(sums, "lag int, s double").groupBy("lag").agg(F.sum("s").alias("s"))
    zero = total.filter("lag = 0").select(F.col("s").alias("s0"))
    return total.join(F.broadcast(zero)).select("lag", F.coalesce(F.try_divide(F.col("s"), F.col("s0")), F.lit(0.0)).alias("acf"))


def std_coefs(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """(term, coefficient, beta): in standard deviations (of samples)."""
    b = fit(df, features, y)
    sd = _complete(df, features, y).agg(*[F.stddev_samp(c).alias(c) for c in [*features, y]]).first()
    rows = [(c, b[c], b[c] * sd[c] / sd[y] if sd[y] else None) for c in features]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, beta double")


def scenario_impact(coefficients: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario, term, change, impact) of rows (scenario, term, change)."""
    return scenarios.join(coefficients, "term").select("scenario", "term", "change", (F.col("change") * F.col("coefficient")).alias("impact"))


def pooled_fits(df: DataFrame, group: str, x: str, y: str, groups: list[str], order: list[str]) -> DataFrame:
    """(scope, n, slope, intercept, r2, skew, kurtosis, durbin_watson, jarque_bera,
    p_value): refitted with one more group at a time, and the residuals' shape and
    dependence in the order given."""
    at = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col(group)).cast("int")
    base = df.filter(F.col(group).isin(*groups)).dropna(subset=[x, y]).select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), *order, F.explode(F.sequence(at, F.lit(len(groups)))).alias("scope"))
    fits = base.groupBy("scope").agg(F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.regr_r2("_y", "_x").alias("r2"))
    met = base.join(F.broadcast(fits), "scope")  # a row per group named
    placed = global_index(met.select("scope", *order, (F.col("_y") - F.col("intercept") - F.col("slope") * F.col("_x")).alias("_e")), "scope", *order).select("scope", "index", "_e")
    before = placed.select("scope", (F.col("index") + 1).alias("index"), F.col("_e").alias("_b"))
    steps = F.sum(F.pow(F.col("_e") - F.col("_b"), F.lit(2)))
    shape = placed.join(before, ["scope", "index"], "left").groupBy("scope").agg(F.skewness("_e").alias("skew"), F.kurtosis("_e").alias("kurtosis"), F.try_divide(steps, F.sum(F.col("_e") ** 2)).alias("durbin_watson"))
    jb = F.col("n") / 6 * (F.pow("skew", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4)
    return fits.join(shape, "scope").withColumn("jarque_bera", jb).withColumn("p_value", F.exp(-F.col("jarque_bera") / 2))


def residual_bins(df: DataFrame, features: list[str], y: str, bins: int = 20) -> DataFrame:
    """(bin, n, mean_fitted, mean_residual, sd_residual) along the fitted values."""
    res = with_residuals(df, features, y)
    ends = res.agg(F.min("fitted").alias("lo"), F.max("fitted").alias("hi"))
    place = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col("fitted") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins)).cast("int")
    return res.join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("fitted").alias("mean_fitted"), F.avg("residual").alias("mean_residual"), F.stddev_pop("residual").alias("sd_residual"))
