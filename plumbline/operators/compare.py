"""Tests and effect sizes for groups, from a row of moments per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import chi2_sf, f_sf, norm_ppf, range_sf, t_quantile, t_sf2
from ..functions.quantiles import group_quantiles, summary_quantile
from .groups import group_stats, k_rows


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def eta_squared(f: Column, d1: Column, d2: Column) -> Column:
    return _clamp(F.coalesce(F.try_divide(d1 * f, d1 * f + d2), F.lit(0.0)))


def omega_squared(f: Column, d1: Column, n: Column) -> Column:
    return _clamp(F.coalesce(F.try_divide(d1 * (f - 1), d1 * (f - 1) + n), F.lit(0.0)))


def epsilon_squared(h: Column, k: Column, n: Column) -> Column:
    return _clamp(F.coalesce(F.try_divide(h - k + 1, n - k), F.lit(0.0)))


def _anova_row(stats: DataFrame) -> DataFrame:
    grand = F.sum(F.col("n") * F.col("mean")).over(k_rows()) / F.sum("n").over(k_rows())
    rows = stats.withColumn("_g", grand)
    one = rows.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_g"), 2)).alias("ssb"), F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ssw"))
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    return one.withColumn("df1", d1).withColumn("df2", d2).withColumn("statistic", F.try_divide(F.col("ssb") / d1, F.col("ssw") / d2))


def anova(df: DataFrame, group: str, y: str, alpha: float = 0.05) -> DataFrame:
    """(k, n, statistic, df1, df2, eta_squared, omega_squared, p_value, passed)."""
    one = _anova_row(group_stats(df, group, y))
    out = one.withColumn("eta_squared", eta_squared(F.col("statistic"), F.col("df1"), F.col("df2"))).withColumn("omega_squared", omega_squared(F.col("statistic"), F.col("df1"), F.col("n"))).withColumn("p_value", f_sf("statistic", "df1", "df2"))
    return out.withColumn("passed", F.col("p_value") < alpha).drop("ssb", "ssw")


def anova_warnings(df: DataFrame, group: str, y: str, small: int = 30, imbalance: float = 1.5) -> DataFrame:
    """(warning): small groups, imbalance, groups without variance."""
    one = group_stats(df, group, y).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count_if(F.col("var") == 0).alias("flat"))
    tests = {"small group": F.col("lo") < small, "imbalance": F.col("hi") / F.col("lo") > imbalance, "group without variance": F.col("flat") > 0}
    return one.select(F.explode(F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()]))).alias("warning"))


def welch_anova(df: DataFrame, group: str, y: str, alpha: float = 0.05) -> DataFrame:
    """(k, n, statistic, df1, df2, eta_squared, omega_squared, p_value, passed); a group
    without variance is an error. Effect sizes take the whole part of df2."""
    stats = group_stats(df, group, y).withColumn("var", F.when(F.col("var") > 0, F.col("var")).otherwise(F.raise_error(F.lit("a group has no variance")).cast("double")))
    rows = stats.withColumn("w", F.col("n") / F.col("var"))
    rows = rows.withColumn("_w", F.sum("w").over(k_rows())).withColumn("_m", F.sum(F.col("w") * F.col("mean")).over(k_rows()) / F.col("_w"))
    lam = F.sum(F.pow(1 - F.col("w") / F.col("_w"), 2) / (F.col("n") - 1))
    one = rows.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("w") * F.pow(F.col("mean") - F.col("_m"), 2)).alias("b"), lam.alias("l"))
    k = F.col("k")
    f = F.col("b") / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * F.col("l"))
    one = one.withColumn("statistic", f).withColumn("df1", (k - 1).cast("double")).withColumn("df2", (k * k - 1) / (3 * F.col("l")))
    out = one.withColumn("eta_squared", eta_squared(F.col("statistic"), F.col("df1"), F.floor("df2"))).withColumn("omega_squared", omega_squared(F.col("statistic"), F.col("df1"), F.col("n"))).withColumn("p_value", f_sf("statistic", "df1", "df2"))
    return out.withColumn("passed", F.col("p_value") < alpha).drop("b", "l")


def kruskal(df: DataFrame, group: str, y: str, alpha: float = 0.05) -> DataFrame:
    """(k, n, statistic, df1, epsilon_squared, p_value, passed), corrected for ties.

    Average ranks come from the counts of the distinct values, summed up in their order
    by ranges, so no task holds them all.
    """
    from ..functions.order import global_index

    base = df.select(F.col(group).cast("string").alias("g"), F.col(y).cast("double").alias("v")).filter("g is not null and v is not null and not isnan(v)")
    cells = base.groupBy("v", "g").agg(F.count("*").alias("c"))
    values = global_index(cells.groupBy("v").agg(F.sum("c").alias("t")), "v")
    # running counts: within blocks of the order, then over the blocks
    block = F.floor(F.col("index") / 65536)
    values = values.withColumn("_b", block)
    sums = values.groupBy("_b").agg(F.sum("t").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.join(F.broadcast(sums.select("_b", before.alias("_before"))), "_b")
    run = F.coalesce(F.sum("t").over(Window.partitionBy("_b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = values.select("v", "t", (F.col("_before") + run + (F.col("t") + 1) / 2).alias("r"))
    by_group = cells.join(ranks, "v").groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("r")).alias("s"))
    one = by_group.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"))
    ties = ranks.agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    out = one.join(F.broadcast(ties)).withColumn("statistic", h).withColumn("df1", (F.col("k") - 1).cast("double"))
    out = out.withColumn("epsilon_squared", epsilon_squared(F.col("statistic"), F.col("k"), n)).withColumn("p_value", chi2_sf("statistic", "df1"))
    return out.withColumn("passed", F.col("p_value") < alpha).drop("q", "ties")


def levene(df: DataFrame, group: str, y: str, alpha: float = 0.05, approx: bool = False) -> DataFrame:
    """Analysis of variance of the distances from the groups' medians."""
    base = df.filter(F.col(group).isNotNull() & F.col(y).isNotNull())
    if approx:
        medians = base.groupBy(F.col(group).alias("_g")).agg(summary_quantile(y, 0.5).alias("_m"))
    else:
        medians = group_quantiles(base.select(F.col(group).alias("_g"), F.col(y).cast("double").alias("_y")), "_g", "_y", {"_m": 0.5}).select("_g", "_m")
    away = base.join(medians, F.col(group) == F.col("_g")).withColumn("_d", F.abs(F.col(y) - F.col("_m")))
    return anova(away, group, "_d", alpha).select("k", "n", "statistic", "df1", "df2", "p_value", "passed")


def normality(df: DataFrame, group: str, y: str) -> DataFrame:
    """(group, n, skew, kurtosis, jarque_bera, p_value) on all rows."""
    v = F.col(y).cast("double")
    out = df.filter(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("group")).agg(F.count(v).alias("n"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.pow("skew", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4)
    return out.withColumn("jarque_bera", jb).withColumn("p_value", F.exp(-F.col("jarque_bera") / 2))


def effect_sizes(f_rows: DataFrame) -> DataFrame:
    """Add eta_squared and omega_squared to rows (statistic, df1, df2, n)."""
    return f_rows.withColumn("eta_squared", eta_squared(F.col("statistic"), F.col("df1"), F.col("df2"))).withColumn("omega_squared", omega_squared(F.col("statistic"), F.col("df1"), F.col("n")))


BLOCKS = 16


def pairs(df: DataFrame, group: str, y: str) -> DataFrame:
    """Each pair of groups (a < b) with their moments. Groups are dealt into blocks, and
    blocks meet by an equal pair of block numbers, so that many groups are spread over
    tasks and none has to hold all of them."""
    stats = group_stats(df, group, y)
    own, other = F.pmod(F.xxhash64("group"), F.lit(BLOCKS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    a = stats.select(own.alias("_i"), other.alias("_j"), *[F.col(c).alias(f"{c}_a") for c in stats.columns])
    b = stats.select(other.alias("_i"), own.alias("_j"), *[F.col(c).alias(f"{c}_b") for c in stats.columns])
    return a.join(b, ["_i", "_j"]).filter(F.col("group_a") < F.col("group_b")).drop("_i", "_j")


def _pooled() -> Column:
    freedom = F.col("n_a") + F.col("n_b") - 2
    return F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / freedom)


def cohens_d(df: DataFrame, group: str, y: str) -> DataFrame:
    """(group_a, group_b, d, g): 0 for groups of fewer than 2 or without variance."""
    ok = (F.col("n_a") > 1) & (F.col("n_b") > 1)
    d = F.when(ok, F.coalesce(F.try_divide(F.col("mean_a") - F.col("mean_b"), _pooled()), F.lit(0.0))).otherwise(0.0)
    out = pairs(df, group, y).withColumn("d", d)
    return out.select("group_a", "group_b", "d", (F.col("d") * (1 - 3 / (4 * (F.col("n_a") + F.col("n_b")) - 9))).alias("g"))


def _welch(rows: DataFrame) -> DataFrame:
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    rows = rows.withColumn("diff", F.col("mean_a") - F.col("mean_b")).withColumn("se", F.sqrt(va + vb))
    freedom = F.try_divide(F.pow(va + vb, F.lit(2)), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    return rows.withColumn("t", F.coalesce(F.try_divide(F.col("diff"), F.col("se")), F.lit(0.0))).withColumn("df", F.coalesce(freedom, (F.col("n_a") + F.col("n_b") - 2).cast("double")))


def games_howell(df: DataFrame, group: str, y: str, groups: list[str] | None = None) -> DataFrame:
    """All pairs: diff, se, t, df, p_value by the studentised range, g and a note for small
    groups. ``groups`` restricts them; without it all groups of the table count."""
    df = df if groups is None else df.filter(F.col(group).isin(*groups))
    k = group_stats(df, group, y).agg(F.count("*").cast("double").alias("k"))
    rows = _welch(pairs(df, group, y)).join(F.broadcast(k))
    d = F.coalesce(F.try_divide(F.col("diff"), _pooled()), F.lit(0.0))
    rows = rows.withColumn("g", d * (1 - 3 / (4 * (F.col("n_a") + F.col("n_b")) - 9))).withColumn("p_value", range_sf(F.abs("t") * F.sqrt(F.lit(2.0)), F.col("k"), F.col("df")))
    note = F.when(F.least("n_a", "n_b") < 30, "use hedges_g").otherwise("")
    return rows.select("group_a", "group_b", "diff", "se", "t", "df", "g", note.alias("note"), "p_value")


def welch_ttest(df: DataFrame, group: str, y: str, treated: str, control: str, level: float = 0.95) -> DataFrame:
    """One row: diff, t, df, d, p_value, low, high (interval of the mean difference)."""
    base = df.filter(F.col(group).isin(treated, control))
    rows = _welch(pairs(base, group, y))
    sign = F.when(F.col("group_a") == treated, 1.0).otherwise(-1.0)
    rows = rows.withColumn("diff", sign * F.col("diff")).withColumn("t", sign * F.col("t")).withColumn("d", F.coalesce(F.try_divide(F.col("diff"), _pooled()), F.lit(0.0)))
    rows = rows.withColumn("p_value", t_sf2("t", "df")).withColumn("_q", t_quantile(F.lit((1 + level) / 2), F.col("df")))
    return rows.select("diff", "t", "df", "d", "p_value", (F.col("diff") - F.col("_q") * F.col("se")).alias("low"), (F.col("diff") + F.col("_q") * F.col("se")).alias("high"))


def adjust_pvalues(df: DataFrame, p: str, method: str) -> DataFrame:
    """Add adjusted to a small table of tests: bonferroni or fdr_bh."""
    m = F.count("*").over(k_rows())
    if method == "bonferroni":
        return df.withColumn("adjusted", F.least(F.lit(1.0), F.col(p) * m))
    if method != "fdr_bh":
        raise ValueError(f"unknown correction: {method}")
    order = Window.partitionBy(F.lit(0)).orderBy(p)
    scaled = df.withColumn("_m", m).withColumn("_r", F.row_number().over(order)).withColumn("_s", F.col(p) * F.col("_m") / F.col("_r"))
    behind = Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return scaled.withColumn("adjusted", F.least(F.lit(1.0), F.min("_s").over(behind))).drop("_m", "_r", "_s")


def assumption_flags(df: DataFrame, group: str, y: str, groups: list[str], alpha: float = 0.05) -> DataFrame:
    """(flag, raised): imbalance or absent groups, shape, and unequal spread."""
    from .groups import group_describe

    sizes = group_describe(df, group, y, groups).agg(F.coalesce((F.max("imbalance_ratio") > 1.5) | F.max("absent"), F.lit(False)).alias("raised")).select(F.lit("sizes").alias("flag"), "raised")
    odd = (F.abs("skew") > 2) | (F.abs("kurtosis") > 7) | (F.col("p_value") < alpha)
    shape = normality(df, group, y).agg(F.coalesce(F.max(odd), F.lit(False)).alias("raised")).select(F.lit("shape").alias("flag"), "raised")
    spread = levene(df, group, y, alpha).select(F.lit("spread").alias("flag"), F.coalesce("passed", F.lit(False)).alias("raised"))
    return sizes.unionByName(shape).unionByName(spread)


def omnibus(df: DataFrame, group: str, y: str, alpha: float = 0.05) -> DataFrame:
    """(method, statistic, effect, p_value, significant_pairs) of all three tests."""
    found = games_howell(df, group, y).agg(F.count_if(F.col("p_value") < alpha).alias("significant_pairs"))
    a = anova(df, group, y, alpha).select(F.lit("anova").alias("method"), "statistic", F.col("omega_squared").alias("effect"), "p_value")
    w = welch_anova(df, group, y, alpha).select(F.lit("welch").alias("method"), "statistic", F.col("omega_squared").alias("effect"), "p_value")
    k = kruskal(df, group, y, alpha).select(F.lit("kruskal").alias("method"), "statistic", F.col("epsilon_squared").alias("effect"), "p_value")
    return a.unionByName(w).unionByName(k).join(F.broadcast(found))


def segment_mde(df: DataFrame, group: str, y: str, alpha: float = 0.05, power: float = 0.8, effect: float = 0.5) -> DataFrame:
    """(group, n, mean, sd, mde, n_needed): with n in each arm the least effect that can be
    found, and the arm size for an effect of ``effect`` standard deviations (normal)."""
    z = norm_ppf(1 - alpha / 2) + norm_ppf(power)
    return group_stats(df, group, y).select("group", "n", "mean", F.sqrt("var").alias("sd"), (F.lit(z) * F.sqrt(2 / F.col("n"))).alias("mde"), F.ceil(F.lit(2 * (z / effect) ** 2)).alias("n_needed"))
