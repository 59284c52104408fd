"""Hand-computed values, edge cases and loud failures."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions import dist, features, order
from plumbline.functions.filters import FilterSpec, exclude_any, filter_all, nan_to_null
from plumbline.operators import checks, clean, compare, encode, graph, groups, joins, models, profile, regress, sample
from plumbline.plans import analysis
from plumbline.sources import tables


def one(df):
    return df.first().asDict()


# ---- distributions ----


def test_tails():
    assert math.isclose(dist.norm_ppf(0.975), 1.959963984540054, rel_tol=1e-12)
    assert math.isclose(dist.t_tail(2.228138851964939, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(dist.f_tail(4.102821015, 2, 10), 0.05, rel_tol=1e-8)
    assert math.isclose(dist.chi2_tail(5.991464547107979, 2), 0.05, rel_tol=1e-10)
    assert math.isclose(dist.t_ppf(0.975, 10), 2.228138851964939, rel_tol=1e-9)
    assert dist.t_tail(0, 5) == 1 and dist.f_tail(0, 2, 5) == 1


def test_studentised_range():
    assert abs(dist.range_tail(3.877, 3, 10) - 0.05) < 2e-4
    assert abs(dist.range_tail(3.633, 4, math.inf) - 0.05) < 2e-4
    for t, df in ((1.0, 8), (2.5, 20), (0.3, 100)):  # two groups: q is the square root of 2 times t
        assert abs(dist.range_tail(math.sqrt(2) * t, 2, df) - dist.t_tail(t, df)) < 1e-5


# ---- cleaning ----


def test_parse_datetime(spark):
    df = spark.createDataFrame([("2024-01-01",), ("not-a-date",), ("2024-01-02",)], "d string")
    assert one(clean.parse_failures(df, {"d": clean.as_datetime("d")})) == {"column": "d", "failures": 1, "examples": ["not-a-date"]}
    assert [r[0] is None for r in df.select(clean.as_datetime("d")).collect()] == [False, True, False]
    us = spark.createDataFrame([("01/02/2024",)], "d string")
    assert us.select(clean.as_datetime("d", ("MM/dd/yyyy",))).first()[0].month == 1


def test_parse_numeric(spark):
    df = spark.createDataFrame([("1",), ("2",), ("abc",), ("3.5",)], "n string")
    assert [r[0] for r in df.select(clean.as_number("n", "bigint")).collect()] == [1, 2, None, 3]
    assert one(clean.parse_failures(df, {"n": clean.as_number("n")}))["failures"] == 1


def test_missing_tokens(spark):
    df = spark.createDataFrame([("a",), ("NA",), ("",), ("b",)], "s string")
    assert [r[0] is None for r in clean.standardize_missing(df).collect()] == [False, True, True, False]
    assert one(clean.observed_tokens(df))["tokens"] == ["", "NA"]


def test_canonicalize_order(spark):
    df = spark.createDataFrame([("2024-01-01", 1), ("NA", 2), ("2024-01-02", 3)], "dt string, target long")
    out = clean.canonicalize(df, "target", {"dt": ()})
    assert out.filter("dt is null").count() == 1 and out.count() == 3


def test_dedup_and_target(spark):
    assert clean.dedup_rows(spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "a string, b int")).count() == 2
    df = spark.createDataFrame([("10",), (None,), ("NA",), ("40",)], "t string")
    assert clean.canonicalize(df, "t").count() == 2


def test_audit_and_guard(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("y", None), ("z", 2)], "a string, t int")
    audit = clean.transform_audit(df, "t", clean.canonicalize(df, "t"))
    assert one(audit) == {"rows_in": 4, "rows_out": 2, "dropped": 2, "duplicates": 1, "null_target": 1, "unexplained": 0}
    lost = clean.transform_audit(df, "t", clean.canonicalize(df, "t").limit(0))
    with pytest.raises(ValueError):
        clean.guard_drops(lost, 0.1)
    empty = df.limit(0)
    clean.guard_drops(clean.transform_audit(empty, "t", empty), 0.1)


# ---- filters ----


def test_filters_and_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0)], "id int, x double")
    assert [r.id for r in filter_all(df, [FilterSpec("x", "!=", 1)]).collect()] == [2, 3]
    assert [r.id for r in filter_all(df, [FilterSpec("x", "<", 9)]).collect()] == [1, 3]
    assert [r.id for r in exclude_any(df, [[FilterSpec("x", ">", 4)]]).collect()] == [1, 2]
    assert exclude_any(df, []).count() == 3
    with pytest.raises(ValueError):
        exclude_any(df, [[FilterSpec("gone", ">", 4)]])
    with pytest.raises(ValueError):
        filter_all(df, [FilterSpec("x", "~", 4)])


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert nan_to_null(df).filter("x is null").count() == 1


# ---- features ----


def test_calendar(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 09:30:00' t union all select timestamp_ntz'2024-02-03 18:00:00'").orderBy("t")
    assert [tuple(r) for r in df.select(features.hour("t"), features.weekday("t"), features.month("t"), features.is_weekend("t"), features.in_hours("t")).collect()] == [(9, 0, 1, 0, 1), (18, 5, 2, 1, 1)]


def test_rate_and_same(spark):
    df = spark.createDataFrame([(6.0, 60.0, "a", "a"), (30.0, 120.0, "a", None), (10.0, 0.0, None, None)], "d double, m double, x string, y string")
    assert [r[0] for r in df.select(features.rate_per_hour("d", "m")).collect()] == [6.0, 15.0, None]
    assert [r[0] for r in df.select(features.same_group("x", "y")).collect()] == [1, 0, 0]


def test_builders(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError):
        features.build_derived(df, [("a", "nothing", ("x",))])
    with pytest.raises(ValueError):
        features.build_derived(df, [("a", "log1p", ("y",))])
    registry = dict(features.BUILDERS)
    features.register_builder("twice", lambda c: F.col(c) * 2, registry)
    assert features.build_derived(df, [("a", "twice", ("x",))], registry).first()["a"] == 2.0
    with pytest.raises(ValueError):
        features.register_builder("twice", None, registry)


# ---- joins ----


def test_join_audit(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,), (5,)], "k int")
    lk = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    assert one(joins.join_audit(df, lk, "k", "k")) == {"rows_attempted": 5, "matched": 3, "null_keys": 1, "unmatched": 1, "unmatched_rate": 0.25, "duplicate_keys": 0}
    none = spark.createDataFrame([(None,), (None,)], "k int")
    assert one(joins.join_audit(none, lk, "k", "k"))["unmatched_rate"] == 0
    assert joins.lookup_join(df, lk, "k", "k").columns == ["k", "k_lookup", "v"]
    assert joins.unmatched_rows(df, lk, "k", "k").count() == 2


def test_lookup_value_audit(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (99,)], "k int")
    lk = spark.createDataFrame([(1, "North", "a"), (2, "Unknown", "b"), (3, None, "c"), (4, "South", "d")], "k int, district string, zone string")
    out = {r["column"]: r for r in joins.lookup_value_audit(df, lk, "k", "k", ["Unknown"]).collect()}
    assert (out["district"].null_count, out["district"].sentinel_count, out["district"].affected_rows, out["district"].affected_rate, out["district"].affected_keys) == (1, 1, 2, 0.5, ["2", "3"])
    assert out["zone"].affected_rows == 0


def test_lookup_tokens(spark):
    raw = spark.createDataFrame([("1", "N/A", None), ("2", None, "N/A")], "id string, a string, b string")
    assert [tuple(r) for r in tables.as_lookup(raw, {"id": "int"}, []).collect()] == [(1, "N/A", ""), (2, "", "N/A")]
    assert [tuple(r) for r in tables.as_lookup(raw, {"id": "int"}, ["N/A"]).collect()] == [(1, None, ""), (2, "", None)]


# ---- groups ----


def test_group_describe(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 10.0), ("c", 3.0), ("c", 4.0)], "g string, t double")
    out = {r.group: r for r in groups.group_describe(df, "g", "t", ["a", "b", "d"]).collect()}
    assert (out["a"].n, out["b"].n, out["d"].n, out["d"].absent, out["a"].imbalance_ratio, out["b"].std) == (2, 1, 0, True, 2.0, None)


def test_robust(spark):
    df = spark.createDataFrame([(float(x), 7.0) for x in (1, 2, 3, 4, 5, 100)], "x double, k double")
    z = [r.x_mz for r in groups.modified_zscores(df, ["x", "k"]).orderBy("x").collect()]
    assert math.isclose(z[-1], 0.6745 * 96.5 / 1.5)
    assert groups.modified_zscores(df, ["k"]).filter("k_mz = 0").count() == 6
    assert groups.outlier_mask(df, ["x", "k"]).filter("outlier").count() == 1
    ten = spark.createDataFrame([(float(x),) for x in range(1, 11)] + [(None,)], "x double")
    out = groups.winsorize(ten, ["x"], 0.9)
    assert math.isclose(out.agg(F.max("x")).first()[0], 9.1) and out.filter("x is null").count() == 1


def test_baselines(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (30.0,)], "y double")
    assert math.isclose(one(groups.baseline_regression(df, "y"))["mae_mean"], 20 / 3)
    labels = spark.createDataFrame([("b",), ("a",), ("a",), ("b",)], "y string")
    assert one(groups.baseline_majority(labels, "y")) == {"label": "a", "support": 2, "accuracy": 0.5}
    g = spark.createDataFrame([("a", 10.0)] * 3 + [("b", 20.0)] * 3, "g string, y double")
    assert one(groups.baseline_group_range(g, "g", "y"))["value"] == 10
    with pytest.raises(Exception, match="no group"):
        groups.baseline_group_range(g.limit(0), "g", "y").collect()
    imp = spark.createDataFrame([(10.0, 8.0), (10.0, 12.0), (0.0, 1.0)], "b double, c double")
    assert [r.improvement for r in groups.improvement(imp, "b", "c").collect()] == [0.2, -0.2, None]


# ---- tests ----


def frame(spark, values):
    return spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, y double")


def test_anova_by_hand(spark):
    df = frame(spark, {"a": [1, 2, 3], "b": [2, 3, 4], "c": [5, 6, 7]})
    r = one(compare.anova(df, "g", "y"))
    assert math.isclose(r["statistic"], 13.0) and math.isclose(r["p_value"], dist.f_tail(13.0, 2, 6)) and r["passed"]
    k = one(compare.kruskal(df, "g", "y"))
    values = [1, 2, 3, 2, 3, 4, 5, 6, 7]
    ranks = np.array([1, 2.5, 4.5, 2.5, 4.5, 6, 7, 8, 9])
    h = 12 / 90 * sum(ranks[i : i + 3].sum() ** 2 / 3 for i in (0, 3, 6)) - 30
    assert math.isclose(k["statistic"], h / (1 - 12 / (9**3 - 9)))
    assert len(values) == k["n"]


def test_effects(spark):
    row = spark.createDataFrame([(4.0, 2.0, 30.0, 33)], "statistic double, df1 double, df2 double, n long")
    out = one(compare.effect_sizes(row))
    assert math.isclose(out["eta_squared"], 8 / 38) and math.isclose(out["omega_squared"], 6 / 39)
    e = spark.range(1).select(compare.epsilon_squared(F.lit(12.0), F.lit(3), F.lit(90))).first()[0]
    assert math.isclose(e, 10 / 87)


def test_cohens_d(spark):
    assert one(compare.cohens_d(frame(spark, {"a": [1, 2, 3], "b": [4, 5, 6]}), "g", "y"))["d"] == -3
    assert one(compare.cohens_d(frame(spark, {"a": [1, 1], "b": [1, 1]}), "g", "y"))["d"] == 0


def test_welch_pairs(spark):
    df = frame(spark, {"a": [1, 2, 3, 4], "b": [3, 5, 7, 9]})
    t = one(compare.welch_ttest(df, "g", "y", "b", "a"))
    se = math.sqrt(5 / 3 / 4 + 20 / 3 / 4)
    assert math.isclose(t["diff"], 3.5) and math.isclose(t["t"], 3.5 / se) and t["low"] < 3.5 < t["high"]
    g = one(compare.games_howell(df, "g", "y"))
    assert abs(g["p_value"] - t["p_value"]) < 1e-5 and g["note"] == "use hedges_g"


def test_welch_needs_variance(spark):
    with pytest.raises(Exception, match="no variance"):
        compare.welch_anova(frame(spark, {"a": [1, 1], "b": [1, 2]}), "g", "y").collect()


def test_adjust(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.2,), (0.5,)], "p double")
    assert [r.adjusted for r in compare.adjust_pvalues(df, "p", "bonferroni").orderBy("p").collect()] == [0.04, 0.16, 0.8, 1.0]
    assert [round(r.adjusted, 6) for r in compare.adjust_pvalues(df, "p", "fdr_bh").orderBy("p").collect()] == [0.04, 0.08, 0.266667, 0.5]
    with pytest.raises(ValueError):
        compare.adjust_pvalues(df, "p", "other")


def test_group_guards(spark):
    level = lambda v: [tuple(r) for r in checks.validate_groups(frame(spark, v), "g", "y").collect()]
    assert ("error", "fewer than 2 groups") in level({"a": [1, 2]})
    assert ("error", "group of fewer than 2") in level({"a": [1, 2], "b": [1]})
    assert ("error", "not finite") in level({"a": [1, float("nan")], "b": [1, 2]})
    assert ("error", "no variance") in level({"a": [1, 1], "b": [2, 2]})
    assert level({"a": [1, 1], "b": [2, 3]}) == [("warning", "group without variance")]
    with pytest.raises(ValueError):
        checks.require_groups(frame(spark, {"a": [1, 2]}), "g", "y")


# ---- samples ----


def test_split_time(spark):
    df = spark.createDataFrame([(i, i) for i in range(10)], "d int, v int")
    out = sample.split_time(df, 0.3, "d", ["v"])
    assert sorted(r.v for r in out.filter("part = 'val'").collect()) == [7, 8, 9]


def test_sample_sizes(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 5), ("b", 3), ("c", 10)) for i in range(n)], "g string, i int").withColumn("id", F.monotonically_increasing_id())
    sizes = lambda d: {r.g: r["count"] for r in d.groupBy("g").count().collect()}
    assert sizes(sample.sample_per_group(df, "g", 3, ["id"], 1)) == {"a": 3, "b": 3, "c": 3}
    assert sizes(sample.sample_balanced(df, "g", ["id"], 1)) == {"a": 3, "b": 3, "c": 3}
    assert sizes(sample.sample_frac(df, "g", 0.5, ["id"], 1)) == {"a": 2, "b": 2, "c": 5}


def test_assignment(spark):
    df = spark.createDataFrame([(s, i) for s, n in (("a", 40), ("b", 30), ("c", 30)) for i in range(n)], "s string, i int").withColumn("id", F.monotonically_increasing_id())
    out = sample.assign_stratified(df, "s", 50, ["id"], 1)
    assert {r.s: r.n for r in out.groupBy("s").agg(F.sum("treated").alias("n")).collect()} == {"a": 20, "b": 15, "c": 15}
    assert sample.assign_random(df, 7, ["id"], 1).filter("treated = 1").count() == 7
    with pytest.raises(ValueError):
        sample.assign_random(df, 101, ["id"], 1)


def test_independent_of_partitions(spark):
    df = spark.range(1000).withColumn("y", F.col("id") % 7)
    take = lambda d: sorted(r.id for r in sample.split_random(d, 0.1, ["id"], 3).filter("part = 'val'").collect())
    assert take(df.repartition(1)) == take(df.repartition(16)) and len(take(df)) == 100
    assert [r[0] for r in order.global_index(df, "id").orderBy("id").select("index").collect()] == list(range(1000))


def test_sample_needs_size(spark):
    df = spark.range(5)
    with pytest.raises(ValueError):
        tables.read_sample(df, None, 1, ["id"], ["id"])
    assert tables.read_sample(df, None, 1, ["id"], ["id"], full=True).count() == 5


# ---- profiles ----


def test_profile(spark):
    df = spark.createDataFrame([(1, 10.0, "a"), (2, 20.0, "a"), (3, 30.0, "b"), (4, 40.0, "b")], "id long, value double, g string")
    out = {r["column"]: r for r in profile.profile(df).collect()}
    assert (out["id"].identifier_score, out["g"].distinct_count, out["value"].min_value, out["value"].max_value) == (1.0, 2, "10.0", "40.0")


def test_histogram_discrete(spark):
    df = spark.createDataFrame([(-1.75,), (0.0,), (0.0,), (1.75,)], "y double")
    assert [(r.low, r.high, r["count"]) for r in profile.histogram_discrete(df, "y").orderBy("value").collect()] == [(-2.625, -0.875, 1), (-0.875, 0.875, 2), (0.875, 2.625, 1)]
    single = profile.histogram_discrete(df.limit(1), "y").first()
    assert single.high - single.low == 1


def test_histogram_auto_matches_numpy(spark):
    x = np.random.default_rng(3).normal(size=500)
    got = profile.histogram_auto(spark.createDataFrame([(float(v),) for v in x], "y double"), "y").orderBy("bin").collect()
    counts, edges = np.histogram(x, bins="auto")
    assert [r["count"] for r in got] == counts.tolist() and np.allclose([r.low for r in got], edges[:-1])
    assert sum(r["count"] for r in profile.histogram_auto(spark.createDataFrame([(2.0,)] * 3, "y double"), "y").collect()) == 3


def test_infer(spark):
    rows = [(i, float(i) / 3, i % 2 + 1, "x" if i % 2 else "y", f"2024-01-{i % 28 + 1:02d}") for i in range(60)]
    out = {r["column"]: (r.kind, r.role) for r in profile.infer_columns(spark.createDataFrame(rows, "id long, value double, cat_int long, cat string, day string")).collect()}
    assert out["id"][1] == "ignore" and out["day"] == ("datetime", "datetime") and out["cat_int"][0] == out["cat"][0] == "categorical"


def test_qq_line(spark):
    x = np.random.default_rng(5).normal(size=400)
    r = profile.qq_points(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id int, y double"), "y", ["id"], 50).collect()
    assert len(r) <= 51 and abs(r[0].slope - 1) < 0.05 and abs(r[0].intercept) < 1e-6


# ---- checks ----


def test_checks(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, 4.0), (4, float("inf"))], "a long, b double")
    assert [r["column"] for r in checks.check_nulls(df, 0.2).filter("not ok").collect()] == ["b"]
    assert {r.rule: r.violations for r in checks.check_values(df, [FilterSpec("a", ">", 2), FilterSpec("b", "<", 4)], ("b",)).collect()} == {"> 2": 2, "< 4": 2, "not null": 1}
    assert checks.check_dtypes(df, StructType().add("a", "long").add("b", "double")).count() == 0
    with pytest.raises(ValueError):
        checks.require_finite(df, ["b"])
    assert one(checks.readiness([spark.createDataFrame([("x", "PASS"), ("y", "WARNING")], "kind string, status string")]))["verdict"] == "READY WITH WARNINGS"


def test_versions(spark, tmp_path):
    df = spark.range(3)
    path = tables.write_version(df, str(tmp_path), "s", 1)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tables.write_version(df, str(tmp_path), "s", 1)
    assert one(tables.table_digest(df)) == one(tables.table_digest(df.repartition(3)))
    with pytest.raises(ValueError):
        tables.scan_table(spark, "x.xlsx")


# ---- regression ----


def test_ols(spark):
    rng = np.random.default_rng(0)
    x1, x2 = rng.normal(size=200), rng.normal(size=200)
    y = 2 * x1 + 0.5 * x2 + rng.normal(size=200) * (1 + abs(x1))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x1, x2, y)], "x1 double, x2 double, y double")
    X = np.column_stack([np.ones(200), x1, x2])
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    out = {r.term: r for r in regress.coef_table(df, ["x1", "x2"], "y").collect()}
    assert np.allclose([out[t].coefficient for t in ("intercept", "x1", "x2")], b)
    inv = np.linalg.inv(X.T @ X)
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    e = (y - X @ b) / (1 - h)
    assert np.allclose([out[t].hc3_se for t in ("intercept", "x1", "x2")], np.sqrt(np.diag(inv @ (X.T * e**2) @ X @ inv)))
    beta = {r.term: r.beta for r in regress.std_coefs(df, ["x1", "x2"], "y").collect()}
    assert math.isclose(beta["x1"], b[1] * x1.std(ddof=1) / y.std(ddof=1))


def test_series(spark):
    rng = np.random.default_rng(0)
    e = rng.normal(size=500)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(e)], "i int, y double")
    assert math.isclose(one(regress.durbin_watson(df, "y", ["i"]))["statistic"], (np.diff(e) ** 2).sum() / (e**2).sum())
    x = e - e.mean()
    got = [r.acf for r in regress.acf(df, "y", ["i"], 5).orderBy("lag").collect()]
    assert np.allclose(got, [(x[: 500 - k] * x[k:]).sum() / (x**2).sum() for k in range(6)])


def test_acf_across_blocks(spark):
    x = np.random.default_rng(1).normal(size=10_000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, y double")
    x = x - x.mean()
    got = [r.acf for r in regress.acf(df, "y", ["i"], 3).orderBy("lag").collect()]
    assert np.allclose(got, [(x[: len(x) - k] * x[k:]).sum() / (x**2).sum() for k in range(4)])


# ---- models ----


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (3.0, 3.2), (4.0, 3.8)], "y double, p double")
    m = one(models.regression_metrics(df, "y", "p"))
    assert (m["mae"], m["rmse"], m["r2"]) == (0.15, 0.1581, 0.98)
    b = spark.createDataFrame([(float(y), p) for y, p in zip(range(1, 6), (0.1, 0.2, 0.9, 0.95, 0.99))], "y double, p double")
    r = one(models.binary_metrics(b, "y", "p", 3))
    assert (r["roc_auc"], r["average_precision"]) == (1.0, 1.0)
    with pytest.raises(Exception, match="finite"):
        models.regression_metrics(df.union(spark.createDataFrame([(float("nan"), 1.0)], "y double, p double")), "y", "p").collect()


def test_search_allocation(spark):
    lb = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "model string, best double")
    plan = lambda rest, top, d=lb: {r.model: r.trials for r in models.trial_allocation(d, rest, top).collect()}
    assert plan(9, 2) == {"a": 5, "b": 4} and plan(2, 5) == {"a": 1, "b": 1, "c": 0}


def test_promotion(spark):
    c = spark.createDataFrame([("mae", 9.0), ("rmse", 9.9), ("new", 1.0), ("r2", 0.9)], "metric string, value double")
    h = spark.createDataFrame([("mae", 10.0), ("rmse", 10.0), ("r2", 0.5)], "metric string, value double")
    out = {r.metric: r.promote for r in models.promotion(models.compare_models(c, h), 0.05, ("r2",)).collect()}
    assert out == {"mae": True, "rmse": False, "new": True, "r2": True}


def test_unknown_model(spark):
    with pytest.raises(ValueError):
        models.train_model(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), ["x"], "y", "other")
    with pytest.raises(ValueError):
        models.rfe_curve(spark.createDataFrame([("a", 2.0)], "x string, y double"), ["x"], "y", ["x"])


def test_encodings(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0), (None, 4.0)], "g string, y double")
    df = spark.createDataFrame([("a",), ("z",), (None,)], "g string")
    out = {r.g: r.g_target_enc for r in encode.target_encode(train, df, ["g"], "y", 2.0).collect()}
    assert out == {"a": (2 * 2 + 2 * 4) / 4, "z": 4.0, None: 4.0}
    assert {r.g: r.g_freq_enc for r in encode.freq_encode(train, df, "g").collect()} == {"a": 2 / 3, "z": -1.0, None: -1.0}


# ---- graphs ----


def test_reachability(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    out = {r.id: r.depth for r in graph.reachability(edges, spark.createDataFrame([("a",)], "id string")).collect()}
    assert out == {"a": 0, "b": 1, "c": 2}
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert [r.source for r in graph.missing_parents(edges, nodes).collect()] == ["x"]


def test_reachability_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(53)], "source long, target long").coalesce(1)
    out = {r.id: r.depth for r in graph.reachability(edges, spark.createDataFrame([(0,)], "id long").coalesce(1)).collect()}
    assert out == {i: i for i in range(54)}


def test_group_quantiles(spark):
    """Against numpy, with ties, one row, a null group and a group of nulls only."""
    import numpy as np

    from plumbline.functions.quantiles import group_quantiles

    rng = np.random.default_rng(3)
    data = [("a", float(x)) for x in rng.integers(0, 20, 301)] + [("b", float(x)) for x in rng.normal(size=200)] + [("c", 4.0), (None, 1.0), (None, 2.0), ("d", None), ("a", None)]
    qs = {"low": 0.0, "q1": 0.25, "median": 0.5, "p99": 0.99, "high": 1.0}
    got = {r["g"]: r for r in group_quantiles(spark.createDataFrame(data, "g string, v double"), "g", "v", qs).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        own = [v for k, v in data if k == g and v is not None]
        assert r["distinct_count"] == len(set(own))
        assert all(abs(r[name] - np.quantile(own, q)) < 1e-12 for name, q in qs.items())
    assert group_quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", qs).count() == 0


def test_parse_failures_keeps_the_first(spark):
    from plumbline.operators.clean import as_number, parse_failures

    df = spark.createDataFrame([(str(i), f"x{i % 50:02d}", "1") for i in range(500)], "n string, bad string, good string")
    got = {r["column"]: (r["failures"], r["examples"]) for r in parse_failures(df, {c: as_number(c, "double") for c in df.columns}).collect()}
    assert got == {"n": (0, []), "bad": (500, ["x00", "x01", "x02", "x03", "x04"]), "good": (0, [])}


def test_norm_ppf_sql(spark):
    from statistics import NormalDist

    data = [(p,) for p in (1e-300, 1e-12, 0.001, 0.07, 0.08, 0.5, 0.9, 0.93, 1 - 1e-9)]
    got = spark.createDataFrame(data, "p double").select("p", F.expr(dist.norm_ppf_sql("p")).alias("z")).collect()
    assert all(math.isclose(r["z"], NormalDist().inv_cdf(r["p"]), rel_tol=1e-12, abs_tol=1e-12) for r in got)


def _line_rows(spark, n=240):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3))
    y = 2 + x @ [1.5, -0.2, 0.01] + rng.normal(size=n) * 0.3
    return x, y, spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))] + [(n, None, 1.0, 1.0, 1.0)], "i int, a double, b double, c double, y double")


def test_kfold_and_rfe_against_numpy(spark):
    x, y, df = _line_rows(spark)
    fold = np.arange(len(y)) % 3

    def errors(columns):
        out = []
        for f in range(3):
            m = np.column_stack([np.ones(len(y)), x[:, columns]])
            beta = np.linalg.lstsq(m[fold != f], y[fold != f], rcond=None)[0]
            out.append(y[fold == f] - m[fold == f] @ beta)
        return out

    got = one(models.kfold_cv(df, ["a", "b", "c"], "y", ["i"], 3, fold=F.col("i") % 3, digits=9))
    e = errors([0, 1, 2])
    assert got["folds"] == 3
    assert math.isclose(got["mae"], np.mean([np.abs(v).mean() for v in e]), abs_tol=1e-8)
    assert math.isclose(got["rmse"], np.mean([np.sqrt((v * v).mean()) for v in e]), abs_tol=1e-8)
    assert math.isclose(got["median_ae"], np.mean([np.median(np.abs(v)) for v in e]), abs_tol=1e-8)
    assert math.isclose(got["r2"], np.mean([1 - (v * v).sum() / (len(v) * y[fold == f].var()) for f, v in enumerate(e)]), abs_tol=1e-8)
    curve = {r["count"]: (r["dropped"], r["mae"]) for r in models.rfe_curve(df, ["a", "b", "c"], "y", ["i"], fold=F.col("i") % 3).collect()}
    assert [curve[k][0] for k in (3, 2, 1)] == ["c", "b", "a"]
    for k in (1, 2, 3):
        assert math.isclose(curve[k][1], np.mean([np.abs(v).mean() for v in errors(list(range(k)))]), abs_tol=1e-8)
    assert models.rfe_curve(df, ["a", "b"], "y", ["i"]).count() == 2
    assert one(models.kfold_cv(df, "a", "y", ["i"]))["folds"] == 5
    with pytest.raises(ValueError):
        models.kfold_cv(df.filter("i < 0"), ["a"], "y", ["i"])


def test_formula_terms(spark):
    df = spark.createDataFrame([("u", 1.0, 3.0), ("u", 2.0, 5.0), ("v", 1.0, 10.0), ("v", 3.0, 10.0), ("w", 0.0, 0.0), ("w", 2.0, -2.0), (None, 9.0, 9.0)], "g string, x double, y double")
    got = {r["term"]: round(r["coefficient"], 9) for r in regress.ols_formula(df, ["x", "C(g)", "x:C(g)"], "y").collect()}
    assert got == {"intercept": 1.0, "x": 2.0, "C(g)[v]": 9.0, "C(g)[w]": -1.0, "x:C(g)[v]": -2.0, "x:C(g)[w]": -3.0}
    with pytest.raises(ValueError):
        regress.ols_formula(spark.range(100).selectExpr("cast(id as string) g", "id y"), ["C(g)"], "y")


def test_neighbours_as_models(spark):
    train = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0), (4.0, 2.0), (10.0, 5.0), (None, 7.0)], "x double, y double")
    rows = spark.createDataFrame([(1, 0.0), (2, 3.0), (3, None)], "i int, x double")
    predict = lambda m, **p: {r["i"]: r["prediction"] for r in models.train_model(train, ["x"], "y", m, p).transform(rows).collect()}
    assert predict("knn", k=2) == {1: 1.5, 2: 2.0}
    assert predict("knn", k=2, weights="distance") == {1: 1.0, 2: 2.0}
    assert predict("knn_classifier", k=3) == {1: 2.0, 2: 2.0}
    assert predict("knn_classifier", k=3, weights="distance") == {1: 1.0, 2: 2.0}
    for model in ("knn", "linear"):
        with pytest.raises(ValueError):
            models.train_model(train, ["x"], "y", model, {"depth": 2})


def test_neighbours_in_several_blocks(spark):
    rng = np.random.default_rng(4)
    v, y = rng.normal(size=(60, 3)), rng.integers(0, 10, 60).astype(float)
    df = spark.createDataFrame([(i, v[i].tolist(), y[i].item()) for i in range(60)], "i long, v array<double>, y double")
    for weights in ("uniform", "distance"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with tables too large for one partition
        try:
            got = {r["i"]: r["prediction"] for r in models.knn_predict(df, df.filter("i % 3 = 0"), "v", "y", "i", 4, block=7, weights=weights).collect()}
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sorted(got) == list(range(0, 60, 3))
        for i in got:
            d = np.sqrt(((v - v[i]) ** 2).sum(1))
            best = [j for j in np.argsort(d) if j != i][:4]
            assert math.isclose(got[i], np.average(y[best], weights=1 / d[best] if weights == "distance" else None), abs_tol=1e-9)


def test_weighted_neighbours_at_distance_zero_in_other_blocks(spark):
    df = spark.createDataFrame([(i, [float(i // 6), 1.0], float(i)) for i in range(60)], "i long, v array<double>, y double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["i"]: r["prediction"] for r in models.knn_predict(df, df, "v", "y", "i", 8, block=5, weights="distance").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: (sum(range(i // 6 * 6, i // 6 * 6 + 6)) - i) / 5 for i in range(60)}  # the five of equal vectors alone


def test_ranges_of_a_global_order_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(order, "RANGE_ROWS", 50)
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    kept = []
    checkpoint = order.checkpoint
    monkeypatch.setattr(order, "checkpoint", lambda d: kept.append(checkpoint(d)) or kept[-1])
    placed = order.global_index(df, "x").collect()
    assert sorted((r["x"], r["index"]) for r in placed) == [(i, i) for i in range(1000)]
    assert kept[0].rdd.getNumPartitions() == 20
    assert kept[0].groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 150


def test_model_search_reads_stored_columns(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 5), 2.0 * (i % 5), "k") for i in range(40)], "x double, y double, other string")
    read, train = [], models.train_model
    monkeypatch.setattr(models, "train_model", lambda d, *a: read.append((d.columns, len(d.inputFiles()) > 0)) or train(d, *a))
    assert models.model_search(df, df, ["x"], "y", {"linear": {"regParam": [0.0]}}, 1, 1, 1).count() == 1
    assert read == [(["x", "y"], True)]


def test_model_search_query_tries_every_point(spark, data, monkeypatch):
    class Mean:
        def transform(self, df):
            return df.withColumn("prediction", F.lit(1.0))

    tried = []
    monkeypatch.setattr(models, "train_model", lambda d, features, y, model, params: tried.append((model, params)) or Mean())
    found = analysis.QUERIES["model_search"](spark, data).collect()
    assert sorted(r["params"] for r in found) == sorted(repr(sorted(p.items())) for _, p in tried) and [r["trial"] for r in found] == list(range(len(found)))
    for m in ("linear", "boosted_trees"):
        mine = [p for name, p in tried if name == m]
        whole = math.prod(len({p[c] for p in mine}) for c in mine[0])
        assert whole == len({tuple(sorted(p.items())) for p in mine}) == len(mine) >= 20
        assert sum(r["round"] == 1 for r in found if r["model"] == m) == 20
    assert max(p["maxIter"] for m, p in tried if m == "boosted_trees") >= 20


@pytest.mark.parametrize("name", ["knn_weighted", "knn_predict"])
def test_knn_of_vectors_close_together_as_sql(spark, tmp_path, name):
    rng = np.random.default_rng(3)
    base = rng.random((6, 4))
    # groups of vectors that are 0 to 5e-9, or less than the 12 places that are kept, apart
    given = [(100 * g + i, [float(x) for x in base[g] + rng.random(4) * (3e-9 if g % 2 else 4e-13) * (i > 0)], int(rng.integers(0, 5))) for g in range(6) for i in range(9)]
    spark.createDataFrame(given, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = dict(duck.execute(analysis.ORACLES[name]).fetchall())
    assert {r["vec_id"]: r["prediction"] for r in analysis.QUERIES[name](spark, str(tmp_path)).collect()} == want and len(want) == 6


def test_explain_any_model(spark):
    x, y, df = _line_rows(spark, 60)
    fitted = models.train_model(df.dropna(), ["a", "b", "c"], "y")
    for model in (None, fitted):
        drop = {r["feature"]: r["mean_drop"] for r in models.permutation_importance(df, ["a", "b", "c"], "y", ["i"], 2, model=model).collect()}
        assert drop["a"] > drop["b"] > drop["c"] - 1e-3
        curves = models.ice_curves(df, ["a", "b", "c"], "y", "a", ["i"], 3, model=model)
        mean = {r["point"]: r["average"] for r in models.partial_dependence(df, ["a", "b", "c"], "y", "a", 3, model=model).collect()}
        own = {r["point"]: r["m"] for r in curves.groupBy("point").agg(F.avg("prediction").alias("m")).collect()}
        assert curves.count() == 180 and all(math.isclose(mean[p], own[p], rel_tol=1e-9) for p in (0, 1, 2))


def test_pipeline_saved_and_loaded(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 2.0)], "g string, y double")
    p = encode.FeaturePipeline("y", [("log_y", "log1p", ("y",))], ["g"], ["g"]).fit(rows)
    p.save(str(tmp_path / "p"))
    again = encode.FeaturePipeline.load(spark, str(tmp_path / "p"))
    new = spark.createDataFrame([("a", 2.0), ("z", 2.0), (None, 2.0)], "g string, y double")
    assert sorted(map(str, again.transform(new).collect())) == sorted(map(str, p.transform(new).collect()))
    with pytest.raises(ValueError):
        encode.FeaturePipeline("y").save(str(tmp_path / "q"))


def test_audited_canonicalize_reads_the_table_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(1, "a", "5"), (1, "a", "5"), (2, "b", "x"), (3, None, "7"), (4, "NA", "8"), (4, "NA", "8")]
    df = spark.createDataFrame(rows, "k long, s string, t string").mapInArrow(seen, "k long, s string, t string")
    lookup = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "key string, v int")
    cleaned, audit = clean.audited_canonicalize(df, "t", numbers={"t": "bigint"}, lookup=lookup, keys=("s", "key"), drop=("key", "k"))
    assert audit.collect() == audit.collect() and read.value == len(rows)
    one = audit.first().asDict()
    # "a" meets three rows, twice: six rows, two of them distinct; "x" is no number
    assert one == {"rows_before_join": 6, "duplicate_keys": 1, "rows_in": 10, "rows_out": 4, "dropped": 6, "duplicates": 5, "null_target": 1, "unexplained": 0, "columns_added": ["v"], "columns_dropped": ["k"]}
    assert sorted(map(tuple, cleaned.collect()), key=repr) == sorted([("a", 5, 1), ("a", 5, 2), (None, 7, None), (None, 8, None)], key=repr)
    none = clean.audited_canonicalize(df.limit(0), "t")[1].first()
    assert (none.rows_before_join, none.rows_in, none.rows_out, none.duplicate_keys, none.columns_added) == (0, 0, 0, 0, [])
    for wrong in ({"drop": ("z",)}, {"lookup": lookup}):
        with pytest.raises(ValueError):
            clean.audited_canonicalize(df, "t", **wrong)


def test_classifiers(spark):
    rows = [(i, float(i % 10), float(i % 3), "low" if i % 10 < 5 else "high") for i in range(200)]
    df = spark.createDataFrame([*rows, (200, None, 1.0, "low"), (201, 1.0, 1.0, None)], "i int, x double, z double, g string")
    for model in ("logistic", "random_forest_classifier", "boosted_trees_classifier"):
        fitted = models.train_model(df, ["x", "z"], "g", model)
        assert fitted.labels == ["high", "low"]
        scored = fitted.transform(df.filter("i < 200 or i = 200"))
        out = scored.withColumn("c", fitted.chance(scored, "low")).collect()
        assert len(out) == 200 and all(r["prediction"] == r["g"] and (r["c"] > 0.5) == (r["g"] == "low") for r in out)
        low = scored.select((F.col("g") == "low").cast("int").alias("y"), fitted.chance(scored, "low").alias("s"))
        assert one(models.binary_metrics(low, "y", "s", 1))["roc_auc"] == 1.0
        weights = {r["feature"]: r["importance"] for r in models.feature_importances(fitted, ["x", "z"], spark).collect()}
        assert weights["x"] > weights["z"]
        held = models.holdout_table(fitted, df.filter("i < 3"), "g", ["i"]).collect()
        assert sorted((r["i"], r["actual"], r["predicted"]) for r in held) == [(0, "low", "low"), (1, "low", "low"), (2, "low", "low")]
        assert one(models.kfold_cv(df, ["x", "z"], "g", ["i"], fold=F.floor(F.col("i") / 100), model=model)) == {"folds": 2, "accuracy": 1.0, "precision": 1.0, "recall": 1.0, "f1": 1.0}
    vote = models.train_model(df, ["x"], "g", "knn_classifier", {"k": 3})
    assert {r["prediction"] for r in vote.transform(df.filter("x = 9")).collect()} == {"high"}
    with pytest.raises(ValueError):
        vote.chance(vote.transform(df), "low")
    with pytest.raises(ValueError):
        models.feature_importances(vote, ["x"], spark)
    numbers = models.train_model(df.withColumn("n", F.when(F.col("g") == "low", 0).otherwise(1)), ["x"], "n", "logistic")
    assert {(r["g"], r["prediction"]) for r in numbers.transform(df.filter("i < 200")).collect()} == {("low", "0"), ("high", "1")}
    for bad in (df.filter("g = 'low'"), df.filter("i < 0")):
        with pytest.raises(ValueError):
            models.train_model(bad, ["x"], "g", "logistic")
    with pytest.raises(ValueError):
        models.train_model(df.withColumn("g", F.col("i").cast("string")), ["x"], "g", "random_forest_classifier")
    search = models.model_search(df, df, ["x"], "g", {"logistic": {"regParam": [0.0]}, "random_forest_classifier": {"maxDepth": [1, 2]}}, 1, 1, 1).collect()
    assert all(r["objective"] == 0 for r in search)


def test_classification_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), (None, "a"), ("a", None)], "y string, p string")
    got = one(models.classification_metrics(df, "y", "p", 6))
    assert got == {"accuracy": 0.5, "precision": round((1 + 1 / 3 + 0) / 3, 6), "recall": round((0.5 + 1 + 0) / 3, 6), "f1": round((2 / 3 + 0.5 + 0) / 3, 6)}
    assert one(models.classification_metrics(df.filter("y = 'z'"), "y", "p"))["accuracy"] is None


def test_folds_of_any_model(spark):
    x, y, df = _line_rows(spark, 120)
    fold = F.col("i") % 3
    by_sums = one(models.kfold_cv(df, ["a", "b"], "y", ["i"], fold=fold, digits=6))
    by_fits = one(models.kfold_cv(df, ["a", "b"], "y", ["i"], fold=fold, digits=6, params={"regParam": 0.0}))
    assert all(math.isclose(by_sums[c], by_fits[c], abs_tol=1e-5) for c in by_sums)
    one_way = models.rfe_curve(df, ["a", "b", "c"], "y", ["i"], fold=fold).collect()
    other = models.rfe_curve(df, ["a", "b", "c"], "y", ["i"], fold=fold, params={"regParam": 0.0}).collect()
    assert [(r["count"], r["dropped"], round(r["mae"], 6)) for r in one_way] == [(r["count"], r["dropped"], round(r["mae"], 6)) for r in other]
    step = df.withColumn("s", (F.col("a") > 0).cast("int"))
    got = one(models.kfold_cv(step, ["s"], "y", ["i"], fold=fold, digits=9, model="random_forest", params={"numTrees": 1, "maxDepth": 1, "bootstrap": False}))
    s, f, errors = x[:, 0] > 0, np.arange(len(y)) % 3, []
    for k in range(3):
        mean = np.where(s, y[s & (f != k)].mean(), y[~s & (f != k)].mean())
        errors.append(np.abs(y - mean)[f == k].mean())
    assert math.isclose(got["mae"], np.mean(errors), abs_tol=1e-8)
    curve = models.rfe_curve(df, ["a", "b", "c"], "y", ["i"], fold=fold, model="boosted_trees", params={"maxIter": 2}).collect()
    assert [r["count"] for r in curve] == [3, 2, 1] and curve[-1]["dropped"] == "a"
    assert one(models.kfold_cv(df, ["a"], "y", ["i"], fold=fold, model="knn", params={"k": 3}))["folds"] == 3
    with pytest.raises(ValueError):
        models.rfe_curve(df, ["a"], "y", ["i"], model="knn")
    with pytest.raises(ValueError):
        models.kfold_cv(df, ["a"], "y", ["i"], fold=F.lit(1), model="random_forest")


def _few_cells(spark, monkeypatch):
    """(rows of 12 different features and their frame, sizes of what is fitted on)."""
    rng = np.random.default_rng(8)
    rows = [(int(a), float(b), float(a * b + rng.normal())) for a, b in zip(rng.integers(0, 4, 600), rng.integers(0, 3, 600))]
    sizes, plain = [], models._fit_pipeline
    monkeypatch.setattr(models, "_fit_pipeline", lambda df, *a: sizes.append(df.count()) or plain(df, *a))
    return rows, spark.createDataFrame([*rows, (None, 1.0, 1.0), (1, 1.0, None)], "a int, b double, y double"), sizes


def test_forest_is_fitted_on_cells(spark, monkeypatch):
    rows, df, sizes = _few_cells(spark, monkeypatch)
    forest = models.train_model(df, ["a", "b"], "y", "random_forest", {"numTrees": 40, "maxDepth": 6, "featureSubsetStrategy": "all"})
    assert len(sizes) == 40 and max(sizes) <= 12
    got = {(r["a"], r["b"]): r["prediction"] for r in forest.transform(df.filter("y is not null and a is not null")).collect()}
    means = {c: np.mean([y for a, b, y in rows if (a, b) == c]) for c in got}
    assert len(got) == 12 and all(0 < abs(got[c] - means[c]) < 0.2 for c in got)  # rows were drawn, not cells
    weights = {r["feature"]: r["importance"] for r in models.feature_importances(forest, ["a", "b"], spark).collect()}
    assert math.isclose(sum(weights.values()), 1) and min(weights.values()) > 0.1
    u = spark.range(20000).select(F.rand(3).alias("u")).select(models._poisson(F.col("u"), 1.0).alias("n"))
    drawn = u.agg(F.avg("n").alias("m"), F.var_samp("n").alias("v")).first()
    assert abs(drawn["m"] - 1) < 0.05 and abs(drawn["v"] - 1) < 0.1
    sizes.clear()
    models.train_model(df, ["a", "b"], "y", "random_forest", {"numTrees": 2, "minInstancesPerNode": 5})
    assert sizes[0] > 600  # rows count here


def test_boosted_trees_are_fitted_on_cells(spark, monkeypatch):
    rows, df, sizes = _few_cells(spark, monkeypatch)
    params = {"maxIter": 4, "maxDepth": 2}
    by_cells = models.train_model(df, ["a", "b"], "y", "boosted_trees", params)
    assert sizes == [12]
    by_rows = models._fit_pipeline(df.dropna(), ["a", "b"], "y", "boosted_trees", params)
    same = [{(r["a"], r["b"]): round(r["prediction"], 9) for r in m.transform(df.dropna()).collect()} for m in (by_cells, by_rows)]
    assert same[0] == same[1]
    assert [round(v, 6) for v in models._importances(by_cells)] == [round(v, 6) for v in models._importances(by_rows)]


def test_folds_of_a_tree_are_fitted_on_cells(spark, monkeypatch):
    rows, df, sizes = _few_cells(spark, monkeypatch)
    placed = df.dropna().withColumn("i", F.monotonically_increasing_id())
    params = {"numTrees": 1, "maxDepth": 5, "bootstrap": False}
    got = one(models.kfold_cv(placed, ["a", "b"], "y", ["i"], fold=F.pmod("i", F.lit(2)), model="random_forest", params=params, digits=9))
    assert len(sizes) == 2 and max(sizes) <= 12
    given, errors = [(r["a"], r["b"], r["y"], r["i"] % 2) for r in placed.collect()], []
    for f in (0, 1):
        mean = {c: np.mean([y for a, b, y, g in given if g != f and (a, b) == c]) for c in {x[:2] for x in given}}
        errors.append(np.mean([abs(y - mean[a, b]) for a, b, y, g in given if g == f]))
    assert math.isclose(got["mae"], np.mean(errors), abs_tol=1e-8)


def test_log_skews_of_positive_groups(spark):
    given = [("a", v) for v in (1.0, 2.0, 9.0, None)] + [("zero", v) for v in (0.0, 1.0, 5.0)] + [("same", 2.0)] * 3 + [(None, 1.0), (None, 2.0)]
    got = profile.log_skews(spark.createDataFrame(given, "g string, v double"), "g", "v").collect()
    x = np.array([1.0, 2.0, 9.0])
    skew = lambda v: ((v - v.mean()) ** 3).mean() / v.std() ** 3
    assert [(r["g"], r["n"], round(r["skew"], 9), round(r["log_skew"], 9)) for r in got] == [("a", 3, round(skew(x), 9), round(skew(np.log(x)), 9))]


def test_log_choice_and_ranked_metrics(spark):
    df = spark.createDataFrame([(float(v), float(v) - 2, 5.0, None) for v in (1, 1, 1, 1, 40)], "a double, b double, c double, d double")
    got = {r["column"]: (r["n"], r["show_log"]) for r in profile.log_choice(df, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": (5, True), "b": (5, False), "c": (5, False), "d": (0, False)}
    ranked = profile.ranked_metrics(profile.numeric_diagnostics(df, ["a", "b", "c", "d"])).filter("metric = 'skew'").orderBy("rank").collect()
    assert [(r["column"], r["exceeds"]) for r in ranked][:2] == [("a", True), ("b", True)]


def test_quotas_of_many_groups(spark):
    from plumbline.functions.order import quotas

    n = [(f"g{i:04d}", i % 7 + 1) for i in range(500)] + [(None, 3)]
    got = {r["g"]: r["quota"] for r in quotas(spark.createDataFrame(n, "g string, n long"), 300, "g").collect()}
    whole = sum(k for _, k in n)
    share = {g: k * 300 / whole for g, k in n}
    rest = sorted(share, key=lambda g: (-round(share[g] - math.floor(share[g]), 9), g is not None, g or ""))
    lucky = set(rest[: 300 - sum(math.floor(v) for v in share.values())])
    assert got == {g: math.floor(v) + (g in lucky) for g, v in share.items()} and sum(got.values()) == 300
    assert quotas(spark.createDataFrame([], "g string, n long"), 5, "g").count() == 0


def test_pairs_of_many_groups(spark):
    rows = spark.range(600).selectExpr("concat('g', cast(id % 60 as string)) as g", "cast(id as double) as y")
    out = compare.pairs(rows, "g", "y")
    assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().toString()
    met = [(r["group_a"], r["group_b"]) for r in out.collect()]
    names = sorted(f"g{i}" for i in range(60))
    assert sorted(met) == [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def test_distinct_counts_and_sketches(spark):
    df = spark.range(40000).selectExpr("id", "cast(id % 7 as double) as few", "if(id % 2 = 0, null, concat('t', cast(id as string))) as text", "cast(null as int) as none", "id % 2 = 0 as even")
    out = profile.distinct_counts(df)
    assert "Expand" not in out._jdf.queryExecution().toString()
    assert "gid" not in profile.profile(df)._jdf.queryExecution().toString()  # the one row of results is turned, no others
    exact = {r["column"]: r["distinct_count"] for r in out.collect()}
    assert exact == {"id": 40000, "few": 7, "text": 20000, "none": 0, "even": 2}
    kept = profile.sketch_columns(df.filter("id < 25000")).union(profile.sketch_columns(df.filter("id >= 20000"))).union(profile.sketch_columns(df.filter("id < 0")))
    got = {r["column"]: r for r in profile.merged_profile(kept).collect()}
    want = {r["column"]: r for r in profile.profile(df.union(df.filter("id >= 20000 and id < 25000"))).collect()}
    for c, n in exact.items():
        assert abs(got[c]["distinct_count"] - n) <= 0.03 * n
        assert all(got[c][k] == want[c][k] for k in ("dtype", "nulls", "min_value", "max_value"))
    assert {r["column"]: r["distinct_count"] for r in profile.profile(df.filter("id < 0")).collect()} == dict.fromkeys(exact, 0)


def test_committed_sample(spark, tmp_path):
    from plumbline.sources import tables

    rows, folder, want = spark.range(50).selectExpr("id", "id * 2 as y"), str(tmp_path), {"size": 50, "seed": 1}
    with pytest.raises(ValueError):
        tables.committed_sample(spark, folder, "s", 1)
    rows.limit(3).write.parquet(f"{folder}/s@1/rows-lost")  # a run that ended before its manifest
    with pytest.raises(ValueError):
        tables.committed_sample(spark, folder, "s", 1)
    tables.commit_sample(rows, folder, "s", 1, want)
    kept, manifest = tables.committed_sample(spark, folder, "s", 1)
    assert kept.count() == manifest["rows"] == 50
    with pytest.raises(ValueError):
        tables.commit_sample(rows, folder, "s", 1, want)
    ok = lambda d: {r["check"]: r["ok"] for r in checks.validate_committed(spark, folder, "s", 1, d).collect()}
    assert all(ok({"seed": 1, "size": 50}).values())
    assert [c for c, v in ok({"size": 50, "seed": 2}).items() if not v] == ["definition"]
    rows.limit(1).write.mode("append").parquet(manifest["data"])
    assert {c for c, v in ok(want).items() if not v} == {"rows", "digest"}
    tables.commit_sample(rows.limit(0), folder, "s", 2, want)
    assert tables.committed_sample(spark, folder, "s", 2)[1]["rows"] == 0
