"""Queries on groups, features, encodings, samples, tests, regression, models and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as fx
from ..functions.filters import FilterSpec
from ..functions.order import new_path
from ..operators import compare, encode, graph, groups, models, profile, regress, sample
from ..sources import tables
from .tables import ORACLES, QUERIES, query, rounded, table

__all__ = ["ORACLES", "QUERIES"]

# ---- groups ----

_SEGMENTS = ["BUILDING", "MACHINERY", "HOUSEHOLD", "NONE"]


@query("""
    WITH t AS (SELECT count(*) AS total FROM customer), s AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd FROM customer GROUP BY 1),
    r AS (SELECT unnest(['BUILDING', 'MACHINERY', 'HOUSEHOLD', 'NONE']) AS g), j AS (SELECT r.g, coalesce(n, 0) AS n, m, sd FROM r LEFT JOIN s USING (g))
    SELECT g AS "group", n, round(m, 4) AS mean, round(sd, 4) AS std, round(n / total, 6) AS proportion, n = 0 AS absent,
           (SELECT CASE WHEN count(*) < 2 THEN 0.0 ELSE round(max(n) / min(n), 4) END FROM j WHERE n > 0) AS imbalance_ratio FROM j, t
""")
def group_describe(spark, d):
    out = groups.group_describe(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", _SEGMENTS)
    return rounded(rounded(out, "mean", "std", digits=4), "proportion")


@query("""
    SELECT count(*) AS n_total, count(*) FILTER (g IN ('BUILDING', 'MACHINERY') AND y IS NOT NULL) AS n_used,
           count(*) - count(*) FILTER (g IN ('BUILDING', 'MACHINERY') AND y IS NOT NULL) AS excluded, count(*) FILTER (g IS NULL) AS null_group,
           count(*) FILTER (g IN ('BUILDING', 'MACHINERY') AND y IS NULL) AS null_target, count(*) FILTER (g NOT IN ('BUILDING', 'MACHINERY')) AS unlisted
    FROM (SELECT CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS g, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS y FROM customer)
""")
def attrition(spark, d):
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("g"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("y"))
    return groups.attrition(c, "g", "y", ["BUILDING", "MACHINERY"])


@query("SELECT round(max(n) / min(n), 6) AS imbalance FROM (SELECT count(*) AS n FROM events GROUP BY event_type)")
def group_imbalance(spark, d):
    return rounded(groups.group_imbalance(table(spark, d, "events"), "event_type"), "imbalance")


@query("SELECT round(max(m) - min(m), 4) AS value FROM (SELECT avg(o_totalprice) AS m FROM orders GROUP BY o_orderpriority)")
def baseline_group_range(spark, d):
    return rounded(groups.baseline_group_range(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), "value", digits=4)


@query("""
    WITH s AS (SELECT avg(o_totalprice) AS mean, quantile_cont(o_totalprice, 0.5) AS median FROM orders)
    SELECT round(mean, 2) AS mean, round(median, 2) AS median, round(avg(abs(o_totalprice - mean)), 2) AS mae_mean, round(avg(abs(o_totalprice - median)), 2) AS mae_median FROM orders, s GROUP BY s.mean, s.median
""")
def baseline_regression(spark, d):
    return rounded(groups.baseline_regression(table(spark, d, "orders"), "o_totalprice"), "mean", "median", "mae_mean", "mae_median", digits=2)


@query("SELECT o_orderpriority AS label, n AS support, round(n / (SELECT count(*) FROM orders), 6) AS accuracy FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)")
def baseline_majority(spark, d):
    return rounded(groups.baseline_majority(table(spark, d, "orders"), "o_orderpriority"), "accuracy")


@query("""
    WITH s AS (SELECT avg(abs(o_totalprice - m)) AS b FROM orders, (SELECT avg(o_totalprice) AS m FROM orders)),
    g AS (SELECT avg(abs(o_totalprice - m)) AS c FROM orders JOIN (SELECT o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY 1) USING (o_orderstatus))
    SELECT round((b - c) / b, 6) AS improvement FROM s, g
""")
def baseline_improvement(spark, d):
    o = table(spark, d, "orders")
    base = groups.baseline_regression(o, "o_totalprice").select(F.col("mae_mean").alias("b"))
    means = groups.group_stats(o, "o_orderstatus", "o_totalprice").select("group", "mean")
    cand = o.join(F.broadcast(means), F.col("o_orderstatus") == F.col("group")).agg(F.avg(F.abs(F.col("o_totalprice") - F.col("mean"))).alias("c"))
    return rounded(groups.improvement(base.join(F.broadcast(cand)), "b", "c").select("improvement"), "improvement")


_MZ = "WITH m AS (SELECT quantile_cont({c}, 0.5) AS med FROM {t}), s AS (SELECT quantile_cont(abs({c} - med), 0.5) AS mad FROM {t}, m)"


@query(f"{_MZ.format(c='c_acctbal', t='customer')} SELECT c_custkey, round(0.6745 * (c_acctbal - med) / mad, 6) AS c_acctbal_mz FROM customer, m, s")
def modified_zscore(spark, d):
    return rounded(groups.modified_zscores(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), "c_acctbal_mz").drop("c_acctbal")


@query(f"{_MZ.format(c='value', t='events')} SELECT event_id, abs(0.6745 * (value - med) / mad) > 3.5 AS outlier FROM events, m, s")
def outlier_mask(spark, d):
    return groups.outlier_mask(table(spark, d, "events").select("event_id", "value"), ["value"], 3.5).select("event_id", "outlier")


@query("WITH q AS (SELECT quantile_cont(value, 0.9) AS cap FROM events) SELECT event_id, round(least(value, cap), 6) AS value FROM events, q")
def winsorize(spark, d):
    return rounded(groups.winsorize(table(spark, d, "events").select("event_id", "value"), ["value"], 0.9), "value")


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def distinct_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


# ---- features ----


@query("SELECT event_id, CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS weekday, CAST(month(ts) AS BIGINT) AS month FROM events")
def dt_parts(spark, d):
    return table(spark, d, "events").select("event_id", fx.hour("ts").alias("hour"), fx.weekday("ts").alias("weekday"), fx.month("ts").alias("month"))


@query("SELECT event_id, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend, CAST(hour(ts) < 6 OR hour(ts) > 20 AS BIGINT) AS is_night, CAST(hour(ts) IN (7, 8, 9, 17, 18, 19) AS BIGINT) AS rush FROM events")
def dt_flags(spark, d):
    return table(spark, d, "events").select("event_id", fx.is_weekend("ts").alias("is_weekend"), fx.is_night("ts").alias("is_night"), fx.in_hours("ts").alias("rush"))


@query("SELECT l_orderkey, l_linenumber, round(datediff('microsecond', o_orderdate, l_shipdate) / 60000000.0, 6) AS minutes FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def duration_minutes(spark, d):
    met = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select("l_orderkey", "l_linenumber", F.round(fx.duration_minutes("o_orderdate", "l_shipdate"), 6).alias("minutes"))


@query("SELECT event_id, CASE WHEN hour(ts) >= 6 AND hour(ts) < 10 THEN 'morning' WHEN hour(ts) >= 16 AND hour(ts) < 20 THEN 'evening' ELSE 'other' END AS bucket FROM events")
def time_bucket(spark, d):
    return table(spark, d, "events").select("event_id", fx.time_bucket("ts", {"morning": (6, 10), "evening": (16, 20)}, "other").alias("bucket"))


@query("SELECT l_orderkey, l_linenumber, round(ln(1 + l_extendedprice), 8) AS log_price FROM lineitem")
def log1p(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(fx.log1p("l_extendedprice"), 8).alias("log_price"))


@query("SELECT l_orderkey, l_linenumber, CAST(c_nationkey = s_nationkey AS BIGINT) AS same FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey")
def same_group(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    met = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return met.select("l_orderkey", "l_linenumber", fx.same_group("c_nationkey", "s_nationkey").alias("same"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity % 7 / 60, 0), 4) AS rate FROM lineitem")
def rate_per_hour(spark, d):
    li = table(spark, d, "lineitem").withColumn("minutes", F.col("l_quantity") % 7)
    return li.select("l_orderkey", "l_linenumber", F.round(fx.rate_per_hour("l_extendedprice", "minutes"), 4).alias("rate"))


@query("SELECT event_id, CAST(hour(ts) AS BIGINT) AS h, round(ln(1 + value), 8) AS lv, value AS v2 FROM events")
def build_derived(spark, d):
    out = fx.build_derived(table(spark, d, "events"), [("h", "hour", ("ts",)), ("lv", "log1p", ("value",)), ("v2", "copy", ("value",))])
    return rounded(out.select("event_id", "h", "lv", "v2"), "lv", digits=8)


# ---- encodings ----

_TRAIN = "(SELECT * FROM orders WHERE o_orderkey % 3 <> 0)"
_ALL = "(SELECT o_orderkey, o_totalprice, o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN 'unseen' ELSE o_orderpriority END AS o_orderpriority FROM orders)"


def _orders(spark, d):
    o = table(spark, d, "orders")
    changed = o.select("o_orderkey", "o_totalprice", "o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "unseen").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return o.filter("o_orderkey % 3 <> 0"), changed


@query(f"""
    WITH g AS (SELECT avg(o_totalprice) AS g FROM {_TRAIN}), s AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m FROM {_TRAIN} GROUP BY 1)
    SELECT o_orderkey, round(coalesce((n * m + 20 * g) / (n + 20), g), 4) AS o_orderpriority_target_enc FROM {_ALL} a CROSS JOIN g LEFT JOIN s USING (o_orderpriority)
""")
def target_encode(spark, d):
    train, df = _orders(spark, d)
    return rounded(encode.target_encode(train, df, ["o_orderpriority"], "o_totalprice", 20.0), "o_orderpriority_target_enc", digits=4).select("o_orderkey", "o_orderpriority_target_enc")


@query(f"""
    WITH s AS (SELECT o_orderpriority, count(*) / (SELECT count(*) FROM {_TRAIN}) AS f FROM {_TRAIN} GROUP BY 1)
    SELECT o_orderkey, round(coalesce(f, -1.0), 8) AS o_orderpriority_freq_enc FROM {_ALL} a LEFT JOIN s USING (o_orderpriority)
""")
def freq_encode(spark, d):
    train, df = _orders(spark, d)
    return rounded(encode.freq_encode(train, df, "o_orderpriority"), "o_orderpriority_freq_enc", digits=8).select("o_orderkey", "o_orderpriority_freq_enc")


@query(f"""
    WITH s AS (SELECT o_orderpriority, o_orderstatus, CAST(count(*) AS INTEGER) AS n FROM {_TRAIN} GROUP BY ALL)
    SELECT o_orderkey, coalesce(n, 0) AS pair_count FROM {_ALL} a LEFT JOIN s USING (o_orderpriority, o_orderstatus)
""")
def count_encode(spark, d):
    train, df = _orders(spark, d)
    return encode.count_encode(train, df, ["o_orderpriority", "o_orderstatus"], 0, "pair_count").select("o_orderkey", "pair_count")


@query(f"""
    WITH g AS (SELECT avg(o_totalprice) AS g FROM {_TRAIN}), s AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, avg(o_totalprice) AS m FROM {_TRAIN} GROUP BY ALL)
    SELECT o_orderkey, round(coalesce((n * m + 10 * g) / (n + 10), g), 4) AS pair_mean FROM {_ALL} a CROSS JOIN g LEFT JOIN s USING (o_orderpriority, o_orderstatus)
""")
def target_encode_multi(spark, d):
    train, df = _orders(spark, d)
    return rounded(encode.target_encode(train, df, ["o_orderpriority", "o_orderstatus"], "o_totalprice", 10.0, "pair_mean"), "pair_mean", digits=4).select("o_orderkey", "pair_mean")


@query(f"""
    WITH g AS (SELECT avg(o_totalprice) AS g FROM {_TRAIN}), s AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, count(*) / (SELECT count(*) FROM {_TRAIN}) AS f FROM {_TRAIN} GROUP BY 1)
    SELECT o_orderkey, round(ln(1 + o_totalprice), 8) AS log_total, round(coalesce(f, -1.0), 8) AS o_orderpriority_freq_enc,
           round(coalesce((n * m + 20 * g) / (n + 20), g), 4) AS o_orderpriority_target_enc
    FROM {_ALL} a CROSS JOIN g LEFT JOIN s USING (o_orderpriority)
""")
def feature_pipeline(spark, d):
    train, df = _orders(spark, d)
    p = encode.FeaturePipeline("o_totalprice", [("log_total", "log1p", ("o_totalprice",))], ["o_orderpriority"], ["o_orderpriority"]).fit(train)
    out = p.transform(df).select("o_orderkey", "log_total", "o_orderpriority_freq_enc", "o_orderpriority_target_enc")
    return rounded(rounded(out, "log_total", "o_orderpriority_freq_enc", digits=8), "o_orderpriority_target_enc", digits=4)


@query("SELECT 'o_orderdate' AS \"column\", unnest(['hour', 'weekday', 'month']) AS feature UNION ALL SELECT 'o_orderpriority', unnest(['target_enc', 'freq_enc'])")
def auto_features(spark, d):
    return encode.auto_features(profile.infer_columns(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")), "o_totalprice")


# ---- samples ----

_KEYS = ["l_orderkey", "l_linenumber"]


@query("SELECT 'val' AS part, CAST(ceil(count(*) * 0.2) AS BIGINT) AS n FROM lineitem UNION ALL SELECT 'train', count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) FROM lineitem")
def split_random(spark, d):
    return sample.split_random(table(spark, d, "lineitem").select(*_KEYS), 0.2, _KEYS, 1).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= floor(count(*) OVER () * 0.7) THEN 'train' ELSE 'val' END AS part FROM events")
def split_time(spark, d):
    return sample.split_time(table(spark, d, "events").select("event_id", "ts"), 0.3, "ts", ["event_id"]).select("event_id", "part")


_PARTS = " UNION ALL ".join(f"SELECT '{m}' AS method, unnest(['val', 'train']) AS part, unnest([v, n - v]) AS n FROM (SELECT count(*) AS n, CAST({v} AS BIGINT) AS v FROM events)" for m, v in (("random", "ceil(count(*) * 0.3)"), ("time", "count(*) - floor(count(*) * 0.7)"), ("stratified", "ceil(count(*) * 0.3)")))


@query(_PARTS)
def split_methods(spark, d):
    """Sizes of the parts by each way of splitting."""
    e = table(spark, d, "events").select("event_id", "ts", "event_type")
    found = [sample.split(e, 0.3, ["event_id"], m, 5, "ts", "event_type").groupBy("part").agg(F.count("*").alias("n")).select(F.lit(m).alias("method"), "part", "n") for m in ("random", "time", "stratified")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT event_id, value, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= floor(count(*) OVER () * 0.7) THEN 'train' ELSE 'val' END AS part FROM events")
def written_splits(spark, d):
    """Training and validation rows, written as Parquet and read back."""
    parts = sample.split(table(spark, d, "events").select("event_id", "ts", "value"), 0.3, ["event_id"], "time", time="ts")
    folder, back = new_path(spark, "splits"), []
    for part in ("train", "val"):
        path = f"{folder}/{part}.parquet"
        tables.write_table(parts.filter(F.col("part") == part).select("event_id", "value"), path)
        back.append(spark.read.parquet(path).withColumn("part", F.lit(part)))
    return back[0].unionByName(back[1])


_QUOTA = """
    WITH g AS (SELECT {c}, count(*) AS n FROM {t} GROUP BY 1), w AS (SELECT *, {total} AS total, n * {total} / sum(n) OVER () AS share FROM g),
    f AS (SELECT *, floor(share) AS fl, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, {c}) AS r, total - sum(floor(share)) OVER () AS rest FROM w)
    SELECT {c}, CAST(fl + CASE WHEN r <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f
"""


@query(_QUOTA.format(c="o_orderstatus", t="orders", total="(SELECT ceil(count(*) * 0.25) FROM orders)"))
def split_stratified(spark, d):
    out = sample.split_stratified(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), 0.25, "o_orderstatus", ["o_orderkey"], 3)
    return out.filter("part = 'val'").groupBy("o_orderstatus").agg(F.count("*").alias("quota"))


@query("SELECT event_type, least(50, count(*)) AS n FROM events GROUP BY 1")
def sample_per_group(spark, d):
    return sample.sample_per_group(table(spark, d, "events"), "event_type", 50, ["event_id"], 5).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(round_even(count(*) * 0.1, 0) AS BIGINT) AS n FROM events GROUP BY 1")
def sample_frac(spark, d):
    return sample.sample_frac(table(spark, d, "events"), "event_type", 0.1, ["event_id"], 5).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, (SELECT min(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type)) AS n FROM events GROUP BY 1")
def sample_balanced(spark, d):
    return sample.sample_balanced(table(spark, d, "events"), "event_type", ["event_id"], 5).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""
    WITH e AS (SELECT event_id, hour(ts) AS at_hour, month(ts) AS at_month, isodow(ts) - 1 AS at_weekday, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS weekend, ln(1 + value) AS log_value, user_id AS who FROM events)
    SELECT event_id, CAST(at_hour AS BIGINT) AS at_hour, CAST(at_month AS BIGINT) AS at_month, CAST(at_weekday AS BIGINT) AS at_weekday, CAST(weekend AS BIGINT) AS weekend, round(log_value, 6) AS log_value, who
    FROM e WHERE log_value > 3 AND NOT (weekend = 1 AND at_hour < 12)
""")
def derived_sample(spark, d):
    derived = [("at_hour", "hour", ("ts",)), ("at_month", "month", ("ts",)), ("at_weekday", "weekday", ("ts",)), ("weekend", "is_weekend", ("ts",)), ("log_value", "log1p", ("value",)), ("who", "copy", ("user_id",))]
    morning = [FilterSpec("weekend", "==", 1), FilterSpec("at_hour", "<", 12)]
    out = sample.named_sample(table(spark, d, "events"), ["event_id", "user_id", "ts", "value"], None, ["event_id"], 0, derived, [FilterSpec("log_value", ">", 3)], [morning])
    return rounded(out.select("event_id", *[n for n, _, _ in derived]), "log_value")


@query()
def named_sample(spark, d):
    return sample.named_sample(table(spark, d, "lineitem"), [*_KEYS, "l_quantity", "l_extendedprice"], 1000, _KEYS, 11, [("log_price", "log1p", ("l_extendedprice",))], [FilterSpec("l_quantity", ">", 2)], [[FilterSpec("l_quantity", ">=", 45), FilterSpec("l_extendedprice", "<", 5000)]])


@query("WITH t AS (SELECT count(*) AS n FROM customer), r AS (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rank FROM customer) SELECT rank FROM r, t WHERE floor(ceil((rank - 1) / ((n - 1) / 99.0)) * ((n - 1) / 99.0)) = rank - 1")
def thin_ranks(spark, d):
    return profile.thin(profile.ranked_positions(table(spark, d, "customer"), "c_acctbal", ["c_custkey"]), 100).select("rank")


@query("SELECT 100 AS treated, count(*) - 100 AS control FROM customer")
def assign_random(spark, d):
    out = sample.assign_random(table(spark, d, "customer").select("c_custkey"), 100, ["c_custkey"], 2)
    return out.agg(F.count_if(F.col("treated") == 1).alias("treated"), F.count_if(F.col("treated") == 0).alias("control"))


@query(_QUOTA.format(c="c_mktsegment", t="customer", total="100"))
def assign_stratified(spark, d):
    out = sample.assign_stratified(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", 100, ["c_custkey"], 2)
    return out.groupBy("c_mktsegment").agg(F.sum("treated").cast("long").alias("quota"))


# ---- tests ----

_GROUPS = "g AS (SELECT {g} AS g, count(*) AS n, avg({y}) AS m, var_samp({y}) AS v FROM {t} GROUP BY 1)"
_EVENTS = _GROUPS.format(g="event_type", y="value", t="events")
_F_PARTS = "gm AS (SELECT sum(n * m) / sum(n) AS gm FROM {g}), s AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * pow(m - gm, 2)) AS ssb, sum((n - 1) * v) AS ssw FROM {g}, gm), f AS (SELECT *, CAST(k - 1 AS DOUBLE) AS df1, CAST(n - k AS DOUBLE) AS df2, (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM s)"
_F = _F_PARTS.format(g="g")
_EFFECTS = "round(greatest(0, least(1, df1 * f / (df1 * f + df2))), 6) AS eta_squared, round(greatest(0, least(1, df1 * (f - 1) / (df1 * (f - 1) + n))), 6) AS omega_squared"


@query(f"""
    WITH {_GROUPS.format(g='c_mktsegment', y='o_totalprice', t='orders JOIN customer ON o_custkey = c_custkey')}, {_F}
    SELECT k, n, round(f, 6) AS statistic, df1, df2, {_EFFECTS} FROM f
""")
def anova(spark, d):
    """Does the order value differ between market segments?"""
    from ..operators.clean import drop_null_target
    from ..operators.joins import lookup_join

    met = lookup_join(table(spark, d, "orders").select("o_custkey", "o_totalprice"), table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "o_custkey", "c_custkey")
    out = compare.anova(drop_null_target(met, "o_totalprice"), "c_mktsegment", "o_totalprice")
    return rounded(out.drop("p_value", "passed"), "statistic", "eta_squared", "omega_squared")


@query(f"WITH {_EVENTS}, w AS (SELECT min(n) AS lo, max(n) AS hi FROM g) SELECT unnest(list_filter([CASE WHEN lo < 30 THEN 'small group' END, CASE WHEN hi / lo > 1.5 THEN 'imbalance' END], lambda x: x IS NOT NULL)) AS warning FROM w")
def anova_warnings(spark, d):
    return compare.anova_warnings(table(spark, d, "events"), "event_type", "value")


@query(f"""
    WITH {_EVENTS}, w AS (SELECT *, n / v AS w, sum(n / v) OVER () AS sw, sum(n / v * m) OVER () / sum(n / v) OVER () AS mm FROM g),
    s AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(w * pow(m - mm, 2)) AS b, sum(pow(1 - w / sw, 2) / (n - 1)) AS l FROM w),
    f AS (SELECT k, n, CAST(k - 1 AS DOUBLE) AS df1, (k * k - 1) / (3 * l) AS df2, b / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * l) AS f FROM s)
    SELECT k, n, round(f, 5) AS statistic, df1, round(df2, 3) AS df2, round(greatest(0, df1 * f / (df1 * f + floor(df2))), 6) AS eta_squared, round(greatest(0, df1 * (f - 1) / (df1 * (f - 1) + n)), 6) AS omega_squared FROM f
""")
def welch_anova(spark, d):
    out = compare.welch_anova(table(spark, d, "events"), "event_type", "value").drop("p_value", "passed")
    return rounded(rounded(rounded(out, "statistic", digits=5), "df2", digits=3), "eta_squared", "omega_squared")


@query("""
    WITH r AS (SELECT event_type, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS r FROM events),
    t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*) AS c FROM events GROUP BY value)),
    g AS (SELECT event_type, count(*) AS n, sum(r) AS s FROM r GROUP BY 1),
    h AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(s * s / n) AS q FROM g),
    f AS (SELECT k, n, (12 / (CAST(n AS DOUBLE) * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (pow(CAST(n AS DOUBLE), 3) - n)) AS h FROM h, t)
    SELECT k, n, round(h, 4) AS statistic, CAST(k - 1 AS DOUBLE) AS df1, round(greatest(0, least(1, (h - k + 1) / (n - k))), 6) AS epsilon_squared FROM f
""")
def kruskal(spark, d):
    out = compare.kruskal(table(spark, d, "events"), "event_type", "value").drop("p_value", "passed")
    return rounded(rounded(out, "statistic", digits=4), "epsilon_squared")


@query(f"WITH {_EVENTS}, {_F} SELECT n, round(f, 6) AS statistic, df1, df2, {_EFFECTS} FROM f")
def effect_sizes(spark, d):
    one = compare._anova_row(groups.group_stats(table(spark, d, "events"), "event_type", "value")).select("n", "statistic", "df1", "df2")
    return rounded(compare.effect_sizes(one), "statistic", "eta_squared", "omega_squared")


_PAIR = "a JOIN g b ON a.g < b.g"
_D = "(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2))"


@query(f"WITH {_EVENTS} SELECT a.g AS group_a, b.g AS group_b, round({_D}, 6) AS d, round({_D} * (1 - 3 / (4 * (a.n + b.n) - 9)), 6) AS g FROM g {_PAIR}")
def cohens_d(spark, d):
    return rounded(compare.cohens_d(table(spark, d, "events"), "event_type", "value"), "d", "g")


@query(f"""
    WITH md AS (SELECT event_type, quantile_cont(value, 0.5) AS md FROM events GROUP BY 1),
    g AS (SELECT event_type AS g, count(*) AS n, avg(abs(value - md)) AS m, var_samp(abs(value - md)) AS v FROM events JOIN md USING (event_type) GROUP BY 1), {_F}
    SELECT k, n, round(f, 5) AS statistic, df1, df2 FROM f
""")
def levene(spark, d):
    return rounded(compare.levene(table(spark, d, "events"), "event_type", "value").drop("p_value", "passed"), "statistic", digits=5)


_SHAPE = "SELECT {g} AS g, count(*) AS n, avg(pow(({y} - m) / s, 3)) AS skew, avg(pow(({y} - m) / s, 4)) - 3 AS kurtosis FROM {t} JOIN (SELECT {g}, avg({y}) AS m, stddev_pop({y}) AS s FROM {t} GROUP BY 1) USING ({g}) GROUP BY 1"


@query(f"SELECT g AS \"group\", n, round(skew, 4) AS skew, round(kurtosis, 4) AS kurtosis, round(n / 6 * (skew * skew + kurtosis * kurtosis / 4), 2) AS jarque_bera, round(exp(-n / 12 * (skew * skew + kurtosis * kurtosis / 4)), 6) AS p_value FROM ({_SHAPE.format(g='c_mktsegment', y='c_acctbal', t='customer')})")
def normality(spark, d):
    out = compare.normality(table(spark, d, "customer"), "c_mktsegment", "c_acctbal")
    return rounded(rounded(rounded(out, "skew", "kurtosis", digits=4), "jarque_bera", digits=2), "p_value")


_VA = "(a.v / a.n + b.v / b.n)"


@query(f"""
    WITH {_EVENTS} SELECT a.g AS group_a, b.g AS group_b, round(a.m - b.m, 6) AS diff, round(sqrt({_VA}), 6) AS se, round((a.m - b.m) / sqrt({_VA}), 5) AS t,
    round(pow({_VA}, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 3) AS df, round({_D} * (1 - 3 / (4 * (a.n + b.n) - 9)), 6) AS g,
    CASE WHEN least(a.n, b.n) < 30 THEN 'use hedges_g' ELSE '' END AS note FROM g {_PAIR}
""")
def games_howell(spark, d):
    out = compare.games_howell(table(spark, d, "events"), "event_type", "value").drop("p_value")
    return rounded(rounded(rounded(out, "diff", "se", "g"), "t", digits=5), "df", digits=3)


@query(f"""
    WITH {_GROUPS.format(g='o_orderstatus', y='o_totalprice', t='orders')}
    SELECT round(a.m - b.m, 4) AS diff, round((a.m - b.m) / sqrt({_VA}), 5) AS t, round(pow({_VA}, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 3) AS df, round({_D}, 6) AS d
    FROM g a, g b WHERE a.g = 'O' AND b.g = 'F'
""")
def welch_ttest(spark, d):
    out = compare.welch_ttest(table(spark, d, "orders"), "o_orderstatus", "o_totalprice", "O", "F").select("diff", "t", "df", "d")
    return rounded(rounded(rounded(rounded(out, "diff", digits=4), "t", digits=5), "df", digits=3), "d")


_P = f"(SELECT g, exp(-n / 12 * (skew * skew + kurtosis * kurtosis / 4) / 100) AS p FROM ({_SHAPE.format(g='o_orderpriority', y='o_totalprice', t='orders')}))"


@query(f"""
    WITH r AS (SELECT g, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS r FROM {_P})
    SELECT 'bonferroni' AS method, g AS "group", round(least(1, p * m), 6) AS adjusted FROM r
    UNION ALL SELECT 'fdr_bh', g, round(least(1, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) FROM r
""")
def adjust_pvalues(spark, d):
    tests = compare.normality(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").select("group", F.exp(-F.col("jarque_bera") / 200).alias("p"))
    both = [compare.adjust_pvalues(tests, "p", m).select(F.lit(m).alias("method"), "group", F.round("adjusted", 6).alias("adjusted")) for m in ("bonferroni", "fdr_bh")]
    return both[0].unionByName(both[1])


# five kinds of event: the F distribution's tail for four degrees of freedom is a closed form
@query(f"""
    WITH md AS (SELECT event_type, quantile_cont(value, 0.5) AS md FROM events GROUP BY 1),
    g AS (SELECT event_type AS g, count(*) AS n, avg(abs(value - md)) AS m, var_samp(abs(value - md)) AS v FROM events JOIN md USING (event_type) GROUP BY 1), {_F},
    c AS (SELECT count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY event_type)
    SELECT 'sizes' AS flag, max(n) / min(n) > 1.5 OR count(*) < 3 AS raised FROM c
    UNION ALL SELECT 'shape', bool_or(abs(skew) > 2 OR abs(kurtosis) > 7 OR exp(-n / 12 * (skew * skew + kurtosis * kurtosis / 4)) < 0.05) FROM ({_SHAPE.format(g='event_type', y='value', t='events')})
    UNION ALL SELECT 'spread', pow(x, df2 / 2) * (1 + df2 / 2 * (1 - x)) < 0.05 FROM (SELECT df2, df2 / (df2 + df1 * f) AS x FROM f)
""")
def assumption_flags(spark, d):
    return compare.assumption_flags(table(spark, d, "events"), "event_type", "value", ["click", "view", "purchase"])


@query()
def omnibus(spark, d):
    return compare.omnibus(table(spark, d, "events"), "event_type", "value")


@query(f"""
    WITH a AS (WITH {_EVENTS}, {_F} SELECT f AS statistic, greatest(0, least(1, df1 * (f - 1) / (df1 * (f - 1) + n))) AS effect FROM f)
    SELECT 'anova' AS method, round(statistic, 3) AS statistic, round(effect, 4) AS effect FROM a
    UNION ALL SELECT 'welch', round(statistic, 3), round(omega_squared, 4) FROM ({ORACLES["welch_anova"]})
    UNION ALL SELECT 'kruskal', round(statistic, 3), round(epsilon_squared, 4) FROM ({ORACLES["kruskal"]})
""")
def omnibus_statistics(spark, d):
    """What SQL can say of ``omnibus``: all but the tails of the distributions."""
    return rounded(rounded(omnibus(spark, d).select("method", "statistic", "effect"), "statistic", digits=3), "effect", digits=4)


@query(f"""
    WITH {_GROUPS.format(g='c_mktsegment', y='c_acctbal', t='customer')}
    SELECT g AS "group", n, round(m, 4) AS mean, round(sqrt(v), 4) AS sd, round((1.959963984540054 + 0.8416212335729143) * sqrt(2 / n), 6) AS mde, CAST(63 AS BIGINT) AS n_needed FROM g
""")
def segment_mde(spark, d):
    return rounded(rounded(compare.segment_mde(table(spark, d, "customer"), "c_mktsegment", "c_acctbal"), "mean", "sd", digits=4), "mde")


# ---- regression ----

_X, _Y = "l_quantity", "l_extendedprice"
_LINE = f"SELECT regr_slope({_Y}, {_X}) AS b, regr_intercept({_Y}, {_X}) AS a, regr_r2({_Y}, {_X}) AS r2, count(*) AS n FROM lineitem"


@query(f"SELECT 'intercept' AS term, round(a, 3) AS coefficient, round(r2, 6) AS r2, n FROM ({_LINE}) UNION ALL SELECT 'l_quantity', round(b, 3), round(r2, 6), n FROM ({_LINE})")
def ols(spark, d):
    return rounded(rounded(regress.ols(table(spark, d, "lineitem"), [_X], _Y), "coefficient", digits=3), "r2")


@query(f"""
    WITH g AS (SELECT l_returnflag AS g, count(*) AS n, regr_slope({_Y}, {_X}) AS b, regr_intercept({_Y}, {_X}) AS a, regr_syy({_Y}, {_X}) - pow(regr_sxy({_Y}, {_X}), 2) / regr_sxx({_Y}, {_X}) AS rss FROM lineitem GROUP BY 1),
    z AS (SELECT a AS a0, b AS b0, g AS g0 FROM g ORDER BY g LIMIT 1), t AS (SELECT sum(n) AS n, 1 - sum(rss) / (SELECT var_pop({_Y}) * count(*) FROM lineitem) AS r2 FROM g),
    c AS (SELECT 'intercept' AS term, a0 AS c FROM z UNION ALL SELECT 'l_quantity', b0 FROM z
          UNION ALL SELECT 'C(l_returnflag)[' || g || ']', a - a0 FROM g, z WHERE g <> g0 UNION ALL SELECT 'l_quantity:C(l_returnflag)[' || g || ']', b - b0 FROM g, z WHERE g <> g0)
    SELECT term, round(c, 3) AS coefficient, round(r2, 6) AS r2, CAST(n AS BIGINT) AS n FROM c, t
""")
def ols_formula(spark, d):
    out = regress.ols_formula(table(spark, d, "lineitem"), [_X, "C(l_returnflag)", f"{_X}:C(l_returnflag)"], _Y)
    return rounded(rounded(out, "coefficient", digits=3), "r2")


_MOMENT = f"SELECT avg({_X}) AS mx, var_pop({_X}) * count(*) AS sxx, count(*) AS n FROM lineitem"
_HC3 = f"""
    e AS (SELECT {_X} AS x, mx, sxx, ({_Y} - a - b * {_X}) / (1 - 1.0 / m.n - pow({_X} - mx, 2) / sxx) AS u FROM lineitem, ({_LINE}) l, ({_MOMENT}) m),
    se AS (SELECT sqrt(sum(pow((x - mx) * u, 2))) / max(sxx) AS slope_se, sqrt(sum(pow((1.0 / (SELECT count(*) FROM lineitem) - mx * (x - mx) / sxx) * u, 2))) AS intercept_se FROM e)"""


@query(f"WITH {_HC3} SELECT 'l_quantity' AS term, round(slope_se, 4) AS hc3_se FROM se UNION ALL SELECT 'intercept', round(intercept_se, 4) FROM se")
def ols_hc3(spark, d):
    return rounded(regress.ols_hc3(table(spark, d, "lineitem"), [_X], _Y), "hc3_se", digits=4)


@query(f"WITH {_HC3} SELECT 'l_quantity' AS term, round(b, 3) AS coefficient, round(slope_se, 4) AS hc3_se FROM se, ({_LINE}) UNION ALL SELECT 'intercept', round(a, 3), round(intercept_se, 4) FROM se, ({_LINE})")
def coef_table(spark, d):
    return rounded(rounded(regress.coef_table(table(spark, d, "lineitem"), [_X], _Y), "hc3_se", digits=4), "coefficient", digits=3).select("term", "coefficient", "hc3_se")


@query(f"WITH e AS (SELECT {_X} AS x, pow({_Y} - a - b * {_X}, 2) AS e2 FROM lineitem, ({_LINE})) SELECT round(count(*) * regr_r2(e2, x), 3) AS lm, CAST(1 AS INTEGER) AS df FROM e")
def breusch_pagan(spark, d):
    return rounded(regress.breusch_pagan(table(spark, d, "lineitem"), [_X], _Y), "lm", digits=3).select("lm", "df")


@query("""
    WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer),
    k AS (SELECT count(*) AS n, avg(pow((c_acctbal - m) / s, 3)) AS skew, avg(pow((c_acctbal - m) / s, 4)) AS kurtosis FROM customer, s)
    SELECT n, round(skew, 5) AS skew, round(kurtosis, 5) AS kurtosis, round(n / 6 * (skew * skew + pow(kurtosis - 3, 2) / 4), 3) AS statistic, round(exp(-n / 12 * (skew * skew + pow(kurtosis - 3, 2) / 4)), 6) AS p_value FROM k
""")
def jarque_bera(spark, d):
    out = regress.jarque_bera(table(spark, d, "customer"), "c_acctbal")
    return rounded(rounded(rounded(out, "skew", "kurtosis", digits=5), "statistic", digits=3), "p_value")


@query("WITH e AS (SELECT value, lag(value) OVER (ORDER BY ts, event_id) AS b FROM events) SELECT round(sum(pow(value - b, 2)) / sum(value * value), 6) AS statistic FROM e")
def durbin_watson(spark, d):
    return rounded(regress.durbin_watson(table(spark, d, "events"), "value", ["ts", "event_id"]), "statistic")


@query("""
    WITH e AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, value - (SELECT avg(value) FROM events) AS x FROM events),
    p AS (SELECT k, sum(a.x * b.x) AS s FROM e a JOIN (SELECT unnest(range(13)) AS k) ON true JOIN e b ON b.i = a.i + k GROUP BY 1)
    SELECT CAST(k AS INTEGER) AS lag, round(s / (SELECT s FROM p WHERE k = 0), 6) AS acf FROM p
""")
def acf(spark, d):
    return rounded(regress.acf(table(spark, d, "events"), "value", ["ts", "event_id"], 12), "acf")


@query(f"SELECT 'l_quantity' AS term, round(b, 3) AS coefficient, round(b * sx / sy, 6) AS beta FROM ({_LINE}), (SELECT stddev_samp({_X}) AS sx, stddev_samp({_Y}) AS sy FROM lineitem)")
def std_coefs(spark, d):
    return rounded(rounded(regress.std_coefs(table(spark, d, "lineitem"), [_X], _Y), "beta"), "coefficient", digits=3)


@query(f"SELECT * FROM (VALUES ('more', 'l_quantity', 2.0), ('fewer', 'l_quantity', -1.0)) s(scenario, term, change), (SELECT b FROM ({_LINE}))".replace("SELECT * FROM", "SELECT scenario, term, CAST(change AS DOUBLE) AS change, round(change * b, 3) AS impact FROM", 1))
def scenario_impact(spark, d):
    scenarios = spark.createDataFrame([("more", "l_quantity", 2.0), ("fewer", "l_quantity", -1.0)], "scenario string, term string, change double")
    return rounded(regress.scenario_impact(regress.ols(table(spark, d, "lineitem"), [_X], _Y), scenarios), "impact", digits=3)


@query("""
    WITH g AS (SELECT unnest(['R', 'A', 'N']) AS l_returnflag, unnest([1, 2, 3]) AS k), s AS (SELECT unnest([1, 2, 3]) AS scope),
    r AS (SELECT scope, l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice AS y FROM lineitem JOIN g USING (l_returnflag) JOIN s ON k <= scope),
    f AS (SELECT scope, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2 FROM r GROUP BY 1),
    e AS (SELECT scope, l_orderkey, l_linenumber, x, y, y - a - b * x AS e FROM r JOIN f USING (scope)),
    m AS (SELECT scope, avg(e) AS m, stddev_pop(e) AS sd FROM e GROUP BY 1),
    k AS (SELECT scope, avg(pow((e - m) / sd, 3)) AS skew, avg(pow((e - m) / sd, 4)) - 3 AS kurtosis FROM e JOIN m USING (scope) GROUP BY 1),
    w AS (SELECT scope, sum(pow(e - b, 2)) / sum(e * e) AS dw FROM (SELECT scope, e, lag(e) OVER (PARTITION BY scope ORDER BY l_orderkey, l_linenumber, y, x) AS b FROM e) GROUP BY 1)
    SELECT CAST(scope AS INTEGER) AS scope, n, round(b, 3) AS slope, round(a, 3) AS intercept, round(r2, 6) AS r2, round(skew, 4) AS skew, round(kurtosis, 4) AS kurtosis,
           round(dw, 6) AS durbin_watson, round(exp(-n / 12 * (skew * skew + kurtosis * kurtosis / 4)), 6) AS p_value FROM f JOIN k USING (scope) JOIN w USING (scope)
""")
def pooled_fits(spark, d):
    out = regress.pooled_fits(table(spark, d, "lineitem"), "l_returnflag", _X, _Y, ["R", "A", "N"], [*_KEYS, _Y, _X]).drop("jarque_bera")
    return rounded(rounded(rounded(out, "slope", "intercept", digits=3), "r2", "durbin_watson", "p_value"), "skew", "kurtosis", digits=4)


@query(f"""
    WITH f AS (SELECT a + b * {_X} AS fitted, {_Y} - a - b * {_X} AS residual FROM lineitem, ({_LINE})), s AS (SELECT min(fitted) AS lo, max(fitted) AS hi FROM f)
    SELECT CAST(least(9, floor((fitted - lo) / (hi - lo) * 10 + 0.0)) AS INTEGER) AS bin, count(*) AS n, round(avg(fitted), 2) AS mean_fitted, round(stddev_pop(residual), 2) AS sd_residual FROM f, s GROUP BY 1
""")
def residual_bins(spark, d):
    return rounded(regress.residual_bins(table(spark, d, "lineitem"), [_X], _Y, 10).drop("mean_residual"), "mean_fitted", "sd_residual", digits=2)


# ---- models ----

_SCORED = "(SELECT l_extendedprice AS y, 1400 * l_quantity + 100 * (l_linenumber - 3) AS p FROM lineitem)"


def _scored(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (1400 * F.col("l_quantity") + 100 * (F.col("l_linenumber") - 3)).alias("p"))


@query(f"""
    SELECT round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 4) AS r2,
           round(avg(abs(y - p) / abs(y)), 4) AS mape, round(max(abs(y - p)), 4) AS max_error, round(quantile_cont(abs(y - p), 0.5), 4) AS median_ae,
           round(1 - var_pop(y - p) / var_pop(y), 4) AS explained_var FROM {_SCORED}
""")
def regression_metrics(spark, d):
    return models.regression_metrics(_scored(spark, d), "y", "p")


@query(f"""
    WITH c AS (SELECT p, CAST(sum(CASE WHEN y >= 40000 THEN 1 ELSE 0 END) AS BIGINT) AS pos, CAST(sum(CASE WHEN y >= 40000 THEN 0 ELSE 1 END) AS BIGINT) AS neg FROM {_SCORED} GROUP BY 1),
    r AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cq FROM c)
    SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives, round(sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)), 4) AS roc_auc,
           round(sum(pos * cp / (cp + cq)) / sum(pos), 4) AS average_precision FROM r
""")
def binary_metrics(spark, d):
    return models.binary_metrics(_scored(spark, d), "y", "p", 40000)


@query(f"WITH c AS (SELECT quantile_cont(y, 0.9) AS cut FROM {_SCORED}) SELECT round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(avg(abs(y - p)) FILTER (y >= cut), 4) AS tail_mae FROM {_SCORED}, c")
def tail_mae(spark, d):
    return rounded(models.tail_mae(_scored(spark, d), "y", "p", 0.9), "mae", "rmse", "tail_mae", digits=4)


@query(f"SELECT round(avg(abs(y - p)), 4) AS mean_residual, round(stddev_pop(y - p), 4) AS std_residual, round(max(abs(y - p)), 4) AS max_residual FROM {_SCORED}")
def residual_summary(spark, d):
    return rounded(models.residual_summary(_scored(spark, d), "y", "p"), "mean_residual", "std_residual", "max_residual", digits=4)


_METRICS = ("mae", "rmse", "r2", "mape", "max_error", "median_ae", "explained_var")


@query(f"""
    WITH d AS (SELECT l_quantity AS x, l_discount AS z, l_extendedprice AS y, (l_orderkey * 7 + l_linenumber) % 5 AS fold FROM lineitem),
    f AS (SELECT o AS fold, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy
          FROM d JOIN (SELECT unnest(range(5)) AS o) ON fold <> o GROUP BY 1),
    b AS (SELECT fold, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz, mx, mz, my FROM f),
    e AS (SELECT fold, y, y - my - bx * (x - mx) - bz * (z - mz) AS e FROM d JOIN b USING (fold)),
    p AS (SELECT fold, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - sum(e * e) / (var_pop(y) * count(*)), 4) AS r2, round(avg(abs(e) / abs(y)), 4) AS mape,
                 round(max(abs(e)), 4) AS max_error, round(quantile_cont(abs(e), 0.5), 4) AS median_ae, round(1 - var_pop(e) / var_pop(y), 4) AS explained_var FROM e GROUP BY 1)
    SELECT count(*) AS folds, {", ".join(f"round(avg({m}), 4) AS {m}" for m in _METRICS)} FROM p
""")
def kfold_cv(spark, d):
    fold = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 5
    return models.kfold_cv(table(spark, d, "lineitem"), [_X, "l_discount"], _Y, _KEYS, fold=fold)


@query(f"""
    WITH d AS (SELECT l_quantity > 25 AS x, l_extendedprice AS y, (l_orderkey * 7 + l_linenumber) % 5 AS fold FROM lineitem),
    f AS (SELECT o AS fold, x, avg(y) AS p FROM d JOIN (SELECT unnest(range(5)) AS o) ON fold <> o GROUP BY 1, 2),
    e AS (SELECT fold, y, y - p AS e FROM d JOIN f USING (fold, x)),
    p AS (SELECT fold, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - sum(e * e) / (var_pop(y) * count(*)), 4) AS r2, round(avg(abs(e) / abs(y)), 4) AS mape,
                 round(max(abs(e)), 4) AS max_error, round(quantile_cont(abs(e), 0.5), 4) AS median_ae, round(1 - var_pop(e) / var_pop(y), 4) AS explained_var FROM e GROUP BY 1)
    SELECT count(*) AS folds, {", ".join(f"round(avg({m}), 4) AS {m}" for m in _METRICS)} FROM p
""")
def kfold_cv_tree(spark, d):
    fold = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 5
    li = table(spark, d, "lineitem").withColumn("many", (F.col("l_quantity") > 25).cast("int"))
    return models.kfold_cv(li, ["many"], _Y, _KEYS, fold=fold, model="random_forest", params={"numTrees": 1, "maxDepth": 1, "bootstrap": False})


@query("""
    WITH d AS (SELECT CASE WHEN l_quantity <= 10 THEN 'few' WHEN l_quantity <= 30 THEN 'some' ELSE 'many' END AS size FROM lineitem WHERE (l_orderkey * 7 + l_linenumber) % 5 = 0)
    SELECT size AS actual, size AS predicted, count(*) AS n FROM d GROUP BY 1
""")
def train_classifier(spark, d):
    size = F.when(F.col("l_quantity") <= 10, "few").when(F.col("l_quantity") <= 30, "some").otherwise("many")
    li = table(spark, d, "lineitem").select(*_KEYS, "l_quantity", "l_discount", size.alias("size"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 5).alias("part"))
    fitted = models.train_model(li.filter("part <> 0"), ["l_quantity", "l_discount"], "size", "random_forest_classifier", {"numTrees": 1, "maxDepth": 2, "maxBins": 64, "bootstrap": False})
    return models.holdout_table(fitted, li.filter("part = 0"), "size", _KEYS).groupBy("actual", "predicted").agg(F.count("*").alias("n"))


@query("""
    WITH c AS (SELECT l_linestatus AS a, CASE WHEN l_quantity > 25 THEN 'F' ELSE 'O' END AS p FROM lineitem),
    l AS (SELECT l, sum(CASE WHEN a = l AND p = l THEN 1 ELSE 0 END) AS r, sum(CASE WHEN a = l THEN 1 ELSE 0 END) AS a, sum(CASE WHEN p = l THEN 1 ELSE 0 END) AS p
          FROM c, (SELECT unnest(['F', 'O']) AS l) GROUP BY 1)
    SELECT round(sum(r) / sum(a), 4) AS accuracy, round(avg(r / p), 4) AS precision, round(avg(r / a), 4) AS recall, round(avg(2 * r / (a + p)), 4) AS f1 FROM l
""")
def classification_metrics(spark, d):
    li = table(spark, d, "lineitem").select("l_linestatus", F.when(F.col("l_quantity") > 25, "F").otherwise("O").alias("guess"))
    return models.classification_metrics(li, "l_linestatus", "guess")


_COMPARED = f"SELECT unnest(['mae', 'rmse']) AS metric, unnest([avg(abs(y - p)), sqrt(avg(pow(y - p, 2)))]) AS candidate, unnest([avg(abs(y - 35000)), NULL]) AS champion FROM {_SCORED}"


def _compared(spark, d):
    s = _scored(spark, d)
    e = F.abs(F.col("y") - F.col("p"))
    candidate = s.agg(F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")).unpivot([], ["mae", "rmse"], "metric", "value")
    champion = s.agg(F.avg(F.abs(F.col("y") - 35000)).alias("mae")).unpivot([], ["mae"], "metric", "value")
    return models.compare_models(candidate, champion)


@query(f"SELECT metric, round(candidate, 4) AS candidate, round(champion, 4) AS champion, round(candidate - champion, 4) AS delta, round((candidate - champion) / champion * 100, 4) AS delta_pct FROM ({_COMPARED})")
def compare_models(spark, d):
    return rounded(_compared(spark, d), "candidate", "champion", "delta", "delta_pct", digits=4)


@query(f"SELECT metric, round((champion - candidate) / champion, 6) AS improvement, champion IS NULL OR (champion - candidate) / champion > 0.05 AS promote FROM ({_COMPARED})")
def promotion(spark, d):
    return rounded(models.promotion(_compared(spark, d)), "improvement")


@query()
def train_model(spark, d):
    li = table(spark, d, "lineitem").select(*_KEYS, "l_quantity", "l_discount", "l_extendedprice")
    parts = sample.split_random(li, 0.2, _KEYS, 1)
    fitted = models.train_model(parts.filter("part = 'train'"), ["l_quantity", "l_discount"], _Y)
    return models.holdout_table(fitted, parts.filter("part = 'val'"), _Y, _KEYS)


@query("""
    WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
    p AS (SELECT q.vec_id, e.vec_id AS other, e.label, round(sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))), 12) AS d FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS r FROM p)
    SELECT vec_id, round(avg(label), 6) AS prediction FROM r WHERE r <= 5 GROUP BY 1
""")
def knn_predict(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(models.knn_predict(e, e.filter("vec_id % 100 = 0"), "embedding", "label", "vec_id", 5), "prediction")


@query("""
    WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
    p AS (SELECT q.vec_id, e.vec_id AS other, e.label, round(sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))), 12) AS d FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS r FROM p)
    SELECT vec_id, round(coalesce(avg(label) FILTER (d = 0), sum(label / d) FILTER (d > 0) / sum(1 / d) FILTER (d > 0)), 6) AS prediction FROM r WHERE r <= 5 GROUP BY 1
""")
def knn_weighted(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(models.knn_predict(e, e.filter("vec_id % 100 = 0"), "embedding", "label", "vec_id", 5, weights="distance"), "prediction")


@query()
def permutation_importance(spark, d):
    return models.permutation_importance(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], _Y, _KEYS, 2)


@query(f"""
    WITH m AS (SELECT min({_X}) AS lo, max({_X}) AS hi FROM lineitem), g AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS point)
    SELECT point, lo + (hi - lo) * point / 4 AS value, round(a + b * (lo + (hi - lo) * point / 4), 3) AS average FROM g, m, ({_LINE})
""")
def partial_dependence(spark, d):
    return rounded(models.partial_dependence(table(spark, d, "lineitem"), [_X], _Y, _X, 5), "average", digits=3)


@query("""
    WITH l AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a, min(p_size) AS lo, max(p_size) AS hi FROM part), g AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS point)
    SELECT p_partkey, point, CAST(lo + (hi - lo) * point / 4 AS DOUBLE) AS value, round(a + b * (lo + (hi - lo) * point / 4), 3) AS prediction FROM part, l, g
""")
def ice_curves(spark, d):
    return rounded(models.ice_curves(table(spark, d, "part"), ["p_size"], "p_retailprice", "p_size", ["p_partkey"], 5), "prediction", digits=3)


@query()
def rfe_curve(spark, d):
    return models.rfe_curve(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], _Y, _KEYS)


@query()
def rfe_curve_forest(spark, d):
    return models.rfe_curve(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], _Y, _KEYS, model="random_forest", params={"numTrees": 5, "maxDepth": 4})


_TRIALS = "(SELECT event_type AS model, abs(value - 50) + 1 AS objective FROM events)"


def _trials(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("model"), (F.abs(F.col("value") - 50) + 1).alias("objective"))


@query(f"SELECT model, round(min(objective), 6) AS best, CAST(row_number() OVER (ORDER BY min(objective), model) AS INTEGER) AS rank FROM {_TRIALS} GROUP BY 1")
def leaderboard(spark, d):
    return rounded(models.leaderboard(_trials(spark, d)), "best")


@query(f"""
    WITH b AS (SELECT model, min(objective) AS best, row_number() OVER (ORDER BY min(objective), model) AS r FROM {_TRIALS} GROUP BY 1)
    SELECT model, CAST(4 + CASE WHEN r <= 1 THEN 1 ELSE 0 END AS BIGINT) AS trials FROM b WHERE r <= 2
""")
def trial_allocation(spark, d):
    return models.trial_allocation(models.leaderboard(_trials(spark, d)).drop("rank"), 9, 2).select("model", "trials")


@query()
def model_search(spark, d):
    li = table(spark, d, "lineitem").select(*_KEYS, "l_quantity", "l_discount", "l_extendedprice")
    parts = sample.split_random(li, 0.2, _KEYS, 1)
    spaces = {"linear": {"regParam": [0.0, 0.01, 0.1, 1.0, 10.0], "elasticNetParam": [0.0, 0.25, 0.5, 0.75, 1.0]}, "boosted_trees": {"maxIter": [5, 10, 20], "maxDepth": [2, 3, 5], "stepSize": [0.05, 0.1, 0.3]}}
    # up to 100 trials, 20 of each model first and the rest for the best two: all points of both spaces are tried
    return models.model_search(parts.filter("part = 'train'"), parts.filter("part = 'val'"), ["l_quantity", "l_discount"], _Y, spaces, 20, 60, 2)


# ---- graphs ----

_EDGES = "(SELECT 'r' || r_regionkey AS source, 'n' || n_nationkey AS target FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"


def _edges(spark, d):
    def name(letter, c):
        return F.concat(F.lit(letter), F.col(c).cast("string"))

    nation = table(spark, d, "nation").select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target"))
    customer = table(spark, d, "customer").select(name("n", "c_nationkey").alias("source"), name("c", "c_custkey").alias("target"))
    orders = table(spark, d, "orders").select(name("c", "o_custkey").alias("source"), name("o", "o_orderkey").alias("target"))
    return nation.union(customer).union(orders)


@query(f"WITH RECURSIVE e AS {_EDGES}, r(id, depth) AS (SELECT 'r1', 0 UNION SELECT target, depth + 1 FROM r JOIN e ON id = source) SELECT id, CAST(depth AS INTEGER) AS depth FROM r")
def reachability(spark, d):
    return graph.reachability(_edges(spark, d), spark.createDataFrame([("r1",)], "id string"))


@query(f"WITH RECURSIVE e AS {_EDGES}, r(id) AS (SELECT 'n3' UNION SELECT target FROM r JOIN e ON id = source), b(id) AS (SELECT 'n3' UNION SELECT source FROM b JOIN e ON id = target), a AS (SELECT id FROM r UNION SELECT id FROM b) SELECT DISTINCT source, target FROM e WHERE source IN (SELECT id FROM a) AND target IN (SELECT id FROM a)")
def graph_scope(spark, d):
    return graph.scope(_edges(spark, d), spark.createDataFrame([("n3",)], "id string"))


@query("SELECT DISTINCT c_custkey AS source FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_parents(spark, d):
    edges = table(spark, d, "customer").select(F.col("c_custkey").alias("source"))
    return graph.missing_parents(edges, table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct())
