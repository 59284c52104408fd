"""Queries on sources, filters, cleaning, checks, joins and profiles, each beside its SQL."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as fx
from ..functions.dist import norm_ppf_sql
from ..functions.filters import FilterSpec, between, exclude_any, filter_all, members, slice_rows
from ..functions.order import new_path
from ..operators import checks, clean, joins, profile
from ..sources import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.scan_table(spark, f"{d}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- sources ----


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def scan_table(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query("""
    SELECT n_nationkey, CASE WHEN n_name IN ('FRANCE', 'NATION_3', '') THEN NULL ELSE n_name END AS n_name, n_regionkey FROM nation
""")
def read_lookup(spark, d):
    raw = table(spark, d, "nation").select(*[F.col(c).cast("string").alias(c) for c in ("n_nationkey", "n_name", "n_regionkey")])
    return tables.as_lookup(raw, {"n_nationkey": "int", "n_regionkey": "int"}, ["FRANCE", "NATION_3", ""])


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, c_acctbal FROM customer")
def lookup_csv(spark, d):
    """A lookup written as CSV and read with its declared missing tokens."""
    path = new_path(spark, "lookup")
    table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.csv(path, header=True)
    return tables.read_lookup(spark, path, {"c_custkey": "bigint", "c_acctbal": "double"}, ["BUILDING", ""])


@query("SELECT o_orderkey, o_totalprice, true AS immutable FROM orders WHERE o_totalprice > 1000")
def versioned_sample(spark, d):
    """A version that is written once; writing it again is refused."""
    folder = new_path(spark, "versions")
    rows = table(spark, d, "orders").filter("o_totalprice > 1000").select("o_orderkey", "o_totalprice")
    path = tables.write_version(rows, folder, "orders", 1)
    try:
        tables.write_version(rows, folder, "orders", 1)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.parquet(path).withColumn("immutable", F.lit(refused))


@query("SELECT least(500, count(*)) AS n, least(500, count(*)) AS distinct_keys FROM orders")
def read_sample(spark, d):
    out = tables.read_sample(table(spark, d, "orders"), 500, 7, ["o_orderkey", "o_totalprice"], ["o_orderkey"])
    return out.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("distinct_keys"))


@query("""
    SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name AS name,
           CASE WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' WHEN data_type = 'VARCHAR' THEN 'string'
                WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type = 'INTEGER' THEN 'int' WHEN data_type = 'DOUBLE' THEN 'double' END AS dtype
    FROM (SELECT row_number() OVER () AS ordinal_position, column_name, column_type AS data_type FROM (DESCRIBE SELECT * FROM lineitem))
""")
def list_columns(spark, d):
    return tables.list_columns(table(spark, d, "lineitem"))


@query()
def table_digest(spark, d):
    return tables.table_digest(table(spark, d, "orders"))


@query("""
    SELECT count(*) AS n, round(sum(datediff('microsecond', o_orderdate, l_shipdate) / 60000000.0) / count(*), 6) AS mean_minutes
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_extendedprice > 1000 AND datediff('microsecond', o_orderdate, l_shipdate) / 60000000.0 > 0
      AND datediff('microsecond', o_orderdate, l_shipdate) / 60000000.0 < 86400
""")
def duration_filter(spark, d):
    met = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    met = met.withColumn("minutes", fx.duration_minutes("o_orderdate", "l_shipdate")).filter(between("l_extendedprice", 1000) & between("minutes", 0, 86400))
    return met.agg(F.count("*").alias("n"), F.round(F.sum("minutes") / F.count("*"), 6).alias("mean_minutes"))


# ---- filters ----


@query("""
    SELECT event_id, event_type, nullif(value, 0) AS value FROM events
    WHERE (nullif(value, 0) IS NULL OR nullif(value, 0) <> 10) AND user_id > 5
""")
def filter_all_rows(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.nullif("value", F.lit(0.0)).alias("value"))
    return filter_all(e, [FilterSpec("value", "!=", 10), FilterSpec("user_id", ">", 5)]).drop("user_id")


@query("""
    SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
    WHERE NOT ((l_quantity <= 4 AND l_extendedprice > 3000) OR (l_quantity >= 40 AND l_discount < 0.03))
""")
def exclude_any_rows(spark, d):
    groups = [[FilterSpec("l_quantity", "<=", 4), FilterSpec("l_extendedprice", ">", 3000)], [FilterSpec("l_quantity", ">=", 40), FilterSpec("l_discount", "<", 0.03)]]
    return exclude_any(table(spark, d, "lineitem"), groups).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def membership_filter(spark, d):
    return members(table(spark, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def slice_filter(spark, d):
    return slice_rows(table(spark, d, "orders"), "o_totalprice > 100000 and o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem")
def numeric_features(spark, d):
    return profile.numeric_features(table(spark, d, "lineitem"), "l_extendedprice")


@query("SELECT o_orderpriority, o_orderstatus FROM orders")
def role_columns(spark, d):
    return profile.by_role(table(spark, d, "orders"), {"o_orderpriority": "feature", "o_orderstatus": "feature", "o_totalprice": "target"}, "feature").select("o_orderpriority", "o_orderstatus")


# ---- cleaning ----

_DIRTY = "SELECT doc_id % 400 AS id, CASE WHEN lang = 'es' THEN 'NA' WHEN lang = 'fr' THEN '' ELSE lang END AS lang, CASE WHEN n_chars % 7 = 0 THEN 'bad' || CAST(n_chars % 3 AS VARCHAR) ELSE CAST(n_chars % 50 AS VARCHAR) || '.5' END AS amount, CASE WHEN n_chars % 5 = 0 THEN 'never' WHEN n_chars % 5 = 1 THEN '2024-02-' || lpad(CAST(n_chars % 28 + 1 AS VARCHAR), 2, '0') ELSE '2024-01-15 10:30:00' END AS seen, CASE WHEN n_chars % 11 = 0 THEN NULL ELSE n_chars % 13 END AS target FROM documents"


def _dirty(spark, d):
    n = F.col("n_chars")
    lang = F.when(F.col("lang") == "es", "NA").when(F.col("lang") == "fr", "").otherwise(F.col("lang"))
    amount = F.when(n % 7 == 0, F.concat(F.lit("bad"), (n % 3).cast("string"))).otherwise(F.concat((n % 50).cast("string"), F.lit(".5")))
    seen = F.when(n % 5 == 0, "never").when(n % 5 == 1, F.concat(F.lit("2024-02-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"))).otherwise("2024-01-15 10:30:00")
    return table(spark, d, "documents").select((F.col("doc_id") % 400).alias("id"), lang.alias("lang"), amount.alias("amount"), seen.alias("seen"), F.when(n % 11 != 0, n % 13).alias("target"))


@query(f"SELECT DISTINCT * FROM ({_DIRTY})")
def dedup_rows(spark, d):
    return clean.dedup_rows(_dirty(spark, d))


@query(f"SELECT id, CASE WHEN lang NOT IN ('', 'NA', 'N/A', 'null', 'None', 'nan') THEN lang END AS lang, amount, seen, target FROM ({_DIRTY})")
def standardize_missing(spark, d):
    return clean.standardize_missing(_dirty(spark, d))


@query(f"SELECT 'seen' AS \"column\", count(*) FILTER (seen = 'never') AS failures, ['never'] AS examples FROM ({_DIRTY})")
def parse_datetime(spark, d):
    return clean.parse_failures(_dirty(spark, d), {"seen": clean.as_datetime("seen")})


@query(f"SELECT 'amount' AS \"column\", count(*) FILTER (amount LIKE 'bad%') AS failures, list_sort(list(DISTINCT amount) FILTER (amount LIKE 'bad%'))[1:5] AS examples FROM ({_DIRTY})")
def parse_numeric(spark, d):
    return clean.parse_failures(_dirty(spark, d), {"amount": clean.as_number("amount")})


@query(f"SELECT * FROM ({_DIRTY}) WHERE target IS NOT NULL")
def drop_null_target(spark, d):
    return clean.drop_null_target(_dirty(spark, d), "target")


_CANONICAL = f"SELECT id, CASE WHEN lang NOT IN ('', 'NA') THEN lang END AS lang, CAST(trunc(try_cast(amount AS DOUBLE)) AS BIGINT) AS amount, try_cast(seen AS TIMESTAMP) AS seen, target FROM (SELECT DISTINCT * FROM ({_DIRTY})) WHERE target IS NOT NULL"


@query(_CANONICAL)
def canonicalize(spark, d):
    return clean.canonicalize(_dirty(spark, d), "target", {"seen": ()}, {"amount": "bigint"})


@query(f"SELECT DISTINCT * FROM ({_DIRTY}) WHERE target IS NOT NULL")
def simple_clean(spark, d):
    return clean.simple_clean(_dirty(spark, d), "target")


_AUDIT = f"""
    SELECT (SELECT count(*) FROM ({_DIRTY})) AS rows_in, (SELECT count(*) FROM ({_CANONICAL})) AS rows_out,
           (SELECT count(*) FROM ({_DIRTY})) - (SELECT count(*) FROM ({_CANONICAL})) AS dropped,
           (SELECT count(*) FROM ({_DIRTY})) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({_DIRTY}))) AS duplicates,
           (SELECT count(*) FROM (SELECT DISTINCT * FROM ({_DIRTY})) WHERE target IS NULL) AS null_target, 0 AS unexplained
"""


@query(_AUDIT)
def transform_audit(spark, d):
    dirty = _dirty(spark, d)
    return clean.transform_audit(dirty, "target", clean.canonicalize(dirty, "target", {"seen": ()}, {"amount": "bigint"}))


_FANNED = """
    WITH m AS (
        SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS target FROM orders
        UNION ALL SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END FROM orders WHERE o_orderkey % 7 = 0),
    l AS (SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'NA' FROM customer WHERE c_custkey % 10 = 0),
    j AS (SELECT * FROM m LEFT JOIN l ON o_custkey = c_custkey),
    u AS (SELECT DISTINCT * FROM j)
"""


def _fanned(spark, d):
    """Orders, some twice, met by customers of whom some have two rows."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("target"))
    orders = orders.withColumn("_n", F.explode(F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_n")
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    twice = customers.filter("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("NA"))
    return clean.audited_canonicalize(orders, "target", lookup=customers.unionByName(twice), keys=("o_custkey", "c_custkey"), drop=("o_custkey", "c_custkey"))


@query(_FANNED + """
    SELECT (SELECT count(*) FROM m) AS rows_before_join, (SELECT count(*) FROM (SELECT c_custkey FROM l GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys,
           (SELECT count(*) FROM j) AS rows_in, (SELECT count(*) FROM u WHERE target IS NOT NULL) AS rows_out,
           (SELECT count(*) FROM j) - (SELECT count(*) FROM u WHERE target IS NOT NULL) AS dropped, (SELECT count(*) FROM j) - (SELECT count(*) FROM u) AS duplicates,
           (SELECT count(*) FROM u WHERE target IS NULL) AS null_target, 0 AS unexplained, ['c_mktsegment'] AS columns_added, ['o_custkey'] AS columns_dropped
""")
def audited_join(spark, d):
    """The audit of a join that multiplies rows, and of the cleaning after it."""
    return _fanned(spark, d)[1]


@query(_FANNED + "SELECT o_orderkey, target, CASE WHEN c_mktsegment <> 'NA' THEN c_mktsegment END AS c_mktsegment FROM u WHERE target IS NOT NULL")
def audited_rows(spark, d):
    """The rows that this cleaning leaves."""
    return _fanned(spark, d)[0]


@query(_AUDIT)
def guarded_transform(spark, d):
    """The audit of a cleaning that may not lose a row without a reason."""
    return clean.guard_drops(transform_audit(spark, d), 0.0)


@query("SELECT least(400, count(*)) AS n, least(400, count(*)) AS distinct_keys FROM documents")
def capped_rows(spark, d):
    """The rows of a trial run."""
    out = clean.cap_rows(table(spark, d, "documents").select("doc_id", "lang"), 400, ["doc_id"])
    return out.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("distinct_keys"))


@query(f"SELECT 'lang' AS \"column\", list_sort(list(DISTINCT lang) FILTER (lang IN ('', 'NA'))) AS tokens FROM ({_DIRTY}) UNION ALL SELECT 'amount', [] UNION ALL SELECT 'seen', []")
def observed_tokens(spark, d):
    return clean.observed_tokens(_dirty(spark, d))


# ---- checks ----


@query("SELECT 'o_missing' AS \"column\", 'issue' AS level, 'missing' AS reason UNION ALL SELECT unnest(['o_orderstatus', 'o_orderdate', 'o_orderpriority']), 'warning', 'extra'")
def check_columns(spark, d):
    return checks.check_columns(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_missing"])


@query("""
    SELECT 'a' AS "column", round(avg(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END), 6) AS null_rate, avg(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END) <= 0.2 AS ok FROM events
    UNION ALL SELECT 'event_id', 0.0, true
""")
def check_nulls(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("value") >= 20, F.col("value")).alias("a"))
    return rounded(checks.check_nulls(e, 0.2), "null_rate")


@query("SELECT 'o_custkey' AS \"column\", 'int' AS expected, 'bigint' AS found UNION ALL SELECT 'o_none', 'string', NULL")
def check_dtypes(spark, d):
    from pyspark.sql.types import StructType

    return checks.check_dtypes(table(spark, d, "orders"), StructType().add("o_orderkey", "long").add("o_custkey", "integer").add("o_none", "string"))


@query("""
    SELECT 'l_quantity' AS "column", '> 5' AS rule, count(*) FILTER (NOT l_quantity > 5) AS violations FROM lineitem
    UNION ALL SELECT 'l_discount', '<= 0.05', count(*) FILTER (NOT l_discount <= 0.05) FROM lineitem
    UNION ALL SELECT 'l_tax', 'not null', count(*) FILTER (l_tax IS NULL) FROM lineitem
""")
def check_values(spark, d):
    return checks.check_values(table(spark, d, "lineitem"), [FilterSpec("l_quantity", ">", 5), FilterSpec("l_discount", "<=", 0.05)], ("l_tax",))


@query("SELECT 'n_chars' AS \"column\", 'not null' AS rule, count(*) FILTER (n_chars % 11 = 0) AS violations FROM documents UNION ALL SELECT 'lang', 'dtype', 1")
def check_engineered(spark, d):
    from pyspark.sql.types import StructType

    docs = table(spark, d, "documents").select("lang", F.when(F.col("n_chars") % 11 != 0, F.col("n_chars")).alias("n_chars"))
    return checks.check_engineered(docs, StructType().add("lang", "long", True).add("n_chars", "long", False))


@query("""
    SELECT 'x' AS "column", count(*) FILTER (value < 10 OR value > 90) AS bad FROM events UNION ALL SELECT 'value', 0
""")
def check_finite(spark, d):
    v = F.col("value")
    x = F.when(v < 10, F.lit(float("nan"))).when(v > 90, F.lit(float("inf"))).otherwise(v)
    return checks.check_finite(table(spark, d, "events").select("value", x.alias("x")), ["x", "value"])


@query("SELECT 'warning' AS level, 'group without variance' AS reason")
def validate_groups(spark, d):
    y = F.when(F.col("o_orderstatus") == "F", F.lit(1.0)).otherwise(F.col("o_totalprice"))
    return checks.validate_groups(table(spark, d, "orders").select("o_orderstatus", y.alias("y")), "o_orderstatus", "y")


@query("""
    WITH a AS (SELECT count(*) FILTER (l.doc_id IS NULL) > 0 AS warn FROM documents d LEFT JOIN labels l USING (doc_id)),
    b AS (SELECT count(*) FILTER (text IS NULL) > 0 AS warn FROM documents)
    SELECT 2 AS checks, CASE WHEN (SELECT warn FROM a) OR (SELECT warn FROM b) THEN 'READY WITH WARNINGS' ELSE 'READY' END AS verdict
""")
def readiness(spark, d):
    docs = table(spark, d, "documents")
    audit = joins.join_audit(docs, table(spark, d, "labels"), "doc_id", "doc_id").select(F.lit("join").alias("kind"), F.when(F.col("unmatched") > 0, "WARNING").otherwise("PASS").alias("status"))
    nulls = checks.check_nulls(docs.select("text"), 0.0).select(F.lit("nulls").alias("kind"), F.when(F.col("ok"), "PASS").otherwise("WARNING").alias("status"))
    return checks.readiness([audit, nulls])


@query("SELECT unnest(['rows', 'digest', 'definition', 'schema', 'values']) AS \"check\", true AS ok")
def validate_sample(spark, d):
    orders = table(spark, d, "orders")
    was = tables.table_digest(orders).first()
    return checks.validate_sample(orders, was["rows"], (was["digest_sum"], was["digest_xor"]), "v1", "v1", orders.schema, [FilterSpec("o_totalprice", ">=", 0)])


@query("""
    SELECT unnest(['rows', 'digest', 'definition', 'schema', 'values', 'refused']) AS "check", true AS ok, (SELECT count(*) FROM events WHERE value > 20 AND event_type <> 'view') AS kept
""")
def committed_sample(spark, d):
    """A sample with its manifest: written once, read back and validated."""
    folder, definition = new_path(spark, "samples"), {"filters": ["value > 20"], "exclude": ["event_type = view"], "columns": ["event_id", "event_type", "value"]}
    rows = table(spark, d, "events").filter("value > 20 and event_type <> 'view'").select(*definition["columns"])
    tables.commit_sample(rows, folder, "large", 1, definition)
    try:
        tables.commit_sample(rows, folder, "large", 1, definition)
        refused = False
    except ValueError:
        refused = True
    found = checks.validate_committed(spark, folder, "large", 1, definition, [FilterSpec("value", ">", 20)])
    kept = tables.committed_sample(spark, folder, "large", 1)[0].agg(F.count("*").alias("kept"))
    return found.union(spark.createDataFrame([("refused", refused)], found.schema)).join(F.broadcast(kept))  # one row


# ---- joins ----


@query("""
    SELECT c_custkey, c_nationkey, n_name, n_regionkey, r_name FROM customer
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def lookup_join(spark, d):
    out = joins.lookup_joins(table(spark, d, "customer"), [(table(spark, d, "nation"), "c_nationkey", "n_nationkey"), (table(spark, d, "region"), "n_regionkey", "r_regionkey")])
    return out.select("c_custkey", "c_nationkey", "n_name", "n_regionkey", "r_name")


@query("""
    SELECT count(*) AS rows_attempted, count(l.doc_id) AS matched, 0 AS null_keys, count(*) - count(l.doc_id) AS unmatched,
           round((count(*) - count(l.doc_id)) / count(*), 6) AS unmatched_rate, 0 AS duplicate_keys
    FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def join_audit(spark, d):
    return joins.join_audit(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "doc_id")


_LOOKUP = "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'Unknown' WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_name END AS district, n_regionkey AS zone FROM nation"


@query(f"""
    WITH lk AS ({_LOOKUP}), c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
    m AS (SELECT lk.*, coalesce(n, 0) AS n FROM lk LEFT JOIN c ON n_nationkey = c_nationkey)
    SELECT 'district' AS "column", CAST(sum(CASE WHEN district IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_count,
           CAST(sum(CASE WHEN district = 'Unknown' THEN n ELSE 0 END) AS BIGINT) AS sentinel_count,
           CAST(sum(CASE WHEN district IS NULL OR district = 'Unknown' THEN n ELSE 0 END) AS BIGINT) AS affected_rows,
           round(sum(CASE WHEN district IS NULL OR district = 'Unknown' THEN n ELSE 0 END) / sum(n), 6) AS affected_rate,
           list_sort(list(CAST(n_nationkey AS VARCHAR)) FILTER (district IS NULL OR district = 'Unknown')) AS affected_keys FROM m
    UNION ALL SELECT 'zone', 0, 0, 0, 0.0, []
""")
def lookup_value_audit(spark, d):
    k = F.col("n_nationkey")
    lk = table(spark, d, "nation").select("n_nationkey", F.when(k % 5 == 0, "Unknown").when(k % 7 != 0, F.col("n_name")).alias("district"), F.col("n_regionkey").alias("zone"))
    return joins.lookup_value_audit(table(spark, d, "customer"), lk, "c_nationkey", "n_nationkey", ["Unknown"])


@query("""
    SELECT 2 AS lookups, CAST(2 * (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS BIGINT) AS matched_events,
           CAST(2 * (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS BIGINT) AS unmatched_events
""")
def join_summary(spark, d):
    audit = joins.join_audit(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "doc_id")
    return joins.join_summary([audit, audit])


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def unmatched_rows(spark, d):
    return joins.unmatched_rows(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)")
def matched_rows(spark, d):
    return joins.matched_rows(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "doc_id").select("doc_id", "lang")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def join_filter_select(spark, d):
    out = joins.lookup_joins(table(spark, d, "supplier"), [(table(spark, d, "nation"), "s_nationkey", "n_nationkey"), (table(spark, d, "region"), "n_regionkey", "r_regionkey")])
    return members(out, "r_name", ["ASIA", "EUROPE"]).select("s_suppkey", "n_name", "r_name")


# ---- profiles ----


def _profile_sql(name: str, columns: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, round(count(DISTINCT {c}) / count(*), 4) AS identifier_score FROM {name}" for c, t in columns)


_CUSTOMER = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_mktsegment", "string")]


@query(_profile_sql("customer", _CUSTOMER))
def profile_table(spark, d):
    return profile.profile(table(spark, d, "customer").select(*[c for c, _ in _CUSTOMER]))


_LINES = [("l_orderkey", "bigint"), ("l_quantity", "double"), ("l_shipdate", "datetime")]


@query(f"""
    SELECT "column", dtype, CAST(nulls AS BIGINT) AS nulls, true AS close, CASE WHEN dtype = 'datetime' THEN NULL ELSE min_value END AS min_value, CASE WHEN dtype = 'datetime' THEN NULL ELSE max_value END AS max_value FROM ({_profile_sql('lineitem', _LINES)})
""")
def merged_profile(spark, d):
    li = table(spark, d, "lineitem").select(*[c for c, _ in _LINES])
    kept = new_path(spark, "sketches")
    for part in range(3):  # as if they were files that come one by one
        profile.sketch_columns(li.filter(F.col("l_orderkey") % 3 == part)).write.mode("append").parquet(kept)
    met = profile.merged_profile(spark.read.parquet(kept)).join(profile.distinct_counts(li).withColumnRenamed("distinct_count", "exact"), "column")
    number = F.col("dtype") != "datetime"
    close = F.abs(F.col("distinct_count") / F.col("exact") - 1) < 0.05
    return met.select("column", "dtype", "nulls", close.alias("close"), *[F.when(number, F.col(c)).alias(c) for c in ("min_value", "max_value")])


@query(f"SELECT \"column\", identifier_score FROM ({_profile_sql('customer', _CUSTOMER)}) WHERE identifier_score >= 0.95")
def identifier_columns(spark, d):
    return profile.identifier_columns(profile_table(spark, d))


@query("""
    SELECT 'o_orderkey' AS "column", 'numeric' AS kind, 'ignore' AS role UNION ALL SELECT 'o_orderdate', 'datetime', 'datetime'
    UNION ALL SELECT 'o_orderpriority', 'categorical', 'feature' UNION ALL SELECT 'day', 'datetime', 'datetime'
""")
def infer_columns(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return profile.infer_columns(o)


@query("""
    SELECT 'c_custkey' AS "column", 'bigint' AS dtype, 0 AS null_count, 'ignore' AS role UNION ALL SELECT 'c_nationkey', 'int', 0, 'feature'
    UNION ALL SELECT 'c_acctbal', 'double', count(*) FILTER (c_acctbal IS NULL), 'target' FROM customer
""")
def build_contract(spark, d):
    return profile.build_contract(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal", ignore=("c_custkey",))


def _diagnostics(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return profile.numeric_diagnostics(li, li.columns)


_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_MOMENTS = ", ".join(["count(x) AS n", "avg(x) AS m", "var_pop(x) AS v"])


def _diagnostics_sql(columns=_COLUMNS) -> str:
    one = "SELECT '{c}' AS \"column\", count(*) AS n_valid, 0 AS n_excluded, avg({c}) AS mean, stddev_pop({c}) AS std, avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END) AS zero_rate, avg(pow(({c} - m) / s, 3)) AS skew, avg(pow(({c} - m) / s, 4)) - 3 AS kurtosis, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.99) AS p99, min({c}) AS min_value, max({c}) AS max_value, count(DISTINCT {c}) AS distinct_count FROM lineitem, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem)"
    return " UNION ALL ".join(one.format(c=c) for c in columns)


_D = f"({_diagnostics_sql()})"


@query(f'SELECT "column", n_valid, n_excluded, round(mean, 4) AS mean, round(std, 4) AS std, round(zero_rate, 4) AS zero_rate, round(skew, 4) AS skew, round(kurtosis, 4) AS kurtosis, round(median, 4) AS median, round(p99, 4) AS p99, round(max_value, 4) AS max_value, distinct_count FROM {_D}')
def numeric_diagnostics(spark, d):
    return rounded(_diagnostics(spark, d).drop("min_value", "log_skew"), "mean", "std", "zero_rate", "skew", "kurtosis", "median", "p99", "max_value", digits=4)


@query(f"SELECT \"column\", list_filter([CASE WHEN zero_rate > 0.05 THEN 'zero_inflated' END, CASE WHEN skew > 1 THEN 'skewed' END, CASE WHEN kurtosis > 3 THEN 'heavy_tailed' END, CASE WHEN max_value / p99 > 10 THEN 'extreme_max' END], lambda x: x IS NOT NULL) AS flags FROM {_D}")
def diagnostic_flags(spark, d):
    return profile.diagnostic_flags(_diagnostics(spark, d))


@query(f"SELECT \"column\", CASE WHEN \"column\" = 'l_tax' THEN 'excluded: identifier' WHEN distinct_count <= 15 THEN 'discrete' ELSE 'continuous' END AS status, false AS id_like FROM {_D}")
def feature_status(spark, d):
    return profile.feature_status(_diagnostics(spark, d), ("l_tax",))


@query(f"""
    WITH long AS (UNPIVOT (SELECT "column", skew, kurtosis, zero_rate FROM {_D}) ON skew, kurtosis, zero_rate INTO NAME metric VALUE x)
    SELECT "column", metric, round(coalesce((x - avg(x) OVER (PARTITION BY metric)) / nullif(stddev_pop(x) OVER (PARTITION BY metric), 0), 0), 3) AS z FROM long
""")
def diagnostics_zscores(spark, d):
    return rounded(profile.zscores(_diagnostics(spark, d)), "z", digits=3)


@query(f"""
    WITH long AS (UNPIVOT (SELECT "column", zero_rate / 0.05 AS zero_rate, skew / 1.0 AS skew, kurtosis / 3.0 AS kurtosis, max_value / p99 / 10 AS tail FROM {_D}) ON zero_rate, skew, kurtosis, tail INTO NAME metric VALUE x)
    SELECT "column", metric, round(greatest(0.0, least(2.0, x)), 4) AS ratio, x > 1 AS exceeds FROM long
""")
def diagnostics_ratio(spark, d):
    return rounded(profile.limit_ratios(_diagnostics(spark, d)), "ratio", digits=4)


@query(f"""
    WITH long AS (UNPIVOT (SELECT "column", zero_rate, skew, kurtosis, max_value / p99 AS tail FROM {_D}) ON zero_rate, skew, kurtosis, tail INTO NAME metric VALUE x),
    r AS (SELECT metric, round(x, 6) AS x, CASE metric WHEN 'zero_rate' THEN 0.05 WHEN 'skew' THEN 1 WHEN 'kurtosis' THEN 3 ELSE 10 END AS top, "column" FROM long)
    SELECT metric, CAST(row_number() OVER (PARTITION BY metric ORDER BY x DESC, "column") AS INTEGER) AS rank, "column", x AS value, x > top AS exceeds FROM r
""")
def ranked_metrics(spark, d):
    return rounded(profile.ranked_metrics(_diagnostics(spark, d)), "value")


_CHOICE = "SELECT '{c}' AS \"column\", count({c}) AS n, min({c}) AS min_value, avg(pow(({c} - m) / s, 3)) AS skew FROM events, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM events)"


@query(f"""
    WITH e AS ({_CHOICE.format(c="value")} UNION ALL {_CHOICE.format(c="exp(value / 100)").replace("'exp(value / 100)'", "'grown'")} UNION ALL {_CHOICE.format(c="(value - 50)").replace("'(value - 50)'", "'centred'")})
    SELECT "column", n, round(min_value, 4) AS min_value, round(skew, 4) AS skew, n > 1 AND min_value > 0 AND skew > 1 AS show_log FROM e
""")
def log_choice(spark, d):
    e = table(spark, d, "events").select("value", F.exp(F.col("value") / 100).alias("grown"), (F.col("value") - 50).alias("centred"))
    return rounded(profile.log_choice(e, ["value", "grown", "centred"]), "min_value", "skew", digits=4)


@query(f'SELECT "column", round(p99 / median, 4) AS p99_to_median, round(max_value / median, 4) AS max_to_median FROM {_D}')
def tail_ratios(spark, d):
    return rounded(profile.tail_ratios(_diagnostics(spark, d)), "p99_to_median", "max_to_median", digits=4)


@query("""
    WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s, avg(ln(value)) AS lm, stddev_pop(ln(value)) AS ls, min(value) AS lo FROM events GROUP BY 1)
    SELECT event_type, count(*) AS n, round(avg(pow((value - m) / s, 3)), 4) AS skew, round(avg(pow((ln(value) - lm) / ls, 3)), 4) AS log_skew
    FROM events JOIN s USING (event_type) WHERE lo > 0 GROUP BY event_type
""")
def log_skews(spark, d):
    return rounded(profile.log_skews(table(spark, d, "events"), "event_type", "value"), "skew", "log_skew", digits=4)


@query("""
    WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1)
    SELECT c_mktsegment, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
           min(c_acctbal) FILTER (c_acctbal >= q1 - 1.5 * (q3 - q1)) AS low, max(c_acctbal) FILTER (c_acctbal <= q3 + 1.5 * (q3 - q1)) AS high
    FROM customer JOIN q USING (c_mktsegment) GROUP BY ALL
""")
def boxplot_stats(spark, d):
    return rounded(profile.boxplot_stats(table(spark, d, "customer"), "c_mktsegment", "c_acctbal"), "q1", "median", "q3", digits=4)


@query("""
    WITH s AS (SELECT count(*) AS n, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer),
    r AS (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rank, c_acctbal FROM customer)
    SELECT rank, n, round((c_acctbal - m) / s, 6) AS z,
           round(CASE WHEN rank = n THEN pow(0.5, 1.0 / n) WHEN rank = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (rank - 0.3175) / (n + 0.365) END, 8) AS position
    FROM r, s
""")
def qq_positions(spark, d):
    out = profile.ranked_positions(table(spark, d, "customer"), "c_acctbal", ["c_custkey"])
    return rounded(rounded(out, "z"), "position", digits=8).select("rank", "n", "z", "position")


@query(f"""
    WITH s AS (SELECT count(*) AS n, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem),
    r AS (SELECT row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS rank, l_extendedprice FROM lineitem),
    p AS (SELECT rank, n, (l_extendedprice - m) / s AS z, CASE WHEN rank = n THEN pow(0.5, 1.0 / n) WHEN rank = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (rank - 0.3175) / (n + 0.365) END AS position FROM r, s),
    t AS (SELECT rank, n, z, {norm_ppf_sql("position")} AS theoretical FROM p),
    l AS (SELECT regr_slope(z, theoretical) AS slope, regr_intercept(z, theoretical) AS intercept FROM t)
    SELECT rank, round(theoretical, 6) AS theoretical, round(z, 6) AS z, round(slope, 6) AS slope, abs(round(intercept, 6)) AS intercept
    FROM t, l WHERE n <= 1000 OR floor(ceil((rank - 1) / ((n - 1) / 999.0)) * ((n - 1) / 999.0)) = rank - 1
""")
def qq_points(spark, d):
    out = profile.qq_points(table(spark, d, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber"], 1000)
    return rounded(out, "theoretical", "z", "slope", "intercept").withColumn("intercept", F.abs("intercept"))  # no -0.0


@query("""
    WITH s AS (SELECT (quantile_cont(value, 0.25) - avg(value)) / stddev_pop(value) AS z1, (quantile_cont(value, 0.75) - avg(value)) / stddev_pop(value) AS z3 FROM events)
    SELECT round((z3 - z1) / (2 * 0.6744897501960817), 6) AS slope, round(z1 + (z3 - z1) / 2, 6) AS intercept FROM s
""")
def robust_line(spark, d):
    return rounded(profile.robust_line(table(spark, d, "events"), "value"), "slope", "intercept")


@query("""
    WITH s AS (SELECT count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS iqr FROM customer),
    b AS (SELECT lo, hi, CAST(ceil((hi - lo) / least((hi - lo) / (log2(n) + 1), 2 * iqr / pow(n, 1.0 / 3))) AS INTEGER) AS bins FROM s),
    c AS (SELECT CAST(least(bins - 1, floor((c_acctbal - lo) / (hi - lo) * bins)) AS INTEGER) AS bin, count(*) AS count FROM customer, b GROUP BY 1)
    SELECT i AS bin, round(lo + (hi - lo) / bins * i, 4) AS low, round(lo + (hi - lo) / bins * (i + 1), 4) AS high, coalesce(count, 0) AS count
    FROM (SELECT unnest(range(bins))::INTEGER AS i, lo, hi, bins FROM b) LEFT JOIN c ON i = bin
""")
def histogram_auto(spark, d):
    return rounded(profile.histogram_auto(table(spark, d, "customer"), "c_acctbal"), "low", "high", digits=4)


@query("""
    WITH c AS (SELECT CAST(p_size AS DOUBLE) AS value, count(*) AS count FROM part GROUP BY 1),
    w AS (SELECT value, count, lag(value) OVER (ORDER BY value) AS b, lead(value) OVER (ORDER BY value) AS a FROM c)
    SELECT value, coalesce((b + value) / 2, value - (a - value) / 2, value - 0.5) AS low, coalesce((a + value) / 2, value + (value - b) / 2, value + 0.5) AS high, count FROM w
""")
def histogram_discrete(spark, d):
    return profile.histogram_discrete(table(spark, d, "part"), "p_size")
