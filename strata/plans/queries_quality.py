"""Queries for contracts, rules, profiles, reconciliation and privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import privacy as G
from ..operators import profiling as P
from ..operators import quality as Q
from ..operators import reconcile as K
from .model import behaviour, customers, products, sales, sql, table
from .queries_model import facts
from .registry import query

ORDERS = Q.Contract(["order_id", "customer_id", "order_date"], ["order_id"], {"total_amount": (2000, 480000), "quantity": (1, None)}, [("customer_id", "customers", "customer_id"), ("product_id", "products", "product_id")])


@query("c01_orders_contract", sql("sales", """, t AS (SELECT count(*) AS total FROM sales)
SELECT rule, target, 'critical' AS severity, failed, total FROM (
SELECT 'not_null' AS rule, 'order_id' AS target, count(*) FILTER (order_id IS NULL) AS failed FROM sales UNION ALL
SELECT 'not_null', 'customer_id', count(*) FILTER (customer_id IS NULL) FROM sales UNION ALL
SELECT 'not_null', 'order_date', count(*) FILTER (order_date IS NULL) FROM sales UNION ALL
SELECT 'unique', 'order_id', count(*) - count(DISTINCT order_id) FROM sales UNION ALL
SELECT 'range', 'total_amount', count(*) FILTER (total_amount < 2000 OR total_amount > 480000) FROM sales UNION ALL
SELECT 'range', 'quantity', count(*) FILTER (quantity < 1) FROM sales UNION ALL
SELECT 'reference', 'customer_id', count(*) FILTER (customer_id IS NULL OR customer_id NOT IN (SELECT c_custkey FROM customer)) FROM sales UNION ALL
SELECT 'reference', 'product_id', count(*) FILTER (product_id IS NULL OR product_id NOT IN (SELECT p_partkey FROM part)) FROM sales), t"""))
def _(spark, d):
    return Q.check_contract(sales(spark, d), ORDERS, {"customers": customers(spark, d), "products": products(spark, d)})


RULES = [Q.Rule("positive", "balance"), Q.Rule("in_set", "region", "warning", values=["ASIA", "EUROPE", "AFRICA"]), Q.Rule("pattern", "customer_name", text="^Customer#[0-9]+$"), Q.Rule("expression", "segment_or_balance", "warning", text="segment <> 'BUILDING' OR balance > 1000")]


@query("c06_rule_set", sql("customers", """, t AS (SELECT count(*) AS total FROM customers)
SELECT rule, target, severity, failed, total FROM (
SELECT 'positive' AS rule, 'balance' AS target, 'critical' AS severity, count(*) FILTER (balance <= 0) AS failed FROM customers UNION ALL
SELECT 'in_set', 'region', 'warning', count(*) FILTER (region NOT IN ('ASIA', 'EUROPE', 'AFRICA')) FROM customers UNION ALL
SELECT 'pattern', 'customer_name', 'critical', count(*) FILTER (NOT regexp_matches(customer_name, '^Customer#[0-9]+$')) FROM customers UNION ALL
SELECT 'expression', 'segment_or_balance', 'warning', count(*) FILTER (NOT (segment <> 'BUILDING' OR balance > 1000)) FROM customers), t"""))
def _(spark, d):
    return Q.evaluate(customers(spark, d), RULES)


@query("c02_quarantine", sql("customers", "SELECT customer_id, list_filter([CASE WHEN balance <= 0 THEN 'positive:balance' END, CASE WHEN region NOT IN ('ASIA', 'EUROPE', 'AFRICA') THEN 'in_set:region' END, CASE WHEN segment = 'BUILDING' AND balance <= 1000 THEN 'expression:segment_or_balance' END], lambda x: x IS NOT NULL)::VARCHAR AS errors FROM customers"))
def _(spark, d):
    clean, bad = Q.quarantine(customers(spark, d), RULES)
    told = lambda e: F.concat(F.lit("["), F.concat_ws(", ", e), F.lit("]"))
    quoted = F.transform("_errors", lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return clean.select("customer_id", F.lit("[]").alias("errors")).unionByName(bad.select("customer_id", told(quoted).alias("errors")))


@query("c08_quality_gate", sql("customers", ", f AS (SELECT count(*) FILTER (balance <= 0) AS a, count(*) FILTER (region NOT IN ('ASIA', 'EUROPE', 'AFRICA')) AS b, count(*) FILTER (segment = 'BUILDING' AND balance <= 1000) AS c FROM customers) SELECT 4::BIGINT AS rules, (a > 0)::BIGINT AS critical_failed, (b > 0)::BIGINT + (c > 0)::BIGINT AS warning_failed, a = 0 AS passed FROM f"))
def _(spark, d):
    return Q.gate(customers(spark, d), RULES)


@query("c11_thresholds", "SELECT count(*) AS row_count, greatest(avg((user_id IS NULL)::INTEGER), avg((value IS NULL)::INTEGER)) AS max_null_share, round((epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(ts)))) / 3600.0, 4) AS age_hours, (count(*) - count(DISTINCT event_id)) / count(*)::DOUBLE AS duplicate_share FROM events")
def _(spark, d):
    return Q.thresholds(table(spark, d, "events"), ["event_id"], ["user_id", "value"], "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query("c15_semantic_checks", "SELECT 'not_future' AS rule, 'ts' AS target, 'critical' AS severity, count(*) FILTER (ts > TIMESTAMP '2024-01-15') AS failed, count(*) AS total FROM events UNION ALL SELECT 'max_length', 'event_type', 'critical', count(*) FILTER (length(event_type) > 6), count(*) FROM events")
def _(spark, d):
    return Q.evaluate(table(spark, d, "events"), [Q.Rule("not_future", "ts"), Q.Rule("max_length", "event_type", high=6)], as_of=F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


def _profile_sql(columns: dict[str, bool], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS \"distinct\", {f'round(avg({c}), 4)' if n else 'NULL::DOUBLE'} AS mean FROM {source}" for c, n in columns.items())


@query("c17_column_profile", sql("sales", _profile_sql({"customer_id": True, "quantity": True, "status": False, "priority": False}, "sales")))
def _(spark, d):
    return P.profile(sales(spark, d), ["customer_id", "quantity", "status", "priority"], approximate=False).select("column_name", "row_count", "nulls", "distinct", F.round("mean", 4).alias("mean"))


@query("c17_top_values", sql("sales", "SELECT * FROM (SELECT 'status' AS column_name, status AS value, count(*) AS count FROM sales GROUP BY 2 UNION ALL SELECT 'priority', priority, count(*) FROM sales GROUP BY 2) QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) <= 3"))
def _(spark, d):
    return P.top_values(sales(spark, d), ["status", "priority"], 3)


@query("a14_statistics", "SELECT 'l_quantity' AS column_name, count(l_quantity) AS n, round(avg(l_quantity), 4) AS mean, round(stddev(l_quantity), 4) AS stddev, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem UNION ALL SELECT 'l_discount', count(l_discount), round(avg(l_discount), 4), round(stddev(l_discount), 4), min(l_discount), max(l_discount) FROM lineitem")
def _(spark, d):
    return P.statistics(table(spark, d, "lineitem"), ["l_quantity", "l_discount"]).select("column_name", "n", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "min", "max")


@query("a16_correlations", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def _(spark, d):
    return P.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", F.round("corr", 6).alias("corr"))


@query("c18_quality_score", "SELECT count(*) AS n, 1.0::DOUBLE AS completeness, count(DISTINCT (l_orderkey, l_linenumber)) / count(*)::DOUBLE AS uniqueness, round(0.6 + 0.4 * count(DISTINCT (l_orderkey, l_linenumber)) / count(*)::DOUBLE, 6) AS score FROM lineitem")
def _(spark, d):
    return P.quality_score(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_quantity"])


@query("c19_outliers", "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS is_outlier FROM events, q")
def _(spark, d):
    return P.outliers(table(spark, d, "events"), "value").select("event_id", "is_outlier")


@query("c19_outliers_zscore", "WITH q AS (SELECT avg(value) AS m, stddev(value) AS s FROM events) SELECT event_id, value < m - 3 * s OR value > m + 3 * s AS is_outlier FROM events, q")
def _(spark, d):
    return P.outliers(table(spark, d, "events"), "value", "zscore", 3.0).select("event_id", "is_outlier")


@query("c20_drift", "WITH a AS (SELECT avg(value) AS m, count(DISTINCT user_id) AS u FROM events WHERE ts < TIMESTAMP '2024-01-16'), b AS (SELECT avg(value * 2) AS m, count(DISTINCT user_id) AS u FROM events WHERE ts >= TIMESTAMP '2024-01-16') SELECT 'value' AS column_name, round(abs(b.m - a.m) / a.m, 4) AS mean_change, true AS drifted FROM a, b")
def _(spark, d):
    e = table(spark, d, "events")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    old, new = e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut).withColumn("value", F.col("value") * 2)
    return P.drift(P.profile(old, ["value"], False), P.profile(new, ["value"], False)).select("column_name", F.round("mean_change", 4).alias("mean_change"), "drifted")


@query("a19_key_skew", "SELECT count(*) AS keys, max(n) AS most, round(avg(n), 4) AS mean, round(max(n) / avg(n), 4) AS ratio, max(n) / avg(n) > 10 AS skewed FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def _(spark, d):
    return P.skew(table(spark, d, "documents"), "source").select("keys", "most", F.round("mean", 4).alias("mean"), F.round("ratio", 4).alias("ratio"), "skewed")


@query("a20_control_total", sql("sales", "SELECT round(sum(total_amount), 2) AS actual, 1000000.0::DOUBLE AS expected, round(abs(sum(total_amount) - 1000000.0) * 100 / 1000000.0, 2) AS diff_pct, abs(sum(total_amount) - 1000000.0) * 100 / 1000000.0 <= 1 AS passed FROM sales"))
def _(spark, d):
    return K.control_total(sales(spark, d), "total_amount", 1_000_000, 1.0).select(F.round("actual", 2).alias("actual"), "expected", F.round("diff_pct", 2).alias("diff_pct"), "passed")


@query("st10_stream_fitness", sql("behaviour", ", m AS (SELECT *, epoch_us(event_ts) / 1e6 - lag(epoch_us(event_ts) / 1e6) OVER (PARTITION BY session_id ORDER BY event_ts, event_id) AS gap, lag(event_ts) OVER (PARTITION BY session_id ORDER BY event_id) AS before, max(event_ts) OVER (PARTITION BY session_id ORDER BY event_id) AS seen FROM behaviour) SELECT count(*) AS events, count(DISTINCT event_type) AS kinds, count(DISTINCT session_id) AS sessions, count(*) FILTER (gap > 1800) AS long_gaps, count(*) FILTER (event_ts < seen - INTERVAL 1 HOUR) AS late, count(*) FILTER (event_ts < before) AS out_of_order FROM m"))
def _(spark, d):
    return P.stream_fitness(behaviour(spark, d), "event_id", "event_ts", "event_type", "session_id")


@query("c22_keys_reconciled", "SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS matched, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_left, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS only_right")
def _(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return K.keys_reconciled(left, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("c23_reconciled_by_grain", sql("sales", "SELECT order_date, round(sum(total_amount), 2) AS left_total_amount, round(sum(CASE WHEN order_id % 50 = 0 THEN total_amount + 1 ELSE total_amount END), 2) AS right_total_amount, count(*) FILTER (order_id % 50 = 0) = 0 AS within FROM sales GROUP BY 1"))
def _(spark, d):
    s = sales(spark, d)
    other = s.withColumn("total_amount", F.when(F.col("order_id") % 50 == 0, F.col("total_amount") + 1).otherwise(F.col("total_amount")))
    return K.reconciled(s, other, ["order_date"], "total_amount").select("order_date", *[F.round(c, 2).alias(c) for c in ("left_total_amount", "right_total_amount")], "within")


@query("t02_worst_mismatches", sql("sales", ", g AS (SELECT customer_id, sum(CASE WHEN order_id % 50 = 0 THEN -order_id ELSE 0 END) AS diff FROM sales GROUP BY 1) SELECT customer_id, round(diff, 2)::DOUBLE AS diff FROM g ORDER BY abs(diff) DESC, customer_id LIMIT 5"))
def _(spark, d):
    s = sales(spark, d).select("order_id", "customer_id", F.round("total_amount").cast("long").alias("amount"))
    other = s.withColumn("amount", F.when(F.col("order_id") % 50 == 0, F.col("amount") + F.col("order_id")).otherwise(F.col("amount")))
    return K.reconciled(s, other, ["customer_id"], "amount", worst=5).select("customer_id", F.col("diff_amount").cast("double").alias("diff"))


@query("c24_table_fingerprint")
def _(spark, d):
    return K.fingerprint(table(spark, d, "orders"))


@query("c24_fingerprint_of_changes", "SELECT count(*) AS row_count, true AS same_in_another_order, true AS differs_after_a_change FROM orders")
def _(spark, d):
    orders = table(spark, d, "orders")
    again = K.fingerprint(orders.repartition("o_custkey")).toDF("n1", "x1", "s1")
    last = orders.agg(F.max("o_orderkey").alias("last"))
    edited = orders.join(F.broadcast(last)).withColumn("o_totalprice", F.when(F.col("o_orderkey") == F.col("last"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).drop("last")
    changed = K.fingerprint(edited).toDF("n2", "x2", "s2")
    same = (F.col("row_count") == F.col("n1")) & (F.col("hash_xor") == F.col("x1")) & (F.col("hash_sum") == F.col("s1"))
    return K.fingerprint(orders).join(again).join(changed).select("row_count", same.alias("same_in_another_order"), ((F.col("hash_xor") != F.col("x2")) & (F.col("hash_sum") != F.col("s2"))).alias("differs_after_a_change"))


@query("c26_join_integrity", sql("sales", "SELECT count(*) AS facts, 0::BIGINT AS unmatched, count(*) FILTER (product_id IS NULL) AS unknown, round(1 - count(*) FILTER (product_id IS NULL) / count(*)::DOUBLE, 6) AS joined_share FROM sales"))
def _(spark, d):
    return K.join_integrity(facts(spark, d), products(spark, d), "product_key", "product_id").withColumn("joined_share", F.round("joined_share", 6))


@query("c29_whole_row_duplicates", "SELECT (SELECT count(*) FROM documents) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)) AS distinct_rows, (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)) AS duplicates")
def _(spark, d):
    return K.whole_duplicates(table(spark, d, "documents"))


@query("c29_repeated_kinds", "SELECT count(*) AS row_count, count(DISTINCT (lang, source)) AS distinct_rows, count(*) - count(DISTINCT (lang, source)) AS duplicates FROM documents")
def _(spark, d):
    return K.whole_duplicates(table(spark, d, "documents").select("lang", "source"))


# --- privacy ------------------------------------------------------------------------------------------------------

_MASKS = {"email": "substr(email, 1, 1) || '***' || regexp_extract(email, '(@.*)$', 1)", "phone": "'***-***-' || right(regexp_replace(phone, '[^0-9]', '', 'g'), 4)", "name": "substr(name, 1, 1) || repeat('*', CAST(length(name) - 1 AS INTEGER))"}
_PEOPLE = "people AS (SELECT c_custkey AS customer_id, c_name AS name, 'user' || c_custkey || '@' || lower(c_mktsegment) || '.example' AS email, '+1-555-' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS phone FROM customer)"


def people(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    pad = lambda n: F.lpad((k % 10**n).cast("string"), n, "0")
    return c.select(k.alias("customer_id"), F.col("c_name").alias("name"), F.concat(F.lit("user"), k.cast("string"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example")).alias("email"), F.concat(F.lit("+1-555-"), pad(3), F.lit("-"), pad(4)).alias("phone"))


@query("g01_masking", f"WITH {_PEOPLE} SELECT customer_id, {_MASKS['email']} AS email, {_MASKS['phone']} AS phone, {_MASKS['name']} AS name FROM people")
def _(spark, d):
    return G.masked(people(spark, d), {"email": "email", "phone": "phone", "name": "name"})


@query("g02_salted_hash", f"WITH {_PEOPLE} SELECT customer_id, sha256('pepper' || email) AS email_hash FROM people")
def _(spark, d):
    return people(spark, d).select("customer_id", G.hashed(F.col("email"), "pepper").alias("email_hash"))


@query("g03_masking_by_name", f"WITH {_PEOPLE} SELECT customer_id, {_MASKS['email']} AS email, {_MASKS['phone']} AS phone, {_MASKS['name']} AS name, DATE '2024-01-01' AS _masked_at, 'v1' AS _mask_version FROM people")
def _(spark, d):
    return G.masked_by_name(people(spark, d), F.lit("2024-01-01").cast("date"))


def _pii_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{p}' AS pii_type, count(*) FILTER (regexp_matches({c}, '{x}')) AS matches, round(count(*) FILTER (regexp_matches({c}, '{x}')) / count(*)::DOUBLE, 6) AS share FROM {source}" for c in columns for p, x in G.PATTERNS.items())


@query("g05_pii_report", " ".join(_pii_sql("documents", ["text", "source"]).split("\n")))
def _(spark, d):
    return G.pii_report(table(spark, d, "documents"), ["text", "source"]).withColumn("share", F.round("share", 6))


@query("g05_pii_conversations", _pii_sql("conversations", ["text"]))
def _(spark, d):
    return G.pii_report(table(spark, d, "conversations"), ["text"]).withColumn("share", F.round("share", 6))


@query("g06_classification", "SELECT * FROM (VALUES ('c_custkey', 'public'), ('c_name', 'confidential'), ('c_nationkey', 'public'), ('c_acctbal', 'internal'), ('c_mktsegment', 'public')) v(column_name, sensitivity) WHERE (SELECT count(*) FROM customer) > 0")
def _(spark, d):
    return G.classify(table(spark, d, "customer"))


@query("g07_anonymize", "SELECT c_custkey, sha256('s' || c_name) AS c_name, CAST(floor(c_acctbal / 100) * 100 AS BIGINT) AS c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer")
def _(spark, d):
    return G.anonymize(table(spark, d, "customer").drop("c_nationkey"), {"c_name": "confidential", "c_acctbal": "internal", "c_mktsegment": "restricted"}, "s")


@query("ud02_ssn_and_ip", "SELECT c_custkey, '***-**-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS ssn, '10.' || (c_custkey % 256) || '.*.*' AS ip, substr(c_name, 1, 2) || repeat('*', CAST(length(c_name) - 2 AS INTEGER)) AS partial FROM customer")
def _(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    ssn = F.concat(F.lit("123-45-"), F.lpad((k % 10000).cast("string"), 4, "0"))
    ip = F.concat(F.lit("10."), (k % 256).cast("string"), F.lit(".0.7"))
    return c.select("c_custkey", G.mask_ssn(ssn).alias("ssn"), G.mask_ip(ip).alias("ip"), G.mask_partial(F.col("c_name")).alias("partial"))
