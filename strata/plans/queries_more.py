"""Further queries: one for each inventory row the other modules do not show by itself."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import expr as X
from ..functions import privacy as G
from ..operators import currency as C
from ..operators import history as H
from ..operators import profiling as P
from ..operators import quality as Q
from ..operators import relational as R
from ..sources import readers as S
from . import crm, marts as M
from .model import behaviour, customers, fx, products, sales, sql, table
from .queries_model import facts, r2
from .registry import QUERIES, query

# --- projections ----------------------------------------------------------------------------------------------------


@query("p02_coalesced_columns", "SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS label FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("first", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")))
    return o.select(F.col("o_orderkey").alias("order_id"), X.coalesced(o, ["absent", "first", "O_ORDERSTATUS"]).alias("label"))


@query("p03_missing_columns", "SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS phone FROM customer")
def _(spark, d):
    return X.with_missing(table(spark, d, "customer").select("c_custkey", "c_name"), {"score": "double", "phone": "string", "c_name": "string"})


@query("p04_align_to_contract", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_acctbal AS c_acctbal, CAST(NULL AS INTEGER) AS c_age, '{\"c_mktsegment\":\"' || c_mktsegment || '\"}' AS extra FROM customer")
def _(spark, d):
    schema = StructType([StructField("c_custkey", StringType()), StructField("c_acctbal", DoubleType()), StructField("c_age", IntegerType())])
    return X.align(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), schema, "extra")


ACCOUNTS = "SELECT c_custkey AS account_id, c_name AS account_name, lower(c_mktsegment) AS industry, 'NATION_' || c_nationkey AS country, c_acctbal AS annual_revenue FROM customer"


def accounts(spark, d):
    c = table(spark, d, "customer")
    return crm.accounts_silver(c.select(F.col("c_custkey").alias("Id"), F.concat(F.lit(" "), F.col("c_name")).alias("Name"), F.col("c_mktsegment").alias("Industry"), F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("BillingCountry"), F.col("c_acctbal").cast("string").alias("AnnualRevenue"), F.lit("2024-01-01").alias("CreatedDate")))


def contacts(spark, d):
    s = table(spark, d, "supplier")
    return crm.contacts_silver(s.select(F.col("s_suppkey").alias("ContactId"), (F.col("s_suppkey") * 2).alias("AccountId"), F.col("s_name").alias("FirstName"), F.upper(F.concat(F.col("s_name"), F.lit("@X.ORG"))).alias("Email"), F.concat(F.lit("(555) "), F.col("s_suppkey").cast("string")).alias("Phone"), F.lit("02/03/2024").alias("CreatedDate")))


def opportunities(spark, d):
    o = table(spark, d, "orders")
    return crm.opportunities_silver(o.select(F.col("o_orderkey").alias("Id"), F.col("o_custkey").alias("AccountId"), (F.col("o_orderkey") % 1000).alias("ContactId"), F.col("o_orderstatus").alias("StageName"), F.col("o_totalprice").alias("Amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("CloseDate")))


@query("p08_crm_accounts", f"SELECT account_id, account_name, industry, country, annual_revenue, 'unknown' AS account_type, DATE '2024-01-01' AS created_date FROM ({ACCOUNTS})")
def _(spark, d):
    return accounts(spark, d)


@query("p09_crm_contacts", "SELECT s_suppkey AS contact_id, s_suppkey * 2 AS account_id, s_name AS first_name, CAST(NULL AS VARCHAR) AS last_name, lower(s_name) || '@x.org' AS email, '555' || s_suppkey AS phone, DATE '2024-02-03' AS created_date FROM supplier")
def _(spark, d):
    return contacts(spark, d)


@query("p10_crm_opportunities", "SELECT o_orderkey AS opportunity_id, o_custkey AS account_id, o_orderkey % 1000 AS contact_id, lower(o_orderstatus) AS stage, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS close_date FROM orders")
def _(spark, d):
    return opportunities(spark, d)


def account_dim(spark, d):
    """Accounts by the day they were created; all have one version here."""
    return M.type2_dimension(accounts(spark, d), "account_id", "created_date", "account_key")


def contact_dim(spark, d):
    return M.type2_dimension(contacts(spark, d), "contact_id", "created_date", "contact_key")


_ACCOUNT_KEY, _CONTACT_KEY = "sha256({0} || '||2024-01-01')", "sha256({0} || '||2024-02-03')"


@query("d04_contact_dimension", f"SELECT s_suppkey AS contact_id, CASE WHEN s_suppkey * 2 IN (SELECT c_custkey FROM customer) THEN {_ACCOUNT_KEY.format('(s_suppkey * 2)')} ELSE '-1' END AS account_key FROM supplier")
def _(spark, d):
    return crm.contact_dimension(contacts(spark, d), account_dim(spark, d)).select("contact_id", "account_key")


@query(
    "m03_fact_opportunity",
    f"SELECT o_orderkey AS opportunity_id, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN {_ACCOUNT_KEY.format('o_custkey')} ELSE '-1' END AS account_key, CASE WHEN o_orderkey % 1000 IN (SELECT s_suppkey FROM supplier) THEN {_CONTACT_KEY.format('(o_orderkey % 1000)')} ELSE '-1' END AS contact_key,"
    " o_totalprice AS amount, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS close_date_key, year(o_orderdate) AS close_year, month(o_orderdate) AS close_month FROM orders",
)
def _(spark, d):
    return crm.fact_opportunity(opportunities(spark, d), account_dim(spark, d), contact_dim(spark, d)).select("opportunity_id", "account_key", "contact_key", "amount", "close_date_key", "close_year", "close_month")


@query("p13_fx_projection", sql("fx", "SELECT rate_date, base_ccy, quote_ccy, rate, CAST(NULL AS VARCHAR) AS source FROM fx WHERE day(rate_date) <> 13"))
def _(spark, d):
    raw = fx(spark, d).select(F.date_format("rate_date", "MM/dd/yyyy").alias("trade_date"), F.lower("base_ccy").alias("base_currency"), F.concat(F.col("quote_ccy"), F.lit(" ")).alias("counter_ccy"), F.when(F.dayofmonth("rate_date") == 13, "-1").otherwise(F.col("rate").cast("string")).alias("exchange_rate"))
    return S.canonical_fx(raw)


@query("p15_flatten_struct", "SELECT event_id, event_type AS payment_method, CAST(value AS VARCHAR) AS payment_status FROM events WHERE event_type = 'purchase'")
def _(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'")
    nested = e.select("event_id", F.struct(F.col("event_type").alias("method"), F.col("value").cast("string").alias("status")).alias("payment"))
    return nested.select("event_id", F.col("payment.method").alias("payment_method"), F.col("payment.status").alias("payment_status"))


@query("p17_rename_and_parse", "SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS ordered FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return X.renamed(o, {"o_orderkey": "order_id", "o_custkey": "customer_id", "o_orderdate": "ordered"}).withColumn("ordered", X.parsed_date(F.col("ordered")))


@query("p25_salted_aggregate", "SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY 1")
def _(spark, d):
    salted = table(spark, d, "documents").withColumn("salt", X.salt(F.col("doc_id"), 16))
    part = salted.groupBy("source", "salt").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return part.groupBy("source").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


@query("p27_row_keys")
def _(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", X.row_key(c).alias("row_key"))


@query("p27_row_keys_tell_rows_apart", "SELECT count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS keys, 64 AS shortest, 64 AS longest FROM customer")
def _(spark, d):
    keys = QUERIES["p27_row_keys"](spark, d).groupBy("row_key").agg(F.count("*").alias("n"))
    return keys.agg(F.sum("n").alias("row_count"), F.count("*").alias("keys"), F.min(F.length("row_key")).alias("shortest"), F.max(F.length("row_key")).alias("longest"))


# --- filters, joins, windows, sets ----------------------------------------------------------------------------------


@query("f04_positive_amounts", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def _(spark, d):
    return table(spark, d, "customer").where(F.col("c_acctbal") > 0).select("c_custkey", "c_acctbal")


@query("f07_current_versions", sql("sales", "SELECT customer_id, status FROM (SELECT customer_id, order_date, max(status) AS status FROM sales GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC) = 1"))
def _(spark, d):
    from .queries_model import status_history

    return status_history(spark, d).where("is_current").select("customer_id", "status")


@query("j04_composite_key_join", sql("sales fx rates", "SELECT order_id, s.currency, round(usd_rate, 8) AS usd_rate FROM sales s LEFT JOIN rates r ON order_date = rate_date AND s.currency = r.currency"))
def _(spark, d):
    from ..operators.currency import usd_rates

    s, r = sales(spark, d), usd_rates(fx(spark, d))
    return s.join(r, (s["order_date"] == r["rate_date"]) & (s["currency"] == r["currency"]), "left").select("order_id", s["currency"], F.round("usd_rate", 8).alias("usd_rate"))


@query("j09_overlapping_versions", sql("sales", "SELECT a.order_id FROM sales a WHERE EXISTS (SELECT 1 FROM sales b WHERE a.customer_id = b.customer_id AND (b.order_date, b.order_id) < (a.order_date, a.order_id) AND b.order_date + 30 > a.order_date)"))
def _(spark, d):
    # every order opens a version of 30 days
    s = sales(spark, d).select("order_id", "customer_id", F.concat(F.date_format("order_date", "yyyy-MM-dd"), F.lpad(F.col("order_id").cast("string"), 10, "0")).alias("start"), F.date_format(F.date_add("order_date", 30), "yyyy-MM-dd").alias("until"))
    return H.overlapping(s, ["customer_id"], "start", "until").select("order_id")


@query("j10_compared_to_current", sql("customers", "SELECT customer_id, CASE WHEN customer_id % 10 = 0 THEN 'new' WHEN customer_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM customers"))
def _(spark, d):
    c = customers(spark, d).select("customer_id", "segment", "country")
    old = c.where("customer_id % 10 <> 0").withColumn("segment", F.when(F.col("customer_id") % 3 == 0, "OLD").otherwise(F.col("segment")))
    return H.compared(c, old, "customer_id", ["segment", "country"]).select("customer_id", "state")


@query("j11_date_dimension_join", sql("sales", "SELECT strftime(order_date, '%Y%m') AS year_month, count(*) AS orders FROM sales GROUP BY 1"))
def _(spark, d):
    s = sales(spark, d)
    days = M.date_dimension(s, "order_date").select("date", "year_month")
    return s.join(days, s["order_date"] == days["date"]).groupBy("year_month").agg(F.count("*").alias("orders"))


@query("a02_behaviour_per_customer", sql("behaviour", "SELECT customer_id, round(sum(amount), 2) AS event_value, count(DISTINCT session_id) AS sessions, count(*) AS events FROM behaviour GROUP BY 1"))
def _(spark, d):
    return M.behaviour_metrics(behaviour(spark, d)).select("customer_id", *r2("event_value"), "sessions", "events")


@query("a09_customer_and_product_metrics", sql("customers sales", "SELECT segment, count(DISTINCT customer_id) AS customers, count(order_id) AS orders, count(DISTINCT product_id) AS products FROM customers LEFT JOIN sales USING (customer_id) GROUP BY 1"))
def _(spark, d):
    return customers(spark, d).join(sales(spark, d), "customer_id", "left").groupBy("segment").agg(F.count_distinct("customer_id").alias("customers"), F.count("order_id").alias("orders"), F.count_distinct("product_id").alias("products"))


@query("a15_quartiles", "SELECT l_returnflag, quantile_disc(l_quantity, 0.25) AS q1, quantile_disc(l_quantity, 0.5) AS median, quantile_disc(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1")
def _(spark, d):
    q = F.percentile_approx("l_quantity", [0.25, 0.5, 0.75], 100000)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(q.alias("q")).select("l_returnflag", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


@query("a21_totals_of_360", sql("customers sales fx rates usd", "SELECT (SELECT count(*) FROM customers) AS customers, round(sum(amount_usd), 0) AS revenue_usd, count(*) AS orders FROM usd WHERE customer_id IN (SELECT customer_id FROM customers)"))
def _(spark, d):
    whole = M.customer_360(customers(spark, d), facts(spark, d), None)
    return whole.agg(F.count("*").alias("customers"), F.round(F.sum("revenue_usd"), 0).alias("revenue_usd"), F.sum("orders").alias("orders"))


@query("w02_latest_with_ties", "SELECT l_orderkey, l_partkey, l_extendedprice FROM (SELECT DISTINCT l_orderkey, l_partkey, l_extendedprice, l_shipdate FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC NULLS LAST, l_extendedprice DESC, l_partkey DESC) = 1")
def _(spark, d):
    return R.latest(table(spark, d, "lineitem"), ["l_orderkey"], R.newest("l_shipdate", "l_extendedprice", "l_partkey")).select("l_orderkey", "l_partkey", "l_extendedprice")


@query("w08_source_wins", sql("customers", "SELECT customer_id, CASE WHEN customer_id % 4 = 0 THEN 'fresh' ELSE segment END AS segment FROM customers"))
def _(spark, d):
    c = customers(spark, d).select("customer_id", "segment").withColumn("ts", F.lit(1))
    return H.one_per_key([c.where("customer_id % 4 = 0").withColumn("segment", F.lit("fresh")), c], ["customer_id"], ["ts"]).select("customer_id", "segment")


@query("t04_ordered_dimension", sql("products", "SELECT product_id, product_name FROM products ORDER BY product_id"))
def _(spark, d):
    return products(spark, d).select("product_id", "product_name").orderBy("product_id")


@query("t05_history_of_one_key", sql("sales", ", v AS (SELECT customer_id, order_date AS start, max(status) AS status FROM sales GROUP BY 1, 2), n AS (SELECT *, lag(status) OVER (PARTITION BY customer_id ORDER BY start) AS before FROM v) SELECT status, start AS effective_from FROM n WHERE customer_id = 10 AND (before IS NULL OR before <> status)"))
def _(spark, d):
    from .queries_model import status_history

    return H.history_of(status_history(spark, d), "customer_id", 10).select("status", "effective_from")


@query("u03_counts_of_tables", "SELECT 'orders' AS table_name, count(*) AS row_count FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'part', count(*) FROM part")
def _(spark, d):
    return R.counted({t: table(spark, d, t) for t in ("orders", "lineitem", "part")})


# --- history, silver, marts -----------------------------------------------------------------------------------------


@query("h05_version_numbers", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER) AS version FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def _(spark, d):
    return H.version_numbers(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey"], "l_linenumber")


@query("h09_multi_source", "SELECT coalesce(c_custkey, user_id) AS customer_id, c_name AS name, coalesce(n, 0) AS events FROM customer FULL JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON c_custkey = user_id")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.lit(2).alias("ts"))
    e = table(spark, d, "events").select(F.col("user_id").alias("customer_id"), F.lit(1).alias("ts"))
    counts = e.groupBy("customer_id").agg(F.count("*").alias("events"))
    return H.one_per_key([c, e], ["customer_id"], ["ts"]).join(counts, "customer_id", "left").select("customer_id", "name", F.coalesce("events", F.lit(0)).alias("events"))


@query("b03_fx_silver", sql("fx", "SELECT rate_date, base_ccy, quote_ccy, rate FROM fx"))
def _(spark, d):
    rates = fx(spark, d)
    older = rates.withColumns({"rate": F.col("rate") * 2, "seen": F.lit(0)})
    both = rates.withColumn("seen", F.lit(1)).unionByName(older).unionByName(older.withColumn("rate", F.lit(-1.0)).withColumn("seen", F.lit(2)))
    return R.latest(both.where("rate > 0"), ["rate_date", "base_ccy", "quote_ccy"], R.newest("seen")).drop("seen")


@query("b09_events_with_orders", sql("behaviour sales", "SELECT event_id, o.order_id, o.status FROM behaviour b LEFT JOIN (SELECT * FROM sales QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_id DESC) = 1) o USING (customer_id)"))
def _(spark, d):
    last = R.latest(sales(spark, d), ["customer_id"], R.newest("order_date", "order_id")).select("customer_id", "order_id", "status")
    return behaviour(spark, d).join(last, "customer_id", "left").select("event_id", "order_id", "status")


_VERSIONED = "SELECT {0} AS {1}, sha256({0} || '||' || strftime(order_date, '%Y-%m-%d')) AS {2}, order_date AS effective_from, lead(order_date) OVER (PARTITION BY {0} ORDER BY order_date) IS NULL AS is_current FROM (SELECT DISTINCT {0}, order_date FROM sales WHERE {0} IS NOT NULL)"


@query("d02_product_dimension", sql("sales products", ", v AS (" + _VERSIONED.format("product_id", "product_id", "product_key") + ") SELECT v.*, category FROM v JOIN products USING (product_id)"))
def _(spark, d):
    seen = sales(spark, d).select("product_id", "order_date").join(products(spark, d).select("product_id", "category"), "product_id")
    return M.type2_dimension(seen, "product_id", "order_date", "product_key").select("product_id", "product_key", "effective_from", "is_current", "category")


@query("d03_account_dimension", sql("sales", ", v AS (" + _VERSIONED.format("customer_id", "account_id", "account_key") + ") SELECT v.*, lower(c_mktsegment) AS industry FROM v JOIN customer ON c_custkey = account_id"))
def _(spark, d):
    seen = sales(spark, d).select(F.col("customer_id").cast("string").alias("account_id"), "order_date").join(accounts(spark, d).select("account_id", "industry"), "account_id")
    return M.type2_dimension(seen, "account_id", "order_date", "account_key").select(F.col("account_id").cast("long").alias("account_id"), "account_key", "effective_from", "is_current", "industry")


@query("d04_contact_versions", "WITH v AS (SELECT DISTINCT l_suppkey AS contact_id, date_trunc('month', l_shipdate)::DATE AS start FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) SELECT contact_id, sha256(contact_id || '||' || strftime(start, '%Y-%m-%d')) AS contact_key, start AS effective_from, lead(start) OVER (PARTITION BY contact_id ORDER BY start) IS NULL AS is_current FROM v")
def _(spark, d):
    seen = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("contact_id"), F.trunc("l_shipdate", "month").alias("start")).join(contacts(spark, d).select("contact_id"), "contact_id")
    return M.type2_dimension(seen, "contact_id", "start", "contact_key").select(F.col("contact_id").cast("long").alias("contact_id"), "contact_key", "effective_from", "is_current")


@query("d08_type1_dimension", sql("customers", "SELECT customer_id, customer_name, coalesce(region, 'unknown') AS region FROM customers"))
def _(spark, d):
    return customers(spark, d).select("customer_id", "customer_name", X.filled(F.col("region"), "unknown").alias("region"))


@query("m04_sales_star", sql("sales customers products", "SELECT region, category, year(order_date) AS year, count(*) AS orders, round(sum(total_amount), 2) AS revenue FROM sales LEFT JOIN customers USING (customer_id) LEFT JOIN products USING (product_id) GROUP BY ALL"))
def _(spark, d):
    s = sales(spark, d).join(customers(spark, d), "customer_id", "left").join(products(spark, d), "product_id", "left")
    return s.groupBy("region", "category", F.year("order_date").alias("year")).agg(F.count("*").alias("orders"), F.round(F.sum("total_amount"), 2).alias("revenue"))


@query("m11_customer_showcase", sql("sales", "SELECT customer_id, count(*) AS orders, round(sum(total_amount), 2) AS revenue, max(order_date) AS last_order FROM sales GROUP BY 1 ORDER BY revenue DESC, customer_id"))
def _(spark, d):
    return sales(spark, d).groupBy("customer_id").agg(F.count("*").alias("orders"), F.round(F.sum("total_amount"), 2).alias("revenue"), F.max("order_date").alias("last_order")).orderBy(F.desc("revenue"), "customer_id")


# --- quality --------------------------------------------------------------------------------------------------------


_WANTED = "(VALUES ('o_orderkey', 'BIGINT'), ('o_custkey', 'BIGINT'), ('o_orderstatus', 'VARCHAR'), ('o_totalprice', 'DOUBLE'), ('o_orderdate', 'VARCHAR'), ('o_orderpriority', 'VARCHAR'), ('o_comment', 'VARCHAR')) w(c, t)"


@query("c03_schema_check", f"SELECT c AS column_name, CASE WHEN column_name IS NULL THEN 'missing' ELSE 'mismatched' END AS fault FROM {_WANTED} LEFT JOIN (DESCRIBE orders) s ON c = column_name WHERE column_type IS DISTINCT FROM t")
def _(spark, d):
    o = table(spark, d, "orders")
    wanted = StructType([*[StructField(f.name, StringType() if f.name == "o_orderdate" else f.dataType) for f in o.schema], StructField("o_comment", StringType())])
    faults = [(c, kind) for kind, names in Q.schema_diff(o.schema, wanted).items() for c in names]
    return o.agg(F.count("*")).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("fault")) for c, k in faults])).alias("f")).select("f.*")


@query("c05_apply_schema", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(NULL AS BIGINT) AS o_orderstatus FROM orders")
def _(spark, d):
    return X.align(table(spark, d, "orders"), StructType([StructField("o_orderkey", StringType()), StructField("o_orderstatus", LongType())]))


@query("c12_orphan_sample", "SELECT user_id, count(*) AS child_rows FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1 ORDER BY 1 LIMIT 100")
def _(spark, d):
    return Q.orphan_sample(table(spark, d, "events"), table(spark, d, "customer").where("c_custkey % 2 = 0"), "user_id", "c_custkey")


@query("c16_date_realism", sql("sales", "SELECT 'order_date' AS column_name, count(order_date) AS present, 0::BIGINT AS unparsable, count(*) FILTER (order_date > DATE '2000-01-02') AS future, 0::BIGINT AS old FROM sales UNION ALL SELECT 'status', count(status), count(status), 0, 0 FROM sales"))
def _(spark, d):
    return Q.date_realism(sales(spark, d), ["order_date", "status"], F.lit("2000-01-01").cast("date"))


@query("c21_freshness_guard", "SELECT 'events' AS table_name, floor((epoch(TIMESTAMP '2024-01-31') - epoch(max(ts))) / 3600) AS age_hours, epoch(TIMESTAMP '2024-01-31') - epoch(max(ts)) <= 3600 AS fresh FROM events UNION ALL SELECT 'orders', floor((epoch(TIMESTAMP '2024-01-31') - epoch(max(o_orderdate))) / 3600), false FROM orders")
def _(spark, d):
    tables = {"events": (table(spark, d, "events"), "ts", 1.0), "orders": (table(spark, d, "orders"), "o_orderdate", 24.0)}
    return Q.freshness(tables, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("table_name", F.floor("age_hours").cast("double").alias("age_hours"), "fresh")


@query("c25_gold_truth_report", sql("sales", ", t AS (SELECT count(*) AS total FROM sales) SELECT 'unique:order_id' AS test, 0::BIGINT AS failed FROM t UNION ALL SELECT 'reference:customer_key', 0 FROM t UNION ALL SELECT 'reference:product_key', count(*) FILTER (product_id IS NULL) FROM sales UNION ALL SELECT 'not_future:order_date', 0 FROM t UNION ALL SELECT 'not_null:amount_usd', 0 FROM t"))
def _(spark, d):
    rules = [Q.Rule("unique", "order_id"), Q.Rule("reference", "customer_key", parent="customers", parent_key="customer_id"), Q.Rule("reference", "product_key", parent="products", parent_key="product_id"), Q.Rule("not_future", "order_date"), Q.Rule("not_null", "amount_usd")]
    report = Q.evaluate(facts(spark, d), rules, {"customers": customers(spark, d), "products": products(spark, d)}, F.lit("2030-01-01").cast("date"))
    return report.select(F.concat_ws(":", "rule", "target").alias("test"), "failed")


@query("c28_expectations", "SELECT 'not_null:c_name' AS expectation, true AS met FROM (SELECT count(*) FROM customer) UNION ALL SELECT 'range:c_acctbal', count(*) FILTER (c_acctbal > 9000) = 0 FROM customer UNION ALL SELECT 'in_set:c_mktsegment', count(*) FILTER (c_mktsegment <> 'BUILDING') = 0 FROM customer UNION ALL SELECT 'unique:c_custkey,c_name', true FROM (SELECT count(*) FROM customer) UNION ALL SELECT 'type:bigint:c_custkey', true FROM (SELECT count(*) FROM customer)")
def _(spark, d):
    wanted = [{"kind": "not_null", "column": "c_name"}, {"kind": "between", "column": "c_acctbal", "high": 9000}, {"kind": "in_set", "column": "c_mktsegment", "values": ["BUILDING"]}, {"kind": "unique", "column": ["c_custkey", "c_name"]}, {"kind": "type", "column": "c_custkey", "type": "bigint"}]
    return Q.expectations(table(spark, d, "customer"), wanted)


@query("c14_row_scores", "SELECT round(count(*) FILTER (c_acctbal >= 0) / count(*)::DOUBLE, 6) AS in_range, round(count(*) FILTER (regexp_matches(c_name, '0$')) / count(*)::DOUBLE, 6) AS matching, 1.0::DOUBLE AS complete FROM customer")
def _(spark, d):
    share = lambda c: F.round(F.try_divide(F.count_if(c), F.count("*")), 6)
    return table(spark, d, "customer").agg(share(X.in_range(F.col("c_acctbal"), 0)).alias("in_range"), share(F.col("c_name").rlike("0$")).alias("matching"), share(F.col("c_custkey").isNotNull() & X.non_blank(F.col("c_name"))).alias("complete"))


@query("c19_outlier_counts", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem) SELECT l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a) AS is_outlier, count(*) AS n FROM lineitem, q GROUP BY 1")
def _(spark, d):
    return P.outliers(table(spark, d, "lineitem"), "l_extendedprice").groupBy("is_outlier").agg(F.count("*").alias("n"))


# --- dimensions whose attributes change ---------------------------------------------------------------------------

_CHANGED = (
    "s AS (SELECT {key} AS {id}, {start} AS start, {value} AS {name} FROM {source} GROUP BY 1, 2), m AS (SELECT *, row_number() OVER w AS n, lag({name}) OVER w AS before FROM s WINDOW w AS (PARTITION BY {id} ORDER BY start)),"
    " c AS (SELECT * FROM m WHERE n = 1 OR {name} IS DISTINCT FROM before) SELECT {id}, sha256({id} || '||' || strftime(start, '%Y-%m-%d')) AS {key_name}, {name}, start AS effective_from, lead(start) OVER (PARTITION BY {id} ORDER BY start)::DATE AS effective_to, lead(start) OVER (PARTITION BY {id} ORDER BY start) IS NULL AS is_current FROM c"
)


def changing(df, key, start, key_name, name):
    """Versions of one tracked attribute; the open end shows as NULL."""
    out = M.type2_dimension(df, key, start, key_name, tracked=[name])
    return out.select(key, key_name, name, "effective_from", F.when(~F.col("is_current"), F.to_date("effective_to")).alias("effective_to"), "is_current")


@query("d02_product_versions_on_change", sql("sales", ", " + _CHANGED.format(key="product_id", id="product_id", start="order_date", value="max(CASE WHEN quantity > 100 THEN 'bulk' ELSE 'retail' END)", name="demand", source="sales WHERE product_id IS NOT NULL", key_name="product_key")))
def _(spark, d):
    """A version of a product wherever the size of its orders changes class."""
    seen = sales(spark, d).where("product_id is not null").groupBy("product_id", "order_date").agg(F.max(F.when(F.col("quantity") > 100, "bulk").otherwise("retail")).alias("demand"))
    return changing(seen, "product_id", "order_date", "product_key", "demand")


@query("d03_account_versions_on_change", sql("sales", ", " + _CHANGED.format(key="customer_id", id="account_id", start="order_date", value="max(priority)", name="service", source="sales", key_name="account_key")))
def _(spark, d):
    """A version of an account wherever the priority of its orders changes."""
    seen = sales(spark, d).groupBy(F.col("customer_id").alias("account_id"), "order_date").agg(F.max("priority").alias("service"))
    return changing(seen, "account_id", "order_date", "account_key", "service")


@query("d04_contact_versions_on_change", "WITH " + _CHANGED.format(key="l_suppkey", id="contact_id", start="date_trunc('month', l_shipdate)::DATE", value="CASE WHEN max(l_quantity) > 45 THEN NULL ELSE max(l_returnflag) END", name="standing", source="lineitem", key_name="contact_key"))
def _(spark, d):
    """A version of a contact wherever its months change standing, which may be NULL."""
    month = F.trunc("l_shipdate", "month")
    seen = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("contact_id"), month.alias("start")).agg(F.when(F.max("l_quantity") <= 45, F.max("l_returnflag")).alias("standing"))
    return changing(seen, "contact_id", "start", "contact_key", "standing")


@query("d08_type1_with_defaults", "SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 4 = 0 OR c_mktsegment = 'BUILDING' THEN 'unknown' ELSE lower(c_mktsegment) END AS segment, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS balance FROM customer")
def _(spark, d):
    """Attributes that are missing, blank or below zero get their defaults."""
    c = table(spark, d, "customer")
    raw = F.when(F.col("c_custkey") % 4 == 0, None).when(F.col("c_mktsegment") == "BUILDING", "  ").otherwise(F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("customer_id"), X.filled(F.lower(F.trim(raw)), "unknown").alias("segment"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("balance"))


# --- faults that are there ----------------------------------------------------------------------------------------


@query(
    "h04_planted_history_faults",
    sql("sales", ", s AS (SELECT DISTINCT customer_id, order_date FROM sales), h AS (SELECT customer_id, order_date, lead(order_date) OVER (PARTITION BY customer_id ORDER BY order_date) AS until, row_number() OVER (PARTITION BY customer_id ORDER BY order_date) AS n FROM s),"
        " p AS (SELECT CASE WHEN customer_id % 97 = 5 THEN NULL ELSE customer_id END AS k, order_date AS a, CASE WHEN customer_id % 10 = 3 AND n = 1 AND until IS NOT NULL THEN until + 1 WHEN customer_id % 10 = 4 AND n = 1 AND until IS NOT NULL THEN order_date - 1 ELSE until END AS b, until IS NULL AND customer_id % 10 <> 6 OR customer_id % 10 = 7 AS current FROM h),"
        " q AS (SELECT *, coalesce(b, DATE '9999-12-31') AS e, lead(a) OVER (PARTITION BY k ORDER BY a, b NULLS LAST) AS next FROM p), r AS (SELECT k, count(*) FILTER (current) AS c, count(*) FILTER (next < e) AS o, count(*) FILTER (e < a) AS i, count(*) FILTER (current AND b IS NOT NULL) AS cc FROM q GROUP BY k)"
        " SELECT count(*) FILTER (c <> 1) AS keys_without_one_current, sum(cc)::BIGINT AS closed_current, sum(o)::BIGINT AS overlaps, sum(i)::BIGINT AS inverted, count(*) FILTER (k IS NULL) AS null_keys FROM r"),
)
def _(spark, d):
    """All customers' order days as versions, with overlaps, inverted ends, missing and doubled current flags and NULL keys."""
    k = F.col("customer_id")
    w = Window.partitionBy("customer_id").orderBy("order_date")
    h = sales(spark, d).select("customer_id", "order_date").distinct().withColumns({"until": F.lead("order_date").over(w), "n": F.row_number().over(w)})
    first = (F.col("n") == 1) & F.col("until").isNotNull()
    planted = h.select(
        F.when(k % 97 != 5, k).alias("customer_id"), F.col("order_date").alias("effective_from"), F.when((k % 10 == 3) & first, F.date_add("until", 1)).when((k % 10 == 4) & first, F.date_sub("order_date", 1)).otherwise(F.col("until")).alias("effective_to"),
        ((F.col("until").isNull() & (k % 10 != 6)) | (k % 10 == 7)).alias("is_current"),
    )
    return H.history_faults(planted, ["customer_id"])


@query(
    "x04_planted_rate_faults",
    sql("fx", ", p AS (SELECT rate_date, CASE WHEN day(rate_date) = 7 THEN NULL ELSE base_ccy END AS base_ccy, quote_ccy, CASE WHEN day(rate_date) = 8 THEN -rate WHEN day(rate_date) = 9 THEN NULL ELSE rate END AS rate FROM fx UNION ALL SELECT rate_date, base_ccy, quote_ccy, rate FROM fx WHERE day(rate_date) = 10),"
        " g AS (SELECT count(*) AS n, count(*) FILTER (rate IS NULL OR rate <= 0) AS bad, rate_date IS NULL OR base_ccy IS NULL OR quote_ccy IS NULL AS no_key FROM p GROUP BY rate_date, base_ccy, quote_ccy)"
        " SELECT coalesce(sum(n) FILTER (no_key), 0)::BIGINT AS null_keys, coalesce(sum(bad), 0)::BIGINT AS bad_rates, count(*) FILTER (n > 1) AS repeated_keys FROM g"),
)
def _(spark, d):
    """All rates, some without a currency, below zero, missing or twice."""
    f, day = fx(spark, d), F.dayofmonth("rate_date")
    planted = f.select("rate_date", F.when(day != 7, F.col("base_ccy")).alias("base_ccy"), "quote_ccy", F.when(day == 8, -F.col("rate")).when(day != 9, F.col("rate")).alias("rate"))
    return C.rate_faults(planted.unionByName(f.where(day == 10).select(*planted.columns)))


@query(
    "c13_accuracy_and_timeliness",
    "WITH t AS (SELECT count(*) AS n, count(*) FILTER (value < 10) AS low, count(*) FILTER (value > 90) AS high, count(*) FILTER (NOT regexp_matches(event_type, '^(view|click)$')) AS pattern, count(*) FILTER (ts < TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR) AS late FROM events)"
    " SELECT dimension, name, violations, n AS total, round((n - violations) / n::DOUBLE, 6) AS score FROM (SELECT 'accuracy' AS dimension, 'range:value' AS name, low + high AS violations, n FROM t UNION ALL SELECT 'accuracy', 'below:value', low, n FROM t UNION ALL SELECT 'accuracy', 'above:value', high, n FROM t"
    " UNION ALL SELECT 'accuracy', 'pattern:event_type', pattern, n FROM t UNION ALL SELECT 'timeliness', 'ts:72h', late, n FROM t)",
)
def _(spark, d):
    rules = [Q.Rule("range", "value", low=10, high=90), Q.Rule("pattern", "event_type", text="^(view|click)$")]
    out = Q.accuracy_and_timeliness(table(spark, d, "events"), rules, "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), 72)
    return out.withColumn("score", F.round("score", 6))


@query("g04_card_masking", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '****' ELSE '****-****-****-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END AS card FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    card = F.when(k % 9 == 0, F.lit("1234")).otherwise(F.concat(F.lit("4000 1234-5678 "), F.lpad((k % 10000).cast("string"), 4, "0")))
    return G.masked(table(spark, d, "customer").select("c_custkey", card.alias("card")), {"card": "card"})
