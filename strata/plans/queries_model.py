"""Queries for history, currency, silver tables, dimensions, facts, marts and the SQL reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import currency as C
from ..operators import history as H
from ..operators import relational as R
from ..sources import writers as W
from . import marts as M
from .model import behaviour, currency_of, customers, fx, products, sales, sql, table
from .registry import query

r2 = lambda *names: [F.round(n, 2).alias(n) for n in names]

r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]

# --- history and change capture -----------------------------------------------------------------------------------

_FEED = "SELECT order_id, customer_id, total_amount, 'U' AS op, order_date AS updated FROM sales UNION ALL SELECT order_id, customer_id, total_amount + 1, CASE WHEN order_id % 17 = 0 THEN 'D' WHEN order_id % 5 = 0 THEN NULL ELSE 'U' END, order_date + 3 FROM sales WHERE order_id % 3 = 0 OR order_id % 17 = 0"


def feed(spark, d):
    s = sales(spark, d)
    k = F.col("order_id")
    first = s.select("order_id", "customer_id", "total_amount", F.lit("U").alias("op"), F.col("order_date").alias("updated"))
    later = s.where((k % 3 == 0) | (k % 17 == 0)).select("order_id", "customer_id", (F.col("total_amount") + 1).alias("total_amount"), F.when(k % 17 == 0, "D").when(k % 5 != 0, "U").alias("op"), F.date_add("order_date", 3).alias("updated"))
    return first.unionByName(later)


@query("h01_apply_changes", sql("sales", f", feed AS ({_FEED}) SELECT order_id, customer_id, round(total_amount, 2) AS total_amount FROM (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY updated DESC NULLS LAST) = 1) WHERE coalesce(op, 'U') <> 'D'"))
def _(spark, d):
    return H.apply_changes(feed(spark, d), ["order_id"], ["updated"]).select("order_id", "customer_id", *r2("total_amount"))


@query("h02_rolling_upsert", sql("sales", ", inc AS (SELECT order_id, total_amount + 5 AS total_amount, order_date FROM sales WHERE order_id % 4 = 0) SELECT s.order_id, round(CASE WHEN s.order_date >= DATE '2000-01-01' AND i.order_id IS NOT NULL THEN i.total_amount ELSE s.total_amount END, 2) AS total_amount FROM sales s LEFT JOIN inc i USING (order_id)"))
def _(spark, d):
    old = sales(spark, d).select("order_id", "total_amount", "order_date")
    new = old.where("order_id % 4 = 0").withColumn("total_amount", F.col("total_amount") + 5)
    return H.rolling_upsert(old, new, ["order_id"], "order_date", ["order_date"], F.lit("2000-01-01").cast("date")).select("order_id", *r2("total_amount"))


_VERSIONS = ", v AS (SELECT customer_id, order_date AS start, status FROM sales QUALIFY row_number() OVER (PARTITION BY customer_id, order_date ORDER BY status DESC) = 1), n AS (SELECT *, lag(status) OVER (PARTITION BY customer_id ORDER BY start) AS before FROM v), h AS (SELECT customer_id, status, start AS effective_from, lead(start) OVER (PARTITION BY customer_id ORDER BY start) AS effective_to, row_number() OVER (PARTITION BY customer_id ORDER BY start) AS version FROM n WHERE before IS NULL OR before <> status)"


def status_history(spark, d):
    """A customer's status over time, as its orders tell; of a day's orders the greatest status counts."""
    s = sales(spark, d).groupBy("customer_id", "order_date").agg(F.max("status").alias("status"))
    return H.apply_scd2(None, s, ["customer_id"], ["status"], "order_date")


@query("h03_type2_history", sql("sales", _VERSIONS + " SELECT customer_id, status, effective_from, effective_to, effective_to IS NULL AS is_current, CAST(version AS INTEGER) AS version FROM h"))
def _(spark, d):
    return status_history(spark, d).select("customer_id", "status", "effective_from", "effective_to", "is_current", "version")


@query("h03_late_batches", sql("sales", _VERSIONS + " SELECT customer_id, status, effective_from, effective_to, effective_to IS NULL AS is_current FROM h"))
def _(spark, d):
    s = sales(spark, d).groupBy("customer_id", "order_date").agg(F.max("status").alias("status"))
    cut = F.lit("1998-01-01").cast("date")
    # only unchanged-free versions may be forgotten, so a table that takes late rows keeps all versions it was given
    first = H.apply_scd2(None, s.where(F.col("order_date") >= cut), ["customer_id"], ["status"], "order_date", keep_unchanged=True)
    return H.apply_scd2(first, s.where(F.col("order_date") < cut), ["customer_id"], ["status"], "order_date").select("customer_id", "status", "effective_from", "effective_to", "is_current")


@query("h04_history_faults", "SELECT 0::BIGINT AS keys_without_one_current, 0::BIGINT AS closed_current, 0::BIGINT AS overlaps, 0::BIGINT AS inverted, 0::BIGINT AS null_keys FROM (SELECT count(*) FROM orders)")
def _(spark, d):
    return H.history_faults(status_history(spark, d), ["customer_id"])


@query("h06_type1_view", sql("customers", "SELECT customer_id, CASE WHEN customer_id % 5 = 0 THEN 'MOVED' ELSE country END AS country FROM customers"))
def _(spark, d):
    c = customers(spark, d).select("customer_id", "country")
    return H.current_view(c, c.where("customer_id % 5 = 0").withColumn("country", F.lit("MOVED")), "customer_id", ["country"])


@query("h08_changes_since", sql("sales", f", feed AS ({_FEED}) SELECT order_id, customer_id FROM feed WHERE op = 'D' AND updated >= DATE '1999-01-01'"))
def _(spark, d):
    log = feed(spark, d).select("order_id", "customer_id", F.col("op").alias("change"), F.col("updated").alias("changed_at"), F.col("order_id").alias("change_id"))
    return H.changes_since(log, F.lit("1999-01-01").cast("date"), ["D"]).select("order_id", "customer_id")


@query("h10_versions_per_key", sql("sales", _VERSIONS + " SELECT versions, count(*) AS keys FROM (SELECT customer_id, count(*) AS versions FROM h GROUP BY 1) GROUP BY 1"))
def _(spark, d):
    return H.change_analysis(status_history(spark, d), ["customer_id"])


@query("h10_versions_by_reason", sql("sales", _VERSIONS + " SELECT CASE WHEN version = 1 THEN 'first version' ELSE 'status to ' || status END AS reason, count(*) AS versions, count(DISTINCT customer_id) AS keys FROM h GROUP BY 1"))
def _(spark, d):
    why = F.when(F.col("version") == 1, "first version").otherwise(F.concat(F.lit("status to "), F.col("status")))
    return status_history(spark, d).groupBy(why.alias("reason")).agg(F.count("*").alias("versions"), F.count_distinct("customer_id").alias("keys"))


@query("s09_above_high_water_mark", sql("sales", "SELECT order_id, order_date FROM sales WHERE order_date > DATE '2001-06-01'"))
def _(spark, d):
    return H.above_mark(sales(spark, d), "order_date", F.lit("2001-06-01").cast("date")).select("order_id", "order_date")


@query("s10_high_water_marks", sql("sales", "SELECT 'orders' AS source, max(order_date) AS mark FROM sales UNION ALL SELECT 'events', DATE '2030-01-01'"))
def _(spark, d):
    old = spark.sql("SELECT 'orders' AS source, DATE '1990-01-01' AS mark UNION ALL SELECT 'events', DATE '2030-01-01'")
    marks = H.marks_after(old, "orders", sales(spark, d), "order_date")
    return H.marks_after(marks, "events", behaviour(spark, d), "event_date")


# --- currency -----------------------------------------------------------------------------------------------------


@query("x01_usd_rates", sql("fx rates", "SELECT rate_date, currency, round(usd_rate, 8) AS usd_rate FROM rates"))
def _(spark, d):
    return C.usd_rates(fx(spark, d)).select("rate_date", "currency", F.round("usd_rate", 8).alias("usd_rate"))


@query("x02_orders_in_usd", sql("sales fx rates usd", "SELECT order_id, currency, round(amount_usd, 6) AS amount_usd FROM usd"))
def _(spark, d):
    return C.in_usd(sales(spark, d), C.usd_rates(fx(spark, d)), "order_date", "currency", "total_amount", strict=True).select("order_id", "currency", *r6("amount_usd"))


@query("x03_fixed_rates", sql("sales", "SELECT order_id, round(CASE currency WHEN 'EUR' THEN total_amount * 1.1 WHEN 'GBP' THEN total_amount * 1.3 ELSE total_amount END, 4) AS amount_usd FROM sales"))
def _(spark, d):
    return sales(spark, d).select("order_id", F.round(C.fixed_usd("total_amount", "currency", {"EUR": 1.1, "GBP": 1.3}), 4).alias("amount_usd"))


@query("x04_rate_faults", "SELECT 0::BIGINT AS null_keys, 0::BIGINT AS bad_rates, 0::BIGINT AS repeated_keys FROM (SELECT count(*) FROM orders)")
def _(spark, d):
    return C.rate_faults(fx(spark, d))


@query("a11_averaged_rates", sql("fx", "SELECT date_trunc('month', rate_date)::DATE AS rate_date, base_ccy, quote_ccy, round(avg(rate), 6) AS rate, round(min(rate * 0.99), 6) AS bid, round(max(rate * 1.01), 6) AS ask, 'desk' AS source FROM fx GROUP BY 1, 2, 3"))
def _(spark, d):
    quotes = fx(spark, d).select(F.trunc("rate_date", "month").alias("rate_date"), "base_ccy", "quote_ccy", "rate", (F.col("rate") * 0.99).alias("bid"), (F.col("rate") * 1.01).alias("ask"), F.lit("desk").alias("source"))
    return C.averaged(quotes)


# --- silver -------------------------------------------------------------------------------------------------------


@query("b01_orders_silver", sql("sales", "SELECT order_id, customer_id, product_id, quantity, total_amount, currency, status, order_date, round(total_amount / nullif(quantity, 0), 8) AS unit_price FROM sales WHERE customer_id IN (SELECT c_custkey FROM customer)"))
def _(spark, d):
    out = M.orders_silver(sales(spark, d), customers(spark, d))
    return out.withColumn("unit_price", F.round("unit_price", 8))


@query("b01_customers_silver", sql("customers", "SELECT customer_id, customer_name, upper(country) AS country, region, lower(segment) AS segment, balance FROM customers"))
def _(spark, d):
    return M.load_silver(customers(spark, d), M.customers_silver, W.work_path(spark, "customers-silver"), "customer_id", 0.1)


@query("b02_behaviour_silver", sql("behaviour", "SELECT event_id, customer_id, event_type, amount, event_date, session_id FROM behaviour"))
def _(spark, d):
    e = behaviour(spark, d)
    return M.behaviour_silver(e.unionByName(e.where("event_id % 10 = 0").withColumn("event_ts", F.col("event_ts") - F.expr("INTERVAL 1 HOUR")))).drop("event_ts")


@query("b04_order_events_silver", "SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS payload_k, 0.0::DOUBLE AS payload_amount, 'USD' AS currency, 'unknown' AS channel FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    # every third payload arrives with the doubled quotes of a CSV export
    e = e.withColumn("props", F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", '"', '""')).otherwise(F.col("props")))
    return M.order_events_silver(e, "props", ["event_id"], ["ts"]).select("event_id", "payload_k", "payload_amount", "currency", "channel")


@query("b06_enriched_customers", sql("customers behaviour", "SELECT customer_id, country, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'purchase') AS n_purchase, round(coalesce(sum(CASE WHEN event_type = 'purchase' THEN amount ELSE 0 END), 0), 2) AS event_revenue, max(customer_id * 10 + 1) AS contact_id FROM customers LEFT JOIN behaviour USING (customer_id) GROUP BY 1, 2"))
def _(spark, d):
    c = customers(spark, d)
    contacts = c.select("customer_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).select("customer_id", (F.col("customer_id") * 10 + F.col("n")).alias("contact_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")).alias("contacted_at"))
    return M.enriched_customers(c, contacts, behaviour(spark, d), F.lit("2024-02-01").cast("date")).select("customer_id", "country", "n_view", "n_purchase", *r2("event_revenue"), "contact_id")


@query("b07_enriched_orders", sql("sales customers products fx rates usd", "SELECT order_id, round(amount_usd, 6) AS amount_usd, country, category FROM usd LEFT JOIN customers USING (customer_id) LEFT JOIN products USING (product_id)"))
def _(spark, d):
    return M.enriched_orders(sales(spark, d), customers(spark, d), products(spark, d), fx(spark, d)).select("order_id", *r6("amount_usd"), "country", "category")


@query("b08_products_silver", sql("products", "SELECT product_id, lower(product_name) AS product_name, brand, category, size, price FROM products WHERE price > 0"))
def _(spark, d):
    return M.products_silver(products(spark, d))


# --- dimensions, facts, marts -------------------------------------------------------------------------------------


@query("d01_type2_dimension", sql("sales", ", v AS (SELECT DISTINCT customer_id, order_date FROM sales) SELECT customer_id, sha256(customer_id || '||' || strftime(order_date, '%Y-%m-%d')) AS customer_key, order_date AS effective_from, coalesce(strftime(lead(order_date) OVER (PARTITION BY customer_id ORDER BY order_date), '%Y-%m-%d'), '9999-12-31') AS effective_to, lead(order_date) OVER (PARTITION BY customer_id ORDER BY order_date) IS NULL AS is_current FROM v"))
def _(spark, d):
    dim = M.type2_dimension(sales(spark, d).select("customer_id", "order_date"), "customer_id", "order_date", "customer_key")
    return dim.select("customer_id", "customer_key", "effective_from", F.date_format("effective_to", "yyyy-MM-dd").alias("effective_to"), "is_current")


@query("d05_date_dimension", sql("sales", ", days AS (SELECT unnest(generate_series(min(order_date), greatest(max(order_date), min(order_date) + 730), INTERVAL 1 DAY))::DATE AS date FROM sales) SELECT CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key, date, year(date) AS year, month(date) AS month, day(date) AS day, monthname(date) AS month_name FROM days"))
def _(spark, d):
    return M.date_dimension(sales(spark, d), "order_date").select("date_key", "date", "year", "month", "day", "month_name")


@query("d06_fixed_date_range", sql("sales", ", days AS (SELECT unnest(generate_series(DATE '1998-01-01', DATE '1999-12-31', INTERVAL 1 DAY))::DATE AS date) SELECT date, count(order_id) AS orders FROM days LEFT JOIN sales ON order_date = date GROUP BY 1"))
def _(spark, d):
    days = M.date_range(spark, "1998-01-01", "1999-12-31").select("date")
    return days.join(sales(spark, d), F.col("date") == F.col("order_date"), "left").groupBy("date").agg(F.count("order_id").alias("orders"))


@query("d07_sub_dimensions", sql("products", "SELECT 'category' AS dimension, category AS value, sha256(category) AS dimension_key FROM products GROUP BY 2 UNION ALL SELECT 'brand', brand, sha256(brand) FROM products GROUP BY 2"))
def _(spark, d):
    p = products(spark, d)
    part = lambda c: M.sub_dimension(p, c, "dimension_key").select(F.lit(c).alias("dimension"), F.col(c).alias("value"), "dimension_key")
    return part("category").unionByName(part("brand"))


@query("d07_key_substitution", sql("products", "SELECT product_id, sha256(category) AS category_key, sha256(brand) AS brand_key FROM products"))
def _(spark, d):
    return M.with_sub_key(M.with_sub_key(products(spark, d), "category", "category_key"), "brand", "brand_key").select("product_id", "category_key", "brand_key")


@query("d09_demographics", sql("customers sales", ", f AS (SELECT customer_id, min(order_date) AS since FROM sales GROUP BY 1) SELECT customer_id, CAST(DATE '2001-08-02' - since AS INTEGER) AS tenure_days, CASE WHEN since IS NULL THEN 'unknown' WHEN DATE '2001-08-02' - since < 365 THEN 'new' WHEN DATE '2001-08-02' - since < 1095 THEN 'established' ELSE 'loyal' END AS tenure_tier, CASE WHEN balance < 0 THEN 'debtor' WHEN balance < 2500 THEN 'bronze' WHEN balance < 7500 THEN 'silver' ELSE 'gold' END AS value_tier FROM customers LEFT JOIN f USING (customer_id)"))
def _(spark, d):
    since = sales(spark, d).groupBy("customer_id").agg(F.min("order_date").alias("since"))
    return M.demographic_customers(customers(spark, d).join(since, "customer_id", "left"), "since", F.lit("2001-08-02").cast("date")).select("customer_id", "tenure_days", "tenure_tier", "value_tier")


def facts(spark, d):
    return M.fact_orders(sales(spark, d), customers(spark, d), products(spark, d), fx(spark, d))


@query("m01_fact_orders", sql("sales fx rates usd", "SELECT order_id, customer_id AS customer_key, coalesce(product_id, -1) AS product_key, round(amount_usd, 6) AS amount_usd, CAST(strftime(order_date, '%Y%m%d') AS INTEGER) AS date_key, year(order_date) AS year, month(order_date) AS month FROM usd"))
def _(spark, d):
    return facts(spark, d).select("order_id", "customer_key", "product_key", *r6("amount_usd"), "date_key", "year", "month")


def members(spark, d, column, name):
    """A type-2 dimension of the members that orders name: a version for each order date."""
    return M.type2_dimension(sales(spark, d).where(f"{column} is not null").select(column, "order_date"), column, "order_date", name)


def starts(spark, d, column):
    """When the current version of each of those members began."""
    return M.current_starts(sales(spark, d).select(column, "order_date"), column, "order_date", f"{column}_since")


_KEY = "sha256({0} || '||' || strftime(max(order_date), '%Y-%m-%d'))"
_CURRENT = f", c AS (SELECT customer_id, {_KEY.format('customer_id')} AS customer_sk FROM sales GROUP BY 1), p AS (SELECT product_id, {_KEY.format('product_id')} AS product_sk FROM sales WHERE product_id IS NOT NULL GROUP BY 1)"


_EVENTS = """
, rated AS (SELECT rate_date, currency, usd_rate FROM rates),
e AS (SELECT event_id, customer_id, amount, event_ts - INTERVAL 9125 DAY AS event_ts, CASE event_id % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'JPY' END AS currency FROM behaviour),
o AS (SELECT customer_id, order_date, max(order_id) AS last_order_id, max(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS n FROM sales) GROUP BY 1, 2),
v AS (SELECT customer_id, order_date AS since, sha256(customer_id || '||' || strftime(order_date, '%Y-%m-%d')) AS customer_sk FROM (SELECT DISTINCT customer_id, order_date FROM sales)),
x AS (SELECT e.*, last_order_id, o.order_date AS last_order_date, n FROM e ASOF LEFT JOIN o ON e.customer_id = o.customer_id AND e.event_ts >= o.order_date),
y AS (SELECT x.*, customer_sk FROM x ASOF LEFT JOIN v ON x.customer_id = v.customer_id AND x.event_ts >= v.since)
SELECT event_id, coalesce(customer_sk, '-1') AS customer_sk, last_order_id, last_order_date, coalesce(n, 0) AS orders_before, date_diff('day', last_order_date, CAST(event_ts AS DATE)) AS days_since_order,
       round(CASE WHEN y.currency = 'USD' THEN amount ELSE amount * coalesce(usd_rate, 1.0) END, 6) AS amount_usd
FROM y ASOF LEFT JOIN rated ON y.currency = rated.currency AND y.event_ts >= rated.rate_date
"""


@query("m02_fact_order_events", sql("behaviour sales fx rates", _EVENTS))
def _(spark, d):
    """All events, moved 25 years back into the years of the orders, in four currencies."""
    e = behaviour(spark, d).withColumns({"event_ts": F.expr("event_ts - interval 9125 days"), "currency": currency_of("event_id")})
    out = M.fact_order_events(e, members(spark, d, "customer_id", "customer_sk"), sales(spark, d).select("order_id", "customer_id", "order_date"), C.usd_rates(fx(spark, d)))
    return out.select("event_id", "customer_sk", "last_order_id", "last_order_date", "orders_before", "days_since_order", *r6("amount_usd"))


@query("j02_current_members", sql("sales", _CURRENT + " SELECT c_custkey AS customer_id, coalesce(customer_sk, '-1') AS customer_sk FROM customer LEFT JOIN c ON c_custkey = customer_id"))
def _(spark, d):
    out = M.with_start(customers(spark, d).select("customer_id"), starts(spark, d, "customer_id"), "customer_id")
    return out.select("customer_id", M.member_key("customer_id", "customer_id_since").alias("customer_sk"))


@query("m01_fact_orders_with_member_keys", sql("sales fx rates usd", _CURRENT + " SELECT order_id, coalesce(customer_sk, '-1') AS customer_sk, coalesce(product_sk, '-1') AS product_sk, round(amount_usd, 6) AS amount_usd FROM usd LEFT JOIN c USING (customer_id) LEFT JOIN p USING (product_id)"))
def _(spark, d):
    out = M.with_start(facts(spark, d).select("order_id", "customer_id", "product_id", "amount_usd"), starts(spark, d, "customer_id"), "customer_id")
    out = M.with_start(out, starts(spark, d, "product_id"), "product_id")
    return out.select("order_id", M.member_key("customer_id", "customer_id_since").alias("customer_sk"), M.member_key("product_id", "product_id_since").alias("product_sk"), *r6("amount_usd"))


@query("m02_fact_behaviour_with_member_keys", sql("behaviour sales", _CURRENT + " SELECT event_id, coalesce(customer_sk, '-1') AS customer_sk, event_type, amount FROM behaviour LEFT JOIN c USING (customer_id)"))
def _(spark, d):
    out = M.with_start(behaviour(spark, d), starts(spark, d, "customer_id"), "customer_id")
    return out.select("event_id", M.member_key("customer_id", "customer_id_since").alias("customer_sk"), "event_type", "amount")


@query("m04_fact_sales_with_member_keys", sql("sales", _CURRENT + " SELECT l_orderkey AS order_id, l_linenumber AS line, coalesce(customer_sk, '-1') AS customer_sk, coalesce(product_sk, '-1') AS product_sk, CAST(strftime(order_date, '%Y%m%d') AS INTEGER) AS date_key, l_quantity AS quantity FROM lineitem JOIN sales ON l_orderkey = order_id LEFT JOIN c ON sales.customer_id = c.customer_id LEFT JOIN p ON l_partkey = p.product_id"))
def _(spark, d):
    """Orders find their customer before they meet their lines, and lines carry starts: keys are hashed after the last join."""
    o = M.with_start(sales(spark, d).select("order_id", "customer_id", F.date_format("order_date", "yyyyMMdd").cast("int").alias("date_key")), starts(spark, d, "customer_id"), "customer_id")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"))
    out = M.with_start(li.join(o, "order_id"), starts(spark, d, "product_id"), "product_id")
    return out.select("order_id", "line", M.member_key("customer_id", "customer_id_since").alias("customer_sk"), M.member_key("product_id", "product_id_since").alias("product_sk"), "date_key", "quantity")


_360 = ", o AS (SELECT customer_id, sum(amount_usd) AS rev, count(DISTINCT order_id) AS n, max(order_date) AS l FROM usd GROUP BY 1), e AS (SELECT customer_id, count(DISTINCT session_id) AS s, count(*) AS n FROM behaviour GROUP BY 1) SELECT customer_id, country, segment, round(coalesce(rev, 0), 2) AS revenue_usd, coalesce(o.n, 0) AS orders, l AS last_order, coalesce(s, 0) AS sessions, coalesce(e.n, 0) AS events, round(coalesce(rev, 0) * 1.5, 2) AS lifetime_value_usd FROM customers LEFT JOIN o USING (customer_id) LEFT JOIN e USING (customer_id)"


@query("customer_360", sql("customers sales fx rates usd behaviour", _360))
def customer_360(spark, d):
    out = M.customer_360(customers(spark, d), facts(spark, d), behaviour(spark, d))
    return out.select("customer_id", "country", "segment", *r2("revenue_usd"), "orders", "last_order", "sessions", "events", *r2("lifetime_value_usd"))


@query("m06_product_performance", sql("products sales fx rates usd", "SELECT product_id, category, coalesce(sum(quantity), 0) AS units, round(coalesce(sum(amount_usd), 0), 2) AS revenue_usd, count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS buyers, count(order_id) > 0 AS is_active FROM products LEFT JOIN usd USING (product_id) GROUP BY 1, 2"))
def _(spark, d):
    return M.product_performance(products(spark, d), facts(spark, d)).select("product_id", "category", "units", *r2("revenue_usd"), "orders", "buyers", "is_active")


@query("m08_attribution", sql("customers sales fx rates usd", ", s AS (SELECT segment, count(*) * 1000.0 AS spend FROM customers GROUP BY 1), c AS (SELECT customer_id, segment, sum(amount_usd) AS rev FROM customers LEFT JOIN usd USING (customer_id) GROUP BY 1, 2) SELECT segment, count(*) AS customers, round(sum(rev), 2) AS revenue_usd, round((sum(rev) - any_value(spend)) / nullif(any_value(spend), 0), 4) AS roi, CASE WHEN (sum(rev) - any_value(spend)) / any_value(spend) < 0 THEN 'loss' WHEN (sum(rev) - any_value(spend)) / any_value(spend) < 10 THEN 'fair' ELSE 'strong' END AS tier FROM c JOIN s USING (segment) GROUP BY 1"))
def _(spark, d):
    c = customers(spark, d)
    spend = c.groupBy("segment").agg((F.count("*") * 1000.0).alias("spend"))
    return M.attribution(c, facts(spark, d), spend, "segment").select("segment", "customers", *r2("revenue_usd"), F.round("roi", 4).alias("roi"), "tier")


@query("m09_orders_daily", sql("sales", "SELECT order_date, product_id, count(*) AS orders, sum(quantity) AS units, round(sum(total_amount), 2) AS revenue, round(max(total_amount), 2) AS largest, round(min(total_amount), 2) AS smallest, count(DISTINCT customer_id) AS customers FROM sales GROUP BY 1, 2"))
def _(spark, d):
    return sales(spark, d).groupBy("order_date", "product_id").agg(F.count("*").alias("orders"), F.sum("quantity").alias("units"), F.round(F.sum("total_amount"), 2).alias("revenue"), F.round(F.max("total_amount"), 2).alias("largest"), F.round(F.min("total_amount"), 2).alias("smallest"), F.count_distinct("customer_id").alias("customers"))


@query("m10_events_daily", sql("behaviour", "SELECT event_date, event_type, customer_id, count(*) AS events, round(sum(amount), 2) AS amount FROM behaviour GROUP BY 1, 2, 3"))
def _(spark, d):
    return behaviour(spark, d).groupBy("event_date", "event_type", "customer_id").agg(F.count("*").alias("events"), F.round(F.sum("amount"), 2).alias("amount"))


# --- SQL models and reports ---------------------------------------------------------------------------------------


def report(name: str, tables: str, text: str, twin: str | None = None):  # noqa: ANN201
    """A report kept as Spark SQL over canonical tables; its twin is the same text unless dialects differ."""
    makers = {"sales": sales, "customers": customers, "products": products, "fx": fx, "behaviour": behaviour}

    @query(name, sql(tables, twin or text))
    def _(spark, d):
        used = {t: makers[t](spark, d) for t in tables.split()}
        body = text
        for t in used:
            body = body.replace(f" {t} ", f" {{{t}}} ")
        return spark.sql(body.strip(), **used)


report("q01_sql_customer_dimension", "customers sales behaviour", " SELECT c.customer_id, coalesce(o.orders, 0) AS orders, round(coalesce(o.value, 0), 2) AS value, o.first_order, o.last_order, coalesce(e.events, 0) AS events, CASE WHEN coalesce(o.value, 0) > 3000000 THEN 'high' WHEN coalesce(o.value, 0) > 1000000 THEN 'medium' ELSE 'low' END AS value_segment FROM customers c LEFT JOIN (SELECT customer_id, count(*) AS orders, sum(total_amount) AS value, min(order_date) AS first_order, max(order_date) AS last_order FROM sales GROUP BY customer_id) o ON c.customer_id = o.customer_id LEFT JOIN (SELECT customer_id, count(*) AS events FROM behaviour GROUP BY customer_id) e ON c.customer_id = e.customer_id ")
report("q02_sql_product_dimension", "products sales", " SELECT p.product_id, count(s.order_id) AS orders, round(coalesce(sum(s.total_amount), 0), 2) AS revenue, CASE WHEN count(s.order_id) >= 10 THEN 'top' WHEN count(s.order_id) > 0 THEN 'selling' ELSE 'idle' END AS tier FROM products p LEFT JOIN sales s ON p.product_id = s.product_id GROUP BY p.product_id ")
report("q03_sql_recent_order_fact", "sales", " SELECT order_id, date_trunc('month', order_date) AS order_month, round(total_amount * CAST(0.3 AS DOUBLE), 4) AS margin FROM sales WHERE order_date >= DATE '2001-07-29' ", " SELECT order_id, date_trunc('month', order_date)::TIMESTAMP AS order_month, round(total_amount * CAST(0.3 AS DOUBLE), 4) AS margin FROM sales WHERE order_date >= DATE '2001-07-29' ")
report("q04_sql_engagement", "behaviour", " SELECT customer_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS views, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS purchases, count(DISTINCT event_date) AS active_days, least(100, sum(CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 2 WHEN event_type = 'purchase' THEN 10 ELSE 0 END)) AS score, round(sum(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END), 0), 4) AS click_to_purchase FROM behaviour GROUP BY customer_id ".replace("round(sum(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END)", "round(sum(CASE WHEN event_type = 'purchase' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"))
report("q05_sql_staging_view", "sales", " SELECT order_id, customer_id, upper(status) AS status, order_date FROM sales WHERE order_id IS NOT NULL AND total_amount > 0 ")
report("q06_row_counts", "sales customers products behaviour", " SELECT 'sales' AS table_name, count(*) AS n FROM sales UNION ALL SELECT 'customers', count(*) FROM customers UNION ALL SELECT 'products', count(*) FROM products UNION ALL SELECT 'behaviour', count(*) FROM behaviour ")
report("q07_freshness", "sales behaviour", " SELECT 'sales' AS table_name, max(order_date) AS newest FROM sales UNION ALL SELECT 'behaviour', max(event_date) FROM behaviour ")
report("q08_orders_by_status", "sales", " SELECT status, count(*) AS n, round(CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (), 4) AS pct FROM sales GROUP BY status ")
report("q09_revenue_by_currency", "sales", " SELECT currency, count(*) AS n, round(sum(total_amount), 2) AS revenue FROM sales GROUP BY currency ")
report("q10_customers_by_segment", "customers", " SELECT segment, count(*) AS n, round(CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (), 4) AS pct FROM customers GROUP BY segment ")
report("q12_revenue_by_customer", "sales customers", " SELECT c.customer_id, c.customer_name, round(sum(s.total_amount), 2) AS revenue, count(*) AS orders FROM sales s JOIN customers c ON s.customer_id = c.customer_id GROUP BY c.customer_id, c.customer_name ")
report("q13_revenue_by_region", "sales customers", " SELECT c.region, round(sum(s.total_amount), 2) AS revenue, count(DISTINCT s.customer_id) AS buyers FROM sales s JOIN customers c ON s.customer_id = c.customer_id GROUP BY c.region ")
report("q14_rate_statistics", "fx", " SELECT base_ccy, quote_ccy, count(*) AS n, round(avg(rate), 6) AS mean, min(rate) AS low, max(rate) AS high FROM fx GROUP BY base_ccy, quote_ccy ")
report("q15_monthly_revenue", "sales", " SELECT year(order_date) AS year, month(order_date) AS month, count(*) AS orders, round(sum(total_amount), 2) AS revenue FROM sales GROUP BY year(order_date), month(order_date) ")
report("q17_duplicate_ids", "behaviour", " SELECT session_id, count(*) AS n FROM behaviour GROUP BY session_id HAVING count(*) > 1 ")
report("q18_bad_amounts", "sales", " SELECT count(*) AS n, sum(CASE WHEN total_amount < 0 THEN 1 ELSE 0 END) AS negative, sum(CASE WHEN total_amount = 0 THEN 1 ELSE 0 END) AS zero FROM sales ")
report("q19_invalid_status", "sales", " SELECT status, count(*) AS n FROM sales WHERE status NOT IN ('F', 'O') GROUP BY status ")
report("q20_table_spans", "sales behaviour", " SELECT 'sales' AS table_name, count(*) AS n, min(order_date) AS low, max(order_date) AS high FROM sales UNION ALL SELECT 'behaviour', count(*), min(event_date), max(event_date) FROM behaviour ")
report("q21_last_week", "behaviour", " SELECT event_date, count(*) AS n FROM behaviour WHERE event_date >= DATE '2024-01-31' - INTERVAL 7 DAYS GROUP BY event_date ")
report("q10_leads_by_status", "sales", " SELECT priority AS status, count(*) AS lead_count, round(CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (), 2) AS percentage FROM sales GROUP BY priority ORDER BY lead_count DESC ")
report("q17_duplicate_order_ids", "sales", " SELECT order_id, count(*) AS n FROM (SELECT order_id FROM sales UNION ALL SELECT order_id FROM sales WHERE product_id % 7 = 0) t GROUP BY order_id HAVING count(*) > 1 ")
report("q23_status_with_revenue", "sales", " SELECT status, count(*) AS order_count, round(CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (), 2) AS percentage, round(sum(total_amount), 2) AS total_revenue FROM sales WHERE total_amount IS NOT NULL GROUP BY status ORDER BY order_count DESC ")
report("q24_currency_usage", "sales", " SELECT currency, count(*) AS orders, count(DISTINCT customer_id) AS customers FROM sales GROUP BY currency ")


@query("q11_latest_usd_orders", sql("sales fx rates usd", "SELECT order_id, currency, round(amount_usd, 6) AS amount_usd, order_date FROM usd ORDER BY order_date DESC, order_id LIMIT 50"))
def _(spark, d):
    return R.top(facts(spark, d), 50, F.desc("order_date"), F.asc("order_id")).select("order_id", "currency", *r6("amount_usd"), "order_date")


@query("q16_null_audit", sql("sales", "SELECT 'customer_id' AS column_name, count(*) FILTER (customer_id IS NULL) AS nulls FROM sales UNION ALL SELECT 'product_id', count(*) FILTER (product_id IS NULL) FROM sales UNION ALL SELECT 'order_date', count(*) FILTER (order_date IS NULL) FROM sales"))
def _(spark, d):
    return R.null_counts(sales(spark, d), ["customer_id", "product_id", "order_date"])
