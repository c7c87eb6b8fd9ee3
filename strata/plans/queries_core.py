"""Queries for expressions, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import relational as R
from .model import behaviour, customers, products, sales, sql, table
from .registry import QUERIES, query

# --- projections and predicates ---------------------------------------------------------------------------------


@query("p01_resolve_columns", "SELECT c_custkey AS customer_id, c_name AS name, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS phone FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    return c.select(X.resolve(c, ["customer_id", "C_CUSTKEY"]).alias("customer_id"), X.coalesced(c, ["name", "c_name"]).alias("name"), X.resolve(c, ["balance", "c_acctbal"]).alias("balance"), X.resolve(c, ["phone"]).alias("phone"))


@query("p05_canonical_text", "SELECT p_partkey AS product_id, lower(trim(p_name)) AS name, upper(trim(p_type)) AS type, regexp_replace(p_brand, '[^0-9]', '', 'g') AS brand_no, regexp_replace(p_brand, '[^A-Za-z0-9 ]', '', 'g') AS brand_clean FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("product_id"), X.canonical_text(F.col("p_name"), "lower").alias("name"), X.canonical_text(F.col("p_type"), "upper").alias("type"), X.digits(F.col("p_brand")).alias("brand_no"), X.without_punctuation(F.col("p_brand")).alias("brand_clean"))


@query("p06_default_fill", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS event_type, CASE WHEN event_id % 3 = 0 THEN 'USD' ELSE 'EUR' END AS currency FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    code = F.when(F.col("event_id") % 3 != 0, "EUR").otherwise(" ")
    return e.select("event_id", X.filled(kind, "unknown").alias("event_type"), X.filled(code, "USD").alias("currency"))


@query("p07_clamp_at_zero", "SELECT c_custkey AS customer_id, greatest(c_acctbal - 5000, 0) AS above FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"), X.at_least_zero((F.col("c_acctbal") - 5000).cast("string")).alias("above"))


@query("p16_unit_price", sql("sales", "SELECT order_id, round(total_amount / nullif(quantity, 0), 8) AS unit_price FROM sales"))
def _(spark, d):
    return sales(spark, d).select("order_id", F.round(X.unit_price(F.lit(None).cast("double"), F.col("total_amount"), F.col("quantity")), 8).alias("unit_price"))


@query("p18_date_parts", sql("sales", "SELECT order_id, year(order_date) AS year, quarter(order_date) AS quarter, month(order_date) AS month, day(order_date) AS day, dayofweek(order_date) + 1 AS day_of_week, dayname(order_date) AS day_name, strftime(order_date, '%Y%m') AS year_month, dayofweek(order_date) IN (0, 6) AS is_weekend, order_date = last_day(order_date) AS is_month_end FROM sales"))
def _(spark, d):
    parts = X.date_parts(F.col("order_date"))
    return sales(spark, d).select("order_id", *[parts[n].alias(n) for n in ("year", "quarter", "month", "day", "day_of_week", "day_name", "year_month", "is_weekend", "is_month_end")])


@query("p19_bands", "SELECT p_partkey AS product_id, CASE WHEN p_retailprice < 950 THEN 'budget' WHEN p_retailprice < 1000 THEN 'standard' ELSE 'premium' END AS price_band, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_band FROM part")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), X.banded(F.col("p_retailprice"), [(950, "budget"), (1000, "standard")], "premium").alias("price_band"), X.banded(F.col("p_size"), [(10, "small"), (30, "medium")], "large").alias("size_band"))


@query("p20_category_mapping", "SELECT o_orderkey AS order_id, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'other' END AS state, CASE WHEN o_orderkey % 5 = 0 THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'P' THEN 'shipped' ELSE 'pending' END AS flow FROM orders")
def _(spark, d):
    o, s = table(spark, d, "orders"), F.col("o_orderstatus")
    return o.select(F.col("o_orderkey").alias("order_id"), X.mapped(s, {"F": "filled", "O": "open"}, "other").alias("state"), X.flag_status(F.col("o_orderkey") % 5 == 0, s == "P", s == "F").alias("flow"))


@query("p21_rate_category", sql("fx", "SELECT rate_date, base_ccy, quote_ccy, CASE WHEN (CASE WHEN base_ccy = 'USD' THEN quote_ccy ELSE base_ccy END) IN ('EUR','GBP','JPY','CHF','CAD','AUD','NZD') THEN 'major' ELSE 'minor' END AS category FROM fx"))
def _(spark, d):
    from .model import fx

    other = F.when(F.col("base_ccy") == "USD", F.col("quote_ccy")).otherwise(F.col("base_ccy"))
    return fx(spark, d).select("rate_date", "base_ccy", "quote_ccy", X.rate_category(other).alias("category"))


@query("p22_derived_text", "SELECT c_custkey AS customer_id, trim(c_name || ' ' || c_mktsegment) AS full_name, lower(c_mktsegment) || '.example' AS domain, list_transform(string_split(c_name, '#'), lambda x: trim(x))[2] AS number FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    email = F.concat(F.col("c_custkey").cast("string"), F.lit("@"), F.col("c_mktsegment"), F.lit(".example"))
    return c.select(F.col("c_custkey").alias("customer_id"), X.full_name(F.col("c_name"), F.col("c_mktsegment")).alias("full_name"), X.email_domain(email).alias("domain"), F.get(X.tag_array(F.col("c_name"), "#"), F.lit(1)).alias("number"))


@query("p23_age_in_days", sql("sales", "SELECT order_id, CAST(DATE '2002-01-01' - order_date AS INTEGER) AS age FROM sales"))
def _(spark, d):
    return sales(spark, d).select("order_id", X.age_in_days(F.col("order_date"), F.lit("2002-01-01").cast("date")).alias("age"))


@query("p24_date_parse", sql("sales", "SELECT order_id, CASE WHEN order_id % 3 = 2 THEN DATE '2000-01-01' ELSE order_date END AS d FROM sales"))
def _(spark, d):
    iso = F.date_format("order_date", "yyyy-MM-dd")
    first = F.when(F.col("order_id") % 3 == 0, iso).otherwise("n/a")
    second = F.when(F.col("order_id") % 3 == 1, F.concat(iso, F.lit("T10:00:00"))).otherwise("-")
    return sales(spark, d).select("order_id", X.date_like_or(first, second, F.lit("2000-01-01").cast("date")).alias("d"))


@query("p26_surrogate_key", "SELECT l_orderkey, l_linenumber, l_partkey, sha256(l_orderkey || '||' || l_linenumber || '||' || l_partkey) AS line_key FROM lineitem")
def _(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", X.surrogate_key(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).alias("line_key"))


@query("f01_not_null_and_range", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL AND l_quantity BETWEEN 10 AND 20 AND l_discount >= 0.05")
def _(spark, d):
    li = X.with_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])
    return li.where(X.in_range(F.col("l_quantity"), 10, 20) & X.in_range(F.col("l_discount"), 0.05)).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("f05_set_membership", "SELECT o_orderkey AS order_id, o_orderpriority AS priority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
def _(spark, d):
    return table(spark, d, "orders").where(X.member(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]) & X.not_member(F.col("o_orderstatus"), ["F"])).select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("priority"))


@query("f06_pattern", "SELECT p_partkey AS product_id, p_name AS name FROM part WHERE regexp_matches(p_name, '^(red|blue) ') AND length(trim(p_name)) > 0")
def _(spark, d):
    return table(spark, d, "part").where(F.col("p_name").rlike("^(red|blue) ") & X.non_blank(F.col("p_name"))).select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"))


@query("f08_freshness_window", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-29 00:00:00'")
def _(spark, d):
    return X.fresh(table(spark, d, "events"), "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), X.FRESHNESS_HOURS["fx"]).select("event_id")


@query("f09_lookback_split", sql("sales", "SELECT order_id, order_date >= DATE '2001-01-01' AS recent FROM sales"))
def _(spark, d):
    old, new = X.lookback_split(sales(spark, d), "order_date", F.lit("2001-01-01").cast("date"))
    return old.select("order_id", F.lit(False).alias("recent")).unionByName(new.select("order_id", F.lit(True).alias("recent")))


@query("f10_segment_page", sql("customers", "SELECT customer_id, customer_name FROM customers WHERE segment = 'BUILDING' ORDER BY customer_id LIMIT 25 OFFSET 10"))
def _(spark, d):
    return X.page(customers(spark, d).where("segment = 'BUILDING'"), "customer_id", 25, 10).select("customer_id", "customer_name")


@query("f11_row_rule_and_mask", sql("customers", "SELECT customer_id, region, left(customer_name, 1) || repeat('*', CAST(length(customer_name) - 1 AS INTEGER)) AS customer_name FROM customers WHERE region = 'ASIA'"))
def _(spark, d):
    from ..functions.privacy import mask_name

    return X.secured(customers(spark, d), "region = 'ASIA'", {"customer_name": mask_name(F.col("customer_name"))}).select("customer_id", "region", "customer_name")


@query("f12_having", sql("sales", "SELECT customer_id, sum(quantity) AS quantity FROM sales GROUP BY 1 HAVING sum(quantity) > 100"))
def _(spark, d):
    return sales(spark, d).groupBy("customer_id").agg(F.sum("quantity").alias("quantity")).where("quantity > 100")


@query("q25_sql_equals_dsl", sql("sales", "SELECT customer_id, sum(quantity) AS quantity FROM sales GROUP BY 1 HAVING sum(quantity) > 100"))
def _(spark, d):
    return spark.sql("SELECT customer_id, sum(quantity) AS quantity FROM {s} GROUP BY customer_id HAVING sum(quantity) > 100", s=sales(spark, d))


# --- joins ------------------------------------------------------------------------------------------------------


@query("j01_star_join", sql("sales customers products", "SELECT order_id, customer_name, country, product_name, total_amount FROM sales s LEFT JOIN customers c USING (customer_id) LEFT JOIN products p USING (product_id)"))
def _(spark, d):
    out = R.join_dimension(R.join_dimension(sales(spark, d), customers(spark, d), ["customer_id"]), products(spark, d), ["product_id"])
    return out.select("order_id", "customer_name", "country", "product_name", "total_amount")


@query("j03_small_dimension_join", "SELECT c_custkey AS customer_id, n_name AS country, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(R.small(n), c["c_nationkey"] == n["n_nationkey"]).join(R.small(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("country"), F.col("r_name").alias("region"))


@query("j05_rows_with_parent", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def _(spark, d):
    parents = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.with_parent(table(spark, d, "lineitem"), parents, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("j06_orphans", "SELECT c_custkey AS customer_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def _(spark, d):
    return R.orphans(table(spark, d, "customer"), table(spark, d, "events"), "c_custkey", "user_id").select(F.col("c_custkey").alias("customer_id"))


@query("j07_split_by_keys", sql("sales", "SELECT order_id, customer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS rejected FROM sales"))
def _(spark, d):
    bad = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("customer_id"))
    clean, rejected = R.split_by_keys(sales(spark, d), bad, ["customer_id"])
    return clean.select("order_id", F.lit(False).alias("rejected")).unionByName(rejected.select("order_id", F.lit(True).alias("rejected")))


@query("j08_full_outer_aggregates", "SELECT coalesce(a.k, b.k) AS k, round(coalesce(a.v, 0), 2) AS left_v, round(coalesce(b.v, 0), 2) AS right_v, round(coalesce(a.v, 0) - coalesce(b.v, 0), 2) AS diff_v FROM (SELECT c_nationkey AS k, sum(c_acctbal) AS v FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, sum(s_acctbal) AS v FROM supplier GROUP BY 1) b ON a.k = b.k")
def _(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("v"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("v"))
    return R.both_sides(a, b, ["k"], ["v"]).select("k", *[F.round(c, 2).alias(c) for c in ("left_v", "right_v", "diff_v")])


@query("j12_guarded_join", sql("sales products", "SELECT order_id, coalesce(product_id, -1) AS product_id, category FROM sales LEFT JOIN products USING (product_id)"))
def _(spark, d):
    return sales(spark, d).join(R.assert_unique(products(spark, d), ["product_id"]), "product_id", "left").select("order_id", R.key_or("product_id"), "category")


@query("j13_return_flag", "SELECT o_orderkey AS order_id, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS returned FROM orders")
def _(spark, d):
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order_id"))
    return R.flagged(table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id")), back, "order_id", "returned")


# --- aggregates -------------------------------------------------------------------------------------------------


@query("a01_orders_per_customer", sql("sales", "SELECT customer_id, round(sum(total_amount), 2) AS total, count(DISTINCT order_id) AS orders, round(avg(total_amount), 6) AS average, max(order_date) AS last_order, min(order_date) AS first_order FROM sales GROUP BY 1"))
def _(spark, d):
    return sales(spark, d).groupBy("customer_id").agg(F.round(F.sum("total_amount"), 2).alias("total"), F.count_distinct("order_id").alias("orders"), F.round(F.avg("total_amount"), 6).alias("average"), F.max("order_date").alias("last_order"), F.min("order_date").alias("first_order"))


@query("a03_conditional_counts", sql("behaviour", "SELECT customer_id, count(*) FILTER (event_type = 'signup') AS signups, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases, round(sum(CASE WHEN event_type = 'purchase' THEN amount ELSE 0 END), 2) AS revenue, count(DISTINCT session_id) AS sessions FROM behaviour GROUP BY 1"))
def _(spark, d):
    k = F.col("event_type")
    return behaviour(spark, d).groupBy("customer_id").agg(F.count_if(k == "signup").alias("signups"), F.count_if(k == "view").alias("views"), F.count_if(k == "purchase").alias("purchases"), F.round(F.sum(F.when(k == "purchase", F.col("amount")).otherwise(0)), 2).alias("revenue"), F.count_distinct("session_id").alias("sessions"))


@query("a04_behaviour_per_day", sql("behaviour", "SELECT customer_id, event_date, count(*) AS events, round(avg(amount) / 60, 8) AS avg_minutes FROM behaviour GROUP BY 1, 2"))
def _(spark, d):
    return behaviour(spark, d).groupBy("customer_id", "event_date").agg(F.count("*").alias("events"), F.round(F.avg("amount") / 60, 8).alias("avg_minutes"))


@query("a05_behaviour_by_kind", sql("behaviour customers", "SELECT country, segment, event_type, event_id % 2 = 0 AS mobile, count(*) AS events, count(DISTINCT session_id) AS sessions FROM behaviour LEFT JOIN customers USING (customer_id) GROUP BY ALL"))
def _(spark, d):
    e = behaviour(spark, d).join(customers(spark, d), "customer_id", "left").withColumn("mobile", F.col("event_id") % 2 == 0)
    return e.groupBy("country", "segment", "event_type", "mobile").agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"))


@query("a06_product_sales", "SELECT l_partkey AS product_id, sum(l_quantity) AS units, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("product_id")).agg(F.sum("l_quantity").alias("units"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), F.count_distinct("l_orderkey").alias("orders"))


@query("a07_daily_metrics", sql("sales", "SELECT year(order_date) AS year, month(order_date) AS month, day(order_date) AS day, count(*) AS orders, count(DISTINCT customer_id) AS customers, round(sum(total_amount), 2) AS revenue FROM sales GROUP BY ALL"))
def _(spark, d):
    return sales(spark, d).groupBy(F.year("order_date").alias("year"), F.month("order_date").alias("month"), F.dayofmonth("order_date").alias("day")).agg(F.count("*").alias("orders"), F.count_distinct("customer_id").alias("customers"), F.round(F.sum("total_amount"), 2).alias("revenue"))


@query("a08_return_metrics", "SELECT l_returnflag AS reason, count(*) AS lines, sum(l_quantity) AS units, round(avg(l_extendedprice), 4) AS avg_price FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("reason")).agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("units"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"))


@query("a10_segment_aggregates", sql("sales customers", "SELECT segment, CASE WHEN total_amount < 100000 THEN 'small' WHEN total_amount < 300000 THEN 'medium' ELSE 'large' END AS size, strftime(order_date, '%Y-%m') AS month, count(*) AS orders, round(sum(total_amount), 2) AS revenue FROM sales LEFT JOIN customers USING (customer_id) GROUP BY ALL"))
def _(spark, d):
    s = sales(spark, d).join(customers(spark, d), "customer_id", "left")
    return s.groupBy("segment", X.banded(F.col("total_amount"), [(100000, "small"), (300000, "medium")], "large").alias("size"), F.date_format("order_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("orders"), F.round(F.sum("total_amount"), 2).alias("revenue"))


@query("a12_global_aggregate", sql("sales", "SELECT count(*) AS orders, round(sum(total_amount), 2) AS revenue, min(order_date) AS first_order, max(order_date) AS last_order FROM sales"))
def _(spark, d):
    return sales(spark, d).agg(F.count("*").alias("orders"), F.round(F.sum("total_amount"), 2).alias("revenue"), F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"))


@query("a13_approximate_distinct")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.approx_count_distinct("l_orderkey", 0.01).alias("orders"), F.approx_count_distinct("l_partkey", 0.01).alias("products"))


@query("a13_estimates_within_tolerance", "SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS products, true AS orders_close, true AS products_close FROM lineitem")
def _(spark, d):
    lines = table(spark, d, "lineitem")
    exact = lines.select("l_orderkey").distinct().agg(F.count("*").alias("orders")).join(lines.select("l_partkey").distinct().agg(F.count("*").alias("products")))
    about = QUERIES["a13_approximate_distinct"](spark, d).select(F.col("orders").alias("o"), F.col("products").alias("p"))
    close = lambda x, y: F.abs(F.col(x) - F.col(y)) <= F.greatest(F.lit(1.0), 0.05 * F.col(y))  # noqa: E731  five times the stated deviation
    return exact.join(about).select("orders", "products", close("o", "orders").alias("orders_close"), close("p", "products").alias("products_close"))


@query("a17_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("a18_values_per_category", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("a22_latest_version_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l JOIN (SELECT l_orderkey AS k, max(l_linenumber) AS m FROM lineitem GROUP BY 1) x ON l_orderkey = k AND l_linenumber = m")
def _(spark, d):
    li = table(spark, d, "lineitem")
    top = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber"))
    return li.join(top, ["l_orderkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


# --- windows, top-k, sets ---------------------------------------------------------------------------------------


@query("w01_latest_order", sql("sales", "SELECT customer_id, order_id, order_date FROM sales QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC NULLS LAST, order_id DESC) = 1"))
def _(spark, d):
    return R.latest(sales(spark, d), ["customer_id"], R.newest("order_date", "order_id")).select("customer_id", "order_id", "order_date")


@query("w03_next_start", sql("sales", "SELECT order_id, customer_id, order_date, lead(k) OVER (PARTITION BY customer_id ORDER BY k) AS next_key FROM (SELECT *, strftime(order_date, '%Y%m%d') || lpad(order_id::VARCHAR, 9, '0') AS k FROM sales)"))
def _(spark, d):
    s = sales(spark, d).withColumn("k", F.concat(F.date_format("order_date", "yyyyMMdd"), F.lpad(F.col("order_id").cast("string"), 9, "0")))
    return R.with_next(s, ["customer_id"], "k", "next_key").select("order_id", "customer_id", "order_date", "next_key")


@query("w04_running_total", sql("sales", "SELECT order_id, customer_id, sum(quantity) OVER (PARTITION BY customer_id ORDER BY order_date) AS running_total FROM sales"))
def _(spark, d):
    return R.running_total(sales(spark, d), ["customer_id"], "order_date", "quantity").select("order_id", "customer_id", "running_total")


@query("w05_session_gaps", sql("behaviour", "SELECT event_id, round((epoch_us(event_ts) - epoch_us(lag(event_ts) OVER (PARTITION BY session_id ORDER BY event_ts, event_id))) / 1e6, 3) AS gap_seconds FROM behaviour"))
def _(spark, d):
    return R.gaps(behaviour(spark, d), ["session_id"], "event_ts", ["event_ts", "event_id"]).select("event_id", F.round("gap_seconds", 3).alias("gap_seconds"))


@query("w06_out_of_order", sql("sales", "SELECT order_id, coalesce(order_date < lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_id), false) AS out_of_order FROM sales"))
def _(spark, d):
    return R.out_of_order(sales(spark, d), ["customer_id"], "order_date", "order_id").select("order_id", "out_of_order")


@query("w07_share_of_total", sql("sales", "SELECT status, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM sales GROUP BY 1"))
def _(spark, d):
    return R.with_share(sales(spark, d).groupBy("status").agg(F.count("*").alias("n")), "n")


@query("t01_frequent_values", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10")
def _(spark, d):
    return R.frequent(table(spark, d, "lineitem"), "l_partkey", 10)


@query("t03_top_customers", sql("sales", "SELECT customer_id, round(sum(total_amount), 2) AS revenue FROM sales GROUP BY 1 ORDER BY revenue DESC, customer_id LIMIT 10"))
def _(spark, d):
    return R.top(sales(spark, d).groupBy("customer_id").agg(F.round(F.sum("total_amount"), 2).alias("revenue")), 10, F.desc("revenue"), F.asc("customer_id"))


@query("t06_seeded_sample")
def _(spark, d):
    return R.sampled(sales(spark, d), 0.1, 7, "order_id").select("order_id", "customer_id")


@query("t06_sample_share", sql("sales", "SELECT count(DISTINCT order_id) AS orders, true AS near_a_tenth, 0::BIGINT AS outside_the_larger FROM sales"))
def _(spark, d):
    small, all_ = (x.select("order_id").distinct() for x in (QUERIES["t06_seeded_sample"](spark, d), sales(spark, d)))
    larger = R.sampled(sales(spark, d), 0.2, 7, "order_id").select("order_id").distinct()
    outside = small.join(larger, "order_id", "left_anti").agg(F.count("*").alias("outside_the_larger"))
    share = all_.agg(F.count("*").alias("orders")).join(small.agg(F.count("*").alias("n")))
    near = F.abs(F.col("n") - 0.1 * F.col("orders")) <= 2 * F.sqrt(F.col("orders"))  # over six deviations
    return share.join(outside).select("orders", near.alias("near_a_tenth"), "outside_the_larger")


@query("u01_union_by_name", "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("u02_bag_difference", "SELECT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey").exceptAll(table(spark, d, "orders").select("o_orderkey"))


@query("u04_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


_CHANGED = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey + 100000000, o_orderstatus FROM orders WHERE o_orderkey % 13 = 0"
_TARGET = "SELECT o_orderkey AS k, o_orderstatus AS status FROM orders"


def _sides(spark, d):
    o = table(spark, d, "orders")
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    new = o.where(k % 11 != 0).select(k.alias("k"), F.when(k % 7 == 0, "X").otherwise(s).alias("status")).union(o.where(k % 13 == 0).select(k + 100000000, s))
    return new, o.select(k.alias("k"), s.alias("status"))


@query("u05_change_sets", f"WITH s AS ({_CHANGED}), t AS ({_TARGET}) SELECT coalesce(s.k, t.k) AS k, coalesce(s.status, t.status) AS status, CASE WHEN t.k IS NULL THEN 'insert' WHEN s.k IS NULL THEN 'delete' ELSE 'update' END AS change FROM s FULL JOIN t ON s.k = t.k WHERE t.k IS NULL OR s.k IS NULL OR s.status <> t.status")
def _(spark, d):
    return R.changes(*_sides(spark, d), ["k"])


@query("h07_apply_change_sets", f"WITH s AS ({_CHANGED}) SELECT k, status FROM s")
def _(spark, d):
    new, old = _sides(spark, d)
    return R.applied(old, R.changes(new, old, ["k"]), ["k"])


@query("k04_merge", f"WITH s AS ({_CHANGED}), t AS ({_TARGET}) SELECT coalesce(s.k, t.k) AS k, coalesce(s.status, t.status) AS status FROM s FULL JOIN t ON s.k = t.k")
def _(spark, d):
    new, old = _sides(spark, d)
    return R.merged(old, new, ["k"])
