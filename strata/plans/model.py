"""The driver's tables under the canonical names of the layered model, as DataFrames and as SQL for the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return joined.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def currency_of(key: str):  # noqa: ANN201
    """Every fourth order is in each of four currencies: the driver's tables have none."""
    return F.element_at(F.array(*[F.lit(x) for x in ("USD", "EUR", "GBP", "JPY")]), (F.col(key) % 4 + 1).cast("int"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the smallest product of their lines and the quantity of all."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.min("l_partkey").alias("product_id"), F.sum("l_quantity").alias("quantity"))
    joined = o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left")
    return joined.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), "product_id", "quantity", F.col("o_totalprice").alias("total_amount"),
        currency_of("o_orderkey").alias("currency"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("order_date"),
    )


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quotation a day and currency, derived from the order dates: euro and pound per unit, yen per dollar (and a
    worse inverted euro rate, so that direct rates have to win)."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("rate_date")).distinct()
    d = F.dayofmonth("rate_date")
    quotes = F.array(
        F.struct(F.lit("EUR").alias("base_ccy"), F.lit("USD").alias("quote_ccy"), F.round(1.05 + d / 1000.0, 4).alias("rate")),
        F.struct(F.lit("GBP").alias("base_ccy"), F.lit("USD").alias("quote_ccy"), F.round(1.25 + d / 1000.0, 4).alias("rate")),
        F.struct(F.lit("USD").alias("base_ccy"), F.lit("JPY").alias("quote_ccy"), F.round(100.0 + d, 4).alias("rate")),
        F.struct(F.lit("USD").alias("base_ccy"), F.lit("EUR").alias("quote_ccy"), F.round(0.5 + d / 1000.0, 4).alias("rate")),
    )
    return days.select("rate_date", F.explode(quotes).alias("q")).select("rate_date", "q.*")


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    return e.select(
        "event_id", F.col("user_id").alias("customer_id"), "event_type", F.col("value").alias("amount"), F.col("ts").alias("event_ts"), day.alias("event_date"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"), "props",
    )


CTE = {
    "customers": "SELECT c_custkey AS customer_id, c_name AS customer_name, n_name AS country, r_name AS region, c_mktsegment AS segment, c_acctbal AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "products": "SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS brand, p_type AS category, p_size AS size, p_retailprice AS price FROM part",
    "sales": "SELECT o_orderkey AS order_id, o_custkey AS customer_id, product_id, quantity, o_totalprice AS total_amount, CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'JPY' END AS currency, o_orderstatus AS status, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS order_date FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS product_id, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey",
    "fx": "SELECT rate_date, base_ccy, quote_ccy, round(CASE WHEN base_ccy = 'EUR' THEN 1.05 + day(rate_date) / 1000.0 WHEN base_ccy = 'GBP' THEN 1.25 + day(rate_date) / 1000.0 WHEN quote_ccy = 'JPY' THEN 100.0 + day(rate_date) ELSE 0.5 + day(rate_date) / 1000.0 END, 4)::DOUBLE AS rate FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS rate_date FROM orders), (VALUES ('EUR', 'USD'), ('GBP', 'USD'), ('USD', 'JPY'), ('USD', 'EUR')) q(base_ccy, quote_ccy)",
    "behaviour": "SELECT event_id, user_id AS customer_id, event_type, value AS amount, ts AS event_ts, CAST(ts AS DATE) AS event_date, user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, props FROM events",
    "rates": "SELECT rate_date, base_ccy AS currency, rate AS usd_rate FROM fx WHERE quote_ccy = 'USD' UNION ALL SELECT rate_date, quote_ccy, 1.0 / rate FROM fx WHERE quote_ccy = 'JPY'",
    "usd": "SELECT s.*, CASE WHEN s.currency = 'USD' THEN total_amount ELSE coalesce(total_amount * usd_rate, total_amount) END AS amount_usd FROM sales s LEFT JOIN rates r ON s.order_date = r.rate_date AND s.currency = r.currency",
}


def sql(names: str, body: str) -> str:
    """A SQL text over some of the canonical tables. A body may begin with ", name AS (...)" to add its own."""
    used = [n for n in names.split() if n]
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in used) + "\n" + body
