"""Queries over scans, sinks and streams: whole tables are written through a sink and read back through a scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers as S
from ..sources import writers as W
from ..streaming import streams as T
from .model import fx, sales, sql, table
from .registry import query

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
_KIND = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"


def orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


# --- scans --------------------------------------------------------------------------------------------------------


@query("s01_mixed_layouts", _ORDERS)
def _(spark, d):
    path, o = W.work_path(spark, "mixed"), orders(spark, d)
    o.where("o_orderkey % 2 = 0").write.parquet(f"{path}/a/part=1")
    o.where("o_orderkey % 2 <> 0").write.parquet(f"{path}/b/other=x/deep")
    return S.read_parquet(spark, path, o.schema).select(o.columns)


@query("s02_first_readable_format", _ORDERS)
def _(spark, d):
    path = W.work_path(spark, "any")
    orders(spark, d).write.option("header", True).csv(path)
    return S.read_any(spark, path, orders(spark, d).schema, ("parquet", "orc", "csv"))


@query("s03_delimited", _ORDERS)
def _(spark, d):
    path = W.work_path(spark, "csv")
    orders(spark, d).write.option("header", True).csv(path)
    return S.read_csv(spark, path, orders(spark, d).schema)


@query("s04_snapshot_and_increments", _ORDERS)
def _(spark, d):
    path, o = W.work_path(spark, "increments"), orders(spark, d)
    o.where("o_orderkey % 3 = 0").write.option("header", True).csv(f"{path}/snapshot")
    for k in (1, 2):
        o.where(f"o_orderkey % 3 = {k}").write.option("header", True).csv(f"{path}/later/day={k}")
    return S.read_csv_incremental(spark, o.schema, f"{path}/snapshot", f"{path}/later").select(o.columns)


@query("s05_delimited_with_json", "SELECT event_id, props FROM events")
def _(spark, d):
    path, e = W.work_path(spark, "csv-json"), table(spark, d, "events").select("event_id", "props")
    e.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return S.read_csv(spark, path, e.schema)


@query("s06_json_lines", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, d):
    path, e = W.work_path(spark, "json"), table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    e.write.json(path)
    return S.read_json(spark, path, e.schema)


@query("s07_rates_from_first_source", sql("fx", "SELECT rate_date, base_ccy, quote_ccy, rate, CAST(NULL AS VARCHAR) AS source FROM fx"))
def _(spark, d):
    path = W.work_path(spark, "rates")
    found = fx(spark, d).select(F.date_format("rate_date", "yyyy-MM-dd").alias("as_of_date"), F.col("base_ccy").alias("base_currency"), F.col("quote_ccy").alias("target_currency"), F.col("rate").alias("mid_rate"))
    found.write.json(f"{path}/json")
    return S.read_fx(spark, [("parquet", f"{path}/none"), ("json", f"{path}/json")], found.schema)


@query("s11_ingestion_columns", "SELECT o_orderkey, 'b1' AS _batch_id, 'shop' AS _source, 'orders' AS _table, DATE '2024-01-02' AS _run_date FROM orders")
def _(spark, d):
    got = S.with_ingestion(orders(spark, d).withColumn("_source", F.lit("shop")), "b1", "other", "orders", F.lit("2024-01-02").cast("date"), F.current_timestamp())
    return got.select("o_orderkey", "_batch_id", "_source", "_table", "_run_date")


@query("s12_newest_values", "SELECT 'orders' AS name, CAST(max(o_orderdate) AS DATE) AS newest FROM orders UNION ALL SELECT 'events', CAST(max(ts) AS DATE) FROM events")
def _(spark, d):
    newest = lambda name, column: S.newest_value(table(spark, d, name), column).select(F.lit(name).alias("name"), F.to_date("newest").alias("newest"))
    return newest("orders", "o_orderdate").unionByName(newest("events", "ts"))


# --- sinks --------------------------------------------------------------------------------------------------------


@query("k01_overwrite_then_append", _ORDERS)
def _(spark, d):
    path, o = W.work_path(spark, "table"), orders(spark, d)
    W.write_table(o.where("o_orderkey % 2 = 0"), path)
    W.write_table(o.where("o_orderkey % 2 <> 0"), path, "append", baseline=o.schema)
    return S.read_parquet(spark, path)


@query("k02_replaced_slices", "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def _(spark, d):
    path, o = W.work_path(spark, "slices"), orders(spark, d)
    W.write_slices(o, path, ["o_orderstatus"])
    W.write_slices(o.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2), path, ["o_orderstatus"])
    return spark.read.schema(_KIND).parquet(path)


@query("k03_one_slice", "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def _(spark, d):
    path, o = W.work_path(spark, "slice"), orders(spark, d)
    W.write_slices(o, path, ["o_orderstatus"])
    W.write_slice(o.where("o_orderstatus = 'O'").withColumn("o_totalprice", F.col("o_totalprice") + 1), path, "o_orderstatus", "O")
    return spark.read.schema(_KIND).parquet(path)


@query("k05_checked_appends", _ORDERS)
def _(spark, d):
    path, o = W.work_path(spark, "appends"), orders(spark, d)
    for k in range(2):
        W.append_checked(spark, o.where(f"o_orderkey % 2 = {k}"), path, ["o_orderkey"])
    return S.read_parquet(spark, path)


@query("k06_repeated_run", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'r1' ELSE 'r2' END AS _run_id FROM orders")
def _(spark, d):
    path, o = W.work_path(spark, "runs"), orders(spark, d)
    for run, part in (("r1", 0), ("r2", 1), ("r1", 0)):
        W.write_run(o.where(f"o_orderkey % 2 = {part}"), path, run)
    return spark.read.schema(_KIND + ", _run_id string").parquet(path).select("o_orderkey", "_run_id")


@query("k07_staged_publish", _ORDERS + " WHERE o_totalprice > 1000")
def _(spark, d):
    path = W.work_path(spark, "staged")
    return W.staged_publish(spark, orders(spark, d), f"{path}/stage", f"{path}/live", "r1", lambda staged: staged.where("o_totalprice > 1000"))


@query("k09_warehouse_names", 'SELECT o_orderkey AS "O_ORDERKEY", o_totalprice AS "O_TOTAL_PRICE_" FROM orders')
def _(spark, d):
    return W.warehouse_names(orders(spark, d).select("o_orderkey", F.col("o_totalprice").alias("o_total price!")))


@query("k10_written_and_asserted", _ORDERS)
def _(spark, d):
    path = W.work_path(spark, "asserted")
    W.write_table(orders(spark, d), path)
    return W.assert_written(spark, path)


@query("k11_sample_file", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def _(spark, d):
    path, o = W.work_path(spark, "sample"), orders(spark, d).select("o_orderkey", "o_totalprice")
    W.write_sample(o, path, "o_orderkey", 100)
    return S.read_csv(spark, path, o.schema)


@query("k12_clustered_files", _ORDERS)
def _(spark, d):
    path = W.work_path(spark, "compact")
    W.compact(orders(spark, d), path, ["o_custkey"], 4)
    return S.read_parquet(spark, path)


@query("k13_capped_files", "SELECT count(*) AS n, true AS few FROM orders")
def _(spark, d):
    path = W.work_path(spark, "capped")
    W.write_table(W.capped(orders(spark, d), 2), path)
    return S.read_parquet(spark, path).withColumn("_file", F.input_file_name()).agg(F.count("*").alias("n"), (F.count_distinct("_file") <= 2).alias("few"))


@query("k14_retained", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1999-06-30' - 365 OR o_orderdate IS NULL")
def _(spark, d):
    return W.retained(table(spark, d, "orders"), "o_orderdate", F.lit("1999-06-30").cast("date"), 365).select("o_orderkey")


@query("k15_rewritten_by_date", sql("sales", "SELECT order_id, order_date FROM sales"))
def _(spark, d):
    path = W.work_path(spark, "by-date")
    W.rewrite_by_date(sales(spark, d).select("order_id", "order_date"), path, "order_date", 50)
    return spark.read.schema("order_id long, order_date date").parquet(path)


# --- streams ------------------------------------------------------------------------------------------------------

_FIELDS = "user_id long, event_type string, value double, at timestamp"


def lanes(spark, d):
    """All events as records on a stream (every third twice, errors without a type, every 50th undecodable) through parsing,
    watermark de-duplication and both lanes."""
    path, e = W.work_path(spark, "stream"), table(spark, d, "events")
    good = F.to_json(F.struct("user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"), "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at")))
    e = e.select(F.col("event_id").cast("string").alias("key"), F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(good).alias("value"), F.lit("events").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"))
    e.unionByName(e.where("offset % 3 = 0")).write.json(f"{path}/in")
    stream = T.deduplicated(T.parsed(T.file_stream(spark, f"{path}/in"), _FIELDS), ["key"], "timestamp", "1 hour")
    T.write_lanes(stream, ["event_type"], f"{path}/valid", f"{path}/dead", f"{path}/state", F.lit("2024-01-02").cast("date")).awaitTermination()
    return f"{path}/valid", f"{path}/dead"


@query("st03_stream_valid_lane", "SELECT CAST(event_id AS VARCHAR) AS key, event_id AS \"offset\", user_id, event_type, value FROM events WHERE event_id % 50 <> 0 AND event_type <> 'error'")
def _(spark, d):
    return spark.read.parquet(lanes(spark, d)[0]).select("key", "offset", "user_id", "event_type", "value")


@query("st09_stream_dead_letters", "SELECT CAST(event_id AS VARCHAR) AS key, CASE WHEN event_id % 50 = 0 THEN 'undecodable' ELSE 'missing event_type' END AS reason, true AS failure_time FROM events WHERE event_id % 50 = 0 OR event_type = 'error' OR event_type IS NULL")
def _(spark, d):
    return spark.read.parquet(lanes(spark, d)[1]).select("key", F.col("_reason").alias("reason"), (F.col("_failed_at") <= F.current_timestamp()).alias("failure_time"))


@query("st07_stream_append", "SELECT event_id, event_type, DATE '2024-01-02' AS _proc_date FROM events")
def _(spark, d):
    path, e = W.work_path(spark, "append-stream"), table(spark, d, "events").select("event_id", "event_type")
    e.write.json(f"{path}/in")
    T.append_stream(T.file_stream(spark, f"{path}/in", "event_id long, event_type string"), f"{path}/out", f"{path}/state", F.lit("2024-01-02").cast("date")).awaitTermination()
    return spark.read.parquet(f"{path}/out")
