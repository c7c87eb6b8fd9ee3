"""Queries for table layouts, fingerprint trees, stored profiles, upserts, as-of context and persisted state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile as K
from ..operators import relational as R
from ..operators import sketches as S
from ..sources import layout as L
from ..sources import state as P
from ..sources import writers as W
from .model import table
from .registry import query

# --- layouts ------------------------------------------------------------------------------------------------------


def z_ordered_lines(spark, d):
    """All line items clustered by part and by order in 64 files."""
    path, li = W.work_path(spark, "z-order"), table(spark, d, "lineitem")
    L.z_ordered(li, path, ["l_partkey", "l_orderkey"], 64)
    return path, li


@query("k12_z_ordered_rows", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_partkey BETWEEN (SELECT max(l_partkey) // 2 FROM lineitem) AND (SELECT max(l_partkey) // 2 + max(l_partkey) // 20 FROM lineitem)")
def _(spark, d):
    path, li = z_ordered_lines(spark, d)
    most = li.agg(F.max("l_partkey")).first()[0]
    return spark.read.parquet(path).where(F.col("l_partkey").between(most // 2, most // 2 + most // 20)).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


_PRUNED = "SELECT '{0}' AS column_name, count(*) AS row_count, true AS z_order_prunes, {1} AS sort_prunes FROM lineitem WHERE {0} BETWEEN (SELECT max({0}) // 2 FROM lineitem) AND (SELECT max({0}) // 2 + max({0}) // 20 FROM lineitem)"


@query("k12_files_touched", _PRUNED.format("l_partkey", "true") + " UNION ALL " + _PRUNED.format("l_orderkey", "false"))
def _(spark, d):
    """A twentieth of each column's range: the files that may hold it are under half of the 64 for both columns when
    interleaved; when sorted by part and order, a range of orders touches nearly all."""
    path, li = z_ordered_lines(spark, d)
    plain = W.work_path(spark, "sorted")
    W.compact(li, plain, ["l_partkey", "l_orderkey"], 64)
    columns = ["l_partkey", "l_orderkey"]
    top = li.agg(*[F.max(c) for c in columns]).first()
    wanted = {c: (m // 2, m // 2 + m // 20) for c, m in zip(columns, top, strict=True)}
    z, s = (L.files_touched(L.file_ranges(spark, p, columns), wanted) for p in (path, plain))
    counts = li.agg(*[F.count_if(F.col(c).between(*wanted[c])).alias(f"n_{c}") for c in columns])
    both = counts.join(F.broadcast(z.select(*[(F.col(f"touched_{c}") * 2 < F.col("files")).alias(f"z_{c}") for c in columns]))).join(F.broadcast(s.select(*[(F.col(f"touched_{c}") * 2 < F.col("files")).alias(f"s_{c}") for c in columns])))
    return both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("row_count"), F.col(f"z_{c}").alias("z_order_prunes"), F.col(f"s_{c}").alias("sort_prunes")) for c in columns])).alias("r")).select("r.*")


# --- fingerprint trees --------------------------------------------------------------------------------------------


def edited_orders(spark, d):
    """All orders, and a copy in which a few are changed, missing or extra."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    price = F.when(k % 1009 == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    extra = o.where(k % 2003 == 11).withColumn("o_orderkey", -k)
    return o, o.where(k % 1511 != 7).withColumn("o_totalprice", price).unionByName(extra)


@query(
    "c24_differing_keys",
    "SELECT o_orderkey, 'only_left' AS difference FROM orders WHERE o_orderkey % 1511 = 7 UNION ALL SELECT o_orderkey, 'changed' FROM orders WHERE o_orderkey % 1009 = 5 AND o_orderkey % 1511 <> 7 UNION ALL SELECT -o_orderkey, 'only_right' FROM orders WHERE o_orderkey % 2003 = 11",
)
def _(spark, d):
    return K.differing_keys(*edited_orders(spark, d), "o_orderkey")


@query(
    "c24_rows_read_below_the_root",
    "WITH k AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 1009 = 5 OR o_orderkey % 1511 = 7), s AS (SELECT min(o_orderkey) AS low, ((max(o_orderkey) - min(o_orderkey) + 1) + 65535) // 65536 AS width FROM orders),"
    " n AS (SELECT DISTINCT (k - low) // width AS node FROM k, s) SELECT count(*) AS leaves, (SELECT count(*) FROM orders, s WHERE (o_orderkey - low) // width IN (SELECT node FROM n)) AS rows_read FROM n",
)
def _(spark, d):
    o, _ = edited_orders(spark, d)
    k = F.col("o_orderkey")
    other = o.where(k % 1511 != 7).withColumn("o_totalprice", F.when(k % 1009 == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    low, high = o.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    nodes = K.differing_nodes(*[K.fingerprint_tree(df, "o_orderkey", low, high) for df in (o, other)])
    read = o.withColumn("node", K.leaf_of("o_orderkey", low, high, 2)).join(nodes, "node", "left_semi").agg(F.count("*").alias("rows_read"))
    return nodes.agg(F.count("*").alias("leaves")).join(F.broadcast(read))


# --- stored profiles ----------------------------------------------------------------------------------------------


def stored_events(spark, d, shift=1.0):
    """Profiles of all events by day, written as a table and read back."""
    path = W.work_path(spark, "profiles")
    e = table(spark, d, "events").withColumn("day", F.to_date("ts")).withColumn("value", F.col("value") * shift)
    S.slice_profiles(e, ["user_id", "value", "event_type"], ["day"]).write.parquet(path)
    return spark.read.parquet(path)


_EXACT = "SELECT '{0}' AS column_name, count(*) AS row_count, count(*) FILTER ({0} IS NULL) AS nulls, {1} AS low, {2} AS high, {3} AS mean, {4} AS stddev, true AS distinct_within, true AS median_within FROM events"


@query(
    "c17_merged_profile",
    " UNION ALL ".join([_EXACT.format(c, f"min({c})::DOUBLE", f"max({c})::DOUBLE", f"round(avg({c}), 4)", f"round(stddev({c}), 4)") for c in ("user_id", "value")] + [_EXACT.format("event_type", *["NULL::DOUBLE"] * 4)]),
)
def _(spark, d):
    """Profiles of days, merged: counts, extremes and moments are exact, distinct counts within 5 %, medians within 2 % of
    the rows, both held against the data itself here."""
    told = S.report(S.merged_slices(stored_events(spark, d)))
    e = table(spark, d, "events")
    columns = ["user_id", "value", "event_type"]
    share = lambda c: F.avg((F.col(c) <= F.col(f"m_{c}")).cast("double"))
    medians = told.agg(*[F.max(F.when(F.col("column_name") == c, F.col("median"))).alias(f"m_{c}") for c in columns[:2]])
    truth = e.join(F.broadcast(medians)).agg(*[F.count_distinct(c).alias(f"d_{c}") for c in columns], *[share(c).alias(f"s_{c}") for c in columns[:2]])
    rows = truth.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"d_{c}").alias("d"), (F.col(f"s_{c}") if c != "event_type" else F.lit(0.5)).alias("s")) for c in columns])).alias("t")).select("t.*")
    # a value's share may jump over the median where rows tie
    return told.join(rows, "column_name").select(
        "column_name", "row_count", "nulls", "low", "high", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), (F.abs(F.col("distinct") - F.col("d")) <= 0.05 * F.col("d") + 1).alias("distinct_within"), (F.abs(F.col("s") - 0.5) <= 0.02).alias("median_within"),
    )


@query(
    "c20_drift_of_stored_profiles",
    "WITH a AS (SELECT avg(value) AS m FROM events WHERE ts < TIMESTAMP '2024-01-16'), b AS (SELECT avg(value * 1.5) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-16')"
    " SELECT 'value' AS column_name, round(abs(b.m - a.m) / a.m, 4) AS mean_change, abs(b.m - a.m) / a.m > 0.2 AS drifted FROM a, b UNION ALL SELECT 'event_type', 0.0, false UNION ALL SELECT 'user_id', round(abs(b.m - a.m) / a.m, 4), abs(b.m - a.m) / a.m > 0.2"
    " OR abs(b.u - a.u) / a.u > 0.25 FROM (SELECT avg(user_id) AS m, count(DISTINCT user_id)::DOUBLE AS u FROM events WHERE ts < TIMESTAMP '2024-01-16') a, (SELECT avg(user_id) AS m, count(DISTINCT user_id)::DOUBLE AS u FROM events WHERE ts >= TIMESTAMP '2024-01-16') b",
)
def _(spark, d):
    """Two halves of the days from stored profiles alone: values of the later half are half as large again."""
    cut = F.lit("2024-01-16").cast("date")
    old, new = stored_events(spark, d).where(F.col("day") < cut), stored_events(spark, d, 1.5).where(F.col("day") >= cut)
    return S.drift_of(S.merged_slices(old), S.merged_slices(new), distinct_delta=0.25).select("column_name", F.round("mean_change", 4).alias("mean_change"), "drifted")


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


@query(
    "c18_dataset_profile",
    "SELECT 'rows' AS section, 'all' AS name, count(*)::DOUBLE AS value FROM lineitem UNION ALL SELECT 'type', 'double', 3.0 UNION ALL SELECT 'type', 'string', 1.0"
    + "".join(f" UNION ALL SELECT 'completeness', '{c}', count({c}) / count(*)::DOUBLE FROM lineitem" for c in _LINE)
    + "".join(f" UNION ALL SELECT 'correlation', '{a}~{b}', round(corr({a}, {b}), 6) FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")))
    + "".join(f" UNION ALL SELECT 'outliers', '{c}', 0.0" for c in _LINE[:3]),
)
def _(spark, d):
    """Type mix, completeness, outliers and correlations of all line items (their measures are uniform: none is an outlier)."""
    return S.dataset_profile(table(spark, d, "lineitem"), _LINE).select("section", "name", F.round("value", 6).alias("value"))


# --- loads and merges ---------------------------------------------------------------------------------------------


@query(
    "k05_observed_load",
    "SELECT count(*) AS rows_in, count(*) FILTER (o_totalprice > 50000) AS rows_out, count(*) FILTER (o_orderkey % 13 = 0) AS null_keys, count(*) FILTER (o_totalprice > 50000) AS rows_written FROM orders",
)
def _(spark, d):
    """Counts of a load as its own job saw them, beside the rows that are there afterwards."""
    path, o = W.work_path(spark, "observed-load"), table(spark, d, "orders")
    o = o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey")))
    seen = W.load_observed(o, lambda df: df.where("o_totalprice > 50000"), path, ["o_custkey"], W.Bounds(least_rows=1, most_null_keys=10**12))
    return spark.read.parquet(path).agg(*[F.lit(n).alias(c) for c, n in seen.items()], F.count("*").alias("rows_written"))


def sliced_orders(spark, d):
    """All orders in slices by month, and updates of some: prices change, and every third moves a month on."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    k = F.col("o_orderkey")
    moved = F.when(k % 3 == 0, F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM")).otherwise(F.col("month"))
    # the 7th of each thousand, of the years up to 1993: later slices stay as they are, but for new orders in one of their own
    updates = o.where((k % 1000 == 7) & (F.col("month") < "1994")).withColumns({"o_totalprice": F.col("o_totalprice") + 1, "month": moved})
    return o, updates.unionByName(o.where(k % 500 == 1).withColumns({"o_orderkey": -k, "month": F.lit("new")}))


_MERGED = (
    "WITH o AS (SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m') AS month FROM orders), u AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN strftime(CAST(month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') ELSE month END AS month"
    " FROM o WHERE o_orderkey % 1000 = 7 AND month < '1994' UNION ALL SELECT -o_orderkey, o_totalprice, 'new' FROM o WHERE o_orderkey % 500 = 1), m AS (SELECT * FROM u UNION ALL SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u)), t AS (SELECT month FROM u UNION SELECT month FROM o WHERE o_orderkey IN (SELECT o_orderkey FROM u))"
)


@query("k04_merge_into_slices", _MERGED + " SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice, month FROM m")
def _(spark, d):
    path, (o, updates) = W.work_path(spark, "sliced"), sliced_orders(spark, d)
    o.repartition("month").write.partitionBy("month").parquet(path)
    W.write_table(updates, path, "merge", ["month"], keys=["o_orderkey"])
    return spark.read.schema("o_orderkey long, o_totalprice double, month string").parquet(path).select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "month")


@query("k04_slices_rewritten", _MERGED + " SELECT (SELECT count(*) FROM t) AS rewritten, (SELECT count(DISTINCT month) FROM m) AS slices, (SELECT count(DISTINCT month) FROM o WHERE month NOT IN (SELECT month FROM t)) AS kept_files")
def _(spark, d):
    """Slices that a merge rewrote, and those whose files are the same as before it."""
    path, (o, updates) = W.work_path(spark, "sliced"), sliced_orders(spark, d)
    o.repartition("month").write.partitionBy("month").parquet(path)
    files = lambda: spark.read.schema("o_orderkey long, o_totalprice double, month string").parquet(path).groupBy("month").agg(F.array_sort(F.collect_set(F.col("_metadata.file_path"))).alias("files"))
    before = files()
    before.write.parquet(listed := W.work_path(spark, "files"))
    rewritten = W.merge_slices(updates, path, ["o_orderkey"], ["month"])
    both = files().join(spark.read.parquet(listed).withColumnRenamed("files", "before"), "month", "left")
    return both.agg(F.lit(len(rewritten)).alias("rewritten"), F.count("*").alias("slices"), F.count_if(F.col("files") == F.col("before")).alias("kept_files"))


@query("k01_merge_mode", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'merged' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, d):
    path, o = W.work_path(spark, "merge-mode"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    W.write_table(o.where("o_orderkey % 20 <> 0"), path, "merge", keys=["o_orderkey"])
    W.write_table(o.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("merged")), path, "merge", keys=["o_orderkey"], baseline=o.schema)
    return spark.read.parquet(path)


@query("k10_json_lines", "SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events")
def _(spark, d):
    path, e = W.work_path(spark, "json"), table(spark, d, "events")
    W.write_json(e.select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value")), path)
    return spark.read.schema("event_id long, user_id long, event_type string, value double").json(path)


# --- joins --------------------------------------------------------------------------------------------------------


@query("j01_spread_join", "SELECT d.doc_id, d.source, n.documents, n.source IS NOT NULL AS matched FROM (SELECT doc_id, source FROM documents) d FULL JOIN (SELECT source, count(*) AS documents FROM documents WHERE source <> 'src5' GROUP BY 1 UNION ALL SELECT 'none', 0) n ON d.source = n.source")
def _(spark, d):
    """All documents with the size of their source (one source holds a third of them), but one source and one without any."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    sizes = docs.where("source <> 'src5'").groupBy("source").agg(F.count("*").alias("documents")).unionByName(spark.range(1).select(F.lit("none").alias("source"), F.lit(0).cast("long").alias("documents")))
    out = R.join_spread(docs, sizes.withColumn("_hit", F.lit(True)), "source", "full")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("source")).alias("source"), "documents", F.col("_hit").isNotNull().alias("matched"))


@query("j09_order_before_each_event", "WITH e AS (SELECT event_id, user_id, ts - INTERVAL 9125 DAY AS moved FROM events), o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) SELECT event_id, o_orderkey FROM e ASOF LEFT JOIN o ON user_id = o_custkey AND moved >= o_orderdate")
def _(spark, d):
    """The last order of its user at or before each event, carried over years."""
    e = table(spark, d, "events").select("event_id", "user_id", F.expr("ts - interval 9125 days").alias("at"))
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "user_id")
    return R.as_of(e, o, ["user_id"], "at", "o_orderdate", ["o_orderkey"], order=["o_orderkey"], split="year").select("event_id", "o_orderkey")


# --- persisted state ----------------------------------------------------------------------------------------------


@query("s10_persisted_marks", "SELECT event_type AS source, max(ts) AS mark, CASE WHEN max(ts) >= TIMESTAMP '2024-01-16' THEN 'second' ELSE 'first' END AS run_id FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def _(spark, d):
    """Marks after two runs, a repeated first run and one that sees older rows: none moves back."""
    state = P.marks(spark, W.work_path(spark, "marks"))
    e = table(spark, d, "events").where("event_type is not null").select(F.col("event_type").alias("source"), F.col("ts").alias("mark"))
    early = e.where("mark < timestamp_ntz '2024-01-16 00:00:00'")
    for run, seen in (("first", early), ("second", e), ("first", early), ("third", early)):
        P.advance(state, seen, run)
    return state.read().select("source", F.col("mark").cast("timestamp_ntz").alias("mark"), "run_id")


@query("s09_unread_rows", "SELECT event_id FROM events WHERE event_type = 'click' AND ts > (SELECT max(ts) FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-16')")
def _(spark, d):
    state, e = P.marks(spark, W.work_path(spark, "marks")), table(spark, d, "events").where("event_type = 'click'")
    P.advance(state, e.where("ts < timestamp_ntz '2024-01-16 00:00:00'").select(F.lit("clicks").alias("source"), F.col("ts").alias("mark")), "first")
    return P.unread(e, state, "clicks", "ts").select("event_id")


@query("h08_log_taken_once", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS batch FROM orders")
def _(spark, d):
    """A log of two batches, one of them sent again."""
    path, o = W.work_path(spark, "log"), table(spark, d, "orders").select("o_orderkey")
    state = P.Versions(spark, f"{path}/state", "run_id string, folder string")
    for k, batch in enumerate(("even", "odd", "even")):
        P.append_once(state, f"{path}/log", o.where(f"o_orderkey % 2 = {k % 2}").withColumn("batch", F.lit(batch)), batch)
    return P.read_log(state, "o_orderkey long, batch string")
