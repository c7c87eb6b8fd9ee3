import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from strata.operators.currency import in_usd, rate_faults, usd_rates
from strata.sources import readers as S
from strata.sources import writers as K
from strata.streaming import streams as T

SCHEMA = StructType([StructField("id", IntegerType()), StructField("name", StringType())])


def test_scans(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    df.write.orc(f"{tmp_path}/orc")
    assert S.read_any(spark, f"{tmp_path}/orc", SCHEMA).count() == 2
    assert S.read_any(spark, f"{tmp_path}/none", SCHEMA).count() == 0
    df.write.parquet(f"{tmp_path}/pq/day=1")
    df.write.parquet(f"{tmp_path}/pq/sub")
    (tmp_path / "pq/sub/bad.parquet").write_bytes(b"no parquet")
    assert S.read_parquet(spark, f"{tmp_path}/pq", SCHEMA, skip_corrupt=True).count() == 4
    (tmp_path / "kafka.csv").write_text('id,name\n1,"{""a"": 1}"\nx,plain\n')
    assert [tuple(r) for r in S.read_csv(spark, f"{tmp_path}/kafka.csv", SCHEMA).collect()] == [(1, '{"a": 1}'), (None, "plain")]
    (tmp_path / "inc/2024").mkdir(parents=True)
    (tmp_path / "inc/2024/x.csv").write_text("id,name\n3,c\n")
    assert S.read_csv_incremental(spark, SCHEMA, f"{tmp_path}/kafka.csv", f"{tmp_path}/inc").count() == 3
    assert S.read_csv_incremental(spark, SCHEMA, f"{tmp_path}/kafka.csv", f"{tmp_path}/absent").count() == 2
    (tmp_path / "m.json").write_text('[{"id": 1,\n "name": "q"}]')
    assert S.read_json(spark, f"{tmp_path}/m.json", SCHEMA, multi_line=True).first()["name"] == "q"


def test_fx_synonyms_and_faults(spark):
    raw = spark.createDataFrame([("2024-01-02", "usd", "eur", "0.9"), ("01/03/2024", "USD", "GBP", "-1"), ("01/04/2024", "gbp", "usd", "1.25")], "trade_date string, base_currency string, counter_ccy string, exchange_rate string")
    fx = S.canonical_fx(raw)
    assert [(str(r[0]), r[1], r[2], r[3]) for r in fx.orderBy("rate_date").collect()] == [("2024-01-02", "USD", "EUR", 0.9), ("2024-01-04", "GBP", "USD", 1.25)]
    assert rate_faults(fx).first().asDict() == {"null_keys": 0, "bad_rates": 0, "repeated_keys": 0}
    orders = spark.createDataFrame([("o1", "GBP", 100.0, "2024-01-04"), ("o2", None, 50.0, "2024-01-04"), ("o3", "CHF", 7.0, "2024-01-04")], "order_id string, currency string, amount double, d string").withColumn("d", F.to_date("d"))
    got = {r["order_id"]: r["amount_usd"] for r in in_usd(orders, usd_rates(fx), "d", "currency", "amount").collect()}
    assert got == {"o1": 125.0, "o2": 50.0, "o3": 7.0}
    with pytest.raises(Exception, match="no rate for CHF"):
        in_usd(orders, usd_rates(fx), "d", "currency", "amount", strict=True).collect()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d2")], "id int, v string, day string")
    path = f"{tmp_path}/t"
    K.write_slices(rows, path, ["day"])
    K.write_slice(spark.createDataFrame([(9, "z", "d2")], rows.schema), path, "day", "d2")
    assert sorted((r["id"], r["day"]) for r in spark.read.parquet(path).collect()) == [(1, "d1"), (9, "d2")]
    with pytest.raises(ValueError, match="outside"):
        K.write_slice(rows, path, "day", "d1")
    assert K.append_checked(spark, rows, f"{tmp_path}/a", ["id"]) == 2
    with pytest.raises(ValueError, match="repeat"):
        K.append_checked(spark, rows.union(rows), f"{tmp_path}/a", ["id"])
    for _ in range(2):
        K.write_run(rows, f"{tmp_path}/runs", "r1")
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 2
    out = K.merge_table(spark, rows.withColumn("v", F.lit("new")), path, f"{tmp_path}/m", ["id"])
    assert {(r["id"], r["v"]) for r in out.collect()} == {(1, "new"), (9, "z"), (2, "new")}
    with pytest.raises(ValueError, match="another path"):
        K.merge_table(spark, rows, path, path, ["id"])
    with pytest.raises(ValueError, match="missing: v"):
        K.write_table(rows.drop("v"), f"{tmp_path}/x", baseline=rows.schema)
    K.compact(rows, f"{tmp_path}/c", ["id"], 1)
    assert K.assert_written(spark, f"{tmp_path}/c").count() == 2
    assert K.rewrite_by_date(rows, f"{tmp_path}/by", "day") is True
    assert K.rewrite_by_date(rows, f"{tmp_path}/by2", "day", most_partitions=1) is False
    K.write_sample(rows, f"{tmp_path}/s", "id", 1)
    assert spark.read.option("header", True).csv(f"{tmp_path}/s").count() == 1
    dated = spark.createDataFrame([("2024-01-01",), ("2024-02-01",), (None,)], "d string")
    assert K.retained(dated, "d", F.lit("2024-02-05").cast("date"), 10).count() == 2
    done = K.staged_publish(spark, rows, f"{tmp_path}/st", f"{tmp_path}/pub", "r7", lambda df: df.where("id > 1"))
    assert done.count() == 1


def test_database_round_trip(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    try:
        K.write_jdbc(K.warehouse_names(rows), url, "T", "overwrite", driver=driver)
    except Exception as e:  # noqa: BLE001
        if "ClassNotFound" in str(e) or "No suitable driver" in str(e):
            pytest.skip("no embedded database on the class path")
        raise
    got = S.read_jdbc(spark, url, "SELECT ID, NAME FROM T WHERE ID > 1", {"ID": "key", "NAME": "label"}, driver=driver)
    assert [tuple(r) for r in got.collect()] == [(2, "b")]


def records(spark, tmp_path, name, values):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps({"key": "k", "value": v, "topic": "t", "partition": 0, "offset": o, "timestamp": ts}) for o, v, ts in values))


def test_both_lanes_and_restart(spark, tmp_path):
    day = F.lit("2024-01-01").cast("date")
    order = lambda i: json.dumps({"order_id": i, "amount": 2.5})
    records(spark, tmp_path, "a", [(1, order("o1"), "2024-01-01T00:00:00Z"), (2, "{broken", "2024-01-01T00:01:00Z"), (3, json.dumps({"amount": 1}), "2024-01-01T00:02:00Z")])

    def run():
        parsed = T.parsed(T.file_stream(spark, f"{tmp_path}/in"), "order_id string, amount double")
        T.write_lanes(parsed, ["order_id"], f"{tmp_path}/good", f"{tmp_path}/dead", f"{tmp_path}/cp", day).awaitTermination()
        good, dead = spark.read.parquet(f"{tmp_path}/good"), spark.read.parquet(f"{tmp_path}/dead")
        return good.count(), sorted(r["_reason"] for r in dead.collect())

    assert run() == (1, ["missing order_id", "undecodable"])
    assert run() == (1, ["missing order_id", "undecodable"])
    records(spark, tmp_path, "b", [(4, order("o2"), "2024-01-01T00:03:00Z")])
    assert run()[0] == 2


def test_deduplication_within_the_watermark(spark, tmp_path):
    order = json.dumps({"order_id": "o1"})
    records(spark, tmp_path, "a", [(1, order, "2024-01-01T00:00:00Z"), (2, order, "2024-01-01T00:10:00Z"), (3, json.dumps({"order_id": "o2"}), "2024-01-01T00:11:00Z")])
    parsed = T.parsed(T.file_stream(spark, f"{tmp_path}/in"), "order_id string")
    once = T.deduplicated(parsed, ["order_id"], "timestamp").select("order_id")
    T.append_stream(once, f"{tmp_path}/out", f"{tmp_path}/cp2", F.lit("2024-01-01").cast("date")).awaitTermination()
    assert sorted(r["order_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["o1", "o2"]


def test_stream_settings():
    good = {"watermark": "10 minutes", "dead_letter_path": "d", "checkpoint_path": "c", "output_path": "o"}
    assert T.config_faults(good) == []
    assert T.config_faults({"watermark": "10"}) == ["watermark needs a number and a unit", "dead_letter_path is missing", "checkpoint_path is missing", "output_path is missing"]
