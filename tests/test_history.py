import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strata.operators import history as H
from strata.operators import relational as R


def at(text):
    return dt.datetime.fromisoformat(text)


COLUMNS = "customer_id string, name string, email string, address string, start timestamp"


def load(spark, rows):
    return spark.createDataFrame([(k, n, e, a, at(t)) for k, n, e, a, t in rows], COLUMNS)


GOLDEN = [
    [("C001", "Ann", "a@x", "1 St", "2024-01-01"), ("C002", "Bob", "b@x", "2 St", "2024-01-01")],
    [("C001", "Ann", "a@x", "9 St", "2024-01-15"), ("C003", "Cy", "c@x", "3 St", "2024-01-15")],
    [("C001", "Ann", "a@x", "1 St", "2024-01-05T10:00:00"), ("C004", "Di", "d@x", "4 St", "2024-01-05T10:00:00")],
]


@pytest.mark.parametrize(("keep", "total"), [(False, 5), (True, 6)])
def test_golden_history(spark, keep, total):
    table = None
    for rows in GOLDEN:
        table = H.apply_scd2(table, load(spark, rows), ["customer_id"], ["name", "email", "address"], "start", keep)
    got = table.collect()
    assert len(got) == total
    assert sum(r["is_current"] for r in got) == 4
    assert H.history_faults(table, ["customer_id"]).first().asDict() == {"keys_without_one_current": 0, "closed_current": 0, "overlaps": 0, "inverted": 0, "null_keys": 0}
    again = H.apply_scd2(table, load(spark, GOLDEN[1]), ["customer_id"], ["name", "email", "address"], "start", keep)
    assert again.count() == total


def test_history_faults_are_found(spark):
    bad = spark.createDataFrame([("a", at("2024-01-01"), at("2024-03-01"), False), ("a", at("2024-02-01"), None, True), ("b", at("2024-02-01"), at("2024-01-01"), True), (None, at("2024-02-01"), None, True)], "k string, effective_from timestamp, effective_to timestamp, is_current boolean")
    got = H.history_faults(bad, ["k"]).first()
    assert (got["overlaps"], got["inverted"], got["closed_current"], got["null_keys"]) == (1, 1, 1, 1)


def test_history_invariants_on_random_rows(spark):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(6)}", rng.choice("xy"), "e", None if rng.random() < 0.2 else "a", f"2024-01-{rng.randrange(1, 28):02d}") for _ in range(120)]
    table = H.apply_scd2(None, load(spark, rows), ["customer_id"], ["name", "email", "address"], "start")
    assert set(H.history_faults(table, ["customer_id"]).first().asDict().values()) == {0}


def test_apply_changes_without_an_op_column_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", None)], "id int, v string, updated_at int")
    assert sorted(map(tuple, H.apply_changes(df, ["id"]).collect())) == [(1, "b", 2), (2, "c", None)]


def test_apply_changes_drops_deletes(spark):
    df = spark.createDataFrame([(1, "u", 1), (1, "d", 2), (2, None, 1), (3, "delete", 5)], "id int, op string, updated_at int")
    assert [r["id"] for r in H.apply_changes(df, ["id"]).collect()] == [2]


def test_rolling_upsert(spark):
    old = spark.createDataFrame([(1, "2024-01-01", 1), (2, "2024-02-01", 1), (3, None, 1)], "id int, d string, v int").withColumn("d", F.to_date("d"))
    new = spark.createDataFrame([(1, "2024-01-01", 9), (2, "2024-02-01", 9), (4, "2024-02-03", 9)], "id int, d string, v int").withColumn("d", F.to_date("d"))
    cut = F.lit("2024-01-20").cast("date")
    got = H.rolling_upsert(old, new, ["id"], "d", ["d"], cut)
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [(1, 1), (2, 9), (3, 1), (4, 9)]
    assert [r["id"] for r in H.too_late(new, "d", cut).collect()] == [1]


def test_merge_updates_only_listed_and_newer(spark):
    old = spark.createDataFrame([(1, "a", 5, 10), (2, "b", 5, 10), (None, "n", 1, 1)], "id int, name string, v int, ts int")
    new = spark.createDataFrame([(1, "A", 6, 9), (2, "B", 7, 11), (3, "C", 8, 1), (None, "N", 2, 2)], "id int, name string, v int, ts int")
    got = R.merged(old, new, ["id"], update=["v", "ts"], newer="ts")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", 5, 10), (2, "b", 7, 11), (3, "C", 8, 1), (None, "n", 2, 2)], key=str)
    once = R.merged(old, new, ["id"])
    assert R.merged(once, new, ["id"]).exceptAll(once).isEmpty()


def test_changes_compare_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id int, v string")
    b = spark.createDataFrame([(1, "z"), (2, "x"), (4, None)], "id int, v string")
    change = R.changes(a, b, ["id"])
    assert sorted((r["id"], r["change"]) for r in change.collect()) == [(1, "update"), (3, "insert"), (4, "delete")]
    assert sorted(map(tuple, R.applied(b, change, ["id"]).collect()), key=str) == sorted(map(tuple, a.collect()), key=str)


def test_marks_never_go_back(spark):
    marks = spark.createDataFrame([("a", 5)], "source string, mark int")
    rows = spark.createDataFrame([(3,), (9,)], "ts int")
    assert {tuple(r) for r in H.marks_after(marks, "a", rows.where("ts < 5"), "ts").collect()} == {("a", 5)}
    assert {tuple(r) for r in H.marks_after(marks, "a", rows, "ts").collect()} == {("a", 9)}
    assert H.above_mark(rows, "ts", F.lit(5)).count() == 1
