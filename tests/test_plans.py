"""What scans are asked to prune, and keys that cannot run into each other."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strata.functions import expr as X
from strata.plans.model import table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "filtered",
    [
        lambda df: df.where(X.in_range(F.col("o_totalprice"), 10, 1000)), lambda df: df.where(X.member(F.col("o_orderstatus"), ["F", "O"])), lambda df: df.where(X.not_member(F.col("o_orderstatus"), ["F"])),
        lambda df: X.with_keys(df, ["o_orderkey"]), lambda df: X.lookback_split(df, "o_orderdate", F.lit("1998-01-01").cast("date"))[0], lambda df: X.lookback_split(df, "o_orderdate", F.lit("1998-01-01").cast("date"))[1],
    ],
)
def test_predicates_reach_the_scan(spark, filtered):
    found = plan(filtered(table(spark, SF, "orders")))
    assert "PushedFilters: [" in found and "PushedFilters: []" not in found


def test_null_and_nan_in_predicates(spark):
    df = spark.createDataFrame([(None,), (1.0,), (5.0,), (float("nan"),)], "x double")
    c = F.col("x")
    got = df.select(X.in_range(c, 2, 9), X.in_range(c, None, 3), X.in_range(c), X.member(c, [1.0]), X.member(c, [1.0], True), X.not_member(c, [1.0]), X.not_member(c, [1.0], False)).collect()
    assert [tuple(r) for r in got] == [(True, True, True, False, True, True, False), (False, True, True, True, True, False, False), (True, False, True, False, False, True, True), (False, False, True, False, False, True, True)]
    assert X.with_keys(df, ["x"]).count() == 2


def test_surrogate_keys_keep_parts_apart(spark):
    df = spark.createDataFrame([("a||", "b"), ("a", "||b"), ("a|", "|b"), ("a\\", "b"), (None, "b"), ("", "b")], "x string, y string")
    assert df.select(X.surrogate_key(F.col("x"), F.col("y"))).distinct().count() == 6


def test_entry_lists_no_query_twice():
    assert len(entry.queries()) == len(set(entry.queries()))
