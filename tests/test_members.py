"""Keys of current members: what they are on odd rows, and what the shuffles carry of them."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strata.plans import marts as M
from strata.plans import queries_model
from test_oracles import SF, rows

QUERIES = ["m04_fact_sales_with_member_keys", "m01_fact_orders_with_member_keys", "m02_fact_behaviour_with_member_keys", "j02_current_members"]


@pytest.fixture()
def plainly(spark, monkeypatch):
    """Joins as on tables too large to broadcast."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(M, "small", lambda df: df)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def shuffled(df):
    """The columns that some shuffle of the plan carries."""
    found, nodes = set(), [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        below, out = node.children(), node.output()
        if node.nodeName() == "Exchange":
            found |= {out.apply(i).name() for i in range(out.size())}
        nodes += [below.apply(i) for i in range(below.size())]
    return found


@pytest.mark.parametrize("name", [*QUERIES, "d01_type2_dimension"])
def test_no_shuffle_carries_a_hashed_key(spark, plainly, name):
    found = shuffled(entry.queries()[name](spark, SF))
    assert "customer_id" in found and not found & {"customer_sk", "product_sk", "customer_key"}


def test_history_is_not_sorted_for_current_members(spark, plainly):
    found = queries_model.starts(spark, SF, "product_id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in found and "partial_max" in found


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The smallest tables with orders without a date, a customer or lines, members that have no date at all, orders of one
    key, and lines without a product or an order."""
    d = tmp_path_factory.mktemp("odd")
    t = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in "region nation customer part orders lineitem events".split()}
    k = F.col("o_orderkey")
    t["orders"] = t["orders"].withColumns({"o_orderdate": F.when(F.col("o_custkey") % 7 != 3, F.when(k % 11 != 5, F.col("o_orderdate"))), "o_custkey": F.when(k % 13 != 6, F.col("o_custkey"))})
    t["orders"] = t["orders"].unionByName(t["orders"].where(k % 50 == 1)).unionByName(t["orders"].where(k % 50 == 2).withColumn("o_orderkey", k + 10**6))
    t["lineitem"] = t["lineitem"].withColumns({"l_partkey": F.when(F.col("l_partkey") % 9 != 4, F.when(F.col("l_orderkey") % 17 != 8, F.col("l_partkey"))), "l_orderkey": F.when(F.col("l_partkey") % 23 != 5, F.col("l_orderkey"))})
    con = duckdb.connect()
    for n, df in t.items():
        df.write.parquet(f"{d}/{n}.parquet")
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{d}/{n}.parquet/*.parquet'")
    return str(d), con


@pytest.mark.parametrize("joins", ["as planned", "shuffled"])
@pytest.mark.parametrize("name", QUERIES)
def test_odd_rows_as_in_the_twin(spark, odd, name, joins, request):
    if joins == "shuffled":
        request.getfixturevalue("plainly")
    d, con = odd
    df = entry.queries()[name](spark, d)
    names = sorted(df.columns)
    got = rows(tuple(r) for r in df.select(*names).collect())
    assert got == rows(con.sql(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]}) q").fetchall())
    assert any("-1" in r for r in got) and any(len(str(v)) == 64 for r in got for v in r)


def test_current_starts_are_those_of_the_history(spark):
    day = lambda n: datetime.date(2024, 1, n)
    df = spark.createDataFrame([(1, day(3)), (1, day(1)), (1, day(3)), (2, day(2)), (2, None), (None, day(9))], "k long, t date")
    got = M.current_starts(df, "k", "t", "since").select("k", M.member_key("k", "since").alias("sk"))
    history = M.type2_dimension(df.dropna(), "k", "t", "sk").where("is_current").select("k", "sk")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, history.collect()))
    found = M.with_start(spark.createDataFrame([(3,), (None,)], "k long"), M.current_starts(df, "k", "t", "since"), "k")
    assert [r["sk"] for r in found.select(M.member_key("k", "since").alias("sk")).collect()] == ["-1", "-1"]
