import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, LongType, StringType, StructField, StructType

from strata.functions import expr as X
from strata.functions import privacy as G
from strata.operators import profiling as P
from strata.operators import quality as Q
from strata.operators import reconcile as K
from strata.operators import relational as R
from strata.plans import marts as M

ORDERS = "order_id string, customer_id string, total_amount double, quantity int"
CONTRACT = Q.Contract(["order_id", "customer_id"], ["order_id"], {"total_amount": (0, None)}, [("customer_id", "customers", "customer_id")])


def frame(spark, rows):
    return spark.createDataFrame(rows, ORDERS)


@pytest.mark.parametrize("rows", [[(None, "c1", 1.0, 1)], [("o1", "c1", 1.0, 1), ("o1", "c1", 2.0, 1)], [("o1", "c9", 1.0, 1)], [("o1", "c1", -1.0, 1)]])
def test_broken_contracts_raise(spark, rows):
    parents = {"customers": spark.createDataFrame([("c1",)], "customer_id string")}
    with pytest.raises(ValueError, match="of"):
        Q.enforce_contract(frame(spark, rows), CONTRACT, parents)


def test_valid_contract_passes(spark):
    parents = {"customers": spark.createDataFrame([("c1",)], "customer_id string")}
    df = frame(spark, [("o1", "c1", None, 1), ("o2", "c1", 2.0, 1)])
    assert Q.enforce_contract(df, CONTRACT, parents).count() == 2
    with pytest.raises(ValueError, match="missing"):
        Q.check_contract(df.drop("order_id"), CONTRACT)


def test_quarantine_splits_the_input(spark):
    rules = [Q.Rule("not_null", "order_id"), Q.Rule("range", "total_amount", low=0)]
    df = frame(spark, [("o1", "c", 1.0, 1), (None, "c", -1.0, 1), ("o3", "c", None, 1)])
    clean, bad = Q.quarantine(df, rules)
    assert clean.count() == 2 and bad.first()["_errors"] == ["not_null:order_id", "range:total_amount"]


def test_counters_of_a_table_need_one_pass(spark):
    rules = [Q.Rule("not_null", c) for c in ("order_id", "customer_id", "quantity")]
    plan = Q.evaluate(frame(spark, [("o", "c", 1.0, 1)]), rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_schema_evolution(spark):
    old = StructType([StructField("a", IntegerType(), False), StructField("m", DecimalType(10, 2))])
    new = StructType([StructField("a", LongType(), True), StructField("m", DecimalType(12, 2)), StructField("n", StringType())])
    assert Q.check_evolution(old, new) == ["nullable: a"]
    assert Q.check_evolution(old, new, allow_new=False) == ["nullable: a", "new: n"]
    assert Q.check_evolution(new, old) == ["missing: n", "type: a bigint -> int", "type: m decimal(12,2) -> decimal(10,2)"]
    assert Q.schema_diff(new, old) == {"missing": [], "extra": ["n"], "mismatched": ["a", "m"]}
    assert Q.declared_schema([{"name": "x", "type": "decimal(10,6)"}, {"name": "y", "type": "array", "nullable": False}]).simpleString() == "struct<x:decimal(10,6),y:array<string>>"


def test_strict_silver_checks(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    with pytest.raises(ValueError, match="dropped"):
        M.checked_silver(df, df.where("id = 1"), "id", 0.5)
    with pytest.raises(ValueError, match="empty"):
        M.checked_silver(df.where("id > 9"), df, "id", 0.5)
    with pytest.raises(ValueError, match="have no id"):
        M.checked_silver(df.withColumn("id", F.when(F.col("id") > 1, F.col("id"))), df, "id", 0.5)


def test_join_guard(spark):
    with pytest.raises(ValueError, match="repeat"):
        R.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])


def test_masks(spark):
    df = spark.createDataFrame([("ann@x.org", "+1 (555) 123-4567", "Ann", "1.2.3.4", "4111-1111-1111-1234"), (None, None, None, None, None), ("bad", "12", "A", "x", "9")], "e string, p string, n string, i string, c string")
    got = [tuple(r) for r in df.select(G.mask_email(F.col("e")), G.mask_phone(F.col("p")), G.mask_name(F.col("n")), G.mask_ip(F.col("i")), G.mask_card(F.col("c"))).collect()]
    assert got == [("a***@x.org", "***-***-4567", "A**", "1.2.*.*", "****-****-****-1234"), (None,) * 5, ("***", "***", "*", "***", "****")]


def test_align_and_keys(spark):
    df = spark.createDataFrame([("7", "x", "e")], "a string, b string, extra string")
    schema = StructType([StructField("a", IntegerType()), StructField("z", StringType())])
    assert X.align(df, schema, "rest").first().asDict() == {"a": 7, "z": None, "rest": '{"b":"x","extra":"e"}'}
    two = spark.createDataFrame([(None, ""), ("", None)], "p string, q string")
    assert two.select(X.surrogate_key(F.col("p"), F.col("q"))).distinct().count() == 2
    assert two.select(X.change_hash(F.col("p"), F.col("q"))).distinct().count() == 2


def test_payload_amount_keeps_its_decimals(spark):
    df = spark.createDataFrame([(1, '{"amount": 11.5, "channel": "mobile_app"}', 100), (1, '{"amount": 3}', 90), (2, '{""amount"": 12.75}', 1)], "id int, v string, offset int")
    got = {r["id"]: (r["payload_amount"], r["channel"], r["currency"]) for r in M.order_events_silver(df, "v", ["id"], ["offset"]).collect()}
    assert got == {1: (11.5, "mobile_app", "USD"), 2: (12.75, "unknown", "USD")}


def test_customer_360_without_inputs(spark):
    c = spark.createDataFrame([(1, "x")], "customer_id int, name string")
    row = M.customer_360(c, None, None).first()
    assert row["orders"] == 0 and row["revenue_usd"] == 0.0 and row["last_order"] is None


def test_fingerprint_ignores_order_and_sees_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "")], "k int, v string")
    b = spark.createDataFrame([(2, ""), (1, None)], "k int, v string")
    c = spark.createDataFrame([(2, None), (1, "")], "k int, v string")
    assert K.fingerprint(a).first() == K.fingerprint(b.repartition(3)).first() != K.fingerprint(c).first()


def test_quantiles_are_exact(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    for values in (rng.normal(size=999), np.repeat([1.0, 2.0, 2.5], [500, 3, 400]), np.array([5e-324, 0.0, 1e-323] * 40), np.array([-1.7e308, 1.7e308, 3.0] * 30), np.array([7.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "v double")
        for few in (10_000, 20):
            monkeypatch.setattr(P, "FEW", few)
            got = P.quantiles(df, "v", [0.0, 0.25, 0.5, 0.75, 1.0])
            assert np.allclose(got[1:4], np.quantile(np.sort(values), [0.25, 0.5, 0.75]), rtol=1e-12, atol=0) or np.abs(values).max() > 1e300
            assert (got[0], got[4]) == (values.min(), values.max())
    assert P.quantiles(df.where("false"), "v", [0.5]) == [None]
    assert P.outliers(df.where("false"), "v").isEmpty()
