"""Layouts, fingerprint trees, stored profiles, observed loads, slice merges, as-of and spread joins, persisted state."""

import bisect
import os
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from strata.operators import reconcile as K
from strata.operators import relational as R
from strata.operators import sketches as S
from strata.plans import marts as M
from strata.sources import layout as L
from strata.sources import readers, state
from strata.sources import writers as W


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- layouts ------------------------------------------------------------------------------------------------------


def test_ranks_bisect_and_interleave(spark):
    rng = random.Random(1)
    cuts = sorted(rng.choice([1.0, 2.5, 7.0, 7.0, 9.0]) for _ in range(15))
    values = [None, -5.0, 1.0, 2.0, 2.5, 7.0, 8.0, 9.0, 99.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(L.rank(F.col("v"), cuts, 4)).collect()]
    assert got == [0 if v is None else bisect.bisect_right(cuts, v) for v in values]
    pairs = [(rng.randrange(16), rng.randrange(16)) for _ in range(40)]
    z = spark.createDataFrame(pairs, "a long, b long").select(L.interleaved([F.col("a"), F.col("b")], 4)).collect()
    assert [r[0] for r in z] == [int("".join(x + y for x, y in zip(f"{a:04b}", f"{b:04b}", strict=True)), 2) for a, b in pairs]
    with pytest.raises(ValueError, match="64-bit"):
        L.interleaved([F.col("a")] * 8, 8)


def test_texts_and_dates_keep_their_order(spark):
    texts = ["", "a", "ab", "abcdefX", "abcdeg", "b", "zé", "é"]
    df = spark.createDataFrame([(t, date(2000 + k, 1, 1), datetime(2000 + k, 1, 1)) for k, t in enumerate(texts)], "t string, d date, s timestamp")
    got = df.select(*[L.sortable(df, c) for c in df.columns]).collect()
    assert all(sorted(column) == list(column) for column in zip(*got, strict=True))


def test_z_order_prunes_on_both_columns_of_skewed_rows(spark, tmp_path):
    df = spark.range(20_000).select(F.expr("cast(pow(id % 141, 3) as long)").alias("a"), F.expr("(id * 7919) % 5003").alias("b"), F.when(F.col("id") % 50 > 0, F.col("id")).alias("c"), F.lit("clash").alias("_rank"))
    L.z_ordered(df, f"{tmp_path}/z", ["a", "b"], 36)
    back = spark.read.parquet(f"{tmp_path}/z")
    assert back.columns == df.columns and back.exceptAll(df).isEmpty() and back.count() == 20_000
    one = L.files_touched(L.file_ranges(spark, f"{tmp_path}/z", ["a", "b"]), {"a": (64_000, 91_125), "b": (100, 300)}).first()
    assert 2 * one["touched_a"] < one["files"] and 2 * one["touched_b"] < one["files"]
    counts = [r["row_count"] for r in L.file_ranges(spark, f"{tmp_path}/z", ["a"]).collect()]
    assert max(counts) < 3 * 20_000 / len(counts)


# --- fingerprint trees --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_trees_find_what_differs(spark, levels):
    rng = random.Random(levels)
    left = [(rng.randrange(-500, 90_000), rng.choice(["a", None, ""])) for _ in range(2000)] + [(None, "x"), (None, "y"), (70, "twice"), (70, "twice")]
    right = [r for k, r in enumerate(left) if k % 400 != 3]
    right = [(k, "edited") if n % 500 == 7 else (k, v) for n, (k, v) in enumerate(right)] + [(95_000, "new"), (-900, "new")]
    right.remove((70, "twice"))
    right.remove((None, "y"))
    bag = lambda rows: {k: sorted(str(v) for x, v in rows if x == k) for k, _ in rows}
    a, b = bag(left), bag(right)
    want = {k: "only_left" if k not in b else "only_right" if k not in a else "changed" for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    l, r = (spark.createDataFrame(rows, "k long, v string").repartition(5) for rows in (left, right))
    got = {x["k"]: x["difference"] for x in K.differing_keys(l, r, "k", levels).collect()}
    assert got == want
    assert {x["k"]: x["difference"] for x in K.differing_keys(l, r, "k", levels, most_ranges=0).collect()} == want
    assert K.differing_keys(l, l.repartition(3), "k", levels).isEmpty()


def test_stored_trees_and_pushed_ranges(spark, tmp_path):
    df = spark.range(50_000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    df.write.parquet(f"{tmp_path}/t")
    base = spark.read.parquet(f"{tmp_path}/t")
    K.fingerprint_tree(base, "k", 0, 49_999).write.parquet(f"{tmp_path}/tree")
    other = base.withColumn("v", F.when(F.col("k") == 31_337, 0).otherwise(F.col("v")))
    trees = (spark.read.parquet(f"{tmp_path}/tree"), K.fingerprint_tree(other, "k", 0, 49_999))
    assert [tuple(x) for x in K.differing_keys(base, other, "k", trees=trees, bounds=(0, 49_999)).collect()] == [(31_337, "changed")]
    nodes = [x["node"] for x in K.differing_nodes(*trees).collect()]
    part = K.rows_of_nodes(base, nodes, "k", 0, 49_999, 2)
    assert len(nodes) == 1 and part.count() <= 2 and "GreaterThanOrEqual(k" in plan(part)


def test_whole_row_duplicates_by_hash(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", ""), (None, "a"), (None, "a"), (None, "a")], "x string, y string")
    assert K.whole_duplicates(df).first().asDict() == {"row_count": 6, "distinct_rows": 3, "duplicates": 3}
    assert K.whole_duplicates(df.where("false")).first().asDict() == {"row_count": 0, "distinct_rows": 0, "duplicates": 0}


# --- stored profiles ----------------------------------------------------------------------------------------------


def test_merged_profiles_equal_the_profile_of_all_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k % 9, rng.gauss(5, 3) if k % 11 else None, rng.choice(["x", "y", None, f"t{k}"])) for k in range(6000)] + [(3, float("nan"), "x")]
    df = spark.createDataFrame(rows, "day int, v double, t string")
    S.slice_profiles(df, ["v", "t"], ["day"]).write.parquet(f"{tmp_path}/p")
    stored = spark.read.parquet(f"{tmp_path}/p")
    got = {r["column_name"]: r for r in S.report(S.merged_slices(stored)).collect()}
    values = sorted(v for _, v, _ in rows if v is not None and v == v)
    v, t = got["v"], got["t"]
    mean = sum(values) / len(values)
    assert (v["row_count"], v["nulls"], v["low"], v["high"]) == (6001, sum(x is None for _, x, _ in rows), values[0], values[-1])
    assert abs(v["mean"] - mean) < 1e-9 and abs(v["stddev"] - (sum((x - mean) ** 2 for x in values) / (len(values) - 1)) ** 0.5) < 1e-9
    for q, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert abs(bisect.bisect(values, v[q]) / len(values) - share) < 0.02
    assert abs(t["distinct"] - len({x for _, _, x in rows if x})) < 0.05 * 1500 and t["mean"] is None and t["median"] is None and t["stddev"] is None
    part = S.report(S.merged_slices(stored.where("day < 3"))).where("column_name = 'v'").first()
    assert part["row_count"] == sum(d < 3 for d, _, _ in rows)
    assert S.report(S.merged_slices(stored, ["day"]), ["day"]).count() == 18


def test_drift_sees_a_shape_that_moves_under_an_equal_mean(spark):
    one = spark.range(4000).select((F.col("id") % 101 - 50).cast("double").alias("v"), F.lit("t").alias("t"))
    two = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 40.0).otherwise(-40.0).alias("v"), F.lit("t").alias("t"))
    p = [S.merged_slices(S.slice_profiles(df, ["v", "t"])) for df in (one, two, one.repartition(7))]
    moved = {r["column_name"]: r for r in S.drift_of(p[0], p[1], distinct_delta=9.0, mean_delta=9e9).collect()}
    assert moved["v"]["drifted"] and moved["v"]["rank_change"] > 0.3 and not moved["t"]["drifted"]
    assert not any(r["drifted"] for r in S.drift_of(p[0], p[2], mean_delta=9e9).collect())
    assert {r["drifted"] for r in S.drift_of(p[0], p[1].where("column_name = 'v'"), 1, 9, 9e9, 1).where("column_name = 't'").collect()} == {True}


def test_dataset_profile_counts_outliers(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 7, 1e6).otherwise(F.col("id") % 10).cast("double").alias("v"), F.when(F.col("id") % 4 > 0, "t").alias("t"), F.col("id").alias("k"))
    got = {(r["section"], r["name"]): r["value"] for r in S.dataset_profile(df, ["v", "t", "k"]).collect()}
    assert got["outliers", "v"] == 7 and got["outliers", "k"] == 0 and got["completeness", "t"] == 0.75 and got["type", "string"] == 1 and ("correlation", "v~k") in got
    assert {r["value"] for r in S.dataset_profile(df.where("false"), ["v", "t"]).where("section in ('rows', 'outliers')").collect()} == {0.0}


# --- observed loads -----------------------------------------------------------------------------------------------


def jobs(spark, run):
    spark.sparkContext.setJobGroup(group := f"count-{random.random()}", "counted")
    run()
    spark.sparkContext.setJobGroup("other", "other")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_load_counts_in_the_job_that_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0), (2, -1.0), (None, 3.0), (4, 2.0)], "id int, v double").repartition(2)
    seen = {}
    n = jobs(spark, lambda: seen.update(W.load_observed(df, lambda x: x.where("v > 0"), f"{tmp_path}/t", ["id"], W.Bounds(most_null_keys=1))))
    assert seen == {"rows_in": 4, "rows_out": 3, "null_keys": 1}
    plain = jobs(spark, lambda: df.where("v > 0").write.parquet(f"{tmp_path}/plain"))
    copied = jobs(spark, lambda: spark.read.parquet(f"{tmp_path}/plain").write.parquet(f"{tmp_path}/copy"))
    assert n == plain + copied  # staging and publishing, no counting job
    files = sorted(os.listdir(f"{tmp_path}/t"))
    for bounds in (W.Bounds(most_null_keys=0), W.Bounds(most_dropped=0.1, most_null_keys=1), W.Bounds(least_rows=9, most_null_keys=1)):
        with pytest.raises(ValueError, match="no key|dropped|are left"):
            W.load_observed(df, lambda x: x.where("v > 0"), f"{tmp_path}/t", ["id"], bounds)
    assert sorted(os.listdir(f"{tmp_path}/t")) == files
    assert W.load_observed(df.where("false"), lambda x: x, f"{tmp_path}/t", ["id"])["rows_in"] == 0
    assert spark.read.parquet(f"{tmp_path}/t").columns == ["id", "v"]


def test_silver_loads_are_checked_before_the_target_changes(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    first = M.load_silver(df, lambda x: x.where("id < 3"), f"{tmp_path}/s", "id", 0.5)
    assert first.count() == 2
    for source, keep, words in ((df, "id = 1", "dropped"), (df.where("id > 9"), "true", "are left"), (df.withColumn("id", F.when(F.col("id") > 1, F.col("id"))), "true", "no key")):
        with pytest.raises(ValueError, match=words):
            M.load_silver(source, lambda x, keep=keep: x.where(keep), f"{tmp_path}/s", "id", 0.5)
    assert spark.read.parquet(f"{tmp_path}/s").count() == 2


# --- merges -------------------------------------------------------------------------------------------------------


def test_merge_rewrites_touched_slices_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(1, "a", "d/1"), (2, "b", "d/1"), (3, "c", "d 2"), (4, "d", None), (5, "e", "only"), (6, "f", "far")]
    spark.createDataFrame(rows, "id int, v string, day string").write.partitionBy("day").parquet(path)
    listed = lambda: {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("day=")}
    before = listed()
    new = spark.createDataFrame([(2, "B", "d/1"), (5, "E", "d 2"), (4, "D", None), (9, "i", "new=1")], "id int, v string, day string")
    touched = W.merge_slices(new, path, ["id"], ["day"])
    assert set(touched) == {("d/1",), ("d 2",), (None,), ("only",), ("new=1",)}
    got = {tuple(r) for r in spark.read.schema("id int, v string, day string").parquet(path).collect()}
    assert got == {(1, "a", "d/1"), (2, "B", "d/1"), (3, "c", "d 2"), (4, "D", None), (5, "E", "d 2"), (6, "f", "far"), (9, "i", "new=1")}
    after = listed()
    assert after["day=far"] == before["day=far"] and "day=only" not in after
    assert W.merge_slices(new.where("false"), path, ["id"], ["day"]) == [] and listed() == after
    with pytest.raises(ValueError, match="whole table"):
        W.merge_slices(new, path, ["id"], ["day"], most=2)
    assert listed() == after


def test_merge_mode_and_schema_gate(spark, tmp_path):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, at int")
    W.write_table(a, f"{tmp_path}/m", "merge", keys=["id"])
    W.write_table(spark.createDataFrame([(1, "A", 2), (2, "old", 4), (3, "c", 1)], a.schema), f"{tmp_path}/m", "merge", keys=["id"], newer="at")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/m").collect()} == {(1, "A", 2), (2, "b", 5), (3, "c", 1)}
    with pytest.raises(ValueError, match="type"):
        W.write_table(a.withColumn("at", F.lit("x")), f"{tmp_path}/m", "merge", keys=["id"], baseline=a.schema)


# --- databases ----------------------------------------------------------------------------------------------------

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture
def database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        W.write_jdbc(W.warehouse_names(spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")), url, "T", "overwrite", driver=DRIVER)
    except Exception as e:  # noqa: BLE001
        if "ClassNotFound" in str(e) or "No suitable driver" in str(e):
            pytest.skip("no embedded database on the class path")
        raise
    return url


def test_keyed_upsert_in_one_transaction(spark, database, monkeypatch):
    read = lambda: {tuple(r) for r in readers.read_jdbc(spark, database, "SELECT ID, NAME FROM T", driver=DRIVER).collect()}
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, name string")
    real = W.transaction.run

    def failing(self, text, *values):
        if text.startswith("INSERT INTO T "):
            raise RuntimeError("the connection is lost between the delete and the insert")
        return real(self, text, *values)

    monkeypatch.setattr(W.transaction, "run", failing)
    with pytest.raises(RuntimeError, match="lost"):
        W.publish_jdbc(spark, new, database, "T", ["id"], run_id="r1", driver=DRIVER)
    assert read() == {(1, "a"), (2, "b")}  # staged, but the table is as it was, and the run is not recorded
    monkeypatch.undo()
    assert W.publish_jdbc(spark, new, database, "T", ["id"], run_id="r1", driver=DRIVER)
    assert read() == {(1, "a"), (2, "B"), (3, "c")}
    assert not W.publish_jdbc(spark, new.withColumn("name", F.lit("again")), database, "T", ["id"], run_id="r1", driver=DRIVER)
    assert read() == {(1, "a"), (2, "B"), (3, "c")}
    for bad, words in ((new.union(new), "repeat"), (new.withColumn("id", F.lit(None).cast("int")), "have no")):
        with pytest.raises(ValueError, match=words):
            W.publish_jdbc(spark, bad, database, "T", ["id"], run_id="r2", driver=DRIVER)
    with pytest.raises(ValueError, match="does not exist"):
        W.publish_jdbc(spark, new, database, "NONE", ["id"], driver=DRIVER)
    assert read() == {(1, "a"), (2, "B"), (3, "c")}


def test_measured_bounds_part_skewed_keys_evenly(spark, database):
    keys = spark.range(900).select(F.pow(F.col("id") / 9, 4).cast("long").alias("K"), F.col("id").alias("V")).union(spark.createDataFrame([(None, -1), (None, -2)], "K long, V long"))
    W.write_jdbc(keys, database, "SKEWED", "overwrite", driver=DRIVER)
    got = readers.read_jdbc_even(spark, database, "SELECT K, V FROM SKEWED", "K", 6, driver=DRIVER)
    assert sorted(r["V"] for r in got.collect()) == [-2, -1, *range(900)]
    sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[0] == 2 and len(sizes) == 7 and max(sizes) < 1.3 * 150
    W.write_jdbc(keys.where("false"), database, "EMPTY", "overwrite", driver=DRIVER)
    assert readers.read_jdbc_even(spark, database, "SELECT K, V FROM EMPTY", "K", 6, driver=DRIVER).count() == 0


# --- as-of and spread joins ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("split", [None, "month", "day"])
def test_as_of_equals_brute_force(spark, split):
    rng = random.Random(9)
    moment = lambda: datetime(2024, rng.randrange(1, 5), rng.randrange(1, 28), rng.randrange(24)) if rng.random() > 0.03 else None
    left = [(n, rng.choice([1, 1, 1, 2, 3, None]), moment()) for n in range(300)]
    right = [(rng.choice([1, 1, 2, None]), moment(), n, rng.choice(["x", None])) for n in range(120)]
    right += [(k, t, n + 1000, "tie") for k, t, n, _ in right[:30]]
    l, r = spark.createDataFrame(left, "n int, k int, t timestamp").withColumn("_value", F.lit("clash")), spark.createDataFrame(right, "k int, since timestamp, id int, v string")
    got = {x["n"]: (x["id"], x["v"]) for x in R.as_of(l.repartition(3), r.repartition(4), ["k"], "t", "since", ["id", "v"], order=["id"], split=split).collect()}
    for n, k, t in left:
        earlier = [(since, i, v) for key, since, i, v in right if k is not None and key == k and since is not None and t is not None and since <= t]
        assert got[n] == (max(earlier, key=lambda x: x[:2])[1:] if earlier else (None, None))
    assert len(got) == 300
    assert R.as_of(l, r.where("false"), ["k"], "t", "since", ["id"], split=split).where("id is not null").isEmpty()


def test_member_that_was_valid_then(spark):
    dim = spark.createDataFrame([(1, "2024-01-01", "2024-02-01", "v1"), (1, "2024-02-01", None, "v2"), (2, "2024-01-01", "2024-01-10", "w1")], "id int, effective_from string, effective_to string, sk string")
    dim = dim.withColumns({c: F.to_timestamp(c) for c in ("effective_from", "effective_to")})
    df = spark.createDataFrame([(1, "2023-12-31"), (1, "2024-01-31"), (1, "2024-02-01"), (2, "2024-01-09"), (2, "2024-01-10"), (3, "2024-01-01")], "id int, t string").withColumn("t", F.to_timestamp("t"))
    got = {(r["id"], str(r["t"])[:10]): r["sk"] for r in M.with_member_at(df, dim, "id", "sk", "t").collect()}
    assert got == {(1, "2023-12-31"): "-1", (1, "2024-01-31"): "v1", (1, "2024-02-01"): "v2", (2, "2024-01-09"): "w1", (2, "2024-01-10"): "-1", (3, "2024-01-01"): "-1"}


def test_dimension_grows_with_changes_alone(spark):
    rows = [(1, d, v) for d, v in (("2024-01-01", "a"), ("2024-01-02", "a"), ("2024-01-03", None), ("2024-01-04", None), ("2024-01-05", "a"))] + [(2, "2024-01-01", None), (2, "2024-01-09", None)]
    df = spark.createDataFrame(rows, "id int, d string, v string").withColumn("d", F.to_date("d"))
    got = [(r["id"], str(r["effective_from"]), r["v"], r["is_current"]) for r in M.type2_dimension(df, "id", "d", "sk", tracked=["v"]).orderBy("id", "effective_from").collect()]
    assert got == [(1, "2024-01-01", "a", False), (1, "2024-01-03", None, False), (1, "2024-01-05", "a", True), (2, "2024-01-01", None, True)]
    assert M.type2_dimension(df, "id", "d", "sk").count() == 7


def test_accuracy_of_nothing_and_of_text_times(spark):
    from strata.operators import quality as Q

    df = spark.createDataFrame([(5.0, "2024-01-02 00:00:00"), (None, "no time"), (50.0, None)], "v double, t string")
    rules, now = [Q.Rule("range", "v", low=1, high=9)], F.lit("2024-01-02 12:00:00").cast("timestamp")
    got = {r["name"]: (r["violations"], round(r["score"], 4)) for r in Q.accuracy_and_timeliness(df, rules, "t", now, 24).collect()}
    assert got == {"range:v": (1, 0.6667), "below:v": (0, 1.0), "above:v": (1, 0.6667), "t:24h": (2, 0.3333)}
    assert {r["score"] for r in Q.accuracy_and_timeliness(df.where("false"), rules, "t", now, 24).collect()} == {0.0}
    with pytest.raises(ValueError, match="no rule of accuracy"):
        Q.accuracy_and_timeliness(df, [Q.Rule("unique", "v")], "t", now)


def test_kafka_source_says_what_it_needs(spark):
    from strata.streaming import streams as T

    with pytest.raises(Exception, match="kafka"):
        T.kafka_stream(spark, "localhost:9092", "orders", rate=10)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_spread_join_equals_the_plain_one(spark, how):
    fact = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 97 == 0, None).otherwise(F.col("id") % 500 + 100).cast("int").alias("k"), F.col("id").alias("v"))
    dim = spark.createDataFrame([(7, "hot"), (7, "hot too"), (9, "no facts"), (None, "null"), *[(k, f"d{k}") for k in range(100, 400)]], "k int, name string")
    plain, spread = fact.join(dim, "k", how), R.join_spread(fact, dim, "k", how)
    assert spread.exceptAll(plain).isEmpty() and plain.exceptAll(spread).isEmpty()


def test_a_hot_key_is_dealt_over_tasks(spark):
    n, keys = 30_000, {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        fact = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
        dim = spark.range(n).select(F.col("id").alias("k"), F.lit(1).alias("d"))
        most = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        assert most(fact.join(dim, "k")) > n // 3 and most(R.join_spread(fact, dim, "k")) < n // 6
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_member_join_runs_no_job_to_learn_a_size(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("k"), F.lit(True).alias("is_current"), F.lit("s").alias("sk")).write.parquet(f"{tmp_path}/d")
    dim, df = spark.read.parquet(f"{tmp_path}/d"), spark.range(50).withColumnRenamed("id", "k")
    assert jobs(spark, lambda: M.with_member(df, dim, "k", "sk")) == 0
    assert "BroadcastHashJoin" in plan(M.with_member(df, dim, "k", "sk"))
    large = spark.range(10**9)
    assert R.small(large) is large and R.small(dim) is not dim


def test_retention_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 3, 1)), (3, None)], "id int, d date").write.parquet(f"{tmp_path}/t")
    kept = W.retained(spark.read.parquet(f"{tmp_path}/t"), "d", F.lit("2024-03-05").cast("date"), 10)
    assert sorted(r["id"] for r in kept.collect()) == [2, 3] and "PushedFilters: [Or(" in plan(kept)


# --- persisted state ----------------------------------------------------------------------------------------------


def seen(spark, **times):
    return spark.createDataFrame([(s, datetime(2024, 1, t)) for s, t in times.items()], "source string, mark timestamp")


def held(marks):
    return {r["source"]: (r["mark"].day, r["run_id"]) for r in marks.read().collect()}


def test_marks_never_move_back(spark, tmp_path, monkeypatch):
    marks = state.marks(spark, f"file://{tmp_path}/m")
    assert held(marks) == {} and state.advance(marks, seen(spark, a=5, b=3), "r1") == 1
    assert state.advance(marks, seen(spark, a=5, b=3), "r1") == 1  # repeated: nothing is published
    assert state.advance(marks, seen(spark, a=9), "r2") == 2 and held(marks) == {"a": (9, "r2"), "b": (3, "r1")}
    assert state.advance(marks, seen(spark, a=7, b=4), "late") == 3 and held(marks) == {"a": (9, "r2"), "b": (4, "late")}
    with monkeypatch.context() as broken, pytest.raises(RuntimeError):
        broken.setattr(state.Versions, "claim", lambda *_: (_ for _ in ()).throw(RuntimeError("killed before its claim")))
        state.advance(marks, seen(spark, a=20), "failed")
    assert held(marks)["a"] == (9, "r2") and marks.number() == 3
    df = spark.createDataFrame([(datetime(2024, 1, d),) for d in (8, 9, 10)], "t timestamp")
    assert [r["t"].day for r in state.unread(df, marks, "a", "t").collect()] == [10] and state.unread(df, marks, "new", "t").count() == 3


def test_of_concurrent_runs_the_second_starts_again(spark, tmp_path):
    marks, calls = state.marks(spark, f"file://{tmp_path}/m"), []

    def slow(now):
        calls.append(now.count())
        if len(calls) == 1:
            state.advance(marks, seen(spark, other=1), "faster")
        return now.unionByName(seen(spark, mine=2).withColumn("run_id", F.lit("slow")))

    assert marks.publish(slow) == 2 and calls == [0, 1] and set(held(marks)) == {"other", "mine"}


def test_a_log_takes_each_run_once(spark, tmp_path, monkeypatch):
    log = state.Versions(spark, f"file://{tmp_path}/s", "run_id string, folder string")
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    assert state.append_once(log, f"{tmp_path}/log", rows, "r1") and not state.append_once(log, f"{tmp_path}/log", rows, "r1")
    with monkeypatch.context() as broken, pytest.raises(RuntimeError):
        broken.setattr(state.Versions, "claim", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        state.append_once(log, f"{tmp_path}/log", rows, "r2")
    assert state.read_log(log, "id int").count() == 2
    assert state.append_once(log, f"{tmp_path}/log", rows, "r2") and state.read_log(log, "id int").count() == 4
