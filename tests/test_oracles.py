"""Every registered query with a SQL twin gives the twin's rows on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {n: s for n, s in entry.oracle_sql().items() if not n.startswith("op")}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(found):
    return sorted((tuple(plain(v) for v in r) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_its_twin(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = rows(tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect())
    columns = ", ".join(f'"{c}"' for c in names)
    assert got == rows(duck.sql(f"SELECT {columns} FROM ({OWN[name]}) q").fetchall())


def test_every_query_has_rows_or_a_reason(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
