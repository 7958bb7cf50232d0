"""Every query of the catalogue against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from recollect.jobs import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    if hasattr(value, "tolist") and getattr(value, "shape", ()):
        value = value.tolist()
    if isinstance(value, list):
        return str([plain(v) for v in value])
    if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, (int, float)) and not isinstance(value, bool) or getattr(getattr(value, "dtype", None), "kind", "") in ("i", "f"):
        return f"{float(value):.8g}"
    return str(value)


def rows(df):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        assert rows(got) == rows(con.execute(catalogue.ORACLES[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["chunk_id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_texts_stay_where_few_hits_ask_for_them(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "48k")  # less than the texts, more than the hits
    try:
        plan = catalogue.QUERIES["ir_mrr_recall_at5"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "hashpartitioning(chunk_id" not in plan and "BroadcastHashJoin" in plan
