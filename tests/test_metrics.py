"""Counters and histograms taken on the jobs' own actions."""

import pytest
from pyspark.sql import functions as F

from recollect.jobs.engine import Engine
from recollect.operators import lexical
from recollect.sources import metrics

NOW = "2024-01-01 00:00:00"


def test_counts_come_from_the_action_itself(spark, tmp_path):
    m = metrics.Metrics(spark, f"file://{tmp_path}/m")
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def touch(i):
        read.add(1)
        return i

    rows = m.observed(spark.range(100).select(touch("id").alias("id")), "rows_total", "kind", even=F.count_if(F.col("id") % 2 == 0), all=F.count("*"))
    rows.write.parquet(f"file://{tmp_path}/out")
    m.count("calls_total", 2, who='a"b')
    m.count("calls_total", who='a"b')
    with pytest.raises(RuntimeError), m.timed("work"):
        raise RuntimeError
    assert m.flush(NOW) == 6 and read.value == 100 and m.flush(NOW) == 0
    got = {(r["name"], r["labels"]): r["value"] for r in metrics.series(metrics.read(spark, m.path)).collect()}
    assert got["rows_total", 'kind="even"'] == 50 and got["rows_total", 'kind="all"'] == 100
    assert got["calls_total", 'who="a\\"b"'] == 3 and got["operations_total", 'action="work",outcome="error"'] == 1
    buckets = [got["operation_seconds_bucket", f'action="work",le="{b}"'] for b in (*metrics.BOUNDS, "+Inf")]
    assert buckets == sorted(buckets) and buckets[-1] == got["operation_seconds_count", 'action="work"'] == 1


def test_series_of_a_service_run(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}", "t")
    for turn in range(2):
        e.ingest(spark.createDataFrame([("a", "red house"), ("b", " "), (f"c{turn}", f"blue house {turn}")], "doc_id string, text string"), "w", "me", NOW)
        e.search("house", "w").count()
        e.metrics.flush(NOW)
    e.sweep("2024-06-01 00:00:00")
    e.metrics.flush(NOW)
    got = {(r["name"], r["labels"]): r["value"] for r in metrics.series(metrics.read(spark, e.metrics.path)).collect()}
    assert [got["documents_total", f'status="{s}"'] for s in ("ingested", "duplicate", "EMPTY_TEXT")] == [3, 1, 2]
    assert got["chunks_total", ""] == got["embeddings_total", ""] == got["expired_total", ""] == 3
    assert got["operations_total", 'action="search",outcome="ok"'] == got["operation_seconds_count", 'action="ingest"'] == 2


def test_the_one_tenant_of_a_service_run_is_no_single_task(spark, tmp_path, monkeypatch):
    plans, write = [], lexical._write
    monkeypatch.setattr(lexical, "_write", lambda path, docs, each: plans.append(each._jdf.queryExecution().executedPlan().toString()) or write(path, docs, each))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where Spark expects too large a table
    try:
        e = Engine(spark, f"file://{tmp_path}", "t")
        e.ingest(spark.createDataFrame([("a", "red house"), ("b", "blue house")], "doc_id string, text string"), "w", "me", NOW)
        assert e.search("house", "w").count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(plans) == 1 and "SortMergeJoin" not in plans[0]  # which would bring all its tokens together
