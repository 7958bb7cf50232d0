"""The segmented index: what is tokenised when, results against plain BM25, old versions and lazy results, skipped blocks."""

import random

import pytest
from pyspark.sql import functions as F

from recollect.jobs.engine import Engine
from recollect.operators import lexical

NOW = "2024-01-01 00:00:00"
WORDS = [f"w{i}" for i in range(60)]


def text(rng, common=5):
    return " ".join([*(f"w{rng.randrange(common)}" for _ in range(rng.randint(1, 30))), *(rng.choice(WORDS) for _ in range(rng.randint(0, 20)))])


def ingest(spark, engine, rng, names):
    engine.ingest(spark.createDataFrame([(n, text(rng)) for n in names], "doc_id string, text string"), "w", "me", NOW)


def plain(chunks, query, k=20):
    return [tuple(r) for r in lexical.bm25(chunks, query, k).collect()]


def found(engine, query, version=None, k=20):
    return [tuple(r) for r in lexical.search(engine.index(version), query, k).collect()]


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}", "t")


def test_only_new_rows_are_indexed(spark, engine, monkeypatch):
    rng = random.Random(1)
    ingest(spark, engine, rng, [f"a{i}" for i in range(30)])
    first = engine.store.versions()[-1]
    old = found(engine, "w1 w7 w30")
    assert old == plain(engine.store.read("chunks"), "w1 w7 w30") and engine.texts.manifest(first)["indexed"] == 30
    lazy = lexical.search(engine.index(), "w1 w7 w30", 20)

    built = []
    write = lexical.write_segment
    monkeypatch.setattr(lexical, "write_segment", lambda rows, *a, **k: built.append(rows.count()) or write(rows, *a, **k))
    engine.feedback(old[0][0], True, "me", NOW)
    assert found(engine, "w1 w7 w30") == old and built == []  # feedback builds nothing

    ingest(spark, engine, rng, ["b0", "b1", "b2"])
    assert found(engine, "w1 w7 w30") == plain(engine.store.read("chunks"), "w1 w7 w30") and built == [3]
    assert [tuple(r) for r in lazy.collect()] == old  # a lazy result outlives a commit and a search
    assert found(engine, "w1 w7 w30", first) == old  # and so does an old version

    engine.delete(doc_id="a3")
    assert found(engine, "w1 w7 w30") == plain(engine.store.read("chunks"), "w1 w7 w30") and built == [3]  # removed rows are listed as dead
    assert engine.index().totals()[0] == 32 and engine.index().lengths.count() == 32

    engine.ingest(spark.createDataFrame([("a4", text(rng)), ("b1", text(rng))], "doc_id string, text string"), "w", "me", NOW, on_conflict="replace")
    assert found(engine, "w1 w7 w30") == plain(engine.store.read("chunks"), "w1 w7 w30") and built == [3, 2]
    engine.prune()
    assert found(engine, "w2 w9") == plain(engine.store.read("chunks"), "w2 w9") and built == [3, 2]
    used = engine.texts.manifest(engine.store.versions()[-1])
    left = engine.store.names(engine.texts.home)
    assert sorted(x for x in left if not x.endswith(".json")) == sorted([*used["segments"], *used["dead"]]) and len([x for x in left if x.endswith(".json")]) == 1


def test_segments_of_like_size_become_one(spark, engine, monkeypatch):
    monkeypatch.setattr(lexical, "FAN", 2)
    rng, tokenised = random.Random(2), []
    write = lexical.write_segment
    monkeypatch.setattr(lexical, "write_segment", lambda rows, *a, **k: tokenised.append(rows.count()) or write(rows, *a, **k))
    for turn in range(4):
        ingest(spark, engine, rng, [f"{turn}-{i}" for i in range(4)])
        if turn == 2:
            engine.delete(doc_id="0-1")
        assert found(engine, "w1 w2 w40") == plain(engine.store.read("chunks"), "w1 w2 w40")
    assert tokenised == [4, 4, 4, 4] and len(engine.index().segments) < 4


def test_batch_and_filters_against_plain_search(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["x", "y", None]), f"s{i % 3}", text(rng) if i % 11 else rng.choice(["", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "chunk_id long, tenant_id string, workspace_id string, text string")
    index = lexical.write_index(docs, f"file://{tmp_path}/i", ("workspace_id",))
    for tenant in ("x", None):
        own = docs if tenant is None else docs.filter(F.col("tenant_id") == tenant)
        for query in ("w1 w55", "w0 w1 w2 w3 w4 w17", "nothing", ""):
            assert [tuple(r) for r in lexical.search(index.of(tenant), query, 7).collect()] == plain(own, query, 7)
            keep = F.col("workspace_id") == "s1"
            assert [tuple(r) for r in lexical.search(index.of(tenant), query, 7, keep=keep).collect()] == [tuple(r) for r in lexical.bm25(own, query, 7, keep=keep).collect()]
    queries = spark.createDataFrame([(k, text(rng)) for k in range(20)] + [(98, ""), (99, None)], "query_id long, query string")
    want = {tuple(r) for r in lexical.bm25_batch(docs, queries, 5).select("query_id", "rank", "chunk_id", "score").collect()}
    assert {tuple(r) for r in lexical.search_batch(index, queries, 5).collect()} == want


def test_batches_of_many_pairs_go_in_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "t", text(rng)) for i in range(50)], "chunk_id long, tenant_id string, text string")
    index = lexical.write_index(docs, f"file://{tmp_path}/i")
    queries = spark.createDataFrame([(k, text(rng)) for k in range(30)], "query_id long, query string")
    whole = {tuple(r) for r in lexical.search_batch(index, queries, 5).collect()}
    monkeypatch.setattr(lexical, "PAIRS", 100)
    assert {tuple(r) for r in lexical.search_batch(index, queries, 5).collect()} == whole


def test_blocks_that_cannot_matter_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 64)
    monkeypatch.setattr(lexical, "SHARD", 4096)
    rows = [(i, "t", "the " * (1 + i % 40) + ("rare word " * 5 if i % 20 == 0 else "filler " * 20)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "chunk_id long, tenant_id string, text string")
    index = lexical.write_index(docs, f"file://{tmp_path}/i")
    queries = spark.createDataFrame([(1, "the rare word")], "query_id long, query string")
    counted = spark.sparkContext.accumulator(0)
    got = [tuple(r) for r in lexical.search_batch(index, queries, 5, counted=counted).orderBy("rank").select("chunk_id", "score").collect()]
    assert got == plain(docs, "the rare word", 5)
    assert 0 < counted.value < 1000  # of 6600 postings of its terms


def test_equal_scores_go_to_the_smaller_id_over_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD", 300)
    docs = spark.createDataFrame([(i, "t", "same text") for i in range(2000)], "chunk_id long, tenant_id string, text string")
    index = lexical.write_index(docs, f"file://{tmp_path}/i")
    assert [r["chunk_id"] for r in lexical.search(index, "same", 20).collect()] == list(range(20))


def test_a_tenants_texts_meet_by_shard_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "SMALL", 8, raising=False)
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", None, *(f"t{k}" for k in range(40))]) if i % 3 else "x", text(rng)) for i in range(600)]
    docs = spark.createDataFrame(rows, "chunk_id long, tenant_id string, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where Spark expects too large a table
    try:
        held = docs.selectExpr("chunk_id", "tenant_id", "split(text, ' ') AS t", "size(split(text, ' ')) AS dl").repartition(8)
        placed = lexical._placed(held, ["chunk_id"])
        placed.collect()
        plan = placed._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan  # else a task holds all texts of a tenant
        index = lexical.write_index(docs, f"file://{tmp_path}/i")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    shards = {r["tenant_id"]: r["n"] for r in index.table("docs").groupBy("tenant_id").agg(F.countDistinct("shard").alias("n")).collect()}
    assert shards["x"] > 1 and set(shards) == {r[1] for r in rows}
    for tenant in ("x", "t0", "t7", None):
        own = docs if tenant is None else docs.filter(F.col("tenant_id") == tenant)
        assert [tuple(r) for r in lexical.search(index.of(tenant), "w1 w7 w30", 20).collect()] == plain(own, "w1 w7 w30")


def test_tasks_hold_few_shards(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SMALL", 8, raising=False)
    monkeypatch.setattr(lexical, "SHARD", 16)
    held = spark.range(1200).selectExpr("id AS chunk_id", "'t' AS tenant_id", "array('a', 'b') AS t", "2 AS dl").repartition(8)
    parts = [r["count"] for r in lexical._placed(held, ["chunk_id"]).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 1200 and max(parts) < 150  # dealt to 4 shuffle partitions they are 300 or more
