"""Embedders and scorers as ports: batches, limits, labels, failures, and the embedding cache."""

import warnings

import pytest
from pyspark.errors import PySparkException

from recollect.jobs.engine import Engine
from recollect.operators import embedding, ports

NOW = "2024-01-01 00:00:00"


def lengths(texts):
    if len(texts) > 3:
        raise ValueError("too many at once")
    return [[float(len(t)), 1.0] for t in texts]


def by_length(query, texts):
    return [float(len(t)) for t in texts]


def failing(query, texts):
    raise RuntimeError("no model")


def hits(spark):
    texts = spark.createDataFrame([(f"c{i}", "x" * (i % 4)) for i in range(8)], "chunk_id string, text string")
    return spark.createDataFrame([(f"c{i}", 1.0 - i / 10) for i in range(8)] + [("gone", 0.05)], "chunk_id string, score double"), texts


def test_vectors_in_batches_of_a_fixed_size(spark):
    rows = spark.createDataFrame([(i, "x" * i if i else None) for i in range(20)], "id long, text string")
    got = ports.Embedder(lengths, 2, "len", batch=3).vectors(rows).collect()
    assert {r["id"]: r["vector"] for r in got} == {i: [float(i), 1.0] for i in range(20)}
    for broken in (lambda t: lengths(t)[1:], lambda t: [[1.0]] * len(t)):
        with pytest.raises(PySparkException):
            ports.Embedder(broken, 2, batch=3).vectors(rows).collect()


def test_scorer_orders_hits(spark):
    fused, texts = hits(spark)
    out = ports.rerank(fused, texts, "q", 3, ports.Scorer(by_length, "v1"))
    assert [tuple(r) for r in out.hits.collect()] == [("c3", 3.0), ("c7", 3.0), ("c2", 2.0)] and (out.version, out.degraded) == ("v1", None)


@pytest.mark.parametrize("scorer,why", [(ports.Scorer(failing), "failed"), (ports.Scorer(lambda q, t: [1.0]), "failed"), (ports.Scorer(lambda q, t: [float("nan")] * len(t)), "failed"), (ports.Scorer(by_length, enabled=False), "disabled")])
def test_failing_scorers_keep_the_fused_order(spark, scorer, why):
    fused, texts = hits(spark)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        out = ports.rerank(fused, texts, "q", 3, scorer)
    assert [r["chunk_id"] for r in out.hits.collect()] == ["c0", "c1", "c2"] and (out.version, out.degraded) == (None, why)
    assert any("fused order" in str(w.message) for w in said)
    if why == "failed":
        with pytest.raises(PySparkException):
            ports.rerank(fused, texts, "q", 3, scorer, on_error="raise")


def test_more_texts_than_the_limit_are_refused(spark, monkeypatch):
    monkeypatch.setattr(ports, "LIMIT", 8)
    fused, texts = hits(spark)
    with pytest.raises(ports.ResourceExhausted):
        ports.rerank(fused, texts, "q", 3, ports.Scorer(by_length))


def test_each_text_is_embedded_once_over_all_ingests(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}", "t")
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, text string")
    engine.ingest(docs(("a", "one text"), ("b", "other text")), "w", "me", NOW)
    assert engine.embedded == 2
    engine.ingest(docs(("c", "one text more"), ("d", "other  text")), "w", "me", NOW)
    assert engine.embedded == 1  # d's only chunk reads as b's
    engine.delete(workspace="w")
    engine.ingest(docs(("a", "one text"), ("e", "new")), "w", "me", NOW)
    assert engine.embedded == 1
    got = {r["text"]: r["vector"] for r in engine.store.read("chunks").collect()}
    assert got == {t: pytest.approx(embedding.embed(t, 64)) for t in ("one text", "new")}
    other = Engine(spark, f"file://{tmp_path}", "t", embedder=ports.Embedder(lambda t: [[1.0, 2.0]] * len(t), 2, "m2"))
    other.ingest(docs(("f", "new but of another model")), "w", "me", NOW)
    assert other.embedded == 1 and {r["embedding_model_version"] for r in other.store.read("chunks").filter("doc_id = 'f'").collect()} == {"m2"}


def test_engine_counts_degraded_searches(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}", "t", scorer=ports.Scorer(failing))
    engine.ingest(spark.createDataFrame([("a", "red house"), ("b", "blue house")], "doc_id string, text string"), "w", "me", NOW)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert engine.search("house", "w", hybrid=True, rerank=True).count() == 2
    assert engine.degraded == 1
