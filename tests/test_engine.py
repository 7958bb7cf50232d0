import pytest

from recollect.jobs.engine import Engine, NotFound
from recollect.operators import code, lifecycle, summary
from recollect.sources import backup

NOW = "2024-01-01 00:00:00"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}", "t")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string, metadata string")


def test_life_of_a_memory(spark, engine):
    first = docs(spark, [("a", "árbol rojo en la casa", '{"title": "T"}'), ("b", "casa azul", None), ("c", "casa azul", None), ("d", "  ", None), ("e", None, None)])
    got = {r["doc_id"]: (r["status"], r["existing_id"]) for r in engine.ingest(first, "w", "me", NOW).collect()}
    assert got == {"a": ("ingested", None), "b": ("ingested", None), "c": ("duplicate", "b"), "d": ("EMPTY_TEXT", None), "e": ("EMPTY_TEXT", None)}
    again = {r["doc_id"]: (r["status"], r["existing_id"]) for r in engine.ingest(docs(spark, [("z", "casa azul", None)]), "other", "me", NOW).collect()}
    assert again == {"z": ("duplicate", "b")}
    assert tuple(engine.stats().first()) == (2, 1, 2, 0)

    hit = engine.search("arbol", "w").collect()
    assert len(hit) == 1 and engine.search("arbol", "elsewhere").collect() == [] and engine.search(" ", "w", hybrid=True).collect() == []
    both = [r["chunk_id"] for r in engine.search("casa azul", "w", hybrid=True, rerank=True).collect()]
    assert len(both) == 2
    full = engine.hits(engine.search("arbol", "w")).first()
    assert full["text"].startswith("árbol") and full["provenance"]["doc_id"] == "a"
    with pytest.raises(ValueError):
        engine.search("x", "w", top_k=101)

    chunk = hit[0]["chunk_id"]
    engine.feedback(chunk, True, "me", NOW)
    with pytest.raises(NotFound):
        engine.feedback("none", True, "me", NOW)
    assert [r["chunk_id"] for r in engine.context_fit("casa", "w", 5).collect()] == [chunk]

    assert engine.delete(doc_id="a") == {"n_chunks": 1, "n_docs": 1, "n_feedback": 1}
    with pytest.raises(NotFound):
        engine.delete(doc_id="a")
    assert engine.sweep("2024-01-20 00:00:00", 30) == 0 and engine.sweep("2024-03-01 00:00:00", 30) == 1
    # content whose chunks were swept may come back
    assert engine.ingest(docs(spark, [("b2", "casa azul", None)]), "w", "me", NOW).first()["status"] == "ingested"


def test_new_content_of_a_known_document(spark, engine):
    engine.ingest(docs(spark, [("a", "uno", None)]), "w", "me", NOW)
    engine.ingest(docs(spark, [("a", "dos", None)]), "w", "me", NOW)
    assert {r["text"] for r in engine.store.read("chunks").collect()} == {"uno", "dos"} and engine.store.read("docs").count() == 1
    engine.ingest(docs(spark, [("a", "tres", None)]), "w", "me", NOW, on_conflict="replace")
    assert {r["text"] for r in engine.store.read("chunks").collect()} == {"tres"}
    assert len(engine.store.versions()) == 3


def test_export_and_files(spark, engine, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.md").write_text("hola mundo")
    (tmp_path / "in" / "y.bin").write_text("?")
    report = {r["status"]: r["reason"] for r in engine.ingest_files(str(tmp_path / "in"), "w", "me", NOW).collect()}
    assert report == {"ok": None, "failed": "UNSUPPORTED_FORMAT"}
    assert {r["table"]: r["n_rows"] for r in engine.export(f"file://{tmp_path}/out").collect()} == {"chunks": 1, "docs": 1, "feedback": 0}


def concept_rows(spark, names):
    rows = [(f"c{i}", n, f"m.{n}", f"({n})", "", "function", "a.py", i + 1, i + 3) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "id string, name string, qualified_name string, signature string, description string, kind string, file string, start_line int, end_line int")


def test_project_is_indexed_again_without_leftovers(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}", "t1")
    calls = spark.createDataFrame([("c0", "c1"), ("c1", "c2"), ("c0", "gone"), ("gone", "c1"), ("c1", "c1"), ("c0", "c1")], "source string, target string")
    assert e.index_project("p", concept_rows(spark, ["run", "help", "stop"]), calls, "2024-01-01 00:00:00") == {"n_concepts": 3, "n_edges": 2}
    e.index_project("q", concept_rows(spark, ["other"]), calls, "2024-01-01 00:00:00")
    assert [r["display"] for r in e.callers("p", "help").collect()] == ["run (a.py#L1-L3)"]
    assert {r["id"] for r in e.callers("p", "stop", None).collect()} == {"c0", "c1"} and e.callers("p", "nothing").collect() == []
    found = e.search_code("p", "stop (stop)", 2).collect()
    assert [r["place"] for r in found] == [1, 2] and found[0]["name"] == "stop"
    e.index_project("p", concept_rows(spark, ["start", "run"]), calls, "2024-01-02 00:00:00")
    names = lambda *a: [r["symbol_name"] for r in code.lookup_symbols(e.store.read("symbols"), *a).collect()]
    assert names("p") == ["run", "start"] and names("p", "run") == ["run"] and names("q") == ["other"] and names("z") == []
    assert e.index_project("p", concept_rows(spark, ["x"]).limit(0), calls, "2024-01-03 00:00:00") == {"n_concepts": 0, "n_edges": 0} and names("p") == ["run", "start"]
    with pytest.raises(NotFound):
        e.search_code("missing", "x")
    assert e.delete_tenant()["n_symbols"] == 3 and names("p") == []


def test_code_search_degrades(spark):
    c = concept_rows(spark, ["run", "runner"])

    def broken(text, dim):
        raise RuntimeError("no model")

    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c0", [0.0, 1.0]), ("old", [1.0, 0.0])], "id string, vector array<float>")
    ids = lambda **a: [r["id"] for r in summary.search(c, "run", **a).collect()]
    assert ids() == ids(vectors=vectors.limit(0)) == ids(vectors=vectors, embed_query=broken) == ["c0", "c1"]
    assert ids(vectors=vectors, embed_query=lambda text, dim: [1.0, 0.0]) == ["c1", "c0"]


def test_retention_of_all_tenants(spark):
    rows = spark.createDataFrame([("a", 1, "2024-01-01"), ("b", 2, "2024-01-01"), ("c", 3, "2024-01-01"), ("c", 4, "2023-12-01"), (None, 5, "2023-12-01"), ("a", 6, None)], "tenant_id string, n int, t string")
    rows = rows.selectExpr("tenant_id", "n", "cast(t as timestamp_ntz) as created_at")
    policy = spark.createDataFrame([("a", 5), ("b", 0), ("c", None)], "tenant string, days int")
    gone = lifecycle.expired_by_tenant(rows, policy, "2024-01-20 00:00:00")
    assert sorted(r["n"] for r in gone.collect()) == [1, 4, 5] and gone.columns == rows.columns


def test_backup_count(spark, tmp_path):
    store = Engine(spark, f"file://{tmp_path}", "t2").store
    assert backup.backup_count(store, f"file://{tmp_path}/b") == 0
    for n in ("one", "two"):
        backup.backup(store, f"file://{tmp_path}/b/{n}", b"0" * 32)
    assert backup.backup_count(store, f"file://{tmp_path}/b") == 2
