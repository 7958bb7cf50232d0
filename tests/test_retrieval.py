import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from recollect.functions import text as X
from recollect.operators import context, embedding, fusion, lexical, scope, vector

DOCS = [(1, "a", "w", "Árbol rojo, árbol verde"), (2, "a", "w", "casa roja"), (3, "a", "x", "arbol"), (4, "a", "w", None), (5, "a", "w", "")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "chunk_id long, tenant_id string, workspace_id string, text string")


def test_fold_and_tokens(spark):
    row = spark.range(1).select(X.tokens(F.lit("Él NIÑO, straße 42!")).alias("t"), X.tokens(F.lit(None).cast("string")).alias("n")).first()
    assert row["t"] == ["el", "nino", "straße", "42"] and row["n"] == []


def test_fold_of_every_code_point(spark):
    marks = {i for lo, hi in X.MARKS for i in range(lo, hi + 1)}
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if ord(c) not in marks).lower()
    known = [c for c in map(chr, range(1, 0x110000)) if unicodedata.category(c) not in ("Cn", "Cs") and c != "\n"]
    rows = [(i, "\n".join(known[i : i + 2048])) for i in range(0, len(known), 2048)]
    got = {r["i"]: r["f"] for r in spark.createDataFrame(rows, "i int, t string").select("i", X.fold(F.col("t")).alias("f")).collect()}
    wrong = [c for i, _ in rows for c, f in zip(known[i : i + 2048], got[i].split("\n"), strict=True) if f != plain(c)]
    assert not wrong


def test_fold_in_texts(spark):
    texts = ["", "plain ASCII", "ﬁne … ﬁn™ ½", "한국어 각 ÉTÉ", "e\u0301a\u0301", "İstanbul", "\U0001d400\U0001d401", "x" * 100_000 + "ﬃ", None]
    got = [r["f"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(X.fold(F.col("t")).alias("f")).collect()]
    assert got[:3] == ["", "plain ascii", "fine ... fintm 1⁄2"]
    assert got[3] == unicodedata.normalize("NFD", "한국어 각") + " ete" and got[4:7] == ["ea", "istanbul", "ab"]
    assert got[7] == "x" * 100_000 + "ffi" and got[8] is None


def test_bm25_by_hand(docs):
    got = {r["chunk_id"]: r["score"] for r in lexical.bm25(docs, "árbol", 10).collect()}
    n, df, avgdl = 5, 2, (4 + 2 + 1) / 5
    w = lambda tf, dl: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    assert got == {1: round(w(2, 4), 6), 3: round(w(1, 1), 6)}


def test_bm25_scope_keeps_tenant_statistics(docs):
    whole = {r[0]: r[1] for r in lexical.bm25(docs, "arbol", 10).collect()}
    scoped = {r[0]: r[1] for r in lexical.bm25(docs, "arbol", 10, keep=F.col("workspace_id") == "x").collect()}
    assert scoped == {3: whole[3]}


def test_blank_query_and_empty_table(spark, docs):
    assert lexical.bm25(docs, "  !", 5).collect() == []
    assert lexical.bm25(docs.limit(0), "arbol", 5).collect() == []


def test_batch_agrees_with_single(spark, docs):
    asked = spark.createDataFrame([(7, "árbol"), (8, "roja casa"), (9, "")], "query_id long, query string")
    got = {}
    for r in lexical.bm25_batch(docs, asked, 10).collect():
        got.setdefault(r["query_id"], {})[r["chunk_id"]] = r["score"]
    assert got == {7: {r[0]: r[1] for r in lexical.bm25(docs, "árbol", 10).collect()}, 8: {r[0]: r[1] for r in lexical.bm25(docs, "roja casa", 10).collect()}}


def test_top_k_bounds():
    assert scope.top_k_or_default(0) == 20 and scope.top_k_or_default(100) == 100
    with pytest.raises(ValueError):
        scope.top_k_or_default(101)


def test_knn_and_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "chunk_id long, vector array<float>")
    got = vector.knn(v, [1.0, 0.0], 3).collect()
    assert [(r["chunk_id"], r["distance"], r["score"]) for r in got] == [(1, 0.0, 1.0), (3, 1.0, 0.5), (5, 1.0, 0.5)]
    assert {r[0]: r[1] for r in vector.cosine_rank(v.filter("vector is not null"), [1.0, 0.0], 10).collect()} == {1: 1.0, 3: round(2**-0.5, 6), 2: 0.0, 5: 0.0, 6: 0.0}


def test_rrf_and_filters(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "chunk_id long, score double")
    b = spark.createDataFrame([(2, 5.0), (3, 5.0)], "chunk_id long, score double")
    chunks = spark.createDataFrame([(1, "s"), (2, "t"), (3, "s")], "chunk_id long, source string")
    got = [(r[0], r[1]) for r in fusion.hybrid(a, b, 2, chunks).collect()]
    assert got == [(2, round(1 / 62 + 1 / 61, 6)), (1, round(1 / 61, 6))]
    assert [r[0] for r in fusion.hybrid(a, b, 2, chunks, keep=F.col("source") == "s").collect()] == [1]
    assert [r[0] for r in fusion.hybrid(a, b, 2, chunks, keep=F.col("source") == "s", filter_mode="pre").collect()] == [1, 3]
    with pytest.raises(ValueError):
        fusion.rrf([a], 0)


@pytest.mark.parametrize(("budget", "fits", "reason"), [(0, [], "budget_zero"), (5, [], "budget_smaller_than_smallest_chunk"), (10, [1], None), (99, [1, 2, 3], None)])
def test_context_fit_is_a_prefix(spark, budget, fits, reason):
    hits = spark.createDataFrame([(1, 3.0, 10), (2, 2.0, 20), (3, 1.0, 1)], "chunk_id long, score double, n_tokens int")
    assert [r["chunk_id"] for r in context.fit(hits, budget).collect()] == fits
    assert context.fit_reason(hits, budget).first()["reason"] == reason


def test_feedback_bonus_is_clamped(spark):
    f = spark.createDataFrame([(1, 1.0), (1, 0.0), (2, 1.0), (3, -4.0), (4, None)], "chunk_id long, score float")
    assert {r[0]: r[2] for r in context.feedback_bonus(f).collect()} == {1: 0.25, 2: 0.5, 3: 0.0}


def test_stub_embedding_is_normalised_and_deterministic(spark):
    d = spark.createDataFrame([(1, "Hola mundo"), (2, "hola  MUNDO"), (3, None)], "doc_id long, text string")
    v = {r[0]: r[1] for r in embedding.stub_embed(d).collect()}
    assert v[1] == v[2] and abs(sum(x * x for x in v[1]) - 1) < 1e-6 and set(v[3]) == {0.0}


def test_index_agrees_with_texts(spark, docs, tmp_path):
    index = lexical.write_index(docs, f"file://{tmp_path}/i", ("workspace_id",))
    for query in ("árbol", "roja casa arbol", " !", "nothing"):
        for keep in (None, F.col("workspace_id") == "x"):
            want = lexical.bm25(docs, query, 10, keep=keep).collect()
            assert lexical.search(index.of("a"), query, 10, keep).collect() == want == lexical.search(index, query, 10, keep).collect()
    assert lexical.search(index.of("b"), "casa", 10).collect() == []
    asked = spark.createDataFrame([(7, "árbol"), (8, "roja casa"), (9, "")], "query_id long, query string")
    key = lambda r: (r["query_id"], r["rank"], r["chunk_id"], r["score"])
    assert sorted(map(key, lexical.search_batch(index, asked, 2).collect())) == sorted(map(key, lexical.bm25_batch(docs, asked, 2).collect()))
    plan = lexical.search(index.of("a"), "árbol casa", 10)._jdf.queryExecution().toString()
    assert "In(term" in plan and "text" not in plan.split("ReadSchema")[1].split(">")[0]
    empty = lexical.write_index(docs.limit(0), f"file://{tmp_path}/e")
    assert lexical.search(empty, "casa", 5).collect() == []


def test_knn_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(60)]
    v = spark.createDataFrame(rows + [(99, None), (98, [1.0])], "chunk_id long, vector array<float>")
    asked = v.filter("chunk_id < 20").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], r["distance"]) for r in df.collect())
    whole = key(vector.knn_batch(v, asked, 4))
    want = [(q, k + 1, i, d) for q, (x, y) in rows[:20] for k, (d, i) in enumerate(sorted(((a - x) ** 2 + (b - y) ** 2, i) for i, (a, b) in rows)[:4])]
    monkeypatch.setattr(vector, "BLOCK", 6)
    assert key(vector.knn_batch(v, asked, 4)) == whole == sorted(want)
    assert vector.knn_batch(v, asked.limit(0), 4).collect() == []


def test_batches_of_many_blocks_are_appended(spark, monkeypatch):
    points = spark.createDataFrame([(i, [float(i), float(i % 7)]) for i in range(80)] + [(99, None)], "chunk_id long, vector array<double>")
    asked = points.filter("vector is not null").selectExpr("chunk_id AS query_id", "vector AS query_vector")
    rows = lambda: sorted(map(tuple, vector.knn_batch(points, asked, 3).select("query_id", "chunk_id", "distance", "rank").collect()))
    whole = rows()
    monkeypatch.setattr(vector, "BLOCK", 20)
    assert rows() == whole and len(whole) == 240  # in one plan
    monkeypatch.setattr(vector, "PLANNED", 2)
    assert rows() == whole
