import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recollect.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from recollect.llm._common import save

    from .data import near_groups

    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(save(stage(spark, tables[-1], SF), name))
    assert all(t.columns == docs.columns for t in tables[:-1])
    texts = [{r["doc_id"]: r["text"] for r in t.select("doc_id", "text").collect()} for t in tables[:-1]]
    assert len(texts[1]) < len(texts[0]) and set(texts[2]) <= set(texts[1])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in texts[0] if labels.get(i) == 1]
    assert sum(i in texts[1] for i in good) >= 0.95 * len(good)
    comp = near_groups(sorted(texts[2].items()))[1]
    assert set(texts[3]) == set(comp.values())
    assert set(texts[4]) == set(texts[3]) and tables[4].count() >= len(texts[4])
    assert tables[5].select("doc_id").distinct().count() == len(texts[4])
    assert sorted(map(str, corpus_pipeline.run(spark, SF).columns)) == sorted(tables[5].columns)


def test_language_filter_keeps_mixed_texts_of_known_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    text = {g: " ".join(r["text"] for r in docs.filter(F.col("lang") == g).orderBy("doc_id").limit(8).collect()).split() for g in ("en", "de", "fr")}
    even = " ".join(w for g in text for w in text[g][:150])
    two = " ".join([*text["en"][:150], *text["fr"][:150], *text["de"][:6]])
    rng = random.Random(4)
    noise = " ".join("".join(rng.choice("qxzjkvwbpf") for _ in range(rng.randrange(4, 12))) for _ in range(300))
    more = [(900_001, even, None), (900_002, two, None), (900_003, noise, None), (900_004, "ωδε και νυν " * 60, None), (900_005, "🎉 🙂 123", None), (900_006, None, None)]
    kept = corpus_pipeline.language_filter(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), SF)
    assert {r["doc_id"] for r in kept.filter("doc_id > 900000").collect()} == {900_001, 900_002}
    assert kept.columns == docs.columns


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_the_smallest_tables(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.count() > 0


def test_near_dedup_keeps_other_texts_of_an_id(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c d e f g h", "en", "s", 1), (1, "a b c d e f g h", "en", "r", 1), (1, "other words of another kind altogether", "en", "s", 1), (2, "A b c d e f g h", None, None, None), (3, None, None, None, None), (None, "x", None, None, None), (None, "x", None, None, None)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["source"] or "") for r in got) == [(0, "x", ""), (0, "x", ""), (1, "a b c d e f g h", "r"), (1, "other words of another kind altogether", "s"), (3, "", "")]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_nulls_empty_tables_and_extra_columns(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (5_000, "", None, None, 0)], docs.schema))
    clash = ["score", "lang_pred", "explained", "length", "copies", "block", "weight", "order_key", "place", "kept id", "row", "class", "sequence_id", "_s", "_b", "_full", "_own", "_lo", "0", "1", "a.b", "n_tokens"]
    more = docs.select("*", *(F.concat(F.lit(f"{c} "), F.coalesce("doc_id", F.lit(-1)).cast("string")).alias(c) for c in clash))
    for df in (docs, more, docs.limit(0)):
        got = stage(spark, df, SF)
        rows = got.collect()
        if stage is not corpus_pipeline.packing_stage:
            assert got.columns == df.columns
            own = {tuple(r) for r in df.collect()}
            assert all(tuple(r) in own for r in rows)
        assert df is docs or df is more or not rows
