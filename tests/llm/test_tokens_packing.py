import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recollect.llm import packing, queries, tokens

TEXTS = [None, "", "a", "Hello  world\n\n", "é漢字 🙂 <|endoftext|> x", "word " * 3000, "z" * 2000, "\t \x00end"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_pieces_hold_the_tokenizer_ids(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {}
    for r in tokens.token_pieces(df).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4").tolist()))
    for i, text in enumerate(TEXTS):
        want, at = [*reference(text), 0], 0
        for start, length, total, ids in sorted(got[i]):
            assert start == at and length == len(ids) <= 1024 and total == len(want) and ids == want[start : start + length]
            at += length
        assert at == len(want)


@pytest.mark.parametrize("char", [" ", "\n", "\u2003", " \n", "a", "7", "!"])
def test_runs_of_two_million_characters(reference, char):
    encode, _ = tokens.encoder(tokens.default_vocabulary())
    run = char * (2_000_000 // len(char))
    for text in (run, f"a b{run}x  y", f"{run} x{run[:60_000]}", f"x{run[:49_999]}y{run[:50_000]}z"):
        assert encode(text) == reference(text)


def test_other_columns_pass_through_packing(spark):
    names = ["_own", "_lo", "_class", "_salt", "row", "class", "rank", "first", "many", "0", "k0", "a.b", "ids"]
    df = spark.createDataFrame([(i, s, 1 + (i * 37) % 1024, 9, 9, *(f"{c} {i}" for c in names)) for i in range(50) for s in (0, 1)], "doc_id long, start long, length long, offset int, sequence_id int, " + ", ".join(f"`{c}` string" for c in names))
    got = packing.pack(df, salt_rows=3)
    assert got.columns == ["doc_id", "start", "length", *names, "sequence_id", "offset"] and got.count() == 100
    places = {}
    for r in got.collect():
        assert all(r[c] == f"{c} {r['doc_id']}" for c in names)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(p)])]
        assert [o for o, _ in sorted(p)] == ends[:-1] and ends[-1] <= 1024
    assert set(places) == set(range(len(places)))


def test_packed_rows(spark, reference):
    rng = np.random.default_rng(0)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "beta", "gamma"], rng.integers(1, 900))) for _ in range(120)] + [""] * 60
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in enumerate(texts)] + [(0, texts[0], 5, 6)], "doc_id long, text string, length int, offset int")
    rows = queries.packed(df).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids, own = [*reference(t), 0], sorted(by_doc[i], key=lambda r: r["start"])
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)
        assert sum(r["length"] for r in own) == len(ids) * (2 if i == 0 else 1)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert set(by_seq) == set(range(len(by_seq)))
    assert len(by_seq) <= 1.03 * sum(r["length"] for r in rows) / 1024 + 2


def test_op3_and_pipeline_give_the_default_tokenizer_ids(spark, tmp_path):
    import corpus_pipeline

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # as it is read: the end mark is an added token
    texts = [*TEXTS, "a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n<|endoftext|>", "<|endoftext|", "<|<|endoftext|>|>"]
    assert t.encode(texts[len(TEXTS)], add_special_tokens=False).ids == [64, 50256, 65]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (queries.op3_packing(spark, str(tmp_path)).collect(), corpus_pipeline.packing_stage(spark, df, "").collect()):
        for i, text in enumerate(texts):
            ids, own = [*t.encode(text or "", add_special_tokens=False).ids, 0], [r for r in rows if r["doc_id"] == i]
            assert sum(r["length"] for r in own) == len(ids)
            for r in own:
                part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
                assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part.tobytes())


def test_bad_lengths_get_nulls(spark):
    df = spark.createDataFrame([(1, 0, 5), (2, 0, None), (3, 0, 0), (4, 0, 2000)], "doc_id long, start long, length long")
    assert {r["doc_id"]: r["sequence_id"] for r in packing.pack(df).collect()} == {1: 0, 2: None, 3: None, 4: None}
    assert packing.pack(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_cutting_stock_covers_the_demand(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 65, 40 + 400 * seed) if seed % 2 else rng.integers(20, 40, 300)
    demand = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
    plan, got = packing.cutting_stock(demand, 64), {}
    for pattern, copies in plan:
        assert copies > 0 and sum(s * n for s, n in pattern.items()) <= 64
        for s, n in pattern.items():
            got[s] = got.get(s, 0) + n * copies
    assert got == demand


def test_padding_rule():
    assert [packing.padded_length(n) for n in (1, 3, 512, 513, 1024)] == [1, 1024, 512, 1024, 1024]


@pytest.mark.parametrize("rule", tokens.RULES)
def test_attribution(spark, reference, rule):
    rows = [(1, "src", "en", "A title é\nbody text\nmore"), (2, None, None, None), (2, "x", "", "no newline"), (None, "s", "l", "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").withColumn("section", F.lit(1))
    got = tokens.token_counts(df, rule=rule).collect()
    assert len(got) == 16
    own = [r for r in got if r["doc_id"] == 1]
    assert [r["section"] for r in sorted(own, key=lambda r: r["section_no"])] == ["source", "lang", "title", "body"]
    assert sum(r["n_tokens"] for r in own) == len(reference("src\nen\n" + rows[0][3]))
    assert tokens.token_counts(df.limit(0)).collect() == []


def test_boundary_rules():
    spans, bounds = np.array([2, 5, 9]), np.array([3, 8, 9])  # tokens 0-2, 2-5, 5-9 over sections 0-3, 3-8, 8-9
    assert [tokens.attribute(spans, bounds, r).tolist() for r in tokens.RULES] == [[0, 0, 1], [0, 1, 2], [0, 1, 1]]
    spans, bounds = np.array([4]), np.array([2, 2, 4])
    assert [tokens.attribute(spans, bounds, r).tolist() for r in tokens.RULES] == [[0], [2], [0]]


@pytest.mark.parametrize("rule", ["start", "end"])
def test_counts_of_fields_against_the_tokenizer_offsets(spark, rule):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*(x for x in TEXTS if x != "\t \x00end"), "title <|endoftext|>\nbody  text", "é\n漢字 mixed\n\n", "no title"]
    df = spark.createDataFrame([(i, f"src{i}", "en" if i % 2 else None, x) for i, x in enumerate(texts)], "doc_id long, source string, lang string, text string")
    got = {(r["doc_id"], r["section_no"]): r for r in tokens.token_counts(df, rule=rule, end_mark=True).collect()}
    for i, x in enumerate(texts):
        parts = [p for _, p in tokens.record_sections(f"src{i}", "en" if i % 2 else None, x)]
        whole, at = "".join(parts), 0
        size = [len(p.encode()) for p in parts]
        ids = t.encode(whole, add_special_tokens=False).ids
        spans = [len(tokens.END_MARK) if k == tokens.END_MARK_ID else len(t.id_to_token(k)) for k in ids]  # a byte-level token has a character for each byte
        assert sum(spans) == sum(size)
        n, crossing, where = [0] * 4, [0] * 4, lambda b: next(k for k in range(4) if b < sum(size[: k + 1]))
        for w in spans:
            first, last = where(at), where(at + w - 1)
            own = first if rule == "start" else last
            n[own] += 1
            crossing[own] += first != last
            at += w
        for k in range(4):
            r = got[i, k]
            assert (r["n_tokens"], r["n_crossing"], r["start_byte"], r["end_byte"]) == (n[k], crossing[k], sum(size[:k]), sum(size[: k + 1]))
