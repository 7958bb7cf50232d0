import hashlib
import random

import pytest
import sentencepiece

from recollect.llm import queries
from recollect.llm.sentence_pieces import MARK, Vocabulary, decoded, default_model, encoded
from tests.llm.data import DOCS

PARTS = [" ", "\n", "\t", "▁", "a", "e", "th", "é", "日本", "🙂", "́", "<s>", "</s>", "<0x0A>", "<unk>", "\x00", "　", "0", "1", "the ", "  ", "�", "​", ".", ",", "².", "ing"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def slow_merge(v, segment):
    """The best pair of all, again and again."""
    symbols = list(segment)
    while pairs := [(v.cost[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in v.cost]:
        _, i = min(pairs)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return [x for s in symbols for x in ([v.ids[s]] if s in v.ids else [v.bytes[b] for b in s.encode()])]


def test_agenda_gives_what_repeated_search_for_the_best_pair_gives(library):
    v, rng = Vocabulary(default_model()), random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 15)))
        whole = MARK + text.replace(" ", MARK)
        assert v.encode([text])[0].tolist() == slow_merge(v, whole) == library.encode(text)


def test_long_and_odd_texts_equal_the_library(library):
    v, rng = Vocabulary(default_model()), random.Random(4)
    texts = ["", " ", "   ", "▁", "\n", " " * 100_001 + "x", "\n" * 50_000, "ab" * 50_000, "7" * 50_000, *("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(3000))]
    assert [x.tolist() for x in v.encode(texts)] == library.encode(texts)


def test_a_difference_from_the_library_stops(library):
    v = Vocabulary(default_model())
    v.joins = {}
    with pytest.raises(ValueError, match="differently"):
        v.encode(["the thing"])


def test_rows_nulls_repeats_and_other_columns(spark, library):
    rows = [(1, "The thing.  And more\n", "en", "a"), (1, "The thing.  And more\n", "en", "a"), (2, None, None, None), (None, "", "en", "b"), (3, "日本 🙂 é", "ja", "a")]
    docs = spark.createDataFrame([(i, t, g, s, 0, [1]) for i, t, g, s in rows], DOCS + ", ids array<int>")
    got = sorted((r["doc_id"] or 0, tuple(r["ids"]), r["decoded"]) for r in encoded(docs).collect())
    assert got == sorted((i or 0, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t, _, _ in rows)
    back = sorted((r["doc_id"] or 0, r["text"]) for r in decoded(encoded(docs)).collect())
    assert back == sorted((i or 0, t or "") for i, t, _, _ in rows)
    assert encoded(docs.limit(0)).collect() == []


def test_query_over_all_documents(spark, library, tmp_path):
    sf = "/root/testdata/sf0.001"
    for r in queries.op12_sentence_pieces(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect():
        ids = library.encode(r["text"] or "")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
