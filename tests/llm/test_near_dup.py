import random

import numpy as np
import pytest

from recollect.llm import near_dup as N
from recollect.llm.components import connected_components, forest

from .data import DOCS, groups, near_groups


def corpus():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocab) for _ in range(140)]
    docs = []
    for i in range(90):  # near copies around the threshold, many of which link with each other only
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append(" ".join(w))
    docs += [docs[3]] * 5 + [docs[7].upper()]
    docs += ["", None, " \t", "one two", "One TWO", "one two three"]
    docs += [" ".join(base[:60]) + " " + " ".join(rng.choice(vocab) for _ in range(70)) for _ in range(10)]
    docs.append(" ".join(rng.choice(vocab) for _ in range(20_000)))
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(i, docs[k]) for i, k in enumerate(order)]


def test_against_brute_force(spark):
    docs = corpus()
    sizes, comp = near_groups(docs)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS).withColumnsRenamed({"n_chars": "component_id"})
    got = N.near_duplicates(df).collect()
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert {r["doc_id"]: r["component_id"] for r in got} == comp
    assert all(r["kept"] == (r["doc_id"] == comp[r["doc_id"]]) for r in got)


def test_chunks_meet(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 7)
    docs = corpus()
    got = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == near_groups(docs)[1]


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    assert N.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, None)]
    got = sorted(map(tuple, N.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, None), (2, 0, 2, True), (3, 0, 3, True)], key=str)


def test_repeated_ids_with_other_texts_in_any_order(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (2, b), (1, a)]
    want = None
    for turn in range(4):
        random.Random(turn).shuffle(rows)
        got = sorted(map(tuple, N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()))
        want = want or got
        assert got == want
    assert {r[2] for r in want} == {1}


@pytest.mark.parametrize("share", [0.6, 0.75, 0.9])
def test_sketch_estimates(share):
    rng = np.random.default_rng(1)
    far = []
    for _ in range(20):
        x = rng.integers(0, 1 << 62, 400).astype(np.uint64)
        both = int(round(2 * 400 * share / (1 + share)))
        y = np.concatenate([x[:both], rng.integers(0, 1 << 62, 400 - both).astype(np.uint64)])
        s = N.odd_sketch(N.samples(np.concatenate([x, y]), np.array([0, 400, 800]), N.SAMPLES))
        j = both / (800 - both)
        far.append(N.similarity(np.bitwise_count(s[0] ^ s[1]).sum(dtype=int)) - j)
    assert abs(np.mean(far)) < 0.01 and np.std(far) < 0.02
    assert max(map(abs, far)) < N.MARGIN


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(300, 340)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(7, 7), (5, 6), (6, 5)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k in got} and set(want) - set(got) <= {x for e in edges if e[0] == e[1] for x in e}
    assert connected_components(df.limit(0)).collect() == []


def test_forest():
    a, b = np.array([5, 3, 9, 7]), np.array([3, 8, 9, 2])
    x, y = forest(a, b)
    assert dict(zip(x.tolist(), y.tolist())) == {5: 3, 8: 3, 7: 2}
