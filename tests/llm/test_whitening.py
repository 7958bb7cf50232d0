import math

import numpy as np
import pytest

from recollect.llm import queries
from recollect.llm.whitening import feast, intervals, negatives, whiten


def brute(rows):
    """n, deviation by id, eigenvalues (falling), eigenvectors, whitened by id; with exact sums."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    distinct = sorted({tuple(v) for v in x.values()})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = lambda v: np.array([(n * c - s) / n for c, s in zip(v, sums)])
    d = np.array([centred(v) for v in distinct])
    values, vectors = np.linalg.eigh(d.T @ d / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x.items()}, values, vectors, {i: centred(v) for i, v in x.items()}


def same(got, rows, components=16):
    n, deviation, values, vectors, centred = brute(rows)
    k = min(components, int((values > 1e-12 * values[0]).sum())) if values[0] > 0 else 0
    sign = None
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["deviation"], len(r["whitened"])) == (n, deviation[r["vec_id"]], k)
        if k:
            want = (centred[r["vec_id"]] @ vectors[:, :k]) / np.sqrt(values[:k])
            if sign is None and (np.abs(want) > 1e-6).all():
                sign = np.sign(want) * np.sign(r["whitened"])
            if sign is not None:
                assert np.allclose(np.array(r["whitened"]) * sign, want, atol=1e-7)
            assert np.allclose(r["explained"], values[:k] / values.sum(), rtol=1e-9)
            assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("kind", ["spread", "equal", "falling", "rank", "pairs", "none"])
def test_contours_give_all_leading_eigenvectors(kind):
    rng = np.random.default_rng(len(kind))
    for d in (1, 2, 5, 17, 40):
        e = {"spread": rng.random(d), "equal": np.full(d, 7.0), "falling": np.exp(-0.8 * np.arange(d)), "rank": np.where(np.arange(d) < 3, 2.0 + np.arange(d), 0), "pairs": np.repeat(rng.random(d), 2)[:d], "none": np.zeros(d)}[kind]
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        a = (q * e) @ q.T
        a = (a + a.T) / 2 if e.any() else np.zeros((d, d))
        found = [feast(a, *cut) for cut in intervals(a, 16)]
        want = np.sort(e)[::-1]
        want = want[want > 1e-12 * max(want[0], 1e-300)][:16]
        values = np.concatenate([v for v, _ in found]) if found else np.zeros(0)
        assert len(values) >= len(want) and np.allclose(values[: len(want)], want, atol=1e-10)
        if found:
            x = np.hstack([v for _, v in found])
            assert np.allclose(x.T @ x, np.eye(x.shape[1]), atol=1e-8) and np.allclose(a @ x, x * values, atol=1e-9)


def test_inertia_counts():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 8, 30):
        for _ in range(20):
            a = rng.normal(size=(n, n)) * rng.integers(0, 2, size=(n, n))
            a = a + a.T
            w = np.linalg.eigvalsh(a)
            if (np.abs(w) > 1e-9).all():
                assert negatives(a) == (w < 0).sum()


def test_rows_against_plain_eigenvectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=20) * np.linspace(1, 4, 20)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(150)] + [(2000, [0.0] * 20), (2001, [-0.0] * 20)]
    bad = [(1, None), (2, []), (3, [None] * 20), (4, [float("nan")] * 20), (5, [float("inf")] * 20), (6, [1.0] * 19)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, n string")
    same(whiten(table).collect(), rows)
    same(whiten(table.repartition(7), components=3).collect(), rows, 3)


def test_few_equal_large_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).collect() == []
    equal = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in equal] == [(1, 0, [], [])] * 2
    same(whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 5.0])], schema)).collect(), [(1, [1.0, 2.0]), (2, [3.0, 5.0])])
    large = whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], schema)).collect()
    assert [r["deviation"] for r in large if r["vec_id"] < 3] == [None, None] and all(np.isfinite(r["whitened"]).all() for r in large)


def test_query_over_all_vectors(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op11_whitening(spark, sf).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, deviation, values, vectors, centred = brute(rows)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(by) == len(got) == 16 * len(rows)
    for c in range(16):
        want = np.array([centred[i] @ vectors[:, c] for i, _ in rows]) / np.sqrt(values[c])
        have = np.array([by[i, c + 1]["whitened"] for i, _ in rows])
        assert np.allclose(have * np.sign(have @ want), want, atol=1e-8)
    assert all((r["n"], r["deviation"]) == (n, deviation[r["vec_id"]]) for r in got)
