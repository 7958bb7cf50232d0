import numpy as np

from recollect.llm import ann, vector_dup

from .data import groups

SCHEMA = "vec_id long, embedding array<float>, label int"


def cloud(n=600, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[200:300] = x[7] + rng.normal(size=(100, dim)) * 0.16  # around the threshold
    x[300:320] = x[8]
    x[320:330] = x[9] * np.linspace(0.1, 40, 10)[:, None]
    return x


def rows(x):
    return [(i, [float(np.float32(c)) for c in v], i % 3 if i < 200 or i >= 330 else 1) for i, v in enumerate(x)]


ODD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 16, 1), (9004, [1.0] * 15 + [float("nan")], 1), (9005, [1.0] * 15 + [None], 1), (9006, [1.0] * 15 + [float("inf")], 1)]


def test_search_finds_at_least_nine_in_ten(spark):
    data = rows(cloud())
    df = spark.createDataFrame(data + ODD + [(9007, [1.0, 2.0], 1)], SCHEMA)
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), shard_rows=100, regions=4, block_rows=3, share_rows=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x, hit, total = np.array([v for _, v, _ in data]), 0, 0
    assert set(got) == set(range(0, 600, 20))
    for q, found in got.items():
        s = x @ x[q]
        want = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-round(s[i], 12), i))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s[i] - v) < 1e-9 for _, i, v in found)
        assert [v for _, _, v in found] == sorted((v for _, _, v in found), reverse=True)
        hit, total = hit + len({i for _, i, _ in found} & set(want)), total + 20
    assert hit / total >= 0.95


def test_search_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], SCHEMA)
    got = [tuple(r)[:3] for r in ann.nearest(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(df.limit(0), df).collect() == []


def test_chi_square():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(ann.chi_square_quantile(0.5, 2) - 1.38629) < 1e-4


def check(spark, data, threshold=0.93):
    got = vector_dup.near_vectors(spark.createDataFrame(data, SCHEMA), threshold=threshold).collect()
    good = [(i, np.array(v, float), g) for i, v, g in data if v and None not in v and np.isfinite(v).all() and any(v) and g is not None]
    links = [(a[0], b[0]) for k, a in enumerate(good) for b in good[:k] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= threshold]
    n = {i: 0 for i, _, _ in data}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert {r["vec_id"]: r["n_links"] for r in got} == n
    assert {r["vec_id"]: r["component_id"] for r in got} == groups(n, links)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    return len(links)


def test_links_against_brute_force(spark):
    assert check(spark, rows(cloud()) + ODD + [(9007, [1.0, 2.0], 1), (9008, [2.0, 4.0], 1), (9009, [1.0] * 16, None)]) > 500


def test_hot_cell_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(vector_dup, "CHUNK", 16)
    monkeypatch.setattr(vector_dup, "ROWS", 5)
    check(spark, rows(cloud(400)))


def test_many_dimensions_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(vector_dup, "CHUNK", 50)
    x = np.random.default_rng(5).normal(size=(300, 80))
    x[100:200] = x[7] + np.random.default_rng(6).normal(size=(100, 80)) * 0.27  # around the threshold
    assert 100 < check(spark, [(i, [float(np.float32(c)) for c in v], i % 2 if i < 100 else 1) for i, v in enumerate(x)]) < 4900


def test_no_vectors(spark):
    assert vector_dup.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_vectors_that_share_an_id(spark):
    data = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.1], 1), (3, [1.0, 0.05], 1), (0, [0.0, -1.0], 1), (2, [1.0, 0.1], 2)]
    got = sorted(tuple(r) for r in vector_dup.near_vectors(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == [(0, 0, 0, True), (1, 0, 1, True), (1, 2, 1, True), (2, 0, 2, True), (2, 2, 1, False), (3, 2, 1, False)]


def test_none_below_the_threshold(spark):
    for t in (0.6, 0.8):  # cosines of 0.6 and 0.8 in whole numbers, to the last bit
        got = {r["vec_id"]: r["n_links"] for r in vector_dup.near_vectors(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [3.0, 4.0], 1)], SCHEMA), threshold=t).collect()}
        assert got == ({1: 1, 2: 1} if t == 0.6 else {1: 0, 2: 0})
    above = float(np.nextafter(0.6, 1))
    assert {r["n_links"] for r in vector_dup.near_vectors(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [3.0, 4.0], 1)], SCHEMA), threshold=above).collect()} == {0}


def test_operators_ignore_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 1, 2, 3, 4, 5) for i in range(6)], SCHEMA + ", id int, score int, key int, links int")
    assert ann.nearest(df, df.filter("vec_id = 2")).count() == 5
    assert vector_dup.near_vectors(df).count() == 6


def test_nearest_with_large_vectors_and_repeated_ids(spark):
    """Products of vectors of size 1e6, many of them equal, and ids that stand on two rows in any order."""
    rng = np.random.default_rng(8)
    base = (rng.normal(size=(30, 16)) * 1e6).tolist()
    rows = [(i, base[i % 30]) for i in range(200)] + [(5, base[7]), (20, base[3])]
    want = None
    for turn in range(2):
        df = spark.createDataFrame(rows[::-1] if turn else rows, "vec_id long, embedding array<double>")
        got = sorted(tuple(r) for r in ann.nearest(df, df.filter("vec_id % 20 = 0")).collect())
        want = want or got
        assert got == want
    least = {i: min(v for j, v in rows if j == i) for i, _ in rows}
    for q in range(0, 200, 20):
        order = sorted(((-sum(a * b for a, b in zip(least[q], least[i])), i) for i in least if i != q))[:20]
        assert [r[2] for r in want if r[0] == q] == [i for _, i in order]
