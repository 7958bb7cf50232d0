"""Nearest neighbours by inner product through stable projections indexed by kd-trees.

The largest inner product becomes the smallest distance once every vector gets one more component that brings all to
the largest norm. Projected on DIMS Gaussian directions, the squared distance of two vectors is their true squared
distance times a chi-square variable of DIMS degrees. A query takes the points near it in projected space, nearest tree
leaf first, and verifies them on the original vectors. It stops once the next leaf is so far that a point as near as
its k-th best would lie there with a probability of at most 1 - confidence: the chi-square test. So each true
neighbour is found with at least that confidence, and there is no cap on the points verified.

The projected space is split into regions by a kd-tree fitted on at most sample_rows points (every vector is indexed);
a region's rows are dealt to shards of about shard_rows, each with a kd-tree of its own. A first round searches every
query's own region, which bounds its k-th distance; a second sends it to all regions that pass the test.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import _vectors as V
from recollect.llm._common import save

DIMS, LEAF = 8, 128


def chi_square_quantile(p: float, m: int) -> float:
    """By bisection on the distribution function (series of the incomplete gamma function)."""
    from math import exp, lgamma, log

    def cdf(x: float) -> float:
        a, h = m / 2, x / 2
        term = total = 1 / a
        k = 1
        while term > 1e-15 * total:
            term *= h / (a + k)
            total += term
            k += 1
        return total * exp(a * log(h) - h - lgamma(a)) if h else 0.0

    lo, hi = 0.0, 40.0 * m
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def directions(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, DIMS))


def kd_leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of the leaves: halved at the median of the widest dimension until few enough."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        x = points[rows]
        axis = int(np.ptp(x, axis=0).argmax())
        part = np.argpartition(x[:, axis], len(rows) // 2)
        todo += [rows[part[: len(rows) // 2]], rows[part[len(rows) // 2 :]]]
    return out


def kd_splits(points: np.ndarray, regions: int) -> list[tuple[int, float]]:
    """A complete tree of splits (axis, value) in heap order; regions is a power of two."""
    splits, level = [], [points]
    while len(level) < regions:
        below = []
        for x in level:
            axis = int(np.ptp(x, axis=0).argmax()) if len(x) else 0
            at = float(np.median(x[:, axis])) if len(x) else 0.0
            splits.append((axis, at))
            below += [x[x[:, axis] < at], x[x[:, axis] >= at]]
        level = below
    return splits


def region_of(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    axes, at = np.array([a for a, _ in splits], np.int64), np.array([v for _, v in splits])
    for _ in range((len(splits) + 1).bit_length() - 1):
        right = points[np.arange(len(points)), axes[node]] >= at[node]
        node = 2 * node + 1 + right
    return node - len(splits)


def region_boxes(splits: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of the regions."""
    lo, hi = [np.full(DIMS, -np.inf)], [np.full(DIMS, np.inf)]
    for k, (axis, at) in enumerate(splits):
        below, above = hi[k].copy(), lo[k].copy()
        below[axis], above[axis] = min(at, below[axis]), max(at, above[axis])
        lo += [lo[k], above]
        hi += [below, hi[k]]
    return np.array(lo[len(splits) :]), np.array(hi[len(splits) :])


class Shard:
    """The points of one shard in a kd-tree."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, projected: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points, projected = ids[order], points[order], projected[order]
        self.leaves = [np.sort(r) for r in kd_leaves(projected, LEAF)]
        self.lo, self.hi = (np.array([f(projected[r], axis=0) for r in self.leaves]) for f in (np.min, np.max))

    def search(self, q_ids: np.ndarray, queries: np.ndarray, q_projected: np.ndarray, least: np.ndarray, k: int, quantile: float, ceiling: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, inner product) of up to k best points for each query.

        least: inner products known to be reached k times elsewhere. ceiling: the largest squared norm.
        """
        square = V.dots(queries, queries)
        far = np.zeros((len(queries), len(self.leaves)))
        for d in range(DIMS):
            gap = np.maximum(np.maximum(self.lo[:, d] - q_projected[:, d, None], q_projected[:, d, None] - self.hi[:, d]), 0)
            far += gap * gap
        turn = np.argsort(far, axis=1)
        far = np.take_along_axis(far, turn, axis=1)
        best = np.full((len(queries), k), -np.inf)
        who = np.full((len(queries), k), -1, np.int64)
        kth = least.copy()
        live = np.arange(len(queries))
        for step in range(len(self.leaves)):
            reach = quantile * np.maximum(ceiling + square[live] - 2 * kth[live], 0) * (1 + 1e-9) + 1e-12
            live = live[far[live, step] <= np.where(np.isfinite(kth[live]), reach, np.inf)]
            if not len(live):
                break
            for leaf in np.unique(turn[live, step]):
                mine, rows = live[turn[live, step] == leaf], self.leaves[leaf]
                rough = queries[mine] @ self.points[rows].T
                rough[q_ids[mine][:, None] == self.ids[rows][None, :]] = -np.inf
                room = 1e-9 * np.sqrt(square[mine] * ceiling)  # what two ways of summing may differ by
                a, b = np.nonzero((rough >= (kth[mine] - room)[:, None]) & (rough > -np.inf))
                if not len(a):
                    continue
                exact = V.dots(queries[mine[a]], self.points[rows[b]])
                cuts = np.flatnonzero(np.diff(a, prepend=-1))
                for lo, hi in zip(cuts, [*cuts[1:], len(a)]):
                    q = mine[a[lo]]
                    s, n = np.concatenate([best[q], exact[lo:hi]]), np.concatenate([who[q], self.ids[rows[b[lo:hi]]]])
                    top = np.lexsort((n, -s))[:k]
                    best[q], who[q] = s[top], n[top]
                    kth[q] = max(kth[q], best[q, -1])
        at = np.nonzero(who >= 0)
        return at[0], who[at], best[at]


def _search_groups(k: int, quantile: float, ceiling: float, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard, its points before its queries: region, salt, share, query, id, vec, projected, least. Queries pass by in blocks."""
        name, held, shard = None, [], None
        for b in batches:
            for g in groups([b], 4):
                own, query = tuple(g.column(c)[0].as_py() for c in range(3)), g.column(3)[0].as_py()
                if own != name:
                    name, held, shard = own, [], None
                if not query:
                    held.append(g)
                    continue
                if shard is None:
                    if not held:
                        continue
                    p, held = pa.concat_batches(held), []
                    shard = Shard(p.column(4).to_numpy(), V.matrix(p.column(5)), V.matrix(p.column(6)))
                for lo in range(0, g.num_rows, block_rows):
                    q = g.slice(lo, block_rows)
                    ids, vec, proj = q.column(4).to_numpy(), V.matrix(q.column(5)), V.matrix(q.column(6))
                    least = np.nan_to_num(q.column(7).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                    row, found, score = shard.search(ids, vec, proj, least, k, quantile, ceiling)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first columns, one batch for each group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(keys)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = b.slice(lo, hi - lo)
            if held and any(held[-1].column(c)[-1].as_py() != part.column(c)[0].as_py() for c in range(keys)):
                yield pa.concat_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_batches(held)


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, confidence: float = 0.98, sample_rows: int = 20_000, shard_rows: int = 8192, block_rows: int = 4096, regions: int | None = None, share_rows: int = 262_144, seed: int = 5) -> DataFrame:
    """The k rows of vectors with the largest inner product for each row of queries, but for the row of the query's id.

    Returns query_id, rank (from 1), vec_id, score, nearest first, ties to the smaller id. Null or zero vectors and those
    with null or non-finite components take no part, nor do rows with a null id or of another length than most; of
    repeated ids the least vector counts, on both sides. Fewer candidates than k are all returned; an empty table gives no rows. Other columns are
    ignored. regions: by default as many as shards, between 16 and 1024. A shard of more than share_rows queries is searched
    by several tasks, each with its points and a share of the queries.
    """
    spark = vectors.sparkSession

    def ready(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), V.doubles(df, vec_col).alias("vec")).filter(V.usable("vec") & F.col("id").isNotNull()).groupBy("id").agg(F.min("vec").alias("vec"))

    points = ready(vectors)
    stats = points.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("top")).orderBy(F.desc("n"), "dim").first()
    if stats is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, count, ceiling = stats["dim"], stats["n"], stats["top"]
    quantile, axes = chi_square_quantile(confidence, DIMS), directions(dim + 1, seed)

    def project(own: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = V.matrix(b.column(1))
                extra = np.zeros(len(m)) if own else np.sqrt(np.maximum(ceiling - V.dots(m, m), 0)) if len(m) else np.zeros(0)
                y = m @ axes[:-1] + extra[:, None] * axes[-1] if len(m) else np.zeros((0, DIMS))
                yield pa.RecordBatch.from_arrays([*b.columns, V.rows(y)], names=["id", "vec", "proj"])

        return run

    indexed = save(points.filter(F.size("vec") == dim).mapInArrow(project(False), "id long, vec array<double>, proj array<double>"), "points")
    regions = regions or min(max(1 << (count // shard_rows).bit_length(), 16), 1024)
    sample = indexed.orderBy(F.xxhash64("id")).limit(sample_rows).select("proj").toPandas()["proj"]
    splits = kd_splits(np.array(sample.tolist()), regions)
    lower, upper = region_boxes(splits)

    @F.pandas_udf("int")
    def region(proj):
        return proj.__class__(region_of(np.array(proj.tolist()).reshape(-1, DIMS), splits), dtype="int32")

    asked = ready(queries).filter(F.size("vec") == dim).mapInArrow(project(True), "id long, vec array<double>, proj array<double>").withColumn("region", region("proj"))
    asked = save(asked, "queries")
    placed = save(indexed.withColumn("region", region("proj")), "placed")
    salts = placed.groupBy("region").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("salts"))  # at most as many rows as regions
    shards = placed.join(F.broadcast(salts), "region").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    rows = ["region", "salt", "share", "query", "id", "vec", "proj", "least"]

    def found(to: DataFrame) -> DataFrame:
        shares = to.groupBy("region").agg(F.ceil(F.count("*") / share_rows).cast("int").alias("shares"))  # at most as many rows as regions
        there = shards.join(F.broadcast(shares), "region").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        there = there.withColumn("query", F.lit(False)).withColumn("least", F.lit(None).cast("double")).select(*rows)
        sent = to.join(F.broadcast(salts), "region").join(F.broadcast(shares), "region").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        sent = sent.withColumn("query", F.lit(True)).withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).select(*rows)
        dealt = there.unionByName(sent).repartition("region", "salt", "share").sortWithinPartitions("region", "salt", "share", "query")
        return dealt.mapInArrow(_search_groups(k, quantile, ceiling, block_rows), "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    home = save(ranked(found(asked.withColumn("least", F.lit(None).cast("double")))), "home")
    bounds = home.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))

    @F.pandas_udf("array<int>")
    def passing(proj, vec, least, own):
        y, x, s = np.array(proj.tolist()).reshape(-1, DIMS), np.array(vec.tolist()), least.to_numpy(float)
        gap = np.maximum(np.maximum(lower[None] - y[:, None], y[:, None] - upper[None]), 0)
        reach = quantile * np.maximum(ceiling + V.dots(x, x) - 2 * s, 0) * (1 + 1e-9) + 1e-12
        ok = ((gap * gap).sum(axis=2) <= np.where(np.isnan(s), np.inf, reach)[:, None]) & (np.arange(len(lower))[None] != own.to_numpy()[:, None])
        return proj.__class__([np.flatnonzero(r).tolist() for r in ok])

    out = save(asked.join(bounds, "id", "left").withColumn("region", F.explode(passing("proj", "vec", "least", "region"))), "sent")
    both = home.drop("rank").unionByName(found(out))
    return ranked(both).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
