"""Near-duplicate vectors: a subspace pigeonhole join, every candidate verified exactly.

Unit vectors with cosine of at least t are at a squared distance of at most 2 (1 - t). After a fixed rotation they are
cut into BLOCKS blocks of components; a pair within that distance is, in at least one block, within the block's share
of it (in proportion to its components). So each block is range-joined on a grid over its first one or two components
(two where a component spreads wider than a cell, in few dimensions), with cells as wide as the block's radius: a vector
meets its own cell and, as a probe, those neighbour cells after its own in order that its ball reaches. A pair is taken in the first block whose budget it meets and in no other, so no pair
counts twice and none is missed. Vectors meet in tasks, cell by cell; tasks give numbers of links and, for the
components, at most one edge for each vector they hold. Equal vectors are joined as one, and cells of many vectors are
cut into chunks of CHUNK anchors (of up to 64 dimensions; fewer with more). Places hold ids only; vectors, in the type they came in, join them on the way to their
cells. Where vectors are spread evenly over many dimensions a cell is a constant share of its label, so the comparisons
are then quadratic in the label's distinct vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import _vectors as V
from recollect.llm._common import save
from recollect.llm.components import connected_components, forest

BLOCKS, CHUNK, ROWS, STEP = 4, 8192, 64, 2048
SLACK = 1e-9


def rotation(dim: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_bounds(dim: int) -> np.ndarray:
    return np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)


def _unit(m: np.ndarray) -> np.ndarray:
    scaled = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow of squares
    return scaled / np.sqrt(V.dots(scaled, scaled))[:, None]


def placements(threshold: float):
    """Rows (id, label, vec) to (label, dim, block, x, y, probe, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.compute.list_value_length(b.column(2)).to_numpy()
            for dim in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == dim))
                turned = _unit(V.matrix(part.column(2))) @ rotation(dim)
                edges = block_bounds(dim)
                for k in range(len(edges) - 1):
                    width = max(np.sqrt(2 * (1 - threshold) * (edges[k + 1] - edges[k]) / dim) * (1 + 1e-6), 1e-6)
                    axes = min(2 if width * np.sqrt(dim) < 1 else 1, edges[k + 1] - edges[k])
                    at = turned[:, edges[k] : edges[k] + axes] / width
                    if axes == 1:
                        at = np.hstack([at, np.zeros_like(at)])
                    cell = np.floor(at).astype(np.int64)
                    inside = at - cell
                    for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)) if axes == 2 else ((0, 0), (1, 0)):
                        gap = ((1 - inside[:, 0]) * (dx == 1)) ** 2 + np.where(dy == 1, 1 - inside[:, 1], np.where(dy == -1, inside[:, 1], 0)) ** 2
                        rows = np.flatnonzero(gap <= 1)
                        if not len(rows):
                            continue
                        p = part.take(pa.array(rows))
                        const = [pa.array(np.full(len(rows), v)) for v in (dim, k)]
                        yield pa.RecordBatch.from_arrays(
                            [p.column(1), *const, pa.array(cell[rows, 0] + dx), pa.array(cell[rows, 1] + dy), pa.array(np.full(len(rows), bool(dx or dy))), p.column(0)],
                            names=["label", "dim", "block", "x", "y", "probe", "id"],
                        )

    return run


class _Cell:
    """The anchors of one chunk of a cell; probes come batch by batch."""

    def __init__(self, dim: int, block: int, threshold: float):
        self.edges, self.block, self.threshold = block_bounds(dim), block, threshold
        self.budget = 2 * (1 - threshold) * np.diff(self.edges) / dim * (1 + 1e-9)  # rounding excludes no pair at the threshold itself
        self.turn = rotation(dim)
        self.ids, self.n, self.vec, self.turned = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, dim)), np.empty((0, dim))

    def meet(self, ids: np.ndarray, n: np.ndarray, vec: np.ndarray, anchors: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Links of newcomers with the anchors held, and among themselves if they are anchors: (id, links), edges."""
        turned = _unit(vec) @ self.turn
        all_ids, all_n = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])
        all_vec, all_turned = np.concatenate([self.vec, vec]), np.concatenate([self.turned, turned])
        held, count = len(self.ids), np.zeros(len(all_ids), np.int64)
        ea, eb = [], []
        for lo in range(held, len(all_ids), ROWS):
            hi = min(lo + ROWS, len(all_ids))
            to = hi if anchors else held
            a, b = self._links(all_vec, all_turned, lo, hi, to)
            if len(a):
                np.add.at(count, a, all_n[b])
                np.add.at(count, b, all_n[a])
                x, y = forest(all_ids[a], all_ids[b])
                ea.append(x), eb.append(y)
        if anchors:
            self.ids, self.n, self.vec, self.turned = all_ids, all_n, all_vec, all_turned
        some = count > 0
        if ea:
            x, y = forest(np.concatenate(ea), np.concatenate(eb))
        else:
            x = y = np.empty(0, np.int64)
        return all_ids[some], count[some], x, y

    def _links(self, vec: np.ndarray, turned: np.ndarray, lo: int, hi: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row in lo:hi, earlier row below to) that this block is the first to find and whose cosine reaches the threshold."""
        if not to:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        e, k = self.edges, self.block
        near = self._distance(turned, lo, hi, to, k)
        a, b = np.nonzero(near <= self.budget[k] + SLACK)
        a = a + lo
        keep = b < a
        a, b = a[keep], b[keep]
        if not len(a):
            return a, b
        for s in range(k + 1):  # the block's own budget, and that no earlier block's is met
            d = self._distance(turned, lo, hi, to, s)[a - lo, b] if s < k else near[a - lo, b]
            d = self._exact(d, self.budget[s], lambda i: ((turned[a[i], e[s] : e[s + 1]] - turned[b[i], e[s] : e[s + 1]]) ** 2).sum(axis=1))
            keep = d <= self.budget[s] if s == k else d > self.budget[s]
            a, b = a[keep], b[keep]
        unit = _unit(vec[np.unique(np.concatenate([a, b]))]) if len(a) else vec[:0]
        at = np.searchsorted(np.unique(np.concatenate([a, b])), np.stack([a, b])) if len(a) else np.empty((2, 0), int)
        cosine = np.empty(len(a))
        for i in range(0, len(a), 65536):
            cosine[i : i + 65536] = V.dots(unit[at[0, i : i + 65536]], unit[at[1, i : i + 65536]])
        keep = cosine >= self.threshold
        return a[keep], b[keep]

    def _distance(self, turned: np.ndarray, lo: int, hi: int, to: int, k: int) -> np.ndarray:
        x, y = turned[lo:hi, self.edges[k] : self.edges[k + 1]], turned[:to, self.edges[k] : self.edges[k + 1]]
        return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)

    @staticmethod
    def _exact(rough: np.ndarray, bound: float, again) -> np.ndarray:
        """Rough distances, those near the bound taken again in a way that doesn't depend on how rows were grouped."""
        close = np.flatnonzero(np.abs(rough - bound) <= SLACK)
        if len(close):
            rough = rough.copy()
            rough[close] = again(close)
        return rough


def _join(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (label, dim, block, x, y, chunk, probe, id, n, vec), anchors before probes: (id, links, peer)."""
        key, cell = None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(6)] + [np.array(b.column(6).to_pylist(), np.int64)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                own, probe = tuple(keys[:6, lo].tolist()), bool(keys[6, lo])
                if own != key:
                    key, cell = own, _Cell(own[1], own[2], threshold)
                if probe and not len(cell.ids):
                    continue
                for s in range(lo, hi, STEP):
                    part = b.slice(s, min(STEP, hi - s))
                    ids, n, x, y = cell.meet(part.column(7).to_numpy(), part.column(8).to_numpy(), V.matrix(part.column(9)), not probe)
                    none = pa.nulls
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, x])), pa.concat_arrays([pa.array(n), none(len(x), pa.int64())]), pa.concat_arrays([none(len(ids), pa.int64()), pa.array(y)])], names=["id", "links", "peer"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """Links between vectors of equal labels whose cosine is at least threshold: vec_id, n_links, component_id, kept.

    component_id is the smallest id reachable by links, kept marks it. Vectors that are null, zero or hold null or
    non-finite components, vectors of different lengths, and rows with a null label or id link with nothing; every row
    is returned. Rows that repeat an id count as rows of their own, each with its vector's links. Other columns are ignored;
    an empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), V.reals(vectors, vec_col).alias("vec"))
    good = V.usable("vec") & F.col("id").isNotNull() & F.col("label").isNotNull()
    key = F.concat_ws(" ", F.xxhash64("vec"), F.xxhash64(F.lit(1), "vec"))  # 128 bits
    keyed = rows.select("id", "label", F.when(good, key).alias("key"))
    classes = rows.filter(good).groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("key", key)
    classes = save(classes.withColumn("id", F.xxhash64("label", "key")), "classes")  # a class is known by its vector: ids may repeat
    placed = classes.select("id", "label", "vec").mapInArrow(placements(threshold), "label long, dim long, block long, x long, y long, probe boolean, id long")
    placed, cell = save(placed, "placed"), ["label", "dim", "block", "x", "y"]
    many = placed.filter("not probe").groupBy(*cell).agg(F.ceil(F.count("*") * F.greatest(F.col("dim") / 64, F.lit(1.0)) / CHUNK).cast("int").alias("chunks")).filter("chunks > 1")
    cut = placed.join(many, cell, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    first = F.when(F.col("probe"), F.lit(0)).otherwise(F.col("own"))
    cut = cut.withColumn("chunk", F.explode(F.sequence(first, F.col("chunks") - 1))).withColumn("probe", F.col("probe") | (F.col("chunk") != F.col("own")))
    dealt = cut.join(classes.select("id", "n", "vec"), "id").select(*cell, "chunk", "probe", "id", "n", "vec")
    dealt = dealt.repartition(*cell, "chunk").sortWithinPartitions(*cell, "chunk", "probe")
    met = save(dealt.mapInArrow(_join(threshold), "id long, links long, peer long"), "met")
    links = met.filter("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    labels = connected_components(met.filter("peer is not null").select(F.col("id").alias("src"), F.col("peer").alias("dst")))
    named = classes.join(links, "id", "left").join(labels.select(F.col("node").alias("id"), F.col("component").alias("top")), "id", "left").drop("vec")
    least = named.filter("top is not null").groupBy("top").agg(F.min("least").alias("component"))
    named = named.join(least, "top", "left")
    named = named.select("label", "key", F.coalesce("component", "least").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    out = keyed.select("id", "label", "key").join(named, ["label", "key"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
