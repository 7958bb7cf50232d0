"""Packing of pieces into sequences of bounded length: cutting-stock column generation over the length histogram.

The driver sees only the histogram (at most size / grain classes). A linear program over patterns of classes is
solved by column generation, a knapsack dynamic program pricing new patterns; the rounded patterns become a bounded
table of slots. Spark ranks the pieces of each class and joins every rank to its slot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm._common import numbered

#: Parts of a class at most: their sizes are added up in one task.
SALTS = 4096


def _price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the largest total dual that fits the capacity (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        fit = np.searchsorted(sizes, w, "right")
        best[w] = best[w - 1]
        if fit:
            v = best[w - sizes[:fit]] + duals[:fit]
            k = int(v.argmax())
            if v[k] > best[w] + 1e-12:
                best[w], take[w] = v[k], k
    pattern, w = np.zeros(len(sizes)), capacity
    while w > 0:
        if take[w] < 0:
            w -= 1
        else:
            pattern[take[w]] += 1
            w -= sizes[take[w]]
    return best[capacity], pattern


def _inverse(m: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination. The threads of a BLAS library can stall beside the driver's JVM, so none is called here."""
    n = len(m)
    a = np.hstack([m, np.eye(n)])
    for k in range(n):
        top = k + int(np.abs(a[k:, k]).argmax())
        a[[k, top]] = a[[top, k]]
        a[k] /= a[k, k]
        others = a[:, k].copy()
        others[k] = 0
        a -= others[:, None] * a[k]
    return a[:, n:]


def _times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (m * v).sum(axis=1)


def _first_basis(need: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Greedy patterns, each using up a class that no later one holds: a triangular basis with a feasible solution."""
    left, columns = need.copy(), np.zeros((len(sizes), len(sizes)))
    done = np.zeros(len(sizes), bool)
    while not done.all():
        room, pattern = capacity, np.zeros(len(sizes))
        for k in range(len(sizes) - 1, -1, -1):
            if not done[k]:
                pattern[k] = min(np.ceil(left[k]), room // sizes[k])
                room -= pattern[k] * sizes[k]
        used = pattern > 0
        copies = (left[used] / pattern[used]).min()
        left = left - pattern * copies
        for n, k in enumerate(np.flatnonzero(used & (left < 1e-6))):
            columns[:, k] = pattern if n == 0 else np.eye(len(sizes))[k]
            left[k], done[k] = 0, True
    return columns


def cutting_stock(demand: dict[int, int], capacity: int, tolerance: float = 2e-3) -> list[tuple[dict[int, int], int]]:
    """Patterns ({size: how many}, copies) that cover the demand exactly, in few sequences of the capacity.

    Sizes are whole numbers from 1 to capacity. Columns are added until the relaxed total is proven to be within
    tolerance of its optimum. The relaxed program's solution is rounded down and what then
    remains (less than one copy of each pattern) is packed first-fit by decreasing size.
    """
    demand = {s: n for s, n in demand.items() if n > 0}
    if not demand:
        return []
    sizes = np.array(sorted(demand))
    if sizes[0] < 1 or sizes[-1] > capacity:
        raise ValueError("sizes must be between 1 and the capacity")
    need = np.array([demand[s] for s in sizes.tolist()], float)
    basis = _first_basis(need, sizes, capacity)
    inverse = _inverse(basis)
    best = sizes / capacity  # feasible duals, whose total bounds the optimum from below
    bound = float(need @ best)
    for turn in range(20 * len(sizes)):
        duals, x = inverse.sum(axis=0), _times(inverse, need)
        if x.sum() <= (1 + tolerance) * bound:
            break
        column = None
        for pull in (0.85, 0.5, 0.0):  # duals are drawn to the best ones so far, which steadies them
            mixed = pull * best + (1 - pull) * duals
            value, pattern = _price(mixed, sizes, capacity)
            if (total := float(need @ mixed) / max(value, 1e-9)) > bound:  # Farley's bound
                bound, best = total, mixed / value
            if pattern @ duals > 1 + 1e-7:
                column = pattern
                break
        if column is None:
            break
        d = _times(inverse, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
        basis[:, out] = column
        if turn % 100 == 99:
            inverse = _inverse(basis)
    whole = np.floor(np.maximum(_times(_inverse(basis), need), 0) + 1e-6).astype(np.int64)
    left = need.astype(np.int64) - (basis.astype(np.int64) * whole).sum(axis=1)
    for k in np.flatnonzero(whole):
        while (left < 0).any() and whole[k] and (basis[:, k][left < 0] > 0).any():  # a copy too many by rounding error
            whole[k] -= 1
            left = left + basis[:, k].astype(np.int64)
    plan = [({int(s): int(n) for s, n in zip(sizes, basis[:, k]) if n}, int(whole[k])) for k in range(len(sizes)) if whole[k]]
    while left.any():
        room, pattern = capacity, np.zeros(len(sizes), np.int64)
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(left[k], room // sizes[k])
            room -= pattern[k] * sizes[k]
        copies = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= pattern * copies
        plan.append(({int(s): int(n) for s, n in zip(sizes, pattern) if n}, copies))
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (class, first rank, end of ranks, pieces of the class in a sequence, first sequence)."""
    rows, ranks, sequence = [], {}, 0
    for pattern, copies in plan:
        for size, many in pattern.items():
            lo = ranks.get(size, 0)
            ranks[size] = lo + many * copies
            rows.append((size, lo, ranks[size], many, sequence))
        sequence += copies
    return rows


def pack(pieces: DataFrame, size: int = 1024, grain: int = 4, keys: tuple[str, ...] = ("doc_id", "start"), length_col: str = "length", salt_rows: int = 1000) -> DataFrame:
    """Adds sequence_id (from 0, without gaps) and offset (of the piece in its sequence, gapless from 0) to each piece.

    pieces is read three times: pass a saved table. Lengths are classed by grain, rounded up, so a piece wastes less
    than grain ids against the ideal. A class is ranked in parts of about salt_rows rows (SALTS parts at most, then larger
    ones), so one very frequent length is no single task. A piece whose length is null, below 1 or above size gets nulls. Repeated rows each get a place of their own;
    an empty table gives no rows; columns of the two added names are replaced, all others pass through under any name.
    """
    spark, units = pieces.sparkSession, size // grain
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    flat, at = numbered(pieces.select(*(F.col(f"`{c}`") for c in names))), {c: f"`{k}`" for k, c in enumerate(names)}
    length = F.col(at[length_col])
    kind = F.when((length >= 1) & (length <= size), F.ceil(length / grain).cast("int"))
    classed = flat.select(F.struct("*").alias("row"), kind.alias("class"), length.cast("long").alias("ids"), *(F.col(at[k]).alias(f"k{i}") for i, k in enumerate(keys)))
    order = [f"k{i}" for i in range(len(keys))]
    histogram = {r["class"]: r["n"] for r in classed.filter("class is not null").groupBy("class").agg(F.count("*").alias("n")).collect()}  # at most size / grain rows
    salts = F.array(*(F.lit(max(1, min(-(-histogram.get(c, 0) // salt_rows), SALTS))) for c in range(1, units + 2)))
    classed = classed.withColumn("salt", F.pmod(F.xxhash64(*order), F.element_at(salts, F.coalesce("class", F.lit(1)))).cast("int"))
    table = spark.createDataFrame(slots(cutting_stock(histogram, units)), "own int, lo long, hi long, many long, first long")
    per_salt = classed.filter("class is not null").groupBy("class", "salt").agg(F.count("*").alias("n"))
    before = per_salt.select("class", "salt", (F.sum("n").over(Window.partitionBy("class").orderBy("salt")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("class", "salt").orderBy(*order)) - 1
    ranked = classed.filter("class is not null").withColumn("local", local).join(before, ["class", "salt"]).select("row", "class", "ids", (F.col("before") + F.col("local")).alias("rank"))
    placed = ranked.join(F.broadcast(table), (F.col("own") == F.col("class")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))  # slots: patterns x classes
    placed = placed.withColumn("sequence_id", F.col("first") + F.expr("(rank - lo) div many")).withColumn("slot", (F.col("rank") - F.col("lo")) % F.col("many"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    good = placed.select("row", "sequence_id", F.coalesce(F.sum("ids").over(inside), F.lit(0)).cast("long").alias("offset"))
    bad = classed.filter("class is null").select("row", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    return good.unionByName(bad).select(*(F.col("row").getField(str(k)).alias(c) for k, c in enumerate(names)), "sequence_id", "offset")


def padded_length(used: int, size: int = 1024) -> int:
    """Ids that a sequence takes: its own number at a power of two, else size."""
    return used if used > 0 and used & (used - 1) == 0 else size
