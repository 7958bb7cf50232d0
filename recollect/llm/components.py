"""Connected components of an edge table by contraction: every round hooks each label to its smallest neighbour."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._common import save


def connected_components(edges: DataFrame) -> DataFrame:
    """Table (node, component): the smallest id reachable from each node that has an edge. edges: src, dst (long).

    A round replaces both ends of every edge by their smallest neighbour's smallest neighbour, drops loops and repeats,
    and so leaves far fewer edges to the next. Labels stay in tables; the driver sees only whether edges remain.
    """
    edges = save(_tidy(edges.select("src", "dst")), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hook = save(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("up")), "hook")
        jump = hook.join(hook.select(F.col("src").alias("up"), F.col("up").alias("top")), "up").select("src", F.col("top").alias("up"))
        jump = save(jump, "jump")
        if labels is None:
            labels = jump.select(F.col("src").alias("node"), F.col("up").alias("component"))
        else:
            labels = labels.join(jump.select(F.col("src").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        labels = save(labels, "labels")
        left = edges.join(jump.select("src", F.col("up").alias("a")), "src")
        left = left.join(jump.select(F.col("src").alias("dst"), F.col("up").alias("b")), "dst")
        edges = save(_tidy(left.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "edges")
    return labels if labels is not None else edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its group) that connect what the pairs a, b connect: at most one for each id."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        lo = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], lo)
        np.minimum.at(new, label[y], lo)
        new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]
