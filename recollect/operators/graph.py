"""The code graph: edges, bounded walks, impact, modules, cycles. Edges are (source, target); kinds are optional."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.shared import save


def build_edges(raw: DataFrame, nodes: DataFrame | None = None, node_id: str = "id") -> DataFrame:
    """Distinct edges without loops, mirrored kinds (called_by) and, if nodes are given, edges to nodes outside."""
    out = raw.filter(F.col("source") != F.col("target"))
    if "kind" in raw.columns:
        out = out.filter(~F.col("kind").eqNullSafe("called_by"))
    out = out.dropDuplicates()
    return out if nodes is None else out.join(nodes.select(F.col(node_id).alias("target")).distinct(), "target", "left_semi").select(*raw.columns)


def dangling(edges: DataFrame, nodes: DataFrame, node_id: str = "id") -> DataFrame:
    """Endpoints that are no nodes: node, n_edges."""
    ends = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("n_edges")).join(nodes.select(F.col(node_id).alias("node")).distinct(), "node", "left_anti")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def reach(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """node: all that are reachable from start (node) in 1 to depth steps (None: any number), start itself excluded.

    A breadth-first frontier: each round joins only the nodes that the last one found with the edges, and keeps those
    not seen before; it ends by itself on cycles. Frontiers are tables, the driver sees only whether one is empty.
    """
    steps = save(edges.select("source", "target").distinct(), "steps")
    seen = frontier = save(start.select("node").distinct(), "start")
    first, taken = seen, 0
    while depth is None or taken < depth:
        found = frontier.join(steps, frontier["node"] == steps["source"]).select(F.col("target").alias("node")).distinct()
        frontier = save(found.join(seen, "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        taken += 1
    return seen.join(first, "node", "left_anti")


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges without those from nodes that nothing leads to, or to nodes that lead nowhere, until none is left."""
    n = edges.count()
    while n:
        ends = edges.select(F.col("target").alias("source")).distinct()
        starts = edges.select(F.col("source").alias("target")).distinct()
        edges = save(edges.join(ends, "source", "left_semi").join(starts, "target", "left_semi").select("source", "target"), "trimmed")
        n, before = edges.count(), n
        if n == before:
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """node and colour, the smallest node that leads to it (itself included). Only nodes whose colour fell tell their targets."""
    state = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    state = save(state.select("node", F.col("node").alias("colour"), F.lit(True).alias("fell")), "colours")
    while not state.filter("fell").isEmpty():
        told = edges.join(state.filter("fell"), F.col("source") == F.col("node")).groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("_told"))
        lower = F.coalesce(F.col("_told") < F.col("colour"), F.lit(False))
        state = save(state.join(told, "node", "left").select("node", F.least("colour", "_told").alias("colour"), lower.alias("fell")), "colours")
    return state.select("node", "colour")


def cycle_members(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle and the smallest member of their strongly connected component: node, component.

    Nodes off all cycles are trimmed from the ends; then each node is coloured by the smallest node that leads to it, and the
    nodes of a colour that lead back to that one are its component. The edges left inside colours go round again. The
    state is a row for each node or edge, never one for each pair of nodes. Edges with a null end are no edges.
    """
    live = save(edges.select("source", "target").dropna().distinct(), "edges")
    loops = live.filter("source = target").select(F.col("source").alias("component"))
    found = live.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0)
    while True:
        live = _trimmed(live)
        if live.isEmpty():
            break
        colours = _coloured(live)
        a, b = (colours.select(F.col("node").alias(end), F.col("colour").alias(c)) for end, c in (("source", "_a"), ("target", "_b")))
        inner = save(live.join(a, "source").join(b, "target").filter("_a = _b").select("source", "target"), "inner")
        roots = colours.filter("node = colour").select("node")
        back = reach(reversed_edges(inner), roots).unionByName(roots)
        members = save(colours.join(back, "node", "left_semi").select("node", F.col("colour").alias("component")), "members")
        found = found.unionByName(members)
        gone = members.select("node")
        live = save(inner.join(gone, inner["source"] == gone["node"], "left_anti").join(gone, F.col("target") == gone["node"], "left_anti"), "edges")
    real = found.filter("node <> component").select("component").unionByName(loops).distinct()
    return found.join(real, "component", "left_semi").select("node", "component")


def cycle_paths(edges: DataFrame, members: DataFrame) -> DataFrame:
    """component and path: of each component of cycle_members a shortest cycle through its smallest node, which is first and last.

    A breadth-first search from the smallest nodes, in all components at once; a node is reached from the smallest of the
    nodes that lead to it a step earlier, and the cycle closes from the smallest of the nearest nodes that lead back.
    """
    keyed = lambda end, c: members.select(F.col("node").alias(end), F.col("component").alias(c))
    inner = edges.select("source", "target").distinct().join(keyed("source", "component"), "source").join(keyed("target", "_c"), "target")
    inner = save(inner.filter("component = _c").select("component", "source", "target"), "inner")
    level = inner.select("component", F.col("component").alias("node")).distinct()
    seen = level = save(level.withColumn("parent", F.lit(None).cast(level.schema["node"].dataType)), "level")
    closed = None
    while not level.isEmpty():
        ahead = level.join(inner.withColumnRenamed("source", "node"), ["component", "node"]).groupBy("component", F.col("target").alias("at")).agg(F.min("node").alias("parent"))
        ahead = save(ahead.withColumnRenamed("at", "node"), "ahead")
        home = ahead.filter("node = component").select("component", F.col("parent").alias("at"))
        closed = home if closed is None else closed.unionByName(home)
        level = save(ahead.join(home, "component", "left_anti").join(seen, ["component", "node"], "left_anti").select("component", "node", "parent"), "level")
        seen = seen.unionByName(level)
    if closed is None:
        return inner.select("component", F.array("component").alias("path")).limit(0)
    walk = closed.withColumn("path", F.array("component"))
    while True:
        step = walk.join(seen.withColumnRenamed("node", "at"), ["component", "at"], "left")
        walk = save(step.select("component", F.col("parent").alias("at"), F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat(F.array("at"), "path")).alias("path")), "walk")
        if walk.filter("at is not null").isEmpty():
            return walk.select("component", "path")


def module_edges(edges: DataFrame, modules: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Distinct (source, target) between the modules of calls' ends, loops dropped, and given imports. modules: id, module."""
    a = modules.select(F.col("id").alias("source"), F.col("module").alias("_a"))
    b = modules.select(F.col("id").alias("target"), F.col("module").alias("_b"))
    out = edges.join(a, "source").join(b, "target").filter(F.col("_a") != F.col("_b")).select(F.col("_a").alias("source"), F.col("_b").alias("target"))
    return (out if imports is None else out.unionByName(imports.select("source", "target"))).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """source and its sorted distinct targets, for graphs whose fan-out is small."""
    return edges.groupBy("source").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def dependency_lines(edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """`a -> b` for each module edge, then `cycle: a -> b -> a` for each of cycle_paths, both in order: part, line."""
    a = edges.select(F.lit(0).alias("part"), F.concat(F.col("source").cast("string"), F.lit(" -> "), F.col("target").cast("string")).alias("line"))
    b = cycles.select(F.lit(1).alias("part"), F.concat(F.lit("cycle: "), F.array_join(F.col("path").cast("array<string>"), " -> ")).alias("line"))
    return a.unionByName(b).orderBy("part", "line")


def fan_in(edges: DataFrame, k: int | None = None) -> DataFrame:
    """Raw edges into each target, most first, ties to the smaller id."""
    out = edges.groupBy("target").agg(F.count("*").alias("n"))
    return out if k is None else out.orderBy(F.desc("n"), "target").limit(k)


def call_sites(edges: DataFrame, k: int | None = None) -> DataFrame:
    out = edges.groupBy("source").agg(F.count("*").alias("n"))
    return out if k is None else out.orderBy(F.desc("n"), "source").limit(k)
