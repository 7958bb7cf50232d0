"""The architecture summary, the graph dump and semantic code search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators import graph, vector
from recollect.operators.code import kind_counts, literal_search, semantic_text
from recollect.operators.embedding import embed, stub_embed


def architecture(concepts: DataFrame, imports: DataFrame, calls: DataFrame, modules: DataFrame, k: int = 5) -> DataFrame:
    """Rows (section, item, n): concepts by kind, the k targets with most imports, the k callers with most call sites, members of cycles.

    imports and calls are raw edges, repeats counted; modules are the distinct edges between modules.
    """
    text = lambda c: F.col(c).cast("string").alias("item")
    kinds = kind_counts(concepts).select(F.lit("kind").alias("section"), text("kind"), "n")
    targets = graph.fan_in(imports, k).select(F.lit("imported").alias("section"), text("target"), "n")
    callers = graph.call_sites(calls, k).select(F.lit("calling").alias("section"), text("source"), "n")
    cycles = graph.cycle_members(modules).select(F.lit("cycle").alias("section"), text("node"), F.lit(1).cast("long").alias("n"))
    return kinds.unionByName(targets).unionByName(callers).unionByName(cycles)


def markdown(rows: DataFrame, most: int = 100) -> str:
    """The summary as text: of each section the first most rows by number and name, and how many more there are."""
    out = ["# Architecture"]
    titles = {"kind": "Concepts", "imported": "Most imported", "calling": "Most call sites", "cycle": "Modules on cycles"}
    total = dict(map(tuple, rows.groupBy("section").count().collect()))
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "item"))
    found = rows.withColumn("place", place).filter(F.col("place") <= most).orderBy("section", "place").collect()
    for section, title in titles.items():
        lines = [f"- {r['item']}: {r['n']}" for r in found if r["section"] == section]
        lines += [f"- and {total[section] - most} more"] if total.get(section, 0) > most else []
        out += ["", f"## {title}", *(lines or ["- none"])]
    return "\n".join(out) + "\n"


def dump(edges: DataFrame) -> DataFrame:
    """Edges as JSON lines, sorted by source and target."""
    return edges.orderBy("source", "target").select(F.to_json(F.struct("source", "target")).alias("line"))


def semantic_search(concepts: DataFrame, query: str, k: int = 20, dim: int = 64) -> DataFrame:
    """id and score of the concepts whose name and signature are nearest to the query by cosine, no threshold."""
    rows = concepts.select("id", semantic_text(F.col("name"), F.col("signature")).alias("text"))
    return vector.cosine_rank(stub_embed(rows, "id", "text", dim), embed(query, dim), min(k, 100), "id", "vector")


def search(concepts: DataFrame, query: str, k: int = 20, vectors: DataFrame | None = None, embed_query=embed) -> DataFrame:
    """place (from 1), id, name, kind and file of the best k concepts (at most 100).

    By cosine over stored vectors (id, vector), all of them ranked, if there are any and embed_query (text, dim) gives a
    vector; by literal matches where vectors are None or empty or the embedder fails. Ranked ids without a concept go.
    """
    first = None if vectors is None else vectors.select("vector").first()
    asked = None
    if first is not None:
        try:
            asked = embed_query(query, len(first["vector"]))
        except (OSError, RuntimeError, ValueError):  # an embedder that fails leaves literal search
            asked = None
    known = concepts.select("id", "name", "kind", "file")
    if asked is None:
        ranked = literal_search(concepts, query, k)
        order = ["bucket", "id"]
    else:
        ranked = vector.cosine_rank(vectors.join(concepts.select("id"), "id", "left_semi"), asked, min(k, 100), "id", "vector")
        order = [F.desc("score"), "id"]
    # at most 100 rows come here
    placed = ranked.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return placed.join(known, "id").select("place", "id", "name", "kind", "file").orderBy("place")


def location(file: Column, start: Column, end: Column) -> Column:
    """file#Lx-Ly, always a range."""
    return F.format_string("%s#L%d-L%d", file, start, end)
