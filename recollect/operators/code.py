"""Symbols and literal code search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import node_display
from recollect.operators import graph, lifecycle


def first_definition(symbols: DataFrame) -> DataFrame:
    """Of each name the first definition by file, start_line and id."""
    least = F.min(F.struct("file", "start_line", "id")).alias("d")
    return symbols.groupBy("name").agg(least).select("name", "d.file", "d.start_line", "d.id")


def literal_search(concepts: DataFrame, query: str, k: int = 20) -> DataFrame:
    """Best matches by bucket: 0 exact name, 1 prefix, 2 in the name, 3 in the qualified name, 4 in signature or description. id, bucket."""
    q = query.strip().lower()
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    bucket = (
        F.when(low("name") == q, 0)
        .when(low("name").startswith(q), 1)
        .when(low("name").contains(q), 2)
        .when(low("qualified_name").contains(q), 3)
        .when(low("signature").contains(q) | low("description").contains(q), 4)
    )
    found = concepts.select("id", bucket.alias("bucket")).filter(F.col("bucket").isNotNull() & F.lit(bool(q)))
    return found.orderBy("bucket", "id").limit(min(k, 100))


def symbol_rows(concepts: DataFrame, tenant: str, project: str, now: str) -> DataFrame:
    """Concepts as rows of the store's symbols, stamped with tenant, project and time; location is file#Lx-Ly."""
    place = F.format_string("%s#L%d-L%d", "file", "start_line", F.coalesce("end_line", "start_line"))
    return concepts.select(F.col("name").alias("symbol_name"), F.lit(tenant).alias("tenant_id"), F.lit(project).alias("project_id"), "kind", place.alias("location"), "signature", F.lit(now).cast("timestamp").alias("created_at"))


def replace_project(symbols: DataFrame, project: str, rows: DataFrame) -> DataFrame:
    """symbols with those of a project replaced by rows; none of its old ones stays, other projects are untouched."""
    return lifecycle.survivors(symbols, F.col("project_id") == project).unionByName(rows.select(*symbols.columns))


def lookup_symbols(symbols: DataFrame, project: str, name: str | None = None) -> DataFrame:
    """A project's symbols, all or those of exactly this name, by name and location."""
    out = symbols.filter(F.col("project_id") == project)
    return (out if name is None else out.filter(F.col("symbol_name") == name)).orderBy("symbol_name", "location")


def definitions(concepts: DataFrame, name: str) -> DataFrame:
    """node: the graph ids of all concepts of this name; none for an unknown one."""
    return concepts.filter(F.col("name") == name).select(F.col("id").alias("node")).distinct()


def related(edges: DataFrame, concepts: DataFrame, name: str, depth: int | None = 1, callers: bool = True) -> DataFrame:
    """id and display of the concepts that call (or are called by) any definition of a name in 1 to depth steps (None: any number).

    The definitions themselves are left out, as are ids without a concept.
    """
    found = graph.reach(graph.reversed_edges(edges) if callers else edges, definitions(concepts, name), depth)
    shown = concepts.select("id", node_display(F.col("name"), F.col("file"), F.col("start_line"), F.coalesce("end_line", "start_line")).alias("display"))
    return shown.join(found.withColumnRenamed("node", "id"), "id", "left_semi")


def kind_counts(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy("kind").agg(F.count("*").alias("n"))


def semantic_text(name, signature):
    """`name signature`, or the name alone."""
    return F.concat_ws(" ", name, F.nullif(signature, F.lit("")))


def python_concepts(files: DataFrame) -> DataFrame:
    """Functions, classes and calls of Python sources: id, kind, name, qualified_name, file, start_line, end_line, signature, calls.

    files: file, text. A file that can't be parsed gives one row of kind `skipped`, other languages likewise.
    """
    import ast
    from collections.abc import Iterator

    import pandas as pd

    columns = ["id", "kind", "name", "qualified_name", "file", "start_line", "end_line", "signature", "calls"]

    def rows(file: str, text: str | None) -> list[tuple]:
        skipped = [(f"{file}#", "skipped", file, file, file, 0, 0, "", [])]
        if not file.endswith(".py"):
            return skipped
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError):
            return skipped
        out = []

        def visit(node: ast.AST, path: list[str]) -> None:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    name = ".".join([*path, child.name])
                    kind = "class" if isinstance(child, ast.ClassDef) else "method" if path and path[-1][:1].isupper() else "function"
                    args = "" if kind == "class" else f"({', '.join(a.arg for a in child.args.args)})"
                    called = sorted({c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(child) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))})
                    out.append((f"{file}#{name}", kind, child.name, name, file, child.lineno, child.end_lineno, args, called))
                    visit(child, [*path, child.name])
                else:
                    visit(child, path)

        visit(tree, [])
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for f, t in zip(b["file"], b["text"]) for r in rows(f, t)], columns=columns)

    return files.select("file", "text").mapInPandas(run, "id string, kind string, name string, qualified_name string, file string, start_line int, end_line int, signature string, calls array<string>")
