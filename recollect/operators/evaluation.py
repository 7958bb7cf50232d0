"""Retrieval metrics, counts and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mrr_recall(hits: DataFrame, queries: DataFrame, relevant: DataFrame, k: int = 5, query_id: str = "query_id", id_col: str = "chunk_id") -> DataFrame:
    """One row: n_queries, mrr, recall at k. hits: query_id, chunk_id, rank; relevant: query_id, chunk_id. Queries without a hit score 0."""
    good = hits.filter(F.col("rank") <= k).join(relevant.select(query_id, id_col).distinct(), [query_id, id_col], "left_semi")
    first = good.groupBy(query_id).agg(F.min("rank").alias("first"))
    per = queries.select(query_id).distinct().join(first, query_id, "left")
    return per.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.col("first").isNotNull().cast("double")), 6).alias("recall"))


def stats_rollup(chunks: DataFrame, docs: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row of table counts."""
    a = chunks.agg(F.count("*").alias("n_chunks"), F.countDistinct("tenant_id", "workspace_id").alias("n_workspaces"))
    return a.join(F.broadcast(docs.agg(F.count("*").alias("n_docs")))).join(F.broadcast(feedback.agg(F.count("*").alias("n_feedback"))))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def nearest_rank(df: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.99), buckets: int = 1024) -> DataFrame:
    """Exact percentiles at rank round(p * (n - 1)) of each group: group, p50, p99 for the default shares.

    Equal values are counted first, so a value that many rows share is one row. Values are dealt to buckets by approximate
    quantile bounds (a fixed number of them), so that a frequent group is sorted in many tasks; a value's first rank is
    its bucket's offset plus the rows of smaller values inside. Null values don't count; a null group is a group.
    """
    each = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    bounds = each.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000).alias("_q"))
    held = each.join(F.broadcast(bounds)).withColumn("_b", F.size(F.filter("_q", lambda q: q < F.col(value)))).drop("_q")
    by = Window.partitionBy(group)
    sizes = held.groupBy(group, "_b").agg(F.sum("_c").alias("_m"))
    sizes = sizes.withColumn("_before", F.sum("_m").over(by.orderBy("_b")) - F.col("_m")).withColumn("_n", F.sum("_m").over(by))
    inside = Window.partitionBy(group, "_b").orderBy(value)
    ranked = held.withColumn("_r", F.sum("_c").over(inside) - F.col("_c")).alias("h").join(sizes.alias("s"), F.col(f"h.{group}").eqNullSafe(F.col(f"s.{group}")) & (F.col("h._b") == F.col("s._b")))
    at, want = F.col("_before") + F.col("_r"), lambda p: F.round((F.col("_n") - 1) * p)
    cols = [F.max(F.when((at <= want(p)) & (want(p) < at + F.col("_c")), F.col(f"h.{value}"))).alias(f"p{int(p * 100)}") for p in shares]
    return ranked.groupBy(F.col(f"h.{group}").alias(group)).agg(*cols)
