"""Exact nearest neighbours in double precision. Null vectors and vectors of another length take no part."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.shared import shared_dir


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors that are empty, of different lengths or without length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "chunk_id", vec_col: str = "vector") -> DataFrame:
    """chunk_id, distance (squared L2), score 1 / (1 + distance) of the k nearest, ties to the smaller id: one pass, a top-k in every task."""
    near = vectors.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) == len(query))).select(id_col, F.round(squared_l2(F.col(vec_col), literal(query)), 6).alias("distance"))
    return near.orderBy("distance", id_col).limit(k).select(id_col, "distance", F.round(1 / (1 + F.col("distance")), 6).alias("score"))


def cosine_rank(vectors: DataFrame, query: list[float], k: int, id_col: str = "chunk_id", vec_col: str = "vector") -> DataFrame:
    return vectors.select(id_col, F.round(cosine(F.col(vec_col), literal(query)), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


#: Queries that are broadcast at once, and blocks of them that one plan holds.
BLOCK, PLANNED = 1024, 8


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vec_col: str = "vector", query_id: str = "query_id", query_vec: str = "query_vector") -> DataFrame:
    """The k nearest for each of a stated set of queries, which is sent to all rows, BLOCK queries at a time.

    Every task cuts to its k best for a query before rows meet by query. Beyond PLANNED blocks each one is a job of its own whose rows
    are appended to a table in the shared folder, so that no plan grows with the queries.
    """
    asked = queries.select(query_id, query_vec)
    blocks = -(-asked.count() // BLOCK) or 1
    best, out = Window.partitionBy(query_id).orderBy("distance", id_col), None
    path = f"{shared_dir(vectors.sparkSession)}/knn-{uuid.uuid4().hex}" if blocks > PLANNED else None
    for b in range(blocks):
        some = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)
        pairs = vectors.filter(F.col(vec_col).isNotNull()).join(F.broadcast(some), F.size(vec_col) == F.size(query_vec))
        scored = pairs.select(query_id, id_col, F.round(squared_l2(F.col(vec_col), F.col(query_vec)), 6).alias("distance"))
        ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        if path:
            ranked.write.mode("append").parquet(path)
        else:
            out = ranked if out is None else out.unionByName(ranked)
    return vectors.sparkSession.read.schema(ranked.schema).parquet(path) if path else out
