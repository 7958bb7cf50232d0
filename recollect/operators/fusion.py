"""Reciprocal-rank fusion, the hybrid search built on it, and reranking. Legs hold at most 100 rows, so ranking them is one small task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import tokens

#: Rows of a leg that take part.
LEG = 100


def ranked(leg: DataFrame, id_col: str = "chunk_id", score_col: str = "score") -> DataFrame:
    """Rank from 1 by score, ties to the smaller id, of the LEG best rows of a leg."""
    return leg.orderBy(F.desc(score_col), id_col).limit(LEG).select(id_col, F.row_number().over(Window.orderBy(F.desc(score_col), id_col)).alias("rank"))


def rrf(legs: list[DataFrame], k: float = 60.0, id_col: str = "chunk_id") -> DataFrame:
    """chunk_id and score: the sum over legs (chunk_id, rank) of 1 / (k + rank)."""
    if not (k > 0 and k < float("inf")):
        raise ValueError("k must be positive and finite")
    union = legs[0].select(id_col, "rank")
    for leg in legs[1:]:
        union = union.unionByName(leg.select(id_col, "rank"))
    return union.groupBy(id_col).agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("score"))


def rrf_sweep(legs: list[DataFrame], ks: list[float], id_col: str = "chunk_id") -> DataFrame:
    """The fusion for several k in one pass: k, chunk_id, score."""
    union = legs[0].select(id_col, "rank")
    for leg in legs[1:]:
        union = union.unionByName(leg.select(id_col, "rank"))
    each = union.withColumn("k", F.explode(F.array(*(F.lit(float(k)) for k in ks))))
    return each.groupBy("k", id_col).agg(F.round(F.sum(1 / (F.col("k") + F.col("rank"))), 6).alias("score"))


def hybrid(lexical: DataFrame, vector: DataFrame, top_k: int, chunks: DataFrame, k: float = 60.0, keep: Column | None = None, filter_mode: str = "post", id_col: str = "chunk_id") -> DataFrame:
    """chunk_id and fused score. post: the filter comes after the cut to top_k, so fewer may remain; pre: before it."""
    fused = rrf([ranked(lexical, id_col), ranked(vector, id_col)], k, id_col)
    if keep is not None and filter_mode == "pre":
        fused = fused.join(chunks.filter(keep).select(id_col), id_col, "left_semi")
    cut = fused.orderBy(F.desc("score"), id_col).limit(top_k)
    if keep is not None and filter_mode == "post":
        cut = cut.join(chunks.filter(keep).select(id_col), id_col, "left_semi")
    return cut


def overlap_score(query: str, text: Column) -> Column:
    """The default reranker: the share of the query's distinct tokens that the text has."""
    asked = F.array_distinct(tokens(F.lit(query)))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(text))) / F.size(asked)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, chunks: DataFrame, query: str, top_k: int, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """hits (at most max(top_k, 10)) by the reranker's score, ties to the smaller id."""
    texts = chunks.join(hits.select(id_col), id_col, "left_semi").select(id_col, F.round(overlap_score(query, F.col(text_col)), 6).alias("score"))
    return texts.orderBy(F.desc("score"), id_col).limit(top_k)
