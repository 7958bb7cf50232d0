"""The corpus pipeline: quality, language, near-duplicates, source mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs; all but the
last keep the columns of documents. run() applies them to the documents of sf_dir.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.llm import langid, mixing, near_dup, quality, queries
from recollect.llm._common import numbered, save

#: A document is rejected below this score; the same bound as op5's.
MIN_QUALITY = 0.3
#: A document is rejected if its language is unknown or fewer of its letters stand in words that some language explains.
MIN_LANGUAGE = 0.5
#: The mixture repeats no source more often than this, and every document at least once.
MAX_REPEATS = 1.5


def by_place(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named by their places, and the new names: so no column of docs clashes with one that a stage adds."""
    return numbered(docs), {c: str(k) for k, c in enumerate(docs.columns)}


def named_again(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, as they came, of rows that by_place() named."""
    return rows.select(*(F.col(f"`{k}`") for k in range(len(docs.columns)))).toDF(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality network scores at least MIN_QUALITY. It is fitted on the labelled documents of its input."""
    net, (rows, at) = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), by_place(docs)
    return named_again(quality.score(rows, net, at["text"]).filter(F.col("score") >= MIN_QUALITY), docs)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language of which at least MIN_LANGUAGE of the letters are in words of known languages, however many share them."""
    rows, at = by_place(docs)
    found = langid.identify(rows, langid.train(docs), at["text"], spans=False, shares=True)
    return named_again(found.filter((F.col("lang_pred") != "und") & (F.col("explained") >= MIN_LANGUAGE)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each class of near-duplicates; of rows that repeat an id and its text, the first
    by the other columns. Null ids stay."""
    rows, at = by_place(docs)
    doc_id, text = F.col(f"`{at['doc_id']}`"), F.col(f"`{at['text']}`")
    kept = near_dup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept id")).distinct()
    same = Window.partitionBy(doc_id, F.md5(text)).orderBy(*(F.col(f"`{k}`").cast("string") for c, k in at.items() if c not in ("doc_id", "text")))
    named = rows.filter(doc_id.isNotNull()).join(kept, doc_id == F.col("kept id"), "left_semi").withColumn("place", F.row_number().over(same)).filter("place = 1")
    return named_again(named, docs).unionByName(docs.filter("doc_id is null"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as the mixture's blocks do: whole passes, so that no document is lost, and a cut one for small sources."""
    rows, at = by_place(docs)
    mixed = mixing.copies(rows, at["doc_id"], at["source"], at["text"], entropy_share=None, max_repeats=MAX_REPEATS, whole_epoch=True)
    return named_again(mixing.blocks(mixed), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed into sequences of 1024 ids."""
    return queries.packed(docs, end_mark=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("language", language_filter),
    ("near_dedup", near_dedup),
    ("mixture", source_mixture),
    ("packing", packing_stage),
]

#: Models and sketches are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
