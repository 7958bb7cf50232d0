"""Embedders and scorers as ports: a label of the model, batches of a fixed size, a limit, and what happens when a scorer fails.

A port is any function over a list of texts. It runs in Arrow batches on the executors; texts reach it batch by batch.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.shared import save

#: Texts of one call at most, and texts that one search may ask to have scored (fixed values).
BATCH, LIMIT = 64, 10_000


class ResourceExhausted(ValueError):
    """RESOURCE_EXHAUSTED: more texts than a port takes."""


@dataclass(frozen=True)
class Embedder:
    """embed: a vector of dim numbers for each text of a list, in its order. version labels the model; None: unknown."""

    embed: Callable[[list[str]], list[list[float]]]
    dim: int
    version: str | None = None
    batch: int = BATCH

    def vectors(self, df: DataFrame, text_col: str = "text", to: str = "vector") -> DataFrame:
        """Adds a vector of floats for each text; a null text counts as empty. A wrong number or length of vectors stops the job."""
        call, size, dim = self.embed, self.batch, self.dim

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                each = texts.fillna("").tolist()
                out = [v for k in range(0, len(each), size) for v in _checked(call(each[k : k + size]), len(each[k : k + size]), "vectors")]
                if any(len(v) != dim for v in out):
                    raise ValueError(f"the embedder gave a vector whose length isn't {dim}")
                yield pd.Series([list(map(float, v)) for v in out], index=texts.index)

        return df.withColumn(to, run(text_col))

    def one(self, text: str) -> list[float]:
        """The vector of a query."""
        return list(map(float, _checked(self.embed([text]), 1, "vectors")[0]))


def _checked(out: list, n: int, what: str) -> list:
    if len(out) != n:
        raise ValueError(f"{n} texts gave {len(out)} {what}")
    return out


@dataclass(frozen=True)
class Scorer:
    """score: a number for each text of a list against a query, higher is better, in the list's order."""

    score: Callable[[str, list[str]], list[float]]
    version: str | None = None
    enabled: bool = True
    batch: int = BATCH


@dataclass
class Reranked:
    """hits: chunk_id, score, best first. version: the scorer's label, None where the fused order was kept, and why."""

    hits: DataFrame
    version: str | None
    degraded: str | None = None


def rerank(fused: DataFrame, texts: DataFrame, query: str, k: int, scorer: Scorer, id_col: str = "chunk_id", on_error: str = "fused") -> Reranked:
    """The k best of fused hits (chunk_id, score) by a scorer over their texts, ties to the better fused hit, then to the smaller id.

    Scores are rounded to 6 places. A disabled scorer, and with on_error="fused" one that fails, gives another number of scores or one that is not a number, keeps
    the fused order with a warning and says so; on_error="raise" lets failures through. Hits without a text are scored as empty.
    More than LIMIT hits are refused. The hits are a top-k, so they are saved: what is scored is scored once.
    """
    if on_error not in ("fused", "raise"):
        raise ValueError("on_error must be fused or raise")
    kept = fused.select(id_col, "score").orderBy(F.desc("score"), id_col).limit(k)
    if not scorer.enabled:
        warnings.warn("reranking was asked for and is disabled: the fused order is kept", stacklevel=2)
        return Reranked(kept, None, "disabled")
    fused = save(fused.select(id_col, "score"), "fused")
    n = fused.count()
    if n > LIMIT:
        raise ResourceExhausted(f"RESOURCE_EXHAUSTED: {n} texts, at most {LIMIT} are scored")
    call, size = scorer.score, scorer.batch

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            each = part.fillna("").tolist()
            out = [float(s) for i in range(0, len(each), size) for s in _checked(call(query, each[i : i + size]), len(each[i : i + size]), "scores")]
            if any(s != s for s in out):
                raise ValueError("a score is not a number")
            yield pd.Series(out, index=part.index)

    named = fused.join(texts.select(id_col, F.col("text").alias("_text")).join(F.broadcast(fused.select(id_col)), id_col, "left_semi"), id_col, "left")  # at most LIMIT rows
    try:
        scored = save(named.select(id_col, F.col("score").alias("fused"), F.round(run("_text"), 6).alias("score")), "scored")
    except PySparkException as e:
        if on_error == "raise":
            raise
        warnings.warn(f"the scorer failed, the fused order is kept: {str(e)[:200]}", stacklevel=2)
        return Reranked(fused.orderBy(F.desc("score"), id_col).limit(k), None, "failed")
    return Reranked(scored.orderBy(F.desc("score"), F.desc("fused"), id_col).limit(k).select(id_col, "score"), scorer.version)


class EmbeddingCache:
    """Vectors by model and content hash in a folder that only grows, so that no later ingest embeds a text again."""

    def __init__(self, spark, path: str, embedder: Embedder):
        self.spark, self.embedder = spark, embedder
        self.path = f"{path}/{embedder.version or 'unknown'}-{embedder.dim}"
        self._at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def known(self) -> DataFrame:
        """key, vector."""
        return self.spark.read.schema("key string, vector array<float>").parquet(self.path) if self._fs.exists(self._at) else self.spark.createDataFrame([], "key string, vector array<float>")

    def add(self, rows: DataFrame, text_col: str = "text") -> tuple[DataFrame, int]:
        """rows with a vector for each text, and how many texts were embedded for it. Rows meet the vectors by hash, not by text.

        What the cache doesn't hold yet is embedded once for each content and appended in one write; an ingest that dies
        before leaves the cache as it was.
        """
        keyed = rows.withColumn("key", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
        unseen = keyed.select("key", text_col).join(self.known().select("key"), "key", "left_anti").groupBy("key").agg(F.first(text_col).alias(text_col))
        new = save(self.embedder.vectors(unseen, text_col).select("key", "vector"), "vectors")
        n = new.count()
        if n:
            new.write.mode("append").parquet(self.path)
        return keyed.join(self.known().dropDuplicates(["key"]), "key").drop("key"), n
