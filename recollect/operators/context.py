"""Context packing under a token budget, with a bonus from feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAP = 0.5
#: Hits that a prompt is filled from.
HITS = 100


def feedback_bonus(feedback: DataFrame, id_col: str = "chunk_id", score_col: str = "score") -> DataFrame:
    """chunk_id, mean_score, bonus: mean times CAP, between 0 and CAP. Rows with a null score don't count."""
    mean = feedback.filter(F.col(score_col).isNotNull()).groupBy(id_col).agg(F.avg(F.col(score_col).cast("double")).alias("mean_score"))
    return mean.withColumn("bonus", F.least(F.greatest(F.col("mean_score") * CAP, F.lit(0.0)), F.lit(CAP)))


def orphans(feedback: DataFrame, chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return feedback.join(chunks.select(id_col), id_col, "left_anti")


def fit(hits: DataFrame, budget: int, bonus: DataFrame | None = None, id_col: str = "chunk_id") -> DataFrame:
    """The longest prefix of hits (chunk_id, score, n_tokens; the HITS best count), by score plus bonus, within budget tokens.

    Ends at the first hit that doesn't fit. Returns chunk_id, value, n_tokens, running.
    """
    valued = hits.withColumn("value", F.col("score"))
    if bonus is not None:
        valued = hits.join(bonus.select(id_col, "bonus"), id_col, "left").withColumn("value", F.round(F.col("score") + F.coalesce("bonus", F.lit(0.0)), 6))
    order = Window.orderBy(F.desc("value"), id_col).rowsBetween(Window.unboundedPreceding, 0)
    return valued.orderBy(F.desc("value"), id_col).limit(HITS).withColumn("running", F.sum("n_tokens").over(order)).filter(F.col("running") <= budget).select(id_col, "value", "n_tokens", "running")


def fit_reason(hits: DataFrame, budget: int, id_col: str = "chunk_id") -> DataFrame:
    """One row: how many fit, their tokens, and why none did (budget_zero, budget_smaller_than_smallest_chunk) or null."""
    fitted = fit(hits, budget, id_col=id_col).agg(F.count("*").alias("n_fit"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("tokens"))
    given = hits.agg(F.count("*").alias("n_hits"))
    reason = F.when(F.lit(budget) == 0, "budget_zero").when((F.col("n_hits") > 0) & (F.col("n_fit") == 0), "budget_smaller_than_smallest_chunk")
    return fitted.join(F.broadcast(given)).select("n_hits", "n_fit", "tokens", reason.alias("reason"))
