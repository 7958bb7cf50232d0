"""Deletes with their cascades, retention, and sweeps of JSON lines. Time is always given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delete_counts(chunks: DataFrame, docs: DataFrame, feedback: DataFrame, where: Column) -> DataFrame:
    """One row: chunks, docs and feedback rows that a delete of the chunks and documents for which where holds would remove."""
    gone = chunks.filter(where).select("chunk_id")
    a = gone.agg(F.count("*").alias("n_chunks"))
    b = docs.filter(where).agg(F.count("*").alias("n_docs"))
    c = feedback.join(gone.distinct(), "chunk_id", "left_semi").agg(F.count("*").alias("n_feedback"))
    return a.join(F.broadcast(b)).join(F.broadcast(c)).select("n_chunks", "n_docs", "n_feedback", (F.col("n_chunks") + F.col("n_docs") + F.col("n_feedback")).alias("total"))


def survivors(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which where is not true; rows with a null key stay."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def surviving_feedback(feedback: DataFrame, chunks: DataFrame, where: Column) -> DataFrame:
    return feedback.join(chunks.filter(where).select("chunk_id").distinct(), "chunk_id", "left_anti")


def expired(df: DataFrame, now: str, days: int, ts_col: str = "created_at") -> DataFrame:
    """Rows older than days before now; none if days is 0 (off). Rows without a time never expire."""
    if days == 0:
        return df.limit(0)
    return df.filter(F.col(ts_col) < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS"))


def unexpired(df: DataFrame, now: str, days: int, ts_col: str = "created_at") -> DataFrame:
    if days == 0:
        return df
    old = F.col(ts_col) < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.filter(~F.coalesce(old, F.lit(False)))


def expired_by_tenant(df: DataFrame, policy: DataFrame, now: str, default: int = 30, tenant_col: str = "tenant_id", ts_col: str = "created_at") -> DataFrame:
    """Expired rows of all tenants in one job. policy: tenant, days, one row for each tenant; 0 is off, no row or null is default.

    Columns of df as they are. Rows without a time never expire; rows without a tenant follow the default.
    """
    days = policy.select(F.col("tenant").alias("_tenant"), F.col("days").cast("int").alias("_days"))
    out = df.join(days, F.col(tenant_col) == F.col("_tenant"), "left").withColumn("_days", F.coalesce("_days", F.lit(default)))
    limit = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.col("_days"))
    return out.filter((F.col("_days") > 0) & (F.col(ts_col) < limit)).select(*df.columns)


def sweep_lines(lines: DataFrame, now: str, days: int, line_col: str = "line") -> DataFrame:
    """JSON lines whose `ts` is not older than days; malformed and undated lines stay."""
    ts = F.try_to_timestamp(F.get_json_object(line_col, "$.ts")).cast("timestamp_ntz")
    return unexpired(lines.withColumn("_ts", ts), now, days, "_ts").drop("_ts")


def retention_change(was: Column, now: Column, default: int = 30) -> Column:
    """What a policy's change does: disable (to 0, off), tighten (to fewer days, or on again), relax (to more) or none. A null follows the default."""
    was, now = F.coalesce(was, F.lit(default)), F.coalesce(now, F.lit(default))
    return F.when(was == now, "none").when(now == 0, "disable").when(was == 0, "tighten").when(now > was, "relax").otherwise("tighten")


def compact_decision(rows: DataFrame, now: str, days: int, by: str, ts_col: str = "created_at") -> DataFrame:
    """Per group: rows, expired rows, and whether a sweep should compact (only if rows expired)."""
    old = F.col(ts_col) < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    hit = F.count_if(old & F.lit(days != 0))
    return rows.groupBy(by).agg(F.count("*").alias("n_rows"), hit.alias("n_expired"), (hit > 0).alias("compact"))
