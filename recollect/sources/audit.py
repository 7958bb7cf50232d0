"""Audit and event logs as JSON lines, and counts of what operations did."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.lifecycle import sweep_lines

SCHEMA = "ts timestamp, tenant_id string, agent_id string, action string, target string, outcome string, error_code string, chore_id string"


def record(entries: DataFrame, path: str) -> None:
    """Append entries (columns of SCHEMA; those that are missing are null) as lines."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    have = [F.col(n) if n in entries.columns else F.lit(None).cast("string").alias(n) for n in names]
    lines = entries.select(*have).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    lines.select(F.to_json(F.struct(*names)).alias("value")).write.mode("append").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The entries; malformed lines have nulls only."""
    return spark.read.text(path).select(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")


def sweep(spark: SparkSession, path: str, kept: str, now: str, days: int) -> None:
    """Write the lines not older than days to the folder kept. Malformed and undated lines stay."""
    lines = spark.read.text(path)
    sweep_lines(lines.withColumnRenamed("value", "line"), now, days).select(F.col("line").alias("value")).write.text(kept)


def outcome_counts(entries: DataFrame) -> DataFrame:
    """action, outcome, n: the series of a metrics page."""
    return entries.groupBy("action", "outcome").agg(F.count("*").alias("n"))


def metrics_text(counts: DataFrame, name: str = "operations_total") -> DataFrame:
    """Counts as lines of the Prometheus text format."""
    label = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r'(["\\])', r"\\$1")
    return counts.select(F.concat(F.lit(name + '{action="'), label("action"), F.lit('",outcome="'), label("outcome"), F.lit('"} '), F.col("n").cast("string")).alias("line"))
