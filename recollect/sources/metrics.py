"""Counters and histograms of jobs. Row counts come from observations on the jobs' own actions, so nothing is read twice for them."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, name string, labels string, kind string, value double"
#: Upper bounds of the buckets of a histogram, in seconds.
BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def _text(labels: dict[str, str]) -> str:
    clean = lambda v: str(v).replace("\\", "\\\\").replace('"', '\\"')
    return ",".join(f'{k}="{clean(v)}"' for k, v in sorted(labels.items()))


class Metrics:
    """Samples of a process, held until flush() appends them to a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.held, self.open = spark, path, [], []

    def count(self, name: str, n: float = 1, **labels: str) -> None:
        self.held.append((name, _text(labels), "counter", float(n)))

    def observed(self, df: DataFrame, name: str, label: str | None = None, **what: Column) -> DataFrame:
        """df, whose next action also takes these aggregates; each becomes a count of name, labelled label=<its name> if label is given.

        The action must have ended when flush() is called.
        """
        seen = Observation()
        self.open.append((seen, name, label))
        return df.observe(seen, *(c.alias(k) for k, c in what.items()))

    @contextmanager
    def timed(self, action: str) -> Iterator[None]:
        """Counts an operation by outcome and takes its time."""
        began, outcome = time.monotonic(), "error"
        try:
            yield
            outcome = "ok"
        finally:
            self.count("operations_total", action=action, outcome=outcome)
            self.held.append(("operation_seconds", _text({"action": action}), "histogram", time.monotonic() - began))

    def flush(self, now: str) -> int:
        """Append what was sampled since, stamped with now. Returns how many samples."""
        for seen, name, label in self.open:
            for k, n in seen.get.items():
                self.count(name, n or 0, **({label: k} if label else {}))
        rows, self.held, self.open = self.held, [], []
        if rows:
            df = self.spark.createDataFrame(rows, "name string, labels string, kind string, value double").withColumn("ts", F.lit(now).cast("timestamp"))
            df.select(*(f.split()[0] for f in SCHEMA.split(", "))).coalesce(1).write.mode("append").parquet(self.path)
        return len(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def series(samples: DataFrame) -> DataFrame:
    """name, labels, value of all series: sums of counters, and of histograms name_bucket (le, cumulative), name_sum and name_count."""
    counters = samples.filter("kind = 'counter'").groupBy("name", "labels").agg(F.sum("value").alias("value"))
    timed = samples.filter("kind = 'histogram'").groupBy("name", "labels")
    bounds = [*BOUNDS, float("inf")]
    parts = [(f"_bucket|{'+Inf' if b == float('inf') else b}", F.count_if(F.col("value") <= b).cast("double")) for b in bounds]
    parts += [("_sum|", F.sum("value")), ("_count|", F.count("*").cast("double"))]
    wide = timed.agg(F.array(*(F.struct(F.lit(k).alias("k"), c.alias("value")) for k, c in parts)).alias("all"))
    each = wide.select("name", "labels", F.explode("all").alias("s")).select("name", "labels", F.split("s.k", r"\|").alias("k"), "s.value")
    le = F.when(F.col("k")[1] != "", F.concat(F.when(F.col("labels") != "", F.concat("labels", F.lit(","))).otherwise(F.lit("")), F.lit('le="'), F.col("k")[1], F.lit('"'))).otherwise(F.col("labels"))
    return counters.unionByName(each.select(F.concat("name", F.col("k")[0]).alias("name"), le.alias("labels"), "value"))
