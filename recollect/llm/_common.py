"""Shared helpers: intermediate tables in the shared folder, held-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from recollect.functions.shared import release, save, shared_dir

__all__ = ["bounded_sample", "fold", "numbered", "release", "save", "shared_dir"]


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as held out (0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % mod, F.lit(0))


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named by their places: for functions on Arrow batches, which no name of the input can then disturb."""
    return df.toDF(*map(str, range(len(df.columns))))


def bounded_sample(rows: DataFrame, most: int) -> list[Row]:
    """Rows (id, draw, t and others) in order of draw and id for as long as their texts t, together, are of at most most bytes.

    rows is small in number, not in bytes: it is saved, and only the texts that are picked come to the driver.
    """
    rows = save(rows.withColumn("at", F.monotonically_increasing_id()), "sample")
    sizes, picked, total = rows.select("draw", "id", F.octet_length("t").alias("n"), "at").collect(), [], 0
    for *_, n, at in sorted(sizes):
        if total + n <= most:
            total += n
            picked.append(at)
    out = rows.filter(F.col("at").isin(picked)).drop("at").collect() if picked else []
    return sorted(out, key=lambda r: (r["draw"], r["id"], *map(str, r)))
