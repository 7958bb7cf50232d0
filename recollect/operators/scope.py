"""Tenant and workspace scope, point lookups and lists of ids. Null keys match nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped(df: DataFrame, tenant: str, workspace: str | None = None, tenant_col: str = "tenant_id", workspace_col: str = "workspace_id") -> DataFrame:
    out = df.filter(F.col(tenant_col) == tenant)
    return out if workspace is None else out.filter(F.col(workspace_col) == workspace)


def created_before(cutoff: str, col: str = "created_at") -> Column:
    return F.col(col) < F.lit(cutoff).cast("timestamp_ntz")


def lookup(df: DataFrame, id_col: str, value: object) -> DataFrame:
    """The row of an id in a scope already applied, or none."""
    return df.filter(F.col(id_col) == value).limit(1)


def in_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def top_k_or_default(top_k: int, default: int = 20, most: int = 100) -> int:
    if top_k > most:
        raise ValueError(f"TOP_K_EXCEEDED: {top_k} > {most}")
    return top_k or default


def provenance(df: DataFrame) -> DataFrame:
    """chunk_id, text and a struct of where it came from."""
    return df.select("chunk_id", "text", F.struct("tenant_id", "workspace_id", "doc_id", "source", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at")).alias("provenance"))
