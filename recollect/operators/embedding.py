"""A deterministic stand-in for an embedding model, for work without one."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from recollect.operators.ports import Embedder

#: FNV-1a 64, and the constants of the mixing that scatters a token over SCATTER places (fixed values).
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
STRIDE, MULTIPLIER, SCATTER = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 8
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def token_hashes(tokens: list[str]) -> np.ndarray:
    """FNV-1a of the tokens' bytes, all tokens in step."""
    raw = [t.encode() for t in tokens]
    order = np.argsort([-len(r) for r in raw], kind="stable")
    sizes = -np.array([len(raw[i]) for i in order], np.int64)
    data = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
    starts = np.concatenate([[0], np.cumsum(-sizes)[:-1]]) if len(raw) else np.zeros(0, np.int64)
    h = np.full(len(raw), FNV_OFFSET, np.uint64)
    for k in range(int(-sizes[0]) if len(raw) else 0):
        n = int(np.searchsorted(sizes, -k, "left"))
        h[:n] = (h[:n] ^ data[starts[:n] + k]) * np.uint64(FNV_PRIME)
    out = np.empty(len(raw), np.uint64)
    out[order] = h
    return out


def places(hashes: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of each token in a vector and their signs (tokens x SCATTER)."""
    h = hashes[:, None] ^ (np.arange(SCATTER, dtype=np.uint64) * np.uint64(STRIDE))[None, :]
    h ^= h >> np.uint64(33)
    h *= np.uint64(MULTIPLIER)
    h ^= h >> np.uint64(33)
    return (h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(32) & np.uint64(1), -1.0, 1.0)


def embed_all(texts: list[str | None], dim: int = 64) -> list[list[float]]:
    """Every lower-cased word scatters signs over its text's vector, which is then normalised; zero for no words."""
    words = [[w.lower() for w in _BLANKS.split(t or "") if w] for t in texts]
    distinct = {w: k for k, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
    v = np.zeros((len(texts), dim), np.float32)
    if distinct:
        at, sign = places(token_hashes(list(distinct)), dim)
        row = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
        own = np.fromiter((distinct[w] for ws in words for w in ws), np.int64, len(row))
        np.add.at(v, (row[:, None], at[own]), sign[own].astype(np.float32))
    norm = np.sqrt((v * v).sum(axis=1, dtype=np.float32))
    return (v / np.where(norm > 0, norm, 1)[:, None].astype(np.float32)).tolist()


def embed(text: str | None, dim: int) -> list[float]:
    return embed_all([text], dim)[0]


STUB = Embedder(embed_all, 64, "stub")


def stub_embed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = 64) -> DataFrame:
    """id and vector of each row; whole-number ids become long, others keep their type."""
    kind = df.schema[id_col].dataType
    kind = "long" if isinstance(kind, IntegralType) else kind.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.iloc[k : k + 512]
                yield pd.DataFrame({"id": part.iloc[:, 0], "vector": embed_all(part.iloc[:, 1].tolist(), dim)})

    return df.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("string")).mapInPandas(run, f"id {kind}, vector array<float>").withColumnRenamed("id", id_col)
