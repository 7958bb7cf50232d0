"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into chunks of CHUNK bytes that overlap by the filter width, so that every byte window of the
whole text is seen. Learned filters slide over each chunk, the largest response of each filter in a chunk is taken,
a learned part of the chunk's size is added (a short text has fewer windows to choose from), and a small dense layer
turns the responses into a logit; the mean of the chunks' logits, weighted by the
windows of each, gives one probability. Filters are tables (position, byte) -> response, so a response is a sum of
WIDTH lookups. The network is fitted on a bounded sample of labelled documents (sample_rows), on
whole texts and on random parts of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm import _text as T
from recollect.llm._common import bounded_sample, fold, numbered

WIDTH, FILTERS, CHUNK = 4, 12, 256


@dataclass
class Network:
    table: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    weight: np.ndarray  # FILTERS
    offset: float
    slope: np.ndarray  # FILTERS

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One logit for each document; an empty one gets the offset alone."""
        pooled, _, doc, share, size = pool(self.table, *filled(data, offsets))
        hidden = np.maximum(pooled + self.bias + size[:, None] * self.slope, 0)
        return np.bincount(doc, share * (hidden @ self.weight), minlength=len(offsets) - 1) + self.offset


def filled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with those of fewer than WIDTH bytes filled up with zeros, so that none sees its neighbour."""
    n = np.diff(offsets)
    short = (n > 0) & (n < WIDTH)
    if not short.any():
        return data, offsets
    ends = np.concatenate([[0], np.cumsum(np.where(short, WIDTH, n))])
    out = np.zeros(ends[-1], np.uint8)
    out[np.arange(len(data)) + np.repeat(ends[:-1] - offsets[:-1], n)] = data
    return out, ends


def chunks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where chunks of windows begin, how many windows each has, and the document of each. Texts are filled(): none has fewer than WIDTH bytes."""
    n = np.diff(offsets)
    windows = np.where(n > 0, np.maximum(n - WIDTH + 1, 1), 0)
    count = -(-windows // CHUNK)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[:-1][doc] + k * CHUNK, np.minimum(windows[doc] - k * CHUNK, CHUNK), doc


def pool(table: np.ndarray, data: np.ndarray, offsets: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]:
    """Largest responses (chunks x FILTERS), their positions if asked for, each chunk's document, its share of it, and its size (0: full, to -1)."""
    begin, size, doc = chunks(offsets)
    if not len(begin):
        return np.zeros((0, FILTERS)), np.zeros((0, FILTERS), np.int64), doc, np.zeros(0), np.zeros(0)
    padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    total = np.bincount(doc, size, minlength=len(offsets) - 1)
    pooled, at = np.empty((len(begin), FILTERS), np.float32), np.empty((len(begin), FILTERS), np.int64) if where else None
    for lo in range(0, len(begin), 512):
        rows = slice(lo, lo + 512)
        first, last = begin[rows][0], begin[rows][-1] + size[rows][-1]
        response = table[0][padded[first:last]]
        for j in range(1, WIDTH):
            response += table[j][padded[first + j : last + j]]
        ends = np.stack([begin[rows] - first, begin[rows] - first + size[rows]], axis=1).ravel()
        cuts = ends[:-1] if ends[-1] >= len(response) else ends
        pooled[rows] = np.maximum.reduceat(response, cuts, axis=0)[::2]
        if where:
            for i, (b, s) in enumerate(zip(begin[rows], size[rows])):
                at[lo + i] = response[b - first : b - first + s].argmax(axis=0) + b
    return pooled, at, doc, size / total[doc], np.log2(size) / np.log2(CHUNK) - 1


def part(text: bytes, rng: np.random.Generator) -> bytes:
    """The text, or, two times in five, some words in a row of it."""
    if len(text) < 8 or rng.random() > 0.4:
        return text
    words = text.split(b" ")
    many = int(np.exp(rng.uniform(0, np.log(len(words) + 1)))) if len(words) > 1 else 1
    first = int(rng.integers(0, len(words) - many + 1)) if many < len(words) else 0
    return b" ".join(words[first : first + many]) or text


def fit(rows: list[tuple[bytes, int]], epochs: int = 8, batch: int = 32, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on the log loss, both labels weighing the same. With one label only, the network answers with its share."""
    rng = np.random.default_rng(seed)
    net = Network((rng.normal(size=(WIDTH, 256, FILTERS)) * 0.3).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(size=FILTERS).astype(np.float32) * 0.5, 0.0, np.zeros(FILTERS, np.float32))
    labels = np.array([y for _, y in rows])
    ones = labels.sum()
    if not 0 < ones < len(labels):
        net.weight[:] = 0
        net.offset = 0.0 if not len(labels) else (4.0 if ones else -4.0)
        return net
    weigh = np.where(labels == 1, 0.5 / ones, 0.5 / (len(labels) - ones)) * len(labels)
    params = [net.table, net.bias, net.weight, np.zeros(1, np.float32), net.slope]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            texts = [part(rows[i][0], rng) for i in pick]
            data = np.frombuffer(b"".join(texts), np.uint8)
            data, offsets = filled(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
            pooled, at, doc, share, size = pool(net.table, data, offsets, where=True)
            hidden = np.maximum(pooled + net.bias + size[:, None] * net.slope, 0)
            z = np.bincount(doc, share * (hidden @ net.weight), minlength=len(pick)) + params[3][0]
            slope = (1 / (1 + np.exp(-z)) - labels[pick]) * weigh[pick] / len(pick)
            back = (slope[doc] * share)[:, None] * net.weight * (hidden > 0)
            grads = [np.zeros_like(net.table), back.sum(axis=0), (hidden * (slope[doc] * share)[:, None]).sum(axis=0), np.array([slope.sum()]), (back * size[:, None]).sum(axis=0)]
            padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
            for j in range(WIDTH):
                np.add.at(grads[0][j], (padded[at + j], np.arange(FILTERS)[None, :]), back)
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.offset = float(params[3][0])
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: Column | None = None, sample_rows: int = 2000, sample_bytes: int = 64 << 20) -> Network:
    """Fit on at most sample_rows labelled documents of at most sample_bytes in all, half of each label where there are enough, picked by a hash of the id.

    Of rows that repeat an id the least text counts. Rows with a null id, text or label, and those that learn leaves out, are not used.
    """
    learn = fold(id_col, 5) != 0 if learn is None else learn
    draw = F.xxhash64(F.col(id_col), F.lit(11))
    marks = labels.filter(learn).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), draw.alias("draw")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1)).distinct()
    picked = None
    for y in (0, 1):  # each a top-k of sample_rows / 2
        some = marks.filter(F.col("y") == y).orderBy("draw", "id").limit(sample_rows // 2)
        picked = some if picked is None else picked.unionByName(some)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).filter("t is not null").join(F.broadcast(picked), "id")
    rows = bounded_sample(found.groupBy("id", "y", "draw").agg(F.min("t").alias("t")), sample_bytes)
    return fit([(r["t"].encode(), r["y"]) for r in rows])


def score(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) to docs, in place of a column of that name; all other columns stay.

    A null or empty text gets the network's base rate. Repeated rows are scored each; an empty table gives no rows.
    """
    kept = [f for f in docs.schema if f.name != "score"]
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.texts(b.column(b.num_columns - 1))
            z = [sent.value.logits(part, off) for _, _, part, off in T.pieces(data, offsets)]
            s = 1 / (1 + np.exp(-np.clip(np.concatenate(z) if z else np.zeros(0), -60, 60)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=[*(f.name for f in kept), "score"])

    given = docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text_col}`").cast("string"))
    return numbered(given).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"]))
