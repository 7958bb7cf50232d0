"""MinHash near-duplicates of documents with odd sketches, links confirmed on full sets of word shingles.

Each distinct shingle set gives 128 MinHash samples in 32 bands of 4. Sets that share a band are candidates. Comparison
goes in rounds, each over what the links so far leave unconnected. At first every member of a band's bucket is confirmed
against its smallest. The members of buckets that still hold several groups get odd sketches: 2048 MinHash samples
folded into a bitmap of 8192 parities, so that the population count of two sketches' XOR gives their similarity within
about 0.011. Each is compared with the most similar others of other groups, ever more of them, at last with all;
pairs that the sketches don't rule out are confirmed on the full sets.
A pair is taken in the first band that its sets share, from the side of the larger group id, and so only once.
So a group of n near copies costs about n confirmations, while no pair stays untested that could still connect groups.
At 75 % similarity a pair shares no band with probability below 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import _text as T
from recollect.llm._common import save
from recollect.llm.components import connected_components

BANDS, ROWS = 32, 4
#: Samples and bits of an odd sketch.
SAMPLES, BITS = 2048, 8192
#: Sketch estimates further than this below the threshold are ruled out: four and a half deviations of the estimate.
MARGIN = 0.051
#: Members of a bucket compared in one task at once.
CHUNK = 1024
#: Most similar partners tried for each member in the rounds after the first; None: all of them.
TRIED = (4, None)

_A = T.mix(np.arange(1, SAMPLES + 1, dtype=T.U64) * T.U64(0x9E3779B97F4A7C15)) | T.U64(1)
_B = T.mix(np.arange(1, SAMPLES + 1, dtype=T.U64) * T.U64(0xC2B2AE3D27D4EB4F))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document and where each document's begin."""
    low = T.LOWER[data]
    starts, ends, bounds = T.word_spans(data, offsets)
    sh, at = T.windows(T.span_hashes(low, starts, ends), bounds, words)
    sets = [np.unique(sh[a:b]) for a, b in zip(at[:-1], at[1:])]
    return (np.concatenate(sets) if sets else np.empty(0, T.U64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def samples(shingles: np.ndarray, bounds: np.ndarray, many: int) -> np.ndarray:
    """The first MinHash samples (documents x many) of non-empty sets."""
    out = np.empty((len(bounds) - 1, many), T.U64)
    for k in range(many):
        out[:, k] = np.minimum.reduceat(shingles * _A[k] + _B[k], bounds[:-1])
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    keys = np.empty((len(mins), BANDS), T.U64)
    for b in range(BANDS):
        x = np.full(len(mins), b + 1, T.U64)
        for r in range(ROWS):
            x = T.mix(x * T.U64(0xA24BAED4963EE407) + mins[:, b * ROWS + r])
        keys[:, b] = x
    return keys


def odd_sketch(mins: np.ndarray) -> np.ndarray:
    """Parity bitmaps (documents x BITS / 8 bytes) of the samples: every sample flips one bit."""
    bits = np.zeros((len(mins), BITS), np.uint8)
    rows = np.arange(len(mins))
    for k in range(SAMPLES):
        bits[rows, (T.mix(mins[:, k] + _B[k]) % T.U64(BITS)).astype(np.int64)] ^= 1
    return np.packbits(bits, axis=1)


def similarity(xor_bits: np.ndarray) -> np.ndarray:
    """Jaccard similarity estimated from the population count of two sketches' XOR."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * xor_bits / BITS, 1e-9))


def farthest(percent: int) -> int:
    """The largest XOR count at which a similarity of percent is still plausible."""
    return int(np.flatnonzero(similarity(np.arange(BITS + 1)) >= percent / 100 - MARGIN)[-1])


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, n_shingles, fp (128-bit fingerprint of the set), bands (array of long). Empty sets: nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.texts(b.column(1))
            for i, j, part, off in T.pieces(data, offsets):
                sh, at = shingle_sets(part, off, words)
                n = np.diff(at)
                some = n > 0
                begin = at[:-1][some]
                full = np.concatenate([begin, at[-1:]])
                if some.any():
                    mins = samples(sh, full, BANDS * ROWS)
                    fp = fingerprints(sh, begin)
                    keys = band_keys(mins).view(np.int64)
                rank = np.cumsum(some) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i),
                        pa.array(n, pa.int64()),
                        pa.array([fp[r].tobytes() if s else None for s, r in zip(some, rank)], pa.binary()),
                        pa.array([keys[r] if s else None for s, r in zip(some, rank)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "fp", "bands"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_shingles long, fp binary, bands array<long>")


def fingerprints(sh: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """128 bits of each non-empty set."""
    return np.stack([np.add.reduceat(T.mix(sh), begin), np.add.reduceat(T.mix(sh ^ _A[0]), begin)], axis=1)


def full_sets(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """fp, shingles (binary: sorted 64-bit hashes) of each row with a non-empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.texts(b.column(0))
            for _, _, part, off in T.pieces(data, offsets):
                sh, at = shingle_sets(part, off, words)
                some = np.flatnonzero(np.diff(at))
                if len(some):
                    fp = [x.tobytes() for x in fingerprints(sh, at[some])]
                    yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), pa.array([sh[at[k] : at[k + 1]].tobytes() for k in some], pa.binary())], names=["fp", "shingles"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "fp binary, shingles binary")


def odd_sketches(sets: DataFrame) -> DataFrame:
    """node, sketch of a table of full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                each = [np.frombuffer(x.as_buffer(), T.U64) for x in part.column(1)]
                mins = samples(np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]), SAMPLES)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in odd_sketch(mins)], pa.binary())], names=["node", "sketch"])

    return sets.select("doc_id", "shingles").mapInArrow(run, "node long, sketch binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), T.U64), np.frombuffer(y.as_buffer(), T.U64)
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    first, second = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _chunked(members: DataFrame) -> DataFrame:
    """Members of buckets (bucket, node, comp, band, bands, sketch) dealt to pairs of chunks (bucket, i, j): every two members meet in one."""
    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n")).filter("n > 1")
    dealt = members.join(sizes, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    return dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("bucket", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "node", "comp", "band", "bands", "sketch")


def _plausible(tried: int | None, most: int):
    def pairs(node: np.ndarray, comp: np.ndarray, c: np.ndarray, band: int, keys: np.ndarray, sketch: np.ndarray, cross: bool) -> tuple[list, list]:
        out_a, out_b = [], []
        parts = [(np.flatnonzero(c == c.min()), np.flatnonzero(c != c.min()))] if cross else [(np.arange(len(node)),) * 2]
        for left, right in [*parts, *(p[::-1] for p in parts if cross)]:
            if not len(left) or not len(right):  # all rows of this group of chunks come from one of them
                continue
            left = left[comp[left] > comp[right].min()]
            for s in range(0, len(left), 16):
                rows = left[s : s + 16]
                far = np.bitwise_count(sketch[rows][:, None, :] ^ sketch[right][None, :, :]).sum(axis=2, dtype=np.int32)
                x, y = np.nonzero((far <= most) & (comp[rows][:, None] > comp[right][None, :]))
                first = ~(keys[rows[x], :band] == keys[right[y], :band]).any(axis=1)
                x, y = x[first], y[first]
                if tried is not None and len(x):
                    order = np.lexsort((far[x, y], x))
                    x, y = x[order], y[order]
                    near = np.arange(len(x)) - np.searchsorted(x, x) < tried
                    x, y = x[near], y[near]
                out_a.append(node[rows[x]]), out_b.append(node[right[y]])
        return out_a, out_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in _with_end(batches):
            if b is not None:
                rest = b if rest is None else pa.concat_batches([rest, b])
            if rest is None or not rest.num_rows:
                continue
            key = np.stack([rest.column(k).to_numpy().astype(np.int64) for k in range(3)])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            ends = [*cuts.tolist(), *([rest.num_rows] if b is None else [])]
            node, comp, c = (rest.column(k).to_numpy() for k in (4, 5, 3))
            band, keys = rest.column(6).to_numpy(), rest.column(7).flatten().to_numpy().reshape(rest.num_rows, -1)
            sketch = np.frombuffer(b"".join(rest.column(8).to_pylist()), T.U64).reshape(rest.num_rows, -1)
            a_all, b_all, begin = [], [], 0
            for end in ends:
                if end - begin > 1 and (comp[begin:end] != comp[begin]).any():
                    x, y = pairs(node[begin:end], comp[begin:end], c[begin:end], int(band[begin]), keys[begin:end], sketch[begin:end], key[1, begin] != key[2, begin])
                    a_all += x
                    b_all += y
                begin = end
            rest = rest.slice(begin)
            if a_all:
                x, y = np.concatenate(a_all), np.concatenate(b_all)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """Class of each document among near-duplicates: doc_id, n_shingles, component_id, kept.

    Links join documents whose sets of lower-cased (A-Z) word shingles have 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable; kept marks it. A document of fewer words has one shingle, its whole
    sequence; one without text or words has no shingle and links with nothing. Repeated rows are returned each; rows
    with a null id are returned in a class of their own (null). Where an id repeats with other texts, each row is linked by
    its own text, whatever the order of rows. Equal sets count as one until the end, so exact copies
    add no comparisons. Other columns are ignored; an empty table gives no rows.
    """
    sig = save(signatures(docs, id_col, text_col, words).withColumn("row", F.monotonically_increasing_id()), "signatures")
    some = sig.filter("fp is not null and doc_id is not null")
    classes = some.groupBy("fp").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc"), F.first("bands").alias("bands"))
    classes = save(classes, "classes")  # a class is known by a row of its own, as ids may repeat
    banded = classes.select("node", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "band", "node")
    smallest = banded.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = save(banded.join(smallest, "bucket"), "members")
    pairs = save(members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    meeting = save(members.select("node").distinct(), "meeting")
    need = classes.join(meeting, "node", "left_semi").select("fp", "node", "doc")
    held = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("t")).join(need.select("doc").distinct(), "doc", "left_semi")
    sets = full_sets(held, "t", words).dropDuplicates(["fp"]).join(need.select("fp", F.col("node").alias("doc_id")), "fp").drop("fp")
    sets = save(sets, "sets")
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("h"), F.min("band").alias("band")).groupBy("n", "h").agg(F.min_by("bucket", "band").alias("bucket"))  # of buckets of the same members, the first band's
    members = save(members.join(buckets.select("bucket"), "bucket", "left_semi").select("bucket", "band", "node"), "members")
    links, labels, seen, sketches = save(confirm(pairs, sets, percent), "links"), None, pairs, None
    for turn in (0, *TRIED):
        if turn != 0:
            open_ = members.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
            mixed = open_.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
            open_ = save(open_.join(mixed, "bucket", "left_semi").select("bucket", "band", "node", "comp"), "open")
            if sketches is None:  # later rounds have no other members
                sketches = save(odd_sketches(sets.join(open_.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")), "sketches")
            dealt = _chunked(open_.join(sketches, "node").join(classes.select("node", "bands"), "node"))
            dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
            pairs = save(dealt.mapInArrow(_plausible(turn, farthest(percent)), "a long, b long").distinct().join(seen, ["a", "b"], "left_anti"), "pairs")
            if pairs.isEmpty():
                if turn is None:
                    break
                continue
            seen = seen.unionByName(pairs)
            more = save(confirm(pairs, sets, percent), "links")
            links = links.unionByName(more)
        labels = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select("node", "component")
    named = classes.select("fp", "node", "doc").join(labels, "node", "left").withColumn("top", F.coalesce("component", "node"))
    least = named.groupBy("top").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "top").select("fp", "component_id")
    out = sig.select("doc_id", "n_shingles", "fp").join(named, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
