"""Language-model scoring with a probabilistic suffix tree over tokens.

Tokens are a document's words, A-Z lower-cased, and one end; contexts are the tokens before a token, at most `depth` of
them, a text's start counting as one. An n-gram (w1..wk) is known by a 64-bit key; it stands both for the entry "wk
after the context w1..wk-1" and for the context w1..wk.

Learning, one level of the tree at a time, each a pass over the documents to learn from:
* Tasks count the n-grams of their own texts and send them in blobs, one for each of many hash buckets; the contexts that
  hold most are dealt out by their next token as well. Buckets grow in number with the tokens, so none grows with the table.
* Entries of at least `min_count` occurrences (fewer allow no test) are joined to their context and to the same entry one
  level up. Which n-grams can have so many is known from the level before, in a bitmap of fixed size that never says no
  to one that has.
* A context stays if its next-token distribution diverges from its parent's by `min_bits`, weighted by its count. It
  gives its entries their own discounted shares, and leaves the rest of its mass to the parent's distribution of all
  other tokens. Nothing depends on shares of the corpus or on a largest size: the tree grows with the input.

Scoring: a token's probability is that of its longest kept context. In logarithms that is a sum with one term for each
n-gram of the text, so that a text's score is the sum of the values of its n-grams. The commonest words and entries are
broadcast (HOT_WORDS and HOT_GRAMS rows at most). All others meet the texts' n-grams, where a bitmap of fixed size does
not rule these out, in hash buckets again, and their sums go back to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm import _text as T
from recollect.llm._common import fold, release, save

#: Keys of the start and the end of a text.
START, END = np.uint64(0x9D5C0F3A71B8E264), np.uint64(0x3B1F6E85D2C7A940)
#: Rows broadcast for scoring, at most.
HOT_WORDS, HOT_GRAMS = 1 << 20, 1 << 21
#: Tokens counted at once in a task, tokens for each bucket, occurrences from which a context is dealt out by next token.
STEP, BUCKET, SPLIT = 1 << 20, 1 << 20, 1 << 18
#: Bits of the bitmaps, as a power of 2.
BITS = 26
#: Taken from the count of each entry of a context and left to its parent.
DISCOUNT = 0.75
U64 = np.uint64


def _under(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The key of the n-gram of a context and its next token."""
    return ((context << U64(21)) | (context >> U64(43))) ^ token


def _under_sql(context: str, token: str) -> str:
    return f"((shiftleft({context}, 21) | shiftrightunsigned({context}, 43)) ^ {token})"


class Grams:
    """The n-grams that end at each token of some documents: tokens, their documents, and by level (contexts, keys, valid)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, depth: int):
        starts, ends, at = T.word_spans(data, offsets)
        n = np.diff(at)
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        self.tokens = np.empty(len(self.doc), U64)
        last = at[1:] + np.arange(len(n))
        word = np.ones(len(self.doc), bool)
        word[last] = False
        self.tokens[word] = T.span_hashes(T.LOWER[data], starts, ends)
        self.tokens[last] = END
        index = np.arange(len(self.doc)) - np.repeat(last - n, n + 1)
        self.levels = [(np.zeros(len(self.doc), U64), self.tokens, np.ones(len(self.doc), bool))]
        for d in range(1, depth + 1):
            before = np.empty_like(self.tokens)
            before[1:] = self.levels[-1][1][:-1]
            if d == 1:
                before[index == 0] = START
            self.levels.append((before, _under(before, self.tokens), index >= d - 1))


def _arrays(rows: DataFrame) -> list[np.ndarray]:
    """The columns of a table of bounded size, on the driver."""
    return [c.to_numpy() for c in rows.toArrow().columns]


class Bitmap:
    """A set of keys, in 2**BITS bits: has() is true for each key of the set, and for few others as long as it is small."""

    def __init__(self, keys: DataFrame):
        at = f"shiftrightunsigned(key, {64 - BITS})"
        rows = keys.groupBy(F.expr(f"shiftrightunsigned({at}, 6)").alias("i")).agg(F.expr(f"bit_or(shiftleft(1L, cast({at} & 63 AS INT)))").alias("bits"))  # 2**(BITS - 6) rows at most
        i, bits = _arrays(rows)
        self.words = np.zeros(1 << (BITS - 6), U64)
        self.words[i] = bits.view(U64)

    def plus(self, keys: np.ndarray) -> Bitmap:
        out = copy(self)
        at = keys >> U64(64 - BITS)
        out.words = self.words.copy()
        np.bitwise_or.at(out.words, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
        return out

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> U64(64 - BITS)
        return (self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) > 0


BLOBS = "bucket int, context binary, runs binary, token binary, n binary"


def _blob(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Slices of an array as binaries."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * x.itemsize).astype(np.int64)), pa.py_buffer(x)]).cast(pa.binary())


def _cuts(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of sorted rows, and where their rows begin and end."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return bucket[first], np.append(first, len(bucket))


def _read(b: pa.RecordBatch, i: int, **columns) -> list[np.ndarray]:
    return [np.frombuffer(b.column(b.schema.get_field_index(k))[i].as_buffer(), t) for k, t in columns.items()]


def counted(learned: DataFrame, level: int, buckets: int, hot: tuple[np.ndarray, np.ndarray], above, min_count: int) -> DataFrame:
    """Entries (context, token, key, n) of one level with at least min_count occurrences in a column of texts.

    hot: contexts (sorted) and the number of parts in which they are dealt out. above: the broadcast Bitmap of the level
    before, or None.
    """
    sent = learned.sparkSession.sparkContext.broadcast(hot)

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        context, token = (np.concatenate(x) for x in zip(*held))
        held.clear()
        names, parts = sent.value
        mixed, own = T.mix(token), context.copy()
        at, large = _find(names, context)
        large = np.flatnonzero(large)
        own[large] += mixed[large] % parts[at[large]] * U64(0x9E3779B97F4A7C15)
        bucket = T.mix(own) % U64(buckets)
        del at, own
        # by bucket, context, token, of which some bits of a hash are enough: if others come between, equal entries go as two
        bits = (64 - buckets.bit_length()) // 2
        mixed >>= U64(64 - bits)
        mixed |= T.mix(context) >> U64(64 - bits) << U64(bits)
        mixed |= bucket << U64(2 * bits)
        order = np.argsort(mixed)
        del mixed
        context, token, bucket = context[order], token[order], bucket[order]
        other = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (context[1:] != context[:-1])])
        first = np.flatnonzero(other | np.concatenate([[True], token[1:] != token[:-1]]))
        n = np.diff(np.append(first, len(token))).astype(np.uint32)
        context, token, bucket = context[first], token[first], bucket[first]
        run = np.flatnonzero(other[first])
        runs = np.diff(np.append(run, len(token))).astype(np.uint32)
        own, cuts = _cuts(bucket)
        at = np.searchsorted(run, cuts)
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), _blob(context[run], at), _blob(runs, at), _blob(token, cuts), _blob(n, cuts)], names=["bucket", "context", "runs", "token", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            data, offsets = T.texts(b.column(0))
            for _, _, part, off in T.pieces(data, offsets):
                g = Grams(part, off, level)
                context, key, valid = g.levels[level]
                if above is not None:
                    # the context and the entry one level up must both have been kept there
                    valid = valid & above.value.has(context)
                    valid[valid] = above.value.has(g.levels[level - 1][1][valid])
                held.append((context[valid], g.tokens[valid]))
                size += len(held[-1][0])
                if size >= STEP:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for b in batches:
            for i, own in enumerate(b.column(0).to_pylist()):
                if own != bucket and held:
                    yield merged(held)
                    held = []
                bucket = own
                context, runs, token, n = _read(b, i, context=U64, runs=np.uint32, token=U64, n=np.uint32)
                held.append((np.repeat(context, runs), token, n))
        if held:
            yield merged(held)

    def merged(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        context, token, n = (np.concatenate(x) for x in zip(*held))
        key = _under(context, token)
        order = np.argsort(key)
        first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0]))
        n = np.add.reduceat(n[order].astype(np.int64), first)
        kept = n >= min_count
        rows = order[first[kept]]
        return pa.RecordBatch.from_arrays([*(pa.array(x[rows].view(np.int64)) for x in (context, token, key)), pa.array(n[kept])], names=["context", "token", "key", "n"])

    dealt = learned.mapInArrow(count, BLOBS).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(merge, "context long, token long, key long, n long")


def _step(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * 8).cast("int")


def _hot_step(rows: DataFrame, limit: int) -> int:
    """The smallest step of counts from which on there are no more than limit rows."""
    steps, at = sorted(((r["s"], r["count"]) for r in rows.groupBy(_step(F.col("n")).alias("s")).count().collect()), reverse=True), 1 << 30  # 512 rows at most
    for s, count in steps:
        limit -= count
        if limit < 0:
            break
        at = s
    return at


def _large(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of at least SPLIT occurrences (the 65536 largest), and in how many parts to deal them out. Which these are changes no count."""
    keys, n = _arrays(rows.filter(F.col("n") >= SPLIT).orderBy(F.desc("n"), "key").limit(1 << 16).select("key", "n"))
    order = np.argsort(keys.view(U64))
    return keys.view(U64)[order], (n[order] // SPLIT + 1).astype(U64)


class Tree:
    """What was learned: the tables words (key, n, value) and grams (key, n, value), the value of a text's start, train_tokens, distinct words and the value of an unknown word."""

    def __init__(self, docs: DataFrame, text_col: str, learn: Column, depth: int, min_count: int, min_bits: float):
        spark = docs.sparkSession
        learned = docs.filter(learn).select(F.col(text_col).cast("string").alias("text"))
        # every context of level 0 is the empty one (key 0), dealt out over all buckets by token
        about = learned.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        words = save(counted(learned, 0, about // (6 * BUCKET) + 1, (np.zeros(1, U64), np.array([1 << 62], U64)), None, 1), "words")
        total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.max(F.when(F.col("key") == int(END.view(np.int64)), F.col("n"))).alias("texts")).first()
        self.n, self.v, texts = total["n"] or 0, total["v"], total["texts"] or 0
        self.taken = min(max(total["n1"] / (total["n1"] + 2 * total["n2"]), 0.1), 0.9) if total["n1"] else 0.1
        self.unknown = float(np.log10(self.taken * self.v / self.n)) if self.n else 0.0
        base = words.select("key", F.lit(0).cast("long").alias("up"), "n", F.log10((F.col("n") - self.taken) / float(self.n or 1)).alias("lp"), F.lit(0.0).alias("gain"))
        start = spark.createDataFrame([(int(START.view(np.int64)), 0, texts, 0.0, 0.0)], base.schema)
        levels, backs = [base], []
        buckets = self.n // BUCKET + 1
        for d in range(1, depth + 1):
            prev = levels[-1].filter(F.col("n") >= min_count)
            prev = prev.unionByName(start.filter(F.col("n") >= min_count)) if d == 1 else prev
            above = spark.sparkContext.broadcast(Bitmap(prev))
            entries = counted(learned, d, buckets, _large(prev), above, min_count)
            level, back = self._level(entries, prev, d, min_bits)
            levels.append(level)
            backs.append(back)
        own = lambda k: levels[k].join(backs[k].select(F.col("context").alias("key"), "back"), "key", "left") if k < depth else levels[k].withColumn("back", F.lit(0.0))
        value = F.coalesce("back", F.lit(0.0))
        # a word of few occurrences is no context
        often = own(0).filter(F.col("n") >= min_count).select("key", "n", (F.col("lp") + value).alias("value"))
        self.words = save(often.unionByName(base.filter(F.col("n") < min_count).select("key", "n", F.col("lp").alias("value"))), "word-values")
        grams = [own(k).select("key", "n", (F.col("gain") + value).alias("value")).filter("value <> 0") for k in range(1, depth + 1)]
        self.grams = save(reduce(DataFrame.unionByName, grams, base.limit(0).select("key", "n", F.lit(0.0).alias("value"))), "gram-values")
        first = backs[0].filter(F.col("context") == int(START.view(np.int64))).first() if depth else None
        self.start = first["back"] if first else 0.0
        release(words, *levels[1:], *backs)

    def _level(self, entries: DataFrame, prev: DataFrame, d: int, min_bits: float) -> tuple[DataFrame, DataFrame]:
        """(key, up, n, lp, gain) of a level's entries, and (context, back) of its kept contexts. up: the key of the entry one level up."""
        entries = entries.join(prev.select(F.col("key").alias("context"), F.col("n").alias("total"), F.col("up").alias("over")), "context")
        entries = entries.withColumn("up", F.col("token") if d == 1 else F.expr(_under_sql("over", "token"))).drop("over")
        entries = save(entries.join(prev.select(F.col("key").alias("up"), F.col("lp").alias("lp_up")), "up"), "entries")
        share, above = (F.col("n") - DISCOUNT) / F.col("total"), F.pow(F.lit(10.0), "lp_up")
        contexts = entries.groupBy("context").agg(F.max("total").alias("total"), F.sum("n").alias("n"), F.sum(share).alias("own"), F.sum(above).alias("above"), F.sum(F.col("n") * F.log2(share / above)).alias("bits"))
        left = F.greatest(1 - F.col("own"), F.lit(1e-12)) / F.greatest(1 - F.col("above"), F.lit(1e-12))
        contexts = contexts.withColumn("back", F.log10(left)).filter(F.col("bits") + (F.col("total") - F.col("n")) * F.log2(left) >= min_bits)
        back = save(contexts.select("context", "back"), "contexts")
        lp = F.when(F.col("back").isNull(), F.col("lp_up")).otherwise(F.log10(share))
        gain = F.when(F.col("back").isNull(), F.lit(0.0)).otherwise(F.log10(share) - F.col("back") - F.col("lp_up"))
        level = save(entries.join(back, "context", "left").select("key", "up", "n", lp.alias("lp"), gain.alias("gain")), "level")
        release(entries)
        return level, back


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None, depth: int = 2, min_count: int = 5, min_bits: float = 16.0, hot: tuple[int, int] = (HOT_WORDS, HOT_GRAMS)) -> DataFrame:
    """Scores of all texts under the suffix tree and under a smoothed word-frequency base, both learned where learn is true.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens are a document's words, A-Z
    lower-cased, and one end. score is the tree's log10 probability of those tokens; all words never seen in learning
    are one token, as they are in the base, and over the known words, the end and that token probabilities sum to 1
    after any context. A null text is empty (one token). A null id is held out. Repeated rows are learned from and scored
    each. With nothing to learn from, train_tokens is 0, every token is the unknown one, and score is 0. Other columns are
    ignored; an empty table gives no rows. Words are known by 64-bit hashes. depth 0 gives the root alone.
    """
    learn = fold(id_col, 10) != 0 if learn is None else F.coalesce(learn, F.lit(False))
    spark = docs.sparkSession
    tree = Tree(docs, text_col, learn, depth, min_count, min_bits)
    steps = [_hot_step(t, limit) for t, limit in zip((tree.words, tree.grams), hot)]
    often = [_arrays(t.filter(_step(F.col("n")) >= s).select("key", *cols)) for t, s, cols in zip((tree.words, tree.grams), steps, (("n", "value"), ("value",)))]  # at most as many rows as hot says
    rare = [t.filter(_step(F.col("n")) < s) for t, s in zip((tree.words, tree.grams), steps)]
    words, grams = ([x[order] for x in (t[0].view(U64), *t[1:])] for t in often for order in [np.argsort(t[0].view(U64))])
    del often
    rare_gram = Bitmap(rare[1].select("key"))
    known = spark.sparkContext.broadcast((words, grams, rare_gram.plus(grams[0]), rare_gram))
    buckets, under = tree.n // (4 * BUCKET) + 1, tree.n + 0.1 * (tree.v + 1)
    given = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), (~learn).alias("held_out"))
    values = rare[0].select("key", "n", "value").unionByName(rare[1].select("key", F.lit(0).cast("long").alias("n"), "value"))
    met = _values(values, buckets).unionByName(_lookups(given, known, depth, tree.start, under, buckets), allowMissingColumns=True)
    met = met.repartition("bucket").sortWithinPartitions("bucket", "side").mapInArrow(_sums(tree.unknown, under), CHUNKS)
    out = met.repartition("chunk").sortWithinPartitions("chunk", "side").mapInArrow(_texts, TEXTS)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.n).cast("long").alias("train_tokens"), "base_score", "score")


#: Rare values (side 0), the rows of a chunk of texts (1) and its n-grams to look up (2), by bucket; docs counts from 0 in the chunk.
VALUES = "bucket int, side byte, key binary, n binary, value binary"
LOOKUPS = "bucket int, side byte, chunk long, key binary, docs binary, words int, ids array<long>, out array<boolean>, tokens binary, known binary, base binary, value binary"
CHUNKS = "chunk long, side byte, docs binary, ids array<long>, out array<boolean>, tokens binary, known binary, base binary, value binary"
TEXTS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _values(rows: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n, value = (c.to_numpy() for c in b.columns)
            bucket = T.mix(key.view(U64)) % U64(buckets)
            order = np.argsort(bucket)
            own, cuts = _cuts(bucket[order])
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.zeros(len(own), np.int8)), *(_blob(x[order], cuts) for x in (key, n, value))], names=["bucket", "side", "key", "n", "value"])

    return rows.mapInArrow(run, VALUES)


def _lookups(given: DataFrame, known, depth: int, start: float, under: float, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (word_keys, word_n, word_value), (gram_keys, gram_value), any_gram, rare_gram = known.value
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            data, offsets = T.texts(b.column(1))
            for i, j, part, off in T.pieces(data, offsets):
                g, m, chunk = Grams(part, off, depth), j - i, chunk + 1
                at, hit = _find(word_keys, g.tokens)
                near, n = g.doc[hit], word_n[at[hit]]
                value = np.zeros(len(g.doc))  # by token first: terms of a token and the next cancel out
                value[hit] = word_value[at[hit]]
                keys, docs = [g.tokens[~hit]], [g.doc[~hit]]
                for _, key, valid in g.levels[1:]:
                    on = np.flatnonzero(valid)
                    on = on[any_gram.has(key[on])]
                    at, hit = _find(gram_keys, key[on])
                    value[on[hit]] += gram_value[at[hit]]
                    on = on[~hit]
                    on = on[rare_gram.has(key[on])]
                    keys.append(key[on])
                    docs.append(g.doc[on])
                words, keys, docs = len(keys[0]), np.concatenate(keys), np.concatenate(docs).astype(np.uint32)
                bucket = T.mix(keys) % U64(buckets)
                order = np.argsort(bucket, kind="stable")  # words stay first
                own, cuts = _cuts(bucket[order])
                first = np.bincount(np.searchsorted(own, bucket[:words]), minlength=len(own))
                none = lambda t, k=len(own): pa.nulls(k, t)
                sums = [np.bincount(g.doc, minlength=m), np.bincount(near, minlength=m), np.bincount(near, np.log10((n + 0.1) / under), minlength=m), np.bincount(g.doc, value, minlength=m) + start]
                whole = lambda x: pa.concat_arrays([pa.array([x.tobytes()], pa.binary()), none(pa.binary())])
                lists = lambda c, t: pa.concat_arrays([pa.array([c.slice(i, m).to_pylist()], pa.list_(t)), none(pa.list_(t))])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(chunk % buckets, own.astype(np.int64)).astype(np.int32)),
                        pa.array(np.append(1, np.full(len(own), 2)).astype(np.int8)),
                        pa.array(np.full(len(own) + 1, chunk)),
                        *(pa.concat_arrays([pa.nulls(1, pa.binary()), _blob(x[order], cuts)]) for x in (keys, docs)),
                        pa.array(np.append(0, first).astype(np.int32)),
                        lists(b.column(0), pa.int64()),
                        lists(b.column(2), pa.bool_()),
                        *(whole(x.astype(t)) for x, t in zip(sums, (np.int64, np.int64, float, float))),
                    ],
                    names=[c.split(" ")[0] for c in LOOKUPS.split(", ")],
                )

    return given.mapInArrow(run, LOOKUPS)


def _sums(unknown: float, under: float):
    """Bucket by bucket, its rare values first: for each chunk the sums of its documents over the n-grams in this bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, table = None, [], None
        for b in batches:
            names, rows = b.schema.names, []
            for i, (own, side, chunk, words) in enumerate(zip(*(b.column(names.index(k)).to_pylist() for k in ("bucket", "side", "chunk", "words")))):
                if own != bucket:
                    bucket, held, table = own, [], None
                if side == 0:
                    held.append(_read(b, i, key=U64, n=np.int64, value=float))
                    continue
                if side == 1:
                    rows.append({k: b.column(names.index(k))[i].as_py() for k in ("chunk", "side", "ids", "out", "tokens", "known", "base", "value")})
                    continue
                if table is None:
                    table = [np.concatenate(x) for x in zip(*held)] if held else [np.empty(0, U64), np.empty(0, np.int64), np.empty(0)]
                    order = np.argsort(table[0])
                    table, held = [x[order] for x in table], []
                key, docs = _read(b, i, key=U64, docs=np.uint32)
                at, hit = _find(table[0], key)
                n, value = np.zeros(len(key), np.int64), np.zeros(len(key))
                value[:words] = unknown
                n[hit], value[hit] = table[1][at[hit]], table[2][at[hit]]
                own_docs, of = np.unique(docs, return_inverse=True)
                known, base = np.bincount(of[:words], n[:words] > 0, len(own_docs)), np.bincount(of[:words], np.log10((n[:words] + 0.1) / under), len(own_docs))
                rows.append({"chunk": chunk, "side": 2, "docs": own_docs.tobytes(), "known": known.astype(np.int64).tobytes(), "base": base.tobytes(), "value": np.bincount(of, value, len(own_docs)).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, _CHUNKS)

    return run


_CHUNKS = pa.schema([("chunk", pa.int64()), ("side", pa.int8()), ("docs", pa.binary()), ("ids", pa.list_(pa.int64())), ("out", pa.list_(pa.bool_())), *((k, pa.binary()) for k in ("tokens", "known", "base", "value"))])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each chunk's documents, added up."""
    held = None

    def done() -> pa.RecordBatch:
        ids, out, tokens, known, base, value = held
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), *map(pa.array, (tokens, known, base, value))], names=[c.split(" ")[0] for c in TEXTS.split(", ")])

    for b in batches:
        for i, side in enumerate(b.column(1).to_pylist()):
            known, base, value = _read(b, i, known=np.int64, base=float, value=float)
            if side == 1:
                if held:
                    yield done()
                held = [b.column(3)[i].as_py(), b.column(4)[i].as_py(), _read(b, i, tokens=np.int64)[0], known.copy(), base.copy(), value.copy()]
                continue
            docs = _read(b, i, docs=np.uint32)[0]
            for total, part in zip(held[3:], (known, base, value)):
                total[docs] += part
    if held:
        yield done()


def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether the values are there."""
    if not len(where):
        return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
    at = np.minimum(np.searchsorted(where, what), len(where) - 1)
    return at, where[at] == what
