"""BM25 over folded tokens. Corpus statistics are the tenant's, filters apply before the limit.

Texts that are searched often are indexed once, in segments: documents that come later make a segment of their own,
removed ones are listed as dead, statistics are added up over segments, and segments of like size are merged. A query
reads the row groups of its terms only; what it needs of a shard of documents meets in one task, which skips blocks of
postings that can't reach the k best. Without an index, one query reads the text column once for statistics and once
for scores and moves no text.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions.shared import release, save
from recollect.functions.text import tokens

K1, B = 1.2, 0.75


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def query_terms(spark_text: str, df: DataFrame) -> list[str]:
    """Distinct folded terms of a query, in order."""
    row = df.sparkSession.range(1).select(tokens(F.lit(spark_text)).alias("t")).first()
    return list(dict.fromkeys(row["t"]))


def bm25(docs: DataFrame, query: str, k: int, id_col: str = "chunk_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """chunk_id and score (6 decimals) of the k best rows of a tenant that keep holds for, ties to the smaller id.

    A blank query gives no rows; rows without a query term are left out; null texts have no terms.
    """
    terms = query_terms(query, docs)
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    toks = F.col("_t")
    held = docs.withColumn("_t", tokens(F.col(text_col))).withColumn("_dl", F.size("_t"))
    counts = [(F.size(toks) - F.size(F.array_remove(toks, t))).alias(f"_tf{i}") for i, t in enumerate(terms)]
    held = held.select(id_col, (keep if keep is not None else F.lit(True)).alias("_keep"), "_dl", *counts)
    stats = held.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avgdl"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))))
    score = sum((idf(F.col("_n"), F.col(f"_df{i}")) * term_weight(F.col(f"_tf{i}"), F.col("_dl"), F.col("_avgdl")) for i in range(len(terms))), F.lit(0.0))
    any_term = F.greatest(*(F.col(f"_tf{i}") for i in range(len(terms))), F.lit(0)) > 0
    return held.filter("_keep").filter(any_term).join(F.broadcast(stats)).select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def postings(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text", *carry: str) -> DataFrame:
    """chunk_id, term, tf, dl and the columns to carry: the inverted table."""
    each = docs.select(id_col, *carry, tokens(F.col(text_col)).alias("_t")).select(id_col, *carry, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    return each.groupBy(id_col, *carry, "term", "dl").agg(F.count("*").alias("tf"))


#: Documents of a shard, postings of a block, (query, term) pairs that are sent to all shards at once, segments of a size merged at once.
SHARD, BLOCK, PAIRS, FAN = 8192, 1024, 200_000, 4
#: A tenant of so many documents is one shard, and each of its terms one block.
SMALL = 1024
#: Terms that a filter names one by one.
FEW = 64
#: Room for sums of doubles in another order, and for scores that are equal once rounded.
SLACK = 2e-6
PLACE = ["segment", "tenant_id", "shard"]


@dataclass
class Index:
    """An inverted index in segments, each with a part of the documents, and the documents that are gone from them.

    A segment's documents are dealt to shards and numbered in a shard by id. Its tables: docs (segment, tenant_id, shard, ord, chunk_id, dl, mark and
    what filters need), postings (a row for each block of a term's postings in a shard, largest impact first, with the
    block's largest tf and smallest dl, which bound its weights), terms (df) and stats (n, total of dl, by tenant).
    dead: folders with the rows of docs that no longer count.
    """

    spark: SparkSession
    segments: list[str]
    dead: list[str] = field(default_factory=list)
    tenant: str | None = None
    #: Sums by tenant, as no table of an index ever changes.
    known: dict = field(default_factory=dict, compare=False)

    def of(self, tenant: str | None) -> "Index":
        """The part of one tenant; None: all."""
        return replace(self, tenant=tenant)

    def table(self, name: str) -> DataFrame:
        out = self.spark.read.parquet(*(f"{s}/{name}" for s in self.segments))
        return out if self.tenant is None else out.filter(F.col("tenant_id") == self.tenant)

    def gone(self) -> DataFrame | None:
        """segment, tenant_id, shard, ord, dl of the dead."""
        if not self.dead:
            return None
        out = self.spark.read.parquet(*self.dead).select(*PLACE, "ord", "dl").distinct()
        return out if self.tenant is None else out.filter(F.col("tenant_id") == self.tenant)

    def alive(self, df: DataFrame) -> DataFrame:
        gone = self.gone()
        if gone is None:
            return df
        gone = gone.select(*(F.col(c).alias(f"_{c}") for c in (*PLACE, "ord")))
        return df.join(gone, (F.col("segment") == F.col("_segment")) & F.col("tenant_id").eqNullSafe(F.col("_tenant_id")) & (F.col("shard") == F.col("_shard")) & (F.col("ord") == F.col("_ord")), "left_anti")

    @property
    def lengths(self) -> DataFrame:
        """tenant_id, chunk_id, dl of what counts."""
        return self.alive(self.table("docs")).select("tenant_id", "chunk_id", "dl")

    def totals(self) -> tuple[int, int]:
        """Documents and tokens."""
        if self.tenant in self.known:
            return self.known[self.tenant]
        sums = lambda df, n, total: df.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.sum(total), F.lit(0))).first()
        n, total = sums(self.table("stats"), "n", "total")
        gone = self.gone()
        if gone is not None:
            less, fewer = sums(gone, F.lit(1), "dl")
            n, total = n - less, total - fewer
        self.known[self.tenant] = n, total
        return n, total

    def held(self, name: str, terms: list[str]) -> DataFrame:
        """Rows of these terms: a few prune row groups, many (at most PAIRS) are sent to all tasks."""
        if len(terms) <= FEW:
            return self.table(name).filter(F.col("term").isin(terms))
        return self.table(name).join(F.broadcast(self.spark.createDataFrame([(t,) for t in terms], "term string")), "term", "left_semi")

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """In how many documents each term is; terms in none are left out."""
        found = {r["term"]: r["df"] for r in self.held("terms", terms).groupBy("term").agg(F.sum("df").alias("df")).collect()}
        gone = self.gone()
        if gone is not None and found:
            each = self.held("postings", terms).select(*PLACE, "term", F.explode("ords").alias("ord"))
            lost = each.alias("p").join(gone.alias("g"), (F.col("p.segment") == F.col("g.segment")) & F.col("p.tenant_id").eqNullSafe(F.col("g.tenant_id")) & (F.col("p.shard") == F.col("g.shard")) & (F.col("p.ord") == F.col("g.ord")))
            for r in lost.groupBy("term").count().collect():
                found[r["term"]] -= r["count"]
        return {t: n for t, n in found.items() if n > 0}


def write_index(docs: DataFrame, path: str, carry: tuple[str, ...] = (), id_col: str = "chunk_id", text_col: str = "text", tenant_col: str = "tenant_id") -> Index:
    """An index of one segment under path. carry: columns that searches filter by."""
    return Index(docs.sparkSession, [write_segment(docs, f"{path}/{uuid.uuid4().hex}", carry, id_col, text_col, tenant_col)])


def write_segment(docs: DataFrame, path: str, carry: tuple[str, ...] = (), id_col: str = "chunk_id", text_col: str = "text", tenant_col: str = "tenant_id") -> str:
    """Tokenise docs once and write them as a segment. Returns path."""
    rows = docs.select(F.col(id_col).alias("chunk_id"), F.col(tenant_col).alias("tenant_id"), *carry, tokens(F.col(text_col)).alias("t"), F.xxhash64(text_col).alias("mark"))
    held = save(rows.withColumn("dl", F.size("t")), "tokens")
    placed = _placed(held, ["chunk_id"])
    each = placed.select("tenant_id", "shard", "ord", "dl", "avgdl", F.explode("t").alias("term")).groupBy("tenant_id", "shard", "ord", "dl", "avgdl", "term").agg(F.count("*").cast("int").alias("tf"))
    _write(path, placed.drop("t", "avgdl"), each)
    release(held)
    return path


def merge_segments(index: Index, segments: list[str], path: str) -> str:
    """Some segments of an index as one, without the dead; nothing is tokenised. Returns path."""
    part = replace(index, segments=segments, known={})
    rows = part.alive(part.table("docs")).withColumnsRenamed({"segment": "was", "shard": "was_shard", "ord": "was_ord"})
    placed = save(_placed(rows, ["chunk_id", "was", "was_shard", "was_ord"]), "placed")
    to = placed.select(F.col("was").alias("segment"), F.col("was_shard").alias("old"), F.col("was_ord").alias("ord"), F.col("tenant_id").alias("owner"), "shard", F.col("ord").alias("new"), "avgdl")
    each = part.table("postings").select("segment", "tenant_id", F.col("shard").alias("old"), "term", F.inline(F.arrays_zip("ords", "tfs", "dls"))).withColumnRenamed("ords", "ord")
    each = each.join(to, ["segment", "old", "ord"]).filter(F.col("tenant_id").eqNullSafe(F.col("owner")))
    _write(path, placed.drop("was", "was_shard", "was_ord", "avgdl"), each.select("tenant_id", "shard", F.col("new").alias("ord"), F.col("dls").alias("dl"), "avgdl", "term", F.col("tfs").alias("tf")))
    release(placed)
    return path


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds shard, ord (numbers in a shard, by id) and avgdl of the tenant. Small tables are dealt to several shards too.

    Rows learn their tenant's shards where they lie, so that a tenant's texts never meet: only tenants of over SMALL rows are
    sent to all tasks (at most a SMALL-th of the rows). The others are one shard whose terms are single blocks, so their avgdl orders nothing.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    sizes = rows.groupBy(F.col("tenant_id").alias("owner")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).filter(F.col("n") > SMALL)
    sizes = sizes.select("owner", "avgdl", F.ceil(F.col("n") / F.least(F.lit(SHARD), F.greatest(F.lit(SMALL), F.col("n") / cores))).alias("shards"))
    dealt = rows.join(F.broadcast(sizes), F.col("tenant_id").eqNullSafe(F.col("owner")), "left").drop("owner")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.coalesce("shards", F.lit(1))).cast("int")).drop("shards").withColumn("avgdl", F.coalesce("avgdl", F.lit(1.0)))
    parts = 2 * math.ceil(rows.count() / SHARD)  # so that a task holds few shards, however many there are
    if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        dealt = dealt.repartition(parts, "tenant_id", "shard")
    return dealt.withColumn("ord", (F.row_number().over(Window.partitionBy("tenant_id", "shard").orderBy(*order)) - 1).cast("int"))


def _write(path: str, docs: DataFrame, each: DataFrame) -> None:
    """Tables of a segment. each: tenant_id, shard, ord, dl, avgdl, term, tf."""
    name = F.lit(path.rstrip("/").rsplit("/", 1)[-1])
    impact = Window.partitionBy("tenant_id", "shard", "term").orderBy(F.desc(term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"))), "ord")
    blocks = each.withColumn("block", ((F.row_number().over(impact) - 1) / BLOCK).cast("int"))
    blocks = blocks.groupBy("tenant_id", "shard", "term", "block").agg(F.collect_list(F.struct("ord", "tf", "dl")).alias("p"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    blocks = blocks.select(name.alias("segment"), "tenant_id", "shard", "term", "block", F.col("p.ord").alias("ords"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"), "max_tf", "min_dl")
    blocks.sortWithinPartitions("term", "tenant_id", "shard", "block").write.parquet(f"{path}/postings")
    docs.select(name.alias("segment"), *docs.columns).write.parquet(f"{path}/docs")
    read = docs.sparkSession.read.parquet
    read(f"{path}/postings").groupBy("tenant_id", "term").agg(F.sum(F.size("ords")).alias("df")).sortWithinPartitions("term").write.parquet(f"{path}/terms")
    read(f"{path}/docs").groupBy("tenant_id").agg(F.count("*").alias("n"), F.sum("dl").alias("total")).write.parquet(f"{path}/stats")


class Postings:
    """Blocks of one shard's terms, for any number of queries. scored counts the postings whose weight was taken."""

    def __init__(self, avgdl: float, masked: bool = False):
        self.avgdl, self.blocks, self.most, self.scored = avgdl, {}, 0, 0
        self.allowed, self.dead = np.empty(0, np.int32) if masked else None, np.empty(0, np.int32)

    def add(self, term: str, block: int, ords: np.ndarray, tf: np.ndarray, dl: np.ndarray, max_tf: int, min_dl: int) -> None:
        self.blocks.setdefault(term, []).append((block, ords, tf, dl, max_tf, min_dl))
        self.most = max(self.most, int(ords.max()) + 1)

    def best(self, terms: dict[str, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """ord and score (6 decimals) of the k best documents, ties to the smaller ord. terms: each with its idf.

        Terms go by their largest possible weight. Once the k-th score so far is more than a block and all terms after
        it can add to a document, only documents with a score so far are looked up in it.
        """
        each = sorted(((max(w * term_weight(t, d, self.avgdl) for _, _, _, _, t, d in self.blocks[term]), term, w) for term, w in terms.items() if term in self.blocks), reverse=True)
        score = np.zeros(self.most)
        ok = np.ones(self.most, bool) if self.allowed is None else np.zeros(self.most, bool)
        if self.allowed is not None:
            ok[self.allowed[self.allowed < self.most]] = True
        ok[self.dead[self.dead < self.most]] = False
        kth, rest = 0.0, sum(top for top, _, _ in each)
        for top, term, w in each:
            rest -= top
            for _, ords, tf, dl, max_tf, min_dl in sorted(self.blocks[term], key=lambda b: b[0]):
                keep = ok[ords] & (score[ords] > 0) if w * term_weight(max_tf, min_dl, self.avgdl) + rest < kth - SLACK else ok[ords]
                if kth:
                    keep &= score[ords] + top + rest >= kth - SLACK
                at = ords[keep]
                score[at] += w * term_weight(tf[keep], dl[keep], self.avgdl)
                self.scored += len(at)
            if self.most > k and rest < score.max():  # else no document is safe yet
                kth = float(np.partition(score, self.most - k)[self.most - k])
        found = np.flatnonzero(score > 0)
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k] - SLACK]
        rounded = np.round(score[found], 6)
        top = np.lexsort((found, -rounded))[:k]
        return found[top], rounded[top]


def _shards(asked: dict[int, dict[str, float]], avgdl: float, k: int, masked: bool, counted: Accumulator | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard: segment, tenant_id, shard, term, block, ords, tfs, dls, max_tf, min_dl. Masks have no term: block -1 what may be found, -2 the dead."""
        place, held = None, None
        out: dict[int, list[tuple]] = {q: [] for q in asked}

        def close() -> None:
            if held is None or not held.most:
                return
            for q, terms in asked.items():
                ords, scores = held.best(terms, k)
                out[q] += [(-float(s), *place, int(o)) for o, s in zip(ords, scores)]
                if len(out[q]) > 8 * k:  # of all shards of this task: the k best, and what ties with the last
                    out[q].sort(key=lambda r: r[0])
                    last = out[q][k - 1][0]
                    out[q] = [r for r in out[q] if r[0] <= last]
            if counted is not None:
                counted.add(held.scored)

        for b in batches:
            cols = [b.column(c).to_pylist() for c in (0, 1, 2, 3, 4, 8, 9)]
            lists = [(x.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))) for x in b.columns[5:8]]
            for i, (segment, tenant, shard, term, block, max_tf, min_dl) in enumerate(zip(*cols)):
                if place != (segment, tenant, shard):
                    close()
                    place, held = (segment, tenant, shard), Postings(avgdl, masked)
                own = [x[ends[i] : ends[i + 1]] for x, ends in lists]
                if term is not None:
                    held.add(term, block, *own, max_tf, min_dl)
                elif block == -1:
                    held.allowed = np.append(held.allowed, own[0])
                else:
                    held.dead = np.append(held.dead, own[0])
        close()
        rows = [(q, -r[0], *r[1:]) for q, found in out.items() for r in found]
        kinds = (pa.int32(), pa.float64(), pa.string(), pa.string(), pa.int32(), pa.int32())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["q", "score", *PLACE, "ord"])

    return run


def _found(index: Index, asked: dict[int, list[str]], k: int, keep: Column | None = None, counted: Accumulator | None = None) -> DataFrame | None:
    """q, rank, chunk_id, score of the k best documents that keep holds for, for each of a bounded number of queries (numbered terms).

    Blocks of the queries' terms meet by shard. A task cuts to the k best of each query over all its shards (with ties,
    as ids of other shards may be smaller) before anything is exchanged. None if no term is in the index.
    """
    n, total = index.totals()
    df = index.frequencies(sorted({t for terms in asked.values() for t in terms}))
    if not df or not n:
        return None
    idfs = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    weighed = {q: {t: idfs[t] for t in terms if t in idfs} for q, terms in asked.items()}
    blocks = index.held("postings", list(df)).select(*PLACE, "term", "block", "ords", "tfs", "dls", "max_tf", "min_dl")
    none, docs, gone = (lambda t, c: F.lit(None).cast(t).alias(c)), index.table("docs"), index.gone()
    for number, mask in ((-1, None if keep is None else docs.filter(keep)), (-2, gone)):
        if mask is not None:
            row = mask.groupBy(*PLACE).agg(F.collect_list("ord").alias("ords"))
            blocks = blocks.unionByName(row.select(*PLACE, none("string", "term"), F.lit(number).alias("block"), "ords", none("array<int>", "tfs"), none("array<int>", "dls"), none("int", "max_tf"), none("int", "min_dl")))
    parts = int(index.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(parts, *PLACE).sortWithinPartitions(*PLACE)
    local = dealt.mapInArrow(_shards(weighed, total / n, k, keep is not None, counted), "q int, score double, segment string, tenant_id string, shard int, ord int")
    tied = local.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("r") <= k).drop("r").withColumnRenamed("tenant_id", "owner")
    named = tied.join(docs.select(*PLACE, "ord", "chunk_id"), ["segment", "shard", "ord"]).filter(F.col("owner").eqNullSafe(F.col("tenant_id")))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "chunk_id")
    return named.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("q", "rank", "chunk_id", "score")


def search(index: Index, query: str, k: int, keep: Column | None = None, id_col: str = "chunk_id") -> DataFrame:
    """As bm25(), from an index: chunk_id and score of the k best rows that keep holds for."""
    terms = query_terms(query, index.table("docs"))
    found = _found(index, {0: terms}, k, keep) if terms else None
    if found is None:
        return index.table("docs").select(F.col("chunk_id").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    return found.select(F.col("chunk_id").alias(id_col), "score").orderBy(F.desc("score"), id_col)


def search_batch(index: Index, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "query", counted: Accumulator | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score of the k best rows for each of a stated set of queries, PAIRS (query, term) pairs at a time.

    Each block of queries reads its terms' postings once, however many queries share a term. Results of several blocks are
    saved one after the other, so that no plan grows with their number. counted: gets the postings scored.
    """
    spark = index.spark
    asked = queries.select(F.col(query_id).alias("id"), F.array_distinct(tokens(F.col(query_text))).alias("terms"))
    total, most = asked.agg(F.sum(F.size("terms")), F.max(F.size("terms"))).first()
    blocks = -(-(total or 0) // PAIRS) or 1
    kind, id_kind = queries.schema[query_id].dataType.simpleString(), index.table("docs").schema["chunk_id"].dataType.simpleString()
    out = None
    for b in range(blocks):
        some = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("id", "terms"), F.lit(blocks)) == b)
        rows = some.collect()  # about PAIRS pairs
        found = _found(index, {i: r["terms"] for i, r in enumerate(rows) if r["terms"]}, k, counted=counted) if rows else None
        if found is None:
            continue
        names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)], f"q int, `{query_id}` {kind}")
        found = found.join(F.broadcast(names), "q").select(query_id, "rank", "chunk_id", "score")
        found = found if blocks == 1 else save(found, "found")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"`{query_id}` {kind}, rank int, chunk_id {id_kind}, score double")


def _best(scored: DataFrame, k: int, query_id: str, id_col: str = "chunk_id") -> DataFrame:
    best = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def bm25_batch(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """query_id, rank, chunk_id, score of the k best rows for each query, from the texts."""
    asked = queries.select(query_id, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    wanted = postings(docs, id_col, text_col).join(asked.select("term").distinct(), "term", "left_semi")
    stats = docs.select(F.size(tokens(F.col(text_col))).alias("_dl")).agg(F.count("*").alias("n"), F.avg("_dl").alias("avgdl"))
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    weighed = wanted.join(df, "term").join(F.broadcast(stats)).select(id_col, "term", (idf(F.col("n"), F.col("df")) * term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("w"))
    return _best(asked.join(weighed, "term").groupBy(query_id, id_col).agg(F.round(F.sum("w"), 6).alias("score")), k, query_id, id_col)
