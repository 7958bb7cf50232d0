"""Mixing sources to target weights by temperature, in DataFrame operations alone.

Each source's share of the tokens is raised to an exponent and normalised. The exponent is bisected until the weights
reach a target entropy, or until no source is repeated more than a limit. A source's weight times the token budget is
its quota: so many whole passes (blocks), each a permutation of its documents by a hash, and a last block cut where the
quota ends. The cut is found from the token sums of 1024 hash buckets of each source and, inside the one bucket where
it falls, by a running sum; so a source with a third of all rows is spread over 1024 window groups.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm._common import numbered, save

WORD = r"[^\x20\x09-\x0D]+"
STEPS, WAYS = 8, 16
#: The range for an entropy is 0 to 4, doubled at most so often.
DOUBLINGS = 18


def exponent(shares: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_ratio: float | None) -> float:
    """The exponent, to 6 decimals. shares: one row for each source, p, and q (p against the largest p, so that no power vanishes).

    Entropy falls and repetition of the smallest source falls as the exponent grows, so every step evaluates 15 points
    between the bounds in one aggregation and keeps the part where the target lies: four bisections at once.
    """
    lo, hi = 0.0, 1.0
    if target_entropy is not None:  # double the end until the target is within reach
        ends = [4.0 * 2**k for k in range(DOUBLINGS + 1)]
        sums = [f(F.pow("q", F.lit(a)) * w).alias(f"{n}{k}") for k, a in enumerate(ends) for f, w, n in ((F.sum, F.lit(1.0), "z"), (F.sum, F.log("q"), "l"))]
        row = shares.agg(*sums).first()
        hi = next((a for k, a in enumerate(ends) if log(row[f"z{k}"]) - a * row[f"l{k}"] / row[f"z{k}"] <= target_entropy), ends[-1])
    for _ in range(STEPS):
        points = [lo + (hi - lo) * k / WAYS for k in range(1, WAYS)]
        sums = []
        for k, a in enumerate(points):
            power, part = F.pow("p", F.lit(a)), F.pow("q", F.lit(a))
            sums += [F.sum(power).alias(f"z{k}"), F.sum(part).alias(f"y{k}"), F.sum(part * F.log("q")).alias(f"l{k}"), F.max(F.pow("p", F.lit(a - 1))).alias(f"r{k}"), F.min(F.pow("p", F.lit(a - 1))).alias(f"m{k}")]
        row = shares.agg(*sums).first()
        below = 0  # points at which the target isn't reached yet: the exponent must be larger
        for k, a in enumerate(points):
            z, y = row[f"z{k}"], row[f"y{k}"]
            if target_entropy is not None:
                short = log(y) - a * row[f"l{k}"] / y > target_entropy
            else:
                ratio = budget_ratio / z if budget_ratio is not None else 1 / row[f"m{k}"]
                short = row[f"r{k}"] * ratio > max_repeats
            below = k + 1 if short else below
        lo, hi = lo + (hi - lo) * below / WAYS, lo + (hi - lo) * (below + 1) / WAYS
    return round((lo + hi) / 2, 6)


def order_key(id_col: str, seed: int) -> Column:
    """60 bits of an md5 of the id as text and the seed: the place in a source's permutation."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", entropy_share: float | None = 0.95, max_repeats: float | None = None, budget: int | None = None, whole_epoch: bool = False, seed: int = 1) -> DataFrame:
    """Adds n_tokens, weight, copies and order_key to docs: how often the mixture uses each document, and its place in the blocks.

    Give entropy_share (the target as a share of the entropy of equal weights) or max_repeats. budget: tokens of the
    mixture, by default those of docs; with whole_epoch it is instead what gives the least repeated source one whole pass, so
    that no document is left out. Tokens are words. A null source is a source of its own; null and empty texts have 0
    tokens; a source without tokens has weight 0 and no copies. Repeated rows count each. A target out of reach gives the
    nearest end of the exponent's range (0 to 4, doubled up to 2^20; 0 to 1 for repeats). Columns of docs with the added names are replaced.
    """
    if (entropy_share is None) == (max_repeats is None):
        raise ValueError("give either entropy_share or max_repeats")
    added = ["n_tokens", "weight", "copies", "order_key"]
    names = [c for c in docs.columns if c not in added]
    at = {c: f"`{k}`" for k, c in enumerate(docs.columns)}  # columns go by their places, so that no name of docs can clash
    source = F.coalesce(F.concat(F.lit("="), F.col(at[source_col]).cast("string")), F.lit("-"))
    rows = numbered(docs).withColumn("n_tokens", F.coalesce(F.regexp_count(F.col(at[text_col]), F.lit(WORD)), F.lit(0)).cast("long")).withColumn("order_key", order_key(at[id_col], seed)).withColumn("_s", source)
    own = [F.col(at[c]).alias(c) for c in names]
    rows = rows.withColumn("_b", F.shiftright("order_key", 50).cast("int"))
    buckets = save(rows.groupBy("_s", "_b").agg(F.sum("n_tokens").alias("_t")), "buckets")
    sums = save(buckets.groupBy("_s").agg(F.sum("_t").alias("_own")).filter("_own > 0"), "sources")
    total, n = sums.agg(F.sum("_own"), F.count("*")).first()
    if not n:
        return rows.select(*own, "n_tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("copies"), "order_key")
    most = sums.agg(F.max("_own")).first()[0]
    shares = sums.withColumn("p", F.col("_own") / F.lit(float(total))).withColumn("q", F.col("_own") / F.lit(float(most)))
    target = entropy_share * log(n) if entropy_share is not None else None
    ratio = None if whole_epoch else (budget or total) / total
    a = exponent(shares, target, max_repeats, ratio)
    z, least, y = shares.agg(F.sum(F.pow("p", F.lit(a))), F.min(F.pow("p", F.lit(a - 1))), F.sum(F.pow("q", F.lit(a)))).first()
    ratio = z / least if whole_epoch else ratio
    weighed = shares.withColumn("weight", F.pow("q", F.lit(a)) / F.lit(y)).withColumn("_quota", F.col("weight") * F.lit(float(total) * ratio))
    weighed = weighed.withColumn("_full", F.floor(F.col("_quota") / F.col("_own") + 1e-9)).withColumn("_rest", F.greatest(F.col("_quota") - F.col("_full") * F.col("_own"), F.lit(0.0)))
    before = F.sum("_t").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_t")
    placed = buckets.withColumn("_before", before).join(weighed.select("_s", "weight", "_full", "_rest"), "_s", "left")
    inside = Window.partitionBy("_s", "_b").orderBy("order_key", at[id_col]).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(placed.drop("_t"), ["_s", "_b"]).withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(inside))
    used = F.col("_full") + (F.col("_upto") <= F.col("_rest")).cast("long")
    return out.select(*own, "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce(used, F.lit(0)).cast("long").alias("copies"), "order_key")


def blocks(mixed: DataFrame) -> DataFrame:
    """The mixture itself: a row for each copy, with its block (from 1) and its place in the block's own permutation (order_key).

    Columns named block and order_key are replaced. The first block has the permutation of copies(); the last, cut block of a source holds the head of that one.
    """
    out = mixed.filter("copies > 0").withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    again = F.conv(F.substring(F.md5(F.concat_ws(":", "order_key", "block").cast("binary")), 1, 15), 16, 10).cast("long")
    return out.withColumn("order_key", F.when(F.col("block") == 1, F.col("order_key")).otherwise(again))
