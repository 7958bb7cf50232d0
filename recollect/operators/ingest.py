"""Idempotent ingest: content hashes, duplicates, token windows, sentence chunks, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import content_hash, words

SIZE, OVERLAP, LARGEST = 270, 35, 300


def hashed(docs: DataFrame, tenant_col: str = "tenant_id", text_col: str = "text") -> DataFrame:
    return docs.withColumn("content_hash", content_hash(F.col(tenant_col), F.col(text_col)))


def new_documents(incoming: DataFrame, stored: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """Of each hash that is not stored yet, the row of the smallest id.

    Rows meet by hash and id only: the least id of a hash is an aggregate with map-side combine, so no copied text is
    shuffled for it and a hash with very many copies is no single task.
    """
    first = incoming.groupBy("content_hash").agg(F.min(id_col).alias(id_col))
    if stored is not None:
        first = first.join(stored.select("content_hash").distinct(), "content_hash", "left_anti")
    return incoming.join(first, ["content_hash", id_col], "left_semi")


def duplicates(incoming: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and existing_id: rows whose content a row of a smaller id already holds."""
    first = incoming.groupBy("content_hash").agg(F.min(id_col).alias("existing_id"))
    return incoming.select(id_col, "content_hash").join(first, "content_hash").filter(F.col(id_col) != F.col("existing_id")).select(id_col, "existing_id")


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Fixed-stride chunks: doc_id, ordinal, n_tokens, text. A text without words gives none; the last chunk may be short."""
    stride = size - overlap
    held = docs.select(id_col, words(F.col(text_col)).alias("_w")).filter(F.size("_w") > 0)
    count = F.ceil(F.greatest(F.size("_w") - overlap, F.lit(1)) / stride).cast("int")
    each = held.select(id_col, "_w", F.explode(F.sequence(F.lit(0), count - 1)).alias("ordinal"))
    part = F.slice("_w", F.col("ordinal") * stride + 1, F.lit(size))
    return each.select(id_col, "ordinal", part.alias("_p")).select(id_col, "ordinal", F.size("_p").alias("n_tokens"), F.array_join("_p", " ").alias("text"))


#: Words of a piece at most: a chunk of under SIZE tokens and one more piece stay within LARGEST.
PIECE = LARGEST - SIZE
#: A chunk that ends at a sentence may have so few tokens.
SMALLEST = 256
_SPACE, _WORD = r"[ \t\n\x0B\f\r]", r"[^ \t\n\x0B\f\r]"


def pieces(text: Column, most: int = PIECE) -> Column:
    """A text in sentences, longer ones cut after most words: array of (t, n words, bytes, own bytes, whole), each with the blanks before it.

    A sentence ends at a word with . ! or ? at its end, at a new line and at the end of the text.
    """
    end = rf"(?=[ \t\x0B\f\r]*+(?:\n|\z)|(?<=[.!?]){_SPACE})"
    pattern = rf"{_SPACE}*+(?:(?:{_WORD}++{_SPACE}++){{0,{most - 1}}}?{_WORD}++{end}|(?:{_WORD}++{_SPACE}++){{{most - 1}}}{_WORD}++)"
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    count = lambda p: F.regexp_count(p, F.lit(f"{_WORD}+"))
    return F.transform(found, lambda p: F.struct(p.alias("t"), count(p).alias("n"), F.octet_length(p).alias("bytes"), F.octet_length(F.regexp_replace(p, f"^{_SPACE}+", "")).alias("own"), ((count(p) < most) | p.rlike(r"[.!?]\z")).alias("whole")))


def sentence_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, largest: int = LARGEST, overlap: int = OVERLAP, smallest: int = SMALLEST) -> DataFrame:
    """Chunks at sentence ends where they fit: doc_id, ordinal, n_tokens, start, end (bytes of the text), text.

    A chunk takes pieces until it has size tokens and never more than largest. It ends at the last sentence end from its
    smallest-th token on, or after the piece that filled it. The next one begins with the first piece among its last
    overlap tokens, so neighbours always share some. Only the last chunk may be short. One fold over a text's pieces gives
    the cuts, all of it in expressions; null and blank texts give no chunk, and a null id is kept.
    """
    most = largest - size
    if not 0 < most <= overlap < smallest <= size < largest:
        raise ValueError("sizes must be in order, with an overlap of at least largest - size")
    held = docs.select(F.col(id_col).alias("doc_id"), pieces(F.col(text_col).cast("string"), most).alias("p"))
    place, piece, cuts = "struct<tok:int,byte:int>", "struct<t:string,tok:int,byte:int>", "array<struct<n_tokens:int,start:int,end:int,text:string>>"
    zero = "named_struct('tok', 0, 'byte', 0)"
    first = F.expr(f"named_struct('now', {zero}, 'open', {zero}, 'mark', cast(null as {place}), 'held', cast(array() as array<{piece}>), 'cuts', cast(array() as {cuts}))")

    def chunk(held: Column, a: Column, b: Column) -> Column:
        text = F.array_join(F.transform(F.filter(held, lambda x: x["tok"] < b["tok"]), lambda x: x["t"]), "")
        return F.struct((b["tok"] - a["tok"]).alias("n_tokens"), a["byte"].alias("start"), b["byte"].alias("end"), F.regexp_replace(text, f"^{_SPACE}+", "").alias("text"))

    def step(s: Column, p: Column) -> Column:
        """held: the pieces of the open chunk, each with where it begins."""
        was = s["now"]
        begin = F.struct(p["t"].alias("t"), was["tok"].alias("tok"), (was["byte"] + p["bytes"] - p["own"]).alias("byte"))
        now = F.struct((was["tok"] + p["n"]).alias("tok"), (was["byte"] + p["bytes"]).alias("byte"))
        open_ = F.when(was["tok"] == 0, F.struct(begin["tok"].alias("tok"), begin["byte"].alias("byte"))).otherwise(s["open"])
        mark = F.when(p["whole"] & (now["tok"] - open_["tok"] >= smallest), now).otherwise(s["mark"])
        held, cut, full = F.array_append(s["held"], begin), F.coalesce(mark, now), now["tok"] - open_["tok"] >= size
        left = F.filter(held, lambda x: x["tok"] >= cut["tok"] - overlap)
        after = F.struct(F.get(left, F.lit(0))["tok"].alias("tok"), F.get(left, F.lit(0))["byte"].alias("byte"))
        return F.struct(
            now.alias("now"), F.when(full, after).otherwise(open_).alias("open"), F.when(~full, mark).alias("mark"), F.when(full, left).otherwise(held).alias("held"),
            F.when(full, F.array_append(s["cuts"], chunk(held, open_, cut))).otherwise(s["cuts"]).alias("cuts"),
        )

    def finish(s: Column) -> Column:
        last = F.coalesce(F.get(s["cuts"], F.size(s["cuts"]) - 1)["end"], F.lit(0))
        return F.when(s["now"]["byte"] > last, F.array_append(s["cuts"], chunk(s["held"], s["open"], s["now"]))).otherwise(s["cuts"])

    cut = held.select("doc_id", F.posexplode(F.aggregate("p", first, step, finish)).alias("ordinal", "c"))
    return cut.select("doc_id", "ordinal", "c.n_tokens", "c.start", "c.end", "c.text")


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """stored without the keys of incoming, and incoming."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


#: Chunks of a document at most.
QUOTA = 10_000


def over_quota(text: Column, size: int = SIZE, overlap: int = OVERLAP, most: int = QUOTA) -> Column:
    """Whether a text's windows would be more than allowed."""
    return F.ceil((F.size(words(text)) - overlap) / (size - overlap)) > most


def chunk_ids(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds chunk_id: from document and ordinal, so that a second run gives the same."""
    return chunks.withColumn("chunk_id", F.sha2(F.concat_ws("#", F.col(id_col).cast("string"), F.col("ordinal").cast("string")), 256))


def first_stored(docs: DataFrame) -> DataFrame:
    """content_hash and known: the earliest document of each hash, by created_at and doc_id (nulls last)."""
    order = F.struct(F.col("created_at").isNull(), "created_at", "doc_id")
    return docs.groupBy("content_hash").agg(F.min_by("doc_id", order).alias("known"))
