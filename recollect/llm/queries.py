"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import ann, langid, lm, mixing, near_dup, packing, quality, repair, sentence_pieces, tokens, vector_dup, warc, whitening
from recollect.llm._common import fold, save, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to the shared folder and read back: digests and sizes of responses are those of the payloads read."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(warc.plan_records(table(spark, sf_dir, "pages")), path, compression="gzip")
    records = warc.read_warc(spark, path).filter(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast("long")
    response = F.col("record_type") == "response"
    return records.select(
        page("record_id").alias("page_id"),
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, warc.base32_sha1(F.col("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), end_mark=True)


def packed(docs: DataFrame, end_mark: bool = False) -> DataFrame:
    """Pieces of all documents with the crc32 of their ids, placed into sequences of 1024. end_mark: as in token_pieces."""
    pieces = tokens.token_pieces(docs, end_mark=end_mark).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(save(pieces, "pieces"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), end_mark=True)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights at 95 % of the largest entropy, over as many tokens as the corpus has."""
    mixed = mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), entropy_share=0.95)
    return mixed.select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), "copies", "order_key")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs.select("doc_id", fold("doc_id", 5).alias("f"), "text"), net)
    return out.select("doc_id", (F.col("f") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", fold("doc_id", 5).alias("f"), "text"), langid.train(docs), spans=False)
    return out.select("doc_id", (F.col("f") == 0).alias("held_out"), "lang_pred", "score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings")).select("*", F.explode(F.arrays_zip(F.sequence(F.lit(1), F.size("whitened")), "whitened", "explained")).alias("c"))
    return out.select("vec_id", F.col("c.0").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentence_pieces.encoded(table(spark, sf_dir, "documents"))
    listed = F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations")).drop("rows")


QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_quality": op5_quality,
    "op6_language_id": op6_language_id,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_token_counts": op9_token_counts,
    "op11_whitening": op11_whitening,
    "op12_sentence_pieces": op12_sentence_pieces,
    "op13_conversation_repair": op13_conversation_repair,
}

OP4_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':1'), 1, 15))::BIGINT AS order_key
  FROM documents),
s AS (SELECT source, sum(n_tokens)::DOUBLE AS own FROM d GROUP BY source HAVING sum(n_tokens) > 0),
p AS (SELECT source, own, own / (SELECT max(own) FROM s) AS p FROM s),
u AS (
  SELECT 4.0::DOUBLE AS hi
  UNION ALL
  SELECT hi * 2 FROM u WHERE hi < 1048576 AND (SELECT ln(sum(pow(p, u.hi))) - u.hi * sum(pow(p, u.hi) * ln(p)) / sum(pow(p, u.hi)) FROM p) > 0.95 * ln((SELECT count(*) FROM p))),
h AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, (SELECT max(hi) FROM u) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN e > t THEN (lo + hi) / 2 ELSE lo END, CASE WHEN e > t THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT h.i, h.lo, h.hi, 0.95 * ln((SELECT count(*) FROM p)) AS t,
               (SELECT ln(sum(pow(p, (h.lo + h.hi) / 2))) - (h.lo + h.hi) / 2 * sum(pow(p, (h.lo + h.hi) / 2) * ln(p)) / sum(pow(p, (h.lo + h.hi) / 2)) FROM p) AS e
        FROM h WHERE h.i < 32)),
a AS (SELECT round((lo + hi) / 2, 6) AS a FROM h WHERE i = 32),
w AS (SELECT source, own, pow(p, a) / sum(pow(p, a)) OVER () AS weight, pow(p, a) / sum(pow(p, a)) OVER () * sum(own) OVER () AS quota FROM p, a),
f AS (SELECT *, floor(quota / own + 1e-9) AS full_passes FROM w),
r AS (SELECT *, greatest(quota - full_passes * own, 0) AS rest FROM f),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY order_key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d)
SELECT c.doc_id, c.source, c.n_tokens, round(coalesce(r.weight, 0), 6) AS weight,
       coalesce(r.full_passes + CASE WHEN c.upto <= r.rest THEN 1 ELSE 0 END, 0)::BIGINT AS copies, c.order_key
FROM c LEFT JOIN r ON c.source IS NOT DISTINCT FROM r.source
"""

OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS h FROM p),
f AS (SELECT h, min(page_id) AS first_id FROM q GROUP BY h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(q.h, 10 * (i // 8)::INT + 1, 10))::BIGINT >> (5 * (7 - i % 8))) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM q JOIN f USING (h)
"""

ORACLES: dict[str, str] = {"op2_warc": OP2_SQL, "op4_source_mixing": OP4_SQL}
