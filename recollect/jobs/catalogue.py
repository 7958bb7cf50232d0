"""The registered queries over the given tables, each with an equivalent SQL text where SQL can express it.

Mapping: tenant = documents.lang, workspace = documents.source, a chunk is a document row or a token window, the vector
leg is `embeddings` (joined to documents by number), feedback is `labels` (quality as score), call edges come from `lineitem`,
modules are suppliers' nations, concepts are `part`, the audit log is `events`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import text as X
from recollect.operators import code, context, embedding, evaluation, fusion, graph, ignore, ingest, lexical, lifecycle, scope, summary, vector
from recollect.sources import audit, files

QUERY, WORKSPACE, NOW = "license from thing that", "src0", "2024-01-31 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("tenant_id"), F.col("source").alias("workspace_id"), "doc_id", "text", "source", "n_chars")


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"), F.col("quality").alias("score"), "toxic")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("workspace_id"))


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    row = table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()
    return list(row[0]) if row else [0.0]


def call_edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("source"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 211).alias("target"))


def supplier_edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 97 + 1).alias("target"))


def supplier_modules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("module"))


def concepts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.col("p_type").alias("signature"), F.lit("").alias("description"), F.col("p_brand").alias("file"), F.col("p_size").alias("start_line"), F.substring_index("p_type", " ", 1).alias("kind"))


_INDEXED: dict[tuple, lexical.Index] = {}


def index(spark: SparkSession, sf: str) -> lexical.Index:
    """The inverted index of documents, written to the shared folder by a session's first search of these files as they are now."""
    import uuid

    from recollect.functions.shared import shared_dir

    docs = table(spark, sf, "documents")
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
    key = (spark.sparkContext.applicationId, *sorted(map(tuple, files)))
    if key not in _INDEXED:
        _INDEXED[key] = lexical.write_index(chunks(spark, sf), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", ("workspace_id",))
    return _INDEXED[key]


TOK = r"regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+')"
TERMS = "(SELECT unnest(['license', 'from', 'thing', 'that']) AS term)"
BM25 = f"""
WITH t AS (SELECT doc_id AS chunk_id, source, {TOK} AS toks FROM documents WHERE lang = 'en'),
s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
p AS (SELECT chunk_id, source, len(toks) AS dl, u.tok AS term, count(*) AS tf FROM t, unnest(t.toks) AS u(tok) WHERE u.tok IN (SELECT term FROM {TERMS}) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS (SELECT chunk_id, source, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM p JOIN f USING (term), s GROUP BY chunk_id, source)
"""
L2 = "list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE)))"
DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
Q0 = "q AS (SELECT embedding, label FROM embeddings ORDER BY vec_id LIMIT 1)"


# Scope and lookups


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source = 'src0'")
def scope_filter(spark, sf):
    return scope.scoped(chunks(spark, sf), "en", WORKSPACE).select("doc_id", "n_chars")


@query("SELECT doc_id, lang AS tenant_id, source AS workspace_id, text FROM documents WHERE doc_id = 17")
def get_chunk(spark, sf):
    return scope.lookup(chunks(spark, sf), "chunk_id", 17).select("doc_id", "tenant_id", "workspace_id", "text")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def chunks_in_list(spark, sf):
    return scope.in_ids(chunks(spark, sf), feedback(spark, sf).filter("toxic = 1"), "chunk_id").select("doc_id", "n_chars")


@query("SELECT doc_id, lang || '/' || source AS scope, 'document:' || lower(lang) AS label, lang IN ('en', 'es') AS known FROM documents")
def provenance_labels(spark, sf):
    label = F.concat(F.lit("document:"), F.lower("tenant_id"))
    return chunks(spark, sf).select("doc_id", F.concat_ws("/", "tenant_id", "workspace_id").alias("scope"), F.when(X.is_source_label(label), label).alias("label"), F.col("tenant_id").isin("en", "es").alias("known"))


@query("SELECT page_id, CASE WHEN url ILIKE '%.md' OR url ILIKE '%.markdown' THEN 'markdown' WHEN url ILIKE '%.txt' THEN 'text' WHEN regexp_extract(url, '\\.([^./]+)$', 1) <> '' THEN 'document:' || lower(regexp_extract(url, '\\.([^./]+)$', 1)) END AS source FROM pages")
def page_source_kind(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.source_kind(F.col("url")).alias("source"))


# Lexical retrieval


@query(BM25 + "SELECT chunk_id, score FROM r ORDER BY score DESC, chunk_id LIMIT 20")
def fts_bm25_topk(spark, sf):
    return lexical.search(index(spark, sf).of("en"), QUERY, 20)


@query(BM25 + "SELECT chunk_id, score FROM r WHERE source = 'src0' ORDER BY score DESC, chunk_id LIMIT 20")
def fts_bm25_scoped(spark, sf):
    return lexical.search(index(spark, sf).of("en"), QUERY, 20, keep=F.col("workspace_id") == WORKSPACE)


@query(BM25 + "SELECT chunk_id, score FROM r ORDER BY score DESC, chunk_id LIMIT 20")
def fts_bm25_unindexed(spark, sf):
    """The same search straight from the texts."""
    return lexical.bm25(scope.scoped(chunks(spark, sf), "en"), QUERY, 20)


BATCH = f"""
WITH t AS (SELECT doc_id AS chunk_id, {TOK} AS toks FROM documents),
s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
a AS (SELECT DISTINCT item_id AS query_id, u.tok AS term FROM (SELECT item_id, {TOK} AS toks FROM benchmark) b, unnest(b.toks) AS u(tok)),
p AS (SELECT chunk_id, len(toks) AS dl, u.tok AS term, count(*) AS tf FROM t, unnest(t.toks) AS u(tok) WHERE u.tok IN (SELECT term FROM a) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT chunk_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM p JOIN f USING (term), s),
r AS (SELECT query_id, chunk_id, round(sum(w), 6) AS score FROM a JOIN w USING (term) GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM r QUALIFY rank <= 5)
"""


def batch_hits(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return lexical.search_batch(index(spark, sf), asked, 5)


@query(BATCH + "SELECT query_id, chunk_id, rank::INT AS rank, score FROM h")
def fts_batch_topk(spark, sf):
    return batch_hits(spark, sf).select("query_id", "chunk_id", "rank", "score")


@query(f"SELECT doc_id, len({TOK})::INT AS n_tokens, md5(array_to_string({TOK}, ' ')) AS folded FROM documents")
def fts_accent_fold(spark, sf):
    toks = X.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", toks.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("folded"))


LISTED = "SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'und') AS lang, coalesce(doc_id::VARCHAR, 'x') AS name FROM documents"


@query(f"WITH f AS ({LISTED}), o AS (SELECT source, min(lang) AS own FROM f GROUP BY source) SELECT doc_id, CASE WHEN lang = own THEN name NOT LIKE '%0' ELSE name LIKE '%7' AND lang <> 'en' END AS ignored FROM f JOIN o USING (source)")
def scan_ignored(spark, sf):
    """Documents as a tree source/lang/id.txt under rules at the root and in each source's folder."""
    docs = table(spark, sf, "documents")
    named = docs.select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce(F.col("doc_id").cast("string"), F.lit("x")).alias("name"))
    files = named.select("doc_id", F.concat_ws("/", "source", "lang", F.concat("name", F.lit(".txt"))).alias("file"))
    own = named.groupBy("source").agg(F.min("lang").alias("lang")).select(F.concat("source", F.lit("/.gitignore")).alias("file"), F.format_string("/%s/*.txt\n!/%s/*0.txt", "lang", "lang").alias("text"))
    top = spark.createDataFrame([(".gitignore", "*7.txt\n!*/en/*7.txt")], "file string, text string")
    return ignore.judged(files, ignore.rules(own.unionByName(top))).select("doc_id", "ignored")


# Vector retrieval


@query(f"WITH {Q0}, d AS (SELECT vec_id AS chunk_id, round({L2}, 6) AS distance FROM embeddings v, q) SELECT chunk_id, distance, round(1 / (1 + distance), 6) AS score FROM d ORDER BY distance, chunk_id LIMIT 20")
def knn_exact_topk(spark, sf):
    return vector.knn(vectors(spark, sf), query_vector(spark, sf), 20)


@query(f"WITH {Q0}, d AS (SELECT vec_id AS chunk_id, round({L2}, 6) AS distance FROM embeddings v, q WHERE v.label = 3) SELECT chunk_id, distance, round(1 / (1 + distance), 6) AS score FROM d ORDER BY distance, chunk_id LIMIT 20")
def knn_scoped(spark, sf):
    return vector.knn(vectors(spark, sf).filter("workspace_id = 3"), query_vector(spark, sf), 20)


COSINE = f"round(({DOT.format(a='v.embedding', b='q.embedding')}) / (sqrt({DOT.format(a='v.embedding', b='v.embedding')}) * sqrt({DOT.format(a='q.embedding', b='q.embedding')})), 6)"


@query(f"WITH {Q0} SELECT vec_id AS chunk_id, {COSINE} AS score FROM embeddings v, q ORDER BY score DESC, chunk_id LIMIT 100")
def cosine_rank(spark, sf):
    return vector.cosine_rank(vectors(spark, sf), query_vector(spark, sf), 100)


@query(f"""WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label),
d AS (SELECT query_id, vec_id AS chunk_id, round({L2}, 6) AS distance FROM embeddings v, q)
SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INT AS rank FROM d QUALIFY rank <= 10""")
def knn_batch_topk(spark, sf):
    v = vectors(spark, sf)
    asked = v.groupBy(F.col("workspace_id").alias("query_id")).agg(F.min_by("vector", "chunk_id").alias("query_vector"))
    return vector.knn_batch(v, asked, 10).select("query_id", "chunk_id", "distance", "rank")


# Fusion


def legs(spark, sf) -> tuple[DataFrame, DataFrame]:
    return fts_bm25_topk(spark, sf), knn_exact_topk(spark, sf).select("chunk_id", "score")


LEGS = BM25 + f""", {Q0},
a AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM r QUALIFY rank <= 20),
d AS (SELECT vec_id AS chunk_id, round({L2}, 6) AS distance FROM embeddings v, q),
b AS (SELECT chunk_id, row_number() OVER (ORDER BY round(1 / (1 + distance), 6) DESC, chunk_id) AS rank FROM (SELECT * FROM d ORDER BY distance, chunk_id LIMIT 20)),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
h AS (SELECT chunk_id, round(sum(1 / (60.0 + rank)), 6) AS score FROM u GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 20)
"""


@query(LEGS + "SELECT chunk_id, score FROM h")
def hybrid_rrf(spark, sf):
    return fusion.hybrid(*legs(spark, sf), 20, chunks(spark, sf))


@query(LEGS + "SELECT chunk_id, score FROM h WHERE chunk_id IN (SELECT doc_id FROM documents WHERE source = 'src0')")
def hybrid_rrf_filtered(spark, sf):
    return fusion.hybrid(*legs(spark, sf), 20, chunks(spark, sf), keep=F.col("source") == "src0")


@query(LEGS + "SELECT k, chunk_id, round(sum(1 / (k + rank)), 6) AS score FROM u, (SELECT unnest([30.0, 60.0, 100.0, 150.0])::DOUBLE AS k) GROUP BY ALL")
def rrf_k_sweep(spark, sf):
    a, b = legs(spark, sf)
    return fusion.rrf_sweep([fusion.ranked(a), fusion.ranked(b)], [30, 60, 100, 150]).select("k", "chunk_id", "score")


@query("WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) SELECT event_id % 1000 AS item, round(sum(1 / (60.0 + rank)), 6) AS score FROM e GROUP BY 1")
def rrf_many_lists(spark, sf):
    """Fusion of one ranked list for each event type, each ranked whole: ranks from value buckets, not from one task."""
    e = table(spark, sf, "events").select("event_type", "event_id", "value")
    return fusion.rrf([ranked_lists(e, "event_type", "value", "event_id").withColumn("item", F.col("event_id") % 1000)], 60.0, "item")


def ranked_lists(df: DataFrame, by: str, value: str, id_col: str) -> DataFrame:
    """Exact rank from 1 in each list by value, largest first, nulls last, ties to the smaller id.

    Rows are sorted by range of list, value and id, so neither a long list nor a value that many rows share is one task;
    a rank is the place in its range plus the list's rows in the ranges before.
    """
    from pyspark.sql import Window

    from recollect.functions.shared import save

    order = [by, F.desc_nulls_last(value), id_col]
    held = save(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = held.groupBy(by, "_p").agg(F.count("*").alias("_m")).withColumn("_up", F.sum("_m").over(Window.partitionBy(by).orderBy("_p")) - F.col("_m"))
    inside = F.row_number().over(Window.partitionBy(by, "_p").orderBy(*order[1:]))
    ranked = held.withColumn("_r", inside).alias("h").join(before.alias("b"), F.col(f"h.{by}").eqNullSafe(F.col(f"b.{by}")) & (F.col("h._p") == F.col("b._p")))
    return ranked.select(*(F.col(f"h.{c}") for c in df.columns), (F.col("_r") + F.col("_up")).alias("rank"))


@query(LEGS + f", x AS (SELECT chunk_id, {TOK} AS toks FROM h JOIN documents ON doc_id = chunk_id) SELECT chunk_id, round((SELECT count(*) FROM {TERMS} WHERE list_contains(toks, term)) / 4.0, 6)::DOUBLE AS score FROM x ORDER BY score DESC, chunk_id LIMIT 10")
def rerank_overlap(spark, sf):
    return fusion.rerank(hybrid_rrf(spark, sf), chunks(spark, sf), QUERY, 10)


# Context packing


def sized_hits(spark, sf) -> DataFrame:
    return fts_bm25_topk(spark, sf).join(index(spark, sf).lengths.select("chunk_id", F.col("dl").alias("n_tokens")), "chunk_id")


HITS = BM25 + ", h AS (SELECT chunk_id, score, len(toks)::BIGINT AS n_tokens FROM (SELECT chunk_id, score FROM r ORDER BY score DESC, chunk_id LIMIT 20) JOIN t USING (chunk_id))"
BONUS = ", g AS (SELECT doc_id AS chunk_id, least(greatest(avg(quality::DOUBLE) * 0.5, 0), 0.5) AS bonus FROM labels WHERE quality IS NOT NULL GROUP BY doc_id)"
FIT = ", v AS ({v}), c AS (SELECT chunk_id, value, n_tokens, sum(n_tokens) OVER (ORDER BY value DESC, chunk_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM v) "


@query(HITS + FIT.format(v="SELECT chunk_id, score AS value, n_tokens FROM h") + "SELECT chunk_id, value, n_tokens::INT AS n_tokens, running FROM c WHERE running <= 2000")
def context_fit(spark, sf):
    return context.fit(sized_hits(spark, sf), 2000)


@query(HITS + BONUS + FIT.format(v="SELECT chunk_id, round(score + coalesce(bonus, 0), 6) AS value, n_tokens FROM h LEFT JOIN g USING (chunk_id)") + "SELECT chunk_id, value, n_tokens::INT AS n_tokens, running FROM c WHERE running <= 2000")
def context_fit_feedback(spark, sf):
    return context.fit(sized_hits(spark, sf), 2000, context.feedback_bonus(feedback(spark, sf)))


@query(HITS + FIT.format(v="SELECT chunk_id, score AS value, n_tokens FROM h") + ", z AS (SELECT count(*) AS n_fit, coalesce(sum(n_tokens), 0)::BIGINT AS tokens FROM c WHERE running <= 5) SELECT (SELECT count(*) FROM h) AS n_hits, n_fit, tokens, CASE WHEN (SELECT count(*) FROM h) > 0 AND n_fit = 0 THEN 'budget_smaller_than_smallest_chunk' END AS reason FROM z")
def context_fit_reason(spark, sf):
    return context.fit_reason(sized_hits(spark, sf), 5)


@query("SELECT doc_id AS chunk_id, avg(quality::DOUBLE) AS mean_score, least(greatest(avg(quality::DOUBLE) * 0.5, 0), 0.5) AS bonus FROM labels WHERE quality IS NOT NULL GROUP BY doc_id")
def feedback_mean(spark, sf):
    return context.feedback_bonus(feedback(spark, sf))


@query("SELECT doc_id AS chunk_id, quality AS score FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id IS NOT NULL)")
def feedback_orphans(spark, sf):
    return context.orphans(feedback(spark, sf), scope.scoped(chunks(spark, sf), "en")).select("chunk_id", "score")


# Ingest


def hashed(spark, sf):
    return ingest.hashed(chunks(spark, sf))


HASHED = "WITH d AS (SELECT doc_id, lang, sha256(coalesce(lang, '') || chr(0) || coalesce(text, '')) AS content_hash FROM documents)"


@query(HASHED + " SELECT doc_id, content_hash FROM d")
def content_hash(spark, sf):
    return hashed(spark, sf).select("doc_id", "content_hash")


@query(HASHED + " SELECT doc_id, content_hash FROM d QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1")
def ingest_dedup_new(spark, sf):
    return ingest.new_documents(hashed(spark, sf).select("doc_id", "content_hash"))


@query(HASHED + ", f AS (SELECT content_hash, min(doc_id) AS existing_id FROM d GROUP BY content_hash) SELECT doc_id, existing_id FROM d JOIN f USING (content_hash) WHERE doc_id <> existing_id")
def ingest_dedup_existing(spark, sf):
    return ingest.duplicates(hashed(spark, sf))


WINDOWS = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, ceil(greatest(len(w) - 35, 1) / 235.0)::BIGINT)) AS ordinal FROM w WHERE len(w) > 0),
p AS (SELECT doc_id, ordinal, w[ordinal * 235 + 1 : ordinal * 235 + 270] AS p FROM c)
"""


@query(WINDOWS + "SELECT doc_id, ordinal::INT AS ordinal, len(p)::INT AS n_tokens, md5(array_to_string(p, ' ')) AS digest FROM p")
def chunk_windows(spark, sf):
    return ingest.windows(table(spark, sf, "documents")).select("doc_id", "ordinal", "n_tokens", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(WINDOWS + "SELECT doc_id, count(*) AS n_chunks, sum(len(p))::BIGINT AS tokens, min(len(p))::INT AS shortest, max(len(p))::INT AS longest FROM p GROUP BY doc_id")
def chunk_stats(spark, sf):
    return ingest.windows(table(spark, sf, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("tokens"), F.min("n_tokens").alias("shortest"), F.max("n_tokens").alias("longest"))


SENTENCES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+')) AS t, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+'), 1) AS i FROM documents),
b AS (SELECT doc_id, i, octet_length(encode(t))::BIGINT AS bytes, octet_length(encode(regexp_replace(t, '^[ \t\n\x0b\f\r]+', '')))::BIGINT AS own,
        regexp_matches(t, '[.!?]$') AS dot, lead(regexp_matches(t, '^[ \t\x0b\f\r]*\n')) OVER (PARTITION BY doc_id ORDER BY i) AS line FROM w),
s AS (SELECT *, dot OR coalesce(line, true) AS ends, sum(bytes) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM b),
g AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence ORDER BY i) AS k FROM g),
p AS (SELECT doc_id, i AS e, upto AS e_byte, (k - 1) % 30 + 1 < 30 OR dot AS whole, i - (k - 1) % 30 - 1 AS s FROM n WHERE ends OR k % 30 = 0),
q AS (SELECT p.*, upto - own AS s_byte FROM p JOIN s ON s.doc_id IS NOT DISTINCT FROM p.doc_id AND s.i = p.s + 1),
c AS (
  SELECT doc_id, 0 AS ordinal, 0::BIGINT AS o, min(e) FILTER (e >= 270) AS full_at, max(e) AS top, max(e) FILTER (whole AND e >= 256 AND e <= f) AS mark
  FROM (SELECT *, min(e) FILTER (e >= 270) OVER (PARTITION BY doc_id) AS f FROM q) GROUP BY doc_id
  UNION ALL
  SELECT doc_id, ordinal + 1, o2, min(e) FILTER (e - o2 >= 270), max(e), max(e) FILTER (whole AND e - o2 >= 256 AND e <= f)
  FROM (SELECT d.doc_id, d.ordinal, q.e, q.whole, d.o2, min(q.e) FILTER (q.e - d.o2 >= 270) OVER (PARTITION BY d.doc_id) AS f
        FROM (SELECT c.doc_id, c.ordinal, coalesce(c.mark, c.full_at) AS cut, min(q.s) AS o2 FROM c JOIN q ON q.doc_id IS NOT DISTINCT FROM c.doc_id AND q.s >= coalesce(c.mark, c.full_at) - 35
              WHERE c.full_at IS NOT NULL AND coalesce(c.mark, c.full_at) < c.top GROUP BY ALL) d
        JOIN q ON q.doc_id IS NOT DISTINCT FROM d.doc_id AND q.s >= d.o2) x
  GROUP BY doc_id, ordinal, o2)
SELECT c.doc_id, c.ordinal::INT AS ordinal, (coalesce(c.mark, c.full_at, c.top) - c.o)::INT AS n_tokens, a.s_byte::INT AS start, z.e_byte::INT AS "end",
       md5(decode(encode(d.text)[a.s_byte + 1 : z.e_byte])) AS digest
FROM c JOIN q a ON a.doc_id IS NOT DISTINCT FROM c.doc_id AND a.s = c.o JOIN q z ON z.doc_id IS NOT DISTINCT FROM c.doc_id AND z.e = coalesce(c.mark, c.full_at, c.top)
JOIN documents d ON d.doc_id IS NOT DISTINCT FROM c.doc_id
"""


@query(SENTENCES)
def chunk_sentences(spark, sf):
    """Chunks at sentence ends with their bytes in the text; a digest stands for each chunk's text."""
    out = ingest.sentence_chunks(table(spark, sf, "documents"))
    return out.select("doc_id", "ordinal", "n_tokens", "start", "end", F.md5(F.col("text").cast("binary")).alias("digest"))


STUB = r"""
WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS tok FROM documents),
d AS (SELECT tok, count(*) AS many FROM t GROUP BY tok),
h AS (SELECT tok, list_reduce(list_transform(range(length(hex(encode(tok))) // 2), lambda i: ('0x' || substr(hex(encode(tok)), (2 * i + 1)::BIGINT, 2))::UHUGEINT),
        lambda a, x: (xor(a, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT) AS h FROM d),
a AS (SELECT tok, xor(h, (k::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT) AS x FROM h, range(8) r(k)),
b AS (SELECT tok, (xor(x, x >> 33) * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM a),
c AS (SELECT tok, xor(x, x >> 33) AS x FROM b),
s AS (SELECT doc_id, (x % 64)::INT AS place, sum(CASE WHEN (x >> 32) % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS v FROM t JOIN c USING (tok) GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(v * v)::DOUBLE)::FLOAT AS norm FROM s GROUP BY doc_id)
SELECT s.doc_id, place, round((v::FLOAT / norm)::DOUBLE, 6) AS value FROM s JOIN n ON s.doc_id IS NOT DISTINCT FROM n.doc_id WHERE v <> 0
"""


@query(STUB)
def stub_embed(spark, sf):
    """The stand-in embedder's vectors, a row for each component that isn't zero."""
    each = embedding.stub_embed(table(spark, sf, "documents")).select("doc_id", F.posexplode("vector").alias("place", "v")).filter("v <> 0")
    return each.select("doc_id", "place", F.round(F.col("v").cast("double"), 6).alias("value"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS title FROM events")
def title_from_metadata(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("title"))


@query("SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script)\\b.*?</script\\s*>|<(style)\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n FROM pages")
def page_text_length(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(X.html_text(F.col("html"))).cast("long").alias("n"))


@query(HASHED + """, i AS (SELECT doc_id + CASE WHEN doc_id % 3 = 1 THEN 1000000 ELSE 0 END AS doc_id, sha256(coalesce(lang, '') || chr(0) || coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '!' END) AS content_hash FROM documents WHERE lang = 'en'),
u AS (SELECT doc_id, content_hash FROM d WHERE doc_id NOT IN (SELECT doc_id FROM i) UNION ALL SELECT doc_id, content_hash FROM i)
SELECT count(*) AS n_docs, count(*) FILTER (d.doc_id IS NULL) AS n_new, count(*) FILTER (d.content_hash <> u.content_hash) AS n_changed FROM u LEFT JOIN d USING (doc_id)""")
def upsert_count(spark, sf):
    """A third of a tenant's documents come again as they were, a third changed, and a third under new ids."""
    d = hashed(spark, sf).select("doc_id", "content_hash")
    again = chunks(spark, sf).filter("tenant_id = 'en'").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, "").otherwise("!")))
    again = ingest.hashed(again).select((F.col("doc_id") + F.when(F.col("doc_id") % 3 == 1, 1_000_000).otherwise(0)).alias("doc_id"), "content_hash")
    after = ingest.upsert(d, again, "doc_id").join(d.withColumnRenamed("content_hash", "was"), "doc_id", "left")
    return after.agg(F.count("*").alias("n_docs"), F.count_if(F.col("was").isNull()).alias("n_new"), F.count_if(F.col("was") != F.col("content_hash")).alias("n_changed"))


# Lifecycle


def delete_sql(where: str) -> str:
    return f"SELECT c AS n_chunks, c AS n_docs, f AS n_feedback, 2 * c + f AS total FROM (SELECT (SELECT count(*) FROM documents WHERE {where}) AS c, (SELECT count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE {where})) AS f)"


def deletion(spark, sf, where: Column) -> DataFrame:
    c = chunks(spark, sf)
    return lifecycle.delete_counts(c, c, feedback(spark, sf), where)


@query(delete_sql("doc_id = 17"))
def delete_doc_counts(spark, sf):
    return deletion(spark, sf, F.col("doc_id") == 17)


@query(delete_sql("lang = 'fr'"))
def delete_tenant_counts(spark, sf):
    return deletion(spark, sf, F.col("tenant_id") == "fr")


@query("SELECT doc_id, lang, source FROM documents WHERE NOT coalesce(lang = 'en' AND source = 'src0', false)")
def delete_workspace_survivors(spark, sf):
    return lifecycle.survivors(chunks(spark, sf), (F.col("tenant_id") == "en") & (F.col("workspace_id") == WORKSPACE)).select("doc_id", F.col("tenant_id").alias("lang"), "source")


def log(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT event_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 15 DAY")
def retention_expired(spark, sf):
    return lifecycle.expired(log(spark, sf), NOW, 15, "ts").select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 15 DAY OR ts IS NULL")
def retention_survivors(spark, sf):
    return lifecycle.unexpired(log(spark, sf), NOW, 15, "ts").select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE event_id % 10 = 0 OR ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY OR ts IS NULL")
def audit_sweep(spark, sf):
    """Events as JSON lines, every tenth broken off in the middle: broken lines stay."""
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "event_type"))
    lines = log(spark, sf).select("event_id", F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 12)).otherwise(line).alias("line"))
    return lifecycle.sweep_lines(lines, NOW, 20).select("event_id")


@query("SELECT event_type, count(*) AS n_rows, count(*) FILTER (ts < TIMESTAMP '2024-01-31' - INTERVAL 15 DAY) AS n_expired, count(*) FILTER (ts < TIMESTAMP '2024-01-31' - INTERVAL 15 DAY) > 0 AS compact FROM events GROUP BY event_type")
def lazy_compact_decision(spark, sf):
    return lifecycle.compact_decision(log(spark, sf), NOW, 15, "event_type", "ts")


@query("""WITH p AS (SELECT CASE WHEN p_partkey % 11 <> 0 THEN p_size % 60 END AS was, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 7 % 60 END AS days FROM part),
q AS (SELECT coalesce(was, 30) AS was, coalesce(days, 30) AS days FROM p)
SELECT CASE WHEN was = days THEN 'none' WHEN days = 0 THEN 'disable' WHEN was = 0 THEN 'tighten' WHEN days > was THEN 'relax' ELSE 'tighten' END AS change, count(*) AS n FROM q GROUP BY ALL""")
def retention_change(spark, sf):
    """Days of a policy before and after, each given or by default."""
    days = lambda size, skip: F.when(F.col("p_partkey") % skip != 0, size % 60)
    change = lifecycle.retention_change(days(F.col("p_size"), 11), days(F.col("p_size") * 7, 7))
    return evaluation.counts_by(table(spark, sf, "part").select(change.alias("change")), "change")


@query("SELECT e.event_id, e.event_type FROM events e LEFT JOIN (SELECT event_type, CAST(count(*) % 40 AS INT) AS days FROM events WHERE event_type <> 'click' GROUP BY event_type) p USING (event_type) WHERE coalesce(p.days, 30) > 0 AND e.ts < TIMESTAMP '2024-01-31' - to_days(coalesce(p.days, 30))")
def retention_all_tenants(spark, sf):
    """A policy for each tenant (here: kind of event) but one, which follows the default."""
    policy = table(spark, sf, "events").filter("event_type <> 'click'").groupBy(F.col("event_type").alias("tenant")).agg((F.count("*") % 40).alias("days"))
    return lifecycle.expired_by_tenant(log(spark, sf), policy, NOW, 30, "event_type", "ts").select("event_id", "event_type")


@query("SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def metadata_entries(spark, sf):
    """A row for each key of an event's metadata."""
    entries = F.explode(F.from_json("props", "map<string,string>"))
    return table(spark, sf, "events").select("event_id", entries.alias("key", "value"))


# Statistics and export


@query("SELECT (SELECT count(*) FROM documents) AS n_chunks, (SELECT count(*) FROM (SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)) AS n_workspaces, (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM labels) AS n_feedback")
def stats_rollup(spark, sf):
    return evaluation.stats_rollup(chunks(spark, sf), chunks(spark, sf), feedback(spark, sf))


@query("SELECT lang AS tenant_id, source AS workspace_id, count(*) AS n FROM documents GROUP BY ALL")
def chunks_by_workspace(spark, sf):
    return evaluation.counts_by(chunks(spark, sf), "tenant_id", "workspace_id")


@query("SELECT p_brand AS project_id, count(*) AS n, count(DISTINCT p_name) AS n_names FROM part GROUP BY p_brand")
def symbols_by_project(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("project_id")).agg(F.count("*").alias("n"), F.countDistinct("p_name").alias("n_names"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(value) FILTER (r = round((n - 1) * 0.5)) AS p50, max(value) FILTER (r = round((n - 1) * 0.99)) AS p99 FROM r GROUP BY event_type")
def latency_percentiles(spark, sf):
    return evaluation.nearest_rank(table(spark, sf, "events"), "event_type", "value")


@query("SELECT 'chunks' AS \"table\", count(*) AS n_rows FROM documents UNION ALL SELECT 'docs', count(*) FROM documents UNION ALL SELECT 'feedback', count(*) FROM labels")
def export_manifest(spark, sf):
    from recollect.functions.shared import shared_dir

    import uuid

    c = chunks(spark, sf)
    return files.export({"chunks": c, "docs": c.drop("text"), "feedback": feedback(spark, sf)}, f"{shared_dir(spark)}/export-{uuid.uuid4().hex}")


@query("SELECT to_json({'chunk_id': doc_id, 'tenant_id': lang, 'workspace_id': source, 'doc_id': doc_id, 'text': text, 'source': source, 'n_chars': n_chars})::VARCHAR AS line FROM documents")
def export_chunk_lines(spark, sf):
    return files.export_lines(chunks(spark, sf))


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, true AS same FROM documents")
def backup_roundtrip(spark, sf):
    key = b"0123456789abcdef0123456789abcdef"
    sealed = chunks(spark, sf).select("doc_id", "text", files.sealed(F.col("text"), key).alias("c"))
    back = F.coalesce(files.opened(F.col("c"), key), F.lit(""))
    return sealed.select("doc_id", F.md5(back.cast("binary")).alias("digest"), back.eqNullSafe(F.coalesce("text", F.lit(""))).alias("same"))


@query("SELECT 1::BIGINT AS version, count(*) AS n FROM documents WHERE lang = 'en' UNION ALL SELECT 2, count(*) FROM documents UNION ALL SELECT 3, count(*) FROM documents WHERE NOT coalesce(lang = 'fr', false)")
def version_timeline(spark, sf):
    """Append, append, delete: the chunk counts of each version, read back from the store."""
    import uuid

    from recollect.functions.shared import shared_dir
    from recollect.sources.store import Store

    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", "t")
    c = chunks(spark, sf).select(*(F.col(n).cast("string") for n in ("chunk_id", "tenant_id", "workspace_id", "doc_id", "text", "source")))
    english = F.coalesce(F.col("tenant_id") == "en", F.lit(False))
    store.append("chunks", c.filter(english))
    store.append("chunks", c.filter(~english))
    store.commit(chunks=lifecycle.survivors(store.read("chunks"), F.col("tenant_id") == "fr"))
    out = None
    for v in store.versions():
        n = store.read("chunks", v).agg(F.lit(v).cast("long").alias("version"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


# Code graph


@query("SELECT p_name AS name, p_brand AS file, p_size AS start_line, p_partkey AS id FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_size, p_partkey) = 1")
def symbol_first_definition(spark, sf):
    return code.first_definition(concepts(spark, sf))


@query("SELECT p_name AS symbol_name, p_brand || '#L' || p_size || '-L' || (p_size + 9) AS location, p_name || ' (' || p_brand || '#L' || p_size || '-L' || (p_size + 9) || ')' AS display FROM part")
def symbols_sorted(spark, sf):
    c = concepts(spark, sf)
    end = F.col("start_line") + 9
    out = c.select(F.col("name").alias("symbol_name"), F.format_string("%s#L%d-L%d", "file", "start_line", end).alias("location"), X.node_display(F.col("name"), F.col("file"), F.col("start_line"), end).alias("display"))
    return out.orderBy("symbol_name", "location")


@query("""WITH c AS (SELECT p_partkey AS id, lower(p_name) AS n, lower(p_brand || '.' || p_name) AS q, lower(p_type) AS s FROM part),
b AS (SELECT id, CASE WHEN n = 'small' THEN 0 WHEN starts_with(n, 'small') THEN 1 WHEN contains(n, 'small') THEN 2 WHEN contains(q, 'small') THEN 3 WHEN contains(s, 'small') THEN 4 END AS bucket FROM c)
SELECT id, bucket FROM b WHERE bucket IS NOT NULL ORDER BY bucket, id LIMIT 100""")
def code_literal_search(spark, sf):
    return code.literal_search(concepts(spark, sf), "small", 100)


def sited(spark, sf) -> DataFrame:
    return concepts(spark, sf).withColumn("end_line", F.col("start_line") + 9)


def symbols(spark, sf) -> DataFrame:
    """The symbols of all projects (here: brands)."""
    return code.symbol_rows(sited(spark, sf), "t", "", NOW).drop("project_id").withColumn("project_id", F.regexp_extract("location", "^(.*)#L", 1))


@query("SELECT p_name AS symbol_name, p_brand AS project_id, p_brand || '#L' || p_size || '-L' || (p_size + 9) AS location FROM part WHERE p_brand <> 'Brand#8' UNION ALL SELECT upper(p_name), 'Brand#8', p_brand || '#L' || p_size || '-L' || (p_size + 9) FROM part WHERE p_brand = 'Brand#8' AND p_size > 25")
def symbols_replaced(spark, sf):
    """A project is indexed again with fewer concepts, and other names."""
    again = sited(spark, sf).filter("file = 'Brand#8' and start_line > 25").withColumn("name", F.upper("name"))
    return code.replace_project(symbols(spark, sf), "Brand#8", code.symbol_rows(again, "t", "Brand#8", NOW)).select("symbol_name", "project_id", "location")


@query("SELECT p_name AS symbol_name, split_part(p_type, ' ', 1) AS kind, p_type AS signature, p_brand || '#L' || p_size || '-L' || (p_size + 9) AS location FROM part WHERE p_brand = 'Brand#8' AND p_name = 'red plate'")
def symbol_lookup(spark, sf):
    return code.lookup_symbols(symbols(spark, sf), "Brand#8", "red plate").select("symbol_name", "kind", "signature", "location")


EDGES = "e AS (SELECT DISTINCT l_suppkey % 50 AS source, (7 * l_partkey + l_suppkey) % 211 AS target FROM lineitem WHERE l_suppkey % 50 <> (7 * l_partkey + l_suppkey) % 211)"


@query(f"WITH {EDGES} SELECT source, target FROM e")
def graph_edges(spark, sf):
    return graph.build_edges(call_edges(spark, sf))


def start(spark, node: int) -> DataFrame:
    return spark.range(node, node + 1).select(F.col("id").alias("node"))


@query(f"WITH {EDGES}, one AS (SELECT source AS node FROM e WHERE target = 7), two AS (SELECT e.source AS node FROM e JOIN one ON e.target = one.node) SELECT DISTINCT node FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE node <> 7")
def callers_depth2(spark, sf):
    return graph.reach(graph.reversed_edges(graph.build_edges(call_edges(spark, sf))), start(spark, 7), 2)


@query(f"WITH {EDGES}, one AS (SELECT target AS node FROM e WHERE source = 3), two AS (SELECT e.target AS node FROM e JOIN one ON e.source = one.node) SELECT DISTINCT node FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE node <> 3")
def callees_depth2(spark, sf):
    return graph.reach(graph.build_edges(call_edges(spark, sf)), start(spark, 3), 2)


@query(f"WITH RECURSIVE {EDGES}, r AS (SELECT source AS node FROM e WHERE target = 7 UNION SELECT e.source FROM e JOIN r ON e.target = r.node) SELECT node FROM r WHERE node <> 7")
def impact_closure(spark, sf):
    return graph.reach(graph.reversed_edges(graph.build_edges(call_edges(spark, sf))), start(spark, 7))


@query("WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS source, o_custkey // 2 AS target FROM orders), r AS (SELECT source AS node FROM e WHERE target = 1 UNION SELECT e.source FROM e JOIN r ON e.target = r.node) SELECT node FROM r WHERE node <> 1")
def impact_deep(spark, sf):
    """A deep graph: customers with orders call the customer of half their number."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("source"), F.expr("o_custkey div 2").alias("target"))
    return graph.reach(graph.reversed_edges(graph.build_edges(o)), start(spark, 1))


SHOWN = "p_name || ' (' || p_brand || '#L' || p_size || '-L' || (p_size + 9) || ')'"


@query(f"WITH {EDGES}, s AS (SELECT p_partkey AS node FROM part WHERE p_name = 'red plate'), one AS (SELECT source AS node FROM e WHERE target IN (SELECT node FROM s)), two AS (SELECT e.source AS node FROM e JOIN one ON e.target = one.node) SELECT p_partkey AS id, {SHOWN} AS display FROM part WHERE p_partkey IN (SELECT node FROM one UNION SELECT node FROM two) AND p_partkey NOT IN (SELECT node FROM s)")
def callers_by_name(spark, sf):
    """Everything that leads to any definition of a name in two calls."""
    return code.related(graph.build_edges(call_edges(spark, sf)), sited(spark, sf), "red plate", 2)


@query(f"WITH {EDGES}, s AS (SELECT p_partkey AS node FROM part WHERE p_name = 'small widget') SELECT p_partkey AS id, {SHOWN} AS display FROM part WHERE p_partkey IN (SELECT target FROM e WHERE source IN (SELECT node FROM s)) AND p_partkey NOT IN (SELECT node FROM s)")
def callees_by_name(spark, sf):
    return code.related(graph.build_edges(call_edges(spark, sf)), sited(spark, sf), "small widget", 1, callers=False)


@query("""WITH c AS (SELECT p_partkey AS id, p_name AS name, split_part(p_type, ' ', 1) AS kind, p_brand AS file, lower(p_name) AS n, lower(p_brand || '.' || p_name) AS q, lower(p_type) AS s FROM part),
b AS (SELECT *, CASE WHEN n = 'ring' THEN 0 WHEN starts_with(n, 'ring') THEN 1 WHEN contains(n, 'ring') THEN 2 WHEN contains(q, 'ring') THEN 3 WHEN contains(s, 'ring') THEN 4 END AS bucket FROM c)
SELECT row_number() OVER (ORDER BY bucket, id)::INT AS place, id, name, kind, file FROM b WHERE bucket IS NOT NULL ORDER BY place LIMIT 100""")
def code_search_without_vectors(spark, sf):
    """Code search falls back to literal matches."""
    return summary.search(concepts(spark, sf), "ring", 100)


MODULES = "x AS (SELECT DISTINCT a.s_nationkey::BIGINT AS source, b.s_nationkey::BIGINT AS target FROM (SELECT l_suppkey AS s, (7 * l_partkey + l_suppkey) % 97 + 1 AS t FROM lineitem) l JOIN supplier a ON a.s_suppkey = l.s JOIN supplier b ON b.s_suppkey = l.t WHERE a.s_nationkey <> b.s_nationkey)"
CLOSED = f"WITH RECURSIVE {MODULES}, p AS (SELECT source, target FROM x UNION SELECT p.source, x.target FROM p JOIN x ON p.target = x.source), c AS (SELECT a.source AS node, min(a.target) AS component FROM p a JOIN p b ON a.source = b.target AND a.target = b.source GROUP BY a.source)"


def modules_of(spark, sf):
    return graph.module_edges(graph.build_edges(supplier_edges(spark, sf)), supplier_modules(spark, sf))


@query(f"WITH {MODULES} SELECT source, target FROM x")
def module_edges(spark, sf):
    return modules_of(spark, sf).orderBy("source", "target")


@query(CLOSED + " SELECT node, component FROM c")
def module_cycle_members(spark, sf):
    return graph.cycle_members(modules_of(spark, sf))


#: Breadth-first from the smallest member of each component; no path between the 25 modules takes 30 steps.
CYCLES = CLOSED + """, i AS (SELECT DISTINCT a.component AS k, x.source, x.target FROM x JOIN c a ON x.source = a.node JOIN c b ON x.target = b.node AND a.component = b.component),
l AS (SELECT DISTINCT k, k AS node, 0 AS step FROM i UNION SELECT l.k, i.target, l.step + 1 FROM l JOIN i ON l.k = i.k AND l.node = i.source WHERE l.step < 30 AND i.target <> l.k),
d AS (SELECT k, node, min(step) AS step FROM l GROUP BY k, node),
u AS (SELECT i.k, i.target AS node, min(i.source) AS parent FROM i JOIN d a ON a.k = i.k AND a.node = i.source JOIN d b ON b.k = i.k AND b.node = i.target WHERE b.step = a.step + 1 GROUP BY i.k, i.target),
z AS (SELECT d.k, d.node FROM d JOIN i ON i.k = d.k AND i.source = d.node AND i.target = d.k QUALIFY row_number() OVER (PARTITION BY d.k ORDER BY d.step, d.node) = 1),
w AS (SELECT k, node AS top, [node, k] AS path FROM z UNION ALL SELECT w.k, u.parent, list_concat([u.parent], w.path) FROM w JOIN u ON u.k = w.k AND u.node = w.top),
o AS (SELECT k AS component, array_to_string(path, ' -> ') AS path FROM w WHERE top = k)"""


@query(CYCLES + " SELECT component, path FROM o")
def cycle_paths(spark, sf):
    edges = modules_of(spark, sf)
    found = graph.cycle_paths(edges, graph.cycle_members(edges))
    return found.select("component", F.array_join(F.col("path").cast("array<string>"), " -> ").alias("path"))


@query(CYCLES + " SELECT 0 AS part, source || ' -> ' || target AS line FROM x UNION ALL SELECT 1, 'cycle: ' || path FROM o")
def dependencies(spark, sf):
    edges = modules_of(spark, sf)
    return graph.dependency_lines(edges, graph.cycle_paths(edges, graph.cycle_members(edges)))


@query(f"WITH {EDGES} SELECT node, count(*) AS n_edges FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) WHERE node NOT IN (SELECT s_suppkey FROM supplier) GROUP BY node")
def graph_dangling(spark, sf):
    return graph.dangling(graph.build_edges(call_edges(spark, sf)), supplier_modules(spark, sf))


@query(f"WITH {EDGES} SELECT source, list_sort(list(target)) AS targets FROM e GROUP BY source")
def graph_adjacency(spark, sf):
    return graph.adjacency(graph.build_edges(call_edges(spark, sf)))


@query("SELECT split_part(p_type, ' ', 1) AS kind, count(*) AS n FROM part GROUP BY 1")
def kind_counts(spark, sf):
    return code.kind_counts(concepts(spark, sf))


@query("SELECT (7 * l_partkey + l_suppkey) % 211 AS target, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, target LIMIT 5")
def fan_in_top5(spark, sf):
    return graph.fan_in(call_edges(spark, sf), 5)


@query("SELECT l_suppkey % 50 AS source, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def call_sites_top5(spark, sf):
    return graph.call_sites(call_edges(spark, sf), 5)


# Evaluation


@query(BATCH + ", g AS (SELECT h.query_id, min(h.rank) AS first FROM h JOIN documents d ON d.doc_id = h.chunk_id JOIN benchmark b ON b.item_id = h.query_id WHERE contains(d.text, b.text) GROUP BY h.query_id) SELECT count(*) AS n_queries, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg((first IS NOT NULL)::INT), 6) AS recall FROM (SELECT DISTINCT item_id AS query_id FROM benchmark) LEFT JOIN g USING (query_id)")
def ir_mrr_recall_at5(spark, sf):
    """A hit is relevant if it contains the query's passage. Hits are saved, so that their size is known before they meet the texts: where they are few, no text moves."""
    from recollect.functions.shared import save

    hits = save(batch_hits(spark, sf), "hits")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    relevant = hits.join(chunks(spark, sf).select("chunk_id", "text"), "chunk_id").join(asked, "query_id").filter(F.contains("text", "passage"))
    return evaluation.mrr_recall(hits, asked, relevant)


# Summaries and logs


@query(CLOSED + """, k AS (SELECT split_part(p_type, ' ', 1) AS item, count(*) AS n FROM part GROUP BY 1),
i AS (SELECT ((7 * l_partkey + l_suppkey) % 211)::VARCHAR AS item, count(*) AS n FROM lineitem GROUP BY (7 * l_partkey + l_suppkey) % 211 ORDER BY n DESC, (7 * l_partkey + l_suppkey) % 211 LIMIT 5),
o AS (SELECT (l_suppkey % 50)::VARCHAR AS item, count(*) AS n FROM lineitem GROUP BY l_suppkey % 50 ORDER BY n DESC, l_suppkey % 50 LIMIT 5)
SELECT 'kind' AS section, item, n FROM k UNION ALL SELECT 'imported', item, n FROM i UNION ALL SELECT 'calling', item, n FROM o UNION ALL SELECT 'cycle', node::VARCHAR, 1 FROM c""")
def architecture_summary(spark, sf):
    return summary.architecture(concepts(spark, sf), call_edges(spark, sf), call_edges(spark, sf), modules_of(spark, sf))


@query(f"""WITH {EDGES} SELECT '{{"source":' || source || ',"target":' || target || '}}' AS line FROM e""")
def graph_dump(spark, sf):
    return summary.dump(graph.build_edges(call_edges(spark, sf)))


SEMANTIC = STUB[: STUB.index("SELECT s.doc_id, place")].replace("SELECT doc_id, unnest", "SELECT id AS doc_id, unnest").replace("FROM documents)", "FROM texts)").replace("WITH t AS", """WITH texts AS (
  SELECT p_partkey AS id, coalesce(p_name, '') || ' ' || coalesce(p_type, '') AS text FROM part UNION ALL SELECT NULL, 'small ring'),
t AS""", 1)


@query(SEMANTIC + """, v AS (SELECT s.doc_id, place, (v::FLOAT / norm)::DOUBLE AS x FROM s JOIN n ON s.doc_id IS NOT DISTINCT FROM n.doc_id),
l AS (SELECT doc_id, sqrt(sum(x * x)) AS own FROM v GROUP BY doc_id),
k AS (SELECT a.doc_id AS id, sum(a.x * b.x) AS dot FROM v a JOIN v b USING (place) WHERE a.doc_id IS NOT NULL AND b.doc_id IS NULL GROUP BY a.doc_id)
SELECT id, round(dot / (own * (SELECT own FROM l WHERE doc_id IS NULL)), 6) AS score FROM k JOIN l ON l.doc_id = k.id ORDER BY score DESC, id LIMIT 20""")
def code_semantic_search(spark, sf):
    return summary.semantic_search(concepts(spark, sf), "small ring", 20)


@query(WINDOWS.replace("FROM documents)", "FROM (SELECT min(doc_id::VARCHAR) AS doc_id, text FROM documents WHERE regexp_matches(text, '\\S') GROUP BY text))") + """, d AS (SELECT text, regexp_matches(coalesce(text, ''), '\\S') AS good FROM documents),
s AS (SELECT count(*) FILTER (good) AS good, count(DISTINCT text) FILTER (good) AS once, count(*) FILTER (NOT good) AS blank FROM d),
k AS (SELECT count(*) AS n, count(DISTINCT array_to_string(p, ' ')) AS once FROM p)
SELECT 'documents_total' AS name, 'status="ingested"' AS labels, once::DOUBLE AS value FROM s UNION ALL SELECT 'documents_total', 'status="duplicate"', good - once FROM s UNION ALL SELECT 'documents_total', 'status="EMPTY_TEXT"', blank FROM s
UNION ALL SELECT 'documents_total', 'status="RESOURCE_EXHAUSTED"', 0 UNION ALL SELECT 'chunks_total', '', n FROM k UNION ALL SELECT 'embeddings_total', '', once FROM k UNION ALL SELECT 'expired_total', '', n FROM k
UNION ALL SELECT 'operations_total', 'action="' || a || '",outcome="ok"', 1 FROM (SELECT unnest(['ingest', 'search', 'sweep']) AS a)
UNION ALL SELECT 'operation_seconds_count', 'action="' || a || '"', 1 FROM (SELECT unnest(['ingest', 'search', 'sweep']) AS a)""")
def metrics_series(spark, sf):
    """All documents ingested, one search and a sweep that drops everything: the counters that the jobs themselves took on the way."""
    import uuid

    from recollect.functions.shared import shared_dir
    from recollect.jobs.engine import Engine
    from recollect.sources import metrics

    e = Engine(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}", "t")
    e.ingest(table(spark, sf, "documents").select("doc_id", "text"), "w", "me", "2024-01-01 00:00:00")
    e.search(QUERY, "w").count()
    e.sweep("2025-01-01 00:00:00")
    e.metrics.flush("2025-01-01 00:00:00")
    return metrics.series(metrics.read(spark, e.metrics.path)).filter("name not in ('operation_seconds_bucket', 'operation_seconds_sum')")


@query("SELECT event_type AS action, CASE WHEN value < 10 THEN 'error' ELSE 'ok' END AS outcome, count(*) AS n FROM events GROUP BY ALL")
def audit_outcomes(spark, sf):
    """Events written as an audit log, read back and counted."""
    import uuid

    from recollect.functions.shared import shared_dir

    path = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    e = table(spark, sf, "events")
    audit.record(e.select("ts", F.lit("t").alias("tenant_id"), F.col("event_type").alias("action"), F.when(F.col("value") < 10, "error").otherwise("ok").alias("outcome")), path)
    return audit.outcome_counts(audit.read(spark, path))
