"""The operations of the memory service as batch jobs over one tenant's store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.shared import save
from recollect.functions.text import content_hash, is_source_label
from recollect.jobs.indexing import StoredIndex
from recollect.operators import code, context, embedding, fusion, graph, ignore, ingest, lexical, lifecycle, ports, scope, summary, vector
from recollect.sources import config, files
from recollect.sources.metrics import Metrics
from recollect.sources.store import Store


class NotFound(LookupError):
    """NOT_FOUND: no such chunk or document in the tenant."""


#: What an ingest says of a document.
STATUSES = ("ingested", "duplicate", "EMPTY_TEXT", "RESOURCE_EXHAUSTED")


@dataclass
class Engine:
    """One tenant's memory. now is given to every job that stamps or compares times."""

    spark: SparkSession
    root: str
    tenant: str
    embedder: ports.Embedder = embedding.STUB
    scorer: ports.Scorer | None = None  # None: the share of the query's tokens that a text has

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root, self.tenant)
        self.texts = StoredIndex(self.store)
        self.cache = ports.EmbeddingCache(self.spark, f"{self.store.home}/cache", self.embedder)
        self.metrics = Metrics(self.spark, f"{self.store.home}/metrics")
        #: Texts that the last ingest embedded, and searches that kept the fused order although reranking was asked for.
        self.embedded = self.degraded = 0

    def _chunks(self, workspace: str | None = None) -> DataFrame:
        return scope.scoped(self.store.read("chunks"), self.tenant, workspace)

    # Ingest

    def ingest(self, docs: DataFrame, workspace: str, agent: str, now: str, source: str = "text", on_conflict: str = "append") -> DataFrame:
        """Ingest docs (doc_id, text, optional metadata JSON) in one commit of chunks and docs. Returns doc_id, status, existing_id.

        Blank texts and those of more than ingest.QUOTA chunks are refused. Content that the tenant already holds, in any workspace and with chunks still there, is a
        duplicate and writes nothing. on_conflict says what happens to the chunks of a known doc_id with new content:
        append keeps them, replace drops them.
        """
        with self.metrics.timed("ingest"):
            return self._ingest(docs, workspace, agent, now, source, on_conflict)

    def _ingest(self, docs: DataFrame, workspace: str, agent: str, now: str, source: str, on_conflict: str) -> DataFrame:
        if on_conflict not in ("append", "replace"):
            raise ValueError("on_conflict must be append or replace")
        if not docs.sparkSession.range(1).select(is_source_label(F.lit(source))).first()[0]:
            raise ValueError(f"INVALID_SOURCE: {source}")
        meta = F.col("metadata") if "metadata" in docs.columns else F.lit(None).cast("string")
        rows = docs.select(F.col("doc_id").cast("string"), "text", F.get_json_object(meta, "$.title").alias("title"))
        rows = rows.withColumn("content_hash", content_hash(F.lit(self.tenant), F.col("text")))
        # ids and hashes are judged; only the texts of what is new move
        asked = rows.select("doc_id", "content_hash", F.when(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)), "EMPTY_TEXT").when(ingest.over_quota(F.col("text")), "RESOURCE_EXHAUSTED").alias("_refused"))
        stored_chunks = self._chunks()
        firsts = asked.filter("_refused is null").groupBy("content_hash").agg(F.min("doc_id").alias("first"))
        held = self.store.read("docs").select("content_hash", "doc_id", "created_at").join(firsts.select("content_hash"), "content_hash", "left_semi")
        alive = ingest.first_stored(held.join(stored_chunks.select("doc_id"), "doc_id", "left_semi"))
        judged = asked.join(firsts.join(alive, "content_hash", "left"), "content_hash", "left")
        good = F.col("_refused").isNull()
        fresh = good & F.col("known").isNull() & (F.col("doc_id") == F.col("first"))
        judged = judged.select("doc_id", "content_hash", fresh.alias("_fresh"), F.when(~good, F.col("_refused")).when(fresh, "ingested").otherwise("duplicate").alias("status"), F.when(good & ~fresh, F.coalesce("known", "first")).alias("existing_id"))
        judged = self.metrics.observed(judged, "documents_total", "status", **{s: F.count_if(F.col("status") == s) for s in STATUSES})
        result = save(judged, "report")  # fixed before the store changes beneath it
        accepted = result.filter("_fresh").groupBy("doc_id").agg(F.min("content_hash").alias("content_hash"))
        new = rows.join(accepted, ["doc_id", "content_hash"], "left_semi").dropDuplicates(["doc_id"])
        stamp = {"tenant_id": F.lit(self.tenant), "workspace_id": F.lit(workspace), "agent_id": F.lit(agent), "source": F.lit(source), "created_at": F.lit(now).cast("timestamp")}
        cut = ingest.chunk_ids(ingest.windows(new)).withColumns(stamp).withColumn("embedding_model_version", F.lit(self.embedder.version))
        chunks, self.embedded = self.cache.add(cut)
        self.metrics.count("embeddings_total", self.embedded)
        chunks = self.metrics.observed(chunks, "chunks_total", n=F.count("*"))
        added = {"docs": new.select("doc_id", "title", "content_hash").withColumns(stamp)}  # of a known document the newest row counts
        if on_conflict == "append":
            self.store.commit(added=added | {"chunks": chunks})
        else:
            old = stored_chunks.join(accepted.select("doc_id"), "doc_id", "left_anti")
            self.store.commit(chunks=old.unionByName(chunks, allowMissingColumns=True), added=added)
        return result.select("doc_id", "status", "existing_id")

    def ingest_files(self, folder: str, workspace: str, agent: str, now: str) -> DataFrame:
        """Bulk ingest of a folder; the report has file, status, reason."""
        read = files.bulk(self.spark, folder)
        self.ingest(read.filter("status = 'ok'").select(F.sha2("file", 256).alias("doc_id"), "text"), workspace, agent, now)
        return read.select("file", "status", "reason")

    # Retrieve

    def index(self, version: int | None = None) -> lexical.Index:
        """The inverted index of a version's chunks, by default the newest's. Only rows that no earlier version indexed are tokenised."""
        if not self.store.versions():
            raise NotFound("NOT_FOUND: the store is empty")
        return self.texts.at(version)

    def prune(self) -> int:
        """Drop all versions but the newest, with their folders and indexes. Returns the bytes freed in the tables."""
        freed = self.store.prune()
        self.texts.prune()
        return freed

    def search(self, query: str, workspace: str, top_k: int = 20, hybrid: bool = False, rerank: bool = False, doc_id: str | None = None, source: str | None = None, rrf_k: float = 60.0, filter_mode: str = "post") -> DataFrame:
        """chunk_id and score, best first. A blank query gives none; rerank applies to hybrid search only."""
        with self.metrics.timed("search"):
            return self._search(query, workspace, top_k, hybrid, rerank, doc_id, source, rrf_k, filter_mode)

    def _search(self, query: str, workspace: str, top_k: int, hybrid: bool, rerank: bool, doc_id: str | None, source: str | None, rrf_k: float, filter_mode: str) -> DataFrame:
        k = scope.top_k_or_default(top_k)
        chunks = self._chunks(workspace)
        keep: Column | None = None
        for name, value in (("doc_id", doc_id), ("source", source)):
            if value is not None:
                keep = (F.col(name) == value) if keep is None else keep & (F.col(name) == value)
        inside = F.col("workspace_id") == workspace
        if not self.store.versions():
            return self.spark.createDataFrame([], "chunk_id string, score double")
        index = self.index()
        if not hybrid or not query.strip():
            return lexical.search(index, query, k, keep=inside if keep is None else inside & keep)
        legs = lexical.search(index, query, k, keep=inside), vector.knn(chunks, self.embedder.one(query), k)
        hits = fusion.hybrid(*legs, max(k, 10) if rerank else k, chunks, rrf_k, keep, filter_mode)
        if not rerank:
            return hits
        if self.scorer is None:
            return fusion.rerank(hits, chunks, query, k)
        out = ports.rerank(hits, chunks, query, k, self.scorer)
        self.degraded += out.degraded is not None
        if out.degraded is not None:
            self.metrics.count("degraded_total", reason=out.degraded)
        return out.hits

    def hits(self, found: DataFrame) -> DataFrame:
        """Found chunks with text and provenance."""
        return found.join(scope.provenance(self._chunks()), "chunk_id")

    def get_chunk(self, chunk_id: str) -> DataFrame:
        return scope.provenance(scope.lookup(self._chunks(), "chunk_id", chunk_id))

    def context_fit(self, query: str, workspace: str, budget: int, top_k: int = 20, hybrid: bool = False) -> DataFrame:
        """chunk_id, value, n_tokens, running: what to put into a prompt of budget tokens."""
        if not self.store.versions():
            return self.spark.createDataFrame([], "chunk_id string, value double, n_tokens int, running long")
        sizes = self.index().lengths.select("chunk_id", F.col("dl").alias("n_tokens"))
        return context.fit(self.search(query, workspace, top_k, hybrid).join(sizes, "chunk_id"), budget, context.feedback_bonus(self.store.read("feedback")))

    # Feedback and lifecycle

    def feedback(self, chunk_id: str, useful: bool, agent: str, now: str, comment: str | None = None) -> None:
        row = scope.lookup(self._chunks(), "chunk_id", chunk_id)
        if row.isEmpty():
            raise NotFound(f"CHUNK_NOT_FOUND: {chunk_id}")
        self.store.append("feedback", row.select("chunk_id", "tenant_id", "workspace_id", F.lit(agent).alias("agent_id"), F.lit(1.0 if useful else 0.0).cast("float").alias("score"), F.lit(comment).cast("string").alias("comment"), F.lit(now).cast("timestamp").alias("created_at")))

    def delete(self, chunk_id: str | None = None, doc_id: str | None = None, workspace: str | None = None) -> dict[str, int]:
        """Delete one chunk (its feedback stays), one document or one workspace. Returns the removed rows."""
        given = [(n, v) for n, v in (("chunk_id", chunk_id), ("doc_id", doc_id), ("workspace_id", workspace)) if v is not None]
        if len(given) != 1:
            raise ValueError("give one of chunk_id, doc_id and workspace")
        (name, value), chunks, docs, marks = given[0], self._chunks(), self.store.read("docs"), self.store.read("feedback")
        where = F.col(name) == value
        if name != "workspace_id" and chunks.filter(where).isEmpty():
            raise NotFound(f"NOT_FOUND: {value}")
        if name == "chunk_id":
            self.store.commit(chunks=lifecycle.survivors(chunks, where))
            return {"n_chunks": 1, "n_docs": 0, "n_feedback": 0}
        counts = lifecycle.delete_counts(chunks, docs, marks, where).first().asDict()
        self.store.commit(chunks=lifecycle.survivors(chunks, where), docs=lifecycle.survivors(docs, where), feedback=lifecycle.surviving_feedback(marks, chunks, where))
        return {k: counts[k] for k in ("n_chunks", "n_docs", "n_feedback")}

    def delete_tenant(self) -> dict[str, int]:
        """Empty all four tables of the tenant in one version; older versions stay until prune. Returns the removed rows."""
        tables = {t: self.store.read(t) for t in ("chunks", "docs", "feedback", "symbols")}
        removed = {f"n_{t}": df.count() for t, df in tables.items()}
        self.store.commit(**{t: df.limit(0) for t, df in tables.items()})
        return removed

    # Code projects: concepts has id, name, qualified_name, signature, description, kind, file, start_line, end_line

    def index_project(self, project: str, concepts: DataFrame, calls: DataFrame, now: str) -> dict[str, int]:
        """Store a project's concepts, resolved call edges and vectors, and replace its symbols. Indexing again leaves nothing old.

        calls: source and target ids as they were found; those to or from unknown concepts and loops are no edges. Without
        concepts nothing is written.
        """
        concepts = save(concepts, "concepts")
        n = concepts.count()
        if not n:
            return {"n_concepts": 0, "n_edges": 0}
        home = f"{self.store.home}/projects/{project}"
        edges = graph.build_edges(calls.select("source", "target").join(concepts.select(F.col("id").alias("source")).distinct(), "source", "left_semi"), concepts).select("source", "target")
        texts = concepts.select("id", code.semantic_text(F.col("name"), F.col("signature")).alias("text"))
        for name, df in (("concepts", concepts), ("edges", edges), ("vectors", self.embedder.vectors(texts).select("id", "vector"))):
            df.write.mode("overwrite").parquet(f"{home}/{name}")
        rows = code.symbol_rows(concepts, self.tenant, project, now)
        self.store.commit(symbols=code.replace_project(self.store.read("symbols"), project, rows))
        return {"n_concepts": n, "n_edges": self.project_table(project, "edges").count()}

    def index_sources(self, project: str, sources: DataFrame, now: str) -> dict[str, int]:
        """index_project on source files (file, text) without what their ignore rules leave out; calls go to the first definition of a name.

        Also says how many files were scanned, and how many of them skipped as of another language or malformed.
        """
        scanned = ignore.scan(sources)
        found = save(code.python_concepts(scanned), "sources")
        concepts = found.filter("kind <> 'skipped'").withColumn("description", F.lit(""))
        firsts = code.first_definition(concepts).select("name", F.col("id").alias("target"))
        calls = concepts.select(F.col("id").alias("source"), F.explode("calls").alias("name")).join(firsts, "name").select("source", "target")
        counts = {"n_files": scanned.select("file").distinct().count(), "n_skipped": found.filter("kind = 'skipped'").count()}
        return counts | self.index_project(project, concepts.drop("calls"), calls, now)

    def project_table(self, project: str, name: str) -> DataFrame | None:
        """concepts, edges or vectors of a project; None where there is no such table."""
        path = f"{self.store.home}/projects/{project}/{name}"
        return self.spark.read.parquet(path) if self.store._fs.exists(self.store._path(f"{path}/_SUCCESS")) else None

    def _project(self, project: str, name: str) -> DataFrame:
        found = self.project_table(project, name)
        if found is None:
            raise NotFound(f"NOT_FOUND: project {project}")
        return found

    def search_code(self, project: str, query: str, k: int = 20) -> DataFrame:
        return summary.search(self._project(project, "concepts"), query, k, self.project_table(project, "vectors"))

    def callers(self, project: str, name: str, depth: int | None = 1) -> DataFrame:
        return code.related(self._project(project, "edges"), self._project(project, "concepts"), name, depth)

    def sweep(self, now: str, days: int | None = None) -> int:
        """Drop chunks older than days (0: off, None: as the tenant's settings say) and compact only if any were. Returns how many."""
        days = config.read(self.store).days if days is None else days
        with self.metrics.timed("sweep"):
            chunks = self._chunks()
            n = lifecycle.expired(chunks, now, days).count()
            if n:
                self.store.commit(chunks=lifecycle.unexpired(chunks, now, days))
                self.store.compact()
            self.metrics.count("expired_total", n)
            return n

    def stats(self) -> DataFrame:
        from recollect.operators.evaluation import stats_rollup

        return stats_rollup(self._chunks(), self.store.read("docs"), self.store.read("feedback"))

    def health(self) -> DataFrame:
        """One row: status, tenant, n_chunks, n_docs, n_symbols, days, audit_days and the embedder's version."""
        held = config.read(self.store)
        count = lambda name: self.store.read(name).agg(F.count("*").alias(f"n_{name}"))
        rows = count("chunks").join(F.broadcast(count("docs"))).join(F.broadcast(count("symbols")))
        return rows.select(F.lit("ok").alias("status"), F.lit(self.tenant).alias("tenant"), "*", F.lit(held.days).alias("days"), F.lit(held.audit_days).alias("audit_days"), F.lit(self.embedder.version).alias("embedder"))

    def export(self, path: str) -> DataFrame:
        return files.export({t: self.store.read(t) for t in ("chunks", "docs", "feedback")}, path)

