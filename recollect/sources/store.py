"""A versioned store of a tenant's tables: immutable Parquet snapshots and a manifest for each version.

A commit writes the changed tables, or the rows to append, to new folders and then publishes a manifest by rename, so that
readers see all tables of a version or none. A manifest names the folders of each table; versions share them. There is one
writer for each tenant.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "chunks": "chunk_id string, tenant_id string, workspace_id string, agent_id string, doc_id string, text string, source string, vector array<float>, embedding_model_version string, created_at timestamp",
    "docs": "doc_id string, tenant_id string, workspace_id string, agent_id string, title string, source string, created_at timestamp, content_hash string",
    "feedback": "chunk_id string, tenant_id string, workspace_id string, agent_id string, score float, comment string, created_at timestamp",
    "symbols": "symbol_name string, tenant_id string, project_id string, kind string, location string, signature string, created_at timestamp",
}

#: Tables whose newest row of a key counts.
NEWEST = {"docs": "doc_id"}


class Store:
    def __init__(self, spark: SparkSession, root: str, tenant: str):
        self.spark, self.home, self.tenant = spark, f"{root.rstrip('/')}/db/tenants/{tenant}", tenant
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.home).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.home}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def timeline(self) -> DataFrame:
        """version, published (timestamp) of the versions there are."""
        rows = [(v, self._fs.getFileStatus(self._path(f"{self.home}/manifests/v{v}.json")).getModificationTime()) for v in self.versions()]
        return self.spark.createDataFrame(rows, "version long, ms long").select("version", F.timestamp_millis("ms").alias("published"))

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """Folders of each table at a version; ValueError for one that was pruned or never was."""
        there = self.versions()
        version = version if version is not None else (there[-1] if there else 0)
        if version == 0 and not there:
            return {}
        if version not in there:
            raise ValueError(f"VERSION_NOT_FOUND: {version}")
        return self.read_json(f"{self.home}/manifests/v{version}.json")

    def read_text(self, path: str) -> str | None:
        """A small file's content; None where there is none."""
        if not self._fs.exists(self._path(path)):
            return None
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read_json(self, path: str) -> dict | None:
        text = self.read_text(path)
        return None if text is None else json.loads(text)

    def write_text(self, path: str, content: str, replace: bool = False) -> None:
        """Published by rename, so that readers see all of it or nothing. A file of that name is an error, or replaced in one step."""
        stream = self._fs.create(self._path(path + ".tmp"), True)
        stream.write(bytearray(content.encode()))
        stream.close()
        if replace:
            jvm = self.spark._jvm.org.apache.hadoop
            option = getattr(jvm.fs, "Options$Rename")
            context = jvm.fs.FileContext.getFileContext(self._path(path).toUri(), self._fs.getConf())
            options = self.spark.sparkContext._gateway.new_array(option, 1)
            options[0] = option.OVERWRITE
            context.rename(self._path(path + ".tmp"), self._path(path), options)
        elif not self._fs.rename(self._path(path + ".tmp"), self._path(path)):
            raise OSError(f"{path} could not be published")

    def write_json(self, path: str, content: dict) -> None:
        self.write_text(path, json.dumps(content))

    def names(self, folder: str) -> list[str]:
        """What lies in a folder."""
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def folders(self, table: str, version: int | None = None) -> list[str]:
        return self.manifest(version).get(table) or []

    def read_folders(self, table: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*(f"{self.home}/{f}" for f in folders))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table at a version. Of docs, which ingests only add to, the newest row of each document."""
        out = self.read_folders(table, self.folders(table, version))
        if table not in NEWEST or len(self.folders(table, version)) < 2:
            return out
        added = F.regexp_extract(F.col("_metadata.file_path"), r"/data/v(\d+)/[^/]*/[^/]*$", 1).cast("long")
        newest = out.groupBy(NEWEST[table]).agg(F.max_by(F.struct("*"), added).alias("r"))
        return newest.select("r.*")

    def commit(self, files: dict[str, int] | None = None, added: dict[str, DataFrame] | None = None, dropped: dict[str, list[str]] | None = None, **tables: DataFrame) -> int:
        """The new version after writing these tables whole, dropping folders of others and adding rows to them. files: into how many files a table goes."""
        there = self.versions()
        version, folders = (there[-1] if there else 0) + 1, self.manifest()
        for name, df in [*tables.items(), *(added or {}).items()]:
            folder = f"data/v{version}/{name}"
            out = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (f.split(" ", 1) for f in SCHEMAS[name].split(", "))))
            if files and name in files:
                out = out.repartition(files[name])
            out.write.mode("overwrite").parquet(f"{self.home}/{folder}")
            gone = (dropped or {}).get(name, [])
            folders[name] = [*(f for f in folders.get(name, []) if name not in tables and f not in gone), folder]
        self.write_json(f"{self.home}/manifests/v{version}.json", folders)
        return version

    def append(self, table: str, rows: DataFrame) -> int:
        """Writes the rows only."""
        return self.commit(added={table: rows})

    def delete_doc(self, doc_id: str) -> int:
        """Chunks, docs row and feedback of a document."""
        from recollect.operators.lifecycle import surviving_feedback, survivors

        where, chunks = F.col("doc_id") == doc_id, self.read("chunks")
        return self.commit(chunks=survivors(chunks, where), docs=survivors(self.read("docs"), where), feedback=surviving_feedback(self.read("feedback"), chunks, where))

    def compact(self, file_bytes: int = 256 << 20) -> int:
        """A new version in which folders of small (or far too large) files are one of files of about file_bytes.

        Folders whose files are of that order are kept as they are, all of them where nothing is small. Tables of which the newest row counts are rewritten whole,
        as the order of their folders matters, but only the rows that count.
        """
        changed: dict[str, tuple[list[str], DataFrame, int]] = {}
        for table, folders in self.manifest().items():
            sizes = {f: self._fs.getContentSummary(self._path(f"{self.home}/{f}")) for f in folders}
            files = {f: sum(n.startswith("part-") for n in self.names(f"{self.home}/{f}")) for f in folders}
            each = {f: sizes[f].getLength() / max(files[f], 1) for f in folders}
            small = [f for f in folders if not file_bytes / 2 <= each[f] <= 2 * file_bytes]
            small = folders if small and table in NEWEST else small
            total = sum(sizes[f].getLength() for f in small)
            if sum(files[f] for f in small) != total // file_bytes + 1:
                changed[table] = (small, self.read(table) if table in NEWEST else self.read_folders(table, small), total // file_bytes + 1)
        return self.commit(files={t: n for t, (_, _, n) in changed.items()}, added={t: df for t, (_, df, _) in changed.items()}, dropped={t: gone for t, (gone, _, _) in changed.items()})

    def prune(self) -> int:
        """Drop all versions but the newest, and folders no longer used. Returns the bytes freed."""
        there = self.versions()
        used = {f for folders in self.manifest().values() for f in folders}
        freed = 0
        for folder in {f for v in there[:-1] for folders in self.manifest(v).values() for f in folders} - used:
            path = self._path(f"{self.home}/{folder}")
            if self._fs.exists(path):
                freed += self._fs.getContentSummary(path).getLength()
                self._fs.delete(path, True)
        for v in there[:-1]:
            self._fs.delete(self._path(f"{self.home}/manifests/v{v}.json"), False)
        return freed

    def erase(self) -> None:
        self._fs.delete(self._path(self.home), True)
