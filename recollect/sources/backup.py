"""Encrypted backup of a store's newest version and its restore, as Spark jobs.

Each backup has a random data key. Rows are lines sealed with it (AES-GCM) and bound to tenant and table; a manifest with the
format's version, tenant, time and row counts is sealed with it too; the data key itself lies beside them, wrapped with
the master key. The master key is never written.
"""

from __future__ import annotations

import json
import os

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recollect.functions.shared import save
from recollect.sources.store import SCHEMAS, Store

#: The layout's version; a restore refuses others.
VERSION = 1


class BackupCorrupt(ValueError):
    """BACKUP_CORRUPT: a key, manifest or row that can't be opened, or rows that are missing."""


def _seal(column: Column, key: bytes, bound: str) -> Column:
    return F.hex(F.aes_encrypt(column.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(bound.encode())))


def _open(column: Column, key: bytes, bound: str) -> Column:
    return F.aes_decrypt(F.unhex(column), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bound.encode()))


def _one(spark: SparkSession, column: Column) -> object:
    try:
        return spark.range(1).select(column.alias("v")).first()["v"]
    except PySparkException as e:
        raise BackupCorrupt("BACKUP_CORRUPT: wrong key or broken content") from e


def backup(store: Store, path: str, master_key: bytes, now: str = "") -> dict[str, int]:
    """Write a backup under path and return the rows of each table, counted while they are written. An existing one is replaced."""
    if len(master_key) not in (16, 24, 32):
        raise BackupCorrupt("BACKUP_CORRUPT: the master key must have 16, 24 or 32 bytes")
    spark, key, counts = store.spark, os.urandom(32), {}
    for name in SCHEMAS:
        seen = Observation()
        rows = store.read(name).select(F.to_json(F.struct("*")).alias("line")).observe(seen, F.count("*").alias("n"))
        rows.select(_seal(F.col("line"), key, f"{store.tenant}/{name}").alias("value")).write.mode("overwrite").text(f"{path}/{name}")
        counts[name] = seen.get["n"]
    manifest = json.dumps({"version": VERSION, "tenant": store.tenant, "created_at": now, "rows": counts})
    wrapped = _one(spark, _seal(F.lit(key), master_key, f"{store.tenant}/key"))
    for name, content in (("manifest.json", {"sealed": _one(spark, _seal(F.lit(manifest), key, f"{store.tenant}/manifest"))}), ("key.json", {"version": VERSION, "alg": "AES-GCM", "wrapped": wrapped})):
        store.delete(f"{path}/{name}")
        store.write_json(f"{path}/{name}", content)
    return counts


def read_manifest(store: Store, path: str, master_key: bytes) -> tuple[dict, bytes]:
    """A backup's manifest and data key. BACKUP_CORRUPT if they can't be opened, for a backup of another tenant too."""
    wrapped, sealed = store.read_json(f"{path}/key.json"), store.read_json(f"{path}/manifest.json")
    if not wrapped or not sealed or wrapped.get("version") != VERSION:
        raise BackupCorrupt("BACKUP_CORRUPT: no key or manifest of this version")
    key = bytes(_one(store.spark, _open(F.lit(wrapped["wrapped"]), master_key, f"{store.tenant}/key")))
    manifest = json.loads(_one(store.spark, _open(F.lit(sealed["sealed"]), key, f"{store.tenant}/manifest").cast("string")))
    if manifest["version"] != VERSION or manifest["tenant"] != store.tenant:
        raise BackupCorrupt("BACKUP_CORRUPT: another version or tenant")
    return manifest, key


def restore(store: Store, path: str, master_key: bytes) -> int:
    """Commit a backup into an empty store as one version.

    Every row is opened, bound to its tenant and table, and counted in a staging folder first; the store is touched only when all is
    right. Refuses a store with data (STORE_BUSY).
    """
    if store.versions():
        raise ValueError("STORE_BUSY: the store isn't empty")
    manifest, key = read_manifest(store, path, master_key)
    tables: dict[str, DataFrame] = {}
    for name, schema in SCHEMAS.items():
        lines, seen = store.spark.read.schema("value string").text(f"{path}/{name}"), Observation()
        opened = lines.select(F.from_json(_open(F.col("value"), key, f"{store.tenant}/{name}").cast("string"), schema).alias("row")).select("row.*")
        try:
            tables[name] = save(opened.observe(seen, F.count("*").alias("n")), f"restored-{name}")
        except PySparkException as e:
            raise BackupCorrupt(f"BACKUP_CORRUPT: {name} can't be opened") from e
        if seen.get["n"] != manifest["rows"][name]:
            raise BackupCorrupt(f"BACKUP_CORRUPT: {name} has {seen.get['n']} rows of {manifest['rows'][name]}")
    return store.commit(**tables)


def backup_count(store: Store, root: str) -> int:
    """Backups under root: its folders; 0 where it does not exist."""
    path = store._path(root)
    fs = path.getFileSystem(store.spark._jsc.hadoopConfiguration())
    return sum(1 for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else 0
