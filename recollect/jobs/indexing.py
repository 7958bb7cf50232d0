"""The inverted index of a tenant's chunks, kept up with the store's versions.

An index belongs to a list of chunk folders, so versions that share their chunks share it and none is ever changed: what
was found lazily can still be read. A version that only added folders gets one more segment with their rows. One
whose chunks were rewritten is compared by id and a hash of the text: what is gone is listed as dead, what is new makes a
segment. FAN segments of like size become one. prune() drops what no kept version uses.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators import lexical
from recollect.sources.store import Store

CARRY = ("workspace_id", "doc_id", "source")


class StoredIndex:
    def __init__(self, store: Store):
        self.store, self.home, self.spark = store, f"{store.home}/index", store.spark

    def _name(self, version: int) -> str:
        return f"{self.home}/{hashlib.md5(chr(10).join(self.store.folders('chunks', version)).encode()).hexdigest()}.json"

    def manifest(self, version: int) -> dict | None:
        """folders, segments (folder to documents), dead, indexed (rows tokenised for this step); None where there is none yet."""
        return self.store.read_json(self._name(version))

    def at(self, version: int | None = None) -> lexical.Index:
        """The index of a version (by default the newest), brought up from the nearest earlier one if need be."""
        versions = self.store.versions()
        version = versions[-1] if version is None else version
        found = self.manifest(version)
        if found is None:
            base = next((m for v in reversed(versions) if v < version and (m := self.manifest(v))), None)
            found = self._next(version, base)
            self.store.write_json(self._name(version), found)
        return self._open(found)

    def _open(self, m: dict) -> lexical.Index:
        return lexical.Index(self.spark, [f"{self.home}/{s}" for s in m["segments"]], [f"{self.home}/{d}" for d in m["dead"]])

    def _segment(self, rows: DataFrame) -> tuple[str, int]:
        name = uuid.uuid4().hex
        lexical.write_segment(rows, f"{self.home}/{name}", CARRY)
        return name, self._size(name)

    def _size(self, name: str) -> int:
        return self.spark.read.parquet(f"{self.home}/{name}/stats").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _next(self, version: int, base: dict | None) -> dict:
        folders = self.store.folders("chunks", version)
        out = {"folders": folders, "segments": dict(base["segments"]) if base else {}, "dead": list(base["dead"]) if base else [], "indexed": 0}
        if base is None:
            fresh = self.store.read("chunks", version)
        elif set(base["folders"]) <= set(folders):
            fresh = self.store.read_folders("chunks", [f for f in folders if f not in base["folders"]])
        else:
            now, index = self.store.read("chunks", version).withColumn("mark", F.xxhash64("text")), self._open(base)
            held = index.alive(index.table("docs"))
            gone = held.join(now.select("chunk_id", "mark"), ["chunk_id", "mark"], "left_anti").select(*lexical.PLACE, "ord", "dl")
            name = f"dead-{uuid.uuid4().hex}"
            gone.write.parquet(f"{self.home}/{name}")
            out["dead"].append(name)
            fresh = now.join(held.select("chunk_id", "mark"), ["chunk_id", "mark"], "left_anti").drop("mark")
        if base is None or not fresh.isEmpty():
            name, out["indexed"] = self._segment(fresh)
            out["segments"][name] = out["indexed"]
        tiers: dict[int, list[str]] = {}
        for name, n in out["segments"].items():
            tiers.setdefault(int(math.log(max(n, 1), lexical.FAN)), []).append(name)
        for names in tiers.values():
            if len(names) >= lexical.FAN:
                name = uuid.uuid4().hex
                lexical.merge_segments(self._open(out), [f"{self.home}/{s}" for s in names], f"{self.home}/{name}")
                out["segments"] = {s: n for s, n in out["segments"].items() if s not in names} | {name: self._size(name)}
        return out

    def prune(self) -> None:
        """Drop the indexes of versions that are gone."""
        kept = {self._name(v).rsplit("/", 1)[-1]: self.manifest(v) for v in self.store.versions()}
        used = set(kept) | {x for m in kept.values() if m for x in (*m["segments"], *m["dead"])}
        for name in self.store.names(self.home):
            if name not in used:
                self.store.delete(f"{self.home}/{name}")
