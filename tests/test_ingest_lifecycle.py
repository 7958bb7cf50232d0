import random
import re

import pytest
from pyspark.sql import functions as F

from recollect.operators import evaluation, ingest, lifecycle
from recollect.sources import files
from recollect.sources.store import Store
from recollect.streaming.ingest import ingest_stream

DOCS = "tenant_id string, doc_id long, text string"


def test_dedup_within_and_against_store(spark):
    d = ingest.hashed(spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 3, "x"), ("a", 4, None), ("a", 5, "")], DOCS))
    assert sorted(r["doc_id"] for r in ingest.new_documents(d).collect()) == [1, 3, 4]
    assert [tuple(r) for r in ingest.duplicates(d).orderBy("doc_id").collect()] == [(2, 1), (5, 4)]
    assert sorted(r["doc_id"] for r in ingest.new_documents(d, d.filter("doc_id = 1")).collect()) == [3, 4]


def test_windows(spark):
    d = spark.createDataFrame([(1, " ".join(str(i) for i in range(600))), (2, "one two"), (3, None), (4, " ")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["ordinal"], r["n_tokens"], r["text"].split()[0]) for r in ingest.windows(d).collect())
    assert got == [(1, 0, 270, "0"), (1, 1, 270, "235"), (1, 2, 130, "470"), (2, 0, 2, "one")]


WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def slow_chunks(text, size=270, overlap=35, smallest=256, most=30):
    """(ordinal, words, first byte, last byte, text) by plain loops over words."""
    text = text or ""
    at = [m.span() for m in WORD.finditer(text)]
    cut, begin = [], 0
    for i, (_, e) in enumerate(at):
        gap, dot = text[e : at[i + 1][0] if i + 1 < len(at) else None], text[e - 1] in ".!?"
        if i + 1 == len(at) or "\n" in gap or dot or i + 1 - begin == most:
            cut.append((begin, i + 1, i + 1 - begin < most or dot))
            begin = i + 1
    out, begin, mark, starts, e = [], 0, None, [], 0
    for s, e, whole in cut:
        starts.append(s)
        mark = e if whole and e - begin >= smallest else mark
        if e - begin >= size:
            out.append((begin, mark or e))
            begin, mark = next(x for x in starts if x >= (out[-1][1]) - overlap), None
    if e > (out[-1][1] if out else 0):
        out.append((begin, e))
    part = lambda a, b: text[at[a][0] : at[b - 1][1]]
    first = lambda a: len(text[: at[a][0]].encode())
    return [(k, b - a, first(a), first(a) + len(part(a, b).encode()), part(a, b)) for k, (a, b) in enumerate(out)]


def test_sentence_chunks_against_plain_loops(spark):
    rng = random.Random(5)

    def text(n):
        return "".join(rng.choice(["w", "árbol", "x" * rng.randint(1, 12)]) + rng.choice([""] * 6 + [".", "!", "?", "...", '."']) + rng.choice([" "] * 4 + ["  ", "\n", " \n ", "\t"]) for _ in range(n))

    texts = [None, "", "  \n", "one", "a. b! c", "word " * 5000, "w. " * 3000, "…é\n" * 900, *(rng.choice(["", " ", "\n"]) + text(rng.randint(1, 2500)) for _ in range(40))]
    rows = ingest.sentence_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        got = sorted(tuple(r)[1:] for r in rows if r["doc_id"] == i)
        assert got == slow_chunks(t)
        for _, n, start, end, own in got:
            assert (t or "").encode()[start:end].decode() == own and len(WORD.findall(own)) == n <= 300


def test_sentence_chunk_properties(spark):
    """Short sentences: all but the last chunk hold 256 to 300 words, neighbours share 1 to 45 words, nothing is lost."""
    rng = random.Random(6)
    texts = [" ".join(" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(1, 25))) + rng.choice([".", "!", "?", ".\n"]) for _ in range(rng.randrange(20, 90))) for _ in range(64)]
    rows = ingest.sentence_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["ordinal"])
        assert own and all(256 <= r["n_tokens"] <= 300 for r in own[:-1]) and own[-1]["n_tokens"] <= 300
        assert sum(r["n_tokens"] for r in own) >= len(t.split()) and own[0]["start"] == 0 and own[-1]["end"] == len(t.rstrip().encode())
        for a, b in zip(own, own[1:]):
            assert 1 <= len(t.encode()[b["start"] : a["end"]].split()) <= 45


def test_delete_and_retention(spark):
    c = spark.createDataFrame([(1, 10, "a"), (2, 10, "a"), (3, 11, None)], "chunk_id long, doc_id long, tenant_id string")
    f = spark.createDataFrame([(1, 1.0), (1, 0.0), (3, 1.0)], "chunk_id long, score float")
    row = lifecycle.delete_counts(c, c.select("doc_id", "tenant_id").distinct(), f, F.col("doc_id") == 10).first()
    assert tuple(row) == (2, 1, 2, 5)
    assert [r[0] for r in lifecycle.survivors(c, F.col("tenant_id") == "a").collect()] == [3]
    t = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-01-01'), (2, TIMESTAMP_NTZ'2024-01-20'), (3, NULL) AS t(id, created_at)")
    assert [r[0] for r in lifecycle.expired(t, "2024-01-31", 15).collect()] == [1]
    assert sorted(r[0] for r in lifecycle.unexpired(t, "2024-01-31", 15).collect()) == [2, 3]
    assert lifecycle.expired(t, "2024-01-31", 0).count() == 0 and lifecycle.unexpired(t, "2024-01-31", 0).count() == 3


def test_sweep_keeps_malformed_lines(spark):
    lines = spark.createDataFrame([('{"ts": "2024-01-01 00:00:00"}',), ('{"ts": "2024-01-30 00:00:00"}',), ("{broken",), ('{"a": 1}',), (None,)], "line string")
    assert lifecycle.sweep_lines(lines, "2024-01-31", 10).count() == 4


def test_store_versions_and_time_travel(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}", "t")
    assert s.read("chunks").count() == 0 and s.versions() == []
    rows = spark.createDataFrame([("c1", "t", "d1"), ("c2", "t", "d2")], "chunk_id string, tenant_id string, doc_id string")
    assert s.append("chunks", rows) == 1
    assert s.append("feedback", spark.createDataFrame([("c1", "t", 1.0)], "chunk_id string, tenant_id string, score float")) == 2
    assert s.delete_doc("d1") == 3
    assert [s.read("chunks", v).count() for v in (1, 2, 3)] == [2, 2, 1] and s.read("feedback").count() == 0
    assert s.compact() == 4 and s.prune() > 0 and s.versions() == [4] and s.read("chunks").count() == 1
    with pytest.raises(ValueError):
        s.read("chunks", 1)
    s.erase()
    assert s.versions() == []


def test_bulk_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("﻿# Título")
    (tmp_path / "sub" / "b.html").write_text("<p>Hola</p><script>x()</script> <b>mundo</b>")
    (tmp_path / "c.xyz").write_text("?")
    (tmp_path / "d.txt").write_text(" \n")
    (tmp_path / "e.txt").write_text("")
    got = {r["file"].rsplit("/", 1)[1]: (r["status"], r["reason"], r["text"]) for r in files.bulk(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("ok", None, "# Título"), "b.html": ("ok", None, "Hola mundo"), "c.xyz": ("failed", "UNSUPPORTED_FORMAT", None), "d.txt": ("failed", "EMPTY_TEXT", None), "e.txt": ("failed", "EMPTY_TEXT", None)}


def test_stream_ingests_each_content_once(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    for k, rows in enumerate([[("a", 1, "x"), ("a", 2, "y")], [("a", 3, "x"), ("a", 4, "z")]]):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(DOCS).parquet(str(source))
        ingest_stream(stream, str(out), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(out)).collect()) == [1, 2, 4]


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 3)], "query_id long, chunk_id long, rank int")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    good = spark.createDataFrame([(1, 11), (2, 12)], "query_id long, chunk_id long")
    assert tuple(evaluation.mrr_recall(hits, asked, good).first()) == (3, round((1 / 2 + 1 / 3) / 3, 6), round(2 / 3, 6))


def test_nearest_rank(spark):
    d = spark.createDataFrame([("a", float(i)) for i in range(101)] + [("b", 5.0), ("b", None)], "g string, v double")
    assert {r[0]: (r[1], r[2]) for r in evaluation.nearest_rank(d, "g", "v", buckets=8).collect()} == {"a": (50.0, 99.0), "b": (5.0, 5.0)}


def test_nearest_rank_and_ranks_with_hot_and_null_values(spark):
    from recollect.jobs.catalogue import ranked_lists

    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), i, 5.0 if i % 2 else rng.choice([None, float(rng.randrange(40))])) for i in range(900)]
    d = spark.createDataFrame(rows, "g string, i long, v double")
    got = {r[0]: (r[1], r[2]) for r in evaluation.nearest_rank(d, "g", "v", buckets=8).collect()}
    for g in ("a", "b", None):
        v = sorted(x for k, _, x in rows if k == g and x is not None)
        assert got[g] == tuple(v[int((len(v) - 1) * p + 0.5)] for p in (0.5, 0.99))
    ranks = {r["i"]: r["rank"] for r in ranked_lists(d, "g", "v", "i").collect()}
    for g in ("a", "b", None):
        order = sorted(((x is None, -(x or 0), i) for k, i, x in rows if k == g))
        assert [ranks[i] for _, _, i in order] == list(range(1, len(order) + 1))


def test_walk_refuses_what_leads_out(spark, tmp_path):
    """Reads nothing before the whole tree is known to lie inside; links inside are followed once, also in a circle."""
    root, out = tmp_path / "root", tmp_path / "out"
    (root / "sub").mkdir(parents=True)
    out.mkdir()
    (out / "secret.txt").write_text("secret")
    (root / "b.txt").write_text("b")
    (root / "sub" / "a.txt").write_text("a")
    (root / "sub" / "again").symlink_to(root)
    (root / "z.txt").symlink_to(root / "b.txt")
    names = lambda rows: [r["file"].rsplit("/", 1)[1] for r in rows]
    assert names(files.bulk(spark, str(root)).collect()) == ["b.txt", "a.txt"]  # by path, each file once
    with pytest.raises(files.InvalidInput, match="climbs"):
        files.bulk(spark, f"{root}/../out")
    with pytest.raises(files.InvalidInput, match="isn't a folder"):
        files.bulk(spark, str(root / "b.txt"))
    (root / "leak").symlink_to(out)
    with pytest.raises(files.InvalidInput, match="leads out"):
        files.bulk(spark, str(root))


def test_broken_backups_leave_the_store_alone(spark, tmp_path):
    import json

    from recollect.sources.backup import BackupCorrupt, backup, restore

    key, root = b"0123456789abcdef0123456789abcdef", f"file://{tmp_path}"
    s = Store(spark, f"{root}/a", "t")
    s.append("chunks", spark.createDataFrame([(f"c{i}", "t", f"text {i}") for i in range(20)], "chunk_id string, tenant_id string, text string").repartition(2))
    for turn, spoil in enumerate(["key", "line", "missing", "swapped", "manifest"]):
        path = tmp_path / f"b{turn}"
        backup(s, f"file://{path}", key, "2024-01-01 00:00:00")
        assert json.loads((path / "key.json").read_text())["alg"] == "AES-GCM"
        parts = sorted((path / "chunks").glob("part-*"))
        full = [p for p in parts if p.stat().st_size]
        for p in path.rglob(".*.crc"):
            p.unlink()
        if spoil == "line":
            full[0].write_text(full[0].read_text()[: len(full[0].read_text()) // 2])
        elif spoil == "missing":
            full[0].unlink()
        elif spoil == "swapped":
            (path / "docs" / full[0].name).write_text(full[0].read_text())
        elif spoil == "manifest":
            (path / "manifest.json").write_text(json.dumps({"sealed": "00" * 40}))
        fresh = Store(spark, f"{root}/r{turn}", "t")
        with pytest.raises(BackupCorrupt, match="BACKUP_CORRUPT"):
            restore(fresh, f"file://{path}", b"x" * 32 if spoil == "key" else key)
        assert fresh.versions() == []
    with pytest.raises(BackupCorrupt):
        backup(s, f"{root}/b9", b"too-short")


def test_backup_and_restore(spark, tmp_path):
    from recollect.sources.backup import backup, restore

    key, root = b"0123456789abcdef", f"file://{tmp_path}"
    s = Store(spark, f"{root}/a", "t")
    s.append("chunks", spark.createDataFrame([("c1", "t", "tëxt", [0.5, -1.0]), ("c2", "t", None, None)], "chunk_id string, tenant_id string, text string, vector array<float>"))
    assert backup(s, f"{root}/b", key)["chunks"] == 2
    other = Store(spark, f"{root}/c", "t")
    assert restore(other, f"{root}/b", key) == 1
    order = lambda x: sorted(map(tuple, x.read("chunks").collect()), key=str)
    assert order(other) == order(s)
    with pytest.raises(ValueError, match="STORE_BUSY"):
        restore(other, f"{root}/b", key)
    with pytest.raises(ValueError, match="BACKUP_CORRUPT"):
        restore(Store(spark, f"{root}/d", "u"), f"{root}/b", key)


def test_audit_log(spark, tmp_path):
    from recollect.sources import audit

    path = f"file://{tmp_path}/log"
    e = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' AS ts, 'search' AS action, 'ok' AS outcome UNION ALL SELECT TIMESTAMP'2024-02-01 00:00:00', 'sea\"rch', 'error'")
    audit.record(e, path)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path)
    assert audit.read(spark, path).filter("action is not null").count() == 2
    audit.sweep(spark, path, f"file://{tmp_path}/kept", "2024-02-02 00:00:00", 10)
    assert spark.read.text(f"file://{tmp_path}/kept").count() == 2
    lines = {r[0] for r in audit.metrics_text(audit.outcome_counts(audit.read(spark, path).filter("action is not null"))).collect()}
    assert 'operations_total{action="search",outcome="ok"} 1' in lines


def test_append_writes_only_its_rows(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}", "t")
    rows = lambda *ids: spark.createDataFrame([(i, "t") for i in ids], "chunk_id string, tenant_id string")
    s.append("chunks", rows("a", "b"))
    s.append("chunks", rows("c"))
    s.append("chunks", rows("d"))
    assert [len(s.manifest(v)["chunks"]) for v in (1, 2, 3)] == [1, 2, 3]
    assert spark.read.parquet(f"{s.home}/data/v2/chunks").count() == 1
    assert [s.read("chunks", v).count() for v in (1, 2, 3)] == [2, 3, 4]
    assert [r["version"] for r in s.timeline().orderBy("published", "version").collect()] == [1, 2, 3]
    s.compact()
    assert len(s.manifest()["chunks"]) == 1 and s.read("chunks").count() == 4 and s.prune() > 0 and s.read("chunks").count() == 4
    s.compact(file_bytes=1)
    assert len(s.read("chunks").inputFiles()) > 1


def test_bulk_survives_bad_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in [("a.txt", b"fine"), ("b.md", b"\xff\xfe bad"), ("sub/c.html", b"<p>x</p>"), ("d.txt", b" \n"), ("e.pdf", b"%PDF"), ("f.txt", b"\xef\xbb\xbfwith mark"), ("g", b"no kind")]:
        (tmp_path / name).write_bytes(content)
    (tmp_path / "h.txt").write_bytes(b"x" * (files.LARGEST + 1))
    got = {r["file"].rsplit("/", 1)[1]: (r["status"], r["reason"], r["text"]) for r in files.bulk(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("ok", None, "fine"), "b.md": ("failed", "MALFORMED_TEXT", None), "c.html": ("ok", None, "x"), "d.txt": ("failed", "EMPTY_TEXT", None), "e.pdf": ("failed", "UNSUPPORTED_FORMAT", None), "f.txt": ("ok", None, "with mark"), "g": ("failed", "UNSUPPORTED_FORMAT", None), "h.txt": ("failed", "RESOURCE_EXHAUSTED", None)}


def test_compaction_rewrites_small_folders_only(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}", "t")
    rows = lambda lo, hi: spark.createDataFrame([(f"c{i}", "t", f"text {i} " * 20) for i in range(lo, hi)], "chunk_id string, tenant_id string, text string")
    s.append("chunks", rows(0, 4000).coalesce(1))
    large = s.folders("chunks")[0]
    limit = 2 * s._fs.getContentSummary(s._path(f"{s.home}/{large}")).getLength() - 1000
    for k in range(4):
        s.append("chunks", rows(5000 + 10 * k, 5010 + 10 * k).repartition(3))
    for turn in range(3):
        s.append("docs", spark.createDataFrame([("d", f"title {turn}"), (f"e{turn}", "x")], "doc_id string, title string"))
    before = {t: sorted(map(tuple, s.read(t).collect()), key=str) for t in ("chunks", "docs")}
    assert ("title 2" in str(before["docs"])) and len(before["docs"]) == 4
    was = len(s.versions())
    version = s.compact(limit)
    assert version == was + 1 and {t: sorted(map(tuple, s.read(t).collect()), key=str) for t in before} == before
    kept, new = s.folders("chunks")
    assert kept == large and len(s.folders("docs")) == 1
    written = s._fs.getContentSummary(s._path(f"{s.home}/{new}")).getLength()
    assert written < limit // 10 and sum(n.startswith("part-") for n in s.names(f"{s.home}/{new}")) == 1
    assert s.compact(limit) == version + 1 and s.folders("chunks") == [kept, new] and {t: sorted(map(tuple, s.read(t, was).collect()), key=str) for t in before} == before
