"""Rotation over all tenants: what each job does, when it is due, and that failures stay apart."""

from recollect.jobs.engine import Engine
from recollect.jobs.rotation import failed, rotate
from recollect.sources import backup
from recollect.sources.store import Store

OLD, NOW = "2024-01-01 00:00:00", "2024-03-01 00:00:00"


def test_rotation_of_several_tenants(spark, tmp_path):
    root, key = f"file://{tmp_path}/root", b"k" * 32
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, text string")
    for tenant in ("a", "b", "off"):
        e = Engine(spark, root, tenant)
        e.ingest(docs(("1", "old memory one"), ("2", "old memory two")), "w", "me", OLD)
        e.ingest(docs(("3", "recent memory")), "w", "me", "2024-02-28 00:00:00")
    keys = lambda tenant: b"too-short" if tenant == "b" else key
    policy = spark.createDataFrame([("a", 30), ("b", None), ("off", 0), ("empty", 5)], "tenant string, days int")
    report = rotate(spark, root, policy, NOW, f"file://{tmp_path}/backups", keys)
    got = {(r["tenant"], r["job"]): (r["status"], r["detail"]) for r in report.collect()}
    assert got["a", "sweep"] == got["b", "sweep"] == ("ok", "expired 2") and got["off", "sweep"] == got["empty", "sweep"] == ("ok", "expired 0")
    assert all(got[t, "maintenance"][0] == "ok" for t in ("a", "b", "off", "empty"))
    assert got["b", "backup"][0] == "failed" and "BACKUP_CORRUPT" in got["b", "backup"][1] and failed(report) == ["b/backup"]
    assert got["a", "backup"] == ("ok", "chunks 1") and got["off", "backup"] == ("ok", "chunks 3")
    a = Engine(spark, root, "a")
    assert len(a.store.versions()) == 1 and a.search("old", "w").count() == 0 and a.search("recent", "w").count() == 1

    back = Store(spark, f"file://{tmp_path}/other", "a")
    backup.restore(back, f"file://{tmp_path}/backups/a/2024-03-01T000000", key)
    assert [r["text"] for r in back.read("chunks").collect()] == ["recent memory"]

    again = {(r["tenant"], r["job"]): (r["status"], r["detail"]) for r in rotate(spark, root, policy, "2024-03-01 12:00:00").collect()}
    assert again["a", "maintenance"] == ("not_due", "next at 2024-03-02 00:00:00")
    later = {(r["tenant"], r["job"]): r["status"] for r in rotate(spark, root, policy, "2024-03-02 00:00:00").collect()}
    assert later["a", "maintenance"] == "ok"
