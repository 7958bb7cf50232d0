"""A tenant's settings, its health, and projects indexed from sources under ignore rules."""

import pytest

from recollect.jobs.engine import Engine
from recollect.jobs.rotation import rotate
from recollect.sources import config

OLD, NOW = "2024-01-01 00:00:00", "2024-03-01 00:00:00"


def test_settings_are_kept_replaced_and_survive_broken_files(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/root", "a")
    assert config.read(e.store) == config.Retention(30, 30) and config.read(e.store, 7) == config.Retention(7, 7)
    config.write(e.store, 90)
    assert config.read(e.store) == config.Retention(90, 90)
    config.write(e.store, 60, 365)
    assert config.read(e.store) == config.Retention(60, 365)
    path = f"{e.store.home}/config.toml"
    for text, expected in (
        ("[retention]\ndays = 'x'\naudit_days = 9\n", (30, 9)),
        ("[retention\ndays = 5", (30, 30)),
        ("retention = 4", (30, 30)),
        ("[other]\naudit_days = 3\n[retention]\ndays = 0\n", (0, 0)),
        ("[retention]\ndays = -1\n", (30, 30)),
        ("", (30, 30)),
    ):
        e.store.write_text(path, text, replace=True)
        assert config.read(e.store) == config.Retention(*expected), text
    e.store.write_text(path, '[tenant]\nname = "Ünal \\"x\\""\n', replace=True)
    config.write(e.store, 5)
    assert e.store.read_text(path) == '[tenant]\nname = "\\u00dcnal \\"x\\""\n\n[retention]\ndays = 5\n'
    with pytest.raises(ValueError, match="INVALID_INPUT"):
        config.write(e.store, -1)
    with pytest.raises(OSError):
        e.store.write_text(path, "x")
    assert config.read(e.store).days == 5


def test_sweeps_and_rotation_follow_the_settings(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    for tenant, days in (("a", 90), ("b", None)):
        e = Engine(spark, root, tenant)
        e.ingest(spark.createDataFrame([("1", "an old memory")], "doc_id string, text string"), "w", "me", OLD)
        if days:
            config.write(e.store, days)
    policy = spark.createDataFrame([("a", None), ("b", None)], "tenant string, days int")
    swept = {r["tenant"]: r["detail"] for r in rotate(spark, root, policy, NOW).filter("job = 'sweep'").collect()}
    assert swept == {"a": "expired 0", "b": "expired 1"}
    a = Engine(spark, root, "a")
    row = a.health().first()
    assert (row["status"], row["tenant"], row["n_chunks"], row["n_docs"], row["n_symbols"], row["days"], row["audit_days"]) == ("ok", "a", 1, 1, 0, 90, 90)
    config.write(a.store, 10)
    assert a.sweep(NOW) == 1 and a.health().first()["n_chunks"] == 0


def test_a_project_from_sources(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/root", "a")
    rows = [
        (".gitignore", "build/\n*_gen.py\n!keep_gen.py\n"),
        ("app/main.py", "def run():\n    helper()\n\n\ndef helper():\n    return keep()\n"),
        ("app/keep_gen.py", "def keep():\n    pass\n"),
        ("app/x_gen.py", "def generated():\n    pass\n"),
        ("build/out.py", "def built():\n    run()\n"),
        ("app/lib.rs", "fn main() {}"),
        ("app/bad.py", "def ("),
    ]
    sources = spark.createDataFrame(rows, "file string, text string")
    assert e.index_sources("p", sources, NOW) == {"n_files": 4, "n_skipped": 2, "n_concepts": 3, "n_edges": 2}
    assert [r["display"] for r in e.callers("p", "keep", None).orderBy("id").collect()] == ["helper (app/main.py#L5-L6)", "run (app/main.py#L1-L2)"]
    assert e.index_sources("q", sources.limit(0), NOW) == {"n_files": 0, "n_skipped": 0, "n_concepts": 0, "n_edges": 0}
