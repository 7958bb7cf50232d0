import base64
import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recollect.llm import mixing, warc

DOCS = "doc_id long, source string, text string, weight int"


def corpus(spark):
    rows = [(i, "big" if i % 10 < 6 else "mid" if i % 10 < 9 else None, "w " * (1 + i % 7), 1) for i in range(400)]
    return spark.createDataFrame(rows + [(900, "empty", "", 1), (901, "empty", None, 1), (902, "big", None, 1)], DOCS)


def test_entropy_target_and_budget(spark):
    got = mixing.copies(corpus(spark), entropy_share=0.98).collect()
    weight = {r["source"]: r["weight"] for r in got}
    assert abs(-sum(w * math.log(w) for w in weight.values() if w) - 0.98 * math.log(3)) < 1e-4
    total = sum(r["n_tokens"] for r in got)
    for s, w in weight.items():
        own = [r for r in got if r["source"] == s]
        used, size = sum(r["n_tokens"] * r["copies"] for r in own), sum(r["n_tokens"] for r in own)
        assert used <= w * total + 1e-6 and (not size or used > w * total - 8)
        assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1
        order = sorted(own, key=lambda r: (r["order_key"], r["doc_id"]))
        assert [r["copies"] for r in order] == sorted((r["copies"] for r in order), reverse=True)


def test_targets_that_need_a_large_exponent(spark):
    import duckdb

    from recollect.llm.queries import OP4_SQL

    rows = [(i, f"s{i % 4}", "w " * (26 if i % 4 == 0 else 24 if i % 4 == 3 else 25)) for i in range(40)]
    got = {r["source"]: r["weight"] for r in mixing.copies(spark.createDataFrame(rows, "doc_id long, source string, text string"), entropy_share=0.95).collect()}
    assert abs(-sum(w * math.log(w) for w in got.values()) - 0.95 * math.log(4)) < 1e-4
    documents = duckdb.connect()
    documents.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    documents.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    sql = {r[1]: r[3] for r in documents.execute(OP4_SQL).fetchall()}
    assert all(abs(sql[s] - w) < 2e-6 for s, w in got.items())
    even = mixing.copies(spark.createDataFrame([(i, f"s{i % 4}", "w") for i in range(8)], "doc_id long, source string, text string"), entropy_share=0.95).collect()
    assert {(r["weight"], r["copies"]) for r in even} == {(0.25, 1)}


def test_other_columns_of_any_name_stay(spark):
    names = ["_s", "_b", "_full", "_own", "_upto", "p", "q", "0", "7", "a.b"]
    df = spark.createDataFrame([(i, "x" if i % 3 else "y", "w " * i, *(f"{c} {i}" for c in names)) for i in range(20)], "doc_id long, source string, text string, " + ", ".join(f"`{c}` string" for c in names))
    got = mixing.copies(df)
    assert got.columns == ["doc_id", "source", "text", *names, "n_tokens", "weight", "copies", "order_key"] and got.count() == 20
    assert all(r[c] == f"{c} {r['doc_id']}" for r in got.collect() for c in names)


def test_repetition_limit_keeps_every_document(spark):
    got = mixing.copies(corpus(spark), entropy_share=None, max_repeats=2.0, whole_epoch=True).collect()
    assert all(r["copies"] >= 1 for r in got if r["source"] != "empty") and max(r["copies"] for r in got) == 2
    mixed = mixing.blocks(mixing.copies(corpus(spark), entropy_share=None, max_repeats=2.0, whole_epoch=True)).collect()
    assert Counter((r["doc_id"]) for r in mixed) == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})
    assert all(r["block"] <= r["copies"] for r in mixed)


def test_mixing_of_nothing_and_one_source(spark):
    df = corpus(spark)
    assert mixing.copies(df.limit(0)).collect() == []
    assert {r["copies"] for r in mixing.copies(df.filter("source = 'empty'")).collect()} == {0}
    assert {r["copies"] for r in mixing.copies(df.filter("source = 'mid'")).collect()} == {1}
    with pytest.raises(ValueError):
        mixing.copies(df, entropy_share=0.9, max_repeats=2.0)


PAGES = [(5, "http://a/x", "same"), (3, "http://b/\r\ny", "same"), (9, None, "same"), (4, "u", ""), (2, "v", None), (7, "é", "ñandú\r\n\r\nWARC/1.1\r\nWARC-Type: trap\r\n\r\n"), (None, "n", "same"), (8, "big", "x" * 300_000)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}/out"
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("body", F.lit(1))
    warc.write_warc(warc.plan_records(df), path, records_per_file=2)
    return path


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark, archive):
    got = {r["record_id"]: r for r in warc.read_warc(spark, archive).collect()}
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        r = got[f"<urn:page:{'' if i is None else i}>"]
        assert r["payload_digest"] == "sha1:" + digest(html) and r["payload_bytes"] == len((html or "").encode())
        first = {"same": 3, "": 2}.get(html or "", i)
        if i == first:
            assert r["record_type"] == "response" and r["payload"].decode() == (html or "") and r["refers_to"] is None
        else:
            assert r["record_type"] == "revisit" and r["payload"] is None and r["refers_to"] == f"<urn:page:{first}>"
    assert got["<urn:page:9>"]["target_uri"] is None and got["<urn:page:3>"]["target_uri"] == "http://b/%0D%0Ay"


def test_pushed_filters_and_skipped_payloads(spark, archive, capfd):
    df = warc.read_warc(spark, archive, payload=False).filter((F.col("record_type") == "response") & F.col("target_uri").startswith("b") & (F.col("content_length") > 1000))
    assert [(r["target_uri"], r["payload"], r["payload_bytes"]) for r in df.collect()] == [("big", None, 300_000)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]
    assert warc.read_warc(spark, archive).filter(F.col("record_type").isin("metadata")).count() == 0


def test_gzip_members(spark, archive, tmp_path):
    import glob
    import gzip

    for k, f in enumerate(sorted(glob.glob(archive.removeprefix("file://") + "/part-*"))):
        (tmp_path / f"a{k}.warc.gz").write_bytes(gzip.compress(open(f, "rb").read()))
    both = [{(r["record_id"], r["payload_digest"], bytes(r["payload"] or b"")) for r in warc.read_warc(spark, p).collect()} for p in (archive, f"file://{tmp_path}")]
    assert both[0] == both[1]


def records(spark, path, **options):
    return {(r["record_id"], r["payload_digest"], bytes(r["payload"] or b"")) for r in warc.read_warc(spark, path, **options).collect()}


def test_a_member_for_each_record(spark, archive, tmp_path, monkeypatch):
    import glob
    import gzip

    path, inflated = f"{tmp_path}/z", []
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_warc(warc.plan_records(df), path, records_per_file=5, compression="gzip")
    assert records(spark, path) == records(spark, archive)
    files = sorted(glob.glob(path + "/part-*.warc.gz"))
    assert sum(gzip.open(f).read().count(b"WARC/1.1\r\nWARC-Type: re") for f in files) == len(PAGES)  # any reader of gzip reads them
    once = warc._Member.readinto
    monkeypatch.setattr(warc._Member, "readinto", lambda self, out: (inflated.append(once(self, out)), inflated[-1])[1])
    reader = warc.WarcReader({"path": path})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")])) == []
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4
    assert sum(inflated) < 4096 * len(PAGES)  # of over 300 000 bytes
    empty = f"{tmp_path}/none"
    warc.write_warc(warc.plan_records(df.limit(0)), empty, compression="gzip")
    assert records(spark, empty) == set()


def test_broken_members(spark, archive, tmp_path):
    parts = [warc.gzip_member(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: {i}\r\nContent-Length: 9\r\n\r\npayload {i}\r\n\r\n".encode()) for i in range(3)]
    hurt = bytearray(parts[1])
    hurt[-6] ^= 1  # its checksum
    cases = {"a": parts[0] + bytes(hurt) + parts[2], "b": parts[0] + parts[1] + parts[2][:-9], "c": parts[0] + b"noise" + parts[2], "d": b"".join(parts)}
    for name, data in cases.items():
        path = f"{tmp_path}/{name}.warc.gz"
        with open(path, "wb") as f:
            f.write(data)
        got = {r for r, *_ in records(spark, path, mode="permissive")}
        assert got == {"a": {"0", "2"}, "b": {"0", "1"}, "c": {"0"}, "d": {"0", "1", "2"}}[name]
        if name != "d":
            with pytest.raises(Exception):
                records(spark, path)


def test_small_payloads_are_never_revisits(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.plan_records(df, min_bytes=5).collect()} == {"response"}
    assert warc.plan_records(df.limit(0)).collect() == []


def test_broken_archives(spark, archive, tmp_path):
    import glob
    import gzip

    whole = b"".join(open(f, "rb").read() for f in sorted(glob.glob(archive.removeprefix("file://") + "/part-*")))
    (tmp_path / "a.warc").write_bytes(b"noise\r\nmore\r\n" + whole)
    (tmp_path / "b.warc").write_bytes(whole.replace(b"Content-Length: ", b"Content-Length: x", 1))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(whole)[:-20])
    (tmp_path / "d.warc").write_bytes(whole[: len(whole) // 2])
    n = len(PAGES)
    for name, least in (("a.warc", n), ("b.warc", n - 1), ("c.warc.gz", 1), ("d.warc", 1)):
        path = f"file://{tmp_path}/{name}"
        with pytest.raises(Exception):
            warc.read_warc(spark, path).collect()
        got = {r["record_id"] for r in warc.read_warc(spark, path, mode="permissive").collect()}
        assert least <= len(got) <= n


def test_a_hot_payload_is_decided_without_meeting_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(warc, "COMMON", 3)
    bodies = {i: "hot" if i % 2 else f"page {i // 3}" for i in range(40)} | {50: None, 51: None, 52: ""}
    rows = [(i, f"http://x/{i}", b) for i, b in bodies.items()] + [(None, None, "hot"), (1, "http://again", "hot"), (None, None, "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    planned = warc.plan_records(df)
    least = {}
    for i, _, b in rows:
        if i is not None:
            least[b or ""] = min(i, least.get(b or "", i))
    expected = sorted(str((i, u, None if least.get(b or "") in (None, i) else least[b or ""])) for i, u, b in rows)
    assert sorted(str((r["page_id"], r["url"], r["refers_to"])) for r in planned.collect()) == expected
    assert planned.columns == warc.plan_records(df.limit(0)).columns
    places = planned.filter("body = 'hot'").groupBy("refers_to").count().collect()
    assert {r["refers_to"]: r["count"] for r in places} == {1: 20, None: 2}
