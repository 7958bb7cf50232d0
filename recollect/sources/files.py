"""Bulk reading of files, export as JSON lines, encrypted backup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import html_text, plain_text, source_kind

LARGEST = 10 << 20


class InvalidInput(ValueError):
    """INVALID_INPUT: a root that climbs up or isn't a folder, or an entry that leaves it."""


def walk(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under root, sorted, each once. Nothing is read.

    A root with a `..` part is refused. Links are followed where the file system is the local one; an entry that
    leads out of root refuses the whole walk, and a folder that is met again is passed over.
    """
    if ".." in root.split("/"):
        raise InvalidInput(f"INVALID_INPUT: {root} climbs up")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise InvalidInput(f"INVALID_INPUT: {root} isn't a folder")
    local = fs.getUri().getScheme() == "file"
    paths = spark._jvm.java.nio.file.Paths
    none = lambda kind: spark.sparkContext._gateway.new_array(kind, 0)
    text, option = spark._jvm.java.lang.String, spark._jvm.java.nio.file.LinkOption
    real = lambda p: "file:" + paths.get(p.toUri().getPath(), none(text)).toRealPath(none(option)).toString() if local else p.toString()
    top = real(fs.getFileStatus(path).getPath())
    found, seen, todo = {}, {top}, [top]
    while todo:
        for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(todo.pop())):
            at = real(s.getPath())
            if at != top and not at.startswith(top.rstrip("/") + "/"):
                raise InvalidInput(f"INVALID_INPUT: {s.getPath().toString()} leads out of {root}")
            if not s.isDirectory():
                found[at] = s.getLen()
            elif at not in seen:
                seen.add(at)
                todo.append(at)
    return sorted(found.items())


def bulk(spark: SparkSession, root: str) -> DataFrame:
    """Files under root in order of their paths, each once: file, status (ok or failed), reason, source, text.

    The walk comes first and refuses a root from which anything leads out before any content is read. Too large, unknown,
    empty and blank files and those that are not UTF-8 fail by row; the others' text is read. Contents of files beyond
    LARGEST are never read.
    """
    listed = walk(spark, root)
    rows = spark.createDataFrame(listed, "path string, length long")
    kind = source_kind(F.col("path"))
    known = F.coalesce(kind.isin("text", "markdown", "document:html", "document:htm", "document:csv"), F.lit(False))
    refused = F.when(F.col("length") > LARGEST, "RESOURCE_EXHAUSTED").when(~known, "UNSUPPORTED_FORMAT").when(F.col("length") == 0, "EMPTY_TEXT")
    judged = rows.select("path", kind.alias("source"), refused.alias("refused"))
    asked = [r["path"] for r in judged.filter("refused is null").select("path").collect()]  # of the walk's own list
    content = spark.createDataFrame([], "path string, plain string")
    if asked:
        content = spark.read.format("binaryFile").load(asked).select("path", plain_text(F.col("content")).alias("plain"))
    text = F.when(F.col("source").isin("document:html", "document:htm"), html_text(F.col("plain"))).otherwise(F.col("plain"))
    read = judged.join(content, "path", "left").withColumn("text", text)
    reason = F.when(F.col("refused").isNotNull(), F.col("refused")).when(F.col("text").isNull(), "MALFORMED_TEXT").when(~F.col("text").rlike(r"\S"), "EMPTY_TEXT")
    out = read.select(F.col("path").alias("file"), F.when(reason.isNull(), "ok").otherwise("failed").alias("status"), reason.alias("reason"), "source", F.when(reason.isNull(), F.col("text")).alias("text"))
    return out.orderBy("file")


def export_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON line."""
    return df.select(F.to_json(F.struct("*")).alias("line"))


def export(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each table's lines to path/<table> and return the manifest: table, n_rows."""
    out = None
    for name, df in tables.items():
        export_lines(df).write.text(f"{path}/{name}")
        n = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out


def sealed(column: Column, key: bytes) -> Column:
    """AES-GCM of a text column."""
    return F.aes_encrypt(column.cast("binary"), F.lit(key), F.lit("GCM"))


def opened(column: Column, key: bytes) -> Column:
    return F.aes_decrypt(column, F.lit(key), F.lit("GCM")).cast("string")
