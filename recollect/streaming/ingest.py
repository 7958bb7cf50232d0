"""Ingest from a stream: every micro-batch goes through the same duplicate check as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from recollect.operators.ingest import hashed, new_documents


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append documents (tenant_id, doc_id, text, ...) of unseen content to Parquet under path/epoch=<n>.

    A replayed epoch overwrites its own folder, so content is written exactly once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        stored = None
        if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
            stored = spark.read.option("basePath", path).parquet(path)
            stored = stored.filter(stored["epoch"] != epoch)
        new_documents(hashed(batch), stored).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
