"""Indexes of document streams: each micro-batch is indexed on its own and appended to the store.

A document is a shard of the index, so nothing that is there is touched. A batch's rows carry its number; a batch that is
run again after a failure replaces its own partition, so every document is indexed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphmine.operators.index import build_index
from glyphmine.operators.search import count


def append_index(docs: DataFrame, folder: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", orientation: str = "forward", **trigger) -> StreamingQuery:
    """Starts a query that keeps ``folder`` the index of a stream of documents; ``trigger`` as in ``DataStreamWriter.trigger``."""

    def write(batch: DataFrame, number: int) -> None:
        index = build_index(batch, id_col, text_col, orientation).withColumn("batch", F.lit(number).cast("long"))
        index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def literal_alerts(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stream of (doc_id, cnt) of documents that hold a literal; stateless, so it needs no watermark."""
    return count(docs, pattern, id_col, text_col)
