"""Indexes as Parquet tables: one folder with the documents' index rows in hash buckets of the id, and a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmine.operators.index import build_index, symbol_counts
from glyphmine.operators.search import at_rank

VERSION = 1
#: Text of a bucket, and index rows of a file.
BUCKET_BYTES, ROWS = 256 << 20, 1 << 16


def bucket_of(doc_id, buckets: int):
    """The bucket of an id."""
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def save(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", orientation: str = "forward", buckets: int | None = None, mode: str = "overwrite") -> None:
    """Builds and writes the index of ``docs``: tables ``index`` and ``counts``, parted by bucket, and ``manifest``.

    By default a bucket for every ``BUCKET_BYTES`` of text; an id of more rows than others makes one bucket larger, which is
    then written by several tasks. Files are written to a temporary place and committed by Spark, so a lost executor or a
    failed job leaves no half index.
    """
    if buckets is None:
        buckets = max(1, -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // BUCKET_BYTES))
    for name, rows, most in (("index", build_index(docs, id_col, text_col, orientation), ROWS), ("counts", symbol_counts(docs, id_col, text_col), 256 * ROWS)):
        rows = rows.withColumn("bucket", bucket_of("doc_id", buckets))
        rows.hint("rebalance", "bucket").write.option("maxRecordsPerFile", most).mode(mode).partitionBy("bucket").parquet(f"{folder}/{name}")
    docs.sparkSession.createDataFrame([(VERSION, orientation, buckets)], "version int, orientation string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")


def exists(spark: SparkSession, folder: str) -> bool:
    """Is there a whole index in the folder? The manifest is written last."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


class Store:
    """A saved index."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        m = spark.read.parquet(f"{folder}/manifest").first()
        if m.version != VERSION:
            raise ValueError(f"the index has version {m.version}, this code reads {VERSION}")
        self.orientation, self.buckets = m.orientation, m.buckets

    def index(self) -> DataFrame:
        """All index rows."""
        return self.spark.read.parquet(f"{self.folder}/index").drop("bucket")

    def counts(self) -> DataFrame:
        """(doc_id, c, cnt, start)."""
        return self.spark.read.parquet(f"{self.folder}/counts").drop("bucket")

    def texts(self) -> DataFrame:
        """(doc_id, data): the corpus itself, as it was indexed; the files it came from aren't read again."""
        return self.index().select("doc_id", "data")

    def read(self, doc_id: int, rank: int) -> DataFrame:
        """(doc_id, pos, c, lcp) of one rank of one id."""
        return at_rank(self.document(doc_id), rank)

    def document(self, doc_id: int) -> DataFrame:
        """The index row of one id; only its bucket is read."""
        bucket = self.spark.range(1).select(bucket_of(F.lit(doc_id).cast("long"), self.buckets)).first()[0]
        return self.spark.read.parquet(f"{self.folder}/index").where((F.col("bucket") == bucket) & (F.col("doc_id") == doc_id)).drop("bucket")
