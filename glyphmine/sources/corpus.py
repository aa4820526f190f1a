"""Text sources: files and folders as one row each, with binary files told apart, sizes capped and bytes escaped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmine.operators.lineage import running_start

#: Bytes that are looked at to tell binary content.
SNIFF_BYTES = 1024
#: What stands after each text of a joint corpus.
SEPARATOR = "\x01"
#: What ends a file in old packed corpora.
FILE_END = "\xff"


def is_binary(content: Column) -> Column:
    """Is there a NUL among the first 1024 bytes? Null for null and empty content."""
    head = F.hex(F.substring(content, 1, F.lit(SNIFF_BYTES)))
    return F.when(F.length(content) > 0, head.rlike("^(?:..)*00"))


def escape(text: Column) -> Column:
    r"""NUL as ``\0``, byte 1 as ``\1`` and ``\xff`` as ``\f``, so that neither end mark nor separator is in a text."""
    return F.replace(F.replace(F.replace(text, F.lit("\x00"), F.lit("\\0")), F.lit("\x01"), F.lit("\\1")), F.lit("\xff"), F.lit("\\f"))


def escape_bytes(content: Column) -> Column:
    r"""The same for bytes: 0 as ``\0``, 1 as ``\1`` and 255 as ``\f``; all others stay as they are, whatever they encode."""
    return F.encode(escape(F.decode(content, "ISO-8859-1")), "ISO-8859-1")


def drop_nul(text: Column) -> Column:
    """A text without its NULs."""
    return F.replace(text, F.lit("\x00"), F.lit(""))


def read_files(spark: SparkSession, path: str, max_bytes: int = 0, filter_binary: bool = True, escaped: bool = True) -> DataFrame:
    """(doc_id, path, data, text) of every file at ``path``, folders with all below them.

    Empty files and, with ``filter_binary``, binary ones are left out; ``max_bytes`` caps each file. ``data`` is the bytes,
    whatever they encode; ``text`` reads them as UTF-8, with U+FFFD for what isn't, and without a character that the cap cut through.
    ``doc_id`` is a hash of the path, so it stays the same from run to run and needs no global numbering.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").where(F.length("content") > 0)
    if filter_binary:
        files = files.where(~is_binary(F.col("content")))
    content = F.substring("content", 1, F.lit(max_bytes)) if max_bytes else F.col("content")
    text = F.make_valid_utf8(content.cast("string"))
    if max_bytes:
        cut_through = F.hex(F.substring("content", max_bytes + 1, F.lit(1))).rlike("^[89AB]")
        text = F.when(cut_through, F.regexp_replace(text, "\ufffd+$", "")).otherwise(text)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", (escape_bytes(content) if escaped else content).alias("data"), (escape(text) if escaped else text).alias("text"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of every file at and below ``path`` that isn't empty; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def read_strings(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(doc_id, text) of strings at hand, numbered from 0."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def cap_total(df: DataFrame, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first texts by id whose bytes, with a separator each, sum to at most ``max_bytes``.

    Sizes are summed in two steps, by range of ids and within it, so that no task sees all rows.
    """
    size, start = ("_".join((x, *df.columns)) for x in ("size", "start"))
    rows = running_start(df.withColumn(size, F.coalesce(F.octet_length(text_col), F.lit(0)) + 1), size, [id_col], start)
    return rows.where(F.col(start) + F.col(size) <= max_bytes).drop(size, start)


def pieces(df: DataFrame, group: Column, id_col: str = "doc_id", text_col: str = "text", separator: str = SEPARATOR) -> DataFrame:
    """(grp, start, doc_id, text): the joint text of each group as a relation of any size: its texts by id, each followed by the
    separator, and the characters before each. Null texts are left out; a null group is one."""
    rows = df.where(F.col(text_col).isNotNull()).select(group.alias("grp"), F.col(id_col).alias("doc_id"), F.concat(text_col, F.lit(separator)).alias("text"))
    return running_start(rows.withColumn("size", F.length("text")), "size", ["doc_id"], "start", "grp").select("grp", "start", "doc_id", "text")


def joined(df: DataFrame, group: Column | None = None, id_col: str = "doc_id", text_col: str = "text", separator: str = SEPARATOR) -> DataFrame:
    """(grp, text): the texts of each group by id, each followed by the separator. Without a group, of each text alone.

    A group's text is one value, so it must fit one (2 GB); ``pieces`` has no such bound. Old packers end a file with
    ``FILE_END`` instead of the separator.
    """
    if group is None:
        return df.select(F.col(id_col).alias("grp"), F.concat(text_col, F.lit(separator)).alias("text"))
    kept = df.where(F.col(text_col).isNotNull()).groupBy(group.alias("grp")).agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(text_col).alias("t")))).alias("all"))
    return kept.select("grp", F.array_join(F.transform("all", lambda x: F.concat(x["t"], F.lit(separator))), "").alias("text"))
