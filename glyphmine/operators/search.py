"""Exact substring queries: counts, places, contexts, and the interval steps of backward search.

Counting and locating on plain documents need no index: a literal's occurrences are found by scanning, after a
``contains`` filter that Spark evaluates in generated code. Index forms work on ``build_index`` rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmine.operators import kernels as kn


def count(df: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, cnt): overlapping occurrences of a literal in every text that has it; an empty one occurs length + 1 times."""
    text = F.col(text_col).cast("string")
    if not pattern:
        return df.where(text.isNotNull()).select(F.col(id_col).alias("doc_id"), (F.length(text) + 1).cast("long").alias("cnt"))
    quoted = "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in pattern)
    return df.where(text.contains(pattern)).select(F.col(id_col).alias("doc_id"), F.regexp_count(text, F.lit(f"(?=(?:{quoted}))")).cast("long").alias("cnt"))


def locate(df: DataFrame, pattern: str, context: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, stop, before, after): every overlapping occurrence, in code points from 0, with ``context`` characters around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                i = text.find(pattern)
                while i >= 0:
                    rows.append(k)
                    at.append((i, i + len(pattern), text[max(0, i - context) : i], text[i + len(pattern) : i + len(pattern) + context]))
                    i = text.find(pattern, i + 1)
            a, b, before, after = zip(*at, strict=True) if at else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(before, pa.string()), pa.array(after, pa.string())], names=["doc_id", "start", "stop", "before", "after"])

    if not pattern:
        raise ValueError("an empty pattern is everywhere")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).where(F.col("t").contains(pattern))
    return rows.mapInArrow(run, "doc_id long, start int, stop int, before string, after string")


def interval(index: DataFrame, pattern: bytes) -> DataFrame:
    """(doc_id, sp, ep, cnt): the ranks [sp, ep) of the suffixes that begin with ``pattern``, by backward search; texts without it have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [kn.search_by_counting(b, e, pattern) for b, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            rows = [k for k, g in enumerate(got) if g]
            sp, ep = (np.array([got[k][x] for k in rows], dtype=np.int32) for x in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sp), pa.array(ep), pa.array((ep - sp).astype(np.int32))], names=["doc_id", "sp", "ep", "cnt"])

    return index.select("doc_id", "bwt", "eof").mapInArrow(run, "doc_id long, sp int, ep int, cnt int")


def interval_places(index: DataFrame, pattern: bytes) -> DataFrame:
    """(doc_id, n, place): where the suffixes of ``interval`` begin, read from ``sa`` in the same pass; ``n`` is the text's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, rows, places = batch.column(3), [], [np.zeros(0, np.int32)]
            values, at = sa.flatten().to_numpy(zero_copy_only=False), sa.offsets.to_numpy() - sa.offsets[0].as_py()
            for k, (b, e) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if got := kn.search_by_counting(b, e, pattern):
                    rows += [k] * (got[1] - got[0])
                    places.append(values[at[k] + got[0] : at[k] + got[1]])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(4).take(take), pa.array(np.concatenate(places).astype(np.int32))], names=["doc_id", "n", "place"])

    return index.select("doc_id", "bwt", "eof", "sa", "n").mapInArrow(run, "doc_id long, n int, place int")


def previous_bytes(index: DataFrame, sp: int, ep: int, least: int = 0, most: int = 255) -> DataFrame:
    """(doc_id, c, sp, ep): for every byte from ``least`` to ``most`` before a suffix of the ranks [sp, ep), the ranks of the suffixes with it in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (b, e) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                ranks = kn.Ranks(np.frombuffer(b, np.uint8), e)
                hi = min(ep, ranks.n)
                rows += [(k, c, *got) for c in ranks.distinct(sp, hi) if least <= c <= most and (got := ranks.before(sp, hi, c))]
            k, *cols = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k, pa.int64())), *(pa.array(x, pa.int32()) for x in cols)], names=["doc_id", "c", "sp", "ep"])

    return index.select("doc_id", "bwt", "eof").mapInArrow(run, "doc_id long, c int, sp int, ep int")


def backward_steps(index: DataFrame, pattern: bytes) -> DataFrame:
    """(doc_id, step, c, sp, ep): the interval after each byte of ``pattern`` from its end on, until it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (b, e) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                rows += [(k, step, c, sp, hi) for step, (c, sp, hi) in enumerate(kn.steps_by_counting(b, e, pattern), 1) if sp < hi]
            k, *cols = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k, pa.int64())), *(pa.array(x, pa.int32()) for x in cols)], names=["doc_id", "step", "c", "sp", "ep"])

    return index.select("doc_id", "bwt", "eof").mapInArrow(run, "doc_id long, step int, c int, sp int, ep int")


def occ(index: DataFrame, c: int, rank: int) -> DataFrame:
    """(doc_id, cf, occ): bytes less than c (the end mark included), and c's in rows up to and including ``rank``."""
    @F.arrow_udf("array<int>")
    def both(bwt: pa.Array, eof: pa.Array) -> pa.Array:
        return pa.array([kn.occ_by_counting(b, e, c, min(rank, len(b) - 1)) for b, e in zip(bwt.to_pylist(), eof.to_pylist(), strict=True)], pa.list_(pa.int32()))

    return index.select("doc_id", both("bwt", "eof").alias("x")).select("doc_id", F.col("x")[0].alias("cf"), F.col("x")[1].alias("occ"))


def extract(index: DataFrame, rank: int, length: int) -> DataFrame:
    """(doc_id, next, prev): up to ``length`` bytes from the suffix of a rank on, and those before it; texts without the rank have no row."""
    pos = F.col("sa")[rank]
    kept = index.where(F.col("n") >= rank)
    start = F.greatest(pos - length, F.lit(0))
    return kept.select("doc_id", F.substring("data", pos + 1, F.lit(length)).alias("next"), F.when(pos > 0, F.substring("data", start + 1, pos - start)).otherwise(F.lit(b"")).alias("prev"))


def at_rank(index: DataFrame, rank: int) -> DataFrame:
    """(doc_id, pos, c, lcp): the place, the byte before and the common prefix with the next of one rank; texts without the rank have no row.

    Only what is at the rank leaves the scan; on a stored index with a filter on ``doc_id`` it is a point read.
    """
    c = F.conv(F.hex(F.substring("bwt", rank + 1, F.lit(1))), 16, 10).cast("int")
    kept = index.where(F.col("n") >= rank)
    return kept.select("doc_id", F.col("sa")[rank].alias("pos"), F.when(F.col("eof") != rank, c).alias("c"), F.when(F.col("n") > rank, F.col("lcp")[rank]).alias("lcp"))


def first_byte(index: DataFrame, rank: int) -> DataFrame:
    """(doc_id, c): the first byte of the suffix of a rank; null for the empty suffix."""
    return index.where(F.col("n") >= rank).select("doc_id", F.conv(F.hex(F.substring("data", F.col("sa")[rank] + 1, F.lit(1))), 16, 10).cast("int").alias("c"))


def tail(df: DataFrame, offset: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tail): each text from a code point on, up to the first NUL."""
    rest = F.expr(f"substring(`{text_col}`, {offset + 1})")
    return df.select(F.col(id_col).alias("doc_id"), F.substring_index(rest, "\0", 1).alias("tail"))


def quote(pattern: str) -> str:
    """A literal as a regular expression of this engine."""
    return re.sub(r"([()|*+?\[\]\\.])", r"\\\1", pattern)
