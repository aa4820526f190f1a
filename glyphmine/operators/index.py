"""Full-text indexes of documents: symbol counts, suffix array, BWT, rank maps and common prefixes.

A document is a shard: its index is one row, made in one pass of a vectorised kernel, so building needs no shuffle
and scales with the number of documents. ``suffix_rows`` gives the same as a relation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmine.operators import kernels as kn

INDEX_SCHEMA = "doc_id long, n int, data binary, sa array<int>, bwt binary, eof int, lcp array<int>"


def _input(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    data = text if dict(df.dtypes)[text_col] == "binary" else F.encode(text.cast("string"), "utf-8")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data")).where("data is not null")


def _int_lists(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values.astype(np.int32)))


def _binaries(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _sorted_texts(batches: Iterator[pa.RecordBatch], orientation: str) -> Iterator[tuple[pa.Array, kn.Suffixes, np.ndarray, np.ndarray]]:
    """(ids, suffixes, bytes, offsets) of a few texts at a time."""
    for batch in batches:
        data, offs = kn.buffers(batch.column(1))
        for lo, hi in kn.passes(offs, kn.SORT_BYTES):
            own, at = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            if orientation == "reversed":
                own = kn.reverse_each(own, at)
            yield batch.column(0).slice(lo, hi - lo), kn.Suffixes(own, at), own, at


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", orientation: str = "forward", columns: tuple[str, ...] = ("n", "data", "sa", "bwt", "eof", "lcp")) -> DataFrame:
    """(doc_id, n, data, sa, bwt, eof, lcp) for each text; only those of ``columns`` are worked out.

    ``sa[r]`` is the place of the suffix of rank r; rank 0 is the empty suffix, so there are n + 1 of them. ``bwt`` has
    the byte before each suffix and 0 at rank ``eof``, which is the whole text's. ``lcp[r]`` is the common prefix of
    ranks r and r + 1 (n entries). With orientation 'reversed', texts are indexed backwards. Null texts have no
    index; an empty text has the empty suffix alone.
    """

    def one(name: str, s: kn.Suffixes, data: np.ndarray, offs: np.ndarray) -> pa.Array:
        if name == "n":
            return pa.array(np.diff(offs).astype(np.int32))
        if name == "data":
            return _binaries(data, offs)
        if name == "sa":
            return _int_lists(s.array(), s.first)
        if name == "bwt":
            return _binaries(np.maximum(s.bwt() - 1, 0).astype(np.uint8), s.first)
        if name == "eof":
            return pa.array(s.whole().astype(np.int32))
        keep = np.ones(int(s.first[-1]), dtype=bool)
        keep[s.first[1:] - 1] = False
        return _int_lists(s.lcp()[keep], offs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s, data, offs in _sorted_texts(batches, orientation):
            yield pa.RecordBatch.from_arrays([ids, *(one(c, s, data, offs) for c in columns)], names=["doc_id", *columns])

    kinds = dict(x.rsplit(" ", 1) for x in INDEX_SCHEMA.split(", "))
    return _input(df, id_col, text_col).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *columns)))


def suffix_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", orientation: str = "forward", columns: tuple[str, ...] = ("rank", "pos", "c", "psi", "lf", "lcp")) -> DataFrame:
    """(doc_id, rank, pos, c, psi, lf, lcp): a row for each suffix of each text; only those of ``columns`` are worked out.

    ``c`` is the byte before the suffix, null for the whole text; ``psi`` and ``lf`` are the ranks of the suffixes one
    byte shorter and longer, around the end; ``lcp`` is null at the last rank. ``columns`` may also name ``occ``, how many
    rows of the text up to and including this one have its byte, null for the whole text's, and ``greater``: is the suffix
    greater than the whole text?
    """

    def one(name: str, s: kn.Suffixes) -> pa.Array:
        if name == "greater":
            return pa.array(s.ranks() > s.whole()[s.text])
        if name == "c":
            bwt = s.bwt()
            return pa.array((bwt - 1).astype(np.int32), mask=bwt == 0)
        if name == "occ":
            return pa.array(s.occ().astype(np.int32), mask=s.bwt() == 0)
        if name == "lcp":
            last = np.zeros(int(s.first[-1]), dtype=bool)
            last[s.first[1:] - 1] = True
            return pa.array(s.lcp().astype(np.int32), mask=last)
        return pa.array({"rank": s.ranks, "pos": s.array, "psi": s.psi, "lf": s.lf}[name]().astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s, _, _ in _sorted_texts(batches, orientation):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(s.text)), *(one(c, s) for c in columns)], names=["doc_id", *columns])

    return _input(df, id_col, text_col).mapInArrow(run, ", ".join(["doc_id long", *(f"{c} {'boolean' if c == 'greater' else 'int'}" for c in columns)]))


def inverse_suffix_arrays(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, isa): the rank of the suffix at each place of each text, the empty one's (0) last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in kn.passes(kn.buffers(batch.column(1))[1], kn.SORT_BYTES):
                s = kn.Suffixes(*kn.buffers(batch.column(1).slice(lo, hi - lo)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _int_lists(s.inverse(), s.first)], names=["doc_id", "isa"])

    return _input(df, id_col, text_col).mapInArrow(run, "doc_id long, isa array<int>")


def int_suffix_arrays(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """(doc_id, sa): suffix arrays of arrays of integers; elements compare as numbers, nulls in an array fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.array([len(x) for x in lists.to_pylist()], dtype=np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            code = np.unique(values, return_inverse=True)[1] if len(values) else np.zeros(0, np.int64)
            s = kn.Suffixes(code + 512, np.r_[0, np.cumsum(size)])
            yield pa.RecordBatch.from_arrays([batch.column(0), _int_lists(s.array(), s.first)], names=["doc_id", "sa"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(array_col).cast("array<long>").alias("a")).where("a is not null")
    return rows.mapInArrow(run, "doc_id long, sa array<int>")


def symbol_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: bool = False) -> DataFrame:
    """(doc_id, c, cnt, start): how often each byte occurs in each text, and how many of its bytes are less.

    With ``dense``, all 256 bytes of each text. Without, texts that are empty have no rows. Null texts have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in kn.passes(kn.buffers(batch.column(1))[1]):
                data, offs = kn.buffers(batch.column(1).slice(lo, hi - lo))
                for a in range(0, hi - lo, 4096):  # so that the counts stay small
                    b = min(a + 4096, hi - lo)
                    text = np.repeat(np.arange(b - a), np.diff(offs[a : b + 1]))
                    cnt = np.bincount(text << 8 | data[offs[a] : offs[b]], minlength=(b - a) << 8).reshape(-1, 256)
                    start = np.cumsum(cnt, axis=1) - cnt
                    t, c = np.nonzero(cnt if not dense else np.ones_like(cnt))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo + a, b - a).take(pa.array(t)), pa.array(c.astype(np.int32)), pa.array(cnt[t, c]), pa.array(start[t, c])], names=["doc_id", "c", "cnt", "start"])

    return _input(df, id_col, text_col).mapInArrow(run, "doc_id long, c int, cnt long, start long")


def with_ends(counts: DataFrame) -> DataFrame:
    """``symbol_counts`` with ``end``, the last rank of a byte's bucket when ranks count from 0 without the end mark; less than ``start`` for an empty one."""
    return counts.withColumn("end", F.col("start") + F.col("cnt") - 1)


def corpus_symbol_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(c, cnt, start): the same over all texts together."""
    total = symbol_counts(df, id_col, text_col).groupBy("c").agg(F.sum("cnt").alias("cnt"))
    # at most 256 rows: one partition is enough
    return total.withColumn("start", F.sum("cnt").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1))).select("c", "cnt", F.coalesce("start", F.lit(0)).cast("long").alias("start"))


def occurrence_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``suffix_rows`` with ``occ``: how many rows up to and including this one have its byte; null for the end mark."""
    return suffix_rows(df, id_col, text_col, columns=("rank", "pos", "c", "psi", "lf", "lcp", "occ"))


def greater_than_whole(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, rank, greater): without the end mark's row, is each suffix greater than the whole text?"""
    rows = suffix_rows(df, id_col, text_col, columns=("pos", "rank", "greater"))
    return rows.where("rank > 0").select("doc_id", "pos", (F.col("rank") - 1).alias("rank"), "greater")


def sorted_column(data: Column | str, sa: Column | str) -> Column:
    """Does ``sa`` list every suffix of ``data`` once and in order? In linear time.

    Nothing is sorted again: neighbours must have their first bytes in order, and where these are equal, the suffixes one
    byte shorter must be in order by the ranks that ``sa`` itself gives them.
    """

    @F.arrow_udf("boolean")
    def ok(data: pa.Array, sa: pa.Array) -> pa.Array:
        raw, offs = kn.buffers(data)
        values, at = sa.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(sa), 0).to_numpy(zero_copy_only=False))]
        return pa.array([in_order(raw[offs[k] : offs[k + 1]], values[at[k] : at[k + 1]]) for k in range(len(data))], pa.bool_())

    return ok(data, sa)


def is_sorted(index: DataFrame) -> DataFrame:
    """(doc_id, sorted): a check of an index against its text, in linear time."""
    return index.select("doc_id", sorted_column("data", "sa").alias("sorted"))


def in_order(data: np.ndarray, sa: np.ndarray) -> bool:
    """Is ``sa`` the suffix array, the empty suffix included?"""
    n = len(data)
    if len(sa) != n + 1 or sa[0] != n or (sa < 0).any() or (sa > n).any() or (np.bincount(sa, minlength=n + 1) != 1).any():
        return False
    rank = np.empty(n + 2, dtype=np.int64)
    rank[sa] = np.arange(n + 1)
    first, then = data[sa[1:]].astype(np.int64), rank[sa[1:] + 1]
    return bool(((first[1:] > first[:-1]) | (first[1:] == first[:-1]) & (then[1:] > then[:-1])).all())


def texts_of(index: DataFrame) -> DataFrame:
    """(doc_id, data): the texts as the BWTs give them back."""

    @F.arrow_udf("binary")
    def text(bwt: pa.Array, eof: pa.Array) -> pa.Array:
        out: list[bytes] = []
        ends = eof.to_numpy(zero_copy_only=False)
        for lo, hi in kn.passes(kn.buffers(bwt)[1], kn.SORT_BYTES):
            data, first = kn.buffers(bwt.slice(lo, hi - lo))
            if hi - lo == 1 and len(data) > 2 * kn.SORT_BYTES:  # beyond the cache a walk is faster
                out.append(kn.inverse_bwt(data.tobytes(), int(ends[lo])))
                continue
            raw, offs = kn.inverse_bwts(data, first, ends[lo:hi])
            raw = raw.tobytes()
            out += [raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return pa.array(out, pa.binary())

    return index.select("doc_id", text("bwt", "eof").alias("data"))


def byte_at(data: Column, place: Column) -> Column:
    """The byte at a place (from 0) of a binary column, as a number."""
    return F.conv(F.hex(F.substring(data, place + 1, F.lit(1))), 16, 10).cast("int")
