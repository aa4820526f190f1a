"""Binary files of an index, for exchange: BWT, symbol counts, rank map, suffix array and common prefixes.

All numbers are big-endian, or little-endian with ``big=False``: ``bwt``: int64 size, int64 eof, bytes (the cell at
eof has its neighbour's byte); ``aux``: 256 int64 counts; ``fm``: byte 4, int64 size, int32s; ``sa`` and ``lcp``: int32s.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def bwt_file(bwt: bytes, eof: int, big: bool = True) -> bytes:
    cell = bwt[eof - 1 : eof] or bwt[1:2] or b"\0"
    return struct.pack(">qq" if big else "<qq", len(bwt), eof) + bwt[:eof] + cell + bwt[eof + 1 :]


def read_bwt_file(content: bytes, big: bool = True) -> tuple[bytes, int]:
    """The BWT with 0 at eof, and eof; ValueError if the size isn't the content's."""
    n, eof = struct.unpack(">qq" if big else "<qq", content[:16])
    if len(content) != n + 16 or not 0 <= eof < n:
        raise ValueError("a BWT file of another size than it says")
    bwt = content[16:]
    return bwt[:eof] + b"\0" + bwt[eof + 1 :], eof


def ints(values: list[int] | np.ndarray, big: bool = True, size: int = 4) -> bytes:
    return np.array(values, dtype=f"{'>' if big else '<'}i{size}").tobytes()


def read_ints(content: bytes, big: bool = True, size: int = 4) -> list[int]:
    return np.frombuffer(content, dtype=f"{'>' if big else '<'}i{size}").tolist()


def fm_file(psi: list[int] | np.ndarray, big: bool = True) -> bytes:
    return b"\4" + struct.pack(">q" if big else "<q", len(psi)) + ints(psi, big)


def read_fm_file(content: bytes, big: bool = True) -> list[int]:
    n = struct.unpack(">q" if big else "<q", content[1:9])[0]
    if content[0] != 4 or len(content) != 9 + 4 * n:
        raise ValueError("an FM file of another size than it says")
    return read_ints(content[9:], big)


def _psi(bwt: bytes, eof: int) -> np.ndarray:
    code = np.frombuffer(bwt, np.uint8).astype(np.uint16) + 1  # 16 bits are sorted by radix
    code[eof] = 0
    return np.argsort(code, kind="stable")


def psi_of(bwt: bytes, eof: int) -> list[int]:
    """The stable sort of a BWT's rows by symbol, the end mark first."""
    return _psi(bwt, eof).tolist()


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, and where each list begins."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]


def files(index: DataFrame, big: bool = True) -> DataFrame:
    """(doc_id, kind, content): the five files of each index row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 64):  # so that few files are held at a time
                ids, bwt, eof, sa, lcp = whole.slice(lo, 64).columns
                out: list[bytes] = []
                (ranks, r), (common, k) = _flat(sa), _flat(lcp)
                for i, (b, e) in enumerate(zip(bwt.to_pylist(), eof.to_pylist(), strict=True)):
                    count = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
                    count[b[e]] -= 1
                    out += [bwt_file(b, e, big), ints(count, big, 8), fm_file(_psi(b, e), big), ints(ranks[r[i] : r[i + 1]], big), ints(common[k[i] : k[i + 1]], big)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(ids)), 5))), pa.array(["bwt", "aux", "fm", "sa", "lcp"] * len(ids), pa.string()), pa.array(out, pa.binary())], names=["doc_id", "kind", "content"])

    return index.select("doc_id", "bwt", "eof", "sa", "lcp").mapInArrow(run, f"doc_id {dict(index.dtypes)['doc_id']}, kind string, content binary")
