"""Scalar helpers of the index: printing, integer codes, borders, suffix types, run-length bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def pretty_byte(code: Column) -> Column:
    """A byte as its printable ASCII character, else as two hexadecimal digits; null stays null."""
    return F.when(code.between(32, 126), F.char(code.cast("long"))).otherwise(F.lpad(F.hex(code.cast("long")), 2, "0"))


def gamma_length(n: Column) -> Column:
    """Bits of the Elias gamma code of n: 2 * bits - 1; -1 for 0, null for less."""
    return F.when(n == 0, -1).when(n > 0, 2 * F.length(F.bin(n.cast("long"))) - 1).cast("int")


def kmp_borders(text: Column) -> Column:
    """Of each prefix the length of its longest proper border, as an array; null stays null, '' gives an empty array. Linear time."""

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else borders(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return of(text)


def borders(data: bytes | str) -> list[int]:
    """The same for one text or bytes."""
    out = [0] * len(data)
    k = 0
    for i in range(1, len(data)):
        while k and data[i] != data[k]:
            k = out[k - 1]
        k += data[i] == data[k]
        out[i] = k
    return out


def suffix_types(text: Column) -> Column:
    """'S' or 'L' of every suffix of a text and of the empty one: S if it is less than the next suffix; the empty one is S. Linear time."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else types_of(t) for t in texts.to_pylist()], pa.string())

    return of(text)


def types_of(text: str) -> str:
    """The same for one text."""
    point = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    # a suffix is S if the next other character after its first is greater
    step = np.r_[np.sign(np.diff(point)), -1] if len(point) else np.zeros(0, np.int64)
    at = np.where(step != 0, np.arange(len(step)), len(step))
    next_ = np.minimum.accumulate(at[::-1])[::-1]
    return "".join(np.where(step[next_] > 0, "S", "L").tolist()) + "S"


def lms_positions(types: Column) -> Column:
    """Positions of 'S' right after 'L' in a string of suffix types."""
    n = F.length(types)
    return F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(types, i, 2) == "LS")


def encode_bits(bits: list[bool], least: int = 16) -> str:
    """Bits as '0'/'1' text: runs of ``least`` or more are a mark and an Elias gamma code, others stay as they are.

    '1' + bit + gamma(length) for a run, '0' + bit for a single bit.
    """
    out, at = [], 0
    while at < len(bits):
        end = at
        while end < len(bits) and bits[end] == bits[at]:
            end += 1
        bit = "1" if bits[at] else "0"
        if end - at >= least:
            b = bin(end - at)[2:]
            out.append("1" + bit + "0" * (len(b) - 1) + b)
        else:
            out.append(("0" + bit) * (end - at))
        at = end
    return "".join(out)


def run_code(bits: Column, least: int = 16) -> Column:
    """``encode_bits`` of a column of boolean arrays; null stays null."""

    @F.arrow_udf("string")
    def of(arrays: pa.Array) -> pa.Array:
        return pa.array([None if b is None else encode_bits(b, least) for b in arrays.to_pylist()], pa.string())

    return of(bits)


def decode_bits(code: str) -> list[bool]:
    """The bits of ``encode_bits``."""
    out, at = [], 0
    while at < len(code):
        run, bit, at = code[at] == "1", code[at + 1] == "1", at + 2
        n = 1
        if run:
            zeros = 0
            while code[at + zeros] == "0":
                zeros += 1
            n = int(code[at + zeros : at + 2 * zeros + 1], 2)
            at += 2 * zeros + 1
        out += [bit] * n
    return out
