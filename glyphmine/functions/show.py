"""For people at a terminal: bytes, tables of suffixes and times."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame


def byte(c: int | None) -> str:
    """A byte as it prints, else as two hexadecimal digits; '$' for the end mark (None)."""
    return "$" if c is None else chr(c) if 32 <= c <= 126 else f"{c:02x}"


def suffix_table(rows: DataFrame, text: bytes, width: int = 20) -> str:
    """The suffix rows of one document (``index.suffix_rows``, of this text) as lines: rank, place, byte before, suffix."""
    out = []
    for r in rows.orderBy("rank").collect():  # of one document
        suffix = "".join(byte(c) for c in text[r.pos : r.pos + width])
        out.append(f"{r['rank']:>6} {r.pos:>6} {byte(r.c):>3}  {suffix}{'' if r.pos + width < len(text) else '$'}")
    return "\n".join(out)


@contextmanager
def timed(what: str) -> Iterator[None]:
    """Prints how long the block took."""
    began = time.monotonic()
    yield
    print(f"{what}: {time.monotonic() - began:.1f} s")
