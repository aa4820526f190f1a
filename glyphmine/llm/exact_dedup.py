"""Exact deduplication by a Grace hash: partition by content, spill and partition again until a bucket fits its table.

Before the shuffle, each task puts the texts it reads in an open-addressing table, so that a content goes on once with the
least id and the number of its rows, under a token; each row keeps only its token. The shuffle is the first partitioning. Inside
a partition, contents go to such a table again, which compares complete contents. When it passes the memory bound, what
it holds and all that is still to come is written to ``FANOUT`` spill files by further hash bits, and each file is solved in
the same way. A content that has come before only gives a link from its token to the first one's, so however many rows
share it, no task holds them. Spill files are in the shared folder, named by task attempt, and removed when their task
ends; a task that is run again makes new ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmine.llm import textkit as tk

#: Bytes of content that one bucket's table may hold, and those of a task's before the shuffle, which is emptied then.
MEMORY, LOCAL_MEMORY = 96 << 20, 32 << 20
FANOUT = 16
#: Beyond this many spills the hash has no bits left: contents with equal hashes stay in one table.
DEEPEST = 15
_LOCAL = "token long, id long, at long, content binary, least long, n long"
_FOUND = "token long, first long, least long, of long, at long, n long"


def content_hashes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """64-bit hash of each row's bytes."""
    p, _ = tk._pow(len(data) + 1)
    out = np.zeros(len(offs) - 1, dtype=np.uint64)
    full = np.flatnonzero(np.diff(offs) > 0)
    if len(full):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
        lo, hi = offs[:-1][full], offs[1:][full]
        out[full] = tk.mix64((sums[hi] - sums[lo]) * tk._pow(len(data) + 1)[1][lo])
    return out


class Group:
    """The rows of one content so far: the token that stands for it, their number, and the least id (nulls last) with its row's token and place."""

    __slots__ = ("token", "least", "of", "at", "n")

    def __init__(self, token: int, least: int | None, of: int, at: int, n: int) -> None:
        self.token, self.least, self.of, self.at, self.n = token, least, of, at, n

    def add(self, least: int | None, of: int, at: int, n: int) -> None:
        self.n += n
        if (least is None, least or 0, of, at) < (self.least is None, self.least or 0, self.of, self.at):
            self.least, self.of, self.at = least, of, at


class Table:
    """Open addressing with linear probing; entries are distinct contents with their groups."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.content: list[bytes] = []
        self.groups: list[Group] = []
        self.bytes = 0

    def find(self, content: bytes, h: int) -> tuple[Group | None, int]:
        """The content's group, or None and the slot where it goes."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (e := slots[at]) >= 0:
            if self.hashes[e] == h and self.content[e] == content:
                return self.groups[e], at
            at = (at + 1) & mask
        return None, at

    def put(self, slot: int, content: bytes, h: int, group: Group) -> None:
        self.slots[slot] = len(self.content)
        self.hashes.append(h)
        self.content.append(content)
        self.groups.append(group)
        self.bytes += len(content) + 192
        if 2 * len(self.content) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        mask = 4 * len(self.slots) - 1
        self.slots = slots = [-1] * (mask + 1)
        for e, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = e


#: A content with its hash, its rows' group, and whether its token's link is already given.
Record = tuple[bytes, int, Group, bool]


class Spill:
    """One file of records in the shared folder."""

    KIND = pa.schema([("content", pa.large_binary()), ("h", pa.uint64()), *((k, pa.int64()) for k in Group.__slots__), ("linked", pa.bool_())])

    def __init__(self, fs: pa.fs.FileSystem, path: str) -> None:
        self.fs, self.path = fs, path
        self.file = fs.open_output_stream(path)
        self.out = pa.ipc.new_stream(self.file, self.KIND)
        self.rows: list[Record] = []
        self.held = 0

    def add(self, record: Record) -> None:
        self.rows.append(record)
        self.held += len(record[0]) + 192
        if self.held > 1 << 20:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            content, h, group, linked = zip(*self.rows, strict=True)
            stats = [pa.array([getattr(g, k) for g in group], pa.int64()) for k in Group.__slots__]
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.array(content, pa.large_binary()), pa.array(np.array(h, dtype=np.uint64)), *stats, pa.array(linked)], schema=self.KIND))
            self.rows, self.held = [], 0

    def read(self) -> Iterator[Record]:
        self.flush()
        self.out.close()
        self.file.close()
        with self.fs.open_input_stream(self.path) as f, pa.ipc.open_stream(f) as batches:
            for b in batches:
                content, h, *stats, linked = (c.to_pylist() for c in b.columns)
                for c, x, s, known in zip(content, h, zip(*stats, strict=True), linked, strict=True):
                    yield c, x, Group(*s), known
        self.fs.delete_file(self.path)


def solve(records: Iterator[Record], new_spill: Callable[[], Spill], memory: int, depth: int = 0) -> Iterator[tuple[int, int] | Group]:
    """(token, first token) for each record that isn't linked yet, and the group of each distinct content."""
    table = Table()
    for content, h, group, linked in records:
        known, slot = table.find(content, h)
        if known is None:
            table.put(slot, content, h, group)
        else:
            known.add(group.least, group.of, group.at, group.n)
        if not linked:
            yield group.token, (known or group).token
        if table.bytes > memory and depth < DEEPEST and len(table.content) > 1:
            files = [new_spill() for _ in range(FANOUT)]
            # what the table holds comes first in its file, so it stays the first of its content
            for part in (((c, x, g, True) for c, x, g in zip(table.content, table.hashes, table.groups, strict=True)), records):
                for r in part:
                    files[r[1] >> (60 - 4 * depth) & (FANOUT - 1)].add(r)
            del table
            for f in files:
                yield from solve(f.read(), new_spill, memory, depth + 1)
            return
    yield from table.groups


def _contents(column: pa.Array) -> Iterator[tuple[int, bytes, int]]:
    """(row, content, hash) of each row."""
    for lo, _, data, offs in tk.chunks(column):
        raw = data.tobytes()
        for k, (a, b, h) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), content_hashes(data, offs).tolist(), strict=True)):
            yield lo + k, raw[a:b], h


def _locals(memory: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) in; out a row (token, id, place) for each, and (token, content, least id, its place, rows) for each content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, token, place = Table(), TaskContext.get().partitionId() << 36, 0
        names = ["token", "id", "at", "content", "least", "n"]

        def held() -> pa.RecordBatch:
            g = table.groups
            ints = lambda k: pa.array([getattr(x, k) for x in g], pa.int64())
            return pa.RecordBatch.from_arrays([ints("token"), pa.nulls(len(g), pa.int64()), ints("at"), pa.array(table.content, pa.binary()), ints("least"), ints("n")], names=names)

        for batch in batches:
            ids, tokens = batch.column(0).to_pylist(), []
            for row, content, h in _contents(batch.column(1)):
                known, slot = table.find(content, h)
                if known is None:
                    if table.bytes > memory:
                        yield held()
                        table = Table()
                        slot = h & (len(table.slots) - 1)
                    known = Group(token, ids[row], token, place + row, 1)
                    table.put(slot, content, h, known)
                    token += 1
                else:
                    known.add(ids[row], known.token, place + row, 1)
                tokens.append(known.token)
            n = len(tokens)
            nothing = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), batch.column(0), pa.array(np.arange(place, place + n)), pa.nulls(n, pa.binary()), nothing, nothing], names=names)
            place += n
        if table.groups:
            yield held()

    return run


def _buckets(folder: str, memory: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(token, content, least, at, n) in; out (token, first) links, and (first, least, of, at, n) with a null token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where: list = []

        def new_spill() -> Spill:
            if not where:
                own, path = fs.FileSystem.from_uri(folder)
                where.extend([own, f"{path}/grace-{uuid.uuid4().hex}"])
                own.create_dir(where[1])
            return Spill(where[0], f"{where[1]}/{uuid.uuid4().hex}")

        def records() -> Iterator[Record]:
            for batch in batches:
                token, least, at, n = (batch.column(k).to_pylist() for k in (0, 2, 3, 4))
                for row, content, h in _contents(batch.column(1)):
                    yield content, h, Group(token[row], least[row], token[row], at[row], n[row]), False

        def answer(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["token", "first", "least", "of", "at", "n"])

        try:
            rows: list[tuple] = []
            for found in solve(records(), new_spill, memory):
                rows.append((None, found.token, found.least, found.of, found.at, found.n) if isinstance(found, Group) else (*found, None, None, None, None))
                if len(rows) >= 20_000:
                    yield answer(rows)
                    rows = []
            if rows:
                yield answer(rows)
        finally:
            if where:
                where[0].delete_dir(where[1])
            tk.release()

    return run


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """(doc_id, first_id, copies, kept) for each row: the least id with the same content, the rows that have it, and whether this is the one to keep.

    Contents are compared byte by byte. One row of each content is kept: one with the least id, a null id last.
    Empty texts are copies of each other. A null text is no copy of anything: it is kept, with its own id and one
    copy. Rows that repeat as a whole are copies. Other columns are ignored; an empty table gives no rows.
    """
    rows = tk.small_batches(df).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    folder = tk.shared_dir(df.sparkSession)
    local = tk.cut(rows.where("t is not null").mapInArrow(_locals(min(memory, LOCAL_MEMORY)), _LOCAL))
    contents = local.where("content is not null").select("token", "content", "least", "at", "n")
    found = tk.cut(contents.repartition("content").mapInArrow(_buckets(folder, memory), _FOUND))
    whole = found.where("token is null").drop("token")
    known = found.where("token is not null").select("token", "first").join(whole, "first").select("token", "least", "of", F.col("at").alias("place"), "n")
    own = local.where("content is null").select("token", "id", "at")
    out = own.join(known, "token").select(F.col("id").alias("doc_id"), F.col("least").alias("first_id"), F.col("n").alias("copies"), ((F.col("token") == F.col("of")) & (F.col("at") == F.col("place"))).alias("kept"))
    return out.unionByName(rows.where("t is null").select(F.col("i").alias("doc_id"), F.col("i").alias("first_id"), F.lit(1).cast("long").alias("copies"), F.lit(True).alias("kept")))


GROUPS_SQL = """
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS first_id,
       CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS copies,
       text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1 AS kept
FROM documents
"""
