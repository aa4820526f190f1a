"""Near-duplicate groups: SimHash fingerprints searched by multi-index hashing.

A fingerprint is cut into segments, each of which is a hash table: each document is put in the tables under its own
segment and every segment at Hamming distance 1, and looks itself up under the same ball, so two documents meet
in a table exactly when that segment differs in at most 2 bits. Every meeting is verified by the distance of the complete
fingerprints. That finds most near pairs and whatever is in large groups, but not each pair.

The rest is found by an exact search, which compares what isn't in one group yet. A fingerprint is cut once more, into so many
segments that two within the radius differ in at most 2 bits of one at least (14 of about 18 bits for 40 of 256). Nodes are
cut into parts, and each two parts are a task, which has the fingerprints of both at hand and looks up the whole ball of
radius 2 around each segment. No near pair is left out. On unlike texts 1 to 2 % of all pairs are met and compared.

Segments have 32 bits, or 14 more than the binary logarithm of the documents if that is more, so that a document meets
less than about one other by chance however many there are. Up to 2**18 documents a fingerprint has eight segments, 256 bits. Wider
segments are met less often by near documents, so there are more of them: as many as let at least nine in ten pairs at a
tenth of the bits meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmine.llm import textkit as tk
from glyphmine.llm.components import components

BITS = 256
#: Distance up to which two documents are near duplicates, of ``BITS`` bits; longer fingerprints have the same share.
RADIUS = 40
#: Segments at least, each of which is a table, and their bits at least.
SEGMENTS, WIDTH = 8, 32
#: Bits of a segment beyond the logarithm of the documents.
SPARE_BITS = 14
#: Buckets up to this size give their pairs; larger ones are searched with their fingerprints at hand.
PAIRS_UP_TO = 48
#: Buckets of more are first cut down by one of their documents, and the rest is compared in blocks of so many.
HOT_BUCKET = 8192
#: Rows of sorted keys that are looked at together; a key of more is a large bucket.
TOGETHER = 200_000
#: Fingerprints of a part of the exact search, at most; smaller tables are cut into up to ``PARTS`` parts of ``LEAST_PART`` or more.
PART, LEAST_PART, PARTS = 1 << 19, 1 << 14, 5
#: Tasks of the exact search at most; each has its share of the pairs of parts, one after the other.
SEARCH_TASKS = 4096
#: Pairs of fingerprints that are compared together.
COMPARED = 1 << 18
_STEP = 0x632BE59BD9B4E019


@dataclass(frozen=True)
class Shape:
    """Segments and their bits."""

    segments: int = SEGMENTS
    width: int = WIDTH

    @property
    def lanes(self) -> list[str]:
        """Columns of 64 bits of a fingerprint."""
        return [f"f{k}" for k in range(-(-self.segments * self.width // 64))]

    @property
    def complete(self) -> int:
        """The distance up to which every pair meets in a table."""
        return 3 * self.segments - 1

    def radius(self, of_bits: int = RADIUS) -> int:
        """``of_bits`` of ``BITS`` bits, for these fingerprints."""
        return of_bits * 64 * len(self.lanes) // BITS


def shape(n: int) -> Shape:
    """The shape for ``n`` documents."""
    width = max(WIDTH, ceil(log2(max(n, 2))) + SPARE_BITS)
    if width == WIDTH:
        return Shape()
    meet = sum(comb(width, k) * 0.1**k * 0.9 ** (width - k) for k in range(3))
    return Shape(max(SEGMENTS, ceil(log2(0.1) / log2(1 - meet))), width)


def fingerprints(data: np.ndarray, offs: np.ndarray, lanes: int = BITS // 64) -> tuple[np.ndarray, np.ndarray]:
    """(n, lanes) uint64 SimHash of the set of words of each row, and whether the row has a word at all."""
    n = len(offs) - 1
    out, has = np.zeros((n, lanes), dtype=np.uint64), np.zeros(n, dtype=bool)
    h, row = tk.word_hashes(data, offs)
    if not len(h):
        return out, has
    table, code, row = tk.distinct_per_row(h, row)
    every = np.stack([tk.mix64(table + np.uint64(k * _STEP & 0xFFFFFFFFFFFFFFFF)) for k in range(lanes)], axis=1)
    bits = np.unpackbits(every.view(np.uint8), axis=1, bitorder="little")  # (words, bits)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[first, len(row)])
    # a byte for each bit, eight to an integer: sums of at most 255 words don't overflow
    lanes8 = bits.view(np.uint64)
    votes = np.zeros((len(first), 64 * lanes), dtype=np.int32)
    for i, (lo, n_words) in enumerate(zip(first.tolist(), size.tolist(), strict=True)):
        for at in range(lo, lo + n_words, 255):
            votes[i] += np.add.reduce(lanes8[code[at : min(at + 255, lo + n_words)]], axis=0).view(np.uint8)
    packed = np.packbits(votes * 2 > size[:, None], axis=1, bitorder="little").view(np.uint64)
    at = row[first]
    out[at], has[at] = packed, True
    return out, has


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: Shape = Shape(), more: dict | None = None) -> DataFrame:
    """(id, f0, f1, ...): the fingerprint of each row's words; null lanes where the text is null or has no word. ``more``: long columns to carry along."""
    lanes, more = form.lanes, more or {}
    carried = list(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.chunks(batch.column(1), lower=True):
                f, has = fingerprints(data, offs, len(lanes))
                own = [batch.column(k).slice(lo, hi - lo) for k in (0, *range(2, 2 + len(carried)))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(f[:, k].view(np.int64), mask=~has) for k in range(len(lanes)))], names=["id", *carried, *lanes])
        tk.release()

    rows = tk.small_batches(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), *[c.cast("long").alias(x) for x, c in more.items()])
    return rows.mapInArrow(run, ", ".join(f"{x} long" for x in ("id", *more, *lanes)))


def _keys(form: Shape):
    """(k, id): the ball of radius 1 around each segment, with the segment's number."""
    ball = np.array([0] + [1 << i for i in range(form.width)], dtype=np.uint64)
    mask, number = np.uint64((1 << form.width) - 1), np.arange(form.segments, dtype=np.uint64) << np.uint64(form.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                lanes = [part.column(1 + k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(len(form.lanes))]
                segments = []
                for k in range(form.segments):
                    lane, bit = divmod(k * form.width, 64)
                    x = lanes[lane] >> np.uint64(bit)
                    if bit + form.width > 64:
                        x = x | lanes[lane + 1] << np.uint64(64 - bit)
                    segments.append(x & mask)
                key = (np.stack(segments, axis=1)[:, :, None] ^ ball[None, None, :]) | number[None, :, None]
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, form.segments * len(ball)))], names=["k", "id"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key in; out: (null, a, b) for each pair of a small bucket, (key, a, null) for each member of a large one."""

    def large(k: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(v), pa.nulls(len(k), pa.int64())], names=["k", "a", "b"])

    def made(k: np.ndarray, v: np.ndarray, known: int | None) -> Iterator[pa.RecordBatch]:
        if known is not None and (more := int(np.searchsorted(k, known, side="right"))):
            yield large(k[:more], v[:more])
            k, v = k[more:], v[more:]
        if not len(k):
            return
        cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[cut, len(k)])
        pairs = []
        for s in np.unique(size[(size > 1) & (size <= PAIRS_UP_TO)]):
            at = cut[size == s]
            member = v[at[:, None] + np.arange(s)[None, :]]
            i, j = np.triu_indices(s, 1)
            pairs.append(np.stack([member[:, i].reshape(-1), member[:, j].reshape(-1)], axis=1))
        if pairs:
            p = np.concatenate(pairs)
            p = np.stack([p.min(axis=1), p.max(axis=1)], axis=1)
            p = np.unique(p[p[:, 0] != p[:, 1]], axis=0) if len(p) < 1 << 16 else p[np.unique(np.ascontiguousarray(p).view("V16").reshape(-1), return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(p), pa.int64()), pa.array(p[:, 0]), pa.array(p[:, 1])], names=["k", "a", "b"])
        big = np.repeat(size > PAIRS_UP_TO, size)
        if big.any():
            yield large(k[big], v[big])

    known = None  # a key of so many rows that they didn't fit one pass
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        count += batch.num_rows
        if count < TOGETHER:
            continue
        k, v = (np.concatenate(x) for x in zip(*held, strict=True))
        if k[0] == k[-1]:
            known = int(k[0])
            yield large(k, v)
            held, count = [], 0
            continue
        at = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
        yield from made(k[:at], v[:at], known)
        held, count = [(k[at:], v[at:])], len(k) - at
    if held:
        yield from made(*(np.concatenate(x) for x in zip(*held, strict=True)), known)
    del held
    tk.release()


def spanning(ids: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Edges that span the components of the graph of pairs within ``radius``: a search that compares each
    reached member with all that are not reached yet, so what it connects is what all pairs would."""
    left, edges = np.arange(len(ids)), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(lanes[left] ^ lanes[x]).sum(axis=1, dtype=np.int64) <= radius
            got = left[near]
            edges += [(ids[x], ids[y]) for y in got]
            front += got.tolist()
            left = left[~near]
    return np.array(edges, dtype=np.int64).reshape(-1, 2)


def _large_buckets(radius: int, lanes: list[str]):
    """(a, b): edges that span each key's near pairs; rows come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        def flush(rows: pd.DataFrame) -> pa.RecordBatch:
            e = [spanning(g["id"].to_numpy(), g[lanes].to_numpy().view(np.uint64), radius) for _, g in rows.groupby("k")]
            e = np.unique(np.concatenate(e), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

        held = None
        for batch in batches:
            rows = batch.to_pandas()
            held = rows if held is None else pd.concat([held, rows], ignore_index=True)
            whole = held["k"].ne(held["k"].iloc[-1]) if len(held) else held["k"].isna()
            if whole.any():
                yield flush(held[whole])
                held = held[~whole].reset_index(drop=True)
        if held is not None and len(held):
            yield flush(held)

    return run


def _distance(lanes: list[str], a: str, b: str):
    return sum((F.bit_count(F.col(a + f).bitwiseXOR(F.col(b + f))) for f in lanes), F.lit(0))


def _in_buckets(members: DataFrame, radius: int, lanes: list[str], hot: int) -> DataFrame:
    """(a, b): edges that connect what all near pairs of each bucket would; ``members`` has (k, id, lanes).

    A bucket of up to ``hot`` members is one task's. Of a larger one, the least member is the hub, to which the members near
    it are joined; those that aren't are a query set against all members, in blocks: members and queries are cut in
    parts by their ids, and each pair of parts is a bucket of its own.
    """
    size = members.groupBy("k").agg(F.count("*").alias("m"))
    if not size.where(F.col("m") > hot).limit(1).count():
        return members.repartition("k").sortWithinPartitions("k").mapInArrow(_large_buckets(radius, lanes), "a long, b long")
    size = tk.cut(size.where(F.col("m") > hot).withColumn("parts", F.ceil(F.col("m") / (hot // 2)).cast("int")))
    small = members.join(size, "k", "left_anti").repartition("k").sortWithinPartitions("k").mapInArrow(_large_buckets(radius, lanes), "a long, b long")
    big = members.join(size, "k")
    hub = big.groupBy("k").agg(F.min(F.struct("id", *lanes)).alias("h")).select("k", F.col("h.id").alias("hub"), *[F.col(f"h.{f}").alias("h" + f) for f in lanes])
    # hubs are few, a row for each hot bucket; they are spread like the members, so that no task has all of one
    salt = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    hub = hub.join(size, "k").select("k", "hub", *["h" + f for f in lanes], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    seen = tk.cut(big.withColumn("part", salt).join(hub, ["k", "part"]).withColumn("near", _distance(lanes, "", "h") <= radius))
    spokes = seen.where("near and id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    queries = seen.where("not near").select("k", "id", *lanes, F.col("part").alias("q"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = queries.select("k", "q", "part").distinct()
    blocks = queries.unionByName(seen.select("k", "id", *lanes, "part").join(asked, ["k", "part"])).distinct()
    block = F.xxhash64("k", "q", "part")
    own = blocks.select(block.alias("k"), "id", *lanes).repartition("k").sortWithinPartitions("k").mapInArrow(_large_buckets(radius, lanes), "a long, b long")
    return small.union(spokes).union(own)


def _segment(lanes: np.ndarray, bit: int, width: int) -> np.ndarray:
    """``width`` bits (32 at most) of each fingerprint, from ``bit`` on; a row of ``lanes`` for each lane."""
    lane, at = divmod(bit, 64)
    x = lanes[lane] >> np.uint64(at)
    if at + width > 64:
        x = x | lanes[lane + 1] << np.uint64(64 - at)
    return (x & np.uint64((1 << width) - 1)).astype(np.int64)


def _joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``root`` (of each place its component's least place) with the components of ``u`` and ``v`` joined, pair by pair."""
    root = root.copy()
    while True:
        x, y = root[u], root[v]
        other = x != y
        if not other.any():
            return root
        u, v, x, y = u[other], v[other], x[other], y[other]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def links(lanes: np.ndarray, roots: np.ndarray, other: np.ndarray, other_roots: np.ndarray, radius: int) -> np.ndarray:
    """(n, 2) pairs of roots that connect what all pairs within ``radius`` of one fingerprint and one of the others would.

    ``lanes`` and ``other`` have a row for each lane. Segments are so many that a pair within ``radius`` differs in at most two
    bits of one of them, since three bits in each would be more; so every such pair whose roots differ is compared.
    """
    known = np.unique(np.concatenate([roots, other_roots]))
    mine, theirs = np.searchsorted(known, roots), np.searchsorted(known, other_roots)
    root = np.arange(len(known))
    bits, half = 64 * len(lanes), max(len(lanes) // 2, 1)
    edges = np.linspace(0, bits, min(bits, radius // 3 + 1) + 1).astype(int).tolist()
    for bit, end in zip(edges[:-1], edges[1:], strict=True):
        width = min(end - bit, 20)  # of wider segments a part
        start = sorted_at = None
        for flip in [0, *(1 << i for i in range(width)), *(1 << i | 1 << j for i in range(width) for j in range(i))]:
            if start is None or np.count_nonzero(root != sorted_at) > len(known) // 16:
                # both sides by key, and those of a key by root
                sides = []
                for x, r in ((lanes, root[mine]), (other, root[theirs])):
                    k = _segment(x, bit, width) << 32 | r
                    order = np.argsort(k)
                    sides.append((order, k[order], np.ascontiguousarray(x[:, order])))
                (order_a, key, a), (order_b, there, b) = sides
                key, start = (key >> 32).astype(np.int32), np.searchsorted(there >> 32, np.arange((1 << width) + 1)).astype(np.int32)
                size, there_root = np.diff(start), there & 0xFFFFFFFF
                sorted_at = root
                root_a, root_b = root[mine[order_a]], root[theirs[order_b]]
            k = key ^ flip
            q = np.flatnonzero(size[k])
            k, own = k[q], root_a[q]
            lo, hi = start[k], start[k + 1]
            # nothing is asked of buckets of the own root, and of large ones only what is of others
            some = np.flatnonzero((there_root[lo] != own) | (there_root[hi - 1] != own))
            q, k, own, lo, hi = q[some], k[some], own[some], lo[some], hi[some]
            large = np.flatnonzero(hi - lo > PAIRS_UP_TO)
            if len(large):
                own = k[large].astype(np.int64) << 32 | own[large]
                left, right = np.searchsorted(there, own), np.searchsorted(there, own, side="right")
                q, lo, hi = np.r_[q, q[large]], np.r_[lo, right], np.r_[hi, hi[large]]
                hi[large] = left
            ends = np.r_[0, np.cumsum(hi - lo, dtype=np.int64)]
            # runs of pairs; a bucket that is larger than one run goes on in the next
            for at in range(0, int(ends[-1]), COMPARED):
                upto = min(at + COMPARED, int(ends[-1]))
                first, last = int(np.searchsorted(ends, at, side="right")) - 1, int(np.searchsorted(ends, upto))
                count = np.minimum(ends[first + 1 : last + 1], upto) - np.maximum(ends[first:last], at)
                i = np.repeat(q[first:last], count)
                j = np.arange(at, upto) + np.repeat(lo[first:last] - ends[first:last], count)
                d = np.bitwise_count(a[0][i] ^ b[0][j]).astype(np.int16)
                for lane in range(1, len(lanes)):
                    if lane == half:
                        some = np.flatnonzero(d <= radius)
                        i, j, d = i[some], j[some], d[some]
                    d += np.bitwise_count(a[lane][i] ^ b[lane][j])
                some = np.flatnonzero(d <= radius)
                u, v = root_a[i[some]], root_b[j[some]]
                if (u != v).any():
                    root = _joined(root, u, v)
                    root_a, root_b = root[mine[order_a]], root[theirs[order_b]]
    moved = np.flatnonzero(root != np.arange(len(known)))
    return np.stack([known[moved], known[root[moved]]], axis=1)


def _all_links(radius: int, n_lanes: int):
    """(a, b): links of the two parts of each pair; rows come sorted by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def searched(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            columns = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in rows]) for k in range(1, 3 + n_lanes)]
            side, root, lanes = columns[0], columns[1], np.stack(columns[2:]).view(np.uint64)
            one, two = side != 1, side != 0  # a part with itself is on both
            found = links(lanes[:, one], root[one], lanes[:, two], root[two], radius)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            pair = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(pair)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and hi > lo and held[0].column(0)[0].as_py() != int(pair[lo]):
                    yield searched(held)
                    held = []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield searched(held)
        del held
        tk.release()

    return run


def _exact(named: DataFrame, radius: int, lanes: list[str], parts: int) -> DataFrame:
    """(a, b): pairs of roots that connect what all near pairs would; ``named`` has (root, lanes), a row for each node."""
    pairs = parts * (parts + 1) // 2
    tasks = min(pairs, SEARCH_TASKS)
    other = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    least, most = F.least("p", "o"), F.greatest("p", "o")
    rows = named.select(F.pmod(F.xxhash64(*lanes), F.lit(parts)).cast("int").alias("p"), "root", *lanes).select("p", other.alias("o"), "root", *lanes)
    # side 0 or 1 of a pair of parts; 2 of a part with itself
    side = F.when(F.col("p") == F.col("o"), 2).when(F.col("p") < F.col("o"), 0).otherwise(1)
    rows = rows.select((most.cast("long") * (most + 1) / 2 + least).cast("long").alias("pair"), side.cast("int").alias("side"), "root", *lanes)
    return rows.repartitionById(tasks, (F.col("pair") % tasks).cast("int")).sortWithinPartitions("pair").mapInArrow(_all_links(radius, len(lanes)), "a long, b long")


def _near(df: DataFrame, id_col: str, text_col: str, radius: int, more: dict | None = None) -> DataFrame:
    """(id, ``more``, root, group_id) for each row; a null root where the text has no word."""
    form = shape(df.count())
    lanes, most = form.lanes, form.radius(radius)
    fp = tk.cut(with_fingerprints(df, id_col, text_col, form, more))
    # a node for each fingerprint, numbered as it lies in the checkpoint
    node = tk.cut(fp.where("f0 is not null").groupBy(*lanes).agg(F.min("id").alias("least"))).select(F.monotonically_increasing_id().alias("id"), "least", *lanes)
    node = tk.cut(node)
    met = tk.cut(node.select("id", *lanes).mapInArrow(_keys(form), "k long, id long").repartition("k").sortWithinPartitions("k").mapInArrow(_buckets, "k long, a long, b long"))
    at = [node.select(F.col("id").alias(x), *[F.col(f).alias(x + f) for f in lanes]) for x in ("a", "b")]
    pairs = met.where("k is null").select("a", "b").distinct().join(at[0], "a").join(at[1], "b").where(_distance(lanes, "a", "b") <= most).select("a", "b")
    members = met.where("k is not null").select("k", F.col("a").alias("id")).join(node.drop("least"), "id").select("k", "id", *lanes)
    root = components(pairs.union(_in_buckets(members, most, lanes, HOT_BUCKET)))
    named = tk.cut(node.join(root, node["id"] == root["node"], "left").select(*lanes, "least", F.coalesce("root", node["id"]).alias("root")))
    n = named.count()
    more_links = tk.cut(_exact(named, most, lanes, max(min(PARTS, n // LEAST_PART), -(-n // PART), 1)))
    if more_links.limit(1).count():
        joined = components(more_links).withColumnRenamed("root", "least_root")
        named = named.join(joined, named["root"] == joined["node"], "left").select(*lanes, "least", F.coalesce("least_root", "root").alias("root"))
    name = named.groupBy("root").agg(F.min("least").alias("group_id"))
    named = named.drop("least").join(name, "root")
    return fp.join(named, lanes, "left").select("id", *(more or {}), "root", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("group_id")).alias("group_id"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, group_id, kept) for each row: the near-duplicate group it belongs to, named by its least id.

    Words are compared without case or punctuation, as a set. Rows with the same fingerprint are one node; nodes
    whose complete distance is at most ``radius`` (of 256 bits) are joined, and groups are the connected components. Every row is
    a query. A null, empty or wordless text is a group of its own (two such texts are not copies). Repeated rows
    appear as often as they occur, with the same answer. An id that repeats with other texts is answered row by row, and
    a null id is an id like any other, but names a group only if it has no other. ``kept``: is this the id that names the
    group? Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    found = _near(df, id_col, text_col, radius)
    return found.select(F.col("id").alias("doc_id"), "group_id", F.col("id").eqNullSafe(F.col("group_id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``df`` with one row of each near-duplicate group; columns as they were.

    It is the row with the least id, of those the one with the least hashes of the whole row, and of rows that repeat
    as a whole one. Null, empty and wordless texts all stay. Only ids and hashes are grouped; the rows themselves are
    taken out by their hashes.
    """
    names = tk.fresh(df, "near_row_hash", "near_row_other_hash")
    whole = [F.col(f"`{c}`") for c in df.columns]
    hashes = [F.xxhash64(*whole), F.xxhash64(F.lit("near"), *whole)]
    found = tk.cut(_near(df, id_col, text_col, radius, dict(zip(("h", "g"), hashes, strict=True))).where("root is not null"))
    row = F.struct(F.col("id").isNull().alias("x"), "id", "h", "g")
    first = found.groupBy("root").agg(F.min(row).alias("first"))
    judged = found.groupBy("root", "id", "h", "g").agg(F.count("*").alias("n")).join(first, "root").select("h", "g", "n", (row == F.col("first")).alias("stays"))
    lost = judged.where("not stays").select(F.col("h").alias(names[0]), F.col("g").alias(names[1]))
    key = (hashes[0] == F.col(names[0])) & (hashes[1] == F.col(names[1]))
    left = df.join(lost, key, "left_anti")
    again = tk.cut(judged.where("stays and n > 1").select(F.col("h").alias(names[0]), F.col("g").alias(names[1])))
    if not again.limit(1).count():
        return left
    # of rows that repeat as a whole: first one of each partition, then one of those
    n, part = tk.fresh(df, "near_row_number", "near_part")
    some = left.join(again, key, "left_semi").withColumns({names[0]: hashes[0], names[1]: hashes[1]}).withColumn(part, F.spark_partition_id())
    for by in ([*names, part], names):
        some = some.withColumn(n, F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))).where(F.col(n) == 1).drop(n)
    return left.join(again, key, "left_anti").unionByName(some.drop(*names, part))
