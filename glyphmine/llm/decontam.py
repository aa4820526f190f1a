"""Benchmark decontamination by the q-gram lemma.

Texts are compared lower-cased, with every run of characters other than letters and digits as one space. Every piece of
``WINDOW`` bytes of a benchmark item is a window of it. A window of n bytes that occurs with at most e edits shares at least
``n + 1 - q * (e + 1)`` q-grams with the place, on diagonals (place in the text less place in the item) no
more than e apart. So shared q-grams are gathered in diagonal bands of width 2e that overlap by e, which no
such place can miss; windows that hold as many places of a band's q-grams as the bound are verified by a banded alignment.

Repetition is bounded on both sides: of windows of an item with equal contents one is kept, of equal pieces of a text that
shares many q-grams one is looked at, and shared q-grams are taken in overlapping slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmine.llm import textkit as tk

Q = 12
#: Bytes of a window; one begins at every byte of an item.
WINDOW = 72
#: Edits a window may have, as a share of its bytes.
EDIT_RATE = 0.06
#: Benchmark text of one pass; a larger benchmark is taken in several, one after the other. Its index has some 20 bytes a byte.
PASS_BYTES = 8 << 20
#: Shared q-grams (text and item places) that are gathered at once.
SLICE = 1 << 18

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_KEEP = np.zeros(256, dtype=bool)
_KEEP[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_KEEP[128:] = True


@dataclass
class Index:
    """The items of a benchmark, one after another, and where their q-grams are. A window is known by its first byte's place."""

    ids: list[int | None]
    data: np.ndarray
    owner: np.ndarray  # of each item with windows: its place in ``ids``
    begin: np.ndarray
    end: np.ndarray
    size: np.ndarray  # bytes of its windows
    most: np.ndarray  # edits that they may have
    bound: np.ndarray
    grams: np.ndarray  # distinct, sorted
    first: np.ndarray  # of each gram's postings, one more at the end
    place: np.ndarray  # of each posting
    bits: int
    seen: np.ndarray
    fresh: np.ndarray  # of each place: does a window begin there that no earlier place of its item has?
    short: list[tuple[int, bytes]]  # items shorter than a q-gram

    def _windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(item with windows, place) of every window; one of each content that repeats within an item."""
        at = np.flatnonzero(self.fresh)
        return np.searchsorted(self.begin, at, side="right") - 1, at

    @property
    def item(self) -> np.ndarray:
        """Of each window: the item's place in ``ids``."""
        return self.owner[self._windows()[0]]

    @property
    def text(self) -> list[bytes]:
        """Of each window."""
        of, at = self._windows()
        return [self.data[a : a + n].tobytes() for a, n in zip(at.tolist(), self.size[of].tolist(), strict=True)]

    @property
    def edits(self) -> np.ndarray:
        """Of each window."""
        return self.most[self._windows()[0]]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``n`` integers from each of ``first`` on."""
    return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def normal(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the compared form of texts; a null has none."""
    return tk.squeeze(*tk.buffers(pc.utf8_lower(column)), _KEEP)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``Q`` bytes from each place on."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    eight = np.ndarray((n,), "<u8", data, 0, (1,))
    four = np.ndarray((n,), "<u4", data, 8, (1,))
    return eight * _K1 ^ (four.astype(np.uint64) + np.uint64(1)) * _K2


def allowed(n: int, rate: float = EDIT_RATE) -> int:
    """Edits that a window of ``n`` bytes may have: by the rate, and such that the bound is 1 or more."""
    e = int(n * rate)
    while e and n + 1 - Q * (e + 1) < 1:
        e -= 1
    return e


def index(items: list[tuple[int | None, str | None]], rate: float = EDIT_RATE) -> Index:
    """The index of (id, text) pairs; null texts and texts without letters or digits have no windows."""
    data, offs = normal(pa.array([t for _, t in items], pa.large_string()))
    owner, text, short = [], [], []
    for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        raw = data[a:b].tobytes().strip()
        if len(raw) >= Q:
            owner.append(i)
            text.append(raw)
        elif raw:
            short.append((i, raw))
    end = np.cumsum([len(t) for t in text], dtype=np.int64)
    begin = np.r_[0, end[:-1]].astype(np.int64)[: len(text)]
    size = np.minimum(end - begin, WINDOW)
    most = np.array([allowed(n, rate) for n in size.tolist()], dtype=np.int64)
    joint = np.frombuffer(b"".join(text), np.uint8)
    n = end - size - begin + 1
    start, of = _ranges(begin, n), np.repeat(np.arange(len(n)), n)
    fresh = np.zeros(len(joint), dtype=bool)
    fresh[start] = True
    whole = size[of] == WINDOW
    fresh[start[whole]] = _first_of_kind(joint, start[whole], of[whole], WINDOW)
    place = np.flatnonzero(_covered(len(joint), np.flatnonzero(fresh), (size - Q + 1)[of][fresh[start]]))
    all_grams = gram_hashes(joint)[place]
    order = np.argsort(all_grams, kind="stable")
    grams, first = np.unique(all_grams[order], return_index=True)
    bits = max(16, min(24, int(np.ceil(np.log2(max(1, len(grams)) * 64)))))
    seen = np.zeros(1 << bits, dtype=bool)
    seen[grams >> np.uint64(64 - bits)] = True
    return Index([i for i, _ in items], joint, np.array(owner, dtype=np.int64), begin, end, size, most, size + 1 - Q * (most + 1), grams, np.r_[first, len(order)].astype(np.int32), place[order].astype(np.int32), bits, seen, fresh, short)


def _covered(n: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Which of ``n`` places are within ``length`` of one of ``start``?"""
    return np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1))[:n] > 0


def _first_of_kind(data: np.ndarray, start: np.ndarray, of: np.ndarray, length: int) -> np.ndarray:
    """Of the pieces of ``length`` bytes from each of ``start`` on: has no earlier piece of the same text (``of``) its content?"""
    if not len(start):
        return np.zeros(0, dtype=bool)
    lo = int(start.min())
    part = data[lo : int(start.max()) + length]
    power, inverse = tk._pow(len(part) + 1)
    sums = np.zeros(len(part) + 1, dtype=np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
    h = tk.mix64((sums[start - lo + length] - sums[start - lo]) * inverse[start - lo])
    order = np.lexsort((h, of))
    new = np.r_[True, (h[order[1:]] != h[order[:-1]]) | (of[order[1:]] != of[order[:-1]])]
    first = start[order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]]
    later = np.flatnonzero(~new)
    for at in range(0, len(later), 4096):  # not only the hash
        k = later[at : at + 4096]
        new[k] = (data[first[k][:, None] + np.arange(length)] != data[start[order[k]][:, None] + np.arange(length)]).any(axis=1)
    out = np.empty(len(start), dtype=bool)
    out[order] = new
    return out


def align(text: np.ndarray, lo: np.ndarray, doc_lo: np.ndarray, doc_hi: np.ndarray, pattern: np.ndarray, band: int) -> np.ndarray:
    """Least edits of each pattern row against the text from ``lo`` on, over ``band`` start diagonals; bytes outside a document match nothing."""
    n, size = pattern.shape
    if not n:
        return np.zeros(0, np.int16)
    at = lo + np.arange(size + band - 1)[:, None]
    around = np.where((at >= doc_lo) & (at < doc_hi), text[np.clip(at, 0, len(text) - 1)], np.uint8(0))  # no compared text has a byte 0
    own = np.ascontiguousarray(pattern.T)
    cost = np.zeros((band, n), dtype=np.int16)
    for i in range(size):
        best = cost + (around[i : i + band] != own[i])
        np.minimum(best[:-1], cost[1:] + np.int16(1), out=best[:-1])
        for k in range(1, band):
            np.minimum(best[k], best[k - 1] + np.int16(1), out=best[k])
        cost = best
    return cost.min(axis=0)


def _touched(ix: Index, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the texts, number of the q-gram) of each place whose q-gram an item has; equal pieces of one text count once where they are many."""
    none = np.zeros(0, np.int64)
    h = gram_hashes(data)
    at = np.flatnonzero(ix.seen[h >> np.uint64(64 - ix.bits)]) if len(ix.grams) else none
    if not len(at):
        return none, none, none
    g = np.searchsorted(ix.grams, h[at])
    ok = np.flatnonzero(ix.grams[np.minimum(g, len(ix.grams) - 1)] == h[at])
    at, g = at[ok], g[ok]
    row = np.searchsorted(offs, at, side="right") - 1
    inside = at + Q <= offs[row + 1]
    at, g, row = at[inside], g[inside], row[inside]
    n = ix.first[g + 1] - ix.first[g]
    if n.sum() > SLICE:
        # a window found at a place is also found at the first place of the text around which it reads the same
        length = WINDOW + 2 * int(ix.most.max()) + Q
        size = np.diff(offs)
        heavy = np.flatnonzero((np.bincount(row, weights=n, minlength=len(size)) > size) & (size > length))
        start, of = _ranges(offs[heavy], size[heavy] - length + 1), np.repeat(heavy, size[heavy] - length + 1)
        keep = _covered(len(data), start[_first_of_kind(data, start, of, length)], length)
        keep = keep[at] | ~np.isin(row, heavy)
        at, g, row = at[keep], g[keep], row[keep]
    return row, at, g


def _shared(ix: Index, data: np.ndarray, row: np.ndarray, at: np.ndarray, g: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place in the texts, place in the items) of the q-grams that texts and items share, in slices.

    Slices overlap by more than a window can span, and one of too many postings is taken by ranges of items, so every window
    has all its shared q-grams in one of them.
    """
    reach = WINDOW + 2 * int(ix.most.max(initial=0)) + Q
    upto = np.cumsum(ix.first[g + 1] - ix.first[g], dtype=np.int64)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE, side="right")))
        here = slice(int(np.searchsorted(at, at[lo] - reach)), hi)
        r, a, k = row[here], at[here], g[here]
        parts = min(len(ix.owner), -(-int((ix.first[k + 1] - ix.first[k]).sum()) // (2 * SLICE)))
        first, end = ix.first[k].astype(np.int64), ix.first[k + 1].astype(np.int64)
        for part in range(parts):
            if parts > 1:  # postings of a q-gram are by place: those of a range of items are a range of them
                a_, b_ = (ix.begin[len(ix.owner) * x // parts] if x < parts else len(ix.data) for x in (part, part + 1))
                low, high = _bounds(ix, first, end, a_), _bounds(ix, first, end, b_)
            else:
                low, high = first, end
            n = high - low
            p, at_, row_ = ix.place[_ranges(low, n)].astype(np.int64), np.repeat(a, n), np.repeat(r, n)
            same = np.ones(len(p), dtype=bool)
            for x in range(Q):  # not only the hash
                same &= data[at_ + x] == ix.data[p + x]
            if same.any():
                yield row_[same], at_[same], p[same]
        lo = hi


def _bounds(ix: Index, first: np.ndarray, end: np.ndarray, place: int) -> np.ndarray:
    """In each range of postings, where places of ``place`` or more begin."""
    lo, hi = first.copy(), end.copy()
    while (open_ := lo < hi).any():
        middle = (lo + hi) >> 1
        less = open_ & (ix.place[np.minimum(middle, len(ix.place) - 1)] < place)
        lo = np.where(less, middle + 1, lo)
        hi = np.where(open_ & ~less, middle, hi)
    return lo


def _verbatim(ix: Index, row: np.ndarray, at: np.ndarray, p: np.ndarray, item: np.ndarray, span: int) -> np.ndarray:
    """Sorted keys (row and place) of the windows that occur without an edit: all their q-grams are on one diagonal."""
    order = np.argsort((at - p + len(ix.data)) * (span + 1) + at)
    row, at, p, item = row[order], at[order], p[order], item[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(p) != 1)])  # a text's and an item's last q-grams aren't followed by the next one's
    n = np.diff(np.r_[cut, len(at)]) - (ix.size[item[cut]] - Q)
    cut, n = cut[n > 0], n[n > 0]
    row, w = np.repeat(row[cut], n), _ranges(p[cut], n)
    return np.unique(row[ix.fresh[w]] * len(ix.data) + w[ix.fresh[w]])


def _candidates(ix: Index, row: np.ndarray, at: np.ndarray, p: np.ndarray, item: np.ndarray, shift: int) -> tuple[np.ndarray, ...]:
    """(row, item, band, window's place) of the windows with as many q-grams of a band as the bound."""
    by = np.maximum(ix.most[item], 1)
    band = (at - p + shift) // by
    row, item, p, band = np.tile(row, 2), np.tile(item, 2), np.tile(p, 2), np.r_[band, band - 1]
    pair = row * len(ix.owner) + item
    order = np.lexsort((p, band, pair))
    pair, band, p = pair[order], band[order], p[order]
    new = np.r_[True, (np.diff(pair) != 0) | (np.diff(band) != 0)]
    once = new | np.r_[True, np.diff(p) != 0]
    group = np.cumsum(new)[once]
    pair, band, p = pair[once], band[once], p[once]
    item = pair % len(ix.owner)
    # a window holds the q-grams ``k`` to ``k + bound - 1`` of a band if it begins between these places
    ahead = np.arange(len(p)) + ix.bound[item] - 1
    last = np.minimum(ahead, len(p) - 1)
    reach = ix.size[item] - Q
    ok = np.flatnonzero((ahead < len(p)) & (group[last] == group) & (p[last] - p <= reach))
    lo = np.maximum(p[last[ok]] - reach[ok], ix.begin[item[ok]])
    hi = np.minimum(p[ok], (ix.end - ix.size)[item[ok]])
    if len(ok):
        again = group[ok][1:] == group[ok][:-1]
        lo[1:] = np.where(again, np.maximum(lo[1:], hi[:-1] + 1), lo[1:])
    n = np.maximum(hi - lo + 1, 0)
    w = _ranges(lo, n)
    fresh = ix.fresh[w]
    return np.repeat(pair[ok] // len(ix.owner), n)[fresh], np.repeat(item[ok], n)[fresh], np.repeat(band[ok], n)[fresh], w[fresh]


def find(ix: Index, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, window's place, edits) of the windows found in normalised texts; a window may come more than once for a row."""
    for row, at, p in _shared(ix, data, *_touched(ix, data, offs)):
        item = np.searchsorted(ix.begin, p, side="right") - 1
        exact = _verbatim(ix, row, at, p, item, len(data))
        yield exact // len(ix.data), exact % len(ix.data), np.zeros(len(exact), np.int16)
        shift = len(data) + len(ix.data)  # diagonals may begin before the data
        row, item, band, w = _candidates(ix, row, at, p, item, shift)
        rest = ~np.isin(row * len(ix.data) + w, exact)
        row, item, band, w = row[rest], item[rest], band[rest], w[rest]
        for size, e in np.unique(np.stack([ix.size[item], ix.most[item]], axis=1), axis=0).tolist():
            mine = np.flatnonzero((ix.size[item] == size) & (ix.most[item] == e))
            step = max(e, 1)
            for part in np.array_split(mine, max(1, len(mine) // 2048)):
                lo = band[part] * step - shift + w[part] - e
                cost = align(data, lo, offs[row[part]], offs[row[part] + 1], ix.data[w[part][:, None] + np.arange(size)], 2 * step + 2 * e)
                good = cost <= e
                yield row[part][good], w[part][good], cost[good]


def hits(ix: Index, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """(row, item's place, distinct windows found, least edits of one) for each text and item found in it."""
    for first, _, part, own in tk.chunks(column, lower=True):
        data, offs = tk.squeeze(part, own, _KEEP)
        key, least = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for row, w, cost in find(ix, data, offs):
            every, back = np.unique(np.r_[key, row * len(ix.data) + w], return_inverse=True)
            best = np.full(len(every), 1 << 30)
            np.minimum.at(best, back, np.r_[least, cost])
            key, least = every, best
        if len(key):
            pair = key // len(ix.data) * len(ix.owner) + np.searchsorted(ix.begin, key % len(ix.data), side="right") - 1
            both, at, n = np.unique(pair, return_index=True, return_counts=True)
            least = np.minimum.reduceat(least, at) if len(at) else least
            for x, k, e in zip(both.tolist(), n.tolist(), least.tolist(), strict=True):
                yield first + x // len(ix.owner), int(ix.owner[x % len(ix.owner)]), k, e
        if ix.short:
            raw = data.tobytes()
            for r, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                text = b" " + raw[a:b].strip() + b" "
                for item, words in ix.short:
                    if b" " + words + b" " in text:
                        yield first + r, item, 1, 0


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, rate: float) -> tuple[int, Iterator[Index]]:
    """The passes over the texts, and an index for each: the benchmark's size is summed, and parted by a hash, before any of it is fetched."""
    b = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    passes = max(1, -(-(b.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // PASS_BYTES))

    def each() -> Iterator[Index]:
        for k in range(passes):
            rows = b.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).collect()
            yield index(sorted({(r.i, r.t) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), rate)

    return passes, each()


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """(doc_id, item_id, windows, edits): items of which at least one window (any 72 bytes of it, or a shorter one as a whole) occurs in a document, with the number of its different windows found and the least edits.

    Every row is searched whole. Null and empty texts, on either side, match nothing. An item shorter than a q-gram
    is searched for as whole words. Rows that repeat give their answers as often; items that repeat as a whole count
    once; null ids are carried along. Other columns are ignored; an empty table or benchmark gives no rows. Of a
    benchmark of several passes, each but the last is answered before the next one's index is made.
    """
    rows = tk.small_batches(df).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    kind = "doc_id long, item_id long, windows long, edits long"
    passes, indexes = _indexes(benchmark, item_col, item_text_col, rate)
    out = None
    for k, ix in enumerate(indexes):
        shared = df.sparkSession.sparkContext.broadcast(ix)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = list(hits(shared.value, batch.column(1)))
                row, item, n, e = zip(*got, strict=True) if got else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array([shared.value.ids[x] for x in item], pa.int64()), pa.array(n, pa.int64()), pa.array(e, pa.int64())], names=["doc_id", "item_id", "windows", "edits"])

        found = rows.mapInArrow(run, kind)
        if k + 1 < passes:
            found = tk.cut(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _is_clean(shared) -> Callable[[Column], Column]:
    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        out = np.ones(len(text), dtype=bool)
        out[[r for r, *_ in hits(shared.value, text)]] = False
        tk.release()
        return pa.array(out)

    return clean


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``df`` whose text has no window of a benchmark item; all columns as they were. Null and empty texts stay.

    A benchmark of one pass is a predicate. Of a larger one each pass gives the digests of the texts to drop, one pass after
    the other, and they are taken out together.
    """
    tk.small_batches(df)
    text, context = F.col(f"`{text_col}`").cast("string"), df.sparkSession.sparkContext
    passes, indexes = _indexes(benchmark, item_col, item_text_col, rate)
    if passes == 1:
        return df.where(_is_clean(context.broadcast(next(indexes)))(text))
    (name,) = tk.fresh(df, "leaked_digest")
    leaked = None
    for ix in indexes:
        shared = context.broadcast(ix)
        found = tk.cut(df.select(text.alias("t")).where(~_is_clean(shared)(F.col("t"))).select(F.sha2("t", 256).alias(name)).distinct())
        shared.destroy()
        leaked = found if leaked is None else leaked.union(found)
    return df.join(leaked.distinct(), F.sha2(text, 256) == F.col(name), "left_anti")
