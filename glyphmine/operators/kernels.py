"""Numpy kernels of the text index. Each works on many texts at once: symbols of all, one after the other, each with its end mark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one pass of a kernel handles; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 20
#: The same for sorting suffixes, whose many arrays then stay in a core's cache.
SORT_BYTES = 1 << 15


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary array; a null has no bytes."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = column.type in (pa.large_string(), pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offs[0] : offs[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def passes(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1))
        yield lo, hi
        lo = hi


def reverse_each(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Every text backwards."""
    size = np.diff(offs)
    at = np.arange(len(data))
    text = np.repeat(np.arange(len(size)), size)
    return data[offs[text] + offs[text + 1] - 1 - at] if len(data) else data


class Suffixes:
    """Sorted suffixes of texts, each with an end mark that is less than every symbol.

    ``first[k]`` is where text k begins among all symbols, ``order`` the symbols' places sorted by text and suffix,
    ``rank`` its inverse; both count over all texts.
    """

    def __init__(self, symbols: np.ndarray, offs: np.ndarray) -> None:
        n_texts = len(offs) - 1
        size = np.diff(offs) + 1
        self.first = np.r_[0, np.cumsum(size)]
        total = int(self.first[-1])
        self.text = np.repeat(np.arange(n_texts), size)
        self.symbol = np.zeros(total, dtype=np.int64)
        body = np.ones(total, dtype=bool)
        body[self.first[1:] - 1] = False
        self.symbol[body] = symbols.astype(np.int64) + 1  # 0 is the end mark
        self.levels: list[tuple[int, np.ndarray]] = []
        self._sort()

    def _sort(self) -> None:
        total = len(self.symbol)
        # symbols by their place among those that occur take fewer bits
        most = int(self.symbol.max(initial=0))
        if most < 1 << 16:
            used = np.bincount(self.symbol, minlength=1) > 0
            used[0] = True
            code = (np.cumsum(used) - 1)[self.symbol]
            most = int(used.sum()) - 1
        else:
            code = self.symbol
        self.bits, self.head = 0, None
        bits, wide, at_bits = max(1, most.bit_length()), len(self.first).bit_length(), total.bit_length()
        if bits + wide + at_bits <= 63:
            # the first key: the text's number, as many symbols as fit, and the place, so that the numbers themselves are sorted.
            # An end mark tells a text's suffixes apart, so what stands behind it doesn't matter
            self.bits, width = bits, (63 - wide - at_bits) // bits
            key, have = code, 1
            while have < width:
                more = min(have, width - have)
                key = key << bits * more
                key[: max(0, total - have)] |= key[have:] >> bits * have
                have += more
            self.head = key
            key = np.sort((self.text << bits * width | key) << at_bits | np.arange(total))
            order = key & ((1 << at_bits) - 1)
            key >>= at_bits
            new = np.r_[True, key[1:] != key[:-1]] if total else np.zeros(0, bool)
        else:
            width = 1
            order = np.lexsort((self.symbol, self.text))
            new = np.r_[True, (self.symbol[order[1:]] != self.symbol[order[:-1]]) | (self.text[order[1:]] != self.text[order[:-1]])] if total else np.zeros(0, bool)
        rank = np.empty(total, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(total), 0))
        here = np.flatnonzero(~(new & np.r_[new[1:], True])) if total else np.zeros(0, np.int64)
        while True:
            self.levels.append((width, rank.astype(np.int32)))
            if not len(here):
                break
            p = order[here]
            own, then = rank[p], rank[p + width]  # a tied suffix is longer than ``width``
            if 3 * at_bits <= 63:
                key = np.sort((own << at_bits | then) << at_bits | np.arange(len(here)))
                p, key = p[key & ((1 << at_bits) - 1)], key >> at_bits
            else:
                key = own * (total + 1) + then
                by = np.argsort(key)
                p, key = p[by], key[by]
            order[here] = p
            first = np.r_[True, key[1:] != key[:-1]]
            rank[p] = np.maximum.accumulate(np.where(first, here, 0))
            here = here[~(first & np.r_[first[1:], True])]
            width *= 2
        self.order, self.rank = order, rank

    def array(self) -> np.ndarray:
        """The suffix arrays: by text and rank, the place in the text."""
        return self.order - self.first[:-1][self.text]

    def ranks(self) -> np.ndarray:
        """By text and rank, the rank itself."""
        return np.arange(len(self.order)) - self.first[:-1][self.text]

    def whole(self) -> np.ndarray:
        """The rank of each whole text."""
        return self.rank[self.first[:-1]] - self.first[:-1]

    def occ(self) -> np.ndarray:
        """By text and rank, how many rows up to and including this one have the same symbol before their suffix."""
        # the rows that a symbol goes before are in the order of the rows that begin with it
        begin = self.symbol[self.order]
        new = np.r_[True, (begin[1:] != begin[:-1]) | (self.text[1:] != self.text[:-1])] if len(begin) else np.zeros(0, bool)
        block = np.maximum.accumulate(np.where(new, np.arange(len(begin)), 0))
        lf = self.rank[self._around(-1)]
        return lf - block[lf] + 1

    def inverse(self) -> np.ndarray:
        """By text and place, the rank."""
        return self.rank - self.first[:-1][self.text]

    def _around(self, step: int) -> np.ndarray:
        """The places ``step`` after those in ``order``, around the end of each text."""
        low = self.first[:-1][self.text]
        size = np.diff(self.first)[self.text]
        return low + (self.order - low + step) % size

    def psi(self) -> np.ndarray:
        """By text and rank, the rank of the next suffix; from the empty suffix to the whole text."""
        return self.rank[self._around(1)] - self.first[:-1][self.text]

    def lf(self) -> np.ndarray:
        """By text and rank, the rank of the suffix one symbol longer; from the whole text to the empty suffix."""
        return self.rank[self._around(-1)] - self.first[:-1][self.text]

    def bwt(self) -> np.ndarray:
        """By text and rank, the symbol before the suffix plus 1; 0 for the whole text."""
        return self.symbol[self._around(-1)]

    def lcp(self) -> np.ndarray:
        """By text and rank, the common prefix with the suffix of the next rank; 0 at a text's last."""
        total = len(self.symbol)
        out = np.zeros(total, dtype=np.int64)
        if total < 2:
            return out
        pair = np.flatnonzero(self.text[1:] == self.text[:-1])
        a, b = self.order[pair].copy(), self.order[pair + 1].copy()
        got = np.zeros(len(pair), dtype=np.int64)
        tied = np.flatnonzero(self.levels[0][1][a] == self.levels[0][1][b])
        x, y, more = a[tied], b[tied], got[tied]
        for width, rank in reversed(self.levels):
            step = width * (rank[x] == rank[y])
            more, x, y = more + step, x + step, y + step
        got[tied], a[tied], b[tied] = more, x, y
        # what is left is less than the first key's width
        if self.head is None:
            got += (self.symbol[a] == self.symbol[b]) & (self.symbol[a] > 0)
        else:
            differ = self.head[a] ^ self.head[b]
            top = np.frexp((differ & ~(differ >> 1)).astype(np.float64))[1] - 1  # the highest bit, whatever a float rounds
            got += self.levels[0][0] - 1 - top // self.bits
        out[pair] = got
        return out

    def parts(self) -> np.ndarray:
        """Offsets of each text's rows."""
        return self.first


def inverse_bwt(bwt: bytes, eof: int) -> bytes:
    """The text of a BWT whose end mark is at rank ``eof`` (what byte stands there doesn't matter)."""
    n = len(bwt)
    key = np.frombuffer(bwt, np.uint8).astype(np.int64) + 1
    key[eof] = 0
    psi = np.argsort(key, kind="stable")
    steps, at, out = psi.tolist(), eof, bytearray()
    # from the whole text on, psi walks to ever shorter suffixes, and the symbol before each is the text's next one
    for _ in range(n - 1):
        at = steps[at]
        out.append(bwt[at])
    return bytes(out)


def inverse_bwts(bwt: np.ndarray, first: np.ndarray, eof: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of many BWTs side by side; ``first``: where each begins, ``eof``: ranks of end marks.

    How far a suffix is from the empty one is found by pointer jumping along psi, in as many rounds as the longest text's length has bits.
    """
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    code = bwt.astype(np.int64) + 1
    code[first[:-1] + eof] = 0
    ahead = np.argsort(text << 9 | code, kind="stable")
    ahead[first[:-1]] = first[:-1]  # the empty suffix is the last one
    left = np.ones(len(bwt), dtype=np.int64)
    left[first[:-1]] = 0
    for _ in range(int(size.max(initial=1)).bit_length()):
        left += left[ahead]
        ahead = ahead[ahead]
    offs = np.r_[0, np.cumsum(size - 1)]
    out = np.empty(int(offs[-1]), dtype=np.uint8)
    inner = code > 0  # the byte before a suffix that is ``left`` bytes long
    out[(offs[1:][text] - left - 1)[inner]] = bwt[inner]
    return out, offs


def steps_by_counting(bwt: bytes, eof: int, pattern: bytes) -> Iterator[tuple[int, int, int]]:
    """(byte, sp, ep) of each step of backward search, the last one perhaps empty: bytes are counted where that is needed and nothing is sorted."""
    sp, ep = 0, len(bwt)
    below = np.cumsum(np.bincount(np.frombuffer(bwt, np.uint8), minlength=256)) if pattern else None
    for c in reversed(pattern):
        # the cell of the end mark holds a 0 that doesn't count as one
        less = int(below[c - 1]) if c else 1
        a, b = bwt.count(c, 0, sp), bwt.count(c, 0, ep)
        if not c:
            a, b = a - (eof < sp), b - (eof < ep)
        sp, ep = less + a, less + b
        yield c, sp, ep
        if sp >= ep:
            return


def search_by_counting(bwt: bytes, eof: int, pattern: bytes) -> tuple[int, int] | None:
    """``Ranks.search`` for one pattern."""
    sp, ep = 0, len(bwt)
    for _, sp, ep in steps_by_counting(bwt, eof, pattern):
        if sp >= ep:
            return None
    return sp, ep


def occ_by_counting(bwt: bytes, eof: int, c: int, rank: int) -> tuple[int, int]:
    """``Ranks.cf`` and ``Ranks.occ`` of one byte and rank."""
    # the end mark is less than every byte, and its cell is a 0
    less = int(np.count_nonzero(np.frombuffer(bwt, np.uint8) < c)) if c else 1
    return less, bwt.count(c, 0, rank + 1) - (c == 0 and eof <= rank)


class Ranks:
    """Rank queries on one text's BWT: ``occ`` counts a symbol up to and including a rank."""

    def __init__(self, bwt: np.ndarray, eof: int) -> None:
        code = bwt.astype(np.int64) + 1
        code[eof] = 0
        self.n = len(code)
        self.order = np.argsort(code, kind="stable")
        self.start = np.searchsorted(code[self.order], np.arange(258))
        self.code = code

    def cf(self, c: int) -> int:
        """Symbols less than byte ``c``, the end mark included."""
        return int(self.start[c + 1])

    def occ(self, c: int, i: int) -> int:
        """Rows up to and including rank i whose symbol is byte c; 0 for i = -1."""
        rows = self.order[self.start[c + 1] : self.start[c + 2]]
        return int(np.searchsorted(rows, i, side="right"))

    def before(self, sp: int, ep: int, c: int) -> tuple[int, int] | None:
        """The interval of c followed by what the interval [sp, ep) stands for; None if it is empty."""
        lo, hi = self.cf(c) + self.occ(c, sp - 1), self.cf(c) + self.occ(c, ep - 1)
        return (lo, hi) if lo < hi else None

    def before_range(self, sp: int, ep: int, c1: int, c2: int) -> list[tuple[int, int, int]]:
        """(c, sp, ep) of every byte c1..c2 with a non-empty interval, the last first."""
        return [(c, *got) for c in range(c2, c1 - 1, -1) if (got := self.before(sp, ep, c))]

    def search(self, pattern: bytes) -> tuple[int, int] | None:
        """The interval of the suffixes that begin with ``pattern``; all of them for an empty one."""
        at: tuple[int, int] | None = (0, self.n)
        for c in reversed(pattern):
            at = self.before(*at, c)
            if at is None:
                return None
        return at

    def distinct(self, sp: int, ep: int) -> list[int]:
        """The bytes in rows [sp, ep)."""
        return [int(c) - 1 for c in np.unique(self.code[sp:ep]) if c]
