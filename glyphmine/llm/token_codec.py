"""Token ids as compressed blocks: a range coder driven by mixed order-0, order-1 and order-2 predictions.

A document's ids are cut into blocks of up to ``BLOCK`` ids, each coded from a reset model and checksummed, so that any block
can be read by itself. For each id there are three distributions over the vocabulary, of all ids of the block before it:
  * order 0: how often each id occurred, over a fixed prior by the id's number (vocabularies are sorted by frequency);
  * order 1 and order 2: how often each id followed the one or two ids before this one.
They are mixed with weights, and the id is coded in one step by its share of the mixture. The weights of a state (how
often each of the two contexts was seen) move after every id of that state towards each order's part in what was
predicted, which is an online EM step on the code length. Counts and weights are brought up to date at every id.

An id's share of a distribution, and that of all lesser ids, are counts of earlier ids of its context that are equal or
less. The encoder gets those for all ids of many blocks at once, one block a column, by sorts and sums over pieces of
them; only the weights and the coder's range step along the ids, all blocks of a chunk side by side. The decoder counts
in sorted lists and finds an id by bisection. Both use the same sums, products and quotients of doubles in the same order,
which are exact alike everywhere.

Block: the ids' count (uint16), CRC-32 of the ids as little-endian uint16s (uint32), then the code bytes, trimmed of zeros.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmine.llm import textkit as tk

BLOCK = 1024
#: Ids are below this.
VOCABULARY = 1 << 16
#: What an occurrence adds to an id's prior at order 0.
ADD = 2000
#: A mixture is coded in shares of this.
SHARE_BITS = 32
#: How far the weights of a state move at an id, and what order 0 keeps at least.
MOVE, FLOOR = 5 / 64, 1 / 256
#: Text bytes coded side by side.
CHUNK = 2 << 20
#: Ids that are counted at once: their arrays stay in a core's cache.
TOGETHER = 1 << 16
#: Pieces of 2**PIECE_BITS ids are counted by comparing all pairs; 7 at most.
PIECE_BITS = 5
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_PRIOR = 1 + 20_000 // (10 + np.arange(VOCABULARY, dtype=np.int64))
_BELOW = np.r_[0, np.cumsum(_PRIOR)]
_PRIOR_TOTAL = int(_BELOW[-1])
#: A little less than all shares, so that rounding can't pass them.
_SHARES = float((1 << SHARE_BITS) - 64)
#: By state (4 times how often the last id was seen before, up to 3, and how often the last two were): first weights.
_START = np.array([[1 - b - a, a, b] for x in range(4) for y in range(4) for b in [(0, 0.4, 0.6, 0.75)[y]] for a in [(1 - b) * (0.1 + 0.1 * x) if x else 0.0]])
_BITS, _TOP = np.uint64(SHARE_BITS), np.uint64(1 << 40)


def _pairs(values: np.ndarray) -> np.ndarray:
    """Of pieces (first axis): how many of the rows above in the piece have a lesser value in the column; there are at most 255 rows above."""
    rows = np.ascontiguousarray(values.transpose(1, 0, 2))
    out, less = np.zeros(rows.shape, dtype=np.uint8), np.empty(rows.shape, dtype=bool)
    for d in range(1, len(rows)):
        np.less(rows[:-d], rows[d:], out=less[d:])
        np.add(out[d:], less[d:].view(np.uint8), out=out[d:])
    return np.ascontiguousarray(out.transpose(1, 0, 2))


def _lesser(order: np.ndarray) -> np.ndarray:
    """Of each number of columns that are permutations: how many of those above it are less.

    Rows and numbers are cut into pieces. Sums over the pieces count what is in an earlier one both by row and by number. What is in the
    same piece by row, and what is in the same one by number and in an earlier one by row, is counted by comparing all pairs.
    """
    n, width = order.shape
    piece = 1 << PIECE_BITS
    pieces = -(-n // piece)
    if pieces * piece > n:
        order = np.concatenate([order, np.broadcast_to(np.arange(n, pieces * piece)[:, None], (pieces * piece - n, width))])
    column, own = np.arange(width), np.arange(pieces).repeat(piece)[:, None]
    cell = ((order >> PIECE_BITS) + own * pieces) * width + column
    sums = np.bincount(cell.reshape(-1), minlength=pieces * pieces * width).astype(np.int16).reshape(pieces, pieces, width)
    early = np.zeros_like(sums)
    for k in range(1, pieces):
        np.add(early[k - 1], sums[k - 1], out=early[k])
    sums[:, 0] = 0
    for k in range(1, pieces):
        np.add(sums[:, k - 1], early[:, k - 1], out=sums[:, k])
    out = sums.reshape(-1)[cell]
    out += _pairs(order.astype(np.uint16).reshape(pieces, piece, width)).reshape(out.shape)
    at = order * width + column
    by_number = np.empty(order.size, dtype=np.uint16 if pieces > 256 else np.uint8)
    by_number[at] = own
    out += _pairs(by_number.reshape(pieces, piece, width)).reshape(-1)[at]
    return out[:n]


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of numbers in order, of equal ones the first first: the numbers, their rows, and where the run of equal ones begins."""
    n = len(keys)
    bits = (n - 1).bit_length()
    kind = np.uint32 if int(keys.max()) >> 32 - bits == 0 else np.uint64
    k = keys.astype(kind)
    k <<= kind(bits)
    k |= np.arange(n, dtype=kind)[:, None]
    k = np.sort(np.ascontiguousarray(k.T), axis=1)
    row = (k & kind((1 << bits) - 1)).astype(np.int64)
    k >>= kind(bits)
    start = np.zeros(k.shape, dtype=np.int16)
    np.multiply(k[:, 1:] != k[:, :-1], np.arange(1, n, dtype=np.int16), out=start[:, 1:])
    np.maximum.accumulate(start, axis=1, out=start)
    return np.ascontiguousarray(k.T), np.ascontiguousarray(row.T), np.ascontiguousarray(start.T)


def _counts(group: np.ndarray | None, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each id: how many ids of its group came before it in its column, how many of them are equal and how many are less; and a number of its group.

    One axis is one column. None: a column is a group. A column has at most 2**15 ids; groups and ids are not below 0.
    """
    shape = ids.shape
    ids = ids.reshape(len(ids), -1)
    n, width = ids.shape
    column = np.arange(width)
    if group is None:
        _, row, run = _sorted(ids)
        to, first, every = row * width + column, 0, row
    else:
        # groups together, then by value within them: a group has the same rows in both orders
        _, at, start = _sorted(group.reshape(n, width))
        at *= width
        at += column
        value, row, run = _sorted(start.astype(np.uint64) << np.uint64(16) | ids.reshape(-1)[at].astype(np.uint64))
        to, first = at.reshape(-1)[row * width + column], (value >> value.dtype.type(16)).astype(np.int64)
        every = row - first
    equal = np.arange(n, dtype=np.int16)[:, None] - run
    packed = np.empty((n, width, 4), dtype=np.int16)
    for k, part in enumerate((every, equal, _lesser(row) - equal - first, first)):
        packed[..., k] = part
    out = np.empty(n * width, dtype=np.int64)
    out[to] = packed.view(np.int64)[..., 0]
    return tuple(out.view(np.int16).reshape(*shape, 4)[..., k] for k in range(4))  # type: ignore[return-value]


def _contexts(ids: np.ndarray) -> np.ndarray:
    """Of blocks, one a column: of each id itself; how many came before it and after the last one, and after the last two; by order how many of those are less, and equal."""
    n = len(ids)
    out = np.empty((*ids.shape, 9), dtype=np.uint16)
    out[..., 0] = ids
    _, out[..., 4], out[..., 3], _ = _counts(None, ids)
    one = np.full(ids.shape, VOCABULARY, dtype=np.int32)  # nothing is before the first id
    one[1:] = ids[:-1]
    out[..., 1], out[..., 6], out[..., 5], number = _counts(one, ids)
    two = number.astype(np.int32) << (n - 1).bit_length()
    two[1:] |= number[:-1]
    out[..., 2], out[..., 8], out[..., 7], _ = _counts(two, ids)
    return out


def _shares(seen: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each id (``seen``: its ``_contexts``) its state, and by order (rows) the share of all lesser ids and that of the id and them."""
    below, upto = np.empty((3, len(seen))), np.empty((3, len(seen)))
    own, one, two, *rest = (seen[:, k].astype(np.int64) for k in range(9))
    total = (ADD * place + _PRIOR_TOTAL).astype(np.float64)
    np.divide(ADD * rest[0] + _BELOW[own], total, out=below[0])
    np.divide(ADD * (rest[0] + rest[1]) + _BELOW[own + 1], total, out=upto[0])
    for k, every in ((1, one), (2, two)):
        size = np.maximum(every, 1)
        np.divide(rest[2 * k], size, out=below[k])
        np.divide(rest[2 * k] + rest[2 * k + 1], size, out=upto[k])
    return 4 * np.minimum(one, 3) + np.minimum(two, 3), below, upto


def _code(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The code of each block, all blocks side by side."""
    n = len(sizes)
    rank_of = np.argsort(-sizes, kind="stable")  # the longest first
    size = sizes[rank_of]
    longest = int(size[0]) if n else 0
    live = np.searchsorted(-size, -np.arange(longest), side="left")  # blocks of more than s ids
    step = np.r_[0, np.cumsum(live)]
    # ids by place and then by block, as they are coded
    seen = np.empty(9 * len(ids), dtype=np.uint16)
    start = (np.cumsum(sizes) - sizes)[rank_of]
    lo, filled = 0, int(live[0]) if longest else 0
    while lo < filled:
        # blocks of about a length; what a shorter one is filled with comes after its ids and counts for none of them
        n_ids = int(size[lo])
        hi = min(filled, lo + max(1, TOGETHER // max(n_ids, 1 << PIECE_BITS)), int(np.searchsorted(-size, -(n_ids // 2 if n_ids >> PIECE_BITS else 0), side="left")))
        found = _contexts(ids.take(start[lo:hi] + np.arange(n_ids)[:, None], mode="clip")).reshape(n_ids, -1)
        begin, most = 9 * (step[:n_ids] + lo), 9 * (np.minimum(live[:n_ids], hi) - lo)
        for row, a, k in zip(found, begin.tolist(), most.tolist(), strict=True):
            seen[a : a + k] = row[:k]
        lo = hi
    weights = np.tile(_START.T, n)
    rng = np.full(n, (1 << 56) - 1, dtype=np.uint64)
    moved = np.zeros(n, dtype=np.uint64)  # bits that a block's code has moved on by
    adds, where = np.empty(len(ids), dtype=np.uint64), np.empty(len(ids), dtype=np.uint64)
    scratch, least = np.empty((3, n)), _TOP >> np.uint64(16)
    for first, last in tk.spans(step, TOGETHER):
        here = slice(int(step[first]), int(step[last]))
        each = live[first:last]
        own, below, upto = _shares(seen.reshape(-1, 9)[here], np.arange(first, last).repeat(each))
        own += 16 * (np.arange(len(own)) - (step[first:last] - step[first]).repeat(each))
        gain, held = upto - below, np.empty_like(below)
        # the weights that each id meets
        z = 0
        for k in each.tolist():
            a, z = z, z + k
            at, w, part = own[a:z], held[:, a:z], scratch[:, :k]
            for j in range(3):
                np.take(weights[j], at, out=w[j], mode="clip")
            np.multiply(gain[:, a:z], w, out=part)
            part /= part[0] + part[1] + part[2]
            part -= w
            part *= MOVE
            part += w
            np.maximum(part[0], FLOOR, out=part[0])
            for j in range(3):
                weights[j][at] = part[j]
        # shares of the mixture: of lesser ids, and of the id
        scale = _SHARES / (held[0] + held[1] + held[2])
        below *= held
        upto *= held
        c = ((below[0] + below[1] + below[2]) * scale).astype(np.int64)
        f = (((upto[0] + upto[1] + upto[2]) * scale).astype(np.int64) - c).view(np.uint64)
        c = c.view(np.uint64)
        # the coder's range; FLOOR of the prior is 6 shares at least, so that two digits of 16 bits are the most to move on by
        z = 0
        for k in each.tolist():
            a, z = z, z + k
            r, m = rng[:k], moved[:k]
            where[here][a:z] = m
            r >>= _BITS
            np.multiply(c[a:z], r, out=adds[here][a:z])
            r *= f[a:z]
            short = (r < _TOP).view(np.uint8) + (r < least).view(np.uint8)
            shift = np.left_shift(short, 4, dtype=np.uint64)
            r <<= shift
            m += shift
    # a code is the sum of what was added, each where the code had moved on to: digits of 16 bits with carries to come
    ends = (moved >> np.uint64(4)).astype(np.int64) + 4
    begin = np.cumsum(ends) - ends
    digit = (where >> np.uint64(4)).view(np.int64)
    for a, k in zip(step[:-1].tolist(), live.tolist(), strict=True):
        digit[a : a + k] += begin[:k]
    flat = np.zeros(int(ends.sum()))
    for shift in (40, 24, 8):
        flat += np.bincount(digit, adds >> np.uint64(shift) & np.uint64(0xFFFF), minlength=len(flat))
        digit += 1
    flat += np.bincount(digit, (adds & np.uint64(0xFF)) << np.uint64(8), minlength=len(flat))
    flat = flat.astype(np.uint32)
    low, high = (flat & 0xFFFF).astype(">u2").tobytes(), (flat >> 16).astype(">u2").tobytes()
    out: list[bytes] = [b""] * n
    for o, a, z in zip(rank_of.tolist(), (2 * begin).tolist(), (2 * (begin + ends)).tolist(), strict=True):
        whole = int.from_bytes(low[a:z], "big") + (int.from_bytes(high[a:z], "big") << 16)
        out[o] = whole.to_bytes(z - a, "big").rstrip(b"\0")
    return out


def encode(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """One block for each run of ``sizes`` ids (each at most ``BLOCK``, ids below ``VOCABULARY``)."""
    codes = _code(ids, sizes) if len(ids) else [b""] * len(sizes)
    raw = ids.astype("<u2").tobytes()
    start = np.cumsum(sizes) - sizes
    return [int(z).to_bytes(2, "little") + zlib.crc32(raw[2 * a : 2 * (a + z)]).to_bytes(4, "little") + c for a, z, c in zip(start.tolist(), sizes.tolist(), codes, strict=True)]


def decode(block: bytes) -> list[int]:
    """The ids of one block; ValueError if they don't have its checksum."""
    n, crc = int.from_bytes(block[:2], "little"), int.from_bytes(block[2:6], "little")
    data = block[6:]
    code, at = int.from_bytes(data[:7].ljust(7, b"\0"), "big"), 7
    rng = (1 << 56) - 1  # ``code`` is kept relative to the low end of the range
    ids: list[int] = []
    seen: list[int] = []
    after_one: dict[int, list[int]] = {}
    after_two: dict[tuple[int, int], list[int]] = {}
    weights = _START.tolist()
    below, none = _BELOW_LIST, []
    for i in range(n):
        key = (ids[-2], ids[-1]) if i >= 2 else None
        one = after_one.get(ids[-1], none) if i else none
        two = after_two.get(key, none) if key else none
        w = weights[4 * min(len(one), 3) + min(len(two), 3)]
        w0, w1, w2 = w
        total, n1, n2 = float(ADD * i + _PRIOR_TOTAL), max(len(one), 1), max(len(two), 1)
        scale = _SHARES / (w0 + w1 + w2)

        def upto(x: int) -> int:
            """Shares of the ids less than x."""
            return int((w0 * ((ADD * bisect_left(seen, x) + below[x]) / total) + w1 * (bisect_left(one, x) / n1) + w2 * (bisect_left(two, x) / n2)) * scale)

        r = rng >> SHARE_BITS
        value = code // r
        x, end = 0, VOCABULARY
        while end - x > 1:
            middle = (x + end) >> 1
            if upto(middle) <= value:
                x = middle
            else:
                end = middle
        c = upto(x)
        f = upto(x + 1) - c
        code -= r * c
        rng = r * f
        if not 0 <= code < rng:
            raise ValueError("a block is damaged")
        while rng < 1 << 40:
            code = code << 16 | int.from_bytes(data[at : at + 2].ljust(2, b"\0"), "big")
            at += 2
            rng <<= 16
        lesser, greater = (bisect_left(seen, x), bisect_left(one, x), bisect_left(two, x)), (bisect_left(seen, x + 1), bisect_left(one, x + 1), bisect_left(two, x + 1))
        got = [
            w0 * ((ADD * greater[0] + below[x + 1]) / total - (ADD * lesser[0] + below[x]) / total),
            w1 * (greater[1] / n1 - lesser[1] / n1),
            w2 * (greater[2] / n2 - lesser[2] / n2),
        ]
        p = got[0] + got[1] + got[2]
        w[:] = [(part / p - old) * MOVE + old for old, part in zip(w, got, strict=True)]
        w[0] = max(w[0], FLOOR)
        insort(seen, x)
        if i:
            insort(after_one.setdefault(ids[-1], []), x)
        if key:
            insort(after_two.setdefault(key, []), x)
        ids.append(x)
    if zlib.crc32(np.array(ids, dtype="<u2").tobytes()) != crc:
        raise ValueError("a block doesn't have its checksum")
    return ids


_BELOW_LIST = _BELOW.tolist()


class Words:
    """Tokenizes whole columns by their distinct words.

    The tokenizer's pattern always begins a piece at a space that comes before a character other than white space, and
    joins bytes within pieces only, so the ids of such a word with its space don't depend on what is around it: the
    distinct words of a column are tokenized as one text, which is cut where their bytes begin.
    """

    def __init__(self, encoding) -> None:
        self.encoding = encoding
        self.length = np.array([len(encoding.decode_single_token_bytes(i)) for i in range(encoding.n_vocab)], dtype=np.int64)

    def of(self, text: str) -> np.ndarray:
        """The ids of a text by itself."""
        return np.frombuffer(array("H", self.encoding.encode_ordinary(text)), dtype=np.uint16)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; how many each has); a null has none."""
        n = len(texts)
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        at = split.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        flat = split.flatten()
        coded = flat.dictionary_encode()
        place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary
        odd = pc.match_substring_regex(words, r"^(\s|\pZ|\x{85}|[\x1c-\x1f]|$)").to_numpy(zero_copy_only=False)
        bytes_of = np.where(odd, 0, pc.binary_length(words).to_numpy(zero_copy_only=False) + 1)
        plain = words.filter(pa.array(~odd))
        whole = pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain)
        every = [self.of(" " + pc.binary_join(whole, " ")[0].as_py()) if len(plain) else np.zeros(0, np.uint16)]
        ends = np.r_[0, np.cumsum(self.length[every[0]])]
        cuts = np.searchsorted(ends, np.r_[0, np.cumsum(bytes_of)])
        size = np.diff(cuts)
        # the first word of a text has no space before it
        first = at[:-1]
        every += [self.of(w) if w else np.zeros(0, np.uint16) for w in flat.take(pa.array(first)).to_pylist()]
        base = len(words)
        bad = odd[place]
        bad[first] = False
        place[first] = base + np.arange(n)
        for r in np.unique(np.searchsorted(at, np.flatnonzero(bad), side="right") - 1).tolist():
            # white space before white space: the pieces aren't those between spaces
            place[at[r] : at[r + 1]] = base + n
            place[at[r]] = base + r
            every[1 + r] = self.of(texts[r].as_py())
        size = np.r_[size, [len(p) for p in every[1:]], 0].astype(np.int64)
        store = np.concatenate(every)
        begin = np.cumsum(size) - size
        each = size[place]
        upto = np.cumsum(each)
        out = store[np.repeat(begin[place] - (upto - each), each) + np.arange(int(upto[-1]) if len(upto) else 0)]
        return out, np.diff(np.r_[0, upto][at])


_tokenizers: dict[str, Words] = {}


def tokenizer(path: str) -> Words:
    """The byte-level tokenizer whose ranks are in the file at ``path``, loaded once per process."""
    if path not in _tokenizers:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _tokenizers[path] = Words(tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
    return _tokenizers[path]


def _blocks(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        for batch in batches:
            text = batch.column(1)
            for lo, hi in tk.spans(tk.buffers(text)[1], CHUNK):
                ids, n = words.ids(text.slice(lo, hi - lo))
                parts = np.maximum(1, -(-n // BLOCK))  # an empty text has one empty block
                row = np.repeat(np.arange(hi - lo), parts)
                number = np.arange(len(row)) - (np.cumsum(parts) - parts)[row]
                sizes = np.minimum(BLOCK, n[row] - number * BLOCK)
                data = encode(ids, sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + row)), pa.array(number), pa.array(sizes), pa.array(data, pa.binary())], names=["doc_id", "block", "n_tokens", "data"])
        tk.release()

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(doc_id, block, n_tokens, data): the blocks of every row's token ids, numbered from 0.

    The whole text is tokenized with the byte-level vocabulary at ``path`` (which every executor must be able to
    read). A null or empty text has one block of no ids. Rows that repeat have blocks of their own, null ids are
    carried along; other columns are ignored; an empty table gives no rows.
    """
    rows = tk.small_batches(df).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(_blocks(path), "doc_id long, block long, n_tokens long, data binary")


def unpack(blocks: DataFrame) -> DataFrame:
    """(doc_id, block, ids) of each block; a damaged block fails the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([decode(b) for b in batch.column(2).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "block", "ids"])

    return blocks.select("doc_id", "block", "data").mapInArrow(run, "doc_id long, block long, ids array<int>")
