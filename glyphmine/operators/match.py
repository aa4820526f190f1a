"""Every distinct substring of a text that a regular expression matches, with its count.

On plain documents, a DFA runs from all places of all texts of a batch side by side, and a start drops out when its state
is dead. On an index, matches are the paths of a search over rank intervals that extends by one byte a step.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmine.functions.automata import DFA, core_dfa, dfa
from glyphmine.functions.regex_ast import parse, required_literal, rewrite
from glyphmine.operators import kernels as kn


def occurrences(d: DFA, data: np.ndarray, offs: np.ndarray, max_length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, place of the start among all bytes, length) of the non-empty accepted substrings of up to ``max_length`` code points."""
    table = d.table.reshape(-1)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    begins = (data & 0xC0) != 0x80
    at = np.flatnonzero(begins)
    state, chars = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    end = offs[1:][row] if len(row) else row
    length = 0
    while len(at):
        inside = at + length < end[at]
        at, state, chars = at[inside], state[inside], chars[inside]
        state = table[state << 8 | data[at + length]]
        chars = chars + begins[at + length]
        alive = (state >= 0) & ((chars <= max_length) if max_length else True)
        at, state, chars = at[alive], state[alive].astype(np.int64), chars[alive]
        length += 1
        hit = d.final[state]
        if hit.any():
            yield row[at[hit]], at[hit], length


def substrings(d: DFA, text: str, max_length: int) -> list[tuple[str, int]]:
    """(match, count) of one text."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    found: Counter = Counter()
    for _, at, n in occurrences(d, data, np.array([0, len(raw)]), max_length):
        found.update(raw[a : a + n].decode(errors="replace") for a in at.tolist())
    return sorted(found.items())


def regex_matches(df: DataFrame, pattern: str, max_length: int = 0, core: bool = False, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, match, len, cnt): every distinct non-empty substring in the language, its code points and its overlapping occurrences.

    ``max_length`` bounds the code points of a match; 0 means no bound. ``core``: the pattern without leading and
    trailing parts that can be empty, and with accepting positions not walked further; a pattern that is nothing
    but such parts has no matches. Null and empty texts have none.
    """
    d = core_dfa(parse(pattern, **how)) if core else dfa(parse(pattern, **how))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    schema = "doc_id long, match string, len int, cnt int"
    if d is None:
        return df.sparkSession.createDataFrame([], schema)
    literal = required_literal(parse(pattern, **how)) if not core else ""
    if len(literal) > 1:
        rows = rows.where(F.col("t").contains(literal))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in kn.passes(kn.buffers(batch.column(1))[1]):
                data, offs = kn.buffers(batch.column(1).slice(lo, hi - lo))
                raw = data.tobytes()
                found: Counter = Counter()
                for row, at, n in occurrences(d, data, offs, max_length):
                    found.update((r, raw[a : a + n]) for r, a in zip(row.tolist(), at.tolist(), strict=True))
                pairs = [(r, m.decode(errors="replace"), c) for (r, m), c in found.items()]
                r, m, c = zip(*pairs, strict=True) if pairs else ((),) * 3
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(r, pa.int64())), pa.array(m, pa.string()), pa.array([len(x) for x in m], pa.int32()), pa.array(c, pa.int32())], names=["doc_id", "match", "len", "cnt"])

    return rows.mapInArrow(run, schema)


def hybrid_matches(df: DataFrame, pattern: str, max_length: int = 0, postings: DataFrame | None = None, gram: int = 3, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``regex_matches`` over the texts that hold the pattern's required literal.

    Without ``postings`` the literal is a ``contains`` filter. With ``ngram_postings`` rows, texts are first cut down to
    those that have all the literal's n-grams, by a semi-join with the rarest and counts of the rest.
    """
    literal = required_literal(rewrite(parse(pattern, **how)))
    if postings is not None and len(literal) >= gram:
        grams = sorted({literal[i : i + gram] for i in range(len(literal) - gram + 1)})
        have = postings.where(F.col("gram").isin(grams)).groupBy("doc_id").agg(F.count("*").alias("k")).where(F.col("k") == len(grams)).select(F.col("doc_id").alias(id_col))
        df = df.join(have, id_col, "left_semi")
    if literal:
        df = df.where(F.col(text_col).contains(literal))
    return regex_matches(df, pattern, max_length, False, id_col, text_col, **how)


def ngrams(texts: pa.Array, n: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(gram, row, count) of the distinct n-grams of code points of each text."""
    data, offs = kn.buffers(texts)
    begins = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    upto = np.r_[0, np.cumsum(begins)][offs]  # code points before each text
    known, code = np.unique(points, return_inverse=True)
    size = np.diff(upto)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(points))
    whole = np.flatnonzero(at + n <= upto[1:][row]) if len(at) else at
    gram = np.zeros(len(whole), dtype=np.int64)
    wide = max(1, len(known))
    for k in range(n):
        if wide * max(1, int(gram.max(initial=0)) + 1) > 1 << 62:  # numbers of the grams so far instead of the grams
            gram = np.unique(gram, return_inverse=True)[1]
        gram = gram * wide + code[whole + k]
    distinct, sample, gram = np.unique(gram, return_index=True, return_inverse=True)
    key, cnt = np.unique(row[whole] * max(1, len(distinct)) + gram, return_counts=True)
    # each distinct gram's text, from a place where it is
    cut = np.r_[np.flatnonzero(begins), len(data)]
    first, end = cut[whole[sample]], cut[whole[sample] + n]
    length = end - first
    body = data[np.repeat(first - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(int(length.sum()))] if len(length) else data[:0]
    texts_of = pa.StringArray.from_buffers(len(distinct), pa.py_buffer(np.r_[0, np.cumsum(length)].astype(np.int32).tobytes()), pa.py_buffer(body.tobytes()))
    return texts_of.take(pa.array(key % max(1, len(distinct)))), key // max(1, len(distinct)), cnt


def ngram_postings(df: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(gram, doc_id, cnt): the distinct n-grams of code points of each text with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in kn.passes(kn.buffers(batch.column(1))[1]):
                grams, row, cnt = ngrams(batch.column(1).slice(lo, hi - lo), n)
                yield pa.RecordBatch.from_arrays([grams, batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(cnt)], names=["gram", "doc_id", "cnt"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    return rows.mapInArrow(run, "gram string, doc_id long, cnt long")


def ngram_counts(df: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(gram, docs, cnt): in how many texts each n-gram is, and how often in all."""
    return ngram_postings(df, n, id_col, text_col).groupBy("gram").agg(F.count("*").alias("docs"), F.sum("cnt").alias("cnt"))


def search_index(ranks: kn.Ranks, d: DFA, max_length: int, max_iterations: int, max_branching: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """((length, sp, ep) of the accepted intervals, (state, length, sp, ep) of those that a bound left unfinished).

    The index is of the text backwards, so a step of backward search goes forward in the text. The longest interval that
    waits is extended first, of equally long ones the one that came first: a bounded search finds whole matches early.
    """
    front: list[tuple[int, int, int, int, int, int]] = [(0, 0, 0, 0, 0, ranks.n)]
    out: set[tuple[int, int, int]] = set()
    steps = came = 0
    while front:
        if (max_iterations and steps >= max_iterations) or (max_branching and len(front) > max_branching):
            return sorted(out), [x[2:] for x in sorted(front)]
        steps += 1
        _, _, s, n, sp, ep = heappop(front)
        for c in ranks.distinct(sp, ep):
            t = int(d.table[s, c])
            if t < 0 or (got := ranks.before(sp, ep, c)) is None:
                continue
            if d.final[t]:
                out.add((n + 1, *got))
            if not max_length or n + 1 < max_length:
                came += 1
                heappush(front, (-n - 1, came, t, n + 1, *got))
    return sorted(out), []


def search_indexes(bwt: np.ndarray, first: np.ndarray, eof: np.ndarray, d: DFA, max_length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, text, sp, ep) of the accepted intervals of many indexes side by side, a length at a time; ``first``: where each index begins.

    Intervals of one length are disjoint. What stands before the ranks of a small one is read; of a large one, each byte is looked up.
    """
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    code = bwt.astype(np.int64) + 1
    code[first[:-1] + eof] = 0
    key = text * 257 + code
    order = np.argsort(key, kind="stable")
    lf = np.empty(len(order), dtype=np.int64)
    lf[order] = np.arange(len(order))
    wide = len(order) + 1
    sorted_keys = key[order] * wide + order
    known = np.unique(code)
    known = known[known > 0]
    table = d.table
    sp, ep, state, length = first[:-1].astype(np.int64), first[1:].astype(np.int64), np.zeros(len(first) - 1, np.int64), 0
    while len(sp) and (not max_length or length < max_length):
        length += 1
        large = ep - sp > 64
        # each byte before a large interval
        row, c = np.repeat(np.flatnonzero(large), len(known)), np.tile(known, int(large.sum()))
        to = table[state[row], c - 1]
        row, c, to = row[to >= 0], c[to >= 0], to[to >= 0]
        keys = (text[sp[row]] * 257 + c) * wide
        lo, hi = np.searchsorted(sorted_keys, keys + sp[row]), np.searchsorted(sorted_keys, keys + ep[row])
        some = lo < hi
        found = [(lo[some], hi[some], to[some])]
        # the bytes before a small one, those that are alike side by side
        row = np.flatnonzero(~large)
        size = (ep - sp)[row]
        at = np.repeat(sp[row] - np.r_[0, np.cumsum(size)[:-1]] if len(row) else row, size) + np.arange(int(size.sum()))
        row = np.repeat(row, size)
        row, at = row[code[at] > 0], at[code[at] > 0]
        to = table[state[row], code[at] - 1]
        row, at, to = row[to >= 0], at[to >= 0], to[to >= 0]
        by = np.argsort(lf[at])
        row, at, to = row[by], at[by], to[by]
        begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[at][1:] != code[at][:-1])]) if len(at) else at
        found.append((lf[at[begin]], lf[at[np.r_[begin[1:], len(at)] - 1]] + 1 if len(at) else at, to[begin]))
        sp, ep, state = (np.concatenate([np.asarray(x[k], dtype=np.int64) for x in found]) for k in range(3))
        hit = d.final[state]
        if hit.any():
            own = text[sp[hit]]
            yield length, own, sp[hit] - first[own], ep[hit] - first[own]


def index_matches(index: DataFrame, pattern: str, max_length: int = 0, max_iterations: int = 0, max_branching: int = 0, core: bool = False, **how) -> DataFrame:
    """(doc_id, match, len, sp, ep, cnt, truncated): the distinct matches in texts by their index of orientation 'reversed'.

    Lengths are bytes. ``max_iterations`` bounds the intervals that are extended and ``max_branching`` those that wait;
    with either, results may be a part of all, and ``truncated`` says so. 0 means no bound.
    """
    node = parse(pattern, **how)
    d = core_dfa(node) if core else dfa(node)
    schema = "doc_id long, match string, len int, sp int, ep int, cnt int, truncated boolean"
    if d is None:
        return index.sparkSession.createDataFrame([], schema)

    def whole(batch: pa.RecordBatch) -> Iterator[tuple[int, str, int, int, int, int, bool]]:
        bwt, first = kn.buffers(batch.column(3))
        data, offs = kn.buffers(batch.column(1))
        raw, places = data.tobytes(), batch.column(2).flatten().to_numpy(zero_copy_only=False)
        for n, text, sp, ep in search_indexes(bwt, first, batch.column(4).to_numpy().astype(np.int64), d, max_length):
            at = offs[text] + places[first[text] + sp]
            for k, a, lo, hi in zip(text.tolist(), at.tolist(), sp.tolist(), ep.tolist(), strict=True):
                yield k, raw[a : a + n][::-1].decode(errors="replace"), n, lo, hi, hi - lo, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(lo, hi - lo) for batch in batches for lo, hi in kn.passes(kn.buffers(batch.column(3))[1], 8 * kn.SORT_BYTES))
        for batch in parts:
            rows = []
            if not max_iterations and not max_branching:
                rows = list(whole(batch))
                batch_rows = ()
            else:
                batch_rows = zip(*(batch.column(x).to_pylist() for x in (1, 2, 3, 4)), strict=True)
            for k, (data, sa, bwt, eof) in enumerate(batch_rows):
                found, rest = search_index(kn.Ranks(np.frombuffer(bwt, np.uint8), eof), d, max_length, max_iterations, max_branching)
                rows += [(k, data[sa[sp] : sa[sp] + n][::-1].decode(errors="replace"), n, sp, ep, ep - sp, bool(rest)) for n, sp, ep in found]
            k, *cols = zip(*rows, strict=True) if rows else ((),) * 7
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k, pa.int64())), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], names=["doc_id", "match", "len", "sp", "ep", "cnt", "truncated"])

    return index.select("doc_id", "data", "sa", "bwt", "eof").mapInArrow(run, schema)


def index_tips(index: DataFrame, pattern: str, max_length: int = 0, max_iterations: int = 0, max_branching: int = 0, **how) -> DataFrame:
    """(doc_id, prefix, len, state, sp, ep, cnt): what a bounded ``index_matches`` leaves unfinished, to go on from or to report.

    ``prefix`` is what an interval has read so far and ``state`` where the automaton is. A search that ends by itself has none.
    """
    d = dfa(parse(pattern, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (data, sa, bwt, eof) in enumerate(zip(*(batch.column(x).to_pylist() for x in (1, 2, 3, 4)), strict=True)):
                _, rest = search_index(kn.Ranks(np.frombuffer(bwt, np.uint8), eof), d, max_length, max_iterations, max_branching)
                rows += [(k, data[sa[sp] : sa[sp] + n][::-1].decode(errors="replace"), n, s, sp, ep, ep - sp) for s, n, sp, ep in rest]
            k, *cols = zip(*rows, strict=True) if rows else ((),) * 7
            kinds = (pa.string(), *[pa.int32()] * 5)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k, pa.int64())), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], names=["doc_id", "prefix", "len", "state", "sp", "ep", "cnt"])

    return index.select("doc_id", "data", "sa", "bwt", "eof").mapInArrow(run, "doc_id long, prefix string, len int, state int, sp int, ep int, cnt int")


def result_text(matches: DataFrame) -> DataFrame:
    """``matches`` with ``shown``: '[n Results] match', the match alone if it is the only one, '[no results]' for none."""
    return matches.withColumn("shown", F.when(F.col("cnt") == 0, "[no results]").when(F.col("cnt") == 1, F.col("match")).otherwise(F.concat(F.lit("["), F.col("cnt").cast("string"), F.lit(" Results] "), F.col("match"))))
