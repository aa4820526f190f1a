"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of up to ``ORDER`` bytes, counted on a bounded labelled sample and
then frozen. A byte costs -log2 of its share of its context, or of the context's escape (method C: as
many escapes as distinct followers) plus the cost in the context one byte shorter, down to 1/256. The
score of a language is the code length of the whole text; the shortest wins.

With frozen counts a byte's cost depends on the deepest known context before it alone, so the trees of all
languages are merged to one table, and whole batches are scored by table look-ups without a loop over bytes.
Bytes that no training text has behave alike and share one symbol, so the table is exact.

What is coded are a text's letters: lower-cased, with every run of other ASCII characters as one space.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmine.llm import textkit as tk

LANGUAGES = ("de", "en", "es", "fr")
#: Longest context in bytes.
ORDER = 4
#: Labelled documents that each language's tree is counted on (the bound of the training sample).
TRAIN_DOCS = 150
#: A context is kept if the training texts have it this often in one language.
LEAST_COUNT = 6
#: Code lengths are whole multiples of 1/UNIT bit.
UNIT = 512
#: A text whose best code takes more bits a byte than this is in none of the languages.
MAX_BITS = 5.5


_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True
_LETTER[128:] = True


def letters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded form of lower-cased texts: letters, and one space for what stands between or after them."""
    return tk.squeeze(data, offs, _LETTER)


@dataclass
class Model:
    """Frozen trees as tables. ``symbol``: byte to symbol; ``step``: (state, symbol) to state; ``cost``: (state, symbol)
    to the costs of up to four languages, 16 bits each, for each group of four."""

    languages: tuple[str, ...]
    order: int
    symbol: np.ndarray
    width: int
    step: np.ndarray
    cost: list[np.ndarray]
    counts: list[dict[bytes, Counter]]


def count(texts: list[bytes], order: int, least: int) -> dict[bytes, Counter]:
    """Followers of every context of up to ``order`` bytes that occurs ``least`` times (the empty one always)."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if not len(data):
        return {b"": Counter()}
    size = np.array([len(t) for t in texts])
    depth = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    found: dict[bytes, Counter] = {b"": Counter(dict(enumerate(np.bincount(data, minlength=256).tolist())))}
    found[b""] = Counter({k: v for k, v in found[b""].items() if v})
    key = data.astype(np.uint64)
    for k in range(1, order + 1):
        key[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * k) if k < len(data) else np.uint64(0)
        gram, n = np.unique(key[depth >= k], return_counts=True)
        ctx = gram >> np.uint64(8)
        first = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(ctx) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, first) if len(first) else n
        for f, e, t in zip(first, np.r_[first[1:], len(ctx)], total, strict=False):
            if t >= least:
                found[int(ctx[f]).to_bytes(k, "big")] = Counter({int(g) & 255: int(c) for g, c in zip(gram[f:e], n[f:e], strict=True)})
    return found


def fit(samples: dict[str, list[str]], order: int = ORDER, least: int = LEAST_COUNT) -> Model:
    """The model of each language's sample texts; texts are lower-cased, nulls and empty texts are ignored."""
    languages = tuple(sorted(samples))
    counts = []
    for x in languages:
        data, offs = letters(*tk.buffers(pc.utf8_lower(pa.array([t for t in samples[x] if t], pa.large_string()))))
        counts.append(count([data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)], order, least))
    contexts = sorted(set().union(*counts), key=lambda c: (len(c), c))
    used = sorted({b for c in counts for b in c[b""]})
    symbol = np.zeros(256, dtype=np.int64)  # 0: in no training text
    symbol[used] = np.arange(1, len(used) + 1)
    edge = len(used) + 1  # before a text's first byte
    width, n = edge + 1, len(contexts)
    at = {c: i for i, c in enumerate(contexts)}
    step = np.empty((2 * n, width), dtype=np.int32)  # state i + n: context i, and no deeper one is known
    step[:n] = (np.arange(n) + n)[:, None]
    step[n:] = (np.arange(n) + n)[:, None]
    units = np.empty((n, width, len(languages)), dtype=np.float64)
    for i, c in enumerate(contexts):
        if c:
            step[at[c[1:]], symbol[c[0]]] = i
        for j, known in enumerate(counts):
            row = units[at[c[1:]], :, j].copy() if c else np.full(width, 8.0)
            if follow := known.get(c):
                total, kinds = sum(follow.values()), len(follow)
                row += np.log2((total + kinds) / kinds)
                for b, k in follow.items():
                    row[symbol[b]] = np.log2((total + kinds) / k)
            units[i, :, j] = row
    whole = np.rint(units * UNIT).astype(np.int64)
    assert whole.max(initial=0) < 1 << 16, "a code length doesn't fit 16 bits"
    cost = []
    for lo in range(0, len(languages), 4):
        part = np.zeros((n, width, 4), dtype=np.uint16)
        part[:, :, : min(4, len(languages) - lo)] = whole[:, :, lo : lo + 4]
        packed = part.view(np.uint64)[:, :, 0]
        cost.append(np.concatenate([packed, packed]).reshape(-1))
    return Model(languages, order, symbol, width, step.reshape(-1), cost, counts)


def code_lengths(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, languages): code length of each row's bytes as ``letters`` gives them, in 1/UNIT bits."""
    rows = len(offs) - 1
    out = np.zeros((rows, len(model.languages)), dtype=np.int64)
    n = len(data)
    if not n:
        return out
    sym = model.symbol[data]
    state = np.zeros(n, dtype=np.int64)
    size = np.diff(offs)
    depth = np.arange(n) - np.repeat(offs[:-1], size)
    shifted = np.empty(n, dtype=np.int64)
    for k in range(1, model.order + 1):
        shifted[:k] = model.width - 1
        shifted[k:] = sym[:-k]
        starts = offs[:-1][size > 0]
        for d in range(k):  # the first k bytes of a text have no byte k places before them
            shifted[starts[size[size > 0] > d] + d] = model.width - 1
        state = model.step[state * model.width + shifted]
        state = state.astype(np.int64, copy=False)
    del depth
    cell = state * model.width + sym
    full = np.flatnonzero(size > 0)
    for g, table in enumerate(model.cost):
        parts = table[cell].view(np.uint16).reshape(n, 4)
        for j in range(min(4, len(model.languages) - 4 * g)):
            out[full, 4 * g + j] = np.add.reduceat(parts[:, j].astype(np.int64), offs[:-1][full])
    return out


def score(model: Model, text: pa.Array, max_bits: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(best language's number, coded bytes, all code lengths, accepted) of each row."""
    length, units = [], []
    for _, _, data, offs in tk.chunks(text, lower=True):
        data, offs = letters(data, offs)
        units.append(code_lengths(model, data, offs))
        length.append(np.diff(offs))
    every = np.concatenate(units) if units else np.zeros((0, len(model.languages)), np.int64)
    size = np.concatenate(length) if length else np.zeros(0, np.int64)
    best = every.argmin(axis=1) if len(every) else np.zeros(0, np.int64)
    least = every[np.arange(len(every)), best]
    return best, size, every, (size > 0) & (least <= max_bits * UNIT * size)


def sample(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, most: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Up to ``most`` labelled texts of each language: those with the least hashes of their ids; of an id of several texts the least."""
    ids = docs.select(F.col(id_col).cast("long").alias("i"), F.col(lang_col).alias("l")).where("i is not null").where(F.col("l").isin(list(languages)))
    place = F.dense_rank().over(Window.partitionBy("l").orderBy(F.xxhash64("i"), "i"))
    chosen: dict[int, str] = {r.i: r.l for r in ids.distinct().withColumn("k", place).where(F.col("k") <= most).collect()}
    out: dict[str, list[str]] = {x: [] for x in languages}
    if chosen:
        rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where(F.col("i").isin(list(chosen))).groupBy("i").agg(F.min("t").alias("t"))
        for r in sorted(rows.collect(), key=lambda r: (r.i, r.t or "")):
            out[chosen[r.i]].append(r.t or "")
    return out


def _scores(batches: Iterator[pa.RecordBatch], shared, max_bits: float) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        text = batch.column(1)
        best, size, every, accepted = score(model, text, max_bits)
        blank = pa.array(size == 0)
        code = pc.if_else(blank, None, pa.array(best.astype(np.int32)))
        names = pa.array(list(model.languages), pa.string())
        cols = [batch.column(0), names.take(code), pa.array(size)]
        cols += [pc.if_else(blank, None, pa.array(every[:, j])) for j in range(len(model.languages))]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(accepted)], names=["doc_id", "lang", "coded", *(f"units_{x}" for x in model.languages), "accepted"])
    tk.release()


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", max_bits: float = MAX_BITS) -> DataFrame:
    """(doc_id, lang, coded, units_<language>..., accepted) for each row.

    ``units_<language>`` is the code length of the whole text in 1/512 bit, ``coded`` the bytes that were coded;
    ``lang`` has the least, on ties the first by name. ``accepted``: that code takes at most ``max_bits`` bits a
    byte. A null or empty text, or one without letters, has null lang and units and isn't accepted. Repeated rows and null ids are answered row by row; other columns
    are ignored; an empty table gives no rows. A model fitted on nothing costs 8 bits a byte and accepts none.
    """
    shared = tk.small_batches(df).sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"units_{x} long" for x in model.languages)
    return df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(lambda b: _scores(b, shared, max_bits), f"doc_id long, lang string, coded long, {kinds}, accepted boolean")


def accepts(df: DataFrame, model: Model, max_bits: float = MAX_BITS) -> Callable[[Column], Column]:
    """A predicate on a text column: is it in one of the model's languages?"""
    shared = tk.small_batches(df).sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def accepted(text: pa.Array) -> pa.Array:
        out = pa.array(score(shared.value, text, max_bits)[3])
        tk.release()
        return out

    return accepted


def drop_foreign(df: DataFrame, model: Model, text_col: str = "text", max_bits: float = MAX_BITS) -> DataFrame:
    """The rows of ``df`` whose text is accepted; all columns as they were. Null texts and texts without letters go."""
    return df.where(accepts(df, model, max_bits)(F.col(f"`{text_col}`").cast("string")))
