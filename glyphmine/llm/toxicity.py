"""Toxicity scores by a factorization machine over hashed terms.

A document is the set of its words and of their beginnings (insults in compounds and inflected forms), hashed to ``2**BITS``
terms. Its score is ``w0 + Σ w_i + Σ_{i<j} <v_i, v_j>``, so that
pairs of terms (an insult with a mention of a group) count beyond their sum. It is fitted on a bounded
labelled sample by AdaGrad on the logistic loss; proximal steps pull weights and factors to exactly 0, so that a
long text isn't a sum of noise. The fit works on the terms that can leave 0: it begins with those whose slope beats the penalty,
and all terms of the sample are looked at again after each round, until none that is left out would move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmine.llm import textkit as tk

BITS = 20
#: Bytes of a word's beginnings.
BEGINNINGS = (5, 6, 7, 8)
FACTORS = 4
#: Labelled documents that are fitted on (the bound of the sample), half of them toxic if there are as many.
TRAIN_DOCS = 4000
STEPS, RATE = 150, 0.3
#: Penalties on the mean loss.
L1, GROUP = 0.002, 0.002
SEED = 7


@dataclass
class Model:
    """``terms``: sorted terms with a weight or factors; their ``w`` and ``v``; ``at``: term to place, or the last, all-zero one."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    at: np.ndarray


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term, row) of the distinct terms of each (lower-cased) text, sorted by row."""
    h, row = tk.word_hashes(data, offs, BEGINNINGS)
    pair = np.sort(row << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64))
    pair = pair[np.r_[True, pair[1:] != pair[:-1]]] if len(pair) else pair
    return pair & ((1 << BITS) - 1), pair >> BITS


def _logits(w0: float, w: np.ndarray, v: np.ndarray, x: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    z, sums = w0 + np.bincount(row, weights=w[x], minlength=n), []
    for f in range(v.shape[1]):
        vx = v[x, f]
        sums.append(np.bincount(row, weights=vx, minlength=n))
        z += 0.5 * (sums[-1] ** 2 - np.bincount(row, weights=vx * vx, minlength=n))
    return z, sums


def gradients(w0: float, w: np.ndarray, v: np.ndarray, x: np.ndarray, row: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the mean logistic loss: by each document's logit, by weights and by factors; ``x`` are the terms of the documents ``row``."""
    z, sums = _logits(w0, w, v, x, row, len(y))
    g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
    by_factor = [np.bincount(x, weights=g[row] * (s[row] - v[x, f]), minlength=len(w)) for f, s in enumerate(sums)]
    return g, np.bincount(x, weights=g[row], minlength=len(w)), np.stack(by_factor, axis=1)


def fit(docs: list[np.ndarray], labels: list[int], steps: int = STEPS, seed: int = SEED) -> Model:
    """The machine of documents given as arrays of distinct terms; without examples of both kinds it scores all below 0.

    Proximal AdaGrad on the whole sample: an L1 penalty on weights and a group penalty on factors leave only terms
    that the labels call for; a second run without penalties then fits those.
    """
    size, n = 1 << BITS, len(docs)
    at = np.zeros(size, dtype=np.int32)
    if len(set(labels)) < 2:
        return Model(-10.0, np.zeros(1), np.zeros((1, FACTORS)), at)
    y = np.array(labels, dtype=np.float64)
    row, term = np.repeat(np.arange(n), [len(d) for d in docs]), np.concatenate(docs)
    rng = np.random.default_rng(seed)

    def run(used: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray, l1: float, group: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """(w0, w, v, slope of each document's logit) after ``steps`` steps."""
        place = np.full(size, -1)
        place[used] = np.arange(len(used))
        x = place[term]
        r, x = row[x >= 0], x[x >= 0]
        g0, gw, gv = 1e-8, np.full(len(w), 1e-8), np.full(len(w), 1e-8)
        for _ in range(steps):
            g, grad, grad_v = gradients(w0, w, v, x, r, y)
            g0 += g.sum() ** 2
            w0 -= RATE * g.sum() / np.sqrt(g0)
            gw += grad**2
            gv += (grad_v**2).sum(axis=1)
            step = RATE / np.sqrt(gw)
            w = w - step * grad
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            step = RATE / np.sqrt(gv + 1e-6)
            v = v - step[:, None] * grad_v
            v = v * np.maximum(0, 1 - step * group / np.maximum(np.linalg.norm(v, axis=1), 1e-12))[:, None]
        return w0, w, v, gradients(w0, w, v, x, r, y)[0]

    used, w0, w, v = np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, FACTORS))
    slope = (y.mean() - y) / n
    while True:
        # a left-out term without factors moves if its weight's slope beats the penalty
        more = np.setdiff1d(np.flatnonzero(np.abs(np.bincount(term, weights=slope[row], minlength=size)) > L1), used)
        if not len(more):
            break
        used = np.r_[used, more]
        w0, w, v, slope = run(used, w0, np.r_[w, np.zeros(len(more))], np.r_[v, rng.normal(0, 0.05, (len(more), FACTORS))], L1, GROUP)
    live = (w != 0) | (v != 0).any(axis=1)
    order = np.argsort(used[live])
    used, w, v = used[live][order], w[live][order], v[live][order]
    w0, w, v, _ = run(used, w0, w, v, 0.0, 0.0)
    at[:] = len(used)
    at[used] = np.arange(len(used))
    return Model(float(w0), np.r_[w, 0.0], np.r_[v, np.zeros((1, FACTORS))], at)


def scores(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The score (a logit) of each (lower-cased) text."""
    term, row = terms(data, offs)
    out = np.full(len(offs) - 1, model.w0)
    x = model.at[term]
    known = x < len(model.w) - 1
    x, row = x[known], row[known]
    live = (model.w[x] != 0) | (model.v[x] != 0).any(axis=1)
    x, row = x[live], row[live]
    n = len(out)
    out += np.bincount(row, weights=model.w[x], minlength=n)
    for f in range(model.v.shape[1]):
        vx = model.v[x, f]
        out += 0.5 * (np.bincount(row, weights=vx, minlength=n) ** 2 - np.bincount(row, weights=vx * vx, minlength=n))
    return out


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in tk.chunks(batch.column(1), lower=True):
            term, row = terms(data, offs)
            at = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at), pa.array(term.astype(np.int32)))], names=["i", "terms"])


def sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[np.ndarray], list[int]]:
    """Terms and labels of up to ``most`` documents: of each kind those with the least hashes of their ids.

    Ids are chosen from the labels alone, so that the documents' scan meets a set of bounded size. Null ids and labels
    are ignored, an id with both labels is toxic, and of an id of several texts the least is taken.
    """
    y = labels.select(F.col(id_col).cast("long").alias("i"), (F.col(label_col).cast("int") == 1).cast("int").alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))
    place = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("i"), "i"))
    first = sorted(y.withColumn("k", place).where(F.col("k") <= most).collect(), key=lambda r: (-r.y, r.k))
    chosen: dict[int, int] = {r.i: 1 for r in first if r.y and r.k <= most // 2}
    chosen |= {r.i: 0 for r in first if not r.y and r.k <= most - len(chosen)}
    if not chosen:
        return [], []
    ids = df_of(docs, list(chosen))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(ids), "i", "left_semi").groupBy("i").agg(F.min("t").alias("t")).mapInArrow(_term_rows, "i long, terms array<int>").collect()
    rows.sort(key=lambda r: (r.i, r.terms))
    return [np.array(r.terms, dtype=np.int64) for r in rows], [chosen[r.i] for r in rows]


def df_of(df: DataFrame, ids: list[int]) -> DataFrame:
    """(i): a table of the chosen ids, no more than the sample's bound."""
    return df.sparkSession.createDataFrame(pa.table({"i": pa.array(ids, pa.int64())}))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, toxic) for each row: the machine's logit and whether it is above 0.

    The whole text counts. A null text has a null score and isn't toxic; an empty or wordless one has the score of
    no terms, ``w0``. Repeated rows and null ids are answered row by row; other columns are ignored; an empty table
    gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.chunks(batch.column(1), lower=True):
                s = scores(shared.value, data, offs)
                null = batch.column(1).slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s, mask=null), pa.array((s > 0) & ~null)], names=["doc_id", "score", "toxic"])

    return df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, score double, toxic boolean")
