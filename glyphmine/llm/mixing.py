"""Copies of documents for target source weights, by pivotal dependent rounding in a reduction tree.

A document's expected copies are those of its source: ``floor`` copies are sure, the fraction is rounded. Pivotal
rounding pairs two fractions and moves mass between them at random until one is 0 or 1; the other meets the
next. Each leaf of the tree rounds the documents of one (source, bucket) and hands up at most one
fraction; each node pairs the fractions of ``ARITY`` children; a source's root rounds the last one. So a source's
copies miss their expectation by less than one, and every document keeps its probability. Fractions are
integers in 2**-32 and random numbers are hashes of ids, so that a task that is run again decides the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmine.llm import textkit as tk

ONE = 1 << 32
#: Documents of a leaf, and children of a node.
LEAF, ARITY = 20_000, 16
#: Sources weigh as this power of their bytes, unless target weights are given.
POWER = 0.85
SEED = 20_240_601


def pivotal(p: list[int], u: list[int]) -> tuple[list[int], int]:
    """Rounded fractions (0 or 1, in units of ``ONE``) and the place of the one left over, or -1.

    ``p``: fractions in 1..ONE-1; ``u``: a random 64-bit number of each.
    """
    out = list(p)
    held = -1
    for i, q in enumerate(p):
        if held < 0:
            held = i
            continue
        a = out[held]
        total = a + q
        if total <= ONE:  # one of the two takes all
            winner, loser = (held, i) if u[i] * total < a << 64 else (i, held)
            out[winner], out[loser] = total, 0
            held = -1 if total == ONE else winner
        else:  # one of the two is filled
            filled, rest = (held, i) if u[i] * (2 * ONE - total) < (ONE - q) << 64 else (i, held)
            out[filled], out[rest] = ONE, total - ONE
            held = rest
    return out, held


def _node(seed: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Rounds the rows of one node: ``p`` becomes 0 or ONE, save for at most one row, which the root rounds too."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "id"], kind="stable").reset_index(drop=True)
        h = rows["h"].to_numpy().view(np.uint64)
        u = tk.mix64(h ^ np.uint64(seed)).tolist()
        p = rows["p"].tolist()
        live = [i for i, x in enumerate(p) if 0 < x < ONE]
        got, held = pivotal([p[i] for i in live], [u[i] for i in live])
        if last and held >= 0:
            own = int(tk.mix64(h[live[held] : live[held] + 1] ^ np.uint64(seed + 1))[0])
            got[held] = ONE if own < got[held] << 32 else 0
        for i, x in zip(live, got, strict=True):
            p[i] = x
        rows["p"] = p
        return rows

    return run


def expected_copies(df: DataFrame, source: Column, text: Column, weights: dict[str, float] | None = None, budget_bytes: float | None = None, power: float = POWER) -> DataFrame:
    """(source, docs, x): rows of each source and the expected copies of each of its documents.

    With ``weights``, the copies of source s hold the share weights[s] / sum(weights) of ``budget_bytes`` (by default
    the bytes there are); a source without a weight gets none. Else the weight is the source's bytes to ``power``
    and the budget the least that gives every document one copy or more.
    """
    mass = df.select(source.alias("source"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("b")).groupBy("source").agg(F.count("*").alias("docs"), F.greatest(F.sum("b"), F.lit(1)).alias("mass"))
    if weights is None:
        most = mass.agg(F.max("mass").alias("most"))
        return mass.crossJoin(F.broadcast(most)).select("source", "docs", F.pow(F.col("most") / F.col("mass"), F.lit(1.0 - power)).alias("x"))
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k, w in weights.items() for v in (k, float(w) / sum(weights.values()))]), F.coalesce("source", F.lit(""))), F.lit(0.0))
    budget = F.lit(float(budget_bytes)) if budget_bytes is not None else F.col("every")
    return mass.crossJoin(F.broadcast(mass.agg(F.sum("mass").cast("double").alias("every")))).select("source", "docs", (share * budget / F.col("mass")).alias("x"))


def copies(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, budget_bytes: float | None = None, power: float = POWER, seed: int = SEED, leaf: int = LEAF) -> DataFrame:
    """(doc_id, source, copies) for each distinct (doc_id, source).

    Rows that repeat an id of a source are one document and share its copies. A null source is a source of its
    own; a null id is one document. Null and empty texts count as documents without bytes. Other columns are
    ignored; an empty table gives no rows. The sum of copies of a source is its expectation rounded up or down.
    """
    source = F.col(source_col).cast("string")
    units = df.select(F.col(id_col).cast("long").alias("id"), source.alias("source")).distinct()
    plan = tk.cut(expected_copies(df, source, F.col(text_col).cast("string"), weights, budget_bytes, power))
    largest = plan.agg(F.max("docs")).first()[0] or 0
    whole = F.floor("x")
    x = plan.select("source", whole.cast("long").alias("sure"), F.least(F.round((F.col("x") - whole) * ONE), F.lit(ONE)).cast("long").alias("p"), F.greatest(F.ceil(F.col("docs") / leaf), F.lit(1)).alias("leaves"))
    h = F.xxhash64(F.col("u.id"), F.lit(seed))
    level = units.alias("u").join(x.alias("x"), F.col("u.source").eqNullSafe(F.col("x.source"))).select("u.id", "u.source", h.alias("h"), F.pmod(F.xxhash64(h, F.lit(1)), F.col("leaves")).alias("node"), "p", "sure")
    kind = "id long, source string, h long, node long, p long, sure long"
    leaves, depth, done = max(1, -(-largest // leaf)), 0, []
    while True:
        last = leaves == 1
        level = level.groupBy("source", "node").applyInPandas(_node(seed + 2 * depth, last), kind)
        if last:
            done.append(level)
            break
        level = tk.cut(level)
        done.append(level.where((F.col("p") == 0) | (F.col("p") == ONE)))
        level = level.where((F.col("p") > 0) & (F.col("p") < ONE)).withColumn("node", F.floor(F.col("node") / ARITY))
        leaves, depth = -(-leaves // ARITY), depth + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(F.col("id").alias("doc_id"), "source", (F.col("sure") + F.when(F.col("p") == ONE, 1).otherwise(0)).cast("long").alias("copies"))


def resample(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """``df`` with each row as often as its document has copies; columns as they were."""
    i, s, n, k = tk.fresh(df, "mix_id", "mix_source", "mix_copies", "mix_copy")
    drawn = copies(df, id_col, source_col, text_col, **how).toDF(i, s, n).where(F.col(n) > 0)
    both = df.join(drawn, df[id_col].cast("long").eqNullSafe(F.col(i)) & df[source_col].cast("string").eqNullSafe(F.col(s)))
    return both.withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[df[f"`{c}`"] for c in df.columns])
