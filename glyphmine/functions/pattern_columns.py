"""Regular expressions as predicates on text columns.

Engines: 'java' hands an equivalent pattern to Spark's own matcher, inside generated code; it is taken for patterns
without nested or many unbounded repetitions, on which a backtracking matcher can't blow up. 'dfa' runs a table over
all rows of a batch side by side. 'fold' is the same table as a native higher-order expression, for short columns. 'nfa' follows
all states of a Thompson automaton text by text: it needs no table, so it takes patterns whose DFA would be too large.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from glyphmine.functions.automata import DFA, dfa, nfa
from glyphmine.functions.regex_ast import Node, parse, to_java
from glyphmine.operators import kernels as kn


def is_tame(node: Node) -> bool:
    """Can a backtracking matcher take only polynomial time of low degree on the tree?"""
    loops = 0

    def walk(n: Node, inside: bool) -> bool:
        nonlocal loops
        loop = n.kind in ("star", "plus")
        loops += loop
        if loop and (inside or n.kids[0].kind == "opt"):
            return False
        return all(walk(k, inside or loop) for k in n.kids)

    return walk(node, False) and loops <= 2


@lru_cache(maxsize=256)
def compiled(pattern: str) -> DFA:
    """The DFA of a pattern, kept by each process."""
    return dfa(parse(pattern))


def run_all(d: DFA, data: np.ndarray, offs: np.ndarray, prefix: bool = False) -> np.ndarray:
    """Does the DFA accept each whole text, or with ``prefix`` a prefix of it?"""
    n, dead = len(offs) - 1, len(d.table)
    table = np.concatenate([np.where(d.table < 0, dead, d.table), np.full((1, 256), dead)]).astype(np.int32)
    final = np.r_[d.final, False]
    if prefix:
        table[:-1][d.final] = np.flatnonzero(d.final)[:, None]
    table = table.reshape(-1)
    order = np.argsort(-np.diff(offs), kind="stable")
    start, size = offs[:-1][order], np.diff(offs)[order]
    state = np.zeros(n, dtype=np.int64)
    stay = np.arange(n)
    for p in range(int(size[0]) if n else 0):
        stay = stay[: np.searchsorted(-size[stay], -p, side="left")]
        if not len(stay):
            break
        state[stay] = table[state[stay] << 8 | data[start[stay] + p]]
        if p % 16 == 15:
            settled = (state[stay] == dead) | (prefix & final[state[stay]])
            stay = stay[~settled]
    out = np.zeros(n, dtype=bool)
    out[order] = final[state]
    return out


def _by_table(node: Node, prefix: bool):
    d = dfa(node)

    @F.arrow_udf("boolean")
    def match(text: pa.Array) -> pa.Array:
        data, offs = kn.buffers(text)
        return pa.array(run_all(d, data, offs, prefix), mask=text.is_null().to_numpy(zero_copy_only=False))

    return match


def full_match_dfa(text: Column, d: DFA) -> Column:
    """Does an automaton at hand, however it was made, accept the whole text? Null for a null text."""

    @F.arrow_udf("boolean")
    def match(column: pa.Array) -> pa.Array:
        return pa.array(run_all(d, *kn.buffers(column)), mask=column.is_null().to_numpy(zero_copy_only=False))

    return match(text)


def _by_nfa(node: Node, text: Column) -> Column:
    machine = nfa(node)

    @F.arrow_udf("boolean")
    def match(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else machine.matches(t.encode()) for t in column.to_pylist()], pa.bool_())

    return match(text)


def _by_fold(node: Node, text: Column, prefix: bool) -> Column:
    d = dfa(node)
    table = d.table.copy()
    if prefix:
        table[d.final] = np.flatnonzero(d.final)[:, None]
    flat = F.array(*[F.lit(int(x)) for x in table.reshape(-1)])
    digits = F.hex(F.encode(text, "utf-8"))
    codes = F.transform(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int"))
    codes = F.when(F.length(digits) > 0, codes).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(codes, F.lit(0), lambda s, c: F.when(s < 0, s).otherwise(F.element_at(flat, s * 256 + c + 1)))
    return F.when(text.isNotNull(), F.array_contains(F.array(*[F.lit(int(x)) for x in np.flatnonzero(d.final)] or [F.lit(-2)]), end))


def full_match(text: Column, pattern: str, engine: str = "auto", **how) -> Column:
    """Is the whole text in the pattern's language? Null for a null text. ``how`` goes to ``parse``."""
    node = parse(pattern, **how)
    if engine == "java" or engine == "auto" and is_tame(node) and how.get("unit", "char") == "char":
        return text.rlike(f"(?s)\\A(?:{to_java(node)})\\z")
    if engine == "nfa":
        return _by_nfa(node, text)
    return _by_fold(node, text, False) if engine == "fold" else _by_table(node, False)(text)


def prefix_match(text: Column, pattern: str, engine: str = "auto", **how) -> Column:
    """Does a prefix of the text (perhaps the empty one) match? Null for a null text."""
    node = parse(pattern, **how)
    if engine == "java" or engine == "auto" and is_tame(node) and how.get("unit", "char") == "char":
        return text.rlike(f"(?s)\\A(?:{to_java(node)})")
    return _by_fold(node, text, True) if engine == "fold" else _by_table(node, True)(text)


def register(spark: SparkSession) -> None:
    """SQL functions: text_full_match(text, pattern), text_prefix_match(text, pattern), and the table function
    regex_substrings(text, pattern, max_length) with rows (match, cnt)."""
    from glyphmine.operators.match import substrings

    def by_pattern(prefix: bool):
        @F.arrow_udf("boolean")
        def match(text: pa.Array, pattern: pa.Array) -> pa.Array:
            text, pattern = text.cast(pa.string()), pattern.cast(pa.string())
            out = np.zeros(len(text), dtype=bool)
            blank = pc.or_(text.is_null(), pattern.is_null()).to_numpy(zero_copy_only=False)
            for p in pattern.unique().to_pylist():
                if p is not None:
                    rows = np.flatnonzero(pc.equal(pattern, p).fill_null(False).to_numpy(zero_copy_only=False))
                    out[rows] = run_all(compiled(p), *kn.buffers(text.take(pa.array(rows))), prefix)
            return pa.array(out, mask=blank)

        return match

    spark.udf.register("text_full_match", by_pattern(False))
    spark.udf.register("text_prefix_match", by_pattern(True))

    class RegexSubstrings:
        def eval(self, text: str, pattern: str, max_length: int):
            if text is not None:
                yield from substrings(compiled(pattern), text, max_length)

    spark.udtf.register("regex_substrings", F.udtf(RegexSubstrings, returnType=StructType([StructField("match", StringType()), StructField("cnt", IntegerType())])))
