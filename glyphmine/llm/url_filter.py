"""Exact membership of URLs in a list by a cascade of Bloom filters.

Level 0 holds the listed keys. Level 1 holds the keys of the corpus that level 0 takes for listed and that aren't,
level 2 the listed keys that level 1 takes for those, and so on until a level has nothing to hold. Walking the
levels until one says no then answers exactly for every key of the corpus, with no join against the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmine.llm import textkit as tk

#: Bits a key and hash functions of a level: about 1 in 120 other keys pass.
BITS_PER_KEY, HASHES = 10, 7
#: Levels at most. A level leaves about one in 120 of the other kind's keys, so only keys with equal 128-bit hashes get here: an error.
DEEPEST = 24
#: A cascade of more bytes than this isn't broadcast: keys and filters are brought together by shard.
BROADCAST_BYTES = 64 << 20
#: Bytes of filter of a shard, and rows that one task asks it about.
SHARD_BYTES, SHARD_ROWS = 8 << 20, 1 << 20
#: Words of a filter that go to the driver as one row.
PACK_WORDS = 1 << 13

#: Domains whose pages the production list holds.
BLOCKED = ("casino-win.example.com", "free-bets.example.com", "cheap-pills.example.com", "ads-track.example.com")


def key_of(url: Column) -> Column:
    """A URL's key: lower case, without scheme, 'www.' or 'm.', fragment and closing slash."""
    out = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    out = F.regexp_replace(out, r"^(www|m)\.", "")
    return F.regexp_replace(F.regexp_replace(out, r"#.*$", ""), r"/$", "")


_KEY_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^(www|m)\.', ''), '#.*$', ''), '/$', '')"


@dataclass
class Cascade:
    """Bits and bit arrays of the levels."""

    bits: list[int] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)


def _positions(a: Column, b: Column, level: int, bits: int) -> Column:
    """The bits of a key at a level, of its two hashes by double hashing."""
    low = F.lit(0xFFFFFFFF)
    first, second = F.xxhash64(a, F.lit(level)).bitwiseAND(low), F.xxhash64(b, F.lit(level)).bitwiseAND(low).bitwiseOR(F.lit(1))
    return F.array(*[F.pmod(first + second * F.lit(i), F.lit(bits)) for i in range(HASHES)])


def _passes(words: np.ndarray, positions: np.ndarray, base: np.ndarray) -> np.ndarray:
    at = positions + base[:, None]
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).all(axis=1)


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, HASHES)


def build(keys: DataFrame, listed: DataFrame, key_col: str = "key") -> DataFrame:
    """(level, shard, bits, word, value): the set words of every level for the keys of a corpus and of a list.

    A null key is in neither. Keys of the list that the corpus lacks are in the cascade as well. An empty list
    gives a cascade of no words, which says no to everything.
    """
    named = keys.select(F.col(key_col).alias("k"), F.lit(0).alias("l")).union(listed.select(F.col(key_col).alias("k"), F.lit(1).alias("l"))).where("k is not null")
    h = named.groupBy("k").agg(F.max("l").alias("l"))
    # what is still in play: (key, hashes, listed); each level keeps those that it can't tell
    play = tk.cut(h.select("k", F.xxhash64("k").alias("a"), F.xxhash64(F.lit("second"), "k").alias("b"), "l"))
    n = play.where("l = 1").count()
    shards = max(-(-n * BITS_PER_KEY // (8 * SHARD_BYTES)), -(-play.count() // SHARD_ROWS)) if n * BITS_PER_KEY > 8 * BROADCAST_BYTES else 1
    levels = []
    for level in range(DEEPEST):
        if not n:
            break
        bits = max(64, -(-n * BITS_PER_KEY // shards // 64) * 64)
        shard = F.pmod(F.xxhash64("a", F.lit("shard")), F.lit(shards))
        own = play.where(F.col("l") == (1 - level % 2)).select(shard.alias("shard"), F.explode(_positions(F.col("a"), F.col("b"), level, bits)).alias("p"))
        words = tk.cut(own.groupBy("shard", F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("value")))
        levels.append(words.select(F.lit(level).alias("level"), "shard", F.lit(bits).cast("long").alias("bits"), "word", "value"))
        other = play.where(F.col("l") == level % 2).withColumn("shard", shard).withColumn("p", _positions(F.col("a"), F.col("b"), level, bits))
        taken = _ask(other, words, shards, bits)
        play = tk.cut(play.where(F.col("l") == (1 - level % 2)).unionByName(taken))
        n = play.where(F.col("l") == level % 2).count()
    if n:
        raise ValueError(f"{n} keys share both hashes with keys of the other kind")
    out = levels[0] if levels else play.limit(0).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("shard"), F.lit(64).cast("long").alias("bits"), F.lit(0).cast("long").alias("word"), F.lit(0).cast("long").alias("value"))
    for part in levels[1:]:
        out = out.unionByName(part)
    return out


def _packed(words: DataFrame) -> DataFrame:
    """(level, block, bits): the words (level, word, value) of filters as binary blocks of ``PACK_WORDS``, put together in tasks."""

    def run(part: pa.Table) -> pa.Table:
        flat = np.zeros(PACK_WORDS, dtype=np.uint64)
        flat[part.column("word").to_numpy() % PACK_WORDS] = part.column("value").to_numpy().view(np.uint64)
        return pa.table({"level": part.column("level").slice(0, 1), "block": part.column("block").slice(0, 1), "bits": pa.array([flat.tobytes()], pa.binary())})

    return words.withColumn("block", F.expr(f"word div {PACK_WORDS}")).select("level", "block", "word", "value").groupBy("level", "block").applyInArrow(run, "level int, block long, bits binary")


def _fill(flat: np.ndarray, block: int, bits: bytes) -> None:
    at = block * PACK_WORDS
    part = np.frombuffer(bits, dtype=np.uint64)[: len(flat) - at]
    flat[at : at + len(part)] = part


def _ask(asked: DataFrame, words: DataFrame, shards: int, bits: int) -> DataFrame:
    """The rows (k, a, b, l) of ``asked`` whose bits at one level are all set."""
    if shards == 1:
        flat = np.zeros(bits // 64, dtype=np.uint64)
        for r in _packed(words.withColumn("level", F.lit(0))).toLocalIterator():
            _fill(flat, r.block, r.bits)
        shared = asked.sparkSession.sparkContext.broadcast(flat)

        @F.arrow_udf("boolean")
        def passes(p: pa.Array) -> pa.Array:
            at = _lists(p)
            return pa.array(_passes(shared.value, at, np.zeros(len(at), np.int64)))

        return asked.where(passes("p")).select("k", "a", "b", "l")

    def run(rows: pa.Table, filt: pa.Table) -> pa.Table:
        flat = np.zeros(bits // 64, dtype=np.uint64)
        flat[filt.column("word").to_numpy()] = filt.column("value").to_numpy().view(np.uint64)
        at = _lists(rows.column("p").combine_chunks())
        return rows.select(["k", "a", "b", "l"]).filter(pa.array(_passes(flat, at, np.zeros(len(at), np.int64))))

    return asked.groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(run, "k string, a long, b long, l int")


def load(cascade: DataFrame) -> Cascade | None:
    """The cascade on the driver, or None if it is too large to broadcast (its size is summed first)."""
    sizes = cascade.groupBy("level").agg(F.max("bits").alias("bits"), F.max("shard").alias("s")).orderBy("level").collect()
    if any(r.s for r in sizes) or sum(r.bits for r in sizes) > 8 * BROADCAST_BYTES:
        return None
    out = Cascade([r.bits for r in sizes], [np.zeros(r.bits // 64, dtype=np.uint64) for r in sizes])
    for r in _packed(cascade).toLocalIterator():
        _fill(out.words[r.level], r.block, r.bits)
    return out


def contains(cascade: Cascade, positions: list[np.ndarray], n: int) -> np.ndarray:
    """Whether each of ``n`` keys is listed, by its bits at each level."""
    listed, alive = np.zeros(n, dtype=bool), np.arange(n)
    for level, words in enumerate(cascade.words):
        alive = alive[_passes(words, positions[level][alive], np.zeros(len(alive), np.int64))] if len(alive) else alive
        listed[alive] = level % 2 == 0  # so far the last level that said yes
    return listed


def mark(df: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", key_col: str = "key") -> DataFrame:
    """(page_id, key, listed) for each row of ``df``: is the key of its URL in ``listed``?

    Exact for every row. A null URL has a null key and isn't listed; an empty one has the key ''. Repeated rows
    are answered as often as they occur; other columns are ignored; an empty table gives no rows, an empty list
    lists nothing.
    """
    rows = df.select(F.col(id_col).alias("page_id"), key_of(F.col(url_col)).alias("key"))
    cascade = tk.cut(build(rows, listed, key_col))
    small = load(cascade)
    if small is None:
        levels = [(r.level, r.bits) for r in cascade.groupBy("level").agg(F.max("bits").alias("bits")).orderBy("level").collect()]
        shards = cascade.agg(F.max("shard")).first()[0] + 1
        at = rows.select("page_id", "key", F.xxhash64("key").alias("a"), F.xxhash64(F.lit("second"), "key").alias("b"))
        at = at.withColumn("shard", F.pmod(F.xxhash64("a", F.lit("shard")), F.lit(shards)))
        # a URL of many pages, or chance, may give a shard more rows than a task should hold: its filter is then there in several parts
        parts = tk.cut(at.where("key is not null").groupBy("shard").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("parts")))
        cascade = cascade.join(parts, "shard").select("level", "shard", "word", "value", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        at = at.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("page_id", "key"), F.col("parts")).cast("int"))
        for level, bits in levels:
            at = at.withColumn(f"p{level}", _positions(F.col("a"), F.col("b"), level, bits))

        def run(pages: pa.Table, filt: pa.Table) -> pa.Table:
            own = Cascade([b for _, b in levels], [np.zeros(b // 64, dtype=np.uint64) for _, b in levels])
            lv, w, v = (filt.column(c).to_numpy() for c in ("level", "word", "value"))
            for level, _ in levels:
                own.words[level][w[lv == level]] = v[lv == level].view(np.uint64)
            yes = contains(own, [_lists(pages.column(f"p{x}").combine_chunks()) for x, _ in levels], pages.num_rows)
            return pages.select(["page_id", "key"]).append_column("listed", pa.array(yes))

        known = at.where("key is not null").groupBy("shard", "part").cogroup(cascade.groupBy("shard", "part")).applyInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, key string, listed boolean")
        # a null key is in no shard
        return known.unionByName(rows.where("key is null").withColumn("listed", F.lit(False)))
    if not small.words:
        return rows.withColumn("listed", F.lit(False))
    shared = df.sparkSession.sparkContext.broadcast(small)
    n_levels = len(small.words)

    @F.arrow_udf("boolean")
    def is_listed(*p: pa.Array) -> pa.Array:
        return pa.array(contains(shared.value, [_lists(x) for x in p], len(p[0])))

    a, b = F.xxhash64("key"), F.xxhash64(F.lit("second"), "key")
    return rows.select("page_id", "key", (F.col("key").isNotNull() & is_listed(*[_positions(a, b, x, small.bits[x]) for x in range(n_levels)])).alias("listed"))


def blocked_keys(df: DataFrame, url_col: str = "url", domains: tuple[str, ...] = BLOCKED) -> DataFrame:
    """(key): the keys of the URLs that are on one of ``domains`` or a subdomain."""
    key = key_of(F.col(url_col))
    host = F.regexp_extract(key, r"^[^/?]*", 0)
    on = F.lit(False)
    for d in domains:
        on = on | (host == d) | host.endswith("." + d)
    return df.where(on).select(key.alias("key")).distinct()


def mark_sql(domains: tuple[str, ...] = BLOCKED) -> str:
    """DuckDB SQL for ``mark`` over ``pages`` and ``blocked_keys``."""
    on = " OR ".join(f"host = '{d}' OR suffix(host, '.{d}')" for d in domains)
    return f"WITH k AS (SELECT page_id, {_KEY_SQL} AS key FROM pages), h AS (SELECT *, regexp_extract(key, '^[^/?]*') AS host FROM k) SELECT page_id, key, coalesce({on}, false) AS listed FROM h"
