"""Token blocks, source mixing and the pipeline."""

from __future__ import annotations

import os
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmine.llm import mixing, token_codec
from glyphmine.llm import textkit as tk

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
needs_tokenizer = pytest.mark.skipif(not os.path.exists(token_codec.TOKENIZER), reason="no vocabulary")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3) | st.integers(0, 65535), max_size=40), min_size=1, max_size=6))
def test_blocks_round_trip(lists):
    sizes = np.array([len(x) for x in lists])
    ids = np.array([i for x in lists for i in x], dtype=np.uint16)
    assert [token_codec.decode(b) for b in token_codec.encode(ids, sizes)] == lists


def test_whole_blocks_round_trip():
    rng = np.random.default_rng(3)
    sizes = np.array([1024, 0, 1, 1023, 500, 1024])
    for ids in (rng.integers(0, 50_257, sizes.sum()), rng.zipf(1.2, sizes.sum()) % 50_257, np.zeros(sizes.sum(), int), np.tile(np.arange(7), sizes.sum())[: sizes.sum()]):
        out = token_codec.encode(ids.astype(np.uint16), sizes)
        at = 0
        for b, z in zip(out, sizes, strict=True):
            assert token_codec.decode(b) == ids[at : at + z].tolist()
            at += z
    assert sum(map(len, out)) < 0.2 * 2 * sizes.sum()  # repetition is learned within a block
    # a block doesn't depend on those beside it
    assert token_codec.encode(ids[:1024].astype(np.uint16), sizes[:1]) == out[:1]


def plain_bits(ids: list[int]) -> float:
    """The code length of a block by a model that counts afresh at every id."""
    weights = [row[:] for row in token_codec._START.tolist()]
    prior = token_codec._PRIOR.tolist()
    bits = 0.0
    for i, x in enumerate(ids):
        one = [ids[j] for j in range(1, i) if ids[j - 1] == ids[i - 1]]
        two = [ids[j] for j in range(2, i) if ids[j - 2 : j] == ids[i - 2 : i]] if i >= 2 else []
        w = weights[4 * min(len(one), 3) + min(len(two), 3)]
        p = [(token_codec.ADD * ids[:i].count(x) + prior[x]) / (token_codec.ADD * i + sum(prior)), one.count(x) / max(len(one), 1), two.count(x) / max(len(two), 1)]
        mixed = sum(a * b for a, b in zip(w, p, strict=True))
        bits -= np.log2(mixed / sum(w))
        w[:] = [a + token_codec.MOVE * (a * b / mixed - a) for a, b in zip(w, p, strict=True)]
        w[0] = max(w[0], token_codec.FLOOR)
    return bits


def test_code_lengths_are_those_of_the_plain_model():
    rng = np.random.default_rng(5)
    for ids in (rng.zipf(1.3, 400) % 5000, np.tile(rng.integers(0, 50_000, 60), 7)[:400], rng.integers(0, 3, 300), np.full(200, 65535), rng.integers(0, 65536, 150)):
        block = token_codec.encode(ids.astype(np.uint16), np.array([len(ids)]))[0]
        assert abs(8 * (len(block) - 6) - plain_bits(ids.tolist())) < 64 + 0.01 * len(ids)


def test_counts_are_those_of_all_earlier_ids(monkeypatch):
    rng = np.random.default_rng(6)
    for bits in (1, 3, 7):
        monkeypatch.setattr(token_codec, "PIECE_BITS", bits)
        for n, groups, kinds in ((1, 1, 1), (40, 3, 5), (700, 9, 50), (1000, 1, 65536), (900, 400, 3)):
            g, x = rng.integers(0, groups, n), rng.integers(0, kinds, n)
            before = (g[None, :] == g[:, None]) & (np.arange(n)[None, :] < np.arange(n)[:, None])
            every, equal, less, number = token_codec._counts(g, x)
            assert (every == before.sum(1)).all() and (equal == (before & (x[None, :] == x[:, None])).sum(1)).all() and (less == (before & (x[None, :] < x[:, None])).sum(1)).all()
            assert ((number[None, :] == number[:, None]) == (g[None, :] == g[:, None])).all()


def test_counts_of_blocks_side_by_side():
    """Columns are counted at once, without a slot for each context; what fills a short block changes nothing."""
    rng = np.random.default_rng(8)
    for n, width, groups, kinds in ((1, 3, 2, 2), (33, 5, 4, 6), (300, 4, 20, 9), (1024, 3, 1, 65536), (1024, 2, 65537, 3)):
        g, x = rng.integers(0, groups, (n, width)), rng.integers(0, kinds, (n, width))
        every, equal, less, number = token_codec._counts(g, x)
        for k in range(width):
            before = (g[None, :, k] == g[:, None, k]) & (np.arange(n)[None, :] < np.arange(n)[:, None])
            a, b = x[None, :, k], x[:, None, k]
            assert (every[:, k] == before.sum(1)).all() and (equal[:, k] == (before & (a == b)).sum(1)).all() and (less[:, k] == (before & (a < b)).sum(1)).all()
            assert ((number[None, :, k] == number[:, None, k]) == (g[None, :, k] == g[:, None, k])).all()
        for a, b in zip(token_codec._counts(None, x)[:3], token_codec._counts(np.zeros_like(x), x)[:3], strict=True):
            assert (a == b).all()
    sizes = np.array([0, 1, 31, 32, 33, 511, 512, 513, 1024, 1, 0, 700])
    ids = (rng.zipf(1.2, sizes.sum()) % 65536).astype(np.uint16)
    cuts = np.r_[0, np.cumsum(sizes)]
    assert token_codec.encode(ids, sizes) == [token_codec.encode(ids[a:z], np.array([z - a]))[0] for a, z in zip(cuts, cuts[1:], strict=False)]


def test_blocks_are_those_of_the_first_mixing_coder():
    """Blocks that were written before are read, and those written now are the same."""
    ids = [7, 50000, 7, 50000, 7, 0, 65535, 7, 50000, 7]
    block = bytes.fromhex("0a00f92b757e0ec74c6fb4ff0c1deb774b73c0dfae")
    assert token_codec.encode(np.array(ids, np.uint16), np.array([10])) == [block] and token_codec.decode(block) == ids


@needs_tokenizer
def test_mixing_beats_a_dictionary_coder():
    import zlib

    words = [w + " " for w in "the of and to in model data token block order count share weight mix code text page line".split()]
    rng = random.Random(2)
    ids, _ = token_codec.tokenizer(token_codec.TOKENIZER).ids(pa.array(["".join(rng.choice(words) for _ in range(1500))]))
    ids = ids[:1024]
    assert len(token_codec.encode(ids, np.array([1024]))[0]) < 0.8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9))


def test_damage_is_noticed():
    ids = np.arange(300, dtype=np.uint16)
    block = bytearray(token_codec.encode(ids, np.array([300]))[0])
    block[40] ^= 1
    with pytest.raises(ValueError):
        token_codec.decode(bytes(block))


@needs_tokenizer
def test_words_give_the_tokenizers_ids():
    w = token_codec.tokenizer(token_codec.TOKENIZER)
    rng = random.Random(9)
    pieces = ["a", " ", "  ", "\n", " \n", "é", "ß", "12", "!!", "'s", " ", " ", "\x85", "\x1f", "日本", " word", "<|endoftext|>", "\t"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(800)] + ["", None, "plain words only here"]
    ids, n = w.ids(pa.array(texts, pa.string()))
    at = 0
    for t, k in zip(texts, n.tolist(), strict=True):
        assert ids[at : at + k].tolist() == w.encoding.encode_ordinary(t or ""), repr(t)
        at += k


@needs_tokenizer
def test_pack(spark, clash):
    long = "over and over the long way " * 2000
    rows = [(1, "hello hello hello"), (1, "hello hello hello"), (2, None), (3, ""), (None, "x"), (4, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", *clash, "1 as block", "2 as data", "3 as n_tokens")
    packed = token_codec.pack(df).cache()
    of = token_codec.tokenizer(token_codec.TOKENIZER).encoding.encode_ordinary
    got = defaultdict(list)
    for r in sorted(token_codec.unpack(packed).collect(), key=lambda r: r.block):
        got[r.doc_id] += r.ids
    assert got == {1: of(rows[0][1]) * 2, 2: [], 3: [], None: of("x"), 4: of(long)}
    assert packed.where("doc_id = 4").count() == -(-len(of(long)) // token_codec.BLOCK) and token_codec.pack(df.limit(0)).count() == 0


def test_pivotal_keeps_sums_and_odds():
    rng = random.Random(1)
    for _ in range(200):
        p = [rng.choice([1, mixing.ONE // 3, mixing.ONE // 2, mixing.ONE - 1, rng.randrange(1, mixing.ONE)]) for _ in range(rng.randrange(9))]
        out, held = mixing.pivotal(p, [rng.getrandbits(64) for _ in p])
        assert sum(out) == sum(p) and all(x in (0, mixing.ONE) for k, x in enumerate(out) if k != held)
        assert held < 0 or 0 < out[held] < mixing.ONE
    p, n = [int(x * mixing.ONE) for x in (0.2, 0.7, 0.5, 0.9)], 6000
    hits = np.zeros(4)
    for _ in range(n):
        out, held = mixing.pivotal(p, [rng.getrandbits(64) for _ in p])
        if held >= 0:
            out[held] = mixing.ONE if rng.random() * mixing.ONE < out[held] else 0
        hits += np.array(out) == mixing.ONE
    assert np.abs(hits / n - np.array(p) / mixing.ONE).max() < 0.03


@pytest.mark.parametrize("leaf", [20_000, 7])
def test_copies_meet_the_weights(spark, clash, leaf):
    rng = random.Random(2)
    rows = [(k, "x" * rng.randint(0, 50), rng.choice(["a", "a", "a", "b", None])) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("doc_id", "text", "source", *[c.replace("9 as copies", "9 as leaves") for c in clash], "1 as p", "2 as h", "3 as node", "4 as x", "5 as sure")
    mass, docs = Counter(), Counter(r[2] for r in rows)
    for _, t, s in rows:
        mass[s] += len(t)
    got, again = (Counter(tuple(r) for r in mixing.copies(df.repartition(n), leaf=leaf).collect()) for n in (2, 5))
    assert got == again and sum(got.values()) == 900  # the same however the rows lie
    for s in docs:
        want = docs[s] * (max(mass.values()) / mass[s]) ** (1 - mixing.POWER)
        assert abs(sum(c for _, x, c in got if x == s) - want) < 1.001
    assert min(c for *_, c in got) >= 1
    w = mixing.copies(df, weights={"a": 1.0, "b": 3.0}, budget_bytes=4000.0, leaf=leaf).collect()
    for s, share in (("a", 1000), ("b", 3000), (None, 0)):
        assert abs(sum(r.copies for r in w if r.source == s) - docs[s] * share / mass[s]) < 1.001


def plain_rounding(units: list[tuple[int, int, int]], share: Fraction, leaves: int, seed: int) -> dict[int, int]:
    """Copies beyond the sure ones of (id, hash, leaf) units that have ``share`` each: the tree's rounding, one fraction at a time."""
    held = {i: share for i, _, _ in units}
    node = {i: leaf for i, _, leaf in units}
    by_hash = {i: h for i, h, _ in units}
    depth, live = 0, [i for i, _, _ in units if 0 < share < 1]
    while True:
        for n in sorted({node[i] for i in live}):
            left = None
            for i in sorted((i for i in live if node[i] == n), key=lambda i: (by_hash[i], i)):
                if left is None:
                    left = i
                    continue
                u = Fraction(tk.mix64_int((by_hash[i] & (2**64 - 1)) ^ (seed + 2 * depth)), 2**64)
                a, b = held[left], held[i]
                if a + b <= 1:
                    win, lose = (left, i) if u < a / (a + b) else (i, left)
                    held[win], held[lose] = a + b, Fraction(0)
                    left = None if a + b == 1 else win
                else:
                    full, rest = (left, i) if u < (1 - b) / (2 - a - b) else (i, left)
                    held[full], held[rest] = Fraction(1), a + b - 1
                    left = rest
            if leaves == 1 and left is not None:
                u = Fraction(tk.mix64_int((by_hash[left] & (2**64 - 1)) ^ (seed + 2 * depth + 1)), 2**64)
                held[left] = Fraction(int(u < held[left]))
        if leaves == 1:
            return {i: int(x) for i, x in held.items()}
        live = [i for i in live if 0 < held[i] < 1]
        node = {i: n // mixing.ARITY for i, n in node.items()}
        leaves, depth = -(-leaves // mixing.ARITY), depth + 1


@pytest.mark.parametrize("leaf", [7, 40, 1000])
def test_copies_are_those_of_plain_rounding(spark, leaf):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, "x" * 10, "a") for k in range(300)] + [(k, "y" * 3, "b") for k in range(300, 500)], "doc_id long, text string, source string")
    for how in ({}, {"weights": {"a": 1.0, "b": 2.0}, "budget_bytes": 2000.0}):
        got = {r.doc_id: r.copies for r in mixing.copies(df, leaf=leaf, **how).collect()}
        want = {}
        x = {r.source: r.x for r in mixing.expected_copies(df, F.col("source"), F.col("text"), **how).collect()}
        for s, ids in (("a", range(300)), ("b", range(300, 500))):
            most = max(1, -(-300 // leaf))
            leaves = max(1, -(-len(ids) // leaf))
            rows = df.where(df.source == s).select("doc_id", F.xxhash64("doc_id", F.lit(mixing.SEED)).alias("h")).select("doc_id", "h", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(leaves)).alias("leaf")).collect()
            share = Fraction(round((x[s] - int(x[s])) * mixing.ONE), mixing.ONE)
            more = plain_rounding([(r.doc_id, r.h, r.leaf) for r in rows], share, most, mixing.SEED)
            want |= {i: int(x[s]) + more[i] for i in ids}
        assert got == want and len(set(got.values())) > 1


def test_resample_on_odd_inputs(spark, clash):
    rows = [(1, "t", "a"), (1, "t", "a"), (None, "u", None), (2, None, "a"), (3, "", "b"), (4, "long " * 50_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("doc_id", "text", "source", *clash, "1 as mix_source", "2 as mix_copies", "3 as mix_copy")
    out = mixing.resample(df)
    n = Counter((r.doc_id, r.source) for r in out.collect())
    drawn = {(r.doc_id, r.source): r.copies for r in mixing.copies(df).collect()}
    assert out.columns == df.columns and n == Counter({k: c * (2 if k == (1, "a") else 1) for k, c in drawn.items()})
    assert mixing.resample(df.limit(0)).count() == 0 and mixing.copies(df.limit(0)).count() == 0


@needs_data
@needs_tokenizer
def test_pipeline(spark):
    import corpus_pipeline as cp
    from glyphmine.llm import decontam, langid, simhash

    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(f(spark, docs, SF).columns == docs.columns for _, f in cp.STAGES[:-1])
    kept = {r.doc_id: r for r in docs.collect()}
    ok = {r.doc_id for r in langid.identify(docs, langid.fit(langid.sample(docs))).collect() if r.accepted}
    one = docs.where(docs.doc_id.isin(list(ok)))
    two = {r.doc_id for r in simhash.groups(one).collect() if r.kept}
    bad = {r.doc_id for r in decontam.contaminated(one, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    blocks = cp.run(spark, SF).collect()
    assert {r.doc_id for r in blocks} == two - bad
    of = token_codec.tokenizer(token_codec.TOKENIZER).encoding.encode_ordinary
    n = Counter()
    for r in blocks:
        n[r.doc_id] += r.n_tokens
    assert all(n[i] % max(1, len(of(kept[i].text))) == 0 and n[i] >= len(of(kept[i].text)) for i in n)


@needs_data
@needs_tokenizer
def test_pipeline_on_odd_documents(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    texts = [r.text for r in docs.collect() if r.text and len(r.text) > 600 and r.lang == "en"]
    mix = lambda a, b: " ".join(texts[a].split()[::2] + texts[b].split()[1::2])
    odd = [(None, mix(0, 1), "en", "new", 1), (70005, mix(2, 3), "en", "new", 1), (70005, mix(4, 5), "en", None, 1), (70006, None, "en", "x", 0), (70007, "", None, "x", 0), (70005, mix(4, 5), "en", None, 1)]
    kinds = dict(docs.dtypes)
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").select(*[cast(c, kinds[c]) for c in docs.columns])
    clash = docs.unionByName(more).selectExpr("*", "1 as near_row_hash", "2 as mix_id", "'z' as root", "4 as h", "array(1) as g", "5 as block")
    clash.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = cp.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert None in ids and 70005 in ids and not ids & {70006, 70007}
    of = token_codec.tokenizer(token_codec.TOKENIZER).encoding.encode_ordinary
    # two other texts share an id and both stay; the row that repeats as a whole is one
    n = sum(r.n_tokens for r in got if r.doc_id == 70005)
    assert n >= len(of(mix(2, 3))) + len(of(mix(4, 5)))


def cast(name: str, kind: str):
    from pyspark.sql import functions as F

    return F.col(name).cast(kind).alias(name)


@needs_data
@needs_tokenizer
def test_pipeline_on_no_documents(spark, tmp_path):
    import corpus_pipeline as cp

    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


@needs_data
def test_queries_agree_with_sql(spark):
    import duckdb

    from glyphmine.llm import queries

    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        got = Counter(tuple(r[c] for c in cols) for r in df.collect())
        db = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels"):
            db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        r = db.execute(sql)
        names = [x[0] for x in r.description]
        assert Counter(tuple(x[names.index(c)] for c in cols) for x in r.fetchall()) == got, name
