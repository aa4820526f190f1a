"""The text index against sorting all suffixes, on goldens, odd texts and random ones."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmine import cli
from glyphmine.functions import scalars, show
from glyphmine.operators import global_index, index, match, search
from glyphmine.operators import kernels as kn
from glyphmine.sources import corpus, formats, store


def suffixes(texts: list[bytes]) -> kn.Suffixes:
    return kn.Suffixes(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64))


def common(a: bytes, b: bytes) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def check(texts: list[bytes]) -> None:
    s = suffixes(texts)
    sa, lcp, psi, lf, bwt, inv = s.array(), s.lcp(), s.psi(), s.lf(), s.bwt(), s.inverse()
    for k, t in enumerate(texts):
        rows = slice(s.first[k], s.first[k + 1])
        want = sorted(range(len(t) + 1), key=lambda i: t[i:])
        assert sa[rows].tolist() == want
        assert [want[r] for r in inv[rows].tolist()] == list(range(len(t) + 1))
        assert lcp[rows].tolist() == [common(t[a:], t[b:]) for a, b in zip(want, want[1:])] + [0]
        assert psi[rows][lf[rows]].tolist() == list(range(len(t) + 1))
        raw, eof = np.maximum(bwt[rows] - 1, 0).astype(np.uint8), want.index(0)
        assert kn.inverse_bwt(raw.tobytes(), eof) == t
        ranks = kn.Ranks(raw, eof)
        assert sum(ranks.occ(c, len(t)) for c in range(256)) == len(t)
        for p in {t[i : i + 2] for i in range(min(len(t), 5))} | {b"", b"zz", b"\xff"}:
            at = [r for r, i in enumerate(want) if t[i:].startswith(p)]
            assert (ranks.search(p) or (0, 0)) == ((at[0], at[-1] + 1) if at else (0, 0))


def test_goldens():
    s = suffixes([b"abracadabra"])
    assert "-".join(map(str, s.psi())) == "3-0-6-7-8-9-10-11-5-2-1-4"
    assert bytes(np.maximum(s.bwt() - 1, 0).astype(np.uint8)) == b"ard\0rcaaaabb"
    assert "".join(map(str, s.lcp())) == "014110300020"
    assert "-".join(map(str, suffixes([b"missisippi"]).array())) == "10-9-6-4-1-0-8-7-5-3-2"
    check([b"missisippi", b"mmiissiissiippii"])
    ranks = kn.Ranks(np.frombuffer(b"ard\0rcaaaabb", np.uint8), 3)
    assert "".join(str(ranks.occ(97, i)) for i in range(12)) == "111111234555"
    assert ranks.search(b"bra") == (6, 8) and (ranks.cf(97), ranks.cf(98)) == (1, 6) and ranks.occ(97, -1) == 0
    back = suffixes([b"mmabcacadabbbca"[::-1]])
    ranks = kn.Ranks(np.maximum(back.bwt() - 1, 0).astype(np.uint8), int(np.flatnonzero(back.bwt() == 0)[0]))
    assert ranks.before(0, 16, 97) == (1, 6) and ranks.before(1, 6, 98) == (6, 8) and ranks.occ(98, 6) == 3
    assert ranks.before_range(0, 16, 97, 99) == [(c, *ranks.before(0, 16, c)) for c in (99, 98, 97)]


def test_odd_texts():
    rng = random.Random(5)
    check([b"", b"a", b"\0", b"\0\0\1", b"aaaa" * 40, bytes(range(256)) * 2, b"ab" * 200, bytes(rng.choice(b"ab") for _ in range(400)), "éàü".encode() * 9, b""])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=20) | st.text("ab", max_size=30).map(str.encode), min_size=1, max_size=5))
def test_random_texts(texts):
    check(texts)


def test_index_operators(spark):
    rows = [(1, "abracadabra"), (2, ""), (3, None), (4, "aé\x00b"), (4, "aé\x00b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as rank", "'x' as data")
    ix = index.build_index(df)
    got = {r.doc_id: r for r in ix.collect()}
    assert ix.count() == 4 and got[2].sa == [0] and got[2].lcp == [] and bytes(got[1].bwt) == b"ard\0rcaaaabb"
    assert {r.doc_id: bytes(r.data).decode() for r in index.texts_of(ix).collect()} == {1: "abracadabra", 2: "", 4: "aé\x00b"}
    assert all(r["sorted"] for r in index.is_sorted(ix).collect())
    assert search.interval(ix.where("doc_id = 1"), b"bra").first()[:] == (1, 6, 8, 2)
    assert search.occ(ix.where("doc_id = 1"), 97, 6).first()[:] == (1, 1, 2)
    e = search.extract(ix.where("doc_id = 1"), 6, 4).first()
    assert bytes(e.next) == b"bra" and bytes(e.prev) == b"cada"
    assert search.first_byte(ix.where("doc_id = 1"), 6).first().c == ord("b")
    steps = [r[2:] for r in search.backward_steps(ix.where("doc_id = 1"), b"bra").orderBy("step").collect()]
    assert steps == [(97, 1, 6), (114, 10, 12), (98, 6, 8)]
    assert {r.doc_id: r.cnt for r in search.count(df, "a").collect()} == {1: 5, 4: 1}
    assert {(r.start, r.before, r.after) for r in search.locate(df.where("doc_id = 1"), "ra", 2).collect()} == {(2, "ab", "ca"), (9, "ab", "")}
    assert [r.tail for r in search.tail(df, 1).orderBy("doc_id").collect() if r.doc_id == 4] == ["é", "é"]
    counts = {(r.doc_id, r.c): (r.cnt, r.start) for r in index.symbol_counts(df).collect()}
    assert counts[1, 98] == (2, 5) and counts[4, 0] == (1, 0)
    assert index.symbol_counts(df.where("doc_id = 2"), dense=True).count() == 256
    assert index.build_index(df.limit(0)).count() == 0
    ints = spark.createDataFrame([(1, [300, 5, 300, 5]), (2, []), (3, None)], "doc_id long, a array<long>")
    assert {r.doc_id: r.sa for r in index.int_suffix_arrays(ints, "doc_id", "a").collect()} == {1: [4, 3, 1, 2, 0], 2: [0]}


def test_regex_on_index(spark):
    df = spark.createDataFrame([(1, "mmabcacadabbbca"), (2, "")], "doc_id long, text string")
    ix = index.build_index(df, orientation="reversed")
    got = {r.match: r.cnt for r in match.index_matches(ix, "ab+c").collect()}
    assert got == {"abc": 1, "abbbc": 1}
    assert {r.match: r.cnt for r in match.regex_matches(df, "(a|b)c").collect()} == {r.match: r.cnt for r in match.index_matches(ix, "(a|b)c").collect()}
    assert any(r.truncated for r in match.index_matches(ix, "[a-c]+", max_iterations=3).collect())
    assert match.regex_matches(df, "a*b*", core=True).count() == 0
    shown = {r.shown for r in match.result_text(match.index_matches(ix, "(b|a)c")).collect()}
    assert shown == {"[2 Results] bc", "ac"} or shown == {"[2 Results] ac", "bc"} or shown == {"[2 Results] ac", "[2 Results] bc"}
    post = match.ngram_postings(df)
    assert {r.match for r in match.hybrid_matches(df, "x?abc", postings=post).collect()} == {"abc"}


def test_global_suffix_array(spark):
    rows = [(3, "ba"), (1, "aba"), (2, ""), (9, None), (7, "abaaba")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    joint = b"aba\x01\x01ba\x01abaaba\x01"
    place = {(1, i): i for i in range(4)} | {(2, 0): 4} | {(3, i): 5 + i for i in range(3)} | {(7, i): 8 + i for i in range(7)}
    want = {p: r for r, p in enumerate(sorted(range(len(joint)), key=lambda i: joint[i:]))}
    got = {(r.doc_id, r.pos): r["rank"] for r in global_index.global_suffix_array(df).collect()}
    assert got == {k: want[p] for k, p in place.items()}
    assert bytes(r.c for r in global_index.global_bwt(df).orderBy("rank").collect()) == bytes(joint[p - 1] for p in sorted(range(len(joint)), key=lambda i: joint[i:]))


def test_global_index_of_documents(spark, tmp_path):
    from glyphmine.plans import catalog

    rows = [(3, "ana b\u00e9 ana"), (1, "the same text twice"), (2, ""), (9, None), (7, "the same text twice")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = [(i, t.encode() + b"\1") for i, t in sorted(rows) if t is not None]
    joint = b"".join(t for _, t in docs)
    places = [(i, k) for i, t in docs for k in range(len(t))]
    order = sorted(range(len(joint)), key=lambda i: joint[i:])
    got = {r["rank"]: (r.doc_id, r.pos) for r in catalog.QUERIES["global_suffixes_documents"](spark, str(tmp_path)).collect()}
    assert got == {r: places[p] for r, p in enumerate(order)}
    bwt = catalog.QUERIES["global_bwt_documents"](spark, str(tmp_path)).orderBy("rank").collect()
    assert bytes(r.c for r in bwt) == bytes(joint[p - 1] for p in order)


def test_index_queries_of_documents(spark, tmp_path):
    import re

    from glyphmine.plans import catalog

    rows = [(3, "an abandoned citizen olé " * 3), (1, "beautification of the old garden"), (2, "éolé bcdefghijklmn"), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: catalog.QUERIES[f"{name}_documents"](spark, str(tmp_path)).collect()
    texts = {i: t.encode() for i, t in rows if t}
    order = {i: sorted(range(len(t) + 1), key=lambda p, t=t: t[p:]) for i, t in texts.items()}
    assert {(r.doc_id, r["rank"], r.pos) for r in run("suffix_table")} == {(i, k, p) for i, o in order.items() for k, p in enumerate(o)}
    back = {(i, k, p) for i, t in texts.items() for k, p in enumerate(sorted(range(len(t) + 1), key=lambda p, t=t[::-1]: t[p:]))}
    assert {(r.doc_id, r["rank"], r.pos) for r in run("suffix_table_reversed")} == back
    assert {(r.doc_id, r.pos): r.greater for r in run("suffix_greater_than_whole")} == {(i, p): t[p:] > t for i, t in texts.items() for p in range(len(t))}
    held = {i: [k for k, p in enumerate(order[i]) if t[p:].startswith(b"ol")] for i, t in texts.items()}
    assert {(r.doc_id, r.sp, r.ep, r.cnt) for r in run("interval_search")} == {(i, h[0], h[-1] + 1, len(h)) for i, h in held.items() if h}
    assert {(r.doc_id, r.sp, r.ep) for r in run("backward_search_steps") if r.step == 2} == {(i, h[0], h[-1] + 1) for i, h in held.items() if h}
    assert {r.doc_id: r.occ for r in run("occ_at_rank")} == {i: sum(p > 0 and t[p - 1] == ord("e") for p in order[i][:8]) for i, t in texts.items()}
    assert {r.doc_id: (r.next, r.prev) for r in run("extract_at_rank")} == {i: (t[p : p + 4].hex().upper(), t[max(0, p - 4) : p].hex().upper()) for i, t in texts.items() for p in [order[i][5]]}
    assert {r.doc_id: r.c for r in run("first_byte_at_rank")} == {i: t[order[i][5]] for i, t in texts.items()}
    pieces = {(i, t[a:b].decode()): 0 for i, t in texts.items() for a in range(len(t)) for b in range(a + 1, len(t) + 1) if re.fullmatch(rb"[abe][a-z]*n", t[a:b])}
    for i, m in pieces:
        pieces[i, m] = sum(texts[i].startswith(m.encode(), a) for a in range(len(texts[i])))
    assert {(r.doc_id, r.match): r.cnt for r in run("regex_on_index")} == pieces and any(len(m) > 12 for _, m in pieces)
    assert {r.doc_id: r.bytes for r in run("index_files") if r.kind == "bwt"} == {i: 17 + len(t) for i, t in texts.items()}


def test_scalars(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("missisippi",), ("",), (None,), ("aabaab",)], "t string")
    got = df.select(scalars.suffix_types(F.col("t")).alias("s"), scalars.kmp_borders(F.col("t")).alias("k")).collect()
    assert got[0].s == "LSLLSLSLLLS" and got[1].s == "S" and got[2].s is None
    assert got[3].k == [0, 1, 0, 1, 2, 3] == scalars.borders(b"aabaab") and got[1].k == [] and got[2].k is None
    n = spark.createDataFrame([(0,), (1,), (5,), (-1,), (None,)], "n long").select(scalars.gamma_length(F.col("n")).alias("b"), scalars.pretty_byte(F.col("n")).alias("p")).collect()
    assert [r.b for r in n] == [-1, 1, 5, None, None]
    rng = random.Random(1)
    bits = [True] * 40 + [rng.random() < 0.5 for _ in range(50)] + [False] * 17
    assert scalars.decode_bits(scalars.encode_bits(bits)) == bits and scalars.encode_bits([]) == ""


def test_suffix_types_and_borders_of_long_texts():
    rng = random.Random(4)
    for n in (0, 1, 2, 9, 60):
        t = "".join(rng.choice("abé") for _ in range(n))
        want = "".join("S" if i == n or i < n - 1 and t[i:] < t[i + 1 :] else "L" for i in range(n + 1))
        assert scalars.types_of(t) == want
        assert scalars.borders(t) == [max(b for b in range(k) if t[:b] == t[k - b : k]) for k in range(1, n + 1)]
    assert scalars.types_of("a" * 100_000)[-3:] == "LLS" and scalars.borders("ab" * 50_000)[-1] == 99_998


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_bytes(b"banana ban")
    (tmp_path / "d" / "b").write_bytes(b"an\xe9")
    ix = str(tmp_path / "ix")
    cli.main(["index", str(tmp_path / "d"), ix, "--check", "--whole"], spark)
    assert "in order" in capsys.readouterr().out
    cli.main(["index", str(tmp_path / "d"), ix, "--keep"], spark)
    assert "is there" in capsys.readouterr().out
    s = store.Store(spark, ix)
    ids = {bytes(r.data): r.doc_id for r in s.texts().collect()}
    row = s.read(ids[b"banana ban"], 3).first()
    assert (row.pos, row.c, row.lcp) == (8, ord("b"), 2)
    whole = spark.read.parquet(f"{ix}/whole")
    docs = s.texts()
    assert whole.count() == 15 and global_index.global_count(whole, docs, "an", text_col="data").first()[:] [2] == 4
    f = tmp_path / "x.bwt"
    f.write_bytes(next(bytes(r.content) for r in formats.files(s.document(ids[b"banana ban"])).collect() if r.kind == "bwt"))
    cli.main(["fm", str(f), str(tmp_path / "x.fm")])
    assert formats.read_fm_file((tmp_path / "x.fm").read_bytes()) == formats.psi_of(*formats.read_bwt_file(f.read_bytes()))
    cli.main(["dfa", "a[bc]"])
    cli.main(["dfa", "ab", "--dot"])
    out = capsys.readouterr().out
    assert "-b..c-> 2 (accepts)" in out and 'label="a"' in out
    table = show.suffix_table(index.suffix_rows(spark.createDataFrame([(1, "aba")], "doc_id long, text string")), b"aba")
    assert [x.split()[-1] for x in table.splitlines()] == ["$", "a$", "aba$", "ba$"]


def test_files_of_any_bytes(spark, tmp_path):
    (tmp_path / "latin").write_bytes("naïve café".encode("latin-1"))
    (tmp_path / "wide").write_bytes("ab\xe9cd€".encode())
    (tmp_path / "odd").write_bytes(b"\xff\x01\x80 ok")
    (tmp_path / "nul").write_bytes(b"x\x00y")
    docs = {r.path.rsplit("/", 1)[1]: r for r in corpus.read_files(spark, str(tmp_path), filter_binary=False).collect()}
    assert bytes(docs["latin"].data) == b"na\xefve caf\xe9" and docs["latin"].text == "na\ufffdve caf\ufffd"
    assert bytes(docs["odd"].data) == b"\\f\\1\x80 ok" and bytes(docs["nul"].data) == b"x\\0y" and docs["wide"].text == "abécd€"
    for most, want in ((3, "ab"), (4, "abé"), (8, "abécd"), (9, "abéc" + "d€"), (99, "abécd€")):
        got = {r.path.rsplit("/", 1)[1]: r.text for r in corpus.read_files(spark, str(tmp_path), max_bytes=most, filter_binary=False).collect()}
        assert got["wide"] == want and len(got) == 4, most
    raw = corpus.read_files(spark, str(tmp_path), filter_binary=False, escaped=False)
    built = index.build_index(raw, text_col="data")
    assert {bytes(r.data) for r in index.texts_of(built).collect()} == {(tmp_path / x).read_bytes() for x in ("latin", "wide", "odd", "nul")}
    assert all(r.sorted for r in index.is_sorted(built).collect())
    cli.main(["index", str(tmp_path), str(tmp_path.parent / "ix_of_any"), "--no-filter-binary"], spark)
    assert store.Store(spark, str(tmp_path.parent / "ix_of_any")).index().count() == 4


def test_pieces_and_running_sums(spark):
    rows = [(k, f"g{k % 3}" if k % 7 else None, "x" * (k % 11) if k % 5 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sorted(((r.grp or "", r.start, r.doc_id, r.text) for r in corpus.pieces(df, df.source).collect()))
    want = []
    for g in ("", "g0", "g1", "g2"):
        at = 0
        for i, s, t in rows:
            if (s or "") == g and t is not None:
                want.append((g, at, i, t + "\x01"))
                at += len(t) + 1
    assert got == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab\x00\xff", max_size=30).map(lambda t: t.encode("latin-1")), min_size=1, max_size=5), st.text("ab\x00", max_size=3).map(str.encode))
def test_kernels_on_many_texts(texts, pattern):
    offs = np.r_[0, np.cumsum([len(t) for t in texts])]
    s = kn.Suffixes(np.frombuffer(b"".join(texts), np.uint8), offs)
    bwt = s.bwt()
    eof = np.flatnonzero(bwt == 0) - s.first[:-1]
    raw, own = kn.inverse_bwts(np.maximum(bwt - 1, 0).astype(np.uint8), s.first, eof)
    assert [raw[a:b].tobytes() for a, b in zip(own[:-1], own[1:], strict=True)] == texts
    for k, t in enumerate(texts):
        one = np.maximum(bwt[s.first[k] : s.first[k + 1]] - 1, 0).astype(np.uint8)
        assert kn.search_by_counting(one.tobytes(), int(eof[k]), pattern) == kn.Ranks(one, int(eof[k])).search(pattern)
        ranks = kn.Ranks(one, int(eof[k]))
        for c in (0, 1, 97, 98, 255):
            for r in range(len(one)):
                assert kn.occ_by_counting(one.tobytes(), int(eof[k]), c, r) == (ranks.cf(c), ranks.occ(c, r))
        sa = s.array()[s.first[k] : s.first[k + 1]]
        assert index.in_order(np.frombuffer(t, np.uint8), sa)
        for a in range(len(sa) - 1):
            other = sa.copy()
            other[[a, a + 1]] = other[[a + 1, a]]
            assert not index.in_order(np.frombuffer(t, np.uint8), other)
        assert not index.in_order(np.frombuffer(t, np.uint8), np.zeros_like(sa)) or len(sa) == 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("aé€b𝄞", max_size=12), max_size=5), st.integers(1, 4))
def test_ngrams(texts, n):
    grams, row, cnt = match.ngrams(pa.array(texts, pa.string()), n)
    want = Counter((k, t[i : i + n]) for k, t in enumerate(texts) for i in range(len(t) - n + 1))
    assert Counter(dict(zip(zip(row.tolist(), grams.to_pylist(), strict=True), cnt.tolist(), strict=True))) == want


def test_bounded_search_goes_on_with_the_longest(spark):
    df = spark.createDataFrame([(1, "abcabd abce"), (2, "zzz")], "doc_id long, text string")
    ix = index.build_index(df, orientation="reversed")
    few = match.index_matches(ix, "[a-z]*", max_iterations=4).where("doc_id = 1").collect()
    assert max(r.len for r in few) == 4 and all(r.truncated for r in few)  # one match is followed to its end
    tips = match.index_tips(ix, "[a-z]*", max_iterations=4).where("doc_id = 1").collect()
    assert tips and all(r.ep - r.sp == r.cnt and r.prefix in "abcabd abce" and len(r.prefix) == r.len for r in tips)
    assert match.index_tips(ix, "[a-z]*").count() == 0


def test_sources_and_stores(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_bytes(b"abra\x01cad\xc3\xbf")
    (tmp_path / "d" / "e" / "b.txt").write_bytes(b"second")
    (tmp_path / "d" / "bin").write_bytes(b"x\x00y")
    (tmp_path / "d" / "empty").write_bytes(b"")
    docs = corpus.read_files(spark, str(tmp_path / "d"))
    assert {r.text for r in docs.collect()} == {"abra\\1cad\\f", "second"}
    assert {r.text for r in corpus.read_files(spark, str(tmp_path / "d"), max_bytes=3, filter_binary=False).collect()} == {"abr", "sec", "x\\0y"}
    assert corpus.list_files(spark, str(tmp_path / "d")).count() == 3  # Spark lists no empty files
    two = corpus.read_strings(spark, ["abc", "de"])
    assert {r.grp: r.text for r in corpus.joined(two).collect()} == {0: "abc\x01", 1: "de\x01"}
    assert corpus.joined(two, two.doc_id * 0).first().text == "abc\x01de\x01"
    assert [r.text for r in corpus.cap_total(two, 4).collect()] == ["abc"]
    store.save(two, str(tmp_path / "ix"), buckets=4)
    s = store.Store(spark, str(tmp_path / "ix"))
    assert s.index().count() == 2 and s.document(1).first().n == 2 and s.counts().count() == 5
    for big in (True, False):
        f = {r.kind: bytes(r.content) for r in formats.files(s.document(0), big).collect()}
        bwt, eof = formats.read_bwt_file(f["bwt"], big)
        assert kn.inverse_bwt(bwt, eof) == b"abc" and formats.read_fm_file(f["fm"], big) == [1, 2, 3, 0]
        assert formats.read_ints(f["sa"], big) == [3, 0, 1, 2] and formats.read_ints(f["aux"], big, 8)[97] == 1
    with pytest.raises(ValueError, match="another size"):
        formats.read_bwt_file(b"\0" * 20)


def test_stream(spark, tmp_path):
    from glyphmine.streaming import append

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "abra"), (2, "cad")], "doc_id long, text string").write.parquet(src)
    stream = spark.readStream.schema("doc_id long, text string").parquet(src)
    for _ in range(2):
        append.append_index(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    spark.createDataFrame([(3, "x")], "doc_id long, text string").write.mode("append").parquet(src)
    append.append_index(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_text_index(spark, tmp_path):
    from glyphmine.operators.text_index import TextIndex

    df = spark.createDataFrame([(1, "abracadabra"), (2, "bé ra ra"), (3, "")], "doc_id long, text string")
    for orientation in ("forward", "reversed"):
        ix = TextIndex.build(df, orientation=orientation)
        assert {r.doc_id: r.cnt for r in ix.count("ra").collect()} == {1: 2, 2: 2}
        assert {tuple(r) for r in ix.locate("ra").collect()} == {(1, 2, 4), (1, 9, 11), (2, 4, 6), (2, 7, 9)}
    assert {r.match for r in ix.regex("c.d").collect()} == {"cad"}
    store.save(df, str(tmp_path / "ix"), orientation="reversed", buckets=2)
    assert TextIndex.load(spark, str(tmp_path / "ix")).count("ra").count() == 2
    with pytest.raises(ValueError, match="reversed"):
        TextIndex.build(df).regex("a")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_occurrences_are_counted_within_a_text(spark):
    rows = [(3, "abracadabra"), (3, "banana"), (1, ""), (9, None), (2, "\x00b\x00é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = index.occurrence_rows(df)
    assert "Exchange" not in plan_of(found)
    want = []
    for i, t in rows:
        seen: Counter = Counter()
        raw = None if t is None else t.encode()
        for rank, p in enumerate([] if raw is None else sorted(range(len(raw) + 1), key=lambda k: raw[k:])):
            seen[c := raw[p - 1] if p else None] += 1
            want.append((i, rank, p, c, None if c is None else seen[c]))
    assert sorted(((r.doc_id, r["rank"], r.pos, r.c, r.occ) for r in found.collect()), key=str) == sorted(want, key=str)


def test_greater_than_whole_shuffles_nothing(spark):
    rows = [(3, "banana"), (3, "abab"), (1, ""), (9, None)]
    found = index.greater_than_whole(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert "Exchange" not in plan_of(found)
    want = [(i, p, r, t[p:] > t) for i, t in rows if t for r, p in enumerate(sorted(range(len(t)), key=lambda k: t[k:]))]
    assert sorted((r.doc_id, r.pos, r["rank"], r.greater) for r in found.collect()) == sorted(want)


def test_index_columns_are_worked_out_alone(spark):
    df = spark.createDataFrame([(1, "abracadabra"), (2, ""), (3, None), (4, "é\x00aé")], "doc_id long, text string")
    for how in ("forward", "reversed"):
        whole = {r.doc_id: r for r in index.build_index(df, orientation=how).collect()}
        for c in ("n", "data", "sa", "bwt", "eof", "lcp"):
            assert {r.doc_id: r[c] for r in index.build_index(df, orientation=how, columns=(c,)).collect()} == {i: r[c] for i, r in whole.items()}


@pytest.mark.parametrize("limits", [(), (64, 128, 8), (256, 512, 128)])
def test_global_order_in_ranges(spark, limits):
    """Many ranges and blocks, long repeats that only doubling tells apart, zeros at the end, ids out of order."""
    rng = random.Random(3)
    rows = [(7 * i % 41, bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(40)))) for i in range(41)]
    rows += [(100 + i, b"the same text " * 3) for i in range(12)] + [(-5, b"a" * 400), (7000, b"a" * 300), (8000, None), (9000, b"\0" * 90)]
    docs = [(i, t + b"\1") for i, t in sorted(r for r in rows if r[1] is not None)]
    joint = b"".join(t for _, t in docs)
    places = [(i, k) for i, t in docs for k in range(len(t))]
    df = spark.createDataFrame([(i, t and bytearray(t)) for i, t in rows], "doc_id long, text binary")
    got = sorted((r["rank"], r.doc_id, r.pos, r.c) for r in global_index._sorted(df, "doc_id", "text", *limits).collect())
    assert got == [(r, *places[p], joint[p - 1]) for r, p in enumerate(sorted(range(len(joint)), key=lambda i: joint[i:]))]


def test_search_of_many_indexes_is_that_of_each(spark):
    from glyphmine.functions.automata import dfa
    from glyphmine.functions.regex_ast import parse

    rng = random.Random(8)
    texts = [b"", b"a" * 300, b"\0ab\0", "éab".encode()] + [bytes(rng.choice(b"abc") for _ in range(rng.randrange(200))) for _ in range(12)]
    s = suffixes([t[::-1] for t in texts])
    bwt = s.bwt()
    raw, eof = np.maximum(bwt - 1, 0).astype(np.uint8), np.flatnonzero(bwt == 0) - s.first[:-1]
    for pattern, most in (("a(b|c)*a", 0), ("a+", 0), ("(a|b)c?b", 0), ("[a-c]+", 5)):
        d = dfa(parse(pattern))
        got = {(k, n, a, b) for n, *x in match.search_indexes(raw, s.first, eof, d, most) for k, a, b in zip(*(y.tolist() for y in x))}
        want = {(k, *x) for k in range(len(texts)) for x in match.search_index(kn.Ranks(raw[s.first[k] : s.first[k + 1]], int(eof[k])), d, most, 0, 0)[0]}
        assert got == want and want


def test_an_index_is_built_once_for_its_check(spark, tmp_path):
    from glyphmine.plans import catalog

    spark.createDataFrame([(1, "abab"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.QUERIES["index_is_sorted"](spark, str(tmp_path))
    assert plan_of(found).split("Initial Plan")[0].count("MapInArrow") == 1
    assert {tuple(r) for r in found.collect()} == {(1, False, True), (1, True, False), (2, False, True), (2, True, True)}
    count = catalog.QUERIES["index_literal_count"](spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    assert "lcp" not in count and "sa#" not in count
