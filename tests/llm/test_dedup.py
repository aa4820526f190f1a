"""Line, exact and near deduplication against brute force, and on odd inputs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from glyphmine.llm import components, exact_dedup, line_dedup, simhash
from glyphmine.llm import textkit as tk

LONG = "lorem ipsum dolor " * 20_000


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(["ka", "lo", "mi", "ne", "tu", "ro", "sa", "vi"]) for _ in range(rng.randint(2, 5))) for _ in range(n)]


def test_word_hashes():
    texts = ["Hello, world! hello", "", "été_1 x", "x"]
    data, offs = tk.buffers(pa.array([t.lower() for t in texts]))
    h, row = tk.word_hashes(data, offs)
    assert row.tolist() == [0, 0, 0, 2, 2, 3] and h[0] == h[2] and h[4] == h[5] and h[0] == tk.word_hash("hello")
    assert len(tk.word_hashes(*tk.buffers(pa.array([None, ""], pa.string())))[0]) == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_are_the_votes_of_word_bits():
    texts = [" ".join(words(random.Random(k), 700)) for k in range(3)] + ["", "one"]
    f, has = simhash.fingerprints(*tk.buffers(pa.array(texts)))
    assert has.tolist() == [True, True, True, False, True]
    for k, t in enumerate(texts[:3]):
        h = np.unique(np.array([tk.word_hash(w) for w in set(t.split())], dtype=np.uint64))
        lanes = np.stack([tk.mix64(h + np.uint64(j * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) for j in range(4)], axis=1)
        votes = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        assert (np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64) == f[k]).all()


def near_corpus() -> list[tuple[int, str]]:
    rng = random.Random(11)
    rows = [(k, " ".join(words(rng, rng.randint(60, 200)))) for k in range(80)]
    for k in range(0, 60, 2):
        w = rows[k][1].split()
        for c in range(rng.choice([1, 3])):
            v = list(w)
            for _ in range(max(1, len(w) // 40)):
                v[rng.randrange(len(v))] = "changed" + str(rng.randrange(99))
            rows.append((1000 + 10 * k + c, " ".join(v).capitalize()))
    base = rows[61][1].split()
    for c in range(70):  # more than a bucket's pairs
        v = list(base)
        v[c % len(v)] = f"other{c}"
        rows.append((5000 + c, " ".join(v)))
    rows += [(9000 + c, rows[70][1]) for c in range(30)]
    return rows


def brute_groups(rows: list[tuple[int, str]]) -> dict[int, int]:
    f, has = simhash.fingerprints(*tk.buffers(pa.array([t.lower() for _, t in rows])))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in np.flatnonzero(np.bitwise_count(f[a + 1 :] ^ f[a]).sum(axis=1) <= simhash.RADIUS):
            x, y = find(rows[a][0]), find(rows[a + 1 + b][0])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_near_groups_are_those_of_all_pairs(spark):
    rows = near_corpus()
    want = brute_groups(rows)
    got = {r.doc_id: r.group_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = lambda g: {(a, b) for v in defaultdict(list, {}).values() for a in v for b in v} or {(a, r) for a, r in g.items() if a != r}
    assert len(pairs(got) & pairs(want)) >= 0.9 * len(pairs(want)) > 100
    assert pairs(got) <= pairs(want)  # nothing is joined that all pairs wouldn't
    assert {i: got[i] for i in range(80)} == {i: want[i] for i in range(80)} == {i: i for i in range(80)}
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(got)


def test_wide_segments_find_the_same_groups(spark, monkeypatch):
    rows = near_corpus()
    narrow = {r.doc_id: r.group_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    form = simhash.shape(1 << 24)
    assert form.width == 38 and form.segments >= 8 and len(form.lanes) * 64 >= form.segments * 38 and simhash.shape(1 << 18) == simhash.Shape()
    assert [simhash.shape(n).width for n in (0, 1, 1 << 30, 5 * 10**10)] == [32, 32, 44, 50]
    monkeypatch.setattr(simhash, "shape", lambda n: form)
    wide = {r.doc_id: r.group_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(wide[i] == narrow[i] for i in narrow) >= 0.97 * len(narrow)


def unmet_pairs() -> list[tuple[int, str]]:
    """Pairs of texts (ids 2 k and 2 k + 1) within the radius, of which each of the eight segments differs in three bits or more."""
    rng = random.Random(5)
    rows = []
    while len(rows) < 60:
        base = words(rng, 70)
        other = [[w if rng.random() > 0.05 else "changed" + str(rng.randrange(99)) for w in base] for _ in range(200)]
        f, _ = simhash.fingerprints(*tk.buffers(pa.array([" ".join(w) for w in (base, *other)])))
        d = np.bitwise_count(f.view(np.uint32)[1:] ^ f.view(np.uint32)[0])
        for k in np.flatnonzero((d.min(axis=1) > 2) & (d.sum(axis=1) <= simhash.RADIUS))[:1]:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other[k]))]
    return rows


@pytest.mark.parametrize("least", [10, 1 << 14])
def test_pairs_that_meet_in_no_table_are_found(spark, monkeypatch, least):
    monkeypatch.setattr(simhash, "LEAST_PART", least)
    rows = unmet_pairs()
    want = brute_groups(rows)
    assert all(want[k] == want[k + 1] for k in range(0, len(rows), 2))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in simhash.groups(df).collect()} == want


def test_the_pipeline_drops_pairs_that_meet_in_no_table(spark):
    import corpus_pipeline

    rows = unmet_pairs()
    df = spark.createDataFrame([(*r, "en", "web") for r in rows], "doc_id long, text string, lang string, source string")
    left = corpus_pipeline.near_dedup(spark, df, "")
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(brute_groups(rows).values()))


def test_near_groups_are_those_of_all_pairs_without_exception(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_PART", 50)
    rows = near_corpus()
    assert {r.doc_id: r.group_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute_groups(rows)


@pytest.mark.parametrize("lanes, radius, compared", [(4, 40, 1 << 18), (6, 60, 100), (1, 10, 100), (4, 110, 1 << 18), (2, 3, 1 << 18)])
def test_links_connect_what_all_pairs_would(monkeypatch, lanes, radius, compared):
    monkeypatch.setattr(simhash, "COMPARED", compared)
    rng = np.random.default_rng(lanes)
    base = rng.integers(0, 1 << 63, (30, lanes), dtype=np.uint64)
    bits = np.unpackbits(base[rng.integers(0, 30, 600) // np.r_[np.full(300, 1), np.full(300, 30)]].view(np.uint8), axis=1)
    for row in bits:
        row[rng.choice(64 * lanes, rng.integers(0, radius), replace=False)] ^= 1
    x = np.ascontiguousarray(np.packbits(bits, axis=1).view(np.uint64).T)
    roots = rng.permutation(600) // 2 * 11
    for one, two in ((slice(0, 600), slice(0, 600)), (slice(0, 250), slice(250, 600))):
        near = [(a, b) for a in range(600)[one] for b in np.arange(600)[two][np.bitwise_count(x[:, two] ^ x[:, a : a + 1]).sum(axis=0) <= radius]]
        of = []
        for pairs in ([(roots[a], roots[b]) for a, b in near], simhash.links(x[:, one], roots[one], x[:, two], roots[two], radius).tolist()):
            parts = {r: {r} for r in roots.tolist()}
            for a, b in pairs:
                if parts[int(a)] is not parts[int(b)]:
                    both = parts[int(a)] | parts[int(b)]
                    parts |= dict.fromkeys(both, both)
            of.append({r: min(p) for r, p in parts.items()})
        assert of[0] == of[1] and len(near) > 100


@pytest.mark.parametrize("together", [1, 60, 10_000])
def test_buckets_over_batches(monkeypatch, together):
    monkeypatch.setattr(simhash, "TOGETHER", together)
    rng = random.Random(together)
    rows = [(k, v) for k in range(40) for v in rng.sample(range(1000), rng.choice([1, 2, 3, 5, simhash.PAIRS_UP_TO, simhash.PAIRS_UP_TO + 1, 200]))]
    parts = [rows[i : i + 37] for i in range(0, len(rows), 37)]
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in p]), pa.array([v for _, v in p])], names=["k", "id"]) for p in parts]
    out = [tuple(r.values()) for b in simhash._buckets(iter(batches)) for r in b.to_pylist()]
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    pairs, large = {(a, b) for k, a, b in out if k is None}, defaultdict(list)
    for k, a, _ in out:
        if k is not None:
            large[k].append(a)
    for k, members in by.items():
        if k in large:
            assert sorted(large[k]) == sorted(members)
        else:
            assert {(min(a, b), max(a, b)) for a in members for b in members if a != b} <= pairs
    assert all(k in large for k, members in by.items() if len(members) > simhash.PAIRS_UP_TO)


def test_hot_buckets_are_searched_in_blocks(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, (5, 4), dtype=np.uint64)
    lanes = base[rng.choice(5, 260, p=[0.7, 0.1, 0.1, 0.05, 0.05])].copy()
    for row in lanes:
        for b in rng.integers(0, 256, 22):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    rows = [(7, i, *lanes[i].view(np.int64).tolist()) for i in range(200)] + [(8, i, *lanes[i].view(np.int64).tolist()) for i in range(150, 170)] + [(9, i, *lanes[i].view(np.int64).tolist()) for i in range(200, 260)]
    df = spark.createDataFrame(rows, "k long, id long, f0 long, f1 long, f2 long, f3 long")
    edges = {hot: [tuple(r) for r in simhash._in_buckets(df, 40, ["f0", "f1", "f2", "f3"], hot).collect()] for hot in (16, 1000)}

    def parts(pairs):
        root = list(range(260))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return [find(x) for x in range(260)]

    near = np.bitwise_count(lanes[:, None] ^ lanes[None]).sum(axis=2) <= 40
    same = np.array([[any(lo <= a < hi and lo <= b < hi for lo, hi in ((0, 200), (150, 170), (200, 260))) for b in range(260)] for a in range(260)])
    want = parts(zip(*np.where(near & same), strict=True))
    assert parts(edges[16]) == parts(edges[1000]) == want and 4 < len(set(want)) < 260
    assert all(near[a, b] for e in edges.values() for a, b in e)


def test_search_in_a_large_bucket_gives_the_components_of_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (6, 4), dtype=np.uint64)
    lanes = base[rng.integers(0, 6, 90)].copy()
    for row in lanes:
        for b in rng.integers(0, 256, 25):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    edges = simhash.spanning(np.arange(90), lanes, 40)
    root = list(range(90))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = np.bitwise_count(lanes[:, None] ^ lanes[None]).sum(axis=2) <= 40
    assert all(near[a, b] for a, b in edges)
    for a, b in edges:
        root[find(a)] = find(b)
    one = [find(x) for x in range(90)]
    root = list(range(90))
    for a, b in zip(*np.where(near), strict=True):
        root[find(a)] = find(b)
    two = [find(x) for x in range(90)]
    assert len(set(zip(one, two, strict=True))) == len(set(one)) == len(set(two))


def test_near_on_odd_inputs(spark, clash):
    rows = [(1, "alpha beta gamma delta " * 9), (2, "Alpha, beta gamma DELTA! " * 9), (2, "Alpha, beta gamma DELTA! " * 9), (3, None), (4, ""), (5, ""), (6, "!!! ???"), (None, "alpha beta gamma delta"), (7, LONG), (8, LONG + "."), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", *clash)
    got = sorted(((r.doc_id, r.group_id, r.kept) for r in simhash.groups(df).collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert Counter(got[:2]) == Counter([(None, 1, False), (None, None, True)])
    got = [x for x in got if x[0] is not None]
    assert got == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True), (8, 7, False)]
    left = simhash.drop_near_duplicates(df)
    assert left.columns == df.columns and Counter(r.doc_id for r in left.collect()) == Counter([1, 3, 4, 5, 6, 7, None])
    twice = spark.createDataFrame([(2, "b c d"), (2, "b c d"), (9, "x y z")], "doc_id long, text string")
    assert Counter(r.doc_id for r in simhash.drop_near_duplicates(twice).collect()) == Counter([2, 9])
    other = spark.createDataFrame([(2, "b c d"), (2, "x y z"), (3, "Z, y x"), (2, None), (2, None)], "doc_id long, text string")
    assert Counter(simhash.drop_near_duplicates(other).collect()) == Counter([(2, "b c d"), (2, "x y z"), (2, None), (2, None)])
    assert simhash.groups(df.limit(0)).count() == 0 and simhash.drop_near_duplicates(df.limit(0)).count() == 0


def brute_exact(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t if t is not None else object()].append(i)
    out = []
    for ids in by.values():
        ids.sort(key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), k == 0) for k, i in enumerate(ids)]
    return Counter(out)


@pytest.mark.parametrize("memory", [exact_dedup.MEMORY, 2000])
def test_exact_groups(spark, clash, memory):
    rng = random.Random(4)
    texts = [" ".join(words(rng, rng.randint(0, 30))) for _ in range(60)] + ["", LONG, LONG + " ", "é\x00b"]
    rows = [(rng.randrange(500), rng.choice(texts)) for _ in range(400)] + [(1, None), (1, None), (None, None), (None, ""), (None, texts[3]), (7, LONG), (7, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", *clash)
    assert Counter(tuple(r) for r in exact_dedup.groups(df, memory=memory).collect()) == brute_exact(rows)
    assert exact_dedup.groups(df.limit(0)).count() == 0


def test_spills_are_solved_and_removed(tmp_path):
    from pyarrow import fs

    made = []

    def new_spill():
        s = exact_dedup.Spill(fs.LocalFileSystem(), str(tmp_path / str(len(made))))
        made.append(s)
        return s

    rng = random.Random(5)
    rows = [(k, bytes([rng.randrange(4)]) * rng.randrange(40)) for k in range(900)]
    h = exact_dedup.content_hashes(np.frombuffer(b"".join(c for _, c in rows), np.uint8), np.r_[0, np.cumsum([len(c) for _, c in rows])])
    found = list(exact_dedup.solve(((c, int(x), exact_dedup.Group(i, 1000 - i, i, 0, 2), False) for (i, c), x in zip(rows, h, strict=True)), new_spill, 1500))
    want = defaultdict(set)
    for i, c in rows:
        want[c].add(i)
    links, got = defaultdict(set), [x for x in found if isinstance(x, exact_dedup.Group)]
    for token, first in (x for x in found if not isinstance(x, exact_dedup.Group)):
        links[first].add(token)
    assert sorted(map(sorted, links.values())) == sorted(map(sorted, want.values()))
    assert all((g.n, g.least, g.of) == (2 * len(links[g.token]), 1000 - max(links[g.token]), max(links[g.token])) for g in got) and len(got) == len(want)
    assert len(made) > exact_dedup.FANOUT and not list(tmp_path.iterdir())


def test_equal_hashes_of_other_contents_are_told_apart():
    t = exact_dedup.Table()
    for k, c in enumerate([b"a", b"b", b"a", b"c", b"b"]):
        known, slot = t.find(c, 7)
        if known:
            known.add(k, k, 0, 1)
        else:
            t.put(slot, c, 7, exact_dedup.Group(k, k, k, 0, 1))
    assert [(g.token, g.n) for g in t.groups] == [(0, 2), (1, 2), (3, 1)]


def test_one_hot_content_is_not_held(spark):
    """A third of the rows and more share a text; a token for each task's rows is all that meets in one place."""
    rows = [(k, "the same text" if k % 2 else f"text {k % 50}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert Counter(tuple(r) for r in exact_dedup.groups(df).collect()) == brute_exact(rows)
    table, hot = exact_dedup.Table(), [(b"x", 5, exact_dedup.Group(k, k, k, 0, 1), False) for k in range(1000)]
    out = exact_dedup.solve(iter(hot), None, 10)
    assert [next(out) for _ in range(3)] == [(0, 0), (1, 0), (2, 0)] and table.bytes == 0


def brute_lines(rows, ratio, least):
    import re

    split = lambda h: None if h is None else [x for x in (y.strip(" ") for y in re.split(line_dedup._BREAK, h)) if x]
    host = lambda u: (m.group(1).lower() if u and (m := re.match(line_dedup._HOST, u)) else "")
    total, seen = Counter(host(u) for _, u, _ in rows), Counter()
    for _, u, h in rows:
        seen.update({(host(u), x) for x in split(h) or []})
    out = []
    for i, u, h in rows:
        ls = split(h)
        stay = None if ls is None else [x for x in ls if not (seen[host(u), x] >= least and seen[host(u), x] > ratio * total[host(u)])]
        out.append((i, host(u), len(ls or []), len(ls or []) - len(stay or []), None if stay is None else "\n".join(stay)))
    return Counter(out)


@pytest.mark.parametrize("hot", [1000, 2])  # every host is hot, or none to one
def test_boilerplate(spark, clash, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(6)
    rows = []
    for k in range(120):
        host = rng.choice(["a.com", "A.com", "b.org", "c.net"])
        body = "".join(f"<p>{' '.join(words(rng, 3))}</p>" for _ in range(rng.randrange(4)))
        rows.append((k, f"http://{host}/x{k}", f"<html><script>if (a < b) x('<p>no</p>')</script><nav>Home</nav>{body}<b>tie{'' if k % 10 < 3 else k}</b><!-- c -->\nfoot {host.lower()}"))
    rows += [(900, None, "<p>Home</p>"), (901, "no url", "x\n x \nx"), (902, "http://a.com/", None), (903, "http://a.com/", ""), (904, "http://d.com", LONG), (904, "http://d.com", LONG), (None, "http://d.com", "<p>Home")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("page_id", "url", "html", *clash, "1 as pages", "2 as common", "3 as stay", "4 as line_list")
    got = line_dedup.drop_boilerplate(df)
    assert Counter(tuple(r) for r in got.collect()) == brute_lines(rows, line_dedup.RATIO, line_dedup.LEAST_PAGES)
    assert any(r.n_dropped for r in got.collect()) and line_dedup.drop_boilerplate(df.limit(0)).count() == 0
