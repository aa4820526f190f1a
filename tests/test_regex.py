"""Regular expressions: printed forms, rewrites, automata, and all engines against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmine.functions import automata as au
from glyphmine.functions import pattern_columns as pc
from glyphmine.functions import regex_ast as ra
from glyphmine.operators import match


@pytest.mark.parametrize(("pattern", "printed"), [("abc", "ab·c·"), ("a(bb)+a", "abb·+·a·"), ("(a|b)", "ab|"), ("((a|b)*aba*)*(a|b)(a|b)", "ab|*a·b·a*·*ab|·ab|·"), ("a|b|c", "abc||"), (r"\d+", "[0-9]+"), ("[a-c]x", "[abc]x·")])
def test_postfix(pattern, printed):
    assert "".join(ra.postfix(ra.parse(pattern))) == printed


@pytest.mark.parametrize("pattern", ["", "*a", "a|", "|a", "(a", "a)", "()", "[abc", "[]", "[-a]", "[z-a]", "a\\", "(|b)"])
def test_syntax_errors(pattern):
    with pytest.raises(ra.RegexSyntaxError):
        ra.parse(pattern)


@pytest.mark.parametrize("pattern", ["a{2}", "^a$", "(a|b)c", "a(bc)d", "a|b*", "[ab]|c", "((a)*)*", "a.*b", r"\w+\.\w", "(a|b)*(c|d)+e?"])
def test_parses(pattern):
    ra.parse(pattern)


def test_full_match_goldens():
    for p, yes, no in [("(a|m)c", ["ac", "mc"], ["Xc", "c"]), ("a*b?c+", ["abc", "bc", "bcc", "aaabc"], ["ab"]), (".*c", ["ac", "Xcasdasdasdc", "c"], ["masdasdsda"]), (".c", ["ac", "Xc", "éc"], ["c"]), ("ab+c", ["abbc", "abc"], ["absbc", "ac"]), ("^a$", ["^a$"], ["a"]), ("a{2}", ["a{2}"], ["aa"])]:
        d, n = au.compile_dfa(p), au.nfa(ra.parse(p))
        for t in yes:
            assert d.matches(t.encode()) and n.matches(t.encode()), (p, t)
        for t in no:
            assert not d.matches(t.encode()) and not n.matches(t.encode()), (p, t)


def test_quirks_that_are_not_kept():
    assert au.compile_dfa(r"\d").matches(b"9")  # the last digit counts
    assert not au.compile_dfa(r"[a-c]").matches(b"d")  # an interval has an upper end
    assert au.compile_dfa(".", unit="byte").matches(b"\xff") and not au.compile_dfa(".").matches(b"\x01")
    assert not au.compile_dfa("(x+)+").matches(b"")  # x+ repeated isn't x*
    assert str(ra.rewrite(ra.parse("(x+)+"))) == "x+"
    assert au.compile_dfa("a*").final[0]  # an accepting start accepts
    assert not au.compile_dfa("a+|b").matches(b"")
    assert au.compile_dfa(r"\w", words="compat").matches(b"^") and not au.compile_dfa(r"\w").matches(b"^")


def test_legacy_dialect():
    assert au.compile_dfa("a b | c", dialect="legacy").matches(b"ab")
    assert au.compile_dfa(".", dialect="legacy").matches(b"(") and not au.compile_dfa(".", dialect="legacy").matches(b" ")
    with pytest.raises(ra.RegexSyntaxError):
        ra.parse("A", dialect="legacy")


def test_cores_and_follows():
    assert str(ra.core(ra.parse("a*(b|a)*bB*cd*e*"))) == "bB*c"
    assert ra.core(ra.parse("a*(b|a)*b?B*c?d*e*")) is None
    p = au.positions(ra.parse("abc(cde)*ef"))
    assert sorted(p.labels[q] for q in p.follow[5]) == ["c", "e"]  # after the loop's last: its first, and what follows it
    p = au.positions(ra.parse("ab?j"))
    assert sorted(p.labels[q] for q in p.follow[0]) == ["b", "j"]
    assert ra.required_literal(ra.parse("x?abc(d|e)fg+")) == "abc"
    assert "".join(ra.postfix(ra.from_postfix("ab.c.d|*"))) == "ab·c·d|*"


def test_buckets_and_dot():
    d = au.compile_dfa("[cdfklm]b*c")
    assert [(chr(a), chr(b)) for a, b, _ in d.buckets()[0]] == [("c", "d"), ("f", "f"), ("k", "m")]
    assert "digraph" in d.dot() and "digraph" in au.dot(ra.parse("a(b|c)*"))
    e = au.from_edges([(0, 97, 1), (1, 98, 2), (2, 98, 2), (2, 99, 3)], {3})
    assert e.matches(b"abbc") and not e.matches(b"ac")


def brute(pattern: str, text: str, most: int = 99) -> dict[str, int]:
    d = au.compile_dfa(pattern)
    out: dict[str, int] = {}
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + most) + 1):
            if d.matches(text[i:j].encode()):
                out[text[i:j]] = out.get(text[i:j], 0) + 1
    return out


def test_substring_goldens():
    assert dict(match.substrings(au.compile_dfa("ab+c"), "mmabcacadabbbca", 0)) == {"abc": 1, "abbbc": 1}
    assert dict(match.substrings(au.compile_dfa("mab"), "mmabcacamabbbca", 0)) == {"mab": 2}
    assert dict(match.substrings(au.compile_dfa("(b|a)c"), "mmabcacamabbbca", 0)) == {"bc": 2, "ac": 1}
    assert dict(match.substrings(au.core_dfa(ra.parse(".*(a|b)ca")), "mmabcacamabbbca", 0)) == {"bca": 2, "aca": 1}
    assert dict(match.substrings(au.core_dfa(ra.parse("(a|ab)")), "abab", 0)) == {"a": 2, "ab": 2}


patterns = st.recursive(st.sampled_from(["a", "b", "é", ".", "[ab]", "[^a]", r"\.", r"\[", r"[\]a]", r"[a\-b]", r"[^\\b]", r"\*", r"\d", r"\w"]), lambda x: st.one_of(st.tuples(x, x).map(lambda t: t[0] + t[1]), st.tuples(x, x).map(lambda t: f"({t[0]}|{t[1]})"), x.map(lambda t: f"({t})*"), x.map(lambda t: f"({t})+"), x.map(lambda t: f"({t})?")), max_leaves=6)


@settings(max_examples=120, deadline=None)
@given(patterns, st.text("abé\n.]-*[3", max_size=8), st.booleans())
def test_engines_agree(pattern, text, line_only):
    node = ra.parse(pattern, line_only=line_only)
    assert au.dfa(ra.parse(str(node), line_only=line_only)).matches(text.encode()) == au.dfa(node).matches(text.encode())
    pattern = str(node) if not line_only else pattern
    java = ra.to_java(node).replace("\\x{", "\\u{")
    python = re.compile(re.sub(r"\\u\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", java), re.S)
    want = python.fullmatch(text) is not None
    d = au.dfa(node)
    assert d.matches(text.encode()) == au.nfa(node).matches(text.encode()) == want
    assert au.dfa(ra.rewrite(node)).matches(text.encode()) == want
    assert au.dfa(ra.parse(str(ra.rewrite(node)), line_only=line_only)).matches(text.encode()) == want
    raw = np.frombuffer((text * 2).encode(), np.uint8)
    offs = np.array([0, len(text.encode()), 2 * len(text.encode())])
    assert pc.run_all(d, raw, offs).tolist() == [want, want]
    assert pc.run_all(d, raw, offs, True)[0] == any(d.matches(text[:k].encode()) for k in range(len(text) + 1))
    if not line_only:
        assert dict(match.substrings(d, text, 4)) == brute(pattern, text, 4)


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.sampled_from(["a", "z", ".", r"\n", r"\\"]), lambda x: st.one_of(st.tuples(x, x).map(lambda t: t[0] + t[1]), x.map(lambda t: f"({t})*")), max_leaves=4), st.text("az \n\\\x7f", max_size=4))
def test_legacy_engines_agree(pattern, text):
    node = ra.parse(pattern, dialect="legacy")
    python = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", ra.to_java(node)), re.S)
    assert au.dfa(node).matches(text.encode()) == au.nfa(node).matches(text.encode()) == (python.fullmatch(text) is not None)


def test_default_engine(spark):
    from pyspark.sql import functions as F

    texts = ["abc", "a.c", "a\nc", "a c", "a]c", "a-c", "aéc", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for pattern, how in ((r"a\.c", {}), ("a.c", {}), ("a.c", {"line_only": True}), ("a.c", {"dialect": "legacy"}), (r"a[\]\-]c", {}), (r"a[^\]b]c", {}), (r"a\.?c*", {})):
        rows = df.select("text", *[pc.full_match(F.col("text"), pattern, engine=e, **how).alias(e) for e in ("auto", "java", "dfa", "fold")], pc.prefix_match(F.col("text"), pattern, **how).alias("p"), pc.prefix_match(F.col("text"), pattern, engine="dfa", **how).alias("q")).collect()
        assert all(r.auto == r.java == r.dfa == r.fold and r.p == r.q for r in rows), (pattern, how)
    got = df.select("text", pc.full_match(F.col("text"), r"a\.c").alias("x"), pc.full_match(F.col("text"), "a.c", line_only=True).alias("y"), pc.full_match(F.col("text"), "a.c", dialect="legacy").alias("z")).collect()
    assert [r.text for r in got if r.x] == ["a.c"] and [r.text for r in got if r.y] == ["abc", "a.c", "a c", "a]c", "a-c", "aéc"] and [r.text for r in got if r.z] == ["abc", "a.c", "a]c", "a-c"]


def test_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "abbc"), (2, "ac\n"), (3, None), (4, ""), (5, "abé")], "id int, text string")
    for engine in ("java", "dfa", "fold"):
        got = df.select("id", pc.full_match(F.col("text"), "ab*(c|é)", engine=engine).alias("m"), pc.prefix_match(F.col("text"), "ab?", engine=engine).alias("p")).orderBy("id").collect()
        assert [(r.m, r.p) for r in got] == [(True, True), (False, True), (None, None), (False, False), (True, True)], engine


def test_sql_functions(spark):
    pc.register(spark)
    many = spark.sql("select t, p, text_full_match(t, p) as m from values ('abbc', 'ab*c'), ('x', 'ab*c'), ('a.c', 'a[.]c'), (null, 'a'), ('a', null) as v(t, p)").collect()
    assert [r.m for r in many] == [True, False, True, None, None]
    assert spark.sql("select text_full_match('abbc', 'ab*c'), text_prefix_match('xyz', 'xy'), text_full_match(null, 'a')").first()[:] == (True, True, None)
    rows = spark.sql("select * from regex_substrings('mmabcacadabbbca', 'ab+c', 0)").collect()
    assert {r[0]: r[1] for r in rows} == {"abc": 1, "abbbc": 1}
