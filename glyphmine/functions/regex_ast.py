"""Regular expressions: parser, syntax tree, rewrites and printed forms.

Syntax: literals, ``.``, ``( )``, ``|``, ``* + ?``, ``[...]`` with ranges (and ``[^...]``), ``\\x`` escapes, ``\\w``, ``\\d``.
``^ $ { }`` are literals; there are no captures, back references or lazy quantifiers. ``.`` is everything but the
characters 0 and 1, which end and separate texts. ``unit='char'`` (the default) matches code points, ``unit='byte'``
single bytes of UTF-8. ``words='compat'`` gives ``\\w`` its historical meaning, the range A..z; else it is
letters, digits and underscore. ``dialect='legacy'`` is the small old grammar: atoms a-z, escapes ``\\n``,
``.`` for the characters 40..126, postfix quantifiers, groups and ``|``; white space is skipped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: An atom: alternatives, each a sequence of byte sets.
Options = tuple[tuple[frozenset[int], ...], ...]
_TAIL = frozenset(range(0x80, 0xC0))
_WIDE: Options = (
    (frozenset(range(0xC2, 0xE0)), _TAIL),
    (frozenset([0xE0]), frozenset(range(0xA0, 0xC0)), _TAIL),
    (frozenset(range(0xE1, 0xF0)), _TAIL, _TAIL),
    (frozenset([0xF0]), frozenset(range(0x90, 0xC0)), _TAIL, _TAIL),
    (frozenset(range(0xF1, 0xF4)), _TAIL, _TAIL, _TAIL),
    (frozenset([0xF4]), frozenset(range(0x80, 0x90)), _TAIL, _TAIL),
)
_MOST_WIDE_RANGE = 4096


class RegexSyntaxError(ValueError):
    """A pattern that the grammar doesn't have."""


@dataclass(frozen=True)
class Node:
    """A node of the syntax tree: ``kind`` is atom, cat, alt, star, plus or opt."""

    kind: str
    label: str = ""
    options: Options = ()
    kids: tuple[Node, ...] = field(default=())

    @property
    def nullable(self) -> bool:
        """Does it match the empty string?"""
        if self.kind == "atom":
            return False
        if self.kind in ("star", "opt"):
            return True
        return (all if self.kind == "cat" else any)(k.nullable for k in self.kids)

    def __str__(self) -> str:
        return to_text(self)


def cat(*kids: Node) -> Node:
    return kids[0] if len(kids) == 1 else Node("cat", kids=kids)


def alt(*kids: Node) -> Node:
    return kids[0] if len(kids) == 1 else Node("alt", kids=kids)


def _encoded(c: str, unit: str) -> tuple[frozenset[int], ...]:
    if unit == "byte" and ord(c) < 256:
        return (frozenset([ord(c)]),)
    return tuple(frozenset([b]) for b in c.encode())


def literal(c: str, unit: str = "char") -> Node:
    return Node("atom", c, (_encoded(c, unit),))


def _of_chars(chars: set[str], label: str, unit: str) -> Node:
    narrow = frozenset(ord(c) for c in chars if ord(c) < (256 if unit == "byte" else 128))
    options = ([(narrow,)] if narrow else []) + [_encoded(c, unit) for c in sorted(chars) if ord(c) >= (256 if unit == "byte" else 128)]
    return Node("atom", label, tuple(options))


def any_char(unit: str = "char", line_only: bool = False) -> Node:
    low = 0x20 if line_only else 2
    return Node("atom", ".", ((frozenset(range(low, 256)),),) if unit == "byte" else ((frozenset(range(low, 128)),), *_WIDE))


def _between(a: str, b: str, label: str, unit: str) -> Node:
    return _of_chars({chr(x) for x in range(ord(a), ord(b) + 1)}, label, unit)


class _Parser:
    def __init__(self, pattern: str, dialect: str, words: str, unit: str, line_only: bool) -> None:
        self.s, self.at, self.dialect, self.words, self.unit, self.line_only = pattern, 0, dialect, words, unit, line_only

    def error(self, why: str) -> RegexSyntaxError:
        return RegexSyntaxError(f"{why} at {self.at} of {self.s!r}")

    def peek(self) -> str:
        while self.dialect == "legacy" and self.at < len(self.s) and self.s[self.at].isspace():
            self.at += 1
        return self.s[self.at] if self.at < len(self.s) else ""

    def whole(self) -> Node:
        out = self.alternatives()
        if self.peek():
            raise self.error("unexpected )")
        return out

    def alternatives(self) -> Node:
        kids = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            kids.append(self.sequence())
        return alt(*kids)

    def sequence(self) -> Node:
        kids: list[Node] = []
        while (c := self.peek()) and c not in "|)":
            if c in "*+?":
                raise self.error("nothing to repeat")
            kids.append(self.quantified())
        if not kids:
            raise self.error("empty alternative")
        return cat(*kids)

    def quantified(self) -> Node:
        out = self.atom()
        while (c := self.peek()) and c in "*+?":
            self.at += 1
            out = Node({"*": "star", "+": "plus", "?": "opt"}[c], kids=(out,))
        return out

    def atom(self) -> Node:
        c = self.peek()
        self.at += 1
        if c == "(":
            out = self.alternatives()
            if self.peek() != ")":
                raise self.error("missing )")
            self.at += 1
            return out
        if self.dialect == "legacy":
            if c == "\\":
                e = self.s[self.at : self.at + 1]
                self.at += 1
                if e not in ("n", "t", "r", "f", "b", "\\"):
                    raise self.error("unknown escape")
                return literal({"n": "\n", "t": "\t", "r": "\r", "f": "\f", "b": "\b"}.get(e, e), self.unit)
            if c == ".":
                return _between(chr(40), chr(126), ".", self.unit)
            if "a" <= c <= "z":
                return literal(c, self.unit)
            raise self.error("unknown atom")
        if c == ".":
            return any_char(self.unit, self.line_only)
        if c == "[":
            return self.char_class()
        if c == "\\":
            if self.at >= len(self.s):
                raise self.error("nothing after \\")
            e = self.s[self.at]
            self.at += 1
            if e == "d":
                return _between("0", "9", "[0-9]", self.unit)
            if e == "w":
                if self.words == "compat":
                    return _between("A", "z", "[A-z]", self.unit)
                return _of_chars({chr(x) for x in range(128) if chr(x).isalnum() or x == 95}, "\\w", self.unit)
            return literal(e, self.unit)
        return literal(c, self.unit)

    def char_class(self) -> Node:
        negated = self.s[self.at : self.at + 1] == "^"
        self.at += negated
        chars: list[str] = []
        while True:
            if self.at >= len(self.s):
                raise self.error("missing ]")
            c = self.s[self.at]
            self.at += 1
            if c == "]":
                break
            if c == "\\":
                if self.at >= len(self.s):
                    raise self.error("nothing after \\")
                c = self.s[self.at]
                self.at += 1
                if c in "dw":
                    chars += [chr(x) for x in range(128) if chr(x).isdigit() or c == "w" and (65 <= x <= 122 if self.words == "compat" else chr(x).isalnum() or x == 95)]
                    continue
            elif c == "-":
                if not chars:
                    raise self.error("a range without a start")
                if self.at >= len(self.s) or self.s[self.at] == "]":
                    chars.append("-")
                    continue
                end = self.s[self.at]
                self.at += 1
                if end < chars[-1] or ord(end) - ord(chars[-1]) > _MOST_WIDE_RANGE:
                    raise self.error("a range that isn't one")
                chars += [chr(x) for x in range(ord(chars[-1]) + 1, ord(end) + 1)]
                continue
            chars.append(c)
        if not chars:
            raise self.error("an empty class")
        label = "[" + ("^" if negated else "") + "".join("\\" + c if c in "]\\-^" else c for c in chars) + "]"
        if not negated:
            return _of_chars(set(chars), label, self.unit)
        if self.unit == "byte":
            return Node("atom", label, ((frozenset(range(2, 256)) - {ord(c) for c in chars},),))
        if any(ord(c) > 127 for c in chars):
            raise self.error("a negated class beyond ASCII")
        return Node("atom", label, ((frozenset(range(2, 128)) - {ord(c) for c in chars},), *_WIDE))


def parse(pattern: str, dialect: str = "re2", words: str = "posix", unit: str = "char", line_only: bool = False) -> Node:
    """The tree of a pattern; RegexSyntaxError for an empty one, a dangling quantifier, an empty alternative or an open bracket."""
    if not pattern:
        raise RegexSyntaxError("an empty pattern")
    return _Parser(pattern, dialect, words, unit, line_only).whole()


def postfix(node: Node) -> list[str]:
    """The tree as postfix tokens: operands, ``·`` for concatenation, ``|``, ``*``, ``+``, ``?``."""
    if node.kind == "atom":
        return [node.label]
    if node.kind == "cat":
        return postfix(node.kids[0]) + [t for k in node.kids[1:] for t in [*postfix(k), "·"]]
    if node.kind == "alt":
        return [t for k in node.kids for t in postfix(k)] + ["|"] * (len(node.kids) - 1)
    return [*postfix(node.kids[0]), {"star": "*", "plus": "+", "opt": "?"}[node.kind]]


def from_postfix(text: str, unit: str = "char") -> Node:
    """The tree of a postfix string whose operands are single characters and whose concatenation is ``.`` or ``·``."""
    stack: list[Node] = []
    for c in text:
        if c in ".·|" and len(stack) > 1:
            b, a = stack.pop(), stack.pop()
            kind = "alt" if c == "|" else "cat"
            stack.append(Node(kind, kids=(*(a.kids if a.kind == kind else (a,)), b)))
        elif c in "*+?" and stack:
            stack.append(Node({"*": "star", "+": "plus", "?": "opt"}[c], kids=(stack.pop(),)))
        elif c in ".·|*+?":
            raise RegexSyntaxError(f"too few operands in {text!r}")
        else:
            stack.append(literal(c, unit))
    if len(stack) != 1:
        raise RegexSyntaxError(f"{len(stack)} operands are left in {text!r}")
    return stack[0]


def to_text(node: Node) -> str:
    """A pattern with the tree's language, for ``parse`` with the same arguments."""
    if node.kind == "atom":
        one = len(node.label) == 1 and len(node.options) == 1 and all(len(b) == 1 for b in node.options[0])
        return "\\" + node.label if one and node.label in "()|*+?[]\\." else node.label
    if node.kind == "alt":
        return "|".join(to_text(k) for k in node.kids)
    if node.kind == "cat":
        return "".join(f"({to_text(k)})" if k.kind == "alt" else to_text(k) for k in node.kids)
    inner = to_text(node.kids[0])
    return (inner if node.kids[0].kind == "atom" else f"({inner})") + {"star": "*", "plus": "+", "opt": "?"}[node.kind]


_COLLAPSE = {("star", "star"): "star", ("star", "opt"): "star", ("star", "plus"): "star", ("plus", "star"): "star", ("opt", "star"): "star", ("opt", "plus"): "star", ("plus", "opt"): "star", ("opt", "opt"): "opt", ("plus", "plus"): "plus"}


def rewrite(node: Node) -> Node:
    """Flattened sequences and alternatives and collapsed quantifiers; the language stays the same."""
    kids = tuple(rewrite(k) for k in node.kids)
    if node.kind in ("cat", "alt"):
        flat: list[Node] = []
        for k in kids:
            flat += k.kids if k.kind == node.kind else (k,)
        if node.kind == "alt":
            flat = list(dict.fromkeys(flat))
        return flat[0] if len(flat) == 1 else Node(node.kind, kids=tuple(flat))
    if node.kind in ("star", "plus", "opt") and kids[0].kind in ("star", "plus", "opt"):
        return rewrite(Node(_COLLAPSE[node.kind, kids[0].kind], kids=kids[0].kids))
    return Node(node.kind, node.label, node.options, kids)


def core(node: Node) -> Node | None:
    """The tree without leading and trailing factors that match the empty string; None if nothing is left."""
    node = rewrite(node)
    kids = list(node.kids) if node.kind == "cat" else [node]
    while kids and kids[0].nullable:
        kids.pop(0)
    while kids and kids[-1].nullable:
        kids.pop()
    return cat(*kids) if kids else None


def required_literal(node: Node) -> str:
    """The longest string that every match holds as one piece of single characters ('' if none is sure)."""
    best, run = "", ""
    node = rewrite(node)
    for k in node.kids if node.kind == "cat" else (node,):
        if k.kind == "atom" and len(k.options) == 1 and all(len(b) == 1 for b in k.options[0]) and len(k.label) == 1:
            run += k.label
        elif k.kind == "plus":
            inner = required_literal(k.kids[0])
            best, run = max(best, run, inner, key=len), ""
        else:
            best, run = max(best, run, key=len), ""
    return max(best, run, key=len)


def to_java(node: Node) -> str:
    """A Java and RE2 regular expression of the tree's language over code points (the tree was parsed with ``unit='char'``)."""
    if node.kind == "atom":
        narrow = {b for o in node.options if len(o) == 1 for b in o[0]}
        if set(_WIDE) <= set(node.options):  # all characters beyond ASCII, so it is said what is left out
            return "[^" + "".join(f"\\x{{{b:x}}}" for b in range(128) if b not in narrow) + "]"
        chars = sorted({bytes(next(iter(b)) for b in o).decode() for o in node.options if len(o) > 1} | {chr(b) for b in narrow})
        body = "".join(f"\\x{{{ord(c):x}}}" for c in chars)
        return body if len(chars) == 1 else f"[{body}]"
    if node.kind == "alt":
        return "(?:" + "|".join(to_java(k) for k in node.kids) + ")"
    if node.kind == "cat":
        return "".join(to_java(k) for k in node.kids)
    return f"(?:{to_java(node.kids[0])})" + {"star": "*", "plus": "+", "opt": "?"}[node.kind]
