"""Personal data by a semi-Markov conditional random field.

A text is words, white space and single other characters. A segmentation covers it with segments: one token that
is nothing (O), or up to ``LONGEST`` tokens of one kind. Its score is the sum of whole-span feature weights
and of transitions between neighbouring kinds, and the best one, boundaries and kinds together, is found by
dynamic programming.

What can be an entity is part of what the kinds mean: it has a digit or '@', or is the value of a word such as 'password' (with a colon
or equals sign between); it is on one line; and if it has spaces, they are single ones between groups of digits or up to four
capitals, 34 letters and digits at most. Every such span is scored, all spans of a chunk of text side by side. A span that can't make any
segmentation better than its tokens as O would, by the largest gain that transitions allow, is in no best segmentation; the program
runs over the spans that are left.

The field is trained by gradient descent on the likelihood of generated sentences whose entities are known.
"""

from __future__ import annotations

import random
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmine.llm import textkit as tk

KINDS = ("O", "EMAIL", "PHONE", "CARD", "IP", "SECRET", "SSN", "IBAN")
#: Tokens of an entity at most; an e-mail address with many parts has the most.
LONGEST = 25
#: Letters and digits of an entity with spaces at most.
SPACED = 34
#: Generated sentences and passes over them.
SENTENCES, PASSES = 1200, 5
SEED = 11
#: Bytes of text that are taken apart at once, and spans that are scored at once; a longer line is taken by itself.
CHUNK, SPANS = 1 << 18, 1 << 15

_HINTS = {
    1: "token key secret apikey credential credentials bearer auth authorization",
    2: "password passwd passphrase pwd pass passwort contraseña",
    3: "card visa mastercard amex credit debit",
    4: "phone call tel telephone mobile fax cell ring",
    5: "ip host address server gateway ping dns",
    6: "mail email contact write",
    7: "ssn social",
    8: "iban account bank transfer",
    9: "version release build v chapter section figure page isbn issn doi",
    10: "commit revision sha checksum md5 sha1 sha256 hash digest uuid etag",
    11: "order invoice ticket item id number no serial",
}
_SKELETONS = 1 << 13

_WORD, _SPACE, _OTHER = 0, 1, 2
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[*b"0123456789_", *string.ascii_letters.encode(), *range(128, 256)]] = _WORD
_CLASS[list(b" \t\n\r\x0b\x0c")] = _SPACE
_KINDS_OF_BYTES = {"digit": b"0123456789", "upper": string.ascii_uppercase.encode(), "lower": string.ascii_lowercase.encode() + bytes(range(128, 256)), "hex": b"0123456789abcdefABCDEF"}
_IS = {k: np.isin(np.arange(256), list(v)) for k, v in _KINDS_OF_BYTES.items()}


class Tokens:
    """The tokens of lines, one after another, with sums over them. ``line``: the line of each; ``begin`` and ``end``: its bytes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        n = len(data)
        cls = _CLASS[data]
        # marks beyond ASCII (quotes, dashes, odd spaces) aren't parts of words
        lead = np.flatnonzero((data == 0xC2) | (data == 0xE2) | (data == 0xE3))
        lead = lead[(lead + 1 < n)]
        wide = lead[(data[lead] != 0xC2) & (lead + 2 < n)]
        wide = wide[np.isin(data[wide + 1], (0x80, 0x81))]
        for at, k in ((lead[data[lead] == 0xC2], 2), (wide, 3)):
            for x in range(k):
                cls[at + x] = _OTHER
        new = np.ones(n, dtype=bool)
        new[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == _OTHER)
        new[offs[:-1][np.diff(offs) > 0]] = True
        new &= (data & 0xC0) != 0x80
        self.data = data
        self.begin = np.flatnonzero(new).astype(np.int32)
        self.end = np.r_[self.begin[1:], n].astype(np.int32)[: len(self.begin)]
        m = len(self.begin)
        self.line = (np.searchsorted(offs, self.begin, side="right") - 1).astype(np.int32)
        cls = cls[self.begin]
        self.first, self.last = data[self.begin], data[self.end - 1]
        self.size = self.end - self.begin
        word = cls == _WORD
        sums = {}
        for k, mask in _IS.items():
            upto = np.r_[0, np.cumsum(mask[data], dtype=np.int32)]
            sums[k] = upto[self.end] - upto[self.begin]
        digit, upper, lower, hexa = (np.where(word, sums[k], 0) for k in ("digit", "upper", "lower", "hex"))
        letters = upper + lower > 0
        # 0 digits, 1 lower case or capitalised, 2 upper case, 3 mixed case, 4 hex, 5 upper case and digits, 6 lower case and digits, 7 all, 8 a space, 9 other white space, 10 and up: a character
        kind = np.where(digit == 0, np.where(lower == 0, 2, np.where(upper <= (_IS["upper"][self.first]), 1, 3)), np.where(~letters, 0, np.where((hexa == self.size) & ((upper == 0) | (lower == 0)), 4, np.where(lower == 0, 5, np.where(upper == 0, 6, 7)))))
        single = (cls == _SPACE) & (self.size == 1) & (self.first == 32)
        kind = np.where(word, kind, np.where(cls == _SPACE, np.where(single, 8, 9), 10 + np.minimum(self.first, 127)))
        self.kind = kind.astype(np.int16)
        self.word, self.single, self.white = word, single, cls == _SPACE
        self.changes = self._changes(data)
        sized = np.where(kind == 0, np.minimum(self.size, 31), np.where(kind < 8, np.minimum((self.size + 1) // 2, 15), 0))
        mark = tk.mix64(np.where(kind < 8, kind, 40 + kind).astype(np.uint64) * np.uint64(64) + sized.astype(np.uint64))
        power, inverse = tk._pow(m + 1)
        self.inverse = inverse
        total = lambda x: np.r_[0, np.cumsum(x, dtype=np.int32)]
        with np.errstate(over="ignore"):
            self.skeleton = np.r_[np.uint64(0), np.cumsum(mark * power[:m], dtype=np.uint64)]
        self.digits, self.uppers, self.lowers = total(digit), total(upper), total(lower)
        self.words, self.digit_words = total(word), total(kind == 0)
        self.hex_words = total(word & (hexa == self.size) & (self.size <= 4))
        octet = np.zeros(m, dtype=np.int64)
        for k in range(3):
            at = np.minimum(self.begin + k, n - 1)
            octet = np.where(k < self.size, octet * 10 + data[at] - 48, octet)
        self.bad_octets = total((kind == 0) & ((self.size > 3) | (octet > 255)))
        self.spaces = total(self.white)
        self.long_letters = total(word & letters & ((self.size > 4) | (lower > 0)))
        self.breaks = total(self.white & ~single)
        self.chars = {c: total(~word & (self.first == ord(c)) & ~self.white) for c in "@.-:/_+()"}
        self.others = total(~word & ~self.white)
        at = np.where(~word & (self.first == 64), np.arange(m), -1)
        self.last_at = np.r_[-1, np.maximum.accumulate(at)] if m else np.array([-1])
        self._hints()
        self.trigger = total((digit > 0) | (~word & (self.first == 64)))
        self.iban = (upper >= 2) & (digit >= 2) & (self.size >= 4) & _IS["upper"][self.first] & _IS["upper"][data[np.minimum(self.begin + 1, n - 1)]] & _IS["digit"][data[np.minimum(self.begin + 2, n - 1)]] & _IS["digit"][data[np.minimum(self.begin + 3, n - 1)]] if m else np.zeros(0, bool)
        self._around()

    def _changes(self, data: np.ndarray) -> np.ndarray:
        """Changes between digits, capitals and small letters within each token."""
        kind = _IS["digit"][data].astype(np.int8) + 2 * _IS["upper"][data].astype(np.int8)
        upto = np.r_[0, np.cumsum(np.r_[False, kind[1:] != kind[:-1]], dtype=np.int32)] if len(data) else np.zeros(1, np.int32)
        return upto[self.end] - upto[np.minimum(self.begin + 1, len(data))]

    def _hints(self) -> None:
        m = len(self.begin)
        at = np.flatnonzero(self.word & (self.size <= 13))
        hint = np.zeros(m, dtype=np.int16)
        if len(at):
            low = np.where(_IS["upper"][self.data], self.data | 32, self.data).astype(np.uint64) + np.uint64(1)
            power, inverse = tk._pow(len(low) + 1)
            upto = np.r_[np.uint64(0), np.cumsum(low * power[: len(low)], dtype=np.uint64)]
            h = tk.mix64((upto[self.end[at]] - upto[self.begin[at]]) * inverse[self.begin[at]])
            k = np.minimum(np.searchsorted(_HINT_HASHES, h), len(_HINT_HASHES) - 1)
            hint[at] = np.where(_HINT_HASHES[k] == h, _HINT_KINDS[k], 0)
        place = np.arange(m)
        last = np.r_[-1, np.maximum.accumulate(np.where(hint > 0, place, -1))][:m] if m else place
        near = (last >= 0) & (place - last <= 6)
        near[near] = self.line[last[near]] == self.line[near]
        self.hint = np.where(near, hint[np.maximum(last, 0)], 0).astype(np.int16)
        # the value of a word such as 'password': after a colon or equals sign, perhaps with spaces and quotes
        skipped = self.single | np.isin(self.first, list(b"\"'`")) & ~self.word
        before = np.r_[-1, np.maximum.accumulate(np.where(~skipped, place, -1))][:m] if m else place
        sign = (before >= 0) & np.isin(self.first[np.maximum(before, 0)], list(b":=")) & ~skipped & ~self.white
        of = before[np.maximum(before, 0)]
        sign &= (of >= 0) & np.isin(hint[np.maximum(of, 0)], (1, 2)) & (place - of <= 7)
        sign[sign] = self.line[of[sign]] == self.line[sign]
        self.value = sign

    def _around(self) -> None:
        """What stands before and after each token, of its line."""
        m = len(self.begin)
        code = np.where(self.word, np.where(np.isin(self.kind, (0, 4, 5, 6, 7)), 2, 1), np.where(self.white, 3, np.minimum(self.first, 127))).astype(np.int32)
        line = np.r_[-1, -1, self.line, -1, -1]
        wide = np.r_[0, 0, code, 0, 0]
        own = line[2:-2]
        one, two = np.where(line[1:-3] == own, wide[1:-3], 0), np.where(line[:-4] == own, wide[:-4], 0)
        self.left = np.where(one == 3, 128 + two, one)
        one, two = np.where(line[3:-1] == own, wide[3:-1], 0), np.where(line[4:] == own, wide[4:], 0)
        self.right = np.where(one == 3, 3, one) + 128 * ((two == 1) | (two == 2)) + 256 * ((one == 3) & (two > 3))
        del m

    def spans(self, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first tokens, end tokens) of all spans that can be an entity, some at a time."""
        m = len(self.begin)
        ahead = np.minimum(np.arange(m) + longest, m)
        start = ~self.white & ((self.trigger[ahead] > self.trigger[:m]) | self.value) if m else np.zeros(0, bool)
        every = np.flatnonzero(start)
        for lo in range(0, len(every), SPANS):
            i = every[lo : lo + SPANS]
            for n in range(1, longest + 1):
                i = i[i + n <= m]
                j = i + n
                last = j - 1
                spaced = self.spaces[j] > self.spaces[i]
                live = (self.line[last] == self.line[i]) & (self.breaks[j] == self.breaks[i])
                live &= ~spaced | (self.long_letters[j] == self.long_letters[i]) & (self.chars["@"][j] == self.chars["@"][i]) & (self.digits[j] - self.digits[i] + self.uppers[j] - self.uppers[i] <= SPACED)
                i, j, last = i[live], j[live], last[live]
                if not len(i):
                    break
                yes = ~self.white[last] & ((self.trigger[j] > self.trigger[i]) | self.value[i])
                if yes.any():
                    yield i[yes], j[yes]

    def features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """(spans, len(_SIZES)): the number of each feature of spans of tokens i..j-1 where they stand."""
        cap = np.minimum
        n, last = j - i, j - 1
        digits, uppers, lowers, spaced = self.digits[j] - self.digits[i], self.uppers[j] - self.uppers[i], self.lowers[j] - self.lowers[i], self.spaces[j] > self.spaces[i]
        words, others, size = self.words[j] - self.words[i], self.others[j] - self.others[i], self.end[last] - self.begin[i]
        count = {c: x[j] - x[i] for c, x in self.chars.items()}
        letters = uppers + lowers > 0
        with np.errstate(over="ignore"):
            shape = tk.mix64((self.skeleton[j] - self.skeleton[i]) * self.inverse[i]) >> np.uint64(51)
        one = n == 1
        kind, end_kind = self.kind[i], self.kind[last]
        at = self.last_at[j]
        domain = np.where(count["@"] > 0, self.chars["."][j] - self.chars["."][np.maximum(at, 0)], 0)
        ending = np.where(np.isin(end_kind, (1, 2, 3)) & (self.size[last] >= 2), 2, end_kind < 8)
        mail = np.where(count["@"] > 0, 1 + ((cap(count["@"], 2) - 1) * 4 + cap(domain, 3)) * 6 + ending * 2 + (kind < 8), 0)
        pure = others == count["."]
        octets = np.where((count["."] > 0) & ~letters & ~spaced, 1 + cap(count["."], 4) * 24 + cap(self.digit_words[j] - self.digit_words[i], 5) * 4 + (self.bad_octets[j] > self.bad_octets[i]) * 2 + pure, 0)
        colons = np.where((count[":"] > 0) & ~spaced, 1 + cap(count[":"], 8) * 4 + (self.hex_words[j] - self.hex_words[i] == words) * 2 + (others == count[":"]), 0)
        kind_of_start, kind_of_end = np.where(kind < 10, kind, 10 + np.isin(self.first[i], list(b"+("))), np.where(end_kind < 10, end_kind, 10 + (self.first[last] == 41))
        columns = [
            cap(digits, 40) * 8 + (lowers > 0) * 4 + (uppers > 0) * 2 + spaced,
            shape.astype(np.int64) & (_SKELETONS - 1),
            mail,
            octets,
            colons,
            self.left[i],
            self.right[last],
            self.hint[i] * 3 + np.where(one, 0, np.where(spaced, 1, 2)),
            np.where(one, 1 + cap(kind, 11) * 32 + np.where(kind == 0, cap(size, 31), cap(size // 2, 31)), 0),
            np.where(~one & ~spaced & letters & (digits > 0) & (count["@"] == 0), 1 + cap(size // 6, 9) * 32 + cap(digits, 7) * 4 + (uppers > 0) * 2 + (lowers > 0), 0),
            np.where(one & (size >= 8), 1 + cap(self.changes[i], 15) * 8 + cap(size // 8, 7), 0),
            np.where(self.iban[i] & (lowers == 0) & (others == 0), 1 + cap(digits + uppers, 40), 0),
            np.where(self.value[i], 1 + np.where(spaced, 0, 1 + self._to_edge(j)) * 8 + cap(size // 4, 7), 0),
            kind_of_start * 12 + kind_of_end,
            (count["("] - count[")"] + 2).clip(0, 4) * 9 + cap(count["-"], 2) * 3 + cap(count["+"], 2),
        ]
        return np.stack(columns, axis=1) + _BASES

    def _to_edge(self, j: np.ndarray) -> np.ndarray:
        """Does white space, a quote, a mark that ends a clause or the end of the line follow?"""
        m = len(self.begin)
        after = np.minimum(j, m - 1)
        out = (j >= m) | (self.line[after] != self.line[j - 1])
        return (out | self.white[after] | np.isin(self.first[after], list(b"\"'`,;)<")) & ~self.word[after]).astype(np.int64)


_SIZES = np.array([41 * 8, _SKELETONS, 64, 128, 64, 256, 512, 40, 12 * 32 + 40, 340, 140, 48, 32, 150, 50])
_BASES = np.r_[0, np.cumsum(_SIZES)[:-1]]
_FEATURES = int(_SIZES.sum())
_pairs = sorted((tk.word_hash(w), k) for k, ws in _HINTS.items() for w in ws.split())
_HINT_HASHES, _HINT_KINDS = np.array([h for h, _ in _pairs], dtype=np.uint64), np.array([k for _, k in _pairs], dtype=np.int16)


@dataclass
class Model:
    """``weights``: (features, kinds but O); ``move``: from kind to kind. O comes before a line and after it."""

    weights: np.ndarray
    move: np.ndarray

    def scores(self, toks: Tokens, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """(spans, kinds but O)."""
        f = toks.features(i, j)
        out = self.weights[f[:, 0]]
        for k in range(1, f.shape[1]):
            out += self.weights[f[:, k]]
        return out

    def candidates(self, toks: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first tokens, end tokens, scores) of the spans that can be in a best segmentation, by first token and end."""
        move = self.move
        most = (move[:, 1:] - move[:, :1]).max(axis=0) + (move[1:] - move[:1]).max(axis=1)
        found: list[tuple] = []
        for i, j in toks.spans():
            for lo in range(0, len(i), SPANS):
                a, b = i[lo : lo + SPANS], j[lo : lo + SPANS]
                s = self.scores(toks, a, b)
                keep = (s - ((b - a - 1) * move[0, 0])[:, None] + most > 0).any(axis=1)
                if keep.any():
                    found.append((a[keep], b[keep], s[keep]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(KINDS) - 1))
        i, j, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((j, i))
        return i[order], j[order], s[order]


def _best(move: np.ndarray, i: list[int], j: list[int], scores: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation of the tokens that spans cover, between O's; ties go to fewer and earlier kinds, then shorter spans."""
    points = sorted({*i, *j})
    at = {p: k for k, p in enumerate(points)}
    ending: list[list[int]] = [[] for _ in points]
    for k, b in enumerate(j):
        ending[at[b]].append(k)
    best = np.full((len(points), len(KINDS)), -np.inf)
    back: list[list] = [[None] * len(KINDS) for _ in points]
    best[0, 0] = 0
    into = [None] * len(points)
    for p in range(len(points)):
        if p:
            run = points[p] - points[p - 1]
            best[p, 0] = into[p - 1][0][0] + (run - 1) * move[0, 0]
            back[p][0] = (p - 1, int(into[p - 1][1][0]))
            for k in sorted(ending[p], key=lambda k: -i[k]):
                q = at[i[k]]
                total = into[q][0][1:] + scores[k]
                for y in np.flatnonzero(total > best[p, 1:]).tolist():
                    best[p, y + 1] = total[y]
                    back[p][y + 1] = (q, int(into[q][1][y + 1]))
        step = best[p][:, None] + move
        into[p] = (step.max(axis=0), step.argmax(axis=0))
    p, y, found = len(points) - 1, int((best[-1] + move[:, 0]).argmax()), []
    while p:
        q, before = back[p][y]
        if y:
            found.append((points[q], points[p], y))
        p, y = q, before
    return found[::-1]


def decode(model: Model, toks: Tokens) -> list[tuple[int, int, int]]:
    """(first token, end token, kind) of the entities of the best segmentation of each line."""
    i, j, s = model.candidates(toks)
    if not len(i):
        return []
    # spans that neither overlap nor touch have an O between them, or a line's end: they don't depend on each other
    reach = np.maximum.accumulate(j)
    fresh = np.r_[True, (i[1:] > reach[:-1]) | (toks.line[i[1:]] != toks.line[i[:-1]])]
    cut = np.r_[np.flatnonzero(fresh), len(i)]
    out: list[tuple[int, int, int]] = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        out += _best(model.move, i[a:b].tolist(), j[a:b].tolist(), s[a:b])
    return out


def _tokens(text: str) -> Tokens:
    """Of one text's lines."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return Tokens(data, _lines(data, np.array([0, len(data)])))


def _lines(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Offsets of the lines of texts."""
    return np.unique(np.r_[offs, np.flatnonzero(data == 10) + 1]) if len(data) else np.array([0, 0])


def _example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated sentence and its entities: (start, stop, kind) in bytes."""
    word = lambda: "".join(rng.choice(["th", "er", "an", "ou", "re", "tion", "de", "é", "sch", "ar", "lo", "ing", "ma", "st"]) for _ in range(rng.randint(1, 4)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    of = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexa, b62 = "0123456789abcdef", string.ascii_letters + string.digits

    def entity() -> tuple[str, int, str]:
        """(text, kind, what may stand before it)"""
        k = rng.choice([1, 1, 1, 2, 2, 2, 3, 3, 4, 4, 4, 5, 5, 5, 5, 6, 7])
        if KINDS[k] == "EMAIL":
            if rng.random() < 0.3:
                label = lambda: word() + rng.choice(["", "", digits(1), "-" + word()])
                local = word() + "".join(rng.choice([".", "-", "+", "_"]) + rng.choice([word(), word(), digits(2)]) for _ in range(rng.randint(1, 3)))
                return f"{local}@{'.'.join(label() for _ in range(rng.randint(1, 3)))}.{rng.choice(['com', 'org', 'de', 'co.uk', 'ac.jp', 'info'])}", k, rng.choice(["", "email ", "mail: ", "contact "])
            return f"{word()}{rng.choice(['.', '_', '', '-', '+'])}{rng.choice([word(), digits(2)])}@{word()}{rng.choice(['', digits(1)])}.{rng.choice(['', word() + '.'])}{rng.choice(['com', 'org', 'net', 'de', 'co.uk'])}", k, rng.choice(["", "", "mail "])
        if KINDS[k] == "PHONE":
            a, b, c = digits(3), digits(3), digits(4)
            national = [f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(3)} {digits(6)}", f"0{digits(4)} {digits(6)}", f"0{digits(3)}/{digits(7)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"{a}.{b}.{c}", f"{digits(3)} {digits(2)} {digits(2)} {digits(2)}"]
            abroad = [f"+{digits(2)} {digits(2)} {digits(4)} {c}", f"+{digits(2)} {digits(3)} {digits(6)}", f"+{digits(2)}{digits(10)}", f"+{digits(2)} {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"+{digits(2)}-{digits(3)}-{digits(7)}"]
            text = rng.choice([f"+{digits(rng.randint(1, 2))} ({a}) {b}-{c}"] * 5 + [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}"] * 2 + abroad * 2 + national)
            return text, k, rng.choice(["", "", "call ", "phone: ", "tel. "]) if text not in national else rng.choice(["call ", "phone: ", "tel. ", "mobile ", "Tel: ", "fax "])
        if KINDS[k] == "CARD":
            g = [digits(4) for _ in range(4)]
            return rng.choice(["".join(g)] * 4 + [" ".join(g), "-".join(g), "3" + digits(14), "3" + digits(3) + " " + digits(6) + " " + digits(5)]), k, rng.choice(["", "", "card ", "visa: "])
        if KINDS[k] == "IP":
            if rng.random() < 0.3:
                group = lambda: of(hexa, rng.randint(1, 4))
                some = lambda least, most: ":".join(group() for _ in range(rng.randint(least, most)))
                text = rng.choice([some(8, 8), f"2001:{some(1, 3)}::{some(1, 3)}", f"fe80::{some(1, 4)}", f"{some(1, 4)}::{some(1, 3)}", f"{some(2, 3)}::{some(2, 3)}"])
                if any(c.isdigit() for c in text):
                    return text, k, rng.choice(["", "host ", "ip ", "address "])
            return ".".join(str(rng.choice([rng.randint(0, 9), rng.randint(0, 255), rng.randint(100, 255)])) for _ in range(4)), k, rng.choice(["", "", "ip ", "host "])
        if KINDS[k] == "SECRET":
            r = rng.random()
            if r < 0.35:
                text = of(hexa, rng.choice([32, 40, 40, 48, 64]))
                return text.upper() if rng.random() < 0.2 else text, k, rng.choice(["", 'token = "', 'key = "', "secret: ", "TOKEN="])
            if r < 0.5:
                return rng.choice(["AKIA", "ASIA", "AGPA"]) + of(string.ascii_uppercase + string.digits, 16), k, rng.choice(["", "key ", "key: "])
            if r < 0.65:
                return rng.choice(["sk-", "pk_live_", "sk-proj-", "ghp_", "xoxb-" + digits(11) + "-", "glpat-", "AIza", "hf_", "npm_"]) + of(b62, rng.randint(20, 40)), k, rng.choice(["", "token ", "key=", "secret: "])
            if r < 0.75:
                return of(b62, rng.randint(24, 44)) + digits(1), k, rng.choice(["key: ", "token = ", 'secret="', "bearer "])
            text = rng.choice([word() + digits(rng.randint(1, 4)), word().capitalize() + digits(2) + rng.choice("!?#$%&*"), word() + rng.choice("_-.!@") + word(), word(), word() + word(), of(b62 + "!#$%&*", rng.randint(8, 16)), of(b62, rng.randint(6, 12))])
            text = text.rstrip("!#$%&*,.;:") or "pass1"
            return text, k, rng.choice(["password: ", "password = ", "pwd=", 'password="', "passwd: ", "Password: ", "passphrase: "])
        if KINDS[k] == "IBAN":
            text = of(string.ascii_uppercase, 2) + digits(2) + rng.choice([digits(rng.randint(11, 24)), of(string.ascii_uppercase, 4) + digits(14), digits(5) + of(string.ascii_uppercase + string.digits, 11) + digits(2)])
            return " ".join(text[x : x + 4] for x in range(0, len(text), 4)) if rng.random() < 0.5 else text, k, rng.choice(["", "IBAN ", "iban: ", "account "])
        return f"{digits(3)}-{digits(2)}-{digits(4)}", k, rng.choice(["", "", "ssn ", "SSN: "])

    def other() -> str:
        return rng.choice([
            f"{rng.randint(1, 9)}.0", f"{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 20)}", f"v{rng.randint(1, 9)}", str(rng.randint(1900, 2030)), digits(rng.randint(1, 6)), digits(rng.randint(7, 9)),
            f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"${digits(2)}.{digits(2)}", f"@{word()}", f"{digits(1)},{digits(3)},{digits(3)}", f"{word()}{digits(2)}", f"{digits(2)}%", f"§{digits(3)}",
            f"{digits(3)}-{digits(3)}", f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/{rng.randint(1990, 2030)}", f"version {rng.randint(1, 9)}", f"{digits(4)}/{digits(3)}", "#" + digits(5), "a @ b", digits(rng.randint(21, 30)), f"{digits(10)} {digits(2)}",
            f"{rng.choice(['version', 'release', 'build'])} {rng.randint(0, 40)}.{rng.randint(0, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}", f"section {rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}",
            f"{rng.choice(['commit', 'revision', 'sha1', 'checksum', 'md5', 'sha256'])}{rng.choice([' ', ': '])}{of(hexa, rng.choice([7, 8, 32, 40, 40, 64]))}", " ".join(digits(rng.randint(1, 6)) for _ in range(rng.randint(2, 8))), " ".join(digits(rng.randint(2, 3)) for _ in range(4)),
            f"{of(hexa, 8)}-{of(hexa, 4)}-{of(hexa, 4)}-{of(hexa, 4)}-{of(hexa, 12)}", f"the password is {word()}", f"token {word()}", f"key: the {word()}", f"ISBN 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"order {digits(rng.randint(6, 12))}", f"invoice {of(string.ascii_uppercase, 2)}{digits(6)}",
            f"CC BY-NC {rng.randint(1, 4)}.0", f"{rng.randint(1, 99)}th", f"{word()}-{digits(1)}", f"{digits(1)}x{digits(1)}", f"{rng.randint(1, 30)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}", f"{of(string.ascii_uppercase, 3)}-{digits(3)}", f"{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(2)}.{digits(3)}.{digits(3)}",
        ])

    parts: list[tuple[str, int]] = []
    for _ in range(rng.randint(2, 6)):
        r = rng.random()
        if r < 0.38:
            value, k, before = entity()
            lead = rng.choice([""] * 5 + ["(", '"']) if not before.endswith(('"', "=")) else ""
            if before.endswith('"'):
                tail = '"'
            else:
                tail = {"(": ")", '"': '"'}.get(lead) or rng.choice([""] * 5 + [".", ",", "!!", "***", "###", "%%%", "&&&", "$$$", ":", ";", "..", ",,"])
                if KINDS[k] == "SECRET" and before.lower().startswith("pass"):
                    tail = rng.choice(["", "", ",", ";"])
            parts += [(before + lead, 0), (value, k), (tail, 0)]
        elif r < 0.72:
            parts.append((other() + rng.choice(["", "", ".", ",", "***", "!!", "&&&", "$$$"]), 0))
        else:
            parts.append((" ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice(["", ".", ",", ":", "***"]), 0))
        parts.append((rng.choice([" "] * 9 + ["\n"]), 0))
    text, marks, at = "", [], 0
    for value, k in parts:
        n = len(value.encode())
        if k:
            marks.append((at, at + n, k))
        text, at = text + value, at + n
    return text, marks


def _gold(toks: Tokens, marks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Entities by tokens instead of bytes."""
    a, b = {x: k for k, x in enumerate(toks.begin.tolist())}, {x: k + 1 for k, x in enumerate(toks.end.tolist())}
    return [(a[x], b[y], k) for x, y, k in marks if x in a and y in b]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _gradient(w: np.ndarray, move: np.ndarray, n: int, i: np.ndarray, j: np.ndarray, f: np.ndarray, gold: list[tuple[int, int, int]]) -> tuple[float, np.ndarray, np.ndarray]:
    """(negative log-likelihood, its gradients by span and kind and by transition) of one sequence of ``n`` tokens."""
    kinds = len(KINDS)
    score = w[f].sum(axis=1)
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        starting[a].append(k)
        ending[b].append(k)
    a, into = np.full((n + 1, kinds), -np.inf), np.full((n + 1, kinds), -np.inf)
    a[0, 0] = 0
    for at in range(n + 1):
        if at:
            a[at, 0] = into[at - 1, 0]
            if ending[at]:
                a[at, 1:] = _lse(into[i[ending[at]], 1:] + score[ending[at]], 0)
        into[at] = _lse(a[at][:, None] + move, 0)
    total = float(into[n, 0])  # an O follows
    # out[at, y]: everything after a segment of kind y that ends at ``at``
    out, after = np.full((n + 1, kinds), -np.inf), np.full((n + 1, kinds), -np.inf)
    out[n] = move[:, 0]
    for at in range(n - 1, -1, -1):
        after[at, 0] = out[at + 1, 0]
        if starting[at]:
            after[at, 1:] = _lse(score[starting[at]] + out[j[starting[at]], 1:], 0)
        out[at] = _lse(move + after[at][None, :], 1)
    by_move = np.exp(a[:n, :, None] + move[None] + after[:n, None, :] - total).sum(axis=0)
    by_move[:, 0] += np.exp(a[n] + move[:, 0] - total)
    by_span = np.exp(into[i, 1:] + score + out[j, 1:] - total)
    index = {(x, y): k for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True))}
    starts = {x: (y, k) for x, y, k in gold}
    prev, at, of_gold = 0, 0, 0.0
    while at < n:
        y, k = starts.get(at, (at + 1, 0))
        by_move[prev, k] -= 1
        of_gold += move[prev, k]
        if k:
            by_span[index[at, y], k - 1] -= 1
            of_gold += score[index[at, y], k - 1]
        prev, at = k, y
    by_move[prev, 0] -= 1
    return total - of_gold - float(move[prev, 0]), by_span, by_move


def train(sentences: int = SENTENCES, passes: int = PASSES, seed: int = SEED) -> Model:
    """The field fitted to generated sentences by AdaGrad on the conditional likelihood; the same for the same arguments."""
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, marks = _example(rng)
        for line, inside in _by_line(text, marks):
            toks = _tokens(line)
            spans = list(toks.spans())
            if spans:
                i, j = (np.concatenate(x) for x in zip(*spans, strict=True))
                can = set(zip(i.tolist(), j.tolist(), strict=True))
                data.append((len(toks.begin), i, j, toks.features(i, j), [g for g in _gold(toks, inside) if g[:2] in can]))
    kinds = len(KINDS)
    w, gw = np.zeros((_FEATURES, kinds - 1)), np.full((_FEATURES, kinds - 1), 1e-2)
    move, gm = np.zeros((kinds, kinds)), np.full((kinds, kinds), 1e-2)
    for _ in range(passes):
        rng.shuffle(data)
        for n, i, j, f, gold in data:
            _, by_span, by_move = _gradient(w, move, n, i, j, f, gold)
            gm += by_move**2
            move -= 0.2 / np.sqrt(gm) * by_move
            much = np.abs(by_span).max(axis=1) > 1e-4
            if much.any():
                rows, back = np.unique(f[much].reshape(-1), return_inverse=True)
                g = np.zeros((len(rows), kinds - 1))
                np.add.at(g, back, np.repeat(by_span[much], f.shape[1], axis=0))
                g += 1e-4 * w[rows]
                gw[rows] += g**2
                w[rows] -= 0.2 / np.sqrt(gw[rows]) * g
    return Model(w, move)


def _by_line(text: str, marks: list[tuple[int, int, int]]) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    at = 0
    for line in text.split("\n"):
        end = at + len(line.encode())
        yield line, [(a - at, b - at, k) for a, b, k in marks if at <= a and b <= end]
        at = end + 1


_cached: dict[tuple[int, int, int], Model] = {}


def model(sentences: int = SENTENCES, passes: int = PASSES, seed: int = SEED) -> Model:
    """``train``, once per process."""
    key = (sentences, passes, seed)
    if key not in _cached:
        _cached[key] = train(*key)
    return _cached[key]


def search(fitted: Model, column: pa.Array) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, start, stop, kind, first byte, end byte) of the entities of whole texts, in order; positions in code points."""
    data, offs = tk.buffers(column)
    lines = _lines(data, offs)
    known = (0, 0)  # a place among all bytes, and the code points before it
    for lo, hi in tk.spans(lines, CHUNK):
        base = int(lines[lo])
        part = data[base : int(lines[hi])]
        if not len(part):
            continue
        toks = Tokens(part, lines[lo : hi + 1] - base)
        found = decode(fitted, toks)
        if not found:
            continue
        points = np.r_[0, np.cumsum((part & 0xC0) != 0x80)] + known[1] + np.count_nonzero((data[known[0] : base] & 0xC0) != 0x80)
        known = (base + len(part), int(points[-1]))
        i, j, k = (np.array(x) for x in zip(*found, strict=True))
        a, b = toks.begin[i].astype(np.int64), toks.end[j - 1].astype(np.int64)
        row = np.searchsorted(offs, a + base, side="right") - 1
        # code points before the row: it may begin in an earlier chunk
        first = offs[row]
        inside = first >= base
        before = np.where(inside, points[np.where(inside, first - base, 0)], 0)
        for r in np.unique(row[~inside]).tolist():
            before[row == r] = int(points[0]) - np.count_nonzero((data[int(offs[r]) : base] & 0xC0) != 0x80)
        yield from zip(row.tolist(), (points[a] - before).tolist(), (points[b] - before).tolist(), k.tolist(), (a + base).tolist(), (b + base).tolist(), strict=True)


def entities(fitted: Model, text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) in characters of the entities of a whole text."""
    return [(a, b, KINDS[k]) for _, a, b, k, _, _ in search(fitted, pa.array([text]))]


def find(df: DataFrame, fitted: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, stop, kind, value) of every entity; positions in code points from 0, ``stop`` exclusive.

    Whole texts are searched. Null and empty texts have none. Repeated rows give theirs as often; null ids are
    carried along; other columns are ignored; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(fitted or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = tk.buffers(batch.column(1))[0]
            rows = [(r, a, b, KINDS[k], data[x:y].tobytes().decode()) for r, a, b, k, x, y in search(shared.value, batch.column(1))]
            k, a, b, kind, value = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kind, pa.string()), pa.array(value, pa.string())], names=["doc_id", "start", "stop", "kind", "value"])
        tk.release()

    rows = tk.small_batches(df).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, start long, stop long, kind string, value string")


def redact(df: DataFrame, fitted: Model | None = None, text_col: str = "text") -> DataFrame:
    """``df`` with every entity of the text replaced by its kind in angle brackets; other columns as they were, nulls stay null."""
    shared = df.sparkSession.sparkContext.broadcast(fitted or model())

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        out = column.to_pylist()
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for r, a, b, k, _, _ in search(shared.value, column):
            pieces.setdefault(r, []).append((a, b, k))
        for r, found in pieces.items():
            text, at, parts = out[r], 0, []
            for a, b, k in found:
                parts += [text[at:a], f"<{KINDS[k]}>"]
                at = b
            out[r] = "".join(parts) + text[at:]
        return pa.array(out, pa.string())

    return df.withColumn(text_col, clean(F.col(f"`{text_col}`").cast("string")))
