"""Personal data, plain and disguised, with offsets into the source text.

Plain identifiers are found by one linear pattern for each kind. Disguised ones are found in a
normalised text: transducers map look-alike letters and digits to ASCII and delete invisible
characters, turn runs of spelled digits into digits, and at/dot disguises into signs. Each
transducer carries, for every character it writes, the span it has read, so a match maps back to
source characters through all of them. Only documents in which one of their triggers occurs are
normalised; triggers are looked for in whole slices of bytes at once.

Defined cases: a null text counts as empty; a disguised identifier that overlaps a plain one of its
kind, or that no transducer has changed, is not added; repeated rows are judged each by itself; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmere.llm.arrow import IS_SPACE, byte_sums, map_arrow, raw, slices, span_hashes, spans

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Letters of other scripts that look like ASCII letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s",
    "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "з": "3", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3", "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "օ": "o", "ո": "n", "ս": "u",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "｡": ".", "·": ".", "․": ".", "∙": ".",
}
#: Digit names in the languages of the corpus.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
PLUS, DOTS, ATS = ("plus", "más"), ("dot", "punto", "punkt", "point"), ("at", "arroba", "arobase")
#: Endings of an address whose at and dot are both bare words.
ENDINGS = frozenset("com org net edu gov mil info biz io co uk de fr es eu ch nl us".split())
#: Digits that a spelled run has at least, so that "one" in prose stays a word.
RUN = 4


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's matches, found from each @ outwards."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _ip(m: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.split("."))


def _digits(m: str) -> str:
    return "".join(c for c in m if c.isdigit())


_CHECKED = {
    "ip": (_IP, _ip),
    "card": (_CARD, lambda m: 13 <= len(d := _digits(m)) <= 19 and _luhn(d)),
    "phone": (_PHONE, lambda m: 9 <= len(_digits(m)) <= 15),
}


def plain(text: str, kinds: tuple[str, ...] = KINDS) -> list[Span]:
    """Spans of identifiers that are not disguised, by kind, then start; matches that fail a check are dropped."""
    out = [("email", a, b) for a, b in _emails(text)] if "email" in kinds else []
    for kind, (pattern, ok) in _CHECKED.items():
        if kind in kinds:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if ok(m[0])]
    return out


@lru_cache(maxsize=1)
def _characters() -> np.ndarray:
    """Code point to ASCII look-alike, itself, or 0 to delete: compatibility forms, digits of all scripts, format characters."""
    table = np.arange(0x110000, dtype=np.uint32)
    for code in range(128, 0x20000):
        c = chr(code)
        if unicodedata.category(c) == "Cf":
            table[code] = 0
            continue
        form, digit = unicodedata.normalize("NFKC", c), unicodedata.digit(c, None)
        if len(form) == 1 and ord(form) < 128:
            table[code] = ord(form)
        elif digit is not None:
            table[code] = 48 + digit
    for c, ascii_ in LOOKALIKES.items():
        table[ord(c)] = ord(ascii_)
    return table


class Mapped:
    """A text with, for each of its characters, the span of source characters it stands for."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, changed: np.ndarray):
        self.text, self.start, self.end, self.changed = text, start, end, changed

    @classmethod
    def of(cls, text: str) -> Mapped:
        n = np.arange(len(text))
        return cls(text, n, n + 1, np.zeros(len(text), bool))

    def characters(self) -> Mapped:
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        to = _characters()[codes]
        keep = to != 0
        joins = np.zeros(len(codes), bool)
        joins[:-1] = ~keep[1:]  # a character before a deleted one has changed
        return Mapped(to[keep].tobytes().decode("utf-32-le", "surrogatepass"), self.start[keep], self.end[keep], (self.changed | (to != codes) | joins)[keep])

    def replaced(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace spans by short texts; each written character stands for the whole span."""
        if not edits:
            return self
        pieces, start, end, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            pieces += [self.text[at:a], new]
            start += [self.start[at:a], np.full(len(new), self.start[a])]
            end += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            changed += [self.changed[at:a], np.ones(len(new), bool)]
            at = b
        rest = slice(at, None)
        return Mapped("".join([*pieces, self.text[at:]]), np.concatenate([*start, self.start[rest]]), np.concatenate([*end, self.end[rest]]), np.concatenate([*changed, self.changed[rest]]))

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


_any = lambda words: "|".join(sorted(words, key=len, reverse=True))
_TOKEN = rf"(?:{_any(DIGITS)}|{_any(DOTS)}|[0-9]{{1,4}})"
_SPELLED = re.compile(rf"(?<![\w@])(?:(?:{_any(PLUS)}|\+)[\s,-]*)?{_TOKEN}(?:[\s,.-]{{1,3}}{_TOKEN}){{{RUN - 1},}}(?![\w@])", re.IGNORECASE)
_WORD = re.compile(rf"{_any(DIGITS)}|{_any(DOTS)}|{_any(PLUS)}|[0-9]+|\+|\.", re.IGNORECASE)
_OPEN, _CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
_AT = rf"(?:\s*{_OPEN}(?:{_any(ATS)}|@){_CLOSE}\s*|\s+(?:{_any(ATS)})\s+|\s*@\s*)"
_DOT = rf"(?:\s*{_OPEN}(?:{_any(DOTS)}|\.){_CLOSE}\s*|\s+(?:{_any(DOTS)})\s+|\.)"
_DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9._%+-]++(?:{_DOT}[A-Za-z0-9_%+-]++)*+)(?P<at>{_AT})(?P<domain>[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++)", re.IGNORECASE
)
_BRACKETED = re.compile(rf"(?<=[0-9])\s*{_OPEN}(?:{_any(DOTS)}|\.){_CLOSE}\s*(?=[0-9])", re.IGNORECASE)
_ONE_DOT, _LAST = re.compile(_DOT, re.IGNORECASE), re.compile(r"[A-Za-z]{2,12}$")


def _spelled(m: Mapped) -> Mapped:
    """Runs of spelled digits become digits, their separators go; a spelled dot between them stays a dot."""
    edits = []
    for run in _SPELLED.finditer(m.text):
        # a literal dot counts where it joins two words, not where it ends a sentence
        words = [w for w in _WORD.finditer(m.text, run.start(), run.end()) if w[0] != "." or not m.text[w.end() : w.end() + 1].isspace()]
        low = [w[0].lower() for w in words]
        if not any(w in DIGITS or w in DOTS for w in low) or sum(1 if w in DIGITS else len(w) * w.isdigit() for w in low) < RUN:
            continue
        last = run.start()
        for w in words:
            low = w[0].lower()
            sign = DIGITS.get(low) or ("." if low in DOTS or low == "." else "+" if low in PLUS else None)
            if last < w.start():
                edits.append((last, w.start(), ""))
            if sign:
                edits.append((w.start(), w.end(), sign))
            last = w.end()
    return m.replaced(edits)


def _dots(m: Mapped) -> Mapped:
    """Dots in brackets between digits become plain dots."""
    return m.replaced([(*found.span(), ".") for found in _BRACKETED.finditer(m.text)])


def _signs(m: Mapped) -> Mapped:
    """At and dot disguises of an address become signs; a bare "at" needs a disguised dot behind it."""
    edits = []
    for found in _DISGUISED.finditer(m.text):
        at, domain = found["at"], found["domain"]
        disguised = any(d[0] != "." for d in _ONE_DOT.finditer(domain))
        last = _LAST.search(domain)
        bare = at.strip().lower() in ATS
        if not last or (bare and not disguised) or (bare and not set("[({<") & set(domain) and last[0].lower() not in ENDINGS) or (at != "@" and "@" in at and at.strip() == "@" and not disguised and " " not in at):
            continue
        begin = found.start("local")
        edits += [(begin + d.start(), begin + d.end(), ".") for d in _ONE_DOT.finditer(found["local"]) if d[0] != "."]
        if at != "@":
            edits.append((*found.span("at"), "@"))
        begin = found.start("domain")
        edits += [(begin + d.start(), begin + d.end(), ".") for d in _ONE_DOT.finditer(domain) if d[0] != "."]
    return m.replaced(edits)


def disguised(text: str, known: list[Span]) -> list[Span]:
    """Spans that only the normalised text shows, in source offsets."""
    found: set[Span] = set()
    letters = Mapped.of(text).characters()
    digits = _spelled(_dots(letters))
    for m in (_signs(digits), _signs(letters), digits):  # chained first: its spans are the widest
        edges = np.concatenate(([0], np.cumsum(m.changed)))
        for kind, a, b in plain(m.text):
            if edges[a] == edges[b]:
                continue
            start, end = m.source(a, b)
            # beside a plain span only one that reaches beyond it, as where a look-alike letter cuts the plain one short
            if all(k != kind or e <= start or end <= s or (start <= s and e <= end and (s, e) != (start, end)) for k, s, e in known) and all(k != kind or e <= start or end <= s for k, s, e in found):
                found.add((kind, start, end))
    return list(found)


@lru_cache(maxsize=1)
def _word_keys() -> tuple[np.ndarray, np.ndarray]:
    def keys(words) -> np.ndarray:
        data, offsets = raw(pa.array(list(words)))
        return np.sort(span_hashes(byte_sums(data), offsets[:-1], offsets[1:]))

    return keys(DIGITS), keys(DOTS + ATS[1:])


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_OPENS = np.zeros(256, bool)
_OPENS[list(b"[({<")] = True
_CLOSES = np.zeros(256, bool)
_CLOSES[list(b"])}>")] = True


def _member(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h


def triggers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: may it hold plain identifiers, and disguised ones?"""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(n, bool), np.zeros(n, bool)

    def has(where: np.ndarray, least: int = 1) -> np.ndarray:
        at = np.searchsorted(where, offsets)
        return np.diff(at) >= least

    digit = (data >= 48) & (data <= 57)
    at = has(np.flatnonzero(data == 64))
    simple = at | has(np.flatnonzero(digit), 4)
    odd = has(np.flatnonzero((data >= 0xC2) & (data != 0xC3)))
    folded = _FOLD[data]
    starts, ends, _ = spans(folded, offsets, _LETTER[folded])
    h = span_hashes(byte_sums(folded), starts, ends)
    names, signs = _word_keys()
    named = _member(h, names)
    run = named[:-2] & named[1:-1] & named[2:] if len(named) > 2 else np.zeros(0, bool)
    bracketed = (ends - starts == 2) & (folded[starts] == 97) & (folded[np.minimum(starts + 1, len(folded) - 1)] == 116)
    near = lambda p, table: table[data[np.clip(p, 0, len(data) - 1)]]
    bracketed &= near(starts - 1, _OPENS) | near(starts - 2, _OPENS) | near(ends, _CLOSES)
    dots = np.flatnonzero(data == 46)
    dots = dots[near(dots - 1, _OPENS) | near(dots - 2, _OPENS) & (near(dots - 1, IS_SPACE))]
    return simple, at | odd | has(dots) | has(starts[: len(run)][run]) | has(starts[_member(h, signs) | bracketed])


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)``: all spans by kind, then start, each with ``base`` true if it is plain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo)
                simple, odd = triggers(*raw(texts))
                out: list[list[tuple]] = [[]] * (hi - lo)
                for i in np.flatnonzero(simple | odd).tolist():
                    text = texts[i].as_py() or ""
                    known = plain(text) if simple[i] else []
                    more = disguised(text, known) if odd[i] else []
                    if known or more:
                        both = [(*s, True) for s in known] + [(*s, False) for s in more]
                        out[i] = [dict(zip(("kind", "start", "end", "base"), s)) for s in sorted(both, key=lambda s: (rank[s[0]], *s[1:]))]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")
