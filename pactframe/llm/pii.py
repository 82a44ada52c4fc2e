"""Personal data in whole texts: plain identifiers, and disguised ones found in a normalised text.

Spans are code points of the source text, ends exclusive.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pactframe.llm.common import as_map

KINDS = ("email", "ip", "card", "phone")

# The plain identifiers' patterns; possessive, so that long runs take linear time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def emails(text: str) -> list[tuple[int, int]]:
    """Looks from each @ to both sides, so that runs without one cost nothing."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append((begin, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base identifiers of a text by kind, leftmost and non-overlapping per kind."""
    out: dict[str, list[tuple[int, int]]] = {"email": emails(text), "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out["phone"].append(m.span())
    return out


# Letters of other scripts and full-width forms that look like ASCII characters.
_LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "․": ".", "。": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-",
    " ": " ", " ": " ", " ": " ",
}
_LOOKALIKES |= {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
for _zero in (0x0660, 0x06F0, 0x0966):
    _LOOKALIKES |= {chr(_zero + d): str(d) for d in range(10)}
_INVISIBLE = "​‌‍⁠﻿­"
_ODD = re.compile(f"[{re.escape(''.join(_LOOKALIKES))}{_INVISIBLE}]")

# Digits spelled out in English, German, French and Spanish, and words for the signs of an address.
_NAMES = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_AT = ("at", "arroba", "arobase", "klammeraffe")
_DOT = ("dot", "punkt", "punto", "point")
_PLUS = ("plus", "más")


def _either(words) -> str:
    """A pattern for any of some words, as a tree of their letters: a position is refused after a look at one letter."""
    tails: dict[str, list[str]] = {}
    for w in words:
        if w:
            tails.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(re.escape(c) + (_either(t) + ("?" if "" in t else "") if any(t) else "") for c, t in tails.items()) + ")"


_DIGIT_WORD = _either(_NAMES)
_AT_WORD, _DOT_WORD, _PLUS_WORD = "|".join(_AT), "|".join(_DOT), "|".join(_PLUS)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
#: White space between words, line ends too.
_GAP = r"[ \t\r\n]"
_NO_WORD_BEFORE, _NO_WORD_AFTER = r"(?:\b|(?<=_))", r"(?![^\W_])"
#: Runs of four or more digits of which some are spelled, with white space or a hyphen or, after a word, a dot between; in small letters.
_SPELLED = re.compile(rf"{_NO_WORD_BEFORE}(?:(?P<plus>{_PLUS_WORD}){_GAP}++)?(?P<run>(?:(?:{_DIGIT_WORD}|[0-9])(?:(?:{_GAP}++|-|(?<=[^\W\d_])\.)?(?={_DIGIT_WORD}|[0-9])|{_NO_WORD_AFTER})){{4,}})")
_DIGIT = re.compile(rf"(?i){_DIGIT_WORD}|[0-9]|(?P<gap>{_GAP}+)")
#: In brackets the words stand alone; bare, an `at` needs a dot of its own: worded, or plain with a letter top-level label.
_BRACKETED = re.compile(rf"(?i){_OPEN}{_GAP}*+({_AT_WORD}|{_DOT_WORD}){_GAP}*+{_CLOSE}{_GAP}*+")
_BARE_DOT = rf"{_GAP}++(?:{_DOT_WORD}){_GAP}++|{_GAP}\.{_GAP}|\."
_BARE = re.compile(rf"(?i)(?<![A-Za-z0-9._%+@-])([A-Za-z0-9._%+-]++)({_GAP}++(?:{_AT_WORD}){_GAP}++|{_GAP}?@{_GAP}?)([A-Za-z0-9-]++(?:(?:{_BARE_DOT})[A-Za-z0-9-]++)++)")
_BARE_IP = re.compile(rf"(?i)(?<![A-Za-z0-9.])[0-9]{{1,3}}(?:{_GAP}+(?:{_DOT_WORD}){_GAP}+[0-9]{{1,3}}){{3}}(?![0-9])")
_ANY_DOT = re.compile(rf"(?i){_BARE_DOT}")
_WORDED_DOT = re.compile(rf"(?i){_GAP}(?:{_DOT_WORD}){_GAP}")
#: Every rewriting of signs needs one of these, every one of digits a word of a digit beside another digit; in small letters.
_SIGN_HINT = re.compile(rf"{_GAP}(?:{_DOT_WORD}){_GAP}|{_OPEN}{_GAP}*+(?:{_AT_WORD}|{_DOT_WORD}){_GAP}*+{_CLOSE}|{_GAP}@|@{_GAP}|{_GAP}(?:{_AT_WORD}){_GAP}++[A-Za-z0-9-]++\.[A-Za-z0-9]")
_SPELL_HINT = re.compile(rf"{_NO_WORD_BEFORE}{_DIGIT_WORD}(?:{_GAP}++|[-.])?(?:{_DIGIT_WORD}|[0-9])|[0-9](?:{_GAP}++|-)?{_DIGIT_WORD}")


class Rewritten:
    """A text after rewriting, with the source offset of every character and of the end."""

    def __init__(self, text: str, begins=None, ends=None):
        self.text = text
        self.begins = range(len(text)) if begins is None else begins
        self.ends = range(1, len(text) + 1) if ends is None else ends

    def replaced(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Each edit's characters all stand for its whole source span."""
        if not edits:
            return self
        parts, begins, ends, last = [], [], [], 0
        for begin, end, new in edits:
            parts += [self.text[last:begin], new]
            begins += self.begins[last:begin]
            ends += self.ends[last:begin]
            begins += [self.begins[begin]] * len(new)
            ends += [self.ends[end - 1]] * len(new)
            last = end
        return Rewritten("".join([*parts, self.text[last:]]), [*begins, *self.begins[last:]], [*ends, *self.ends[last:]])

    def source(self, begin: int, end: int) -> tuple[int, int]:
        return self.begins[begin], self.ends[end - 1]


def _lookalikes(r: Rewritten) -> Rewritten:
    return r.replaced([(m.start(), m.end(), _LOOKALIKES.get(m.group(), "")) for m in _ODD.finditer(r.text)])


def _small(text: str) -> str:
    """The text in small letters, character for character."""
    small = text.lower()
    if len(small) != len(text):
        small = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return small.replace("ſ", "s")


def _spelled(r: Rewritten) -> Rewritten:
    edits, small = [], _small(r.text)
    if _SPELL_HINT.search(small):
        for run in _SPELLED.finditer(small):
            own = list(_DIGIT.finditer(run.group("run")))
            if all(len(d.group()) == 1 for d in own):
                continue
            if run.group("plus"):
                edits.append((run.start("plus"), run.start("run"), "+"))
            at = run.start("run")
            edits += [(at + d.start(), at + d.end(), " " if d.group("gap") else _NAMES[d.group().lower()]) for d in own if len(d.group()) > 1 or d.group() in "\t\r\n"]
    return r.replaced(edits)


def _signs(r: Rewritten) -> Rewritten:
    if not _SIGN_HINT.search(_small(r.text)):
        return r
    edits, last = [], 0
    for m in _BRACKETED.finditer(r.text):
        begin = last + len(r.text[last:m.start()].rstrip(" \t\r\n"))
        last = m.end()
        edits.append((begin, last, "@" if m.group(1).lower() in _AT else "."))
    r = r.replaced(edits)
    r = r.replaced([(m.start() + d.start(), m.start() + d.end(), ".") for m in _BARE_IP.finditer(r.text) for d in _ANY_DOT.finditer(m.group())])
    edits = []
    for m in _BARE.finditer(r.text):
        worded, named = _WORDED_DOT.search(m.group(3)), re.search(r"\.[ \t\r\n]?[A-Za-z]{2,}\Z", m.group(3))
        if m.group(2) == "@":
            wanted = worded
        elif "@" in m.group(2):
            wanted = worded or named
        else:  # prose has `look at example.com`, so that a plain dot needs a local part that is no word
            wanted = worded or named and not m.group(1).isalpha()
        if wanted:
            edits.append((m.start(2), m.end(2), "@"))
            edits += [(m.start(3) + d.start(), m.start(3) + d.end(), ".") for d in _ANY_DOT.finditer(m.group(3))]
    return r.replaced([e for e in edits if r.text[e[0]:e[1]] != e[2]])


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(plain, added): added spans come from the normalised text and lie in no plain span of their kind, though one may be part of them.

    The transducers run one after the other: look-alike characters and
    invisible ones, spelled digits (four languages), then at/dot words.  Each
    keeps the source span of what it writes.  No length of a part or number of
    labels is capped; all patterns are possessive, so that long texts take
    linear time.
    """
    plain = plain_spans(text)
    r = Rewritten(text)
    if not text.isascii():
        r = _lookalikes(r)
    r = _signs(_spelled(r))
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if r.text is not text and r.text != text:
        for kind, spans in plain_spans(r.text).items():
            taken = plain[kind]
            k = 0
            for span in spans:
                begin, end = r.source(*span)
                while k < len(taken) and taken[k][1] <= begin:
                    k += 1
                if k == len(taken) or not (taken[k][0] <= begin and end <= taken[k][1]):
                    added[kind].append((begin, end))
    return plain, added


SPANS = "struct<kind:string,start:long,end:long,disguised:boolean>"


def personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and found: every span of a whole text, by kind as in KINDS, then start.

    `disguised` marks the spans that only the normalised text shows.  Null and
    empty texts have none; equal rows give equal rows; texts of any length,
    with runs of any length in them, take linear time; columns that are not
    in `keep` are not read, and an empty table gives no row.
    """
    schema = T.StructType(docs.select(*keep).schema.fields + T.StructType.fromDDL(f"found array<{SPANS}>").fields)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]))

    def over(batch):
        rows = []
        for t in batch.column(len(keep)).to_pylist():
            plain, added = find(t or "")
            rows.append([{"kind": k, "start": a, "end": b, "disguised": d}
                         for k in KINDS for a, b, d in sorted([(*s, False) for s in plain[k]] + [(*s, True) for s in added[k]])])
        yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(rows, kind)], names=schema.names)

    return as_map(docs.select(*keep, text), over, schema)


def span_digest(spans: str) -> str:
    return sha256(spans.encode()).hexdigest()
