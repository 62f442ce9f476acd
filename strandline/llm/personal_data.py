"""Personal data with offset-preserving deobfuscation.

Base detection finds e-mail addresses, IPv4 addresses, payment cards and phone numbers in the text as it
stands. Then a chain of transducers, each a pattern whose matches are written anew, rewrites a copy of the text:
look-alike letters and digits to ASCII, three and more spelled digits in a row to digits, disguised "at" and "dot"
to their signs (words of English, German, French and Spanish). Every character of the copy remembers the span of source
characters that it stands for, so what is detected in the copy maps back to a source span; such spans are
added where they overlap no base span of their kind.

One pass over whole texts where they are read; no shuffle. All scans are linear in the text.

Defined results: null and empty texts have no spans; repeated rows repeat; extra columns are ignored.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import text_of

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits that is no address cannot hold one from a later digit of the run on: hence the look-behind.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Letters and digits that look like ASCII ones.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "З": "3",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ",
}
#: Full-width forms of ! to ~, and Arabic-Indic, extended Arabic-Indic and Devanagari digits.
TO_ASCII = str.maketrans(
    LOOK_ALIKES
    | {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
    | {chr(zero + d): str(d) for zero in (0x0660, 0x06F0, 0x0966) for d in range(10)}
)
FOREIGN = re.compile("[" + "".join(map(re.escape, map(chr, TO_ASCII))) + "]")

#: Digits as words in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: How the four languages say the signs of an address.
AT_WORDS, DOT_WORDS = ("at", "bei", "arobase", "arroba"), ("dot", "punkt", "point", "punto")
_DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
#: Three digit words in a row or more, so that ordinary prose stays as it is.
SPELLED = re.compile(rf"(?<!\w){_DIGIT}(?:[ ,.-]{{1,2}}{_DIGIT}){{2,}}(?!\w)", re.I)
DIGIT_WORD = re.compile(_DIGIT, re.I)
_AT, _DOT = "(?:" + "|".join(AT_WORDS) + ")", "(?:" + "|".join(DOT_WORDS) + ")"
AT_SIGN = re.compile(rf" *+[(\[{{<] *+(?:{_AT}|@) *+[)\]}}>] *+", re.I | re.A)
DOT_SIGN = re.compile(rf" *+[(\[{{<] *+(?:{_DOT}|\.) *+[)\]}}>] *+", re.I | re.A)
#: "name at host dot org" in plain words: only as a whole, so that the word "at" alone means nothing.
PLAIN_HOST = re.compile(rf"[A-Za-z0-9-]++(?: {_DOT} [A-Za-z0-9-]++)+", re.I | re.A)
PLAIN_AT = re.compile(rf"(?<=[A-Za-z0-9]) {_AT} (?={PLAIN_HOST.pattern})", re.I | re.A)
PLAIN_DOT = re.compile(rf" {_DOT} ", re.I | re.A)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards: the same matches as from the left, in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = _run_start(text, free, at)
        if start < at and (m := DOMAIN.match(text, at + 1)):
            free = m.end()
            yield start, free
        at = text.find("@", max(free, at + 1))


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _run_start(text: str, free: int, at: int) -> int:
    while at > free and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}
_ANY_DIGIT = re.compile("[0-9]")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each kind's leftmost non-overlapping matches that pass its test."""
    out = []
    if "@" in text:
        out += [(*span, "email") for span in _emails(text)]
    if _ANY_DIGIT.search(text):
        out += [(*span, "ip") for span in _ips(text)] + [(*span, "card") for span in _cards(text)]
        if "+" in text:
            out += [(*span, "phone") for span in _phones(text)]
    return out


class Mapped:
    """A rewritten text; character i of it stands for source characters start[i] to end[i]."""

    def __init__(self, source: str):
        self.text, self.start, self.end = source, range(len(source)), range(1, len(source) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the present text; each new character stands for the whole span it replaces."""
        if not edits:
            return
        text, start, end, done = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[done:a], new]
            start += [*self.start[done:a], *[self.start[a]] * len(new)]
            end += [*self.end[done:a], *[self.end[b - 1]] * len(new)]
            done = b
        text.append(self.text[done:])
        self.text, self.start, self.end = "".join(text), [*start, *self.start[done:]], [*end, *self.end[done:]]

    def source_span(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def normalised(text: str) -> Mapped | None:
    """The text without disguises, or None if it has none."""
    out = Mapped(text)
    if not text.isascii() and FOREIGN.search(text):
        out.text = text.translate(TO_ASCII)  # one character each: offsets stay
    spelled = []
    for m in SPELLED.finditer(out.text):
        words = list(DIGIT_WORD.finditer(out.text, m.start(), m.end()))
        edges = [w.start() for w in words[1:]] + [m.end()]
        spelled += [(w.start(), edge, DIGIT_WORDS[w.group().lower()]) for w, edge in zip(words, edges, strict=True)]
    out.rewrite(spelled)
    for pattern, sign in ((AT_SIGN, "@"), (DOT_SIGN, ".")):
        out.rewrite([(*m.span(), sign) for m in pattern.finditer(out.text)])
    plain = []
    for m in PLAIN_AT.finditer(out.text):
        host = PLAIN_HOST.match(out.text, m.end())
        dots = PLAIN_DOT.finditer(out.text, host.start(), host.end())
        plain += [(*m.span(), "@"), *((*d.span(), ".") for d in dots)]
    out.rewrite(plain)
    return None if out.text is text else out


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, spans that only show once disguises are undone), both in order."""
    base = sorted(base_spans(text), key=_order)
    if (clear := normalised(text)) is None:
        return base, []
    taken = {k: [s for s in base if s[2] == k] for k in KINDS}
    added = {
        (*clear.source_span(a, b), kind)
        for a, b, kind in base_spans(clear.text)
        if not _overlaps(taken[kind], *clear.source_span(a, b))
    }
    return base, sorted(added, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def _overlaps(spans: list[tuple[int, int, str]], a: int, b: int) -> bool:
    """Whether a span of the sorted, disjoint list meets a to b."""
    low, high = 0, len(spans)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if spans[mid][1] <= a else (low, mid)
    return low < len(spans) and spans[low][0] < b


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find(documents: DataFrame) -> DataFrame:
    """doc_id and its spans: array of (kind, start, end, disguised)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            spans = []
            for text in rows["text"]:
                base, added = all_spans(text)
                every = sorted([(*s, False) for s in base] + [(*s, True) for s in added], key=_order)
                spans.append([{"kind": k, "start": a, "end": b, "disguised": d} for a, b, k, d in every])
            yield pd.DataFrame({"doc_id": rows["doc_id"], "spans": spans})

    return text_of(documents).mapInPandas(run, "doc_id long, spans array<struct<kind string, start int, end int, disguised boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans, of `find`'s rows."""
    show = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: ~s["disguised"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(F.array_join(F.transform(base, show), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", show), ",").alias("spans"),
    )
