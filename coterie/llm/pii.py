"""Personal data with offset-preserving deobfuscation.

The base patterns run on the text as it stands. Then transducers rewrite disguises,
each keeping for every character it puts out the source span it stands for: look-alike
characters and digits become plain ones and invisible characters vanish; bracketed or
spaced "at" and "dot" become `@` and `.`; runs of spelled digits become digits. The
patterns run again on the result, and spans that hold a rewritten or dropped character
are mapped back to the source. They are added unless a base span of the kind holds them;
base spans stay. A spelled address may end in any domain ending, other than function
words that are none.

Every pattern is matched in time linear in the text: an address is found from its `@`,
digit runs are entered at their first digit only.

Defined cases: null text is empty; texts are taken whole; repeated rows are searched
each for itself; an empty table gives an empty result; further columns are ignored;
offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from coterie.llm.bpe import texts

KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int, int]  # start, kind, end

#: The base patterns, in parts.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]*+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # where the match before ended
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            yield start, free
        # characters before this place are in no later local part
        free = max(free, at + 1 if not m else free)
        at = text.find("@", max(at + 1, free if m else 0))


def identifiers(text: str) -> list[Span]:
    """All base spans of a text."""
    out: list[Span] = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Characters that look like ASCII letters, by the letter.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "к": "k", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "ο": "o", "α": "a",
    "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z", "ı": "i", "ɡ": "g",
    "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "﹫": "@", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
#: Kinds of Unicode decompositions that only style a character.
STYLES = frozenset(("<wide>", "<narrow>", "<small>", "<font>", "<circle>"))
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
}

_BRACKETED = re.compile(r"[ \t]?[\[({<][ \t]?(at|dot|plus)[ \t]?[\])}>][ \t]?", re.I)
_BRACKET = re.compile(r"[\[({<][ \t]?(?:at|dot|plus)", re.I)  # in all that _BRACKETED matches
#: Fixed value: words after "dot" that are no domain endings.
_NO_TOP = "on|the|and|or|of|for|if|an|with|from|then|than|that|this|these|those|when|where|which|was|were|will|would|not|but|into"
_NAMED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:[ \t]+dot[ \t]+[A-Za-z0-9._%+-]++){0,3}[ \t]+at[ \t]+"
    r"[A-Za-z0-9-]++(?:(?:\.|[ \t]+dot[ \t]+)[A-Za-z0-9-]++)*"
    rf"[ \t]+dot[ \t]+(?!(?:{_NO_TOP})\b)(?:xn--[A-Za-z0-9-]++|[A-Za-z]{{2,}}+)\b",
    re.I,
)
_NAMED_MARK = re.compile(r"[ \t]+(at|dot)[ \t]+", re.I)
_SPELLED_WORD = rf"(?:{'|'.join(DIGIT_WORDS)}|[0-9])"
_SPELLED = re.compile(
    rf"(?<![A-Za-z0-9])(?:plus[ \t-]+)?{_SPELLED_WORD}(?:(?:[ \t,-]{{1,2}}|[ \t]+(?:dot|point)[ \t]+){_SPELLED_WORD}(?![A-Za-z])){{3,}}", re.I
)
_SPELLED_PART = re.compile(rf"plus|dot|point|{_SPELLED_WORD}", re.I)
_MARKS = {"at": "@", "dot": ".", "plus": "+", "point": "."}


class Traced:
    """A rewritten text; every character keeps the source span it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.changed = bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint ascending spans; what is put in stands for the whole span."""
        if not edits:
            return
        text, start, end, changed, at = [], [], [], bytearray(), 0
        for a, b, put in edits:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            changed += self.changed[at:a]
            text.append(put)
            if put:
                start += [self.start[a]] * len(put)
                end += [self.end[b - 1]] * len(put)
                changed += b"\1" * len(put)
            at = b
        text.append(self.text[at:])
        start += self.start[at:]
        end += self.end[at:]
        changed += self.changed[at:]
        self.text, self.start, self.end, self.changed = "".join(text), start, end, changed


@lru_cache(maxsize=65_536)
def _plain(c: str) -> str:
    """What a character stands for; raised and lowered ones stay, as they are notes more often than disguises."""
    if c.isascii():
        return c
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    if unicodedata.decomposition(c).split(" ")[0] not in STYLES:
        return c
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded.isascii() else c


def _unusual(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    odd = "".join(c for c in set(text) if _plain(c) != c)
    return [(m.start(), m.end(), _plain(m[0])) for m in re.finditer(f"[{re.escape(odd)}]", text)] if odd else []


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED.finditer(text):
        parts = [(p.start(), p.end(), p[0].lower()) for p in _SPELLED_PART.finditer(text, m.start(), m.end())]
        if not any(p in DIGIT_WORDS for _, _, p in parts):
            continue
        for k, (a, b, p) in enumerate(parts):
            until = parts[k + 1][0] if k + 1 < len(parts) else b  # what stands between belongs to the part before
            edits.append((a, until, _MARKS.get(p) or DIGIT_WORDS.get(p, p)))
    return edits


def _bracketed(text: str) -> list[tuple[int, int, str]]:
    if not _BRACKET.search(text):
        return []
    return [(m.start(), m.end(), _MARKS[m[1].lower()]) for m in _BRACKETED.finditer(text)]


def _named(text: str) -> list[tuple[int, int, str]]:
    if "dot" not in text.lower():
        return []
    return [
        (m.start(), m.end(), _MARKS[m[1].lower()])
        for whole in _NAMED.finditer(text)
        for m in _NAMED_MARK.finditer(text, whole.start(), whole.end())
    ]


def deobfuscated(text: str) -> Traced | None:
    """The text with disguises rewritten, null if there are none."""
    traced = None
    for edits_of in (_unusual, _spelled, _bracketed, _named):
        edits = edits_of(traced.text if traced else text)
        if edits:
            traced = traced or Traced(text)
            traced.rewrite(edits)
    return traced


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base = identifiers(text)
    traced = deobfuscated(text)
    if traced is None:
        return base, base
    added = []
    for s, kind, e in identifiers(traced.text):
        a, b = traced.start[s], traced.end[e - 1]
        if any(traced.changed[s:e]) or b - a != e - s:
            if not any(k == kind and s2 <= a and b <= e2 for s2, k, e2 in base):
                added.append((a, kind, b))
    return base, sorted({*base, *added})


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """`doc_id`, base counts per kind, `base_sha256` and `spans`, one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [spans(t) for t in texts(batch)]
            counts = [pa.array([sum(k == n for _, k, _ in base) for base, _ in out], pa.int64()) for n in range(len(KINDS))]
            shas = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in out]
            columns = [batch.column("doc_id"), *counts, pa.array(shas, pa.string()), pa.array([written(a) for _, a in out], pa.string())]
            yield pa.record_batch(columns, names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    plain = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
