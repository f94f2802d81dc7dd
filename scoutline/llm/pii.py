"""Personal data: offset-preserving deobfuscation.

Plain identifiers are found in the text as it stands. Then a chain of transducers rewrites the
text: look-alike characters become the letters and digits that they imitate, invisible ones go,
bracketed or spelled at and dot become @ and ., spelled digits become digits, also among figures. Every output
character keeps the start and end of the source characters that it stands for. Identifiers that
appear only in the rewritten text are mapped back to source spans and added, also where a plain
rest of one is a base span already.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.llm.shared import parts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can begin at the first digit of a run only: what precedes it would have been taken.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> list[Span]:
    """Leftmost matches of local@domain, found from each @ outwards, in linear time."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def identifiers(text: str) -> dict[str, list[Span]]:
    """The base spans of each kind, leftmost and non-overlapping within the kind."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    if DIGIT.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    return out


# Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
}
# Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
DISGUISED = re.compile("[" + "".join(LOOK_ALIKE) + INVISIBLE + "！-～٠-٩۰-۹①-⑨\U0001d400-\U0001d7ff]")
# Names of the digits from 0 on, and of plus, at and dot, in English, German, Spanish and French.
DIGIT_NAMES = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "zéro un deux trois quatre cinq six sept huit neuf",
)
OTHER_DIGIT_NAMES = {"oh": "0", "zwo": "2", "fuenf": "5"}
PLUS, AT_NAMES, DOT_NAMES = ("plus", "más"), ("at", "ät", "arroba", "arobase"), ("dot", "punkt", "punto", "point")
DIGITS = {name: str(i) for names in DIGIT_NAMES for i, name in enumerate(names.split())} | OTHER_DIGIT_NAMES


def either(names: Iterable[str]) -> str:
    """A group of the names, longer ones first."""
    return "(?:" + "|".join(sorted(names, key=lambda x: (-len(x), x))) + ")"


NAME, SIGN, AT, SPELLED_DOT = either(DIGITS), either(PLUS), either(AT_NAMES), either(DOT_NAMES)
#: A run of names of digits and figures, with plus before them or not; dots may be between.
SPELLED = re.compile(rf"(?<!\w)(?:{SIGN}[\x20-]+|\+[\x20-]*)?(?:{NAME}|[0-9])(?:(?:[\x20-]+|\.)?(?:{NAME}|[0-9]))*(?!\w)", re.IGNORECASE)
SPELLED_PART = re.compile(rf"{SIGN}|{NAME}|[\x20-]+", re.IGNORECASE)
TOKEN = re.compile(r"\w+")
#: How a word that joins names and figures begins.
HEADS = frozenset([name[:2] for name in DIGITS] + [f"{i}{c}" for i in range(10) for c in {name[0] for name in DIGITS} | set("0123456789")])
JOINED = re.compile(rf"(?:{NAME}|[0-9])+")
BRACKETED = re.compile(rf"\s{{0,9}}[\[({{<]\s{{0,9}}(?:({AT}|@)|({SPELLED_DOT}|\.))\s{{0,9}}[\])}}>]\s{{0,9}}", re.IGNORECASE)
#: name at host dot tld in words, with spaces around at and dot.
WORDED = re.compile(rf"(?<=[A-Za-z0-9])(\x20{{1,9}}{AT}\x20{{1,9}})(?=(?:[A-Za-z0-9-]{{1,63}}(?:\x20{{1,9}}{SPELLED_DOT}\x20{{1,9}}|\.))+[A-Za-z]{{2,}})", re.IGNORECASE)
DOT = re.compile(rf"(?<=[A-Za-z0-9])\x20{{1,9}}{SPELLED_DOT}\x20{{1,9}}(?=[A-Za-z]{{2,}}|[0-9])", re.IGNORECASE)
RUN = re.compile(r"\+?[0-9](?:\.?[0-9]){6,}")


class Tape:
    """A text and, for each of its characters, the source span that it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces [i, j) by a string, for edits in order; each new character stands for all of [i, j)."""
        text, start, end, at = [], [], [], 0
        for i, j, new in edits:
            text += [self.text[at:i], new]
            start += self.start[at:i] + [self.start[i]] * len(new)
            end += self.end[at:i] + [self.end[j - 1]] * len(new)
            at = j
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end = start + self.start[at:], end + self.end[at:]


def plain(c: str) -> str:
    """What a disguised character imitates."""
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKE:
        return LOOK_ALIKE[c]
    d = unicodedata.digit(c, None)
    return str(d) if d is not None else unicodedata.normalize("NFKC", c)


def spelled(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """The edits of every run with two or more names and the digits of a phone number, or with a name and the form of an address."""
    for m in SPELLED.finditer(text):
        edits = [(m.start() + w.start(), m.start() + w.end(), "+" if w[0].lower() in PLUS else DIGITS.get(w[0].lower(), "")) for w in SPELLED_PART.finditer(m[0])]
        names = sum(new.isdigit() for _, _, new in edits)
        if names and (names > 1 and names + len(DIGIT.findall(m[0])) >= 7 or IP.fullmatch(SPELLED_PART.sub(lambda w: DIGITS.get(w[0].lower(), ""), m[0]))):
            yield edits


def may_spell(text: str) -> bool:
    """Whether a run of spelled() can be there: a digit's name beside another one or a figure, or a word of several of them."""
    beside = name_before = False
    for w in TOKEN.findall(text.casefold()):
        name, figure = w in DIGITS, w.isdigit()
        if name and beside or figure and name_before:
            return True
        if not name and not figure and w[:2] in HEADS and JOINED.fullmatch(w):
            return True
        beside, name_before = name or figure, name
    return False


def disguised(text: str) -> bool:
    """Whether any transducer changes the text."""
    if not text.isascii() and DISGUISED.search(text):
        return True
    low = text.lower()
    return bool(
        (any(c in text for c in "[({<") and BRACKETED.search(text))
        or (any(f" {x} " in low for x in AT_NAMES) and WORDED.search(text))
        or (any(f" {x} " in low for x in DOT_NAMES) and DOT.search(text))
        or (may_spell(text) and next(spelled(text), None))
    )


def deobfuscated(text: str) -> tuple[Tape, list[Span]]:
    """The rewritten text, and where spelled numbers of phone length are in it."""
    tape = Tape(text)
    tape.rewrite([(m.start(), m.end(), plain(m[0])) for m in DISGUISED.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), "@" if m[1] else ".") for m in BRACKETED.finditer(tape.text)])
    tape.rewrite([(*m.span(1), "@") for m in WORDED.finditer(tape.text)])
    tape.rewrite([(*m.span(), ".") for m in DOT.finditer(tape.text)])
    edits = [e for run in spelled(tape.text) for e in run]
    spoken = {i for a, b, new in edits if new for i in range(tape.start[a], tape.end[b - 1])}
    tape.rewrite(edits)
    phones = [m.span() for m in RUN.finditer(tape.text) if len(NOT_DIGIT.sub("", m[0])) <= 15 and any(tape.start[i] in spoken for i in range(*m.span()))]
    return tape, phones


def spans(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and those that deobfuscation adds, in source code points. An added span lies in no base span of its kind and in no added span."""
    base = identifiers(text or "")
    added: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not text or not disguised(text):
        return base, added
    tape, phones = deobfuscated(text)
    found = identifiers(tape.text)
    found["phone"] += phones
    for kind in KINDS:
        held = sorted([*base[kind], *(x for k in KINDS for x in added[k])])
        starts, ends = [a for a, _ in held], list(accumulate((b for _, b in held), max))
        far = -1
        for a, b in sorted(((tape.start[i], tape.end[j - 1]) for i, j in found[kind]), key=lambda x: (x[0], -x[1])):
            i = bisect_right(starts, a)
            if b > far and not (i and b <= ends[i - 1]):
                added[kind].append((a, b))
                far = b
    return base, added


def joined(found: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(found[k]))


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added; one row per input row.

    Null text counts as empty: no spans, and the digest of the empty string. Null and repeated
    doc_ids are rows like any other; other columns are ignored; an empty table gives an empty result. Texts of any length
    are read whole. Spans of a kind are in order of start, then of end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = []
            for t in b.column("text"):
                base, added = spans(t.as_py())
                rows.append(
                    [len(base[k]) for k in KINDS]
                    + [hashlib.sha256(joined(base).encode()).hexdigest(), joined({k: base[k] + added[k] for k in KINDS}), sum(map(len, added.values()))]
                )
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")] + [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )


def masked(text: str) -> str:
    """Every span replaced by its kind in brackets; of overlapping spans the first and longest."""
    base, added = spans(text)
    out, at = [], 0
    for a, b, kind in sorted(((a, b, k) for f in (base, added) for k in KINDS for a, b in f[k]), key=lambda x: (x[0], -x[1])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with personal data in text masked and n_chars, where it is there, counted anew; null texts stay null.

    Each row by its own text, whatever its doc_id; other columns stay as they are, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            texts = [t if t is None else masked(t) for t in (x.as_py() for x in b.column("text"))]
            cols = {n: b.column(n) for n in b.schema.names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in cols:
                new = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                cols["n_chars"] = new.cast(b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, docs.schema)
