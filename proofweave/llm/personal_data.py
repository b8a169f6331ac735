"""Personal data in text, also in disguise, at exact source offsets.

Identifiers are found twice: in the text as it is, and in a normalised copy.
The copy is made by transducers that rewrite homoglyphs, invisible characters,
spelled digits and at/dot disguises, and each keeps which source characters
every output character came from; spans found in the copy are mapped back.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from proofweave.llm.common import whole

KINDS = ("email", "ip", "card", "phone")

# Letters that look like ASCII ones, and digit names.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ɡ": "g", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "İ": "I", "ſ": "s", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".",
}
DIGIT_NAMES = (
    ("zero", "cero", "zéro", "null"),
    ("one", "uno", "un", "eins"),
    ("two", "dos", "deux", "zwei"),
    ("three", "tres", "trois", "drei"),
    ("four", "cuatro", "quatre", "vier"),
    ("five", "cinco", "cinq", "fünf"),
    ("six", "seis", "sechs"),
    ("seven", "siete", "sept", "sieben"),
    ("eight", "ocho", "huit", "acht"),
    ("nine", "nueve", "neuf", "neun"),
)
AT_NAMES = ("at", "arroba", "arobase", "ät")
DOT_NAMES = ("dot", "punto", "point", "punkt")
INVISIBLE = "­​‌‍⁠﻿"


def _same_length_map() -> dict[int, str]:
    """LOOKALIKES, and every character whose compatibility form is one ASCII character."""
    found = {ord(k): v for k, v in LOOKALIKES.items()}
    for code in range(0x80, 0x20000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        plain = unicodedata.normalize("NFKC", char)
        if len(plain) == 1 and plain.isascii() and plain.isprintable() and not char.isspace():
            found.setdefault(code, plain)
        elif unicodedata.category(char) == "Nd":
            found.setdefault(code, str(unicodedata.digit(char)))
    return found


SAME_LENGTH = _same_length_map()
_NAMED = {name: str(d) for d, names in enumerate(DIGIT_NAMES) for name in names}
_NAME = "(?:" + "|".join(sorted(_NAMED, key=len, reverse=True)) + ")"
_ATS, _DOTS = "|".join(AT_NAMES), "|".join(DOT_NAMES)
_ODD = frozenset(map(chr, SAME_LENGTH))
_HIDDEN = re.compile(f"[{INVISIBLE}]+")
#: Three or more digit names, or one beside a digit, with a space or hyphen between.
_SPELLED = re.compile(rf"\b{_NAME}(?:[ \-]{_NAME})*\b", re.I)
_BOXED = re.compile(rf"[\[({{<] {{0,2}}(?:({_ATS}|@)|(?:{_DOTS}|\.)) {{0,2}}[\])}}>]", re.I)
_BARE_AT = re.compile(
    rf"(?<=[A-Za-z0-9._%+-]) (?:{_ATS}) (?=[A-Za-z0-9-]+(?:(?: (?:{_DOTS}) |\.)[A-Za-z0-9-]+)* (?:{_DOTS}) [A-Za-z0-9-])", re.I
)
_BARE_DOT = re.compile(rf"(?<=[A-Za-z0-9]) (?:{_DOTS}) (?=[A-Za-z0-9])", re.I)
#: A host with bare dots, of any length.
_HOST = re.compile(rf"[A-Za-z0-9.-]+(?: (?:{_DOTS}) [A-Za-z0-9-]+)*", re.I)
_PLUS = re.compile(r"\bplus (?=[0-9])", re.I)
_HINT = re.compile(rf" (?:{_DOTS}) |[\[({{<] {{0,2}}(?:{_ATS}|{_DOTS}|[.@]) {{0,2}}[\])}}>]|\b{_NAME}\b[ \-]{_NAME}\b|[0-9][ \-]{_NAME}\b|\b{_NAME}[ \-][0-9]|plus [0-9]", re.I)

_LETTERS = re.compile(r"[^\W\d_]+")
_HINT_WORDS = {*_NAMED, *DOT_NAMES, "plus"}

_EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += (n if i % 2 == 0 else n * 2 - 9 * (n > 4))
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, found from each @ so that long words stay linear."""
    floor, at = 0, text.find("@")
    while at >= 0:
        domain = _EMAIL_DOMAIN.match(text, at)
        begin = at
        if domain:
            while begin > floor and _EMAIL_LOCAL.match(text, begin - 1):
                begin -= 1
        if begin < at:
            yield begin, domain.end()
            floor = domain.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of KINDS, then of start."""
    found = [("email", s, e) for s, e in _emails(text)]
    if not re.search("[0-9]", text):
        return found
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            found.append(("phone", *m.span()))
    return found


def _hinted(text: str) -> bool:
    """Whether _HINT is found, asked only of texts with a bracket or one of its words."""
    boxed = any(c in text for c in "[({<")
    return (boxed or not _HINT_WORDS.isdisjoint(_LETTERS.findall(text.lower()))) and bool(_HINT.search(text))


class Rewritten:
    """A text with some slices replaced, and the way back to its source."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        self.at, self.to, self.same = [], [], []  # output starts, source spans, unchanged
        out, size, last = [], 0, 0

        def put(piece: str, begin: int, end: int, same: bool) -> None:
            nonlocal size
            if piece:
                self.at.append(size)
                self.to.append((begin, end))
                self.same.append(same)
                out.append(piece)
                size += len(piece)

        for begin, end, piece in sorted(edits):
            if begin >= last:
                put(source[last:begin], last, begin, True)
                put(piece, begin, end, False)
                last = end
        put(source[last:], last, len(source), True)
        self.text = "".join(out)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span that the output span came from."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        begin = self.to[i][0] + (start - self.at[i] if self.same[i] else 0)
        finish = self.to[j][0] + end - self.at[j] if self.same[j] else self.to[j][1]
        return begin, finish


def _widened(text: str, begin: int, end: int) -> tuple[int, int]:
    """A span with the spaces around it, two on each side at most."""
    for _ in range(2):
        begin -= begin > 0 and text[begin - 1] == " "
        end += end < len(text) and text[end] == " "
    return begin, end


def _disguises(text: str) -> list[tuple[int, int, str]]:
    edits = [(*_widened(text, *m.span()), "@" if m.group(1) else ".") for m in _BOXED.finditer(text)]
    for m in _BARE_AT.finditer(text):
        edits.append((*m.span(), "@"))
    return edits


def _digits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED.finditer(text):
        # Folding of case may match a character whose lower case is another one.
        names = re.split("[ -]", m.group().lower())
        if any(n not in _NAMED for n in names):
            continue
        before = m.start() > 1 and text[m.start() - 2].isdigit()
        after = m.end() + 1 < len(text) and text[m.end() + 1].isdigit()
        dotted = _BARE_DOT.match(text, m.end()) or text[: m.start()].endswith(tuple(f" {d} " for d in DOT_NAMES))
        if len(names) >= 3 or before or after or dotted:
            edits.append((*m.span(), "".join(_NAMED[n] for n in names)))
    return edits


def _dots(text: str) -> list[tuple[int, int, str]]:
    """Bare dots, between numbers or after an at sign in the same address."""
    edits, looked, chain = [], 0, -1  # chain: end of the host that follows the last at sign
    for m in _BARE_DOT.finditer(text):
        at = text.rfind("@", looked, m.start())
        if at >= 0:
            host = _HOST.match(text, at + 1)
            chain = host.end() if host else -1
        looked = m.start()
        numbers = text[m.start() - 1].isdigit() and text[m.end()].isdigit()
        if numbers or m.start() < chain:
            edits.append((*m.span(), "."))
    edits.extend((*m.span(), "+") for m in _PLUS.finditer(text))
    return edits


def find(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, disguised) in code points, by kind and start.

    Plain spans are all there; a disguised one is added unless a plain span of
    its kind holds it all, so one that a disguise cut short stays beside the whole.
    """
    plain = detect(text)
    spans = [(*s, False) for s in plain]
    rare = frozenset() if text.isascii() else frozenset(text)  # one look at each distinct character
    odd, hidden = not rare.isdisjoint(_ODD), not rare.isdisjoint(INVISIBLE)
    if odd or hidden or _hinted(text):
        stages, now = [], text.translate(SAME_LENGTH) if odd else text
        for rule in (lambda t: [(*m.span(), "") for m in _HIDDEN.finditer(t)], _disguises, _digits, _dots):
            stages.append(Rewritten(now, rule(now)))
            now = stages[-1].text
        for kind, start, end in detect(now) if now != text else ():
            for stage in reversed(stages):
                start, end = stage.back(start, end)
            if not any(k == kind and s <= start and end <= e for k, s, e in plain):
                spans.append((kind, start, end, True))
        spans.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return spans


SPAN = "struct<kind: string, start: int, end: int, disguised: boolean>"


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the spans of each whole text, a row per row of ``docs``.

    Offsets count code points, ends are exclusive. Null and empty texts have no
    spans. Null or repeated doc_ids keep their rows. Spans of different kinds
    may overlap. No rows give no rows. Other columns of ``docs`` are not read.
    """

    @F.pandas_udf(f"array<{SPAN}>")
    def spans_of(text: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "disguised")
        return pd.Series([[dict(zip(names, s)) for s in find(t)] for t in text], dtype=object)

    return docs.select("doc_id", spans_of(whole("text")).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each identifier replaced by its kind in brackets.

    Spans that overlap are replaced together, by the kind of the longest. Null
    texts become empty; null and repeated doc_ids keep their rows; no rows give none.
    """

    @F.pandas_udf("string")
    def mask(text: pd.Series) -> pd.Series:
        def one(t):
            groups = []  # start, end, longest kind, its length
            for k, s, e, _ in sorted(find(t), key=lambda s: (s[1], -s[2])):
                if not groups or s >= groups[-1][1]:
                    groups.append([s, e, k, e - s])
                    continue
                last = groups[-1]
                last[1] = max(last[1], e)
                if e - s > last[3]:
                    last[2:] = k, e - s
            return Rewritten(t, [(s, e, f"[{k.upper()}]") for s, e, k, _ in groups]).text

        return text.map(one)

    return docs.withColumn("text", mask(whole("text")))
