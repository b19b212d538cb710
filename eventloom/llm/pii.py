"""Personal data: exact base patterns, and offset-preserving deobfuscation.

`base` finds the four kinds of the contract in the raw text. `Transducer` rewrites disguised text
(homoglyphs and full-width forms, invisible characters, spelled digits, "at" and "dot" in words or in
brackets) into plain text and keeps, for each character it writes, the span of source characters that it
stands for. Identifiers found in the rewritten text are mapped back through these spans to the source.
A span from the transducer is added only where at least one of its characters was rewritten and no base
span overlaps it, so base spans always stay as they are. "at" before a host with plain dots counts as an address
("bob at example.com") unless one of the words PLACED stands before it ("visit us at example.com").

Offsets are code points, end exclusive. A null text counts as empty and has no spans. Whole texts are
read; repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from eventloom.llm.bpe import _schema_of
from eventloom.llm.common import ship, strings

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails as the first part fails from each of its digits, so only its start is tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the leftmost non-overlapping matches of the pattern: each @ is tried once, from the start of the characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _EMAIL.match(text, start) if start < at else None
        if match:
            yield match.span()
            done = match.end()
        else:
            done = at + 1
        at = text.find("@", done)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match.group().split(".")):
            yield match.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 16:
            digits = _NOT_DIGITS.sub("", match.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield match.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for match in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGITS.sub("", match.group())) <= 15:
            yield match.span()


_FINDERS = (("email", emails), ("ip", ips), ("card", cards), ("phone", phones))


def base(text: str) -> list[Span]:
    """By kind, then start."""
    return [(kind, *span) for kind, find in _FINDERS for span in find(text)]


# Look-alike letters and the letters that they stand for.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", " ": " ", " ": " ", " ": " ", " ": " ",
}
# Characters that aren't seen.
INVISIBLE = "­​‌‍⁠﻿"
# The names of digits.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}

#: Character by character: full-width forms and the digits of other scripts (by rule), look-alikes, and what isn't seen.
_ONE: dict[int, str] = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_ONE |= {start + d: str(d) for start in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_ONE |= {ord(c): to for c, to in HOMOGLYPHS.items()}
_ONE |= {ord(c): "" for c in INVISIBLE}
_ODD = "".join(re.escape(chr(c)) for c in sorted(_ONE))
_NAMES = "|".join(sorted(DIGITS, key=len, reverse=True))

_MARKED = r"[\[({<]\s*(?:at|@)\s*[\])}>]|[\[({<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}>]"
_HOST = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"
_SPOKEN = rf"(?<=[A-Za-z0-9])\s+at\s+(?={_HOST}(?:\s+dot\s+|\s*[\[({{<]\s*dot\s*[\])}}>]\s*)[A-Za-z])"
#: "at" before a host with plain dots, whose last part is of letters of one case; neither a time of day nor the end of one sentence and the begin of another.
_SPOKEN_HOST = rf"(?<=[A-Za-z0-9])\s+at\s+(?={_HOST}\.(?-i:[a-z]{{2,}}|[A-Z]{{2,}})(?![A-Za-z0-9-]))(?![0-9.]+[ap]m\b)"
# Words after which "at" and a host name say where something is ("visit us at example.com"), not whose address it is.
PLACED = frozenset(
    "i me you he him she her it we us they them this that these those who what which one all everyone and or but not also is are was were be been being am "
    "look looked looking looks see seen visit visited find found available online live here there out more now today only back up down on over hosted based located "
    "posted published listed website site page pages blog store shop article download downloaded read shown register registered sign work works worked working "
    "arrive arrived stay stayed meet met start started end ended buy sold sale order ordered".split()
)
#: At least four names of digits in a row, of which a number is made; hyphens, dots and blanks may part them.
_SPELLED = rf"(?<![\w])(?:{_NAMES})(?:[\s,-]{{1,3}}(?:{_NAMES})){{3,}}(?!\w)"
# what \s means in Python, for RE2
_BLANK = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: Texts in which nothing of this occurs are not rewritten (RE2, for whole batches at once). It must find at least what _ODD, _STEP and the dots below find; Python takes ı and İ for i.
TRIGGER = rf"(?i)[{_ODD}ıİ]|[\[({{<][{_BLANK}]*(?:at|@|dot|punkt|punto|point|\.)[{_BLANK}]*[\])}}>]|[a-z0-9-][{_BLANK}]+dot[{_BLANK}]+[a-z0-9]|[a-z0-9][{_BLANK}]+at[{_BLANK}]+[a-z0-9-]+\.[a-z0-9-]|(?:{_NAMES})(?:[{_BLANK},-]{{1,3}}(?:{_NAMES})){{3}}"

_STEP = re.compile(rf"(?i)(?P<mark>\s*(?:{_MARKED})\s*)|(?P<spoken>{_SPOKEN})|(?P<host>{_SPOKEN_HOST})|(?P<spelled>{_SPELLED})|(?P<odd>[{_ODD}])")
_NAME = re.compile(rf"(?i){_NAMES}")
_SPOKEN_DOT = re.compile(r"(?i)(?<=[a-z0-9])\s+dot\s+(?=[a-z0-9])")
#: Dots of the addresses of machines.
_NUMBER_DOT = re.compile(r"(?i)(?<=[0-9])\s+dot\s+(?=[0-9])")
# what matches another letter when case is ignored, but isn't lowered to it
_SAME = str.maketrans("ſıİ", "sii")
_HOST_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.-")
_WORD_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+\Z")


class Transducer:
    """The rewritten text, and for each of its characters where its source begins and ends."""

    def __init__(self, text: str):
        # first characters, then what is made of several: a disguise may itself be written in look-alikes
        out, begins, ends, done = [], [], [], 0

        def put(new: str, low: int, high: int) -> None:
            out.append(new)
            begins.extend([low] * len(new))
            ends.extend([high] * len(new))

        for match in re.finditer(f"[{_ODD}]", text):
            low, high = match.span()
            out.append(text[done:low])
            begins.extend(range(done, low))
            ends.extend(range(done + 1, low + 1))
            put(_ONE[ord(match.group())], low, high)
            done = high
        out.append(text[done:])
        begins.extend(range(done, len(text)))
        ends.extend(range(done + 1, len(text) + 1))
        self.text, self.begins, self.ends = "".join(out), begins, ends
        self.changed = {i for i in range(len(self.text)) if self.ends[i] - self.begins[i] != 1 or self.text[i] != text[self.begins[i]]}
        self._again(lambda m: self._of_words(m), _STEP)
        self._again(lambda m: [(".", m.start(), m.end())], _NUMBER_DOT)
        if "@" in self.text:
            self._again(lambda m: [(".", m.start(), m.end())], _SPOKEN_DOT, in_address=True)

    @staticmethod
    def _of_words(match: re.Match) -> list[tuple[str, int, int]]:
        if match.group("mark"):
            return [("@" if re.search(r"(?i)at|@", match.group()) else ".", match.start(), match.end())]
        if match.group("spoken"):
            return [("@", match.start(), match.end())]
        if match.group("host"):
            before = _WORD_BEFORE.search(match.string[max(0, match.start() - 64) : match.start()])
            return [("@", match.start(), match.end())] if before and before.group().lower() not in PLACED else []
        if match.group("spelled"):
            return [(DIGITS[m.group().translate(_SAME).lower()], match.start() + m.start(), match.start() + m.end()) for m in _NAME.finditer(match.group())]
        return []

    def _again(self, rewrite, pattern: re.Pattern, in_address: bool = False) -> None:
        out, begins, ends, changed, done, size = [], [], [], set(), 0, 0
        reached, inside = 0, False

        def copy(low: int, high: int) -> None:
            nonlocal size
            out.append(self.text[low:high])
            begins.extend(self.begins[low:high])
            ends.extend(self.ends[low:high])
            changed.update(i - low + size for i in range(low, high) if i in self.changed)
            size += high - low

        for match in pattern.finditer(self.text):
            if in_address:
                # back over the host to its @, or to a dot that was itself rewritten
                at = match.start()
                while at > reached and self.text[at - 1] in _HOST_CHARACTERS:
                    at -= 1
                if not (at == reached and inside or at > 0 and self.text[at - 1] == "@"):
                    reached, inside = match.end(), False
                    continue
                reached, inside = match.end(), True
            new = rewrite(match)
            if not new:
                continue
            copy(done, match.start())
            for c, low, high in new:
                out.append(c)
                begins.append(self.begins[low])
                ends.append(self.ends[high - 1])
                changed.add(size)
                size += 1
            done = match.end()
        copy(done, len(self.text))
        self.text, self.begins, self.ends, self.changed = "".join(out), begins, ends, changed

    def spans(self) -> list[Span]:
        """Identifiers of the rewritten text with a rewritten character, in source offsets."""
        marks = sorted(self.changed)
        out = []
        for kind, low, high in base(self.text):
            at = bisect_right(marks, low - 1)
            # an invisible character leaves no character of its own, but its neighbours' source spans are apart
            gap = self.begins[low] + (high - low) != self.ends[high - 1]
            if gap or at < len(marks) and marks[at] < high:
                out.append((kind, self.begins[low], self.ends[high - 1]))
        return out


def find(text: str, disguised: bool = True) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by kind and start."""
    own = base(text)
    if not disguised:
        return own, own
    taken = sorted((low, high) for _, low, high in own)
    starts, reach = [low for low, _ in taken], list(accumulate((high for _, high in taken), max))
    every = list(own)
    for kind, low, high in Transducer(text).spans():
        before = bisect_left(starts, high)  # base spans that begin before the end of this one
        if not before or reach[before - 1] <= low:
            every.append((kind, low, high))
    every.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return own, every


def spelled(spans: Sequence[Span]) -> str:
    return ",".join(f"{kind}:{low}:{high}" for kind, low, high in spans)


def redact(text: str, spans: Sequence[Span]) -> str:
    """Each span replaced by its kind in brackets; overlapping spans by the kind of the first."""
    out, done = [], 0
    for kind, low, high in sorted(spans, key=lambda s: (s[1], -s[2])):
        if low < done:
            if high > done:
                done = high
            continue
        out += [text[done:low], f"<{kind}>"]
        done = high
    return "".join([*out, text[done:]])


def _triggers(texts: pa.Array) -> tuple[list[bool], list[bool], list[bool]]:
    """Which texts may hold an address sign or digits at all, or a disguise."""
    digit = pc.match_substring_regex(texts, r"[0-9]").to_pylist()
    sign = pc.match_substring(texts, "@").to_pylist()
    odd = pc.match_substring_regex(texts, TRIGGER).to_pylist()
    return digit, sign, odd


def detect(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, base array<struct<kind, start, end>>, and spans, the same for all spans."""
    ship(df.sparkSession)
    keep = list(keep)
    span = "array<struct<kind: string, start: int, end: int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_find_all(strings(batch.column(len(keep)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([as_rows(b) for _, b, _ in found], kind), pa.array([as_rows(s) for _, _, s in found], kind)], [*keep, "base", "spans"])

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, _schema_of(df, keep, f"base {span}, spans {span}"))


def _find_all(texts: pa.Array) -> Iterator[tuple[str | None, list[Span], list[Span]]]:
    for value, digit, sign, odd in zip(texts, *_triggers(texts), strict=True):
        if digit or sign or odd:
            text = value.as_py()
            yield (text, *find(text, odd))
        else:
            yield None, [], []


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind; null texts stay null."""
    ship(docs.sparkSession)
    at, names = docs.columns.index(text), docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            new = [redact(t, s) if s else None for t, _, s in _find_all(strings(column))]
            replaced = pa.array(new, column.type)
            yield pa.RecordBatch.from_arrays([pc.if_else(pc.is_valid(replaced), replaced, column) if i == at else c for i, c in enumerate(batch.columns)], names)

    return docs.mapInArrow(run, schema)


def digests(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_<kind> of the base spans, base_sha256, spans as one string, n_found of all spans."""
    ship(df.sparkSession)
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {k: [] for k in KINDS}
            sha, every, total = [], [], []
            for _, own, spans in _find_all(strings(batch.column(len(keep)))):
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in own))
                sha.append(hashlib.sha256(spelled(own).encode()).hexdigest())
                every.append(spelled(spans))
                total.append(len(spans))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(every, pa.string()), pa.array(total, pa.int64())], [*keep, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_found"])

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, _schema_of(df, keep, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_found bigint"))
