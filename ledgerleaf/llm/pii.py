"""Operator 3: personal data behind disguises, with spans in the source text.

Detectors run on the text as it stands (the base spans) and on a normalised copy, which
transducers make: look-alike and non-ASCII characters become ASCII (one for one), spelled digits
become digits, and written-out ``at`` / ``dot`` become ``@`` / ``.``.  Each transducer records
which source characters a normalised character stands for, so spans found there are mapped back.
A mapped span is added if it takes in something normalised and every base span of its kind lies beside
or within it.

Null and empty texts have no spans; repeated rows and null ids are reported row by row; other
columns are ignored.  Very long texts take time in proportion to their length.  Spans are ordered by
kind, then start; of those that overlap only in part the base span counts.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table
from .secrets import SPANS

KINDS = ("email", "ip", "card", "phone")

# --- detectors; possessive repeats keep them linear on long runs of digits or letters

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_BACKWARDS = re.compile(r"[A-Za-z0-9._%+-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        # The local part is the run of its characters before the sign, not before the last match.
        low, size = at, 64
        while True:
            low = max(done, at - size)
            run = _LOCAL_BACKWARDS.match(text[low:at][::-1]).end()
            if run < at - low or low == done:
                break
            size *= 8
        if run and (m := _DOMAIN.match(text, at + 1)):
            out.append((at - run, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return s.translate(_NO_MARKS)


_NO_MARKS = str.maketrans("", "", "+ ().-")


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                out.append((3, *m.span()))
    return out


# --- transducers

#: Letters of other scripts that look like ASCII letters.
_LOOKALIKES = "аaеeоoрpсcхxуyіiјjѕsԁdһhӏlАAВBЕEКKМMНHОOРPСCТTХXУYІIЈJЅSαaοoνvρpυuιiκkΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧX"
_MARKS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "﹒": ".", " ": " ", " ": " ", " ": " "}


@functools.cache
def lookalikes() -> dict[int, str]:
    """Every character that stands for one ASCII character, by Unicode's own tables."""
    out = {}
    for code in range(0x80, 0x20000):
        c = chr(code)
        if (d := unicodedata.decimal(c, None)) is not None:
            out[code] = str(d)
        elif unicodedata.category(c) in ("Lo", "Lu", "Ll", "Nd", "No", "Po", "Pd", "Sm", "Ps", "Pe", "So", "Zs"):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and " " <= plain <= "~":
                out[code] = plain
    out |= {ord(a): b for a, b in zip(_LOOKALIKES[::2], _LOOKALIKES[1::2])}
    return out | {ord(a): b for a, b in _MARKS.items()}


_WORDS = {w: str(d) for d, names in enumerate(("zero|oh|null", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")) for w in names.split("|")}
_SPELLED = "(?:" + "|".join(_WORDS) + ")"
_UNIT = rf"(?:{_SPELLED}|[0-9]++)"
_TOP = "(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|eu|us)"
_RULES = re.compile(
    rf"""(?P<gone>[​-‍⁠﻿­]+)
    |(?P<at>(?<=[a-z0-9._%+-])\s?[\[({{<]\s?(?:at|@)\s?[\])}}>]\s?(?=[a-z0-9]))
    |(?P<dot>(?<=[a-z0-9])\s?[\[({{<]\s?(?:dot|\.)\s?[\])}}>]\s?(?=[a-z0-9]))
    |(?P<words>(?<=[a-z0-9._%+-])\ at\ (?=[a-z0-9-]+(?P<spelled>\ dot\ [a-z0-9-]+)+|[a-z0-9-]+(?:\.[a-z0-9-]+)*\.{_TOP}\b))
    |(?P<point>(?<=[a-z0-9])\ dot\ (?=[a-z0-9]))
    |(?P<run>(?<![a-z0-9])(?:plus\ |\+\ ?)?{_UNIT}(?:[ ,.-]{{1,2}}{_UNIT})+(?![a-z0-9]))
    |(?P<twisted>(?<![a-z0-9])(?=[0-9oli]*[0-9])[0-9oli]{{3,}}(?![a-z0-9]))""",
    re.X | re.I | re.A,
)
_HINT = re.compile(rf"[\[({{<]\s?(?:at|dot|@|\.)\s?[\])}}>]| at | dot |[​-‍⁠﻿­]|{_SPELLED}[ ,.-]{{1,2}}{_UNIT}|[0-9][ ,.-]{{1,2}}{_SPELLED}|[0-9][oli]|[oli][0-9]", re.I | re.A)
_PART = re.compile(rf"(plus|\+)\ ?|({_SPELLED})(?:[ ,.-]{{1,2}}(?={_SPELLED}))?", re.I | re.A)
_TWIST = str.maketrans("oOlIiL", "001111")
#: What a word before a plain `` at `` must have to be taken for the local part of an address.
_LOCAL_MARK = re.compile(r"[0-9._%+-]")


def _rewrite(m: re.Match) -> str | None:
    kind, found = m.lastgroup, m.group()
    if kind == "gone":
        return ""
    if kind == "at":
        return "@"
    if m["words"] is not None:
        # In prose people are, meet and work "at example.com": only a spelled dot, or a word that is
        # no plain one, tells an address.
        word = m.string[max(0, m.start() - 64) : m.start()].rpartition(" ")[2]
        return "@" if m["spelled"] is not None or _LOCAL_MARK.search(word) else None
    if kind in ("dot", "point"):
        return "."
    if kind == "twisted":
        return found.translate(_TWIST) if 2 * sum(map(str.isdigit, found)) >= len(found) and not found.isdigit() else None
    # Spelled digits that stand together become one number; figures and their separators stay.
    new = _PART.sub(lambda x: "+" if x[1] else _WORDS[x[2].lower()], found)
    return new if new != found else None


class Mapped:
    """A normalised text and, piece by piece, the source characters that it stands for."""

    def __init__(self, source: str):
        text = source if source.isascii() else source.translate(lookalikes())
        pieces, self.at, self.src, self.changed = [], [0], [0], [False]
        here = done = 0

        def put(piece: str, start: int, changed: bool) -> None:
            nonlocal here
            self.at.append(here)
            self.src.append(start)
            self.changed.append(changed)
            pieces.append(piece)
            here += len(piece)

        if _HINT.search(text):
            for m in _RULES.finditer(text):
                new = _rewrite(m)
                if new is not None:
                    put(text[done : m.start()], done, False)
                    put(new, m.start(), True)
                    done = m.end()
        put(text[done:], done, False)
        self.text, self.source, self.plain = "".join(pieces), source, text
        self.changes = self.text != source

    def span(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a = self.src[i] if self.changed[i] else self.src[i] + start - self.at[i]
        # A changed piece ends where the next piece starts in the source.
        b = self.src[j + 1] if self.changed[j] else self.src[j] + end - self.at[j]
        return a, b


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) by kind and start."""
    base = [(*x, True) for x in detect(text)]
    if text.isascii() and not _HINT.search(text):
        return base
    mapped = Mapped(text)
    if not mapped.changes:
        return base
    more = []
    for kind, start, end in detect(mapped.text):
        a, b = mapped.span(start, end)
        # Beside the base spans, or one of them and more.
        beside = all(k != kind or e <= a or b <= s or (a <= s and e <= b and (a, b) != (s, e)) for k, s, e, _ in base)
        if beside and text[a:b] != mapped.text[start:end]:
            more.append((kind, a, b, False))
    return sorted(base + more) if more else base


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans in code points of each text of (doc_id, text), by kind and then start."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in spans(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SPANS)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest

    found = find_pii(table(spark, sf_dir, "documents"))
    return digest(found, KINDS, {"n_spans": F.size("spans").cast("long")})
