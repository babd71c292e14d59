r"""Personal data, with offsets kept through de-obfuscation.

Two kinds of spans, both in code points of the source text, end exclusive.

*Base* spans are what four patterns find in the text as it stands, leftmost and
non-overlapping for each kind; a match that fails its check (Luhn, range, number of
digits) is dropped and its text is not searched again.

*Added* spans come from the transducers. Each is a rewriting of the text that keeps, for
every character it emits, the range of source characters that it stands for:

1. ``fold``: homoglyphs and full-width forms become ASCII; invisible characters vanish.
2. ``speak``: runs of spelled digits ("four one five", four languages) become digits,
   spoken plus and dot signs within such a run become ``+`` and ``.``.
3. ``join``: at/dot disguises ("[at]", "(dot)", " at ... dot ...") become ``@`` and ``.``.

The base detectors then run over the rewritten text, and a match that contains anything
rewritten is mapped back to the source range it covers. A bare word "at" counts only
before a host whose dots are disguised too, as prose is full of "at".

Work is in proportion to the text: a rewriting is kept as runs of copied and replaced
characters, as many as there are edits, and disguises are looked for from the end of each
dotted name, which no other name shares.

Nulls count as empty texts; an empty text has no spans. Rows that repeat are treated each
on its own. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame

from chronofold.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match takes whole runs of digits, so none starts after a digit.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
# Shorter runs would be dropped in any case.
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """The base detectors, over any text."""
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _HOST.match(text, at + 1)):
            found.append((first, 0, m.end()))
            done = m.end()
        else:
            done = at + 1  # no local part reaches back over an "@"
        at = text.find("@", max(done, at + 1))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
        found.sort()
    return found


# Letters of other scripts that look like ASCII ones.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɑ": "a", "ɡ": "g", "ı": "i", "․": ".", "﹒": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "﹫": "@", "﹢": "+", " ": " ", " ": " ", " ": " ",
}
# Characters that show nothing.
_INVISIBLE = "­​‌‍⁠﻿"
FOLD: dict[str, str] = _LOOKALIKES | dict.fromkeys(_INVISIBLE, "") | {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
for _first in (0x0660, 0x06F0, 0x0966, *range(0x1D7CE, 0x1D800, 10)):  # digits of other scripts and styles
    FOLD |= {chr(_first + d): str(d) for d in range(10)}
_FOLDED = re.compile("[" + "".join(map(re.escape, FOLD)) + "]")

# The digits 0 to 9 as words, in English, French, German and Spanish.
_DIGIT_WORDS = (
    "zero zéro null cero", "one un eins uno", "two deux zwei dos", "three trois drei tres", "four quatre vier cuatro",
    "five cinq fünf cinco", "six sechs seis", "seven sept sieben siete", "eight huit acht ocho", "nine neuf neun nueve",
)
SPELLED = {w: str(d) for d, ws in enumerate(_DIGIT_WORDS) for w in ws.split()} | {"oh": "0"}
_W = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_SIGN = "(?:dot|point|punkt|punto)"
#: Two spelled digits at least, among digits, spoken dots and a leading plus.
_UNIT = rf"(?:{_W}|[0-9]+)"
_SPOKEN = re.compile(rf"(?<!\w)(?:(?:plus|más|\+)[ -]?)?{_UNIT}(?:(?:[ ,-]{{1,2}}|[ ]?\.[ ]?|[ ]{_SIGN}[ ]){_UNIT})+(?!\w)", re.I)
_SPOKEN_HINT = re.compile(rf"(?<!\w){_W}(?:[ ,-]{{1,2}}|[ ]{_SIGN}[ ]){_W}(?!\w)", re.I)
_PIECE = re.compile(rf"(?P<w>{_W})|(?P<d>[0-9]+)|(?P<dot>{_SIGN}|\.)|(?P<plus>plus|más|\+)|(?P<gap>[ ,-]+)", re.I)

_AT = r"(?:at|arroba|chez)"
_DOT = _SIGN
_O, _C = r"[ ]?[\[({<][ ]?", r"[ ]?[\])}>][ ]?"
_MARK_HINT = re.compile(rf"[\[({{<][ ]?(?:{_AT}|{_DOT}|@|\.)[ ]?[\])}}>]|[ ]{_DOT}[ ]|[ ]@|@[ ]", re.I)
_NAME = r"[A-Za-z0-9_%+-]+"
_LABEL = r"[A-Za-z0-9-]+"
_ATS = rf"(?:{_O}(?:{_AT}|@){_C}|[ ]?@[ ]?)"
_DOTS = rf"(?:{_O}(?:{_DOT}|\.){_C}|[ ]{_DOT}[ ]|\.)"
_LOUD_DOTS = rf"(?:{_O}(?:{_DOT}|\.){_C}|[ ]{_DOT}[ ])"
#: A dotted name, as long as it gets; the sign after it; what has to follow a sign that is marked, and one that is a bare word.
_RUN = re.compile(rf"{_NAME}(?:{_DOTS}{_NAME})*", re.I)
_SIGN_AT = re.compile(_ATS, re.I)
_BARE_AT = re.compile(rf"[ ]{_AT}[ ]", re.I)
_AFTER_SIGN = re.compile(rf"{_LABEL}(?:{_DOTS}{_LABEL})*{_DOTS}[A-Za-z]{{2,}}(?![A-Za-z0-9])", re.I)
_AFTER_BARE = re.compile(rf"{_LABEL}(?:{_LOUD_DOTS}{_LABEL})*{_LOUD_DOTS}[A-Za-z]{{2,}}(?![A-Za-z0-9])", re.I)
_MARK = re.compile(rf"(?P<at>{_O}(?:{_AT}|@){_C}|[ ]{_AT}[ ]|[ ]?@[ ]?)|(?P<dot>{_LOUD_DOTS})", re.I)


def marked(text: str) -> Iterator[tuple[int, int]]:
    """The places of addresses, disguised or not; each name starts or ends one at most."""
    done = 0
    for run in _RUN.finditer(text):
        if run.start() >= done and (run.start() == 0 or text[run.start() - 1] not in _LOCAL):
            for sign, after in ((_SIGN_AT, _AFTER_SIGN), (_BARE_AT, _AFTER_BARE)):
                if (at := sign.match(text, run.end())) and (m := after.match(text, at.end())):
                    done = m.end()
                    yield run.start(), done
                    break


class Tape:
    """A text and the source ranges its characters stand for, as runs.

    A run (first character of the text, source start, source end) is copied, character by
    character, or put in place of its whole source range. Characters that were deleted have no run.
    """

    def __init__(self, text: str, at: list[int] | None = None, runs: list[tuple[int, int, bool]] | None = None):
        self.text = text
        self.at = [0] if at is None else at
        self.runs = [(0, len(text), False)] if runs is None else runs

    def source(self, a: int, b: int) -> tuple[int, int, bool]:
        """Where characters a to b come from, and whether anything in between was rewritten."""
        i, j = bisect_right(self.at, a) - 1, bisect_left(self.at, b) - 1
        first, stop, new = self.runs[i]
        start = first if new else first + a - self.at[i]
        first, stop, last = self.runs[j]
        end = stop if last else first + b - self.at[j]
        return start, end, i != j or new

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Edits (start, end, replacement) in order; a replacement's characters share the whole range."""
        parts, at, runs, n, done = [], [], [], 0, 0
        for a, b, put in [*edits, (len(self.text), len(self.text), "")]:
            i = bisect_right(self.at, done) - 1
            while done < a:
                stop = min(a, self.at[i + 1] if i + 1 < len(self.at) else len(self.text))
                first, last, new = self.runs[i]
                at.append(n)
                runs.append((first, last, True) if new else (first + done - self.at[i], first + stop - self.at[i], False))
                parts.append(self.text[done:stop])
                n += stop - done
                done, i = stop, i + 1
            if put:
                at.append(n)
                runs.append((*self.source(a, b)[:2], True))
                parts.append(put)
                n += len(put)
            done = b
        return Tape("".join(parts), at, runs)


def fold(tape: Tape) -> Tape:
    edits = [(m.start(), m.end(), FOLD[m[0]]) for m in _FOLDED.finditer(tape.text)]
    return tape.rewrite(edits) if edits else tape


def speak(tape: Tape) -> Tape:
    edits = []
    for m in _SPOKEN.finditer(tape.text):
        if not _SPOKEN_HINT.search(m[0]):
            continue
        for p in _PIECE.finditer(m[0]):
            kind, a, b = p.lastgroup, m.start() + p.start(), m.start() + p.end()
            if kind != "d":
                put = {"w": SPELLED.get(p[0].lower(), ""), "dot": ".", "plus": "+", "gap": ""}[kind]
                edits.append((a, b, put))
    return tape.rewrite(edits) if edits else tape


def join(tape: Tape) -> Tape:
    edits = []
    for a, b in marked(tape.text):
        edits += [(p.start(), p.end(), "@" if p.lastgroup == "at" else ".") for p in _MARK.finditer(tape.text, a, b)]
    return tape.rewrite(edits) if edits else tape


def disguised(text: str) -> list[Span]:
    """The spans that only the transducers bring out, in source offsets."""
    folded = not text.isascii() and _FOLDED.search(text)
    tape = fold(Tape(text)) if folded else None
    plain = tape.text if tape else text
    said, hinted = _SPOKEN_HINT.search(plain), _MARK_HINT.search(plain)
    if not (folded or said or hinted):
        return []
    tape = tape or Tape(text)
    tape = speak(tape) if said else tape
    tape = join(tape) if hinted else tape
    found = []
    if len(tape.runs) > 1 or len(tape.text) != len(text):
        for a, kind, b in detect(tape.text):
            start, end, new = tape.source(a, b)
            if new:  # a match of copied characters only is a base span, unless something in it was deleted
                found.append((start, kind, end))
    return found


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """The base spans, and those the method adds, each by start and kind."""
    base = detect(text or "")
    return base, sorted(set(disguised(text or "")) - set(base))


def _said(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _columns(texts: list[str | None]) -> dict[str, list]:
    out: dict[str, list] = {c: [] for c in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_total")}
    for t in texts:
        base, added = spans(t)
        kinds = [k for _, k, _ in base]
        for i, k in enumerate(KINDS):
            out[f"n_{k}"].append(kinds.count(i))
        out["base_sha256"].append(hashlib.sha256(_said(base).encode()).hexdigest())
        out["spans"].append(_said(sorted(base + added)))
        out["n_added"].append(len(added))
        out["n_total"].append(len(base) + len(added))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: the id, base counts by kind, the digest of the base spans, all spans, the numbers added and in all."""
    schema = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, n_total long"
    return map_texts(docs, _columns, schema, keep=(id_col,), text=text_col)


def redact(text: str | None, mark: str = "<{}>") -> str | None:
    """The text with every span replaced by its kind; overlapping spans go as one, under the first one's kind."""
    if text is None:
        return None
    out, at = [], 0
    for a, k, b in sorted(sum(spans(text), [])):
        if a >= at:
            out += [text[at:a], mark.format(KINDS[k])]
        at = max(at, b)
    return "".join(out) + text[at:]
