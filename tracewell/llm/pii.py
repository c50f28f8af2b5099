"""Personal data in texts, disguised or plain: emails, IP addresses, card and phone numbers, with places in the source.

Plain identifiers are found in the text as it is. Then transducers rewrite disguises one after the other: look-alike and
invisible characters, spelled at and dot, spelled digits. Each gives the list of its edits (source span, replacement), from
which every place of the rewritten text is mapped back to the span it was made from. Identifiers of the rewritten text
are mapped back through all transducers, and those that plain ones do not hold already are added.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SPANS = "array<struct<kind: int, start: long, end: long>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
Edit = tuple[int, int, str]
Span = tuple[int, int, int]

#: The grammars of plain identifiers. Quantifiers that can't give back are possessive.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether every second digit from the right, doubled, and the others have digits that sum to a multiple of ten."""
    total = sum(map(int, digits[::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for token in _DOTTED.finditer(text):
        for m in _IP.finditer(text, *token.span()) if token.end() - token.start() > 6 else ():
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) < 3 or (len(p) == 3 and int(p) <= 255) for p in parts):
                yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def plain(text: str) -> list[Span]:
    """(kind, start, end) of the identifiers of text, by kind, then start: leftmost matches, of which failing ones are dropped."""
    return [(kind, *span) for kind, find in enumerate((_emails, _ips, _cards, _phones)) for span in find(text)]


#: Characters that look like ASCII ones, beyond those that compatibility forms (wide, mathematical, circled) tell.
LOOK_ALIKES = {
    a: b
    for one, other in (
        ("аеорсухіјѕһԁԛԝѵ", "aeopcyxijshdqwv"),
        ("АВЕКМНОРСТУХІЅЈԌԚԜ", "ABEKMHOPCTYXISJGQW"),
        ("οανικρτυχω", "oavikptuxw"),
        ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
        ("օսոցıȷɡɑ", "oungijga"),
        ("۔•·", "..."),
        ("‐‑‒–—―−⁃﹣", "---------"),
        ("＿⁺", "_+"),
    )
    for a, b in zip(one, other, strict=True)
}
#: Characters without width, and the soft hyphen.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
# letters with accents, general punctuation in quotes and the like are left alone
_ODD = re.compile(r"[^\x00-\x9f\xa1-\xac\xae-\u024f\u2018-\u201f\u2026]|[\u0131\u0237]")


def _ascii(c: str) -> str:
    """What a character stands for: nothing if invisible, a character of ASCII, or itself."""
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if (digit := unicodedata.digit(c, None)) is not None:
        return str(digit)
    if c.isspace():
        return " "
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else LOOK_ALIKES.get(folded, c)


def characters(text: str) -> Iterator[Edit]:
    """Look-alike characters become ASCII, invisible ones nothing.

    Letters are rewritten only beside ASCII letters, digits or signs, or in a word of nothing but look-alikes next to an at
    sign, so that words of other scripts stay.
    """
    if text.isascii():
        return
    end = -1
    for m in _ODD.finditer(text):
        if m.start() < end:
            continue
        # the word around it
        start, end = m.span()
        while start and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        made = [_ascii(c) if not (c.isascii() or " " < c < "­") else c for c in text[start:end]]
        letters = [(c, x) for c, x in zip(text[start:end], made, strict=True) if c.isalpha()]
        foreign = sum(c == x and not c.isascii() and c > "\u024f" for c, x in letters)
        if foreign and not any(x in "@0123456789" for x in made if x):
            continue
        # a word of look-alikes alone says nothing unless signs or digits stand in it
        if letters and all(not c.isascii() for c, _ in letters) and not any(x and (x in "@.+_" or x.isdigit()) for x in made):
            made = [x if not c.isalpha() else c for c, x in zip(text[start:end], made, strict=True)]
        yield from ((start + i, start + i + 1, x) for i, (c, x) in enumerate(zip(text[start:end], made, strict=True)) if c != x)
        if end < len(text) and not text[end].isascii():
            yield end, end + 1, " "
            end += 1


_AT = r"(?:at|ät|arroba|arobase|klammeraffe)"
_DOT = r"(?:dot|punkt|point|punto)"
_GAP = r"[\x20\t]{1,3}"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_NAME = r"[A-Za-z0-9_%+-]{1,64}(?:\.[A-Za-z0-9_%+-]{1,64}){0,8}"
_SIGN = r"[\x20\t]{0,3}[(\[{<][\x20\t]{0,2}(?:(?P<at>%s|@)|(?P<dot>%s|\.))[\x20\t]{0,2}[)\]}>][\x20\t]{0,3}"
_BRACKETED = re.compile(_SIGN % (_AT, _DOT), re.IGNORECASE)
_SPOKEN = re.compile(rf"(?<![\w.%+-]){_NAME}(?:{_GAP}{_DOT}{_GAP}{_NAME}){{0,4}}{_GAP}{_AT}{_GAP}{_LABEL}(?:{_GAP}{_DOT}{_GAP}{_LABEL}|\.{_LABEL})+", re.IGNORECASE)
_SPOKEN_SIGN = re.compile(rf"{_GAP}(?:(?P<at>{_AT})|(?P<dot>{_DOT})){_GAP}", re.IGNORECASE)
_JOINED = re.compile(rf"(?<![A-Za-z0-9])[A-Za-z0-9.]{{1,64}}([_-]){_AT}\1[A-Za-z0-9-]{{1,63}}?(?:\1{_DOT}\1[A-Za-z0-9]{{1,63}})+(?![A-Za-z0-9])", re.IGNORECASE)
_JOINED_SIGN = re.compile(rf"[_-](?:(?P<at>{_AT})|(?P<dot>{_DOT}))[_-]", re.IGNORECASE)
_SPACED = re.compile(rf"(?<=[A-Za-z0-9_])[\x20\t]{{0,3}}@[\x20\t]{{0,3}}(?={_LABEL}[\x20\t]{{0,2}}\.[\x20\t]{{0,2}}[A-Za-z]{{2}})")
_SPACED_DOT = re.compile(r"(?:[\x20\t]{1,2}\.[\x20\t]{0,2}|\.[\x20\t]{1,2})(?=[a-z]{2,24}(?![A-Za-z]))")


def signs(text: str) -> Iterator[Edit]:
    """Spelled, bracketed and spaced at and dot become @ and full stop.

    Bracketed ones always do. Bare words do only in a chain name at label dot label, so that prose stays; the last
    label must be letters and no spelled dot.
    """
    edits = [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(text)] if _has_bracket(text) else []
    lower = text.lower()
    if " at " in lower or "\tat" in lower or any(w in lower for w in ("ät", "arroba", "arobase", "klammeraffe")):
        for m in _SPOKEN.finditer(text):
            inner = list(_SPOKEN_SIGN.finditer(text, *m.span()))
            last = re.split(r"[\x20\t.]", m.group())[-1]
            at = next((k for k, x in enumerate(inner) if x["at"]), None)
            if at is not None and any(x["dot"] for x in inner[at:]) and last.isalpha() and len(last) > 1 and not re.fullmatch(_DOT, last, re.IGNORECASE):
                edits += [(x.start(), x.end(), "@" if x["at"] else ".") for x in inner]
    if "at_" in lower or "at-" in lower or "ät" in lower:
        edits += [(x.start(), x.end(), "@" if x["at"] else ".") for m in _JOINED.finditer(text) for x in _JOINED_SIGN.finditer(text, *m.span())]
    if "@" in text:
        for m in _SPACED.finditer(text):
            if m.end() - m.start() > 1:
                edits.append((m.start(), m.end(), "@"))
            label = re.compile(_LABEL).match(text, m.end())
            while label and (dot := _SPACED_DOT.match(text, label.end())):
                edits.append((dot.start(), dot.end(), "."))
                label = re.compile(_LABEL).match(text, dot.end())
    end = 0
    for edit in sorted(edits):
        if edit[0] >= end:
            end = edit[1]
            yield edit


def _has_bracket(text: str) -> bool:
    return any(c in text for c in "([{<")


#: Digits by their words in the languages of the corpus.
DIGIT_WORDS = {
    w: str(d)
    for d, words in enumerate(("zero oh null zéro cero", "one eins ein un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"))
    for w in words.split()
}
SIGN_WORDS = {"dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-", "minus": "-", "plus": "+"}
TIMES = {"double": 2, "triple": 3}
_SPELLED = "|".join(sorted([*DIGIT_WORDS, *SIGN_WORDS, *TIMES], key=lambda w: (-len(w), w)))
_ELEMENT = re.compile(rf"(?:{_SPELLED})(?![^\W_])|[0-9]{{1,19}}", re.IGNORECASE)
_BETWEEN = r"[\x20\t,.()-]{1,3}"
_DICTATED = re.compile(rf"(?<![^\W_])(?:\+[\x20\t(]{{0,2}})?(?:{_SPELLED}|[0-9]{{1,19}})(?:{_BETWEEN}(?:{_SPELLED}|[0-9]{{1,19}})(?![^\W_])){{3,}}", re.IGNORECASE)
#: A dictated run has this many words of digits or signs at least.
LEAST_SPELLED = 3
_MIXED = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OoIl][0-9OoIl\x20().-]{6,40}[0-9OoIl](?![A-Za-z0-9])")
_LETTERS = {"O": "0", "o": "0", "I": "1", "l": "1"}


def digits(text: str) -> Iterator[Edit]:
    """Dictated digits become digits: runs of four elements or more, LEAST_SPELLED of them words; what separates them goes.

    Full stops and hyphens between elements stay, spelled ones become signs, double and triple repeat the next digit. In
    numbers of mostly digits the letters O, o, I and l become 0 and 1.
    """
    end = 0
    for m in _DICTATED.finditer(text):
        parts = list(_ELEMENT.finditer(text, m.start(), m.end()))
        if sum(not p.group()[0].isdigit() for p in parts) < LEAST_SPELLED or not any(p.group().lower() in DIGIT_WORDS or p.group()[0].isdigit() for p in parts):
            continue
        times, after, before = 1, None, ""
        for p in parts:
            word = p.group().lower()
            plain_digits = word[0].isdigit()
            if after is not None and not (plain_digits and before[0].isdigit()) and text[after : p.start()] not in (".", "-") and after < p.start():
                yield after, p.start(), ""
            if word in TIMES:
                yield p.start(), p.end(), ""
                times = TIMES[word]
            else:
                if not plain_digits:
                    yield p.start(), p.end(), DIGIT_WORDS.get(word, SIGN_WORDS.get(word, "")) * times
                times = 1
            after, before, end = p.end(), word, p.end()
    for m in _MIXED.finditer(text, end):
        found = m.group()
        n = sum(c.isdigit() for c in found)
        letters = [i for i, c in enumerate(found) if c in _LETTERS]
        if letters and n >= 2 * len(letters) and n >= 6:
            yield from ((m.start() + i, m.start() + i + 1, _LETTERS[found[i]]) for i in letters)


TRANSDUCERS = (characters, signs, digits)


class Rewritten:
    """A text with edits applied, and the way back: (start, end) of the new text gives the span of the old."""

    def __init__(self, text: str, edits: list[Edit]):
        out, self.new, self.old, at, n = [], [0], [(0, 0, True)], 0, 0
        for start, end, put in edits:
            if start > at:
                out.append(text[at:start])
                self.new.append(n)
                self.old.append((at, start, True))
                n += start - at
            if put:
                out.append(put)
                self.new.append(n)
                self.old.append((start, end, False))
                n += len(put)
            at = end
        out.append(text[at:])
        self.new.append(n)
        self.old.append((at, len(text), True))
        self.text = "".join(out)

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.new, start) - 1, bisect_right(self.new, end - 1) - 1
        (first, _, kept), (other, last, whole) = self.old[i], self.old[j]
        return first + (start - self.new[i]) * kept, other + (end - self.new[j]) if whole else last


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """(plain identifiers, plain and disguised ones) of text: (kind, start, end) by kind, then start, then end."""
    base = plain(text)
    steps, now = [], text
    for transducer in TRANSDUCERS:
        if edits := list(transducer(now)):
            steps.append(Rewritten(now, edits))
            now = steps[-1].text
    if not steps:
        return base, base
    spans, held = set(base), {k: sorted(x[1:] for x in base if x[0] == k) for k in range(len(KINDS))}
    for kind, start, end in plain(now):
        for step in reversed(steps):
            start, end = step.back(start, end)
        # spans of a kind do not overlap, so only the last that begins by then can hold this one
        i = bisect_right(held[kind], (start, len(text))) - 1
        if i < 0 or held[kind][i][1] < end:
            spans.add((kind, start, end))
    return base, sorted(spans)


def identifiers(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, spans) of every row: plain identifiers, and those with the disguised ones, as (kind, start, end).

    kind counts KINDS from 0; start and end count code points of the source, end is exclusive; spans are in order of kind,
    start and end. All of base is in spans; an added span may overlap plain ones but none of its kind holds it. Rows are
    taken one by one, so repeated rows and null ids stay as they are; a null text is empty and has none; an empty table
    gives an empty result; other columns do not matter, whatever their names. A text is read whole by one task.
    """

    def listed(found: list[list[Span]]) -> pa.Array:
        flat, ends = [x for spans in found for x in spans], [0]
        for spans in found:
            ends.append(ends[-1] + len(spans))
        columns = [pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_SPAN)))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                found = [scan(t.as_py() or "") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), listed([b for b, _ in found]), listed([s for _, s in found])], names=["id", "base", "spans"])

    sent = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return sent.mapInArrow(run, f"id long, base {SPANS}, spans {SPANS}").withColumnRenamed("id", id_col)
