"""Personal data in whole texts, plain or disguised, with spans in the source text.

Plain identifiers are found by fixed patterns. For disguised ones, small transducers
rewrite the text and remember for each rewritten place where it came from: look-alike
characters and character references become ASCII, invisible ones vanish, spelled digits become
digits, and `at` and `dot` in brackets, words or odd signs become signs. The same patterns run over the rewritten text, and
what touches a rewritten place is mapped back to its span in the source.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from termweave.llm.common import map_texts, strings

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
DIGITS = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Look-alikes of ASCII letters in other scripts (fixed values); full-width and styled forms follow by rule.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТУХІЈЅαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlABEKMHOPCTYXIJSaopvikABEZHIKMNOPTYX", strict=True))
LOOKALIKES |= dict(zip("ԛԝүѵᴦՏՍՕսօոհցքյⅼ", "qwyvrSUOuonhgpjl", strict=True))
#: Names of Latin letters that look like a plain one: with marks, script, dotless and so on, small capitals, Greek names.
LATIN = re.compile(r"LATIN (?P<size>SMALL|CAPITAL) LETTER (?:(?:SCRIPT|DOTLESS|LONG|OPEN|BARRED|BLACKLETTER) )?(?P<letter>[A-Z]|ALPHA|IOTA)(?: WITH .*)?|LATIN LETTER SMALL CAPITAL (?P<capital>[A-Z])")
#: Characters that show nothing (fixed values).
INVISIBLE = "­​‌‍⁠﻿"
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_WORD = "|".join(SPELLED)
TIMES = {"double": 2, "triple": 3, "treble": 3}
_TIMES = rf"(?:{'|'.join(TIMES)})[\s-]+"
SPELLED_RUN = re.compile(rf"(?i)\b(?:plus\s+)?(?:{_WORD})(?:(?:[\s,-]+|\s*[\[({{]?\bdot\b[\])}}]?\s*)(?:{_WORD})\b){{3,}}")
SPELLED_PART = re.compile(rf"(?i)\b(plus|dot|{_WORD})\b|[\[({{\])}}\s,-]+")
#: Spelled digits and numerals in any mixture; `dot` in words or brackets may stand between them.
_ALONE = r"(?<![^\W\d_])(?:{})(?![^\W\d_])"
_DIGIT, _GAP_DOT = rf"(?:{_ALONE.format(f'(?:{_TIMES})?(?:{_WORD})')}|{_ALONE.format(f'{_TIMES}[0-9]')}(?![0-9])|[0-9]++)", rf"\s*+(?:[\[({{]\s*+)?{_ALONE.format('dot')}\s*+(?:[\])}}]\s*+)?"
MIXED_RUN = re.compile(rf"(?i)(?:(?:{_ALONE.format('plus')}|\+)[\s(]*)?{_DIGIT}(?:(?:{_GAP_DOT}|[\s,()-]++|\.)?{_DIGIT})+")
MIXED_PART = re.compile(rf"(?i)(?P<plus>plus)|(?P<dot>{_GAP_DOT})|(?P<word>(?:{_TIMES})?(?:{_WORD})|{_TIMES}[0-9])|(?P<number>[0-9]+)|(?P<gap>[\s,()-]+)")
_AT, _DOT = r"\s*[\[({<]\s*at\s*[\])}>]\s*", r"\s*[\[({<]\s*(?:dot|punto|punkt|point)\s*[\])}>]\s*"
#: Signs that stand for a dot where the domain has no dot of its own.
_ODD_DOT = r"\s*[\u00B7\u2022\u30FB\u3002\uFF61\u06D4]\s*"
#: A dot between spaces counts before these last labels only (fixed values); elsewhere it ends a sentence.
_APART = r"\s+\.\s+(?=(?:[A-Z0-9-]+\s+\.\s+){0,8}(?:com|org|net|edu|gov|mil|int|info|biz)(?![A-Z0-9-]))"
#: A bracketed `at`, or an `at` in words that is followed by a `dot` in words or brackets.
DISGUISED = re.compile(rf"(?i)(?<=[A-Z0-9])(?:(?P<at>{_AT}|\s*@\s*)|(?P<word>\s+at\s+))(?P<name>[A-Z0-9-]+)(?P<rest>(?:(?:{_DOT}|\s+dot\s+|{_APART}|{_ODD_DOT}|\.)[A-Z0-9-]+)+)")
#: A disguised dot of the local part, read backwards.
LOCAL_DOT = re.compile(r"(?i)(?:\s*[\])}>]\s*(?:tod|otnup|tknup|tniop)\s*[\[({<]\s*|\s+tod\s+)(?=[A-Z0-9])")
LOCAL_RUN = re.compile(r"(?i)[A-Z0-9._%+-]+")
#: A domain in words alone is prose if it starts or ends with one of these, or ends like a compound of `dot` (fixed values). Two letters are a country.
PROSE = frozenset(
    "the this that these those each every any all some another its his her our their your what which whatever one once least most first last best worst and but for nor yet with from into onto over under then than"
    " when where while who whose was were are has had have not you she they can could will would should may might must been being just also only".split()
)
PROSE_LAST = PROSE | {"matrix", "product", "products", "plot", "plots", "notation"}
LABEL = re.compile(r"[a-z]{2,}|xn--[a-z0-9-]+")
DOT = re.compile(rf"(?i){_DOT}|\s+dot\s+|\s+\.\s+|(?P<odd>{_ODD_DOT})")
BEYOND, BEYOND_LATIN = re.compile("[^\x00-\x7f]"), re.compile("[^\x00-\u00AC\u00AE-\u024F]")
#: A character reference, or an escaped at sign between letters.
REFERENCE = re.compile(r"(?i)&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|commat|period|plus|lowbar|nbsp|zwnj|zwj|shy);|(?<=[a-z0-9])(?P<escape>%40)(?=[a-z0-9])")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The pattern's leftmost non-overlapping matches, found from each `@`: what is before it is a run of the local part's characters."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def plain_spans(text: str) -> list[tuple[int, str, int]]:
    """`(start, kind, end)` of plain identifiers, by start and kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


class Rewritten:
    """A text with some places replaced, and the way back from its positions to the source's."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.new, self.old, self.size, at, made = [], [], [], [], 0, 0
        for start, end, by in edits:
            parts += [text[at:start], by]
            made += start - at
            self.new.append(made)
            self.old.append((start, end))
            self.size.append(len(by))
            made += len(by)
            at = end
        parts.append(text[at:])
        self.text = "".join(parts)

    def source(self, position: int, is_end: bool) -> int:
        """Source position of a position of the rewritten text; inside a replacement, the edge of what it replaces."""
        i = bisect.bisect_left(self.new, position) - 1 if is_end else bisect.bisect_right(self.new, position) - 1
        if i < 0:
            return position
        inside = position - self.new[i]
        start, end = self.old[i]
        if inside < self.size[i] or is_end and inside == self.size[i]:
            return end if is_end else start
        return end + inside - self.size[i]

    def touched(self, start: int, end: int) -> bool:
        """Whether a replacement lies in the span."""
        i = bisect.bisect_left(self.new, start)
        return i < len(self.new) and self.new[i] < end


#: Without one of these a text has no address, plain or disguised.
ADDRESS = re.compile(r"(?i)[@\uFE6B\uFF20]|%40|&(?:#0*64|#x0*40|commat);|dot|[\[({<]\s*(?:at|punto|punkt|point)(?![a-z])")


class Plain(dict):
    """What a character beyond ASCII is rewritten to: one ASCII character, nothing, or itself."""

    def __missing__(self, c: str) -> str:
        by = "" if c in INVISIBLE else LOOKALIKES.get(c)
        if by is None:
            by = unicodedata.normalize("NFKC", c)
            if len(by) == 1 and not by.isascii() and by.isdigit():
                by = str(unicodedata.digit(by))
            if not by.isascii() and (named := LATIN.fullmatch(unicodedata.name(by[0], ""))):
                letter = (named["capital"] or named["letter"])[0]
                by = letter if named["size"] == "CAPITAL" else letter.lower()
            if len(by) != 1 or not by.isascii():
                by = LOOKALIKES.get(by, c)
        self[c] = by
        return by


PLAIN = Plain()


def _character_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    if not text.isascii():
        # Letters with marks matter in addresses only; most texts have none.
        pattern = BEYOND if ADDRESS.search(text) else BEYOND_LATIN
        out = [(m.start(), m.end(), by) for m in pattern.finditer(text) if (by := PLAIN[m[0]]) != m[0]]
    if "&" in text or "%40" in text:
        for m in REFERENCE.finditer(text):
            c = "@" if m["escape"] else html.unescape(m[0])
            by = PLAIN[c] if len(c) == 1 and not c.isascii() else c
            if by == "" or len(by) == 1 and by.isascii():
                out.append((m.start(), m.end(), by))
        out.sort()
    return out


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    """Runs of spelled digits alone."""
    out = []
    for run in SPELLED_RUN.finditer(text):
        for m in SPELLED_PART.finditer(text, run.start(), run.end()):
            word = (m[1] or "").lower()
            out.append((m.start(), m.end(), "+" if word == "plus" else "." if word == "dot" else SPELLED.get(word, "")))
    return out


def _digits(word: str) -> str:
    """A spelled digit, as often as a word before it says."""
    *times, digit = re.split(r"[\s-]+", word.lower())
    return SPELLED.get(digit, digit) * (TIMES[times[0]] if times else 1)


def _mixed_edits(text: str) -> list[tuple[int, int, str]]:
    """Runs of spelled digits and numerals that hold an identifier when rewritten. What is between two numerals stays."""
    out = []
    for run in MIXED_RUN.finditer(text):
        if run[0].isascii() and not any(c.isalpha() for c in run[0]):
            continue
        parts, edits = list(MIXED_PART.finditer(text, run.start(), run.end())), []
        for i, m in enumerate(parts):
            kind = m.lastgroup
            if kind == "gap":
                near = [parts[k] if 0 <= k < len(parts) else None for k in (i - 1, i + 1)]
                if near[0] and all(x and x.lastgroup == "number" for x in near):
                    continue
                joined = not near[0] or near[0].lastgroup == "plus" or all(x and (x.lastgroup == "word" or len(x[0]) == 1) for x in near)
                edits.append((m.start(), m.end(), "" if joined else " "))
            elif kind != "number":
                edits.append((m.start(), m.end(), "+" if kind == "plus" else "." if kind == "dot" else _digits(m[0])))
        moved = [(a - run.start(), b - run.start(), by) for a, b, by in edits]
        if plain_spans(Rewritten(run[0], moved).text):
            out += edits
    return out


def _in_words(name: str, rest: str) -> bool:
    """Whether `name` and `rest`, after an `at` in words, are a domain and not prose."""
    last = re.split(r"[^A-Za-z0-9-]+", rest)[-1].lower()
    if len(last) == 2:
        return True
    if not LABEL.fullmatch(last):
        return False
    return any(c in "[({<" for c in rest) or name.lower() not in PROSE and last not in PROSE_LAST


def _address_edits(text: str) -> list[tuple[int, int, str]]:
    out, back = [], None
    for m in DISGUISED.finditer(text):
        dotted = any(not m["word"] or any(c.isalpha() for c in d[0]) for d in DOT.finditer(m["rest"]))
        if m["word"] and not dotted or m["at"] == "@" and not dotted:
            continue
        whole = "." in m["rest"]  # a domain with a dot of its own ends before an odd one
        if m["word"] and not _in_words(m["name"], m["rest"]):
            continue
        sign = "at" if m["at"] else "word"
        out.append((m.start(sign), m.end(sign), "@"))
        out += [(m.start("rest") + d.start(), m.start("rest") + d.end(), ".") for d in DOT.finditer(m["rest"]) if not (whole and d["odd"])]
        back = back or text[::-1]
        size, at = len(text), len(text) - m.start()
        while (part := LOCAL_RUN.match(back, at)) and (d := LOCAL_DOT.match(back, part.end())):
            out.append((size - d.end(), size - d.start(), "."))
            at = d.end()
    return out


def _in_order(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits by place; of overlapping ones the first."""
    clean, done = [], -1
    for edit in sorted(set(edits)):
        if edit[0] >= done:
            clean.append(edit)
            done = edit[1]
    return clean


def _word_edits(text: str) -> list[list[tuple[int, int, str]]]:
    """The ways to rewrite the words of a text: digits in mixed runs, and where that differs spelled ones alone."""
    lower = text.lower()
    mixed, spelled, address = [], [], []
    if "dot" in lower or any(w in lower for w in SPELLED) or "plus" in lower:
        mixed, spelled = _mixed_edits(text), _spelled_edits(text)
    if "dot" in lower or "@" in text or "at" in lower and any(c in text for c in "[({<"):
        address = _address_edits(text)
    ways = [_in_order(mixed + address)]
    if not set(spelled) <= set(mixed):
        ways.append(_in_order(spelled + address))
    return ways


def disguised_spans(text: str) -> list[tuple[int, str, int]]:
    """`(start, kind, end)` of identifiers that only the rewritten text shows."""
    characters = _character_edits(text)
    first = Rewritten(text, characters) if characters else None
    middle = first.text if first else text
    out = []
    for edits in _word_edits(middle):
        if not edits and not first:
            continue
        second, found = Rewritten(middle, edits), []
        for start, kind, end in plain_spans(second.text):
            a, b = second.source(start, False), second.source(end, True)
            touched = second.touched(start, end)
            if first:
                touched = touched or first.touched(a, b)
                a, b = first.source(a, False), first.source(b, True)
            if touched:
                found.append((a, kind, b))
        out += [x for x in found if not any(y[0] < x[2] and x[0] < y[2] and x[1] == y[1] for y in out)]
    return out


def all_spans(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Plain spans; and those together with disguised ones."""
    plain = plain_spans(text)
    more = set(disguised_spans(text)) - set(plain)
    order = {k: i for i, k in enumerate(KINDS)}
    return plain, sorted([*plain, *more], key=lambda s: (s[0], order[s[1]], s[2])) if more else plain


SPANS = "array<struct<kind: string, start: int, end: int>>"


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `plain` and `spans` (plain and disguised), arrays of (kind, start, end), to every row.

    Positions count code points of the whole text, end exclusive, by start and then by
    kind in the order email, ip, card, phone. Null and empty texts have none. Spans of
    different kinds may overlap. Columns of the two names are replaced.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> dict:
        found = [all_spans(t) for t in strings(batch, text)]
        return {name: pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in f[i]] for f in found], kind) for i, name in enumerate(("plain", "spans"))}

    return map_texts(docs, text, run, f"plain {SPANS}, spans {SPANS}")


def redacted(text: str | None) -> str | None:
    """The text with `<KIND>` for each identifier; overlapping ones become one, of the first's kind."""
    if not text:
        return text
    out, at = [], 0
    for start, kind, end in all_spans(text)[1]:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with identifiers replaced in the text; null stays null."""
    return map_texts(docs, text, lambda batch: {text: pa.array([redacted(t) for t in batch.column(text).to_pylist()], pa.string())}, f"`{text}` string").select(*docs.columns)
