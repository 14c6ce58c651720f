"""Personal data with offset-preserving deobfuscation.

Base spans follow four fixed patterns (email, ip, card, phone), leftmost and
non-overlapping for each kind, then a check of each match without retries.

A chain of transducers then rewrites the text, every output character carrying
the source range it came from:

1. fold: full-width forms, homoglyph letters and Unicode digits become ASCII,
   zero-width characters vanish;
2. digits: runs of three or more spelled digits become digits;
3. marks: "(at)", "[dot]" and the bare words between identifier-like neighbours
   become "@" and "."; a bare word does if the other mark of the address is there
   in any form, and bare "dot" between four groups of digits does, too.

Detection on the rewritten text finds disguised identifiers, and their spans are
mapped back.  A span is added only if it covers a rewritten place and isn't inside
a base span, so texts without disguises keep exactly their base spans, and base
spans always stay.  It may extend a base span, where a disguise hides only a part;
redaction covers the union.

Matching is linear in the text: digit runs are matched possessively and emails
only around their "@".

Defined results
* null text: empty.  Null ids and repeated rows: a row each, treated alike.
* very long texts: whole, linear.  Empty table: no rows.
* offsets are code points, the end exclusive.  Other columns take no part.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four fixed patterns, ordered by start, then kind as listed."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _ANY_DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append(("phone", m.start(), m.end()))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


# --- transducers ----------------------------------------------------------

# fixed values: letters of other scripts that look like a Latin letter
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХУІЈЅαοεινρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTXYIJSaoeivptuxABEZHIKMNOPTYX", strict=True))
ZERO_WIDTH = frozenset("\u200b\u200c\u200d\u2060\ufeff\u00ad")
# fixed values: spelled digits
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "plus": "+"}
# German, French and Spanish; a run is in one language
_SPELLED_BY = [
    SPELLED,
    {"null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "plus": "+"},
    {"zéro": "0", "zero": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "six": "6", "sept": "7", "huit": "8", "neuf": "9", "plus": "+"},
    {"cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "más": "+", "mas": "+"},
]
# fixed values: at and dot in words
_AT, _DOT = ("at", "arroba"), ("dot", "punto", "punkt", "point")

_SPELLED_RUNS = [(re.compile(r"(?i)\b(?:%s)\b(?:[ \-.,]{1,2}(?:%s)\b){2,}+" % (("|".join(words),) * 2)), words) for words in _SPELLED_BY]
_SPELLED_ONE = re.compile(r"(?i)[^\W\d_]+")
_MARK = {
    "@": re.compile(r"(?i) ?[(\[{<] ?(?:%s|@) ?[)\]}>] ?" % "|".join(_AT)),
    ".": re.compile(r"(?i) ?[(\[{<] ?(?:%s|\.) ?[)\]}>] ?" % "|".join(_DOT)),
}
_BARE_AT = re.compile(r"(?i) (?:%s) " % "|".join(_AT))
_BARE_DOT = re.compile(r"(?i) (?:%s) " % "|".join(_DOT))
# either mark may be there already; where all are, there is nothing to rewrite
_ANY_AT = re.compile(r"(?i) (?:%s) |@" % "|".join(_AT))
_DOT_MARK = re.compile(r"(?i) (?:%s) |\." % "|".join(_DOT))
_LABEL = re.compile(r"[A-Za-z0-9-]++")
_LEFT_DOTS = tuple(f" {w} " for w in _DOT)
_BARE_IP = re.compile(r"(?i)(?<![\w.])[0-9]{1,3}+(?:(?: (?:%s) |\.)[0-9]{1,3}+){3}(?!\w)" % "|".join(_DOT))
_PLAIN_DOMAIN = re.compile(r"(?i) (?:%s) [a-z0-9-]++\.[a-z0-9]" % "|".join(_AT))
_TOP = re.compile(r"[a-z]{2,24}|[A-Z]{2,24}")
_DISGUISE = re.compile(r"(?i)[(\[{<] ?(?:%s|[@.]) ?[)\]}>]| (?:%s) " % ("|".join(_AT + _DOT), "|".join(_DOT)))


class Tape:
    """A text whose every character knows its source range and if it was rewritten."""

    __slots__ = ("chars", "start", "end", "new")

    def __init__(self, text: str):
        self.chars = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.new = bytearray(len(text))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply ordered, disjoint (from, to, output) edits in one pass."""
        if not edits:
            return
        chars, start, end, new, at = [], [], [], bytearray(), 0
        for a, b, out in edits:
            chars.append(self.chars[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            new += self.new[at:a]
            if out:
                chars.append(out)
                start += [self.start[a]] * len(out)
                end += [self.end[b - 1]] * len(out)
                new += b"\x01" * len(out)
            elif len(new):
                new[-1] = 1  # something vanished after this character
            at = b
        chars.append(self.chars[at:])
        start += self.start[at:]
        end += self.end[at:]
        new += self.new[at:]
        self.chars, self.start, self.end, self.new = "".join(chars), start, end, new


def _folded(c: str) -> str | None:
    """ASCII look-alike of a character; "" to drop it; None to leave it."""
    if c in ZERO_WIDTH:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    digit = unicodedata.decimal(c, None)
    return None if digit is None else str(digit)


_fold_memo: dict[str, str | None] = {}


def _folds(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    odd = {}
    for c in set(text):
        if c > "\x7f":
            if c not in _fold_memo:
                _fold_memo[c] = _folded(c)
            if _fold_memo[c] is not None:
                odd[c] = _fold_memo[c]
    if not odd:
        return []
    # letters of another script are disguises only beside ASCII letters or digits
    edits = []
    for m in re.finditer("[" + re.escape("".join(odd)) + "]+", text):
        beside = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
        other = any(c in HOMOGLYPHS for c in m.group())
        if not other or any(c.isascii() and (c.isalnum() or c in "@._-") for c in beside):
            edits += [(m.start() + k, m.start() + k + 1, odd[c]) for k, c in enumerate(m.group())]
    return edits


def deobfuscate(text: str) -> Tape | None:
    """The rewritten text, or None if no transducer applies."""
    folds = _folds(text)
    spelled = _spelled(text)
    if not folds and not spelled and not _DISGUISE.search(text) and not _PLAIN_DOMAIN.search(text):
        return None
    tape = Tape(text)
    tape.replace(folds)
    if folds or spelled:
        for pattern, words in _SPELLED_RUNS:
            edits = []
            for m in pattern.finditer(tape.chars):
                digits = "".join(words[w.group().lower()] for w in _SPELLED_ONE.finditer(m.group()))
                edits.append((m.start(), m.end(), digits))
            tape.replace(edits)
    for sign, pattern in _MARK.items():
        tape.replace([(m.start(), m.end(), sign) for m in pattern.finditer(tape.chars) if _between(tape.chars, m)])
    tape.replace([(x.start(), x.end(), ".") for m in _BARE_IP.finditer(tape.chars) for x in _BARE_DOT.finditer(tape.chars, m.start(), m.end())])
    tape.replace(_bare_marks(tape.chars))
    return tape


def _bare_marks(text: str) -> list[tuple[int, int, str]]:
    """Bare "at" and "dot" of addresses, found from each "at" to both sides.

    What lies left of one "at" ends at the one before, so the time is linear.
    """
    edits: list[tuple[int, int, str]] = []
    done = 0
    for at in _ANY_AT.finditer(text):
        if at.start() < done:
            continue
        marks = [] if at.group() == "@" else [(at.start(), at.end(), "@")]
        start = _local_start(text, at.start(), done)
        if start == at.start():
            continue
        while True:  # first dot last dot ... at
            word = next((w for w in _LEFT_DOTS if start - len(w) > done and text[start - len(w) : start].lower() == w), None)
            before = _local_start(text, start - len(word), done) if word else start
            if not word or before == start - len(word):
                break
            marks.append((start - len(word), start, "."))
            start = before
        label = _LABEL.match(text, at.end())
        end, labels, last = label.end() if label else 0, 0, None
        while label:
            dot = _DOT_MARK.match(text, end)
            label = _LABEL.match(text, dot.end()) if dot else None
            if label:
                if dot.group() != ".":
                    marks.append((dot.start(), dot.end(), "."))
                end, labels, last = label.end(), labels + 1, label.group()
        bare_dots = sum(out == "." for _, _, out in marks)
        if not labels or not marks or (start > 0 and (text[start - 1].isalnum() or text[start - 1] in "@_")) or (end < len(text) and (text[end].isalnum() or text[end] in "@_")):
            continue
        if at.group() != "@" and not bare_dots and not _TOP.fullmatch(last):
            continue  # "at noon.Then" is the end of a sentence, not a domain
        if len(last) < 2:
            continue
        edits += sorted(marks)
        done = end
    return edits


def _local_start(text: str, end: int, least: int) -> int:
    while end > least and text[end - 1] in _LOCAL:
        end -= 1
    return end


def _spelled(text: str) -> bool:
    low = text.lower()
    return any(sum(len(w) > 2 and w in low for w in words) >= 2 and pattern.search(text) for pattern, words in _SPELLED_RUNS)


def _between(text: str, m: re.Match) -> bool:
    """A mark joins identifier-like characters on both sides."""
    return 0 < m.start() and m.end() < len(text) and text[m.start() - 1].isalnum() and text[m.end()].isalnum()


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    tape = deobfuscate(text)
    if tape is None:
        return []
    out, ends = [], dict.fromkeys(KINDS, 0)
    nearest, covered = 0, 0  # base spans that begin before, and their greatest end
    for kind, a, b in base_spans(tape.chars):
        if not any(tape.new[a:b]):
            continue
        start, end = tape.start[a], tape.end[b - 1]
        while nearest < len(base) and base[nearest][1] <= start:
            covered = max(covered, base[nearest][2])
            nearest += 1
        if end > covered and start >= ends[kind]:
            out.append((kind, start, end))
            ends[kind] = end
    return out


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of one whole text."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind; overlapping spans merge."""
    if not text:
        return text
    spans = find(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_in_documents(docs: DataFrame) -> DataFrame:
    """Digest form: counts and checksum of base spans, and all spans."""

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, spans = find(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, type=t) for c, t in zip(columns, types, strict=True))], names=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)
