"""Personal data in plain and in disguised form, with spans of the source text.

Plain identifiers are found by fixed patterns.  For disguised ones the text goes
through two transducers: the first replaces look-alike characters one for one, the
second rewrites pieces (invisible characters, at/dot disguises, spelled digits,
letters inside numbers) and keeps, for every character it writes, the source range it came from.  The
same patterns then run on the rewritten text, and matches that contain a
rewritten piece are mapped back to source characters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from hiretide.llm.common import whole

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# starts at the start of a run of digits, as any first match does
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def _is_ip(found: str) -> bool:
    return all(int(part) <= 255 for part in (p.lstrip("0")[:4] or "0" for p in found.split(".")))


def _is_card(found: str) -> bool:
    digits = _digits(found)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _is_phone(found: str) -> bool:
    return 8 <= len(_digits(found)) <= 15


LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part and domain.  Each is anchored at its @: the
    local part is the run before it, from the end of the last match."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            free = domain.end()
            yield "email", start, free
        at = text.find("@", max(at + 1, free))


def plain_spans(text: str) -> list[Span]:
    """Base spans, by kind as listed, then start.  Matches that fail their test are
    dropped, without another try inside them."""
    found = list(emails(text))
    for kind, pattern, test in (("ip", IP, _is_ip), ("card", CARD, _is_card), ("phone", PHONE, _is_phone)):
        found += [(kind, *m.span()) for m in pattern.finditer(text) if test(m.group())]
    return found


# Characters that look like an ASCII letter.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g",
    "к": "k", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "Ѕ": "S", "І": "I", "Ј": "J", "ɑ": "a", "ո": "n",
}
# Blanks and dashes that stand for the ASCII ones inside numbers.
BREAKS = {c: " " for c in "\u00A0\u2007\u2009\u202F"} | {c: "-" for c in "\u2010\u2011\u2012\u2013\u2014\u2212"}
DIGIT_NAMES = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
}


def look_alikes() -> dict[int, str]:
    """The listed characters and every single character that is a compatibility
    form of one printable ASCII character (full-width, mathematical and so on) or
    a decimal digit of another script.  Beyond the Latin letters of European texts,
    whose own letters and signs stand for themselves."""
    table = {ord(c): plain for c, plain in (LOOK_ALIKES | BREAKS).items()}
    for code in range(0x250, 0x20000):
        char = chr(code)
        if char.isdecimal():
            table[code] = str(unicodedata.decimal(char))
        elif len(plain := unicodedata.normalize("NFKC", char)) == 1 and "!" <= plain <= "~":
            table[code] = plain
    return table


# Everything in the tables lies here; a range is tested faster than its members.
FOREIGN = re.compile("[\u00AD\u0131\u0250-\U0010FFFF]")
INVISIBLE = "­​‌‍⁠﻿"
OPEN, CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
SPELLED = "|".join(DIGIT_NAMES)
# Between spelled digits.
PAUSE = r"(?:,?\s+|-)"
# Runs of blanks and dashes are entered at their start only, which keeps long ones cheap.
LEAD = r"(?:(?<!\s)\s*|(?<=\s)(?!\s))"
BLANKS, DASHES = r"(?<!\s)\s+", r"(?<![_-])[_-]+"
DOT = rf"(?:{LEAD}{OPEN}(?:dot|\.){CLOSE}\s*|{BLANKS}dot\s+|{LEAD}{DASHES}dot[_-]+\s*|&(?:#0*46|#x0*2e|period);)"
# A domain of which at least one dot is disguised.
DISGUISED = rf"(?=[a-z0-9-]+(?:(?:{DOT}|\.)[a-z0-9-]+)*{DOT}[a-z0-9-]+)"
DOMAIN_NEXT = rf"(?=[a-z0-9-]+(?:{DOT}|\.)[a-z0-9-]+)"
AT = (
    rf"(?:{LEAD}{OPEN}(?:at|@){CLOSE}\s*|(?:{BLANKS}at\s+|{LEAD}{DASHES}at[_-]+\s*){DISGUISED}|{BLANKS}@\s+{DOMAIN_NEXT}"
    rf"|(?:&(?:#0*64|#x0*40|commat);|(?<=[a-z0-9])%40){DOMAIN_NEXT})"
)
# Letters written for 0 and 1, inside or at an end of a number.
LETTERS = r"(?:(?<=[+0-9])[OoIl]+(?![A-Za-z])|(?<=[0-9][\s.-])[OoIl]+(?=[0-9]))"
AS_DIGITS = str.maketrans("OoIl", "0011")
TIMES = {"double": 2, "triple": 3}
REWRITES = re.compile(
    rf"(?P<gone>[{INVISIBLE}]+)"
    rf"|(?P<at>{AT})"
    rf"|(?P<dot>{DOT})"
    rf"|(?P<plus>\bplus[\s-]+(?=(?:(?:double|triple)\s+)?(?:{SPELLED})\b|[0-9]))"
    rf"|(?P<digit>\b(?:(?:double|triple)\s+)?(?:{SPELLED})\b(?:{PAUSE}(?=(?:(?:double|triple)\s+)?(?:{SPELLED})\b))?)"
    rf"|(?-i:(?P<letters>{LETTERS}))",
    re.IGNORECASE,
)
# Signs that rewriting could matter; each starts with a plain set of characters.
# Together they hold for every text in which a rewriting takes part in an identifier;
# break characters are replaced before any but the last three are looked for.
BRACKETED = re.compile(r"[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]", re.IGNORECASE)
DOT_BETWEEN = re.compile(r"[\s_-]dot[\s_-]")
SPACED_AT = re.compile(r"@(?<=\s@)\s")
ESCAPED = re.compile(r"%40|&(?:#0*64|#x0*40|commat|#0*46|#x0*2e|period);", re.IGNORECASE)
# What may stand between two digits of a number.
JOINTS = r"[\x20().-]"
PLUS_NUMBER = re.compile(rf"plus[\s-]+(?:[0-9]|double|triple|{SPELLED})")
TWO_DIGITS = re.compile(rf"(?:{SPELLED}|double|triple)(?:{PAUSE}|{JOINTS}+)(?:(?:double|triple)\s+)?(?:{SPELLED})\b")
AFTER_DIGIT = re.compile(rf"[0-9]{JOINTS}*(?:(?:double|triple)\s+)?(?:{SPELLED})\b")
BEFORE_DIGIT = re.compile(rf"(?:{SPELLED}){JOINTS}*[0-9]")
IN_NUMBER = re.compile(r"[+0-9][\s.-]?[OoIl]+(?:[^A-Za-z]|\Z)")
ANY_BREAK = re.compile(f"[{''.join(BREAKS)}]")
ODD_BREAK = re.compile(rf"[0-9]{JOINTS}*[{''.join(BREAKS)}][\x20().{''.join(BREAKS)}-]*[0-9]")
EMAIL_BREAK = re.compile(rf"[A-Za-z0-9._%+@-]{ANY_BREAK.pattern}|{ANY_BREAK.pattern}[A-Za-z0-9._%+@-]")


def folded(name: str) -> str:
    """Lower case; the letters that a comparison without case takes for s and i become those."""
    return name.lower().replace("\u017f", "s").replace("i\u0307", "i")


class Disguises:
    """The two transducers; built once for a task."""

    def __init__(self):
        self.table = look_alikes()
        self.odd = frozenset([*map(chr, self.table), *INVISIBLE]) - BREAKS.keys()

    def suspects(self, text: str) -> bool:
        """Whether any rewriting could matter: never False for a text in which one
        takes part in an identifier.  Cheap tests first."""
        if not text.isascii():
            if FOREIGN.search(text) and not self.odd.isdisjoint(text) or "\u017f" in text or "\u0130" in text:
                return True
            if ANY_BREAK.search(text):
                if ODD_BREAK.search(text) or ("@" in text and EMAIL_BREAK.search(text)):
                    return True
                for char, plain in BREAKS.items():
                    text = text.replace(char, plain)
        lower = text.lower()
        if BRACKETED.search(text) or ("dot" in lower and DOT_BETWEEN.search(lower)) or IN_NUMBER.search(text):
            return True
        if "@" in text and SPACED_AT.search(text) or ("&" in text or "%40" in text) and ESCAPED.search(text):
            return True
        if "plus" in lower and PLUS_NUMBER.search(lower):
            return True
        return any(name in lower for name in DIGIT_NAMES) and bool(
            TWO_DIGITS.search(lower) or AFTER_DIGIT.search(lower) or BEFORE_DIGIT.search(lower)
        )

    def rewrite(self, text: str) -> tuple[str, Callable[[int, int], tuple[int, int, bool]]]:
        """The normal form, and a map from its ranges to source ranges, which tells
        whether the range holds a rewritten piece."""
        replaced = text.translate(self.table) if not text.isascii() else text
        pieces: list[str] = []
        edits: list[tuple[int, int, int, int]] = []
        at = written = 0
        for m in REWRITES.finditer(replaced):
            kind = m.lastgroup
            new = {"gone": "", "at": "@", "dot": ".", "plus": "+"}.get(kind)
            if kind == "digit":
                first, *more = re.findall(r"[a-z]+", folded(m.group()))
                new = DIGIT_NAMES[more[0]] * TIMES[first] if more else DIGIT_NAMES[first]
            elif kind == "letters":
                new = m.group().translate(AS_DIGITS)
            pieces += [replaced[at:m.start()], new]
            written += m.start() - at
            edits.append((written, written + len(new), m.start(), m.end()))
            written += len(new)
            at = m.end()
        pieces.append(replaced[at:])
        normal = "".join(pieces)
        starts = [e[0] for e in edits]

        def source(a: int, b: int) -> tuple[int, int, bool]:
            def edge(x: int, end: bool) -> int:
                """Source position of a boundary: before (``end``: after) the
                character it touches."""
                i = bisect_right(starts, x - end) - 1
                while i >= 0 and edits[i][0] == edits[i][1] and (edits[i][0] > x - end):
                    i -= 1
                if i < 0:
                    return x
                new_a, new_b, old_a, old_b = edits[i]
                if x - end < new_b:
                    return (old_b if end else old_a)
                return old_b + x - new_b

            left, right = edge(a, False), edge(b, True)
            first = bisect_right(starts, a - 1)
            changed = any(a <= e[0] < b for e in edits[first:first + 1]) or replaced[left:right] != text[left:right]
            while right > left and text[right - 1].isspace():
                right -= 1
            while left < right and text[left].isspace():
                left += 1
            return left, right, changed

        return normal, source

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Disguised identifiers that are not equal to or inside a base span of their
        kind.  One that goes beyond the plain remainder of itself stands beside it."""
        if not self.suspects(text):
            return []
        normal, source = self.rewrite(text)
        taken = {kind: [s[1:] for s in base if s[0] == kind] for kind in KINDS}
        found = []
        for kind, a, b in plain_spans(normal):
            left, right, changed = source(a, b)
            if changed and not any(start <= left and right <= end for start, end in taken[kind]):
                found.append((kind, left, right))
        return found


def find(text: str, disguises: Disguises) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by kind as listed, then start."""
    base = plain_spans(text)
    more = disguises.spans(text, base)
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if more else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    disguises = Disguises()
    for batch in batches:
        counts, digests, spans = {k: [] for k in KINDS}, [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            base, every = find(text, disguises)
            for kind in KINDS:
                counts[kind].append(sum(s[0] == kind for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        made = [*(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        names = [*batch.schema.names[:-1], *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([*kept, *made], names=names)


def personal_data(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``n_email, n_ip, n_card, n_phone`` (base matches), ``base_sha256``
    of the base spans and ``spans``: all spans as kind:start:end (code points, end
    exclusive).  NULL and empty texts have none; a row is judged on its own, so
    NULL ids, repeated rows and other columns do not matter.
    """
    rows = docs.select(*keep, whole(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(_scan, f"{schema}, {counts}, base_sha256 string, spans string")
