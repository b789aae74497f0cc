"""Secret scan over trigram inverted indexes.

For each rule a Boolean query of trigrams is derived from its regular expression:
trigrams that every match must contain.  The texts of a task are indexed in
segments; a segment's postings hold, per trigram that some rule asks for, the rows
containing it.  Rules intersect and unite postings to find candidate rows, and
only these are searched with the regular expression.  A rule without mandatory
trigrams searches every row.  Segments are local to a task and bounded by their
characters, so nothing is shuffled and a lost executor costs its tasks only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from hiretide.llm import arrays
from hiretide.llm.common import whole

try:
    from re import _constants as codes
    from re import _parser as parser
except ImportError:
    import sre_constants as codes
    import sre_parse as parser

BASE_KINDS = ("assign", "access", "hex")
SEGMENT_CHARS = 1 << 22
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``test`` sees the match; failing matches are dropped without another try."""

    kind: str
    pattern: str
    test: Callable[[re.Match], bool] | None = None


RULES = (
    # Fixed patterns.
    Rule(
        "assign",
        r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m.group(2)) >= 12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18),
    # runs are maximal, so those of 16 and more are all that can pass
    Rule("hex", r"[0-9a-f]{16,}"),
    # Other well-known public token formats.
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)

# A query is ALL (no condition), a trigram, or ("and" | "or", queries).
ALL = ("and", frozenset())


def both(a: tuple, b: tuple) -> tuple:
    parts = [p for q in (a, b) for p in (q[1] if q[0] == "and" else [q])]
    return parts[0] if len(set(parts)) == 1 else ("and", frozenset(parts))


def either(queries: list[tuple]) -> tuple:
    if not queries or ALL in queries:
        return ALL
    parts = {p for q in queries for p in (q[1] if q[0] == "or" else [q])}
    needs = {p: p[1] if p[0] == "and" else frozenset([p]) for p in parts}
    parts = {p for p in parts if not any(needs[o] < needs[p] for o in parts)}
    return parts.pop() if len(parts) == 1 else ("or", frozenset(parts))


def of_string(s: str) -> tuple:
    query = ALL
    for i in range(len(s) - 2):
        query = both(query, ("tri", s[i:i + 3]))
    return query


def of_strings(strings: set[str]) -> tuple:
    return either([of_string(s) for s in strings])


def _walk(items) -> tuple[set[str] | None, tuple]:
    """All strings a sequence can match (None: too many), and its query if not."""
    query, exact, complete = ALL, {""}, True

    def close() -> None:
        nonlocal query, exact, complete
        query, exact, complete = both(query, of_strings(exact)), {""}, False

    for op, value in items:
        strings, inner = _one(op, value)
        if strings is None:
            close()
            query = both(query, inner)
        elif len(exact) * len(strings) > MOST_STRINGS:
            close()
            if len(strings) <= MOST_STRINGS:
                exact = strings
        else:
            exact = {a + b for a in exact for b in strings}
    if complete:
        return exact, ALL
    return None, both(query, of_strings(exact))


def _one(op, value) -> tuple[set[str] | None, tuple]:
    if op is codes.LITERAL:
        return {chr(value).lower()}, ALL
    if op is codes.IN:
        chars: set[str] = set()
        for kind, x in value:
            if kind is codes.LITERAL:
                chars.add(chr(x).lower())
            elif kind is codes.RANGE and x[1] - x[0] < MOST_STRINGS:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ALL
        return (chars, ALL) if len(chars) <= 8 else (None, ALL)
    if op is codes.SUBPATTERN:
        return _walk(value[3])
    if op is codes.BRANCH:
        found = [_walk(b) for b in value[1]]
        if all(s is not None for s, _ in found):
            return set().union(*(s for s, _ in found)), ALL
        return None, either([q if s is None else of_strings(s) for s, q in found])
    if op in (codes.MAX_REPEAT, codes.MIN_REPEAT):
        low, high, inner = value
        strings, query = _walk(inner)
        if low == 0:
            return (strings | {""}, ALL) if strings is not None and high == 1 else (None, ALL)
        if strings is not None and low == high and len(strings) == 1:
            return {next(iter(strings)) * low}, ALL
        return None, of_strings({s * low for s in strings}) if strings is not None and len(strings) == 1 else (
            query if strings is None else of_strings(strings)
        )
    if op is codes.AT:
        return {""}, ALL
    return None, ALL


def trigram_query(pattern: str) -> tuple:
    """Lower-case trigrams that a text with a match must contain."""
    strings, query = _walk(parser.parse(pattern))
    return query if strings is None else of_strings(strings)


def trigrams(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tri" else {t for q in query[1] for t in trigrams(q)}


def postings(texts: list[str], wanted: set[str]) -> dict[str, set[int]]:
    """Rows of a segment that contain each wanted trigram, without regard to case."""
    lowered = [t.lower() for t in texts]
    return {t: {i for i, text in enumerate(lowered) if t in text} for t in wanted}


def candidates(query: tuple, index: dict[str, set[int]], rows: int) -> set[int]:
    if query[0] == "tri":
        return index[query[1]]
    parts = sorted((candidates(q, index, rows) for q in query[1]), key=len)
    if query[0] == "or":
        return set().union(*parts)
    return set.intersection(*parts) if parts else set(range(rows))


Span = tuple[str, int, int]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.order = {r.kind: i for i, r in enumerate(rules)}
        self.wanted = set().union(*(trigrams(q) for _, _, q in self.rules))

    def segment(self, texts: list[str]) -> list[list[Span]]:
        """Spans of each text, by start, then rule."""
        found: list[list[Span]] = [[] for _ in texts]
        index = postings(texts, self.wanted)
        for rule, pattern, query in self.rules:
            for i in candidates(query, index, len(texts)):
                found[i] += [
                    (rule.kind, *m.span()) for m in pattern.finditer(texts[i]) if rule.test is None or rule.test(m)
                ]
        return [sorted(f, key=lambda s: (s[1], self.order[s[0]])) for f in found]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        found = [f for a, b in arrays.spans([len(t) for t in texts], SEGMENT_CHARS) for f in scanner.segment(texts[a:b])]
        base = [[s for s in f if s[0] in BASE_KINDS] for f in found]
        made = [
            *(pa.array([sum(s[0] == k for s in f) for f in base], pa.int64()) for k in BASE_KINDS),
            pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base], pa.string()),
            pa.array([joined(f) for f in found], pa.string()),
        ]
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        names = [*batch.schema.names[:-1], *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([*kept, *made], names=names)


def secrets(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``n_assign, n_access, n_hex``, ``base_sha256`` of the base spans
    and ``spans``: all spans as kind:start:end (code points, end exclusive), other
    token formats included.  NULL and empty texts have none; a row is judged on its
    own, so NULL ids, repeated rows and other columns do not matter.
    """
    rows = docs.select(*keep, whole(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return rows.mapInArrow(_scan, f"{schema}, {counts}, base_sha256 string, spans string")
