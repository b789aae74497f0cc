"""Column building blocks shared by the rule compilers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Nested column functions repeat their argument wherever it is used; binding it
    as a lambda variable keeps the expression (and its generated code) small.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, computed: list[str] | None = None) -> DataFrame:
    """``df`` with its computed columns (all, unless named) fixed before anything
    above reads them.

    Catalyst moves a filter below the projection it reads by copying the
    expressions, which for the rule columns means scanning every text again per
    copy.  Predicates do not move below a generator, so rows pass through a
    one-element array.  Columns that are not named stay outside of it: predicates on
    them still reach the scan.
    """
    computed = df.columns if computed is None else computed
    stored = [c for c in df.columns if c not in computed]
    return df.select(*stored, F.inline(F.array(F.struct(*computed))))


EMPTY_STRINGS = "array<string>"

# What a Unicode-aware strip removes; the JVM's \s and trim() know only ASCII.
SPACE_CLASS = (
    r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Trim at the ends only; an anchored pattern would visit every blank run.  The trim
    lists every character of its text, so texts without a blank at an end skip it."""
    def trim(v: Column) -> Column:
        blank = F.lit(SPACE_CHARS)
        at_an_end = blank.contains(F.substring(v, 1, 1)) | blank.contains(F.substring(v, -1, 1))
        return F.when(at_an_end, F.btrim(v, blank)).otherwise(v)

    return bound(col, trim)


def squeeze(col: Column) -> Column:
    """Collapse every whitespace run to one blank and strip.  Single blanks are
    already right, so only other runs are rewritten."""
    return strip(F.regexp_replace(col, rf"(?! (?!{SPACE_CLASS})){SPACE_CLASS}+", " "))


def not_empty(value: Column) -> Column:
    """The text, or NULL when it is empty.  Unlike nullif, which repeats its argument
    inside lambdas and branches, this computes the value once."""
    return bound(value, lambda v: F.when(v != "", v))


def present(col: Column) -> Column:
    """The stripped text, or NULL when nothing is left."""
    return not_empty(strip(col))


def no_strings() -> Column:
    return F.array().cast(EMPTY_STRINGS)


def strings(values: Iterable[str]) -> Column:
    """Literal string array (folded to a constant by the optimizer)."""
    values = list(values)
    return F.split(F.lit("\x1f".join(values)), "\x1f") if values else no_strings()


def term_table(table: Mapping[str, Iterable[str]]) -> Column:
    """A rule table as one constant: array of (label, terms)."""
    rows = [{"label": label, "terms": list(terms)} for label, terms in table.items()]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<label:string,terms:array<string>>>")


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """Whether the text holds any of the terms, as plain substrings.  The text is
    bound: the optimizer may put its whole expression in the place of a column, and
    inside the lambda it would be computed for every term."""
    terms = list(dict.fromkeys(terms))
    if len(terms) == 1:
        return text.contains(terms[0])
    return bound(text, lambda t: F.exists(strings(terms), lambda term: t.contains(term)))


def labels_where(table: Mapping[str, Iterable[str]], holds: Callable[[Column], Column]) -> Column:
    """Ordered labels of the table rows whose terms satisfy ``holds``."""
    return F.transform(F.filter(term_table(table), lambda row: holds(row.terms)), lambda row: row.label)


def labels_in(text: Column, table: Mapping[str, Iterable[str]]) -> Column:
    """Ordered labels with at least one term in the text."""
    return bound(text, lambda t: labels_where(table, lambda terms: F.exists(terms, lambda term: t.contains(term))))


def first_label_in(text: Column, table: Mapping[str, Iterable[str]], default: str | None = None) -> Column:
    return F.coalesce(F.get(labels_in(text, table), F.lit(0)), F.lit(default))


def labels(conditions: Mapping[str, Column]) -> Column:
    """Ordered array of the labels whose condition holds."""
    hits = [F.when(cond, F.lit(label)) for label, cond in conditions.items()]
    return F.array_compact(F.array(*hits)) if hits else no_strings()


def first_label(conditions: Mapping[str, Column], default: str | None = None) -> Column:
    hits = [F.when(cond, F.lit(label)) for label, cond in conditions.items()]
    return F.coalesce(*hits, F.lit(default))


def clean_list(values: Column) -> Column:
    """Stripped, non-blank elements; NULL array becomes empty."""
    stripped = F.transform(F.coalesce(values, no_strings()), strip)
    return F.filter(stripped, lambda v: v.isNotNull() & (v != ""))


def distinct_in_order(values: Column) -> Column:
    return F.array_distinct(values)


def join_present(separator: str, *parts: Column) -> Column:
    """Join the non-blank parts only."""
    kept = F.filter(F.array(*parts), lambda v: v.isNotNull() & (v != ""))
    return F.array_join(kept, separator)


def alternation(words: Iterable[str]) -> str:
    """Escaped alternatives grouped by first character, so that a failing match
    tries one branch per letter rather than one per word."""
    groups: dict[str, list[str]] = {}
    for word in words:
        groups.setdefault(word[0], []).append(word[1:])
    return "|".join(
        re.escape(head) + f"(?:{'|'.join(map(re.escape, tails))})" for head, tails in groups.items()
    )


def mentions(text: Column, words: Iterable[str], pattern: str) -> Column:
    """``text.rlike(pattern)`` behind a plain substring test: the pattern can only
    match where one of ``words`` occurs, which is rare."""
    return contains_any(text, words) & text.rlike(pattern)


def mapped(col: Column, table: Mapping[str, str]) -> Column:
    """Look a key up in a fixed rule table (bounded, lives inside the expression)."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), col)


def title_words(col: Column) -> Column:
    """Capitalise every run of letters, lower-casing the rest of it.

    Unlike initcap, a letter run may start after a digit or apostrophe.
    """
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")
