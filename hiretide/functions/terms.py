"""Term tables: labels for substrings, found for any number of tables in one scan.

The terms of the given tables form a trie, written as one pattern in which every
common beginning is tried once.  The scan looks ahead from each character, so terms
that overlap are all found; where several start together it takes the longest, of
which the others are beginnings.  What was found is mapped to labels by the tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiretide.functions.expr import bound, labels_where, no_strings, strings

Table = Mapping[str, Iterable[str]]
_END = ""


def trie_pattern(terms: Iterable[str], longest: bool = True) -> str:
    """One factored pattern of all terms; where one begins another, the longer is
    taken, or with ``longest=False`` the shorter."""
    root: dict = {}
    for term in terms:
        if not term:
            raise ValueError("an empty term is in every text")
        node = root
        for char in term:
            node = node.setdefault(char, {})
        node[_END] = {}

    def pattern(node: dict) -> str:
        ends = _END in node
        if ends and not longest:
            return ""
        branches = [re.escape(char) + pattern(child) for char, child in node.items() if char != _END]
        if not branches:
            return ""
        if ends:
            return f"(?:{'|'.join(branches)})?"
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    return pattern(root)


def terms_of(*tables: Table) -> list[str]:
    """The distinct terms of the tables."""
    return list(dict.fromkeys(t for table in tables for terms in table.values() for t in terms))


def found_terms(text: Column, terms: Iterable[str]) -> Column:
    """The distinct terms that the text holds, in one scan; of those that start at
    one place only the longest.  NULL text holds none."""
    terms = list(terms)
    if not terms:
        return no_strings()
    # most places are passed by for their first characters, before the trie is tried
    known = range(min(3, *map(len, terms)))
    ahead = "".join(f"[{''.join(re.escape(c) for c in sorted({t[i] for t in terms}))}]" for i in known)
    pattern = rf"(?={ahead})(?=({trie_pattern(terms)}))"
    return F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1)), no_strings())


def implied(table: Table, terms: Iterable[str]) -> dict[str, list[str]]:
    """For each label the found terms that stand for it: its own, and longer ones
    that begin with one of them."""
    terms = list(terms)
    return {label: [t for t in terms if t.startswith(tuple(own))] for label, own in table.items()}


def labels_found(found: Column, table: Table, terms: Iterable[str]) -> Column:
    """Ordered labels of ``table`` for what ``found_terms`` found of ``terms``.  What
    was found is bound, or the scan would run again for every label."""
    rows = implied(table, terms)
    return bound(found, lambda f: labels_where(rows, lambda own: F.arrays_overlap(f, own)))


def first_label_found(found: Column, table: Table, terms: Iterable[str], default: str | None) -> Column:
    return F.coalesce(F.get(labels_found(found, table, terms), F.lit(0)), F.lit(default))


def any_found(found: Column, own: Iterable[str], terms: Iterable[str]) -> Column:
    """Whether any of ``own`` was found."""
    return F.arrays_overlap(found, strings(implied({"own": list(own)}, terms)["own"]))


def label_scan(text: Column, table: Table) -> Column:
    """Ordered labels of one table in a text."""
    terms = terms_of(table)
    return labels_found(found_terms(text, terms), table, terms)


def first_label_scan(text: Column, table: Table, default: str | None = None) -> Column:
    return F.coalesce(F.get(label_scan(text, table), F.lit(0)), F.lit(default))
