"""All tables of the eligibility rules as one value, so that a caller can swap any."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from hiretide import rules

Terms = tuple[str, ...]
Table = Mapping[str, Terms]


@dataclass(frozen=True)
class Rulebook:
    """Terms are lower-case substrings of the searched text unless stated.  Labels come
    out in table order; first-label tables give the first."""

    intern_words: Terms = rules.INTERN_WORDS  # whole words
    intern_signs: Terms = ("summer analyst",)
    new_grad_phrases: Terms = rules.NEW_GRAD_PHRASES  # between non-word characters
    experienced_signs: Terms = ("senior", "staff ")
    academic_levels: Table = field(default_factory=lambda: rules.ACADEMIC_LEVEL_TERMS)
    degrees: Table = field(default_factory=lambda: rules.DEGREE_TERMS)
    visa: Table = field(default_factory=lambda: rules.VISA_TERMS)  # first label
    remote: Table = field(default_factory=lambda: rules.REMOTE_TERMS)  # first label
    clearance: Terms = rules.CLEARANCE_TERMS
    skills: Table = field(default_factory=lambda: rules.SKILL_ALIASES)  # between non-word characters
    nice_to_have_markers: Terms = rules.NICE_TO_HAVE_MARKERS
    student_context: Terms = rules.STUDENT_CONTEXT_TERMS  # no digits
    year_reach: int = rules.GRAD_YEAR_REACH
    year_range_reach: int = rules.GRAD_RANGE_REACH
    short_description_chars: int = rules.SHORT_DESCRIPTION_CHARS
    blocking_reasons: Terms = rules.BLOCKING_REASONS


DEFAULT = Rulebook()
