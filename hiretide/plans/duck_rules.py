"""The classification rules restated in DuckDB SQL, for checks only.

RE2 has no lookaround, so boundaries are written in the consuming form.
"""

from __future__ import annotations

import re

from hiretide import rules
from hiretide.plans.dialect import quoted
from hiretide.plans.standin import duck_views


def any_term(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(t)})" for t in terms) + ")"


def label_list(conditions: dict[str, str]) -> str:
    arms = ", ".join(f"CASE WHEN {cond} THEN {quoted(label)} END" for label, cond in conditions.items())
    return f"list_filter([{arms}], lambda x: x IS NOT NULL)"


def first_label(conditions: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN {cond} THEN {quoted(label)}" for label, cond in conditions.items())
    return f"CASE {arms} ELSE {quoted(default)} END"


def tidy(x: str) -> str:
    x = f"regexp_replace({x}, '[ \\t\\r\\f\\v]+', ' ', 'g')"
    x = f"regexp_replace({x}, ' *\\n+ *', chr(10), 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def without_boilerplate(x: str) -> str:
    for marker in rules.BOILERPLATE_MARKERS:
        x = f"regexp_replace({x}, {quoted(rf'(?is)\b{marker}\b.*?(\n\n|\z)')}, '\\1', 'g')"
    return x


def alias(column: str, aliases) -> str:
    body = "|".join(map(re.escape, aliases))
    return f"regexp_matches({column}, {quoted(f'(^|[^a-z0-9-])({body})($|[^a-z0-9-])')})"


def skills(column: str) -> str:
    return label_list({s: alias(column, a) for s, a in rules.SKILL_ALIASES.items()})


PROGRAM = first_label(
    {
        "internship": rf"(regexp_matches(s, '\b({'|'.join(rules.INTERN_WORDS)})\b') OR contains(s, 'summer analyst'))",
        "new_grad": "(" + " OR ".join(alias("s", (p,)) for p in rules.NEW_GRAD_PHRASES) + ")",
        "experienced": r"(regexp_matches(s, '\b[3-9]\+?\s+years?\b') OR contains(s, 'senior') OR contains(s, 'staff '))",
    },
    "other",
)
LEVELS = label_list({k: any_term("s", v) for k, v in rules.ACADEMIC_LEVEL_TERMS.items()})
DEGREES = label_list({k: any_term("s", v) for k, v in rules.DEGREE_TERMS.items()})
VISA = first_label({k: any_term("s", v) for k, v in rules.VISA_TERMS.items()}, "not_mentioned")
REMOTE = first_label({k: any_term("s", v) for k, v in rules.REMOTE_TERMS.items()}, "unknown")


def _grad_years() -> str:
    def near(core: str, reach: int) -> str:
        before = "|".join(rf"{t}.{{0,{reach - len(t)}}}" for t in rules.STUDENT_CONTEXT_TERMS)
        after = "|".join(rf".{{0,{reach - len(t)}}}{t}" for t in rules.STUDENT_CONTEXT_TERMS)
        return f"regexp_matches(s, {quoted(rf'(?s)(?:{before}){core}|{core}(?:{after})')})"

    singles = ", ".join(
        f"CASE WHEN {near(rf'\b{y}\b', rules.GRAD_YEAR_REACH)} THEN {y} END"
        for y in range(rules.FIRST_GRAD_YEAR, rules.LAST_GRAD_YEAR + 1)
    )
    year = "20(?:2[4-9]|3[0-5])"
    span = rf"\b({year})\b\s*(?:-|to|through|and|or|,)\s*\b({year})\b"
    core = span.replace("(20", "(?:20")
    bound = lambda i: f"TRY_CAST(regexp_extract(s, {quoted(span)}, {i}) AS INT)"
    # the derived texts hold at most one range
    spread = f"CASE WHEN {near(core, rules.GRAD_RANGE_REACH)} THEN range({bound(1)}, {bound(2)} + 1) ELSE [] END"
    return (
        f"CASE WHEN contains(s, '20') THEN list_sort(list_distinct(list_concat("
        f"list_filter([{singles}], lambda x: x IS NOT NULL), CAST({spread} AS INT[])))) ELSE CAST([] AS INT[]) END"
    )


GRAD_YEARS = _grad_years()
NICE_TEXT = "concat_ws(' ', " + ", ".join(
    f"CASE WHEN contains(s, {quoted(m)}) THEN substr(s, strpos(s, {quoted(m)})) END"
    for m in rules.NICE_TO_HAVE_MARKERS
) + ")"
GPA = (
    r"coalesce(nullif(regexp_extract(s, '\b(?:minimum\s+)?(?:gpa|grade point average)\s*(?:of|:)?\s*([0-4]\.\d{1,2})\b', 1), ''), "
    r"nullif(regexp_extract(s, '\b([0-4]\.\d{1,2})\s*(?:minimum\s+)?gpa\b', 1), ''))"
)

CLEANED = f"""
cleaned AS (
  SELECT l.*, {tidy(f"replace({without_boilerplate(tidy('raw_description'))}, chr(160), ' ')")} AS cleaned_description
  FROM listings l
),
hay AS (
  SELECT c.*, ' ' || lower(job_title || ' ' || company_name || ' ' || array_to_string(location, ' ') || ' '
    || coalesce(employment_type, '') || ' ' || array_to_string(departments, ' ') || ' '
    || cleaned_description) || ' ' AS s
  FROM cleaned c
)"""

REASONS = label_list(
    {
        "missing_description": "length(trim(cleaned_description)) = 0",
        "short_description": f"length(trim(cleaned_description)) < {rules.SHORT_DESCRIPTION_CHARS}",
        "student_role_without_explicit_eligibility":
            "program_type IN ('internship', 'new_grad') AND len(required_grad_years) = 0 AND len(academic_levels) = 0",
        "ambiguous_visa_language": "visa_status = 'unclear'",
        "unknown_remote_type": "remote_type = 'unknown'",
    }
)
# confidence by number of reasons; a missing description caps it
CONFIDENCE = (
    "CASE WHEN len(review_reasons) = 0 THEN 0.92 "
    "WHEN list_contains(review_reasons, 'missing_description') AND len(review_reasons) <= 3 THEN 0.43 "
    "WHEN len(review_reasons) = 1 THEN 0.76 WHEN len(review_reasons) = 2 THEN 0.64 "
    "WHEN len(review_reasons) = 3 THEN 0.52 WHEN len(review_reasons) = 4 THEN 0.40 ELSE 0.33 END"
)


def padded(x: str) -> str:
    return f"(' ' || replace(replace(replace(lower({x}), '/', ' '), '-', ' '), '_', ' ') || ' ')"


def has_term(x: str, terms) -> str:
    spaced = [" " + t.replace("/", " ").replace("-", " ").replace("_", " ") + " " for t in terms]
    return any_term(padded(x), spaced)


_TEAM = has_term("array_to_string(departments, ' ')", rules.RELEVANT_DEPARTMENT_TERMS)
_SKILLED = f"list_has_any(list_concat(required_skills, nice_to_have_skills), [{', '.join(map(quoted, rules.RELEVANT_SKILLS))}])"
_DESCRIBED = has_term(
    "CASE WHEN cleaned_description <> '' THEN cleaned_description ELSE coalesce(raw_description, '') END",
    rules.RELEVANT_DESCRIPTION_TERMS,
)
_NEGATIVE = has_term("job_title", rules.NEGATIVE_TITLE_TERMS)
RELEVANT = (
    f"CASE WHEN {_NEGATIVE} AND NOT {has_term('job_title', rules.TECHNICAL_NOUNS)} THEN false "
    f"WHEN {has_term('job_title', rules.STRONG_TITLE_TERMS)} THEN true "
    f"WHEN {has_term('job_title', rules.WEAK_TITLE_TERMS)} AND ({_TEAM} OR {_SKILLED} OR {_DESCRIBED}) THEN true "
    f"ELSE {_TEAM} AND {_SKILLED} AND NOT {_NEGATIVE} END"
)

ELIGIBILITY = f"""
elig1 AS (
  SELECT h.*, {PROGRAM} AS program_type, {LEVELS} AS academic_levels, {DEGREES} AS degree_requirements,
    {GRAD_YEARS} AS required_grad_years, {VISA} AS visa_status, {skills('s')} AS required_skills,
    {NICE_TEXT} AS nice_text, TRY_CAST({GPA} AS DOUBLE) AS gpa,
    {any_term('s', rules.CLEARANCE_TERMS)} AS clearance_required, {REMOTE} AS remote_type
  FROM hay h
),
elig2 AS (
  SELECT e.*, {skills('nice_text')} AS nice_to_have_skills,
    CASE WHEN gpa BETWEEN 0 AND 4 THEN gpa END AS min_gpa,
    CASE WHEN visa_status IN ('sponsors', 'opt_cpt_allowed') THEN true
         WHEN visa_status IN ('does_not_sponsor', 'requires_authorization') THEN false END AS visa_sponsorship,
    {REASONS} AS review_reasons
  FROM elig1 e
),
elig AS (
  SELECT e.*, CAST({CONFIDENCE} AS DOUBLE) AS confidence,
    CASE WHEN list_has_any(review_reasons, [{', '.join(map(quoted, rules.BLOCKING_REASONS))}])
         THEN 'NEEDS_REVIEW' ELSE 'COMPLETE' END AS normalization_status,
    {RELEVANT} AS is_relevant
  FROM elig2 e
),
jobs AS (
  SELECT e.*, content_hash AS id, sha256(company_name || '|' || ats_provider) AS company_id,
    TIMESTAMP '2026-06-01 00:00:00' - to_hours(CAST(doc_id % 100 AS INT)) AS last_seen_at,
    TIMESTAMP '2026-06-01 00:00:00' - to_hours(CAST(100 + doc_id % 200 AS INT)) AS first_seen_at,
    is_relevant AS is_active
  FROM elig e
)"""


def with_listings(select: str) -> str:
    return f"WITH {duck_views('listings')}\n{select}"


def with_cleaned(select: str) -> str:
    return f"WITH {duck_views('listings')},{CLEANED}\n{select}"


def with_jobs(select: str, *views: str, extra: str = "") -> str:
    more = f",\n{extra}" if extra else ""
    return f"WITH {duck_views('listings', *views)},{CLEANED},{ELIGIBILITY}{more}\n{select}"
