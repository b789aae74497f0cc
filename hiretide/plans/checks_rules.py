"""Registered queries that run the rules with tables of the caller."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from hiretide.operators import classify, events, relevance, routing
from hiretide.plans import duck_rules as duck
from hiretide.plans.duck_events import with_events
from hiretide.plans.registry import query
from hiretide.plans.standin import given, view
from hiretide.plans.tables import joined, listings
from hiretide.rulebook import Rulebook

# Tables unlike the default ones: other labels, terms that overlap and that begin one another.
LEVELS = {"early": ("first", "first year", "fresh"), "late": ("final year", "year student", "senior"), "any": ("student", "stud")}
DEGREES = {"some": ("degree", "bachelor", "bs degree"), "higher": ("master", "masters", "phd")}
VISA = {"spoken_of": ("visa", "sponsor"), "opt": ("opt", "opt/cpt")}
REMOTE = {"away": ("remote", "home"), "here": ("office", "on-site", "onsite")}
SKILLS = {"snakes": ("python",), "beans": ("java", "java script"), "data": ("sql", "data")}
CLEARANCE = ("clearance", "secret")
BOOK = Rulebook(
    intern_words=("trainee", "intern"), intern_signs=("summer",), new_grad_phrases=("graduate",), experienced_signs=("lead",),
    academic_levels=LEVELS, degrees=DEGREES, visa=VISA, remote=REMOTE, clearance=CLEARANCE, skills=SKILLS,
    nice_to_have_markers=("preferred", "bonus"), short_description_chars=400, blocking_reasons=("unknown_remote_type",),
)

_PROGRAM = duck.first_label(
    {
        "internship": r"(regexp_matches(s, '\b(trainee|intern)\b') OR contains(s, 'summer'))",
        "new_grad": duck.alias("s", ("graduate",)),
        "experienced": r"(regexp_matches(s, '\b[3-9]\+?\s+years?\b') OR contains(s, 'lead'))",
    },
    "other",
)


def _skills(column: str) -> str:
    return duck.label_list({s: duck.alias(column, a) for s, a in SKILLS.items()})


_BOOK_CHECK = duck.with_cleaned(
    "SELECT doc_id, "
    f"{_PROGRAM} AS program_type, "
    f"array_to_string({duck.label_list({k: duck.any_term('s', v) for k, v in LEVELS.items()})}, '|') AS academic_levels, "
    f"array_to_string({duck.label_list({k: duck.any_term('s', v) for k, v in DEGREES.items()})}, '|') AS degree_requirements, "
    f"{duck.first_label({k: duck.any_term('s', v) for k, v in VISA.items()}, 'not_mentioned')} AS visa_status, "
    f"{duck.first_label({k: duck.any_term('s', v) for k, v in REMOTE.items()}, 'unknown')} AS remote_type, "
    f"{duck.any_term('s', CLEARANCE)} AS clearance_required, "
    f"array_to_string({_skills('s')}, '|') AS required_skills, "
    "array_to_string(" + _skills(
        "concat_ws(' ', CASE WHEN contains(s, 'preferred') THEN substr(s, strpos(s, 'preferred')) END,"
        " CASE WHEN contains(s, 'bonus') THEN substr(s, strpos(s, 'bonus')) END)"
    ) + ", '|') AS nice_to_have_skills, "
    "length(trim(cleaned_description)) < 400 AS short, "
    f"CASE WHEN {duck.first_label({k: duck.any_term('s', v) for k, v in REMOTE.items()}, 'unknown')} = 'unknown'"
    " THEN 'NEEDS_REVIEW' ELSE 'COMPLETE' END AS normalization_status FROM hay"
)


@query("n15_other_rulebook", _BOOK_CHECK)
def n15_other(spark, sf_dir):
    """N1-N14 with every table replaced."""
    found = classify.with_eligibility(listings(spark, sf_dir), BOOK)
    lists = ("academic_levels", "degree_requirements", "required_skills", "nice_to_have_skills")
    return found.select(
        "doc_id", "program_type", "visa_status", "remote_type", "clearance_required", "normalization_status",
        *[joined(c).alias(c) for c in lists], F.array_contains("review_reasons", "short_description").alias("short"),
    )


QUEUES = {"first": ("a", "ab"), "second": ("b.", "shop"), "third": ("e", "ex")}


@query(
    "rt3_other_markers",
    "SELECT page_id, " + duck.first_label({k: duck.any_term("lower(url)", v) for k, v in QUEUES.items()}, "rest")
    + " AS queue FROM pages",
)
def rt3_other(spark, sf_dir):
    """RT3 with other queues."""
    return given(spark, sf_dir, "pages").select("page_id", routing.choose_queue(F.col("url"), QUEUES, "rest").alias("queue"))


AUDIENCES = {"zeta": ("career", "car"), "alpha": ("engineer", "engine", "gin"), "mid": ("info", "o s")}
TYPES = {"talk": ("session", "info"), "fair": ("fair",)}
FIRMS = {"Firm Two": ("finance", ("two", "user 2")), "Career": ("other", ("career", "fair"))}

_TITLE = "lower(event_title || ' ' || coalesce(description, ''))"
_FIRM = "CASE " + " ".join(
    f"WHEN regexp_matches({_TITLE}, '(^|[^a-z0-9])({'|'.join(words)})($|[^a-z0-9])') THEN '{name}|{kind}'"
    for name, (kind, words) in FIRMS.items()
) + " ELSE '' END"


@query(
    "e12_other_tables",
    with_events(
        f"SELECT event_id, array_to_string(list_sort({duck.label_list({k: duck.any_term(_TITLE, v) for k, v in AUDIENCES.items()})}), '|')"
        f" AS audience, {duck.first_label({k: duck.any_term(_TITLE, v) for k, v in TYPES.items()}, 'none')} AS kind, {_FIRM} AS firm FROM ev"
    ),
)
def e12_other(spark, sf_dir):
    """E9, E11 and E12 with other tables."""
    c = F.col
    text = F.concat_ws(" ", "event_title", F.coalesce("description", F.lit("")))
    firm = events.firm_match(text, F.array().cast("array<string>"), c("firm_name"), c("firm_kind"), FIRMS)
    return view(spark, sf_dir, "recruiting_events").select(
        "event_id", joined(events.audience_tags(text, AUDIENCES)).alias("audience"),
        events.event_type(c("event_title"), c("description"), TYPES, "none").alias("kind"),
        F.coalesce(F.concat_ws("|", firm.firm_name, firm.firm_kind), F.lit("")).alias("firm"),
    )


RELEVANT = dataclasses.replace(
    relevance.TERMS, strong_titles=("intern",), weak_titles=("engineer", "analyst"), negative_titles=("senior",),
    departments=("research", "software"), skills=("sql",),
)


@query(
    "r2_other_terms",
    duck.with_jobs(
        f"SELECT doc_id, CASE WHEN {duck.has_term('job_title', ('senior',))}"
        f" AND NOT {duck.has_term('job_title', relevance.TERMS.technical_nouns)} THEN false"
        f" WHEN {duck.has_term('job_title', ('intern',))} THEN true"
        f" WHEN {duck.has_term('job_title', ('engineer', 'analyst'))} AND (t OR k OR d) THEN true"
        f" ELSE t AND k AND NOT {duck.has_term('job_title', ('senior',))} END AS is_relevant FROM ("
        "SELECT *, " + duck.has_term("array_to_string(departments, ' ')", ("research", "software")) + " AS t,"
        " list_has_any(list_concat(required_skills, nice_to_have_skills), ['sql']) AS k, "
        + duck.has_term(
            "CASE WHEN cleaned_description <> '' THEN cleaned_description ELSE coalesce(raw_description, '') END",
            relevance.TERMS.descriptions,
        ) + " AS d FROM elig)"
    ),
)
def r2_other(spark, sf_dir):
    """R2 with other terms."""
    judged = relevance.with_relevance(classify.with_eligibility(listings(spark, sf_dir)), terms=RELEVANT)
    return judged.select("doc_id", "is_relevant")
