"""Eligibility classification of listings (N1-N19): native column rules."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide import rules
from hiretide.functions import text as tx
from hiretide.functions.expr import (
    alternation, bound, computed_once, contains_any, first_label, labels, labels_where, mentions, no_strings, strings, strip,
)
from hiretide.functions.terms import (
    Table, any_found, first_label_found, first_label_scan, found_terms, label_scan, labels_found, terms_of, trie_pattern,
)
from hiretide.operators.skew import best_per_key
from hiretide.rulebook import DEFAULT, Rulebook


def program_type(text: Column, book: Rulebook = DEFAULT) -> Column:
    """N1.  Precedence: intern words, new-grad phrases, experience, other."""
    # the pattern can only match where a shortest word occurs
    stems = [w for w in book.intern_words if not any(w != o and o in w for o in book.intern_words)]
    intern = mentions(text, stems, rf"\b(?:{alternation(book.intern_words)})\b")
    new_grad = mentions(text, book.new_grad_phrases, tx.alias_pattern(book.new_grad_phrases))
    experience = mentions(text, ("year",), r"\b[3-9]\+?\s+years?\b")
    return first_label(
        {
            "internship": intern | contains_any(text, book.intern_signs),
            "new_grad": new_grad,
            "experienced": experience | contains_any(text, book.experienced_signs),
        },
        "other",
    )


def academic_levels(text: Column, table: Table = rules.ACADEMIC_LEVEL_TERMS) -> Column:
    """N2."""
    return label_scan(text, table)


def degree_requirements(text: Column, table: Table = rules.DEGREE_TERMS) -> Column:
    """N3."""
    return label_scan(text, table)


YEAR = r"20(?:2[4-9]|3[0-5])"
FIRST_YEAR, LAST_YEAR = rules.FIRST_GRAD_YEAR, rules.LAST_GRAD_YEAR
_MERGED = "pos bigint, term bigint, taken bigint, waiting array<struct<e: bigint, reach: int, bits: bigint>>, bits bigint"


def grad_years(
    text: Column, context: Iterable[str] = rules.STUDENT_CONTEXT_TERMS, reach: int = rules.GRAD_YEAR_REACH,
    range_reach: int = rules.GRAD_RANGE_REACH,
) -> Column:
    """N4.  Years and year ranges with a student term near them, sorted.

    Two scans take what the text holds in order: one the years (with the range they
    open) and terms themselves, one the stretches between their starts.  The list is
    then merged in one fold that keeps the last term's start, the end of the last
    range, the years (as bits) that are settled, and those still waiting for a term
    within reach.
    """
    context = list(context)
    if any(c.isdigit() for t in context for c in t):
        raise ValueError("student terms hold no digits")
    year = rf"\b{YEAR}\b"
    # fixed pattern
    token = rf"{year}(?:\s*(?:-|to|through|and|or|,)\s*{year})?"
    if context:
        token = rf"{token}|{trie_pattern(context, longest=False)}"
    first = rf"[{re.escape(''.join(sorted({'2', *(t[0] for t in context)})))}]"
    tokens = F.regexp_extract_all(text, F.lit(rf"(?={first})(?=({token}))"), 1)
    # one blank before the text, so that a token follows each stretch; none follows the last
    stretches = F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(rf"(?s).+?(?=(?={first})(?:{token})|\z)"), 0)
    steps = F.zip_with(
        tokens, stretches,
        lambda t, s: F.struct(t.alias("token"), F.length(s).cast("bigint").alias("step")),
    )
    long = lambda value: F.lit(value).cast("bigint")

    def bit(y: Column) -> Column:
        return F.call_function("shiftleft", long(1), (y - FIRST_YEAR).cast("int"))

    def merge(acc: Column, x: Column) -> Column:
        start = acc.pos + x.step
        ends = start + F.length(x.token)
        # a term: settles those waiting that it lies wholly within the reach of
        reached = lambda w: (w.e <= start) & (w.e >= ends - w.reach)
        gained = F.aggregate(F.filter(acc.waiting, reached), long(0), lambda b, w: b.bitwiseOR(w.bits))
        still = F.filter(acc.waiting, lambda w: ~reached(w) & (w.e + w.reach >= start))
        after_term = F.struct(
            start.alias("pos"), start.alias("term"), acc.taken.alias("taken"), still.alias("waiting"),
            acc.bits.bitwiseOR(gained).alias("bits"),
        )
        # a year, and the range it opens unless an earlier range took it
        first, last = F.substring(x.token, 1, 4).cast("int"), F.substring(x.token, -4, 4).cast("int")
        opens = (F.length(x.token) > 4) & (start >= acc.taken)
        whole = F.when(opens & (first <= last), bit(last) * 2 - bit(first)).otherwise(long(0))

        def entry(end: Column, within: int, bits: Column) -> Column:
            return F.struct(end.alias("e"), F.lit(within).alias("reach"), bits.alias("bits"))

        new = F.array(entry(start + 4, reach, bit(first)), entry(ends, range_reach, whole))
        near = lambda w: acc.term >= start - w.reach
        settled = F.aggregate(F.filter(new, near), long(0), lambda b, w: b.bitwiseOR(w.bits))
        open_ = F.filter(acc.waiting, lambda w: w.e + w.reach >= start)
        after_year = F.struct(
            start.alias("pos"), acc.term.alias("term"), F.when(opens, ends).otherwise(acc.taken).alias("taken"),
            F.concat(open_, F.filter(new, lambda w: ~near(w) & (w.bits != 0))).alias("waiting"),
            acc.bits.bitwiseOR(settled).alias("bits"),
        )
        kept = F.when(x.token.isNull(), acc).when(F.ascii(x.token).between(48, 57), after_year.cast(f"struct<{_MERGED}>"))
        return kept.otherwise(after_term.cast(f"struct<{_MERGED}>"))

    zero = F.expr(f"cast(struct(-1L, -1000000L, 0L, array(), 0L) AS struct<{_MERGED}>)")
    bits = F.aggregate(steps, zero, merge, lambda acc: acc.bits)
    span = F.sequence(F.lit(FIRST_YEAR), F.lit(LAST_YEAR))
    years = bound(bits, lambda b: F.filter(span, lambda y: b.bitwiseAND(bit(y)) != 0))
    return F.when(contains_any(text, ("202", "203")), years).otherwise(F.array().cast("array<int>"))


def visa_status(text: Column, table: Table = rules.VISA_TERMS, default: str = "not_mentioned") -> Column:
    """N5.  First group with a matching phrase, in table order."""
    return first_label_scan(text, table, default)


def visa_sponsorship(status: Column) -> Column:
    """N6."""
    return F.when(status.isin("sponsors", "opt_cpt_allowed"), True).when(
        status.isin("does_not_sponsor", "requires_authorization"), False
    )


def _mentioned_aliases(text: Column, table: Table = rules.SKILL_ALIASES) -> Column:
    """Every skill alias found, in one pass over the text."""
    aliases = terms_of(table)
    if not aliases:
        return no_strings()
    initials = "".join(sorted({a[0] for a in aliases}))
    initials = "".join(map(re.escape, initials))
    guarded = rf"(?<![a-z0-9-])(?=[{initials}])({alternation(aliases)})(?![a-z0-9-])"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(guarded), 1))


def skills_from_aliases(found: Column, table: Table = rules.SKILL_ALIASES) -> Column:
    """Skills of the found aliases; bound, or the scan would run again for every skill."""
    return bound(found, lambda f: labels_where(table, lambda aliases: F.arrays_overlap(f, aliases)))


def required_skills(text: Column, table: Table = rules.SKILL_ALIASES) -> Column:
    """N7.  Canonical skills in table order."""
    return skills_from_aliases(_mentioned_aliases(text, table), table)


def nice_to_have_text(text: Column, markers: Iterable[str] = rules.NICE_TO_HAVE_MARKERS) -> Column:
    """Text from the first occurrence of each nice-to-have marker to the end."""
    sections = []
    for marker in markers:
        at = F.locate(marker, text)
        sections.append(F.when(at > 0, text.substr(at, F.length(text))))
    return F.concat_ws(" ", *sections)


def nice_to_have_skills(text: Column, book: Rulebook = DEFAULT) -> Column:
    """N8."""
    return required_skills(nice_to_have_text(text, book.nice_to_have_markers), book.skills)


def min_gpa(text: Column) -> Column:
    """N9.  The first pattern that matches decides, even if out of range."""
    # fixed patterns
    leading = r"\b(?:minimum\s+)?(?:gpa|grade point average)\s*(?:of|:)?\s*([0-4]\.\d{1,2})\b"
    trailing = r"\b([0-4]\.\d{1,2})\s*(?:minimum\s+)?gpa\b"
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("double") for p in (leading, trailing)]
    value = F.when(contains_any(text, ("gpa", "grade point average")), F.coalesce(*found))
    return F.when(value.between(0.0, 4.0), value)


def clearance_required(text: Column, terms: Iterable[str] = rules.CLEARANCE_TERMS) -> Column:
    """N10."""
    return contains_any(text, terms)


def remote_type(text: Column, table: Table = rules.REMOTE_TERMS, default: str = "unknown") -> Column:
    """N11.  The haystack already holds the locations."""
    return first_label_scan(text, table, default)


def review_reasons(cleaned, program, levels, years, visa, remote, short: int = rules.SHORT_DESCRIPTION_CHARS) -> Column:
    """N12."""
    body = F.length(strip(cleaned))
    return labels(
        {
            "missing_description": body == 0,
            "short_description": body < short,
            "student_role_without_explicit_eligibility":
                program.isin("internship", "new_grad") & (F.size(years) == 0) & (F.size(levels) == 0),
            "ambiguous_visa_language": visa == "unclear",
            "unknown_remote_type": remote == "unknown",
        }
    )


def confidence(reasons: Column) -> Column:
    """N13.  Starts at 0.88 and loses 0.12 per reason (at most 0.55); a missing
    description costs at least 0.45; no reason at all scores 0.92."""
    lost = F.least(F.lit(0.55), F.size(reasons) * 0.12)
    lost = F.when(F.array_contains(reasons, "missing_description"), F.greatest(lost, F.lit(0.45))).otherwise(lost)
    return F.when(F.size(reasons) == 0, F.lit(0.92)).otherwise(
        F.round(F.greatest(F.lit(0.2), F.lit(0.88) - lost), 2)
    )


def normalization_status(reasons: Column, blocking: Iterable[str] = rules.BLOCKING_REASONS) -> Column:
    """N14."""
    blocked = F.arrays_overlap(reasons, strings(blocking))
    return F.when(blocked, "NEEDS_REVIEW").otherwise("COMPLETE")


NORMALIZATION_FIELDS = (
    "program_type", "academic_levels", "degree_requirements", "required_grad_years",
    "visa_sponsorship", "visa_status", "required_skills", "nice_to_have_skills",
    "min_gpa", "clearance_required", "remote_type", "normalization_status",
    "confidence", "review_reasons",
)


def with_cleaned(listings: DataFrame) -> DataFrame:
    cleaned = tx.clean_description(F.col("raw_description"), F.col("description_html"))
    return listings.withColumn("cleaned_description", cleaned)


def with_searchable(cleaned: DataFrame) -> DataFrame:
    c = F.col
    haystack = tx.searchable(
        c("job_title"), c("company_name"), c("location"), c("employment_type"),
        c("departments"), c("cleaned_description"),
    )
    return cleaned.withColumn("_searchable", haystack)


def with_eligibility(listings: DataFrame, book: Rulebook = DEFAULT) -> DataFrame:
    """N15 as flat columns.  Each stage materialises what the next one reads more
    than once, so no text is cleaned or scanned twice.  All tables of plain terms
    share one scan of the text."""
    text, c = F.col("_searchable"), F.col
    shared = terms_of(book.academic_levels, book.degrees, book.visa, book.remote, {"clearance": book.clearance})
    df = with_searchable(with_cleaned(listings))
    df = df.withColumns(
        {
            "_terms": found_terms(text, shared),
            "program_type": program_type(text, book),
            "required_grad_years": grad_years(text, book.student_context, book.year_reach, book.year_range_reach),
            "_found": _mentioned_aliases(text, book.skills),
            "_found_nice": _mentioned_aliases(nice_to_have_text(text, book.nice_to_have_markers), book.skills),
            "min_gpa": min_gpa(text),
        }
    )
    df = df.withColumns(
        {
            "academic_levels": labels_found(c("_terms"), book.academic_levels, shared),
            "degree_requirements": labels_found(c("_terms"), book.degrees, shared),
            "visa_status": first_label_found(c("_terms"), book.visa, shared, "not_mentioned"),
            "clearance_required": any_found(c("_terms"), book.clearance, shared),
            "remote_type": first_label_found(c("_terms"), book.remote, shared, "unknown"),
            "required_skills": skills_from_aliases(c("_found"), book.skills),
            "nice_to_have_skills": skills_from_aliases(c("_found_nice"), book.skills),
        }
    )
    df = df.withColumns(
        {
            "visa_sponsorship": visa_sponsorship(c("visa_status")),
            "review_reasons": review_reasons(
                c("cleaned_description"), c("program_type"), c("academic_levels"), c("required_grad_years"),
                c("visa_status"), c("remote_type"), book.short_description_chars,
            ),
        }
    )
    return df.withColumns(
        {
            "confidence": confidence(c("review_reasons")),
            "normalization_status": normalization_status(c("review_reasons"), book.blocking_reasons),
        }
    ).drop("_searchable", "_terms", "_found", "_found_nice")


def normalize(listings: DataFrame, as_of: Column, book: Rulebook = DEFAULT) -> DataFrame:
    """Listing columns nested as ``job`` next to a ``normalization`` struct."""
    job = F.struct(*listings.columns)
    return with_eligibility(listings.withColumn("job", job), book).select(
        "job",
        "cleaned_description",
        F.struct(*NORMALIZATION_FIELDS).alias("normalization"),
        F.lit("heuristic").alias("normalization_method"),
        as_of.alias("normalized_at"),
    )


def dedupe_listings(listings: DataFrame, order: list[str]) -> DataFrame:
    """First listing per content hash, before any text is touched."""
    return best_per_key(listings, ["content_hash"], [F.col(c) for c in order])


def normalize_run(listings: DataFrame, order: list[str], as_of: Column, book: Rulebook = DEFAULT) -> DataFrame:
    return normalize(dedupe_listings(listings, order), as_of, book)


def run_counts(listings: DataFrame) -> DataFrame:
    """N18 counters that need no text work: source, normalized, duplicates."""
    per_hash = listings.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"))
    return per_hash.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("source_job_count"),
        F.count(F.lit(1)).alias("normalized_job_count"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_job_count"),
    )


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(F.col("normalization.normalization_status").alias("status")).agg(
        F.count(F.lit(1)).alias("records")
    )


def needs_second_stage(records: DataFrame, mode: str = "review") -> DataFrame:
    """Records worth sending to a second-stage model."""
    if mode == "all":
        return records
    if mode != "review":
        return records.limit(0)
    n = F.col("normalization")
    return computed_once(records).filter((n.normalization_status == "NEEDS_REVIEW") | (n.confidence < 0.75))


# --- second-stage answers ----------------------------------------------------

_LISTS = {
    "academic_levels": "string", "degree_requirements": "string", "required_grad_years": "int",
    "required_skills": "string", "nice_to_have_skills": "string", "review_reasons": "string",
}


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def parse_answer(response: Column) -> Column:
    """The JSON object of a model answer, or the outermost braces in it, as VARIANT."""
    whole = F.try_parse_json(response)
    braces = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    embedded = F.try_parse_json(F.nullif(braces, F.lit("")))
    return F.when(_kind(whole).startswith("OBJECT"), whole).when(
        _kind(embedded).startswith("OBJECT"), embedded
    )


def with_answer(df: DataFrame, answer: str) -> DataFrame:
    """N17, first half: typed ``_answer`` struct and ``_answer_ok`` verdict for a
    VARIANT column.  Unknown keys, wrong types, values outside an enumeration or
    bound all make the answer unusable."""
    a = F.col(answer)

    def field(name: str) -> Column:
        return F.try_variant_get(a, f"$.{name}", "variant")

    def absent(name: str) -> Column:
        return field(name).isNull()

    def null(name: str) -> Column:
        return F.coalesce(F.is_variant_null(field(name)), F.lit(False))

    def typed(name: str, kind: str) -> Column:
        return F.try_variant_get(a, f"$.{name}", kind)

    keys = F.json_object_keys(F.to_json(a))
    known = F.size(F.array_except(keys, strings(NORMALIZATION_FIELDS))) == 0

    def enum(name: str, allowed, required: bool = False) -> Column:
        ok = _kind(field(name)).eqNullSafe(F.lit("STRING")) & strip(typed(name, "string")).isin(*allowed)
        return F.coalesce(ok, F.lit(False)) if required else absent(name) | F.coalesce(ok, F.lit(False))

    def list_of(name: str, kind: str, allowed=None) -> Column:
        items = typed(name, "array<variant>")
        want = "STRING" if kind == "string" else "BIGINT"
        good = F.forall(items, lambda v: _kind(v) == want)
        if allowed:
            good = good & F.forall(typed(name, "array<string>"), lambda v: strip(v).isin(*allowed))
        return absent(name) | F.coalesce(good, F.lit(False))

    numeric = r"^(?:BIGINT|DOUBLE|DECIMAL.*|FLOAT)$"
    status_from_flag = (
        F.when(typed("visa_sponsorship", "boolean").isNull() | (_kind(field("visa_sponsorship")) != "BOOLEAN"), "not_mentioned")
        .when(typed("visa_sponsorship", "boolean"), "sponsors")
        .otherwise("does_not_sponsor")
    )
    confident = typed("confidence", "double")
    checks = [
        known,
        enum("program_type", rules.PROGRAM_TYPES, required=True),
        enum("visa_status", rules.VISA_STATUSES),
        enum("remote_type", rules.REMOTE_TYPES),
        enum("normalization_status", rules.NORMALIZATION_STATUSES),
        absent("confidence") | (_kind(field("confidence")).rlike(numeric) & confident.between(0.0, 1.0)),
        absent("visa_sponsorship") | null("visa_sponsorship") | (_kind(field("visa_sponsorship")) == "BOOLEAN"),
        absent("clearance_required") | (_kind(field("clearance_required")) == "BOOLEAN"),
        absent("min_gpa") | null("min_gpa") | _kind(field("min_gpa")).rlike(numeric),
        *[list_of(n, k, rules.ACADEMIC_LEVELS if n == "academic_levels" else None) for n, k in _LISTS.items()],
    ]
    ok = a.isNotNull()
    for check in checks:
        ok = ok & F.coalesce(check, F.lit(False))

    def listed(name: str) -> Column:
        kind = _LISTS[name]
        items = F.coalesce(typed(name, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
        return (F.transform(items, strip) if kind == "string" else items).alias(name)

    def scalar(name: str, kind: str, default) -> Column:
        value = typed(name, kind)
        value = strip(value) if kind == "string" else value
        return F.coalesce(value, default if isinstance(default, Column) else F.lit(default)).alias(name)

    parts = {
        "program_type": strip(typed("program_type", "string")).alias("program_type"),
        "visa_sponsorship": typed("visa_sponsorship", "boolean").alias("visa_sponsorship"),
        "visa_status": scalar("visa_status", "string", status_from_flag),
        "min_gpa": typed("min_gpa", "double").alias("min_gpa"),
        "clearance_required": scalar("clearance_required", "boolean", False),
        "remote_type": scalar("remote_type", "string", "unknown"),
        "normalization_status": scalar("normalization_status", "string", "COMPLETE"),
        "confidence": scalar("confidence", "double", 0.8),
        **{n: listed(n) for n in _LISTS},
    }
    return df.withColumn("_answer_ok", ok).withColumn(
        "_answer", F.when(ok, F.struct(*[parts[n] for n in NORMALIZATION_FIELDS]))
    )




def apply_answers(records: DataFrame, answers: DataFrame, mode: str = "review") -> DataFrame:
    """Replace the rule-based struct by a valid landed answer.

    ``answers``: one row per content_hash with the raw ``response`` text.  Only
    records behind the review gate take an answer.
    """
    n = F.col("normalization")
    gate = F.lit(True) if mode == "all" else (n.normalization_status == "NEEDS_REVIEW") | (n.confidence < 0.75)
    parsed = with_answer(
        answers.select("content_hash", parse_answer(F.col("response")).alias("_parsed")), "_parsed"
    ).select("content_hash", "_answer", "_answer_ok").filter("_answer_ok")
    joined = records.withColumn("content_hash", F.col("job.content_hash")).join(parsed, "content_hash", "left")
    use = F.coalesce(F.col("_answer_ok"), F.lit(False)) & gate
    return joined.withColumns(
        {
            "normalization": F.when(use, F.col("_answer")).otherwise(F.col("normalization")),
            "normalization_method": F.when(use, F.lit("ollama")).otherwise(F.col("normalization_method")),
        }
    ).drop("content_hash", "_answer", "_answer_ok")


def audit_sample(records: DataFrame, size: int, seed: int = 0, needs_review_only: bool = False) -> DataFrame:
    """Seeded sample without replacement (top-k by seeded hash: no shuffle
    of the records, each task keeps ``size`` candidates)."""
    records = computed_once(records)
    if needs_review_only:
        records = records.filter(F.col("normalization.normalization_status") == "NEEDS_REVIEW")
    content_hash = F.col("job.content_hash")
    return records.orderBy(F.sha2(F.concat_ws("|", content_hash, F.lit(seed)), 256), content_hash).limit(size)
