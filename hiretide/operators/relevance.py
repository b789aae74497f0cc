"""Relevance of a listing to software and quantitative work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide import rules
from hiretide.functions.expr import bound, contains_any, strings, strip


def padded(text: Column) -> Column:
    """Lower-case, slashes, hyphens and underscores as blanks, padded."""
    return F.concat(F.lit(" "), F.translate(F.lower(text), "/-_", "   "), F.lit(" "))


def has_term(padded_text: Column, terms) -> Column:
    """A term must be delimited by blanks on both sides."""
    spaced = [" " + t.translate(str.maketrans("/-_", "   ")) + " " for t in terms]
    return contains_any(padded_text, spaced)


@dataclass(frozen=True)
class RelevanceTerms:
    """The tables of R2; terms are delimited by blanks."""

    strong_titles: tuple[str, ...] = rules.STRONG_TITLE_TERMS
    weak_titles: tuple[str, ...] = rules.WEAK_TITLE_TERMS
    negative_titles: tuple[str, ...] = rules.NEGATIVE_TITLE_TERMS
    technical_nouns: tuple[str, ...] = rules.TECHNICAL_NOUNS
    departments: tuple[str, ...] = rules.RELEVANT_DEPARTMENT_TERMS
    skills: tuple[str, ...] = rules.RELEVANT_SKILLS
    descriptions: tuple[str, ...] = rules.RELEVANT_DESCRIPTION_TERMS


TERMS = RelevanceTerms()


def is_relevant(title: Column, departments: Column, required: Column, nice: Column,
                description: Column, terms: RelevanceTerms = TERMS) -> Column:
    """R2.  The description is searched only when a weak title needs it."""
    teams = padded(F.coalesce(F.array_join(departments, " "), F.lit("")))
    skills = F.transform(F.concat(required, nice), lambda s: F.lower(strip(s)))
    body = padded(F.coalesce(description, F.lit("")))

    def judge(heading: Column) -> Column:
        negative = has_term(heading, terms.negative_titles)
        technical = has_term(heading, terms.technical_nouns)
        team = bound(teams, lambda t: has_term(t, terms.departments))
        skilled = F.arrays_overlap(skills, strings(terms.skills))
        described = bound(body, lambda t: has_term(t, terms.descriptions))
        return (
            F.when(negative & ~technical, False)
            .when(has_term(heading, terms.strong_titles), True)
            .when(has_term(heading, terms.weak_titles) & (team | skilled | described), True)
            .otherwise(team & skilled & ~negative)
        )

    return bound(padded(F.coalesce(title, F.lit(""))), judge)


def relevance_text(cleaned: Column, raw: Column) -> Column:
    """Cleaned text, raw text when that is empty, else nothing."""
    return F.coalesce(F.nullif(cleaned, F.lit("")), raw, F.lit(""))


def with_relevance(df: DataFrame, name: str = "is_relevant", terms: RelevanceTerms = TERMS) -> DataFrame:
    """R3 over flat listing and eligibility columns."""
    c = F.col
    verdict = is_relevant(
        c("job_title"), c("departments"), c("required_skills"), c("nice_to_have_skills"),
        relevance_text(c("cleaned_description"), c("raw_description")), terms,
    )
    return df.withColumn(name, verdict)


def sweep(jobs: DataFrame, terms: RelevanceTerms = TERMS) -> DataFrame:
    """Deactivate active jobs that are not relevant."""
    judged = with_relevance(jobs, "_relevant", terms)
    return judged.withColumn("is_active", F.col("is_active") & F.col("_relevant")).drop("_relevant")


def sweep_summary(jobs: DataFrame) -> DataFrame:
    """R4 counters.  A dry run and a real run report the same numbers."""
    slim = jobs.filter("is_active").select(
        "company_id", "job_title", "departments", "required_skills", "nice_to_have_skills",
        "cleaned_description", "raw_description",
    )
    kept = F.col("_relevant")
    return with_relevance(slim, "_relevant").agg(
        F.count(F.lit(1)).alias("active_before"),
        F.count(F.lit(1)).alias("checked"),
        F.count_if(kept).alias("kept_active"),
        F.count_if(~kept).alias("marked_inactive"),
        F.count_if(kept).alias("active_after"),
        F.countDistinct(F.when(kept, F.col("company_id"))).alias("active_companies_after"),
    )
