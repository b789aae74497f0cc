"""Registered queries: text cleaning, eligibility, relevance (TX, N, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hiretide import rules
from hiretide.functions import text as tx
from hiretide.functions.expr import mentions
from hiretide.operators import classify, relevance
from hiretide.plans import duck_rules as duck
from hiretide.plans.dialect import SPARK
from hiretide.plans.registry import query
from hiretide.plans.standin import duck_views, given, view
from hiretide.plans.tables import as_of, eligible, joined, jobs, listings, yes_no

# --- text ---------------------------------------------------------------------

_BLOCKS = "|".join(rules.BLOCK_TAGS)


def _page_text(x: str) -> str:
    """Tag stripping for the given pages: script bodies are character data, so the
    one tag-like string in them is hidden first."""
    x = f"replace({x}, 'var t=\"</p>\";', 'var t=\"' || chr(1) || '/p' || chr(2) || '\";')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g')"
    x = f"regexp_replace({x}, '(?i)</?({_BLOCKS})(\\s[^>]*)?/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '</?[a-zA-Z][^>]*>', '', 'g')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"),
                         ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"replace(replace({x}, chr(1), '<'), chr(2), '>')"


@query(
    "tx1_html_to_text",
    f"SELECT page_id, {duck.tidy(_page_text('html'))} AS body FROM pages",
)
def tx1(spark, sf_dir):
    return given(spark, sf_dir, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("body"))


@query("tx2_clean_description", duck.with_cleaned("SELECT doc_id, cleaned_description FROM cleaned"))
def tx2(spark, sf_dir):
    return classify.with_cleaned(listings(spark, sf_dir)).select("doc_id", "cleaned_description")


@query(
    "tx3_strip_boilerplate",
    duck.with_listings(f"SELECT doc_id, {duck.without_boilerplate('raw_description')} AS body FROM listings"),
)
def tx3(spark, sf_dir):
    return listings(spark, sf_dir).select("doc_id", tx.strip_boilerplate(F.col("raw_description")).alias("body"))


@query("tx4_searchable", duck.with_cleaned("SELECT doc_id, s AS haystack FROM hay"))
def tx4(spark, sf_dir):
    hay = classify.with_searchable(classify.with_cleaned(listings(spark, sf_dir)))
    return hay.select("doc_id", F.col("_searchable").alias("haystack"))


def _one_line(x: str) -> str:
    """Text outside scripts and styles with a blank for every tag, squeezed to one line."""
    x = f"regexp_replace({x}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g')"
    x = f"regexp_replace({x}, '</?[a-zA-Z][^>]*>', ' ', 'g')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"),
                         ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"trim(regexp_replace({x}, '[\\s\\x{{A0}}]+', ' ', 'g'))"


@query("tx5_single_line_text", f"SELECT page_id, {_one_line('html')} AS body FROM pages")
def tx5(spark, sf_dir):
    return given(spark, sf_dir, "pages").select("page_id", tx.single_line_text(F.col("html")).alias("body"))


_PREVIEW = "html"
for _pattern, _to in (
    ("(?i)<br\\s*/?>", "chr(10)"), ("(?i)</p>", "chr(10) || chr(10)"), ("(?i)<li>", "chr(10) || '- '"),
    ("<[^>]+>", "''"), ("&nbsp;", "' '"), ("&amp;", "'&'"), ("&#x2019;|&rsquo;", "''''"),
    ("&#x201C;|&ldquo;|&#x201D;|&rdquo;", "'\"'"), ("\\n{3,}", "chr(10) || chr(10)"), ("[ \\t]{2,}", "' '"),
    ("^\\s+|\\s+$", "''"),
):
    _PREVIEW = f"regexp_replace({_PREVIEW}, '{_pattern}', {_to}, 'g')"


@query("tx6_display_text", f"SELECT page_id, {_PREVIEW} AS body FROM pages")
def tx6(spark, sf_dir):
    return given(spark, sf_dir, "pages").select("page_id", tx.display_text(F.col("html")).alias("body"))


@query(
    "tx7_alias_match",
    duck.with_cleaned(
        "SELECT doc_id, "
        + ", ".join(f"{duck.alias('s', a)} AS m{i}" for i, a in enumerate(rules.SKILL_ALIASES.values()))
        + " FROM hay"
    ),
)
def tx7(spark, sf_dir):
    hay = classify.with_searchable(classify.with_cleaned(listings(spark, sf_dir)))
    matches = [
        mentions(F.col("_searchable"), a, tx.alias_pattern(a)).alias(f"m{i}")
        for i, a in enumerate(rules.SKILL_ALIASES.values())
    ]
    return hay.select("doc_id", *matches)


@query(
    "tx8_slug",
    duck.with_listings(
        "SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(trim(job_title)), '[^a-z0-9]+', '_', 'g'), '_'), ''),"
        " 'recruiting') AS slug FROM listings"
    ),
)
def tx8(spark, sf_dir):
    return listings(spark, sf_dir).select("doc_id", tx.slug(F.col("job_title")).alias("slug"))


# --- eligibility ----------------------------------------------------------------


def _joined_sql(column: str) -> str:
    return f"array_to_string({column}, '|')"


def _yes_no_sql(column: str) -> str:
    return f"CASE WHEN {column} THEN 'yes' WHEN NOT {column} THEN 'no' ELSE 'unknown' END"


_FIELDS = {
    "n1_program_type": ("program_type", F.col, "program_type"),
    "n2_academic_levels": ("academic_levels", joined, _joined_sql("academic_levels")),
    "n3_degree_requirements": ("degree_requirements", joined, _joined_sql("degree_requirements")),
    "n4_grad_years": ("required_grad_years", joined, _joined_sql("required_grad_years")),
    "n5_visa_status": ("visa_status", F.col, "visa_status"),
    "n6_visa_sponsorship": ("visa_sponsorship", yes_no, _yes_no_sql("visa_sponsorship")),
    "n7_required_skills": ("required_skills", joined, _joined_sql("required_skills")),
    "n8_nice_to_have_skills": ("nice_to_have_skills", joined, _joined_sql("nice_to_have_skills")),
    "n9_min_gpa": ("min_gpa", lambda c: F.coalesce(c, F.lit(-1.0)), "coalesce(min_gpa, -1.0)"),
    "n10_clearance_required": ("clearance_required", F.col, "clearance_required"),
    "n11_remote_type": ("remote_type", F.col, "remote_type"),
    "n12_review_reasons": ("review_reasons", joined, _joined_sql("review_reasons")),
    "n13_confidence": ("confidence", F.col, "confidence"),
    "n14_normalization_status": ("normalization_status", F.col, "normalization_status"),
}


def _register_field(name: str, column: str, shape, sql: str) -> None:
    @query(name, duck.with_jobs(f"SELECT doc_id, {sql} AS {column} FROM elig"))
    def build(spark, sf_dir):
        # only this field is selected, so Catalyst prunes the other rules
        value = F.col(column) if shape is F.col else shape(F.col(column))
        return eligible(spark, sf_dir).select("doc_id", value.alias(column))


for _name, (_column, _shape, _sql) in _FIELDS.items():
    _register_field(_name, _column, _shape, _sql)

_ALL = ", ".join(f"{sql} AS {column}" for column, _, sql in _FIELDS.values())


def _flat(records):
    n = F.col("normalization")
    shaped = []
    for column, shape, _ in _FIELDS.values():
        value = n[column] if shape is F.col else shape(n[column])
        shaped.append(value.alias(column))
    return records.select(F.col("job.doc_id").alias("doc_id"), *shaped)


@query("n15_heuristic_normalize", duck.with_jobs(f"SELECT doc_id, {_ALL} FROM elig"))
def n15(spark, sf_dir):
    return _flat(classify.normalize(listings(spark, sf_dir), as_of()))


@query(
    "n16_review_gate",
    duck.with_jobs(
        "SELECT doc_id, confidence FROM elig WHERE normalization_status = 'NEEDS_REVIEW' OR confidence < 0.75"
    ),
)
def n16(spark, sf_dir):
    gated = classify.needs_second_stage(classify.normalize(listings(spark, sf_dir), as_of()))
    return gated.select(F.col("job.doc_id").alias("doc_id"), F.col("normalization.confidence").alias("confidence"))


# Landed answers: one per assistant turn, valid and invalid shapes in turn.
_ANSWERS = (
    '{"program_type": "internship", "visa_sponsorship": true, "required_skills": ["python"]}',
    'Sure! {"program_type": "new_grad", "confidence": 0.9, "remote_type": "remote"} Done.',
    '{"program_type": "wizard"}',
    '{"program_type": "other", "confidence": 1.5}',
    '{"program_type": "other", "surprise": 1}',
    'no object here',
    '{"program_type": "experienced", "visa_status": "sponsors", "academic_levels": ["phd"], "min_gpa": null}',
)


def _answer_case(text) -> str:
    arms = " ".join(f"WHEN {i} THEN {text(a)}" for i, a in enumerate(_ANSWERS))
    return f"CASE CAST((conv_id + turn) % {len(_ANSWERS)} AS INT) {arms} END"


def _answers(spark, sf_dir):
    turns = given(spark, sf_dir, "conversations").filter("role = 'assistant'")
    picked = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.min("turn").alias("turn"))
    landed = picked.withColumnRenamed("doc_id", "conv_id").selectExpr(
        "conv_id AS doc_id", f"{_answer_case(SPARK.text)} AS response"
    )
    return listings(spark, sf_dir).join(landed, "doc_id").select("content_hash", "response")


def _n17_check() -> str:
    # verdict of each answer shape, stated rather than parsed
    case = "CAST((a.doc_id + a.turn) % 7 AS INT)"
    program = f"CASE {case} WHEN 0 THEN 'internship' WHEN 1 THEN 'new_grad' WHEN 6 THEN 'experienced' END"
    visa = f"CASE {case} WHEN 0 THEN 'sponsors' WHEN 1 THEN 'not_mentioned' WHEN 6 THEN 'sponsors' END"
    conf = f"CASE {case} WHEN 1 THEN 0.9 ELSE 0.8 END"
    used = f"(a.doc_id IS NOT NULL AND {program} IS NOT NULL AND (e.normalization_status = 'NEEDS_REVIEW' OR e.confidence < 0.75))"
    return duck.with_jobs(
        f"SELECT e.doc_id, CASE WHEN {used} THEN 'ollama' ELSE 'heuristic' END AS method, "
        f"CASE WHEN {used} THEN {program} ELSE e.program_type END AS program_type, "
        f"CASE WHEN {used} THEN {visa} ELSE e.visa_status END AS visa_status, "
        f"CASE WHEN {used} THEN CAST({conf} AS DOUBLE) ELSE e.confidence END AS confidence "
        "FROM elig e LEFT JOIN answers a ON a.doc_id = e.doc_id",
        extra="answers AS (SELECT conv_id AS doc_id, min(turn) AS turn FROM conversations"
        " WHERE role = 'assistant' GROUP BY conv_id)",
    )


@query("n17_apply_model_output", _n17_check())
def n17(spark, sf_dir):
    records = classify.normalize(listings(spark, sf_dir), as_of())
    merged = classify.apply_answers(records, _answers(spark, sf_dir))
    n = F.col("normalization")
    return merged.select(
        F.col("job.doc_id").alias("doc_id"), F.col("normalization_method").alias("method"),
        n.program_type.alias("program_type"), n.visa_status.alias("visa_status"), n.confidence.alias("confidence"),
    )


@query(
    "n18_normalize_run",
    duck.with_jobs(
        "SELECT e.doc_id, min(r.run_ord) AS run_ord, any_value(e.program_type) AS program_type,"
        " any_value(e.normalization_status) AS normalization_status"
        " FROM elig e JOIN runs r ON r.doc_id = e.doc_id GROUP BY e.doc_id",
        "runs",
    ),
)
def n18(spark, sf_dir):
    run = classify.normalize_run(view(spark, sf_dir, "runs"), ["run_ord", "pos"], as_of())
    job, n = F.col("job"), F.col("normalization")
    return run.select(
        job.doc_id.alias("doc_id"), job.run_ord.cast("bigint").alias("run_ord"),
        n.program_type.alias("program_type"), n.normalization_status.alias("normalization_status"),
    )


@query(
    "n18_run_counts",
    f"WITH {duck_views('runs')}\n"
    "SELECT count(*) AS source_job_count, count(DISTINCT content_hash) AS normalized_job_count,"
    " count(*) - count(DISTINCT content_hash) AS duplicate_job_count FROM runs",
)
def n18_counts(spark, sf_dir):
    return classify.run_counts(view(spark, sf_dir, "runs"))


@query(
    "n18_status_counts",
    duck.with_jobs("SELECT normalization_status AS status, count(*) AS records FROM elig GROUP BY 1"),
)
def n18_status(spark, sf_dir):
    return classify.status_counts(classify.normalize(listings(spark, sf_dir), as_of()))


@query(
    "n19_audit_sample",
    duck.with_jobs(
        "SELECT doc_id, confidence FROM jobs WHERE normalization_status = 'NEEDS_REVIEW'"
        " ORDER BY sha256(content_hash || '|7'), content_hash LIMIT 50"
    ),
)
def n19(spark, sf_dir):
    records = classify.normalize(listings(spark, sf_dir), as_of())
    sample = classify.audit_sample(records, 50, seed=7, needs_review_only=True)
    return sample.select(F.col("job.doc_id").alias("doc_id"), F.col("normalization.confidence").alias("confidence"))


# --- relevance --------------------------------------------------------------------


@query(
    "r1_padded_terms",
    duck.with_listings(
        f"SELECT doc_id, {duck.padded('job_title')} AS padded_title,"
        f" {duck.has_term('job_title', rules.STRONG_TITLE_TERMS)} AS strong,"
        f" {duck.has_term('job_title', rules.WEAK_TITLE_TERMS)} AS weak,"
        f" {duck.has_term('job_title', rules.NEGATIVE_TITLE_TERMS)} AS negative FROM listings"
    ),
)
def r1(spark, sf_dir):
    heading = relevance.padded(F.col("job_title"))
    return listings(spark, sf_dir).select(
        "doc_id", heading.alias("padded_title"),
        relevance.has_term(heading, rules.STRONG_TITLE_TERMS).alias("strong"),
        relevance.has_term(heading, rules.WEAK_TITLE_TERMS).alias("weak"),
        relevance.has_term(heading, rules.NEGATIVE_TITLE_TERMS).alias("negative"),
    )


@query("r2_is_relevant", duck.with_jobs("SELECT doc_id, is_relevant FROM elig"))
def r2(spark, sf_dir):
    return relevance.with_relevance(eligible(spark, sf_dir)).select("doc_id", "is_relevant")


@query(
    "r3_record_relevance",
    duck.with_jobs("SELECT program_type, is_relevant, count(*) AS records FROM elig GROUP BY 1, 2"),
)
def r3(spark, sf_dir):
    judged = relevance.with_relevance(eligible(spark, sf_dir))
    return judged.groupBy("program_type", "is_relevant").agg(F.count(F.lit(1)).alias("records"))


# the rule columns that a sweep reads
SWEPT = ("cleaned_description", "required_skills", "nice_to_have_skills")


@query(
    "r4_relevance_sweep",
    duck.with_jobs("SELECT doc_id, (doc_id % 3 <> 0 AND is_relevant) AS is_active FROM jobs"),
)
def r4(spark, sf_dir):
    before = jobs(spark, sf_dir, SWEPT).withColumn("is_active", F.col("doc_id") % 3 != 0)
    return relevance.sweep(before).select("doc_id", "is_active")


@query(
    "r4_sweep_summary",
    duck.with_jobs(
        "SELECT count(*) AS active_before, count(*) AS checked, count_if(is_relevant) AS kept_active,"
        " count_if(NOT is_relevant) AS marked_inactive, count_if(is_relevant) AS active_after,"
        " count(DISTINCT CASE WHEN is_relevant THEN company_id END) AS active_companies_after FROM jobs"
    ),
)
def r4_summary(spark, sf_dir):
    return relevance.sweep_summary(jobs(spark, sf_dir, SWEPT).withColumn("is_active", F.lit(True)))
