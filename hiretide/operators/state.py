"""Keyed upserts and staleness of the current-state tables.

An upsert is snapshot full-outer-join batch giving the next snapshot.  Batches are reduced to one row per key before
the join, so a key repeated a million times joins once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide.functions.expr import EMPTY_STRINGS, no_strings
from hiretide.operators.relevance import with_relevance
from hiretide.operators.routing import host
from hiretide.operators.skew import best_per_key

JOB_COLUMNS = (
    "id", "company_id", "company_name", "job_title", "job_url", "ats_provider", "ats_job_id", "location",
    "raw_description", "cleaned_description", "description_html", "employment_type", "departments",
    "date_posted", "content_hash", "extracted_at", "first_seen_at", "last_seen_at", "is_active",
    "program_type", "academic_levels", "degree_requirements", "required_grad_years", "visa_sponsorship",
    "visa_status", "required_skills", "nice_to_have_skills", "min_gpa", "clearance_required", "remote_type",
    "normalization_status", "normalization_method", "normalization_confidence",
    "normalization_review_reasons", "normalized_at",
)
# a listing's own columns, from which the rules make the others
LISTING_COLUMNS = (
    "company_name", "job_title", "job_url", "ats_provider", "ats_job_id", "location", "raw_description", "description_html",
    "employment_type", "departments", "date_posted", "content_hash", "extracted_at",
)
EVENT_COLUMNS = (
    "id", "source_id", "firm_name", "firm_kind", "event_title", "event_url", "registration_url",
    "source_provider", "source_event_id", "event_type", "audience_tags", "location", "location_type",
    "starts_at", "ends_at", "timezone", "description", "raw_payload", "content_hash", "extracted_at",
    "first_seen_at", "last_seen_at", "is_active",
)
REACHED = ("productive", "empty", "parser-needed")


def row_id(*key: str | Column) -> Column:
    """Deterministic id from the natural key."""
    return F.sha2(F.concat_ws("|", *key), 256)


def save_bucketed(snapshot: DataFrame, name: str, path: str, key: list[str], buckets: int) -> DataFrame:
    """Writes a snapshot as a plain table bucketed and sorted by its key.  An upsert
    into it moves the batch only: the join finds the snapshot already dealt by the key."""
    by = snapshot.repartition(buckets, *key).write.bucketBy(buckets, *key).sortBy(*key)
    by.mode("overwrite").option("path", path).saveAsTable(name)
    return snapshot.sparkSession.table(name)


def replace_rows(
    snapshot: DataFrame, batch: DataFrame, key: list[str], keep: Iterable[str], told_by: Iterable[str] | None = None,
) -> DataFrame:
    """Next snapshot: batch rows replace snapshot rows of the same key, except
    for the ``keep`` columns, which stay as first written.  Batch rows with a NULL
    key are left out; of a repeated key the row extracted last counts.  Rows that tie
    are told apart by all columns, or by those that the caller knows to fix the rest
    (``told_by``), which spares computing columns that nobody reads."""
    keep = {*keep, *key}
    latest = [F.col("extracted_at").desc_nulls_last()] if "extracted_at" in batch.columns else []
    # rows that tie are told apart by a hash of what can be hashed
    told_by = batch.columns if told_by is None else list(told_by)
    plain = [f.name for f in batch.schema.fields if f.name in told_by and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    batch = best_per_key(batch.dropna(subset=key), key, [*latest, F.xxhash64(*plain)])
    old = snapshot.withColumn("_old", F.lit(True)).alias("o")
    new = batch.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full")

    def pick(name: str) -> Column:
        before, after = F.col(f"o.{name}"), F.col(f"n.{name}")
        value = F.when(F.col("_old"), before).otherwise(after) if name in keep else \
            F.when(F.col("_new"), after).otherwise(before)
        return value.alias(name)

    return joined.select(*[pick(c) for c in snapshot.columns])


def last_per_key(batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return best_per_key(batch, key, [F.col(c).desc() for c in order])


# --- listings -------------------------------------------------------------------


def upsert_companies(snapshot: DataFrame, batch: DataFrame, order: list[str], as_of: Column,
                     touch: bool) -> DataFrame:
    """One row per (name, ats_provider).

    ``touch`` (record import) reactivates known companies and sets their scrape
    time to the last listing's; otherwise (bulk import) only missing ones are added.
    """
    latest = batch.groupBy(F.col("company_name").alias("name"), "ats_provider").agg(
        F.max_by("extracted_at", F.struct(*order)).alias("_extracted_at")
    )
    joined = snapshot.withColumn("_old", F.lit(True)).join(
        latest.withColumn("_new", F.lit(True)), ["name", "ats_provider"], "full"
    )
    old, new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    scraped = F.when(new, F.col("_extracted_at")).otherwise(F.col("last_scraped_at")) if touch \
        else F.col("last_scraped_at")
    active = F.when(new if touch else ~old, F.lit(True)).otherwise(F.col("is_active"))
    values = {
        "id": F.coalesce(F.col("id"), row_id("name", "ats_provider")),
        "is_active": active,
        "last_scraped_at": scraped,
        "created_at": F.when(old, F.col("created_at")).otherwise(as_of),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in snapshot.columns])


def job_rows(records: DataFrame, as_of: Column) -> DataFrame:
    """Nested records to table rows, with defaults for what is missing.  Records
    with a blank or missing hash are skipped, as :func:`import_summary` counts them."""
    job, n = F.col("job"), F.col("normalization")
    records = records.filter(F.coalesce(job.content_hash, F.lit("")) != "")

    def listed(value: Column, kind: str = EMPTY_STRINGS) -> Column:
        kept = F.array_compact(value) if kind == EMPTY_STRINGS else value
        return F.coalesce(kept, F.array().cast(kind))

    flat = records.select(
        job.content_hash.alias("id"),
        row_id(job.company_name, job.ats_provider).alias("company_id"),
        *[job[c].alias(c) for c in ("company_name", "job_title", "job_url", "ats_provider", "ats_job_id")],
        listed(job.location).alias("location"),
        job.raw_description.alias("raw_description"), "cleaned_description",
        job.description_html.alias("description_html"), job.employment_type.alias("employment_type"),
        listed(job.departments).alias("departments"),
        job.date_posted.alias("date_posted"), job.content_hash.alias("content_hash"),
        F.coalesce(job.extracted_at, as_of).alias("extracted_at"),
        as_of.alias("first_seen_at"), as_of.alias("last_seen_at"),
        n.program_type.alias("program_type"),
        listed(n.academic_levels).alias("academic_levels"),
        listed(n.degree_requirements).alias("degree_requirements"),
        listed(n.required_grad_years, "array<int>").alias("required_grad_years"),
        n.visa_sponsorship.alias("visa_sponsorship"), n.visa_status.alias("visa_status"),
        listed(n.required_skills).alias("required_skills"),
        listed(n.nice_to_have_skills).alias("nice_to_have_skills"),
        n.min_gpa.cast("decimal(3,2)").alias("min_gpa"),
        F.coalesce(n.clearance_required, F.lit(False)).alias("clearance_required"),
        n.remote_type.alias("remote_type"), n.normalization_status.alias("normalization_status"),
        "normalization_method",
        F.round(F.coalesce(n.confidence, F.lit(0.5)), 2).cast("decimal(3,2)").alias("normalization_confidence"),
        listed(n.review_reasons).alias("normalization_review_reasons"),
        F.coalesce("normalized_at", as_of).alias("normalized_at"),
    )
    return with_relevance(flat, "is_active").select(*JOB_COLUMNS)


def upsert_jobs(snapshot: DataFrame, rows: DataFrame, told_by: Iterable[str] | None = None) -> DataFrame:
    """Of a repeated content hash the row extracted last counts (callers that know
    a better order reduce first, see :func:`last_per_key`).  ``told_by`` as in
    :func:`replace_rows`: ``LISTING_COLUMNS`` where rules made the others from them."""
    return replace_rows(snapshot, rows, ["content_hash"], ("id", "first_seen_at"), told_by)


def import_summary(records: DataFrame, jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """U4 against the snapshots before the import.  A hash repeated in the payload
    counts once per row.  The records are read once: they are counted per listing and
    company, then per company, and only counts meet the snapshots."""
    job, company = F.col("job"), ["name", "ats_provider"]
    counted = records.groupBy(
        F.nullif(job.content_hash, F.lit("")).alias("content_hash"), job.company_name.alias("name"),
        job.ats_provider.alias("ats_provider"),
    ).agg(F.count(F.lit(1)).alias("rows"))
    known = jobs.select("content_hash").distinct().withColumn("_known", F.lit(True))
    usable, is_known = F.col("content_hash").isNotNull(), F.col("_known").isNotNull()

    def rows_that(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0))

    per_company = counted.join(known, "content_hash", "left").groupBy(*company).agg(
        F.sum("rows").alias("read"), rows_that(usable & ~is_known).alias("inserted"), rows_that(usable & is_known).alias("updated")
    )
    met = companies.select(*company).distinct().withColumn("_met", F.lit(True))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    return per_company.join(met, company, "left").agg(
        total("inserted").alias("jobs_inserted"), total("updated").alias("jobs_updated"), total("read").alias("records_read"),
        F.count_if(F.col("_met").isNull()).alias("companies_inserted"),
    ).withColumns(
        {
            "skipped": F.col("records_read") - F.col("jobs_inserted") - F.col("jobs_updated"),
            "failed": F.lit(0).cast("bigint"),
        }
    )


def import_records(
    jobs: DataFrame, companies: DataFrame, records: DataFrame, order: list[str], as_of: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """U1-U4 as one: (next jobs, next companies, summary) of an import of normalized
    records.  Blank hashes are skipped, a repeated hash takes its last record; the
    companies of all records are added or renewed.  ``order`` are columns of ``job``."""
    placed = [F.col("job")[c].alias(f"_order{i}") for i, c in enumerate(order)]
    last = last_per_key(
        records.select("*", *placed, F.col("job.content_hash").alias("_hash")), ["_hash"], [f"_order{i}" for i in range(len(order))]
    )
    return (
        upsert_jobs(jobs, job_rows(last, as_of)),
        upsert_companies(companies, records.select("job.*"), order, as_of, touch=True),
        import_summary(records, jobs, companies),
    )


def existing_keys(hashes: DataFrame, jobs: DataFrame) -> DataFrame:
    """The given content hashes that the table already holds."""
    return hashes.select("content_hash").distinct().join(jobs, "content_hash", "left_semi")


def _stale(as_of: Column, hours: int) -> Column:
    return F.col("is_active") & (F.col("last_seen_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def mark_stale(jobs: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Active rows not seen for ``hours`` become inactive."""
    return jobs.withColumn("is_active", F.col("is_active") & ~_stale(as_of, hours))


def stale_count(jobs: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """U6 counter."""
    return jobs.agg(F.count_if(_stale(as_of, hours)).alias("jobs_marked_inactive"))


# --- recruiting events --------------------------------------------------------------


def upsert_event_sources(snapshot: DataFrame, results: DataFrame, order: list[str], as_of: Column) -> DataFrame:
    """One row per source URL; only a reached page renews the success time."""
    status = F.when(F.col("status") == "success", "productive").otherwise(F.col("status"))
    staged = results.withColumn("source_status", status)
    facts = staged.groupBy("source_url").agg(
        F.count(F.lit(1)).alias("_times"),
        F.max(F.col("source_status").isin(*REACHED)).alias("_reached"),
    )
    last = last_per_key(staged, ["source_url"], order).join(facts, "source_url")
    reached = F.col("source_status").isin(*REACHED)
    batch = last.select(
        row_id("source_url").alias("id"), "firm_name", "firm_kind", "source_url", "source_provider", "source_scope",
        "source_status", (F.col("source_status") != "inactive").alias("is_active"),
        as_of.alias("created_at"), as_of.alias("last_scraped_at"),
        F.when(F.col("_reached"), as_of).alias("last_success_at"),
        F.col("error_type").alias("last_error_type"), F.col("message").alias("last_error_message"),
        (reached & (F.col("_times") > 1)).alias("_again"), reached.alias("_ok"),
    )
    old = snapshot.withColumn("_old", F.lit(True)).alias("o")
    new = batch.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, F.col("o.source_url") == F.col("n.source_url"), "full")
    is_old, is_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    # a reached page clears the error of a row that already existed
    cleared = F.when(is_old, F.col("_ok")).otherwise(F.col("_again"))

    def pick(name: str) -> Column:
        before, after = F.col(f"o.{name}"), F.col(f"n.{name}")
        if name in ("id", "source_url", "created_at"):
            value = F.coalesce(before, after)
        elif name == "last_success_at":
            value = F.coalesce(after, before)
        elif name.startswith("last_error"):
            value = F.when(is_new & cleared, F.lit(None)).when(is_new, after).otherwise(before)
        else:
            value = F.when(is_new, after).otherwise(before)
        return value.alias(name)

    return joined.select(*[pick(c) for c in snapshot.columns])


def match_sources(events: DataFrame, sources: DataFrame) -> DataFrame:
    """U8: events with the ``source_id`` of their best source, NULL without one.

    Tiers: same URL (event or registration), same host and firm, same firm.  The
    earliest source wins inside a tier, so each tier joins one source per key.  Every
    event row is carried through the lookups, so repeated events stay as they are.
    An event without a registration URL looks its event URL up again, which changes
    nothing and spreads those rows.
    """
    slim = sources.select(
        F.col("id").alias("_id"), "source_ord", "source_url", "firm_name", "firm_kind",
        F.nullif(host(F.col("source_url")), F.lit("")).alias("_host"),
    )

    def earliest(columns: list[str], tag: str) -> DataFrame:
        pick = F.min(F.struct("source_ord", "_id")).alias(tag)
        return slim.dropna(subset=columns).groupBy(*columns).agg(pick)

    probe = events.drop("source_id").withColumns(
        {"_host": host(F.col("event_url")), "_register": F.coalesce("registration_url", "event_url")}
    )
    by_url = earliest(["source_url"], "_u")
    matched = (
        probe.join(by_url.withColumnsRenamed({"source_url": "event_url", "_u": "_u1"}), "event_url", "left")
        .join(by_url.withColumnsRenamed({"source_url": "_register", "_u": "_u2"}), "_register", "left")
        .join(earliest(["_host", "firm_name", "firm_kind"], "_h"), ["_host", "firm_name", "firm_kind"], "left")
        .join(earliest(["firm_name", "firm_kind"], "_f"), ["firm_name", "firm_kind"], "left")
    )
    best = F.coalesce(F.least("_u1", "_u2"), F.col("_h"), F.col("_f"))
    return matched.select(*[c for c in events.columns if c != "source_id"], best["_id"].alias("source_id"))


def event_rows(events: DataFrame, as_of: Column) -> DataFrame:
    """Event listings (with ``source_id``) as table rows; past events are inactive."""
    values = {
        "id": F.col("content_hash"),
        "first_seen_at": as_of,
        "last_seen_at": as_of,
        "is_active": F.coalesce("ends_at", "starts_at") >= as_of,
        "audience_tags": F.coalesce("audience_tags", no_strings()),
        "location": F.coalesce("location", no_strings()),
    }
    return events.select(*[values.get(c, F.col(c)).alias(c) for c in EVENT_COLUMNS])


def upsert_events(snapshot: DataFrame, rows: DataFrame) -> DataFrame:
    """As U2."""
    return replace_rows(snapshot, rows, ["content_hash"], keep=("id", "first_seen_at"))


def import_events(
    snapshot: DataFrame, sources: DataFrame, events: DataFrame, results: DataFrame, order: list[str], as_of: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """U7-U10 as one: (next events, next sources, summary).  ``results`` (one row per
    fetch of a source) are upserted first; events are matched against the sources of
    this import and those known before."""
    known = upsert_event_sources(sources, results, ["source_ord"], as_of)
    last = last_per_key(events, ["content_hash"], order)
    ranked = known.join(
        results.groupBy("source_url").agg(F.min("source_ord").alias("source_ord")), "source_url", "left"
    ).withColumn("source_ord", F.coalesce(F.col("source_ord").cast("bigint"), F.lit((1 << 62))))
    rows = event_rows(match_sources(last, ranked), as_of)
    return upsert_events(snapshot, rows), known, event_import_summary(events, snapshot, results, sources)


def event_import_summary(events: DataFrame, snapshot: DataFrame, results: DataFrame,
                         sources: DataFrame) -> DataFrame:
    """Counters of one import; a repeated hash is an insert, then updates."""
    per_hash = events.groupBy("content_hash").agg(F.count(F.lit(1)).alias("rows"))
    known = snapshot.select("content_hash").distinct().withColumn("_known", F.lit(True))
    is_known, rows = F.col("_known").isNotNull(), F.col("rows")
    added = results.select("source_url").distinct().join(sources, "source_url", "left_anti")
    return per_hash.join(known, "content_hash", "left").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("events_read"),
        F.count_if(~is_known).alias("events_inserted"),
        F.coalesce(F.sum(F.when(is_known, rows).otherwise(rows - 1)), F.lit(0)).alias("events_updated"),
    ).withColumns(
        {
            "sources_inserted": added.agg(F.count(F.lit(1))).scalar(),
            "skipped": F.lit(0).cast("bigint"),
            "failed": F.lit(0).cast("bigint"),
        }
    )


def single_source_status(events: DataFrame, source: DataFrame) -> DataFrame:
    """U10, one-source import: productive when it brought events, else empty."""
    brought = events.groupBy("source_url").agg(F.count(F.lit(1)).alias("event_count"))
    joined = source.join(brought, "source_url", "left")
    count = F.coalesce("event_count", F.lit(0))
    return joined.withColumns(
        {"event_count": count, "status": F.when(count > 0, "productive").otherwise("empty")}
    )


def fetch_status(url: Column, http_status: Column) -> Column:
    """Source status of a failed fetch."""
    handshake = host(url).contains("joinhandshake.com") & http_status.isin(401, 403)
    return (
        F.when(handshake | (http_status == 401), "auth-required")
        .when(http_status.isin(403, 429), "blocked")
        .when(http_status == 404, "inactive")
        .otherwise("failed")
    )
