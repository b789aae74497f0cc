"""Recruiting-event columns, construction, dedupe and run summary."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide import rules
from hiretide.functions.expr import alternation, bound, computed_once, contains_any, first_label, no_strings, strings
from hiretide.functions.terms import Table, first_label_scan, label_scan
from hiretide.functions.text import slug
from hiretide.operators.skew import best_per_key
from hiretide.session import materialize


def location_type(
    text: Column, virtual_terms: Iterable[str] = rules.VIRTUAL_TERMS, in_person_terms: Iterable[str] = rules.IN_PERSON_TERMS,
) -> Column:
    """E10."""
    def decide(lowered: Column) -> Column:
        virtual = contains_any(lowered, virtual_terms)
        in_person = contains_any(lowered, in_person_terms)
        return first_label({"hybrid": virtual & in_person, "virtual": virtual, "in_person": in_person}, "unknown")

    return bound(F.lower(text), decide)


def event_type(
    title: Column, description: Column, table: Table = rules.EVENT_TYPE_TERMS, default: str = "recruiting",
) -> Column:
    """E11."""
    text = F.lower(F.concat(title, F.lit(" "), F.coalesce(description, F.lit(""))))
    return bound(text, lambda t: first_label_scan(t, table, default))


def audience_tags(text: Column, table: Table = rules.AUDIENCE_TERMS) -> Column:
    """E12, sorted."""
    return bound(F.lower(text), lambda t: F.array_sort(label_scan(t, table)))


def location_from_text(text: Column, table: Table = rules.LOCATION_TEXT_TERMS) -> Column:
    """One generic place, or none."""
    return bound(F.lower(text), lambda t: F.slice(label_scan(t, table), 1, 1))


def default_location(location: Column, kind: Column) -> Column:
    """A stand-in for an empty location."""
    stand_in = F.when(kind == "virtual", "Virtual").otherwise("Unspecified")
    return F.when(F.size(F.coalesce(location, no_strings())) > 0, location).otherwise(F.array(stand_in))


def has_event_language(text: Column, terms: Iterable[str] = rules.EVENT_LANGUAGE_TERMS) -> Column:
    return contains_any(F.lower(text), terms)


def firm_match(
    text: Column, aliases: Column, firm_name: Column, firm_kind: Column,
    firms: Mapping[str, tuple[str, Iterable[str]]] = rules.FIRM_ALIASES,
) -> Column:
    """struct(firm_name, firm_kind).  The source's own aliases count anywhere
    in the text; the known ``firms`` (name: kind, words) need a word boundary; the
    first one wins.  All words are looked for in one scan."""
    words = [w for _, own in firms.values() for w in own]
    known = F.lit(None).cast("struct<firm_name:string,firm_kind:string>")
    guarded = rf"(?<![a-z0-9])(?=({alternation(sorted(words, key=len, reverse=True))})(?![a-z0-9]))" if words else None

    def covers(word: str, other: str) -> bool:
        """Whether ``other`` is found too wherever ``word`` is."""
        return word.startswith(other) and not (word + " ")[len(other)].isalnum()

    def first_known(found: Column) -> Column:
        named = F.when(F.lit(False), known)
        for name, (kind, own) in firms.items():
            named = named.when(
                F.arrays_overlap(found, strings([w for w in words if any(covers(w, o) for o in own)])), F.struct(F.lit(name).alias("firm_name"), F.lit(kind).alias("firm_kind"))
            )
        return named

    def pick(lowered: Column) -> Column:
        own = F.exists(F.coalesce(aliases, no_strings()), lambda a: lowered.contains(F.lower(a)))
        from_table = known if guarded is None else bound(F.regexp_extract_all(lowered, F.lit(guarded), 1), first_known)
        return F.when(own, F.struct(firm_name.alias("firm_name"), firm_kind.alias("firm_kind"))).otherwise(from_table)

    return bound(F.lower(text), pick)


def event_hash(source_event_id: Column, source_firm: Column, title: Column, starts_at: Column, url: Column) -> Column:
    """The source's own id, else firm of the source, title, start and URL."""
    micros = F.date_format(starts_at, "SSSSSS")
    iso = F.concat(
        F.date_format(starts_at, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00"),
    )
    natural = F.concat_ws("|", source_firm, title, iso, url)
    return F.sha2(F.coalesce(F.nullif(source_event_id, F.lit("")), natural), 256)


EVENT_FIELDS = (
    "firm_name", "firm_kind", "event_title", "event_url", "registration_url", "source_provider",
    "source_event_id", "event_type", "audience_tags", "location", "location_type", "starts_at", "ends_at",
    "timezone", "description", "raw_payload", "content_hash", "extracted_at",
)


def build_events(found: DataFrame, as_of: Column, carry: list[str]) -> DataFrame:
    """Event listings from extracted facts.

    ``found`` has the source's firm_name, firm_kind and source_provider, an
    optional ``firm`` struct that overrides the firm, and title, url, registration,
    source_event_id, type_text, audience_text, places, place_kind, starts_at,
    ends_at, timezone, description, raw_payload.  ``carry`` columns pass through.
    """
    c = F.col
    return computed_once(found).filter(c("title").isNotNull() & (c("title") != "") & c("starts_at").isNotNull()).select(
        *carry,
        F.coalesce(c("firm.firm_name"), c("firm_name")).alias("firm_name"),
        F.coalesce(c("firm.firm_kind"), c("firm_kind")).alias("firm_kind"),
        c("title").alias("event_title"), c("url").alias("event_url"), c("registration").alias("registration_url"),
        "source_provider", "source_event_id",
        slug(F.coalesce("type_text", F.lit(""))).alias("event_type"),
        audience_tags(c("audience_text")).alias("audience_tags"),
        default_location(c("places"), c("place_kind")).alias("location"),
        c("place_kind").alias("location_type"), "starts_at", "ends_at", "timezone", "description", "raw_payload",
        event_hash(c("source_event_id"), c("firm_name"), c("title"), c("starts_at"), c("url")).alias("content_hash"),
        as_of.alias("extracted_at"),
    )


def with_event_columns(events: DataFrame) -> DataFrame:
    """Derived columns of events that already have title, firm and times."""
    c = F.col
    text = F.concat_ws(" ", "event_title", "description")
    typed = events.withColumns(
        {
            "event_type": event_type(c("event_title"), c("description")),
            "audience_tags": audience_tags(text),
            "location_type": location_type(text),
        }
    )
    return typed.withColumns(
        {
            "location": default_location(location_from_text(text), c("location_type")),
            "timezone": F.lit(None).cast("string"),
            "extracted_at": c("starts_at"),
        }
    )


def dedupe_events(events: DataFrame, order: list[str], scope: list[str]) -> DataFrame:
    """First event per content hash inside ``scope``."""
    return best_per_key(events, [*scope, "content_hash"], [F.col(o) for o in order])


def with_precedence(
    provider: DataFrame, generic: list[DataFrame | Callable[[DataFrame], DataFrame]], page: str,
) -> DataFrame:
    """A page's provider-feed events when there are any, else the events of
    the generic extractors in list order (``extractor_ord``).

    A generic extractor may be a function of the served pages, which leaves them out
    before it parses anything.  The feed is read twice, hence written once.
    """
    every = feed = materialize(provider.withColumn("extractor_ord", F.lit(0)), "feed")
    served = feed.select(page).distinct()
    for order, events in enumerate(generic, start=1):
        found = events(served) if callable(events) else events.join(served, page, "left_anti")
        every = every.unionByName(found.withColumn("extractor_ord", F.lit(order)))
    return every


def feed_rules(provider: Column, page_host: Column) -> dict[str, Column]:
    """Which provider feeds may serve a source, in the order they are asked."""
    # --- fixed values: (feed, provider name, host fragment), in order ---
    table = (
        ("morgan_stanley", "morgan_stanley_events", "morganstanley.com"),
        ("nvidia", "nvidia_university_events", "nvidia.com"),
        ("eightfold", "eightfold_events", "eightfold.ai"),
        ("amazon", "amazon_hiring_events", "hiring.amazon.com"),
        ("jpmorgan", "jpmorgan_events", "jpmorganchase.com"),
    )
    rules_of = {feed: (provider == name) | page_host.contains(part) for feed, name, part in table}
    rules_of["eightfold"] = rules_of["eightfold"] | page_host.startswith("jobs.")
    return rules_of


def feed_provider(provider: Column, page_host: Column) -> Column:
    """The first provider feed that may serve a source, NULL for a generic page."""
    return first_label(feed_rules(provider, page_host))


def event_run_summary(sources: DataFrame, events: DataFrame, failures: DataFrame) -> DataFrame:
    """Per source its status and event count.

    ``failures``: source_url, status (see ``fetch_status``), error_type, message.
    A classified failure is a status, only ``failed`` counts as a failed source.
    """
    counts = events.groupBy("source_url").agg(F.count(F.lit(1)).alias("_events"))
    errors = failures.select("source_url", F.col("status").alias("_status"), "error_type", "message")
    joined = sources.join(counts, "source_url", "left").join(errors, "source_url", "left")
    count = F.when(F.col("_status").isNotNull(), 0).otherwise(F.coalesce("_events", F.lit(0)))
    reached = F.when(count > 0, "productive").otherwise("empty")
    return joined.withColumns(
        {"status": F.coalesce("_status", reached), "event_count": count}
    ).drop("_events", "_status").orderBy(F.lower("source_url"), "source_url")
