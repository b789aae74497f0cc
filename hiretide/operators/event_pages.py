"""Recruiting events from landed pages, feeds and calendars.

``pages``: page_id, url, content_type, body plus the source's firm_name,
firm_kind, source_provider, source_scope, firm_aliases.  One Arrow function breaks a
page into its parts - JSON objects of scripts, cards, site cards - from one parsed
tree; the mapping of parts to events is columns.  Extractors that are given parts do
not parse again.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiretide import rules
from hiretide.functions import dates
from hiretide.functions import text as tx
from hiretide.functions.dom import by_class, by_tag, link, parse
from hiretide.functions.dom import facts as fact_schema
from hiretide.functions.expr import bound, computed_once, join_present, no_strings, not_empty, present, squeeze, strings
from hiretide.functions.variant import at, event_date, first_string, first_strings, first_value, kind, objects, string_list
from hiretide.operators.events import (
    build_events, dedupe_events, event_type, feed_rules, firm_match, has_event_language, location_from_text, location_type,
)
from hiretide.operators.payloads import join_url
from hiretide.operators.routing import host
from hiretide.session import materialize, spread

SOURCE = ("page_id", "url", "firm_name", "firm_kind", "source_provider", "source_scope", "firm_aliases")


def _carry() -> list[Column]:
    """Source columns under names the extracted facts do not use."""
    return [F.col(c).alias("page_url" if c == "url" else c) for c in SOURCE]


# --- JSON objects inside script blocks -------------------------------------------------


def _objects_in(value):
    """Every object in a JSON value, outermost first, in document order."""
    stack = [value]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            yield node
            stack.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            stack.extend(reversed(node))


def _loads(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _named_object(text: str, name: str):
    """The JSON object that follows a name in script source."""
    found = text.find(f'"{name}"')
    found = text.find(name) if found < 0 else found
    opening = text.find("{", found) if found >= 0 else -1
    if opening < 0:
        return None
    try:
        return json.JSONDecoder().raw_decode(text, opening)[0]
    except ValueError:
        return None


SCRIPT, CARD, SITE = "script", "card", "site"
_PARTS = T.ArrayType(fact_schema(
    "part string, pos int, linked boolean, item string, selector int, again boolean, text string, heading string, strong string, "
    "stamp string, href string, cells array<string>, site string, title string, kind string, place string, topic string, "
    "event_id string, starts string, ends string, shown string"
))
_ARROW = {
    T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_(),
    T.ArrayType(T.StringType()): pa.list_(pa.string()),
}
_ARROW_PARTS = pa.list_(pa.struct([(f.name, _ARROW[f.dataType]) for f in _PARTS.elementType.fields]))
# --- fixed values: escapes of embedded markup ---
_ESCAPES = (("\\u003c", "<"), ("\\u003e", ">"), ("\\u003d", "="), ("\\u0026", "&"), ('\\"', '"'), ("\\/", "/"))


def _script_parts(root) -> Iterator[dict]:
    """JSON objects of all script blocks; ``linked`` marks JSON-LD blocks."""
    for script in root.select(by_tag("script")):
        text = "".join(c for c in script.children if isinstance(c, str)).strip()
        if not text:
            continue
        payload = _loads(text) if text[0] in "[{" else None
        if payload is None and "eventData" in text:
            payload = _named_object(text, "eventData")
        if payload is not None:
            linked = script.attrs.get("type") == "application/ld+json"
            for o in _objects_in(payload):
                yield {"linked": linked, "item": json.dumps(o)}


def _text_of(element) -> str | None:
    return element.text() if element is not None else None


def _card_parts(root) -> Iterator[dict]:
    """Facts of the elements that may be event cards, per selector in page order.  What
    an earlier selector found is read once and marked ``again``."""
    tests = (
        lambda e: "event" in e.attrs.get("class", ""),
        lambda e: "event" in e.attrs.get("id", ""),
        by_tag("article"), by_tag("li"), by_tag("tr"),
    )
    read: dict[int, dict] = {}
    for order, test in enumerate(tests):
        for e in root.select(test):
            again = id(e) in read
            if not again:
                stamp, anchor = e.first(by_tag("time")), e.first(link)
                read[id(e)] = {
                    "text": e.text(), "heading": _text_of(e.first(by_tag("h1", "h2", "h3", "h4"))),
                    "strong": _text_of(e.first(by_tag("h1", "h2", "h3", "h4", "strong"))),
                    "stamp": stamp.attrs.get("datetime") if stamp is not None else None,
                    "href": anchor.attrs["href"] if anchor is not None else None,
                    "cells": [c.text() for c in e.select(by_tag("td", "th"))],
                }
            yield {"selector": order, "again": again, **read[id(e)]}


def _site_parts(root, markup: str) -> Iterator[dict]:
    """Result-list cards (of the unescaped page, a text of its own) and agency cards."""
    if "resultsList" in markup:
        decoded = markup
        for escaped, plain in _ESCAPES:
            decoded = decoded.replace(escaped, plain)
        for e in parse(html.unescape(decoded)).select(lambda e: e.attrs.get("data-cy") == "resultsList"):
            title, anchor = " ".join(e.attrs.get("data-tracking-title", "").split()), e.first(link)
            if title and anchor is not None:
                yield {
                    "site": "results", "title": title, "href": anchor.attrs["href"], "text": e.text(),
                    "kind": e.attrs.get("data-glue-filter-event-type"),
                    "place": e.attrs.get("data-glue-filter-location"), "topic": e.attrs.get("data-glue-filter-topic"),
                }
    if "hds-event-item" in markup:
        for e in root.select(lambda e: link(e) and "hds-event-item" in e.classes):
            title, day = e.first(by_class("hds-event-title")), e.first(lambda x: "data-event-start-date" in x.attrs)
            if title is None or day is None:
                continue
            what, where = e.first(by_class("hds-event-type")), e.first(by_class("hds-event-short-location"))
            yield {
                "site": "agency", "title": title.text(), "href": e.attrs["href"], "text": e.text(),
                "kind": what.text() if what is not None else "event", "place": where.text() if where is not None else None,
                "event_id": e.attrs.get("event-id"), "starts": day.attrs["data-event-start-date"],
                "ends": day.attrs.get("data-event-timestamp-end"), "shown": day.text(),
            }


@F.arrow_udf(_PARTS)
def _parts_of(pages: pa.Array, wanted: pa.Array) -> pa.Array:
    """The wanted kinds of parts of each page, numbered by kind, from one tree."""
    def broken(markup: str | None, kinds: str) -> list[dict] | None:
        if markup is None or not kinds:
            return None
        root = parse(markup)
        readers = {
            SCRIPT: lambda: _script_parts(root), CARD: lambda: _card_parts(root), SITE: lambda: _site_parts(root, markup),
        }
        return [
            {"part": kind, "pos": pos, **found} for kind in kinds.split(",") for pos, found in enumerate(readers[kind]())
        ]

    return pa.array((broken(m.as_py(), k.as_py()) for m, k in zip(pages, wanted, strict=True)), _ARROW_PARTS)


def page_parts(pages: DataFrame, kinds: tuple[str, ...] = (SCRIPT, CARD, SITE), carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per part of a page, with the source's columns and ``carry``.  A page is
    parsed once, whatever is wanted of it, and not at all when it cannot have any of
    it; a NULL body has no parts."""
    body = F.col("body")
    possible = {SCRIPT: body.contains("<script"), CARD: F.lit(True), SITE: body.rlike("resultsList|hds-event-item")}
    wanted = F.concat_ws(",", *[F.when(possible[k], k) for k in kinds])
    broken = spread(pages).select(*_carry(), *carry, F.explode(_parts_of(body, wanted)).alias("_p"))
    return broken.select(*[c for c in broken.columns if c != "_p"], "_p.*")


_PART_FIELDS = {
    SCRIPT: ("linked", "item"), CARD: ("selector", "text", "heading", "strong", "stamp", "href", "cells"),
    SITE: ("site", "title", "href", "text", "kind", "place", "topic", "event_id", "starts", "ends", "shown"),
}


def _rows_of(pages: DataFrame | None, kind: str, parts: DataFrame | None) -> DataFrame:
    """Rows of one kind, from given parts or by parsing ``pages``."""
    found = page_parts(pages, (kind,)) if parts is None else parts
    source = ["page_url" if c == "url" else c for c in SOURCE]
    return found.filter(F.col("part") == kind).select(*source, "pos", *_PART_FIELDS[kind])


def script_items(pages: DataFrame | None, parts: DataFrame | None = None) -> DataFrame:
    """One row per JSON object in a page's scripts."""
    rows = _rows_of(pages, SCRIPT, parts).withColumnRenamed("item", "raw_payload")
    # parsed once: a filter above would take a copy of the parser along for each field it reads
    return computed_once(rows.withColumn("_item", F.try_parse_json("raw_payload")))


def _read(items: DataFrame, **groups: tuple[str, ...]) -> DataFrame:
    """Adds a text column _name per key group of the item, read in one expression."""
    lines = items.withColumn("_lines", first_strings(F.col("_item"), *groups.values()))
    return lines.withColumns({f"_{name}": F.get("_lines", F.lit(i)) for i, name in enumerate(groups)}).drop("_lines")


def _read_dates(items: DataFrame, start: tuple[str, ...], end: tuple[str, ...]) -> DataFrame:
    """Adds _starts and _ends."""
    values = F.array(first_value(F.col("_item"), *start), first_value(F.col("_item"), *end))
    dated = items.withColumn("_dates", F.transform(values, event_date))
    return dated.withColumns({"_starts": F.get("_dates", F.lit(0)), "_ends": F.get("_dates", F.lit(1))}).drop("_dates")


def _place_list(item: Column) -> Column:
    """Location as text, list, or an object with name and address."""
    def address(v: Column) -> Column:
        parts = F.array_compact(first_strings(v, *[(k,) for k in rules.ADDRESS_KEYS]))
        plain = not_empty(squeeze(F.try_variant_get(v, "$", "string")))
        return F.when(kind(v).startswith("OBJECT"), not_empty(F.array_join(parts, ", "))).otherwise(plain)

    def shape(v: Column) -> Column:
        whole = F.array_compact(F.array(
            first_string(v, "name", "displayName"), bound(first_value(v, "address"), address)
        ))
        return F.when(kind(v).startswith("OBJECT"), whole).otherwise(F.transform(string_list(v), squeeze))

    return F.coalesce(bound(first_value(item, *rules.EVENT_LOCATION_KEYS), shape), no_strings())


def map_items(items: DataFrame, as_of: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Loosely typed objects to events; the firm found in the text counts only
    for sources that list several firms.  Columns to ``keep`` pass through."""
    carry = [c for c in items.columns if c != "_item"]
    read = _read(
        items, title=rules.EVENT_TITLE_KEYS, url=rules.EVENT_URL_KEYS, registration=rules.EVENT_REGISTRATION_KEYS,
        description=rules.EVENT_DESCRIPTION_KEYS, type=rules.EVENT_TYPE_KEYS, id=rules.EVENT_ID_KEYS,
        timezone=rules.EVENT_TIMEZONE_KEYS,
    )
    read = _read_dates(read, rules.EVENT_START_KEYS, rules.EVENT_END_KEYS)
    facts = read.select(
        *carry, F.col("_title").alias("title"), F.col("_starts").alias("starts_at"), F.col("_ends").alias("ends_at"), "_url",
        "_registration", F.col("_description").alias("description"), "_type", F.col("_id").alias("source_event_id"),
        F.col("_timezone").alias("timezone"), _place_list(F.col("_item")).alias("places"),
    )
    c = F.col
    text = F.concat_ws(" ", "title", F.coalesce("description", F.lit("")))
    shared = c("source_scope").isin(*rules.FIRM_OVERRIDE_SCOPES)
    place_text = F.coalesce(not_empty(F.array_join("places", " ")), c("description"), c("title"))
    facts = facts.withColumn("url", F.coalesce("_url", "page_url")).withColumns(
        {
            "registration": F.coalesce("_registration", "url"),
            "type_text": F.coalesce(c("_type"), event_type(c("title"), c("description"))),
            "audience_text": text,
            "place_kind": location_type(place_text),
            "firm": F.when(shared, firm_match(text, c("firm_aliases"), c("firm_name"), c("firm_kind"))),
        }
    )
    return build_events(facts, as_of, ["page_id", "page_url", "pos", *keep])


def _schema_types(item: Column) -> Column:
    declared = F.coalesce(first_value(item, "@type"), first_value(item, "type"))
    return F.transform(string_list(declared), lambda t: F.element_at(F.split(t, "/"), -1))


def _is_json_ld() -> Column:
    return F.col("linked") & F.arrays_overlap(_schema_types(F.col("_item")), strings(rules.SCHEMA_EVENT_TYPES))


def _is_embedded() -> Column:
    return bound(
        F.json_object_keys("raw_payload"),
        lambda keys: F.arrays_overlap(keys, strings(rules.EVENT_TITLE_KEYS)) & F.arrays_overlap(keys, strings(rules.EVENT_START_KEYS)),
    )


def json_ld_events(pages: DataFrame | None, as_of: Column, parts: DataFrame | None = None) -> DataFrame:
    """Schema.org events of JSON-LD blocks."""
    return map_items(script_items(pages, parts).filter(_is_json_ld()).drop("linked"), as_of)


def embedded_events(pages: DataFrame | None, as_of: Column, parts: DataFrame | None = None) -> DataFrame:
    """Script objects that carry a title key and a date key."""
    return map_items(script_items(pages, parts).filter(_is_embedded()).drop("linked"), as_of)


def script_events(as_of: Column, parts: DataFrame, json_ld: int, embedded: int) -> DataFrame:
    """E1 and E2 with their ``extractor_ord``, for callers that keep an event of a page
    once: an object that both extractors take is mapped once, for the earlier one."""
    order = F.when(_is_json_ld(), json_ld).when(_is_embedded(), embedded)
    taken = computed_once(script_items(None, parts).withColumn("extractor_ord", order)).filter("extractor_ord IS NOT NULL")
    return map_items(taken.drop("linked"), as_of, ("extractor_ord",))


# --- calendars ---------------------------------------------------------------------------


def calendar_events(pages: DataFrame, as_of: Column) -> DataFrame:
    """VEVENT blocks.  Lines are unfolded by joining continuations; the last
    occurrence of a property counts."""
    body = F.regexp_replace(F.regexp_replace("body", "\r\n", "\n"), "\n{2,}", "\n")
    unfolded = F.regexp_replace(body, "\n[ \t]", "")
    opened = F.slice(F.split(unfolded, r"(?<![^\n])BEGIN:VEVENT\n"), 2, 1 << 30)
    closed = F.filter(opened, lambda b: b.rlike(r"(?m)^END:VEVENT$"))
    blocks = F.transform(closed, lambda b: F.regexp_extract(b, r"(?sm)\A(.*?)^END:VEVENT$", 1))
    rows = pages.select(*_carry(), F.posexplode(blocks).alias("pos", "_block"))
    lines = F.filter(F.split("_block", "\n"), lambda x: x.contains(":"))
    name = lambda x: F.upper(F.regexp_extract(x, r"^([^;:]*)", 1))
    value = lambda x: F.regexp_replace(x, r"^[^:]*:", "")

    def clean(v: Column) -> Column:
        for escaped, plain in (("\\n", "\n"), ("\\,", ","), ("\\;", ";")):
            v = F.replace(v, F.lit(escaped), F.lit(plain))
        return F.trim(v)

    def prop(key: str) -> Column:
        return clean(F.try_element_at(F.transform(F.filter("_lines", lambda x: name(x) == key), value), F.lit(-1)))

    zones = F.filter("_lines", lambda x: F.regexp_extract(x, r"^([^:]*)", 1).contains("TZID="))
    zone = F.regexp_extract(F.try_element_at(zones, F.lit(-1)), r"TZID=([^;:]*)", 1)
    pairs = F.transform("_lines", lambda x: F.struct(name(x).alias("k"), clean(value(x)).alias("v")))
    rows = rows.withColumn("_lines", lines).select("*", pairs.alias("_pairs"))
    keys = F.array_distinct(F.transform("_pairs", lambda p: p.k))
    last = F.transform(keys, lambda k: F.element_at(F.filter("_pairs", lambda p: p.k == k), -1).v)
    facts = rows.select(
        *[c for c in rows.columns if not c.startswith("_")],
        present(prop("SUMMARY")).alias("title"),
        dates.calendar_timestamp(prop("DTSTART")).alias("starts_at"),
        dates.calendar_timestamp(prop("DTEND")).alias("ends_at"),
        F.coalesce(not_empty(prop("URL")), F.col("page_url")).alias("url"),
        prop("DESCRIPTION").alias("description"), not_empty(prop("UID")).alias("source_event_id"),
        F.nullif(zone, F.lit("")).alias("timezone"),
        F.array_compact(F.array(not_empty(squeeze(prop("LOCATION"))))).alias("places"),
        F.to_json(F.map_from_arrays(keys, last)).alias("raw_payload"),
    )
    return build_events(_described(facts), as_of, ["page_id", "page_url", "pos"])


def _described(facts: DataFrame, firm: Column | None = None) -> DataFrame:
    """Type, audience and place columns from title and description."""
    c = F.col
    place_text = F.coalesce(not_empty(F.array_join("places", " ")), c("description"), F.lit(""))
    return facts.withColumns(
        {
            "registration": c("url"),
            "type_text": event_type(c("title"), c("description")),
            "audience_text": F.concat_ws(" ", "title", F.coalesce("description", F.lit(""))),
            "place_kind": location_type(place_text),
            "firm": F.lit(None).cast("struct<firm_name:string,firm_kind:string>") if firm is None else firm,
        }
    )


# --- cards -------------------------------------------------------------------------------

def _card_rows(pages: DataFrame | None, parts: DataFrame | None) -> DataFrame:
    rows = _rows_of(pages, CARD, parts)
    return rows.filter((F.length("text") >= 20) & has_event_language(F.col("text")))


def _card_events(rows: DataFrame, title: Column, as_of: Column, firm: Column | None) -> DataFrame:
    c = F.col
    starts = F.coalesce(dates.event_timestamp(c("stamp")), dates.event_timestamp(c("text")))
    facts = rows.select(
        "page_id", "page_url", "firm_name", "firm_kind", "source_provider", "source_scope", "firm_aliases", "pos",
        title.alias("title"), starts.alias("starts_at"), F.lit(None).cast("timestamp").alias("ends_at"),
        F.when(c("href").isNotNull(), join_url(c("page_url"), c("href"))).otherwise(c("page_url")).alias("url"),
        c("text").alias("description"), F.lit(None).cast("string").alias("source_event_id"),
        F.lit(None).cast("string").alias("timezone"), location_from_text(c("text")).alias("places"),
        F.lit(None).cast("string").alias("raw_payload"),
    )
    described = _described(facts, None if firm is None else firm).withColumns(
        {"audience_text": c("description"), "place_kind": location_type(c("description"))}
    )
    return build_events(described, as_of, ["page_id", "page_url", "pos"])


def html_card_events(pages: DataFrame | None, as_of: Column, parts: DataFrame | None = None) -> DataFrame:
    """Generic cards, all of a page."""
    rows = _card_rows(pages, parts).filter("selector < 4")
    return _card_events(rows, F.coalesce(F.col("heading"), F.col("text")), as_of, None)


def recruiting_card_events(pages: DataFrame | None, as_of: Column, parts: DataFrame | None = None) -> DataFrame:
    """E5: cards that name a firm, deduplicated within their page."""
    c = F.col
    rows = _card_rows(pages, parts)
    cell = F.get(F.filter("cells", lambda x: (x != "") & dates.event_timestamp(x).isNull()), F.lit(0))
    title = F.coalesce(present(c("strong")), cell, c("text"))
    match = firm_match(c("description"), c("firm_aliases"), c("firm_name"), c("firm_kind"))
    events = _card_events(rows.filter(
        firm_match(c("text"), c("firm_aliases"), c("firm_name"), c("firm_kind")).isNotNull()
    ), title, as_of, match)
    first = Window.partitionBy("page_id", "content_hash").orderBy("pos")
    return events.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def site_card_events(pages: DataFrame | None, as_of: Column, parts: DataFrame | None = None) -> DataFrame:
    """Evergreen result lists run from the extraction for a year; agency cards
    carry their own dates."""
    c = F.col
    rows = _rows_of(pages, SITE, parts)
    evergreen = c("site") == "results"
    hint = F.coalesce(*[
        F.when(F.lower("text").contains(o.lower()), F.lit(o)) for o in ("VIRTUAL", "ONLINE", "ONSITE", "VARIES")
    ], c("text"))
    agency_place = F.array_compact(F.array(not_empty(squeeze(F.coalesce("place", F.lit(""))))))
    agency_hint = F.coalesce(not_empty(F.array_join(agency_place, " ")), c("kind"))
    url = join_url(c("page_url"), c("href"))
    facts = rows.select(
        "page_id", "page_url", "firm_name", "firm_kind", "source_provider", "pos", "title", url.alias("url"),
        url.alias("registration"),
        F.when(evergreen, url).otherwise(F.coalesce(F.nullif(c("event_id"), F.lit("")), url)).alias("source_event_id"),
        F.when(evergreen, as_of).otherwise(dates.event_timestamp(c("starts"))).alias("starts_at"),
        F.when(evergreen, as_of + F.make_dt_interval(F.lit(365))).otherwise(
            F.timestamp_micros((c("ends").try_cast("double") * 1_000_000).cast("bigint"))
        ).alias("ends_at"),
        F.coalesce(F.nullif(c("kind"), F.lit("")), event_type(c("title"), c("text"))).alias("type_text"),
        F.when(evergreen, c("text")).otherwise(F.concat_ws(" ", "title", "kind")).alias("audience_text"),
        F.when(evergreen, location_from_text(hint)).otherwise(agency_place).alias("places"),
        F.when(evergreen, location_type(hint)).otherwise(location_type(agency_hint)).alias("place_kind"),
        c("text").alias("description"), F.lit(None).cast("string").alias("timezone"),
        F.when(evergreen, F.to_json(F.struct(
            c("title").alias("tracking_title"), c("kind").alias("event_type"), c("place").alias("location"), "topic"
        ))).otherwise(F.to_json(F.struct(
            "event_id", c("shown").alias("display_date"), c("kind").alias("event_type")
        ))).alias("raw_payload"),
        F.lit(None).cast("struct<firm_name:string,firm_kind:string>").alias("firm"),
    )
    return build_events(facts, as_of, ["page_id", "page_url", "pos"])


# --- provider feeds -------------------------------------------------------------------------


def _feed_items(feeds: DataFrame, *lists: Column) -> DataFrame:
    rows = spread(feeds).withColumn("_doc", F.try_parse_json("body"))
    rows = rows.select(*_carry(), F.posexplode(F.coalesce(*lists)).alias("pos", "_item"))
    return rows.withColumn("raw_payload", F.to_json("_item"))


def _feed_events(items: DataFrame, as_of: Column, **facts: Column) -> DataFrame:
    c = F.col
    base = items.select(*[x for x in items.columns if x != "_item"], *[v.alias(k) for k, v in facts.items()])
    place_text = F.coalesce(not_empty(F.array_join("places", " ")), c("title"))
    kind_of = c("place_kind") if "place_kind" in facts else location_type(place_text)
    text = F.concat_ws(" ", "title", F.coalesce("description", F.lit("")))
    if "audience_text" not in facts:
        base = base.withColumn("audience_text", text)
    if "registration" not in facts:
        base = base.withColumn("registration", c("url"))
    ready = base.withColumns(
        {"place_kind": kind_of, "firm": F.lit(None).cast("struct<firm_name:string,firm_kind:string>")}
    )
    return build_events(ready, as_of, ["page_id", "page_url", "pos"])


def jpmorgan_events(feeds: DataFrame, as_of: Column) -> DataFrame:
    """Date and time in separate fields, city, state and country."""
    c = F.col
    items = _read(
        _feed_items(feeds, objects(at(F.col("_doc"), "events"))),
        title=("event_name",), body=("external_description",), day=("date_start",), clock=("start_time",),
        end_day=("date_end",), end_clock=("end_time",), url=("event_url", "apply_url", "registration_url"), city=("city",),
        state=("state",), country=("country",), id=("event_id", "id"), kind=("event_classification",),
        zone=("time_zone", "timezone"),
    )
    natural = join_present("|", c("_title"), c("_day"), c("_clock"), c("_city"))
    return _feed_events(
        items.withColumn("_text", tx.single_line_text(c("_body"))), as_of, title=c("_title"), description=c("_text"),
        starts_at=dates.date_and_time(c("_day"), c("_clock")), ends_at=dates.date_and_time(c("_end_day"), c("_end_clock")),
        url=F.coalesce("_url", "page_url"), places=F.array_compact(F.array("_city", "_state", "_country")),
        source_event_id=F.coalesce(c("_id"), natural),
        type_text=event_type(F.coalesce("_kind", F.lit("recruiting")), c("_title")), timezone=c("_zone"),
    )


def morgan_stanley_events(feeds: DataFrame, as_of: Column) -> DataFrame:
    """E7."""
    c = F.col
    items = _read(
        _feed_items(feeds, objects(at(F.col("_doc"), "eventResults"))),
        title=("eventTitle", "title", "name"), body=("eventHtmlDescription", "eventDescription", "description"),
        day=("eventStartDate",), end_day=("eventEndDate",), clock=("eventTime",), url=("eventDetailUrl", "eventUrl", "url"),
        place=("eventCity", "eventLocation", "eventCountry"), id=("eventId", "id"), kind=("eventType", "eventCategory"),
        zone=("eventTimezone", "timezone"),
    )
    return _feed_events(
        items.withColumn("_text", tx.single_line_text(c("_body"))), as_of, title=c("_title"), description=c("_text"),
        starts_at=dates.date_and_time(c("_day"), c("_clock")), ends_at=dates.date_and_time(c("_end_day"), c("_clock")),
        url=join_url(c("page_url"), F.coalesce("_url", "page_url")), places=F.array_compact(F.array("_place")),
        source_event_id=c("_id"), type_text=event_type(F.coalesce("_kind", "_title"), c("_text")), timezone=c("_zone"),
    )


def nvidia_events(feeds: DataFrame, as_of: Column) -> DataFrame:
    """E7."""
    c = F.col
    items = _read(
        _feed_items(feeds, objects(F.col("_doc")), objects(at(F.col("_doc"), "events"))),
        title=("title", "name"), body=("description", "summary"), venue=("venue",), booth=("booth",), url=("url", "link"),
        place=("location", "venue"), id=("id", "eventId"), zone=("timezone", "timeZone"),
    )
    items = _read_dates(items, ("startDate", "start_date", "date"), ("endDate", "end_date"))
    items = items.withColumn("_text", squeeze(join_present(" ", c("_body"), c("_venue"), c("_booth"))))
    iso = F.date_format("_starts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return _feed_events(
        items, as_of, title=c("_title"), description=F.nullif(c("_text"), F.lit("")), starts_at=c("_starts"),
        ends_at=c("_ends"), url=join_url(c("page_url"), F.coalesce("_url", "page_url")),
        places=F.array_compact(F.array("_place")), source_event_id=F.coalesce(c("_id"), F.concat_ws("|", "_title", iso)),
        type_text=event_type(c("_title"), c("_text")), timezone=c("_zone"),
        audience_text=F.concat_ws(" ", "_title", "_text", F.lit("university student campus")),
    )


def eightfold_events(pages: DataFrame | None, as_of: Column, parts: DataFrame | None = None) -> DataFrame:
    """Event objects embedded in scripts."""
    c = F.col
    outer = script_items(pages, parts).drop("linked")
    inner = at(c("_item"), "eventData")
    items = _read(
        outer.withColumn("_item", F.when(kind(inner).startswith("OBJECT"), inner).otherwise(c("_item"))),
        mark=("plannedEventEncId", "eventLandingURL", "name"), title=("name", "title"), body=("description",),
        place=("completeVenue", "venue", "address", "institution"), url=("eventLandingURL", "registrationUrl", "url"),
        id=("plannedEventEncId", "id"), kind=("eventCategory",), zone=("selectedTimezone", "timezone"),
        place_kind=("eventLocationType",),
    )
    items = computed_once(items).filter(c("_mark").isNotNull())
    items = _read_dates(
        items, ("startTimestamp", "start_timestamp", "startDate"), ("endTimestamp", "end_timestamp", "endDate")
    )
    items = items.withColumns({"raw_payload": F.to_json("_item"), "_text": tx.single_line_text(c("_body"))})
    hint = F.coalesce(c("_place"), F.nullif(c("_text"), F.lit("")), c("_title"))
    return _feed_events(
        items, as_of, title=c("_title"), description=c("_text"), starts_at=c("_starts"), ends_at=c("_ends"),
        url=F.coalesce("_url", "page_url"), places=F.array_compact(F.array("_place")), source_event_id=c("_id"),
        type_text=event_type(F.coalesce("_kind", "_title"), c("_text")), timezone=c("_zone"),
        place_kind=F.when(c("_place_kind") == "virtual_event", "virtual").otherwise(location_type(hint)),
    )


def amazon_events(pages: DataFrame | None, as_of: Column, parts: DataFrame | None = None) -> DataFrame:
    """Titled script objects that mention the firm, then recruiting cards."""
    parts = page_parts(pages, (SCRIPT, CARD)) if parts is None else parts
    items = script_items(None, parts).drop("linked")
    mapped = map_items(items, as_of)
    named = F.lower(F.concat_ws(" ", "event_title", F.coalesce("description", F.lit("")))).contains("amazon")
    return mapped.filter(named).unionByName(recruiting_card_events(None, as_of, parts))


# Feeds in the order they are asked; the first two are the only ones asked for their pages.
JSON_FEEDS = {"morgan_stanley": morgan_stanley_events, "nvidia": nvidia_events, "jpmorgan": jpmorgan_events}
PAGE_FEEDS = {"eightfold": eightfold_events, "amazon": amazon_events}
FEED_ORDER = ("morgan_stanley", "nvidia", "eightfold", "amazon", "jpmorgan")


def asked_feeds(pages: DataFrame) -> DataFrame:
    """Adds ``_asks``, the feeds that are asked for the page."""
    rules_of = feed_rules(F.col("source_provider"), F.coalesce(host(F.col("url")), F.lit("")))
    mine = {feed: F.coalesce(rules_of[feed], F.lit(False)) for feed in FEED_ORDER}
    rest = F.array_compact(F.array(*[F.when(mine[f], f) for f in FEED_ORDER[2:]]))
    return pages.withColumn(
        "_asks", F.when(mine["morgan_stanley"], F.array(F.lit("morgan_stanley"))).when(mine["nvidia"], F.array(F.lit("nvidia"))).otherwise(rest)
    )


def _asking(df: DataFrame, feed: str) -> DataFrame:
    return df.filter(F.array_contains("_asks", feed))


def _first_feed(found: list[DataFrame]) -> DataFrame:
    """Events with their ``feed_ord``: of each page those of its first feed with any."""
    every = found[0]
    for events in found[1:]:
        every = every.unionByName(events)
    first = F.min("feed_ord").over(Window.partitionBy("page_id"))
    return every.withColumn("_first", first).filter(F.col("feed_ord") == F.col("_first")).drop("_first")


def _fed(feed: str, events: DataFrame) -> DataFrame:
    return events.withColumn("feed_ord", F.lit(FEED_ORDER.index(feed)))


def page_events(pages: DataFrame, as_of: Column) -> DataFrame:
    """E16 with E15: events of landed pages, with ``extractor_ord`` (0: a provider
    feed).  An event that several extractors of a page find counts once, for the
    first of them.

    What is read more than once is written once: the parts of the pages (the only
    Python step; a card that several selectors find is one part), and the events of the
    provider feeds.  Pages that a JSON feed serves
    are not parsed unless an earlier feed may serve them too, and no generic extractor
    sees a page that a feed serves.
    """
    calendar = F.coalesce(F.col("content_type").contains("text/calendar"), F.lit(False)) | F.lower("url").endswith(".ics")
    asking = asked_feeds(pages).withColumn("_calendar", calendar)
    from_json = materialize(
        _first_feed([_fed(f, extract(_asking(asking, f), as_of)) for f, extract in JSON_FEEDS.items()]), "json-feeds"
    )
    by_page_feed = F.arrays_overlap("_asks", strings(PAGE_FEEDS))
    served = from_json.select("page_id").distinct()
    unserved = asking.join(served, "page_id", "left_anti").filter(~by_page_feed & ~F.col("_calendar"))
    parsed = asking.filter(by_page_feed).unionByName(unserved)
    broken = page_parts(parsed, carry=("_asks", "_calendar"))
    parts = materialize(broken.filter(~F.coalesce("again", F.lit(False))), "page-parts")
    from_pages = [_fed(f, extract(None, as_of, _asking(parts, f))) for f, extract in PAGE_FEEDS.items()]
    feeds = materialize(_first_feed([from_json, *from_pages]), "feeds")

    fed = feeds.select("page_id").distinct()
    left = parts.filter(~F.col("_calendar")).join(fed, "page_id", "left_anti")
    calendars = asking.filter("_calendar").join(fed, "page_id", "left_anti")
    generic = {
        1: calendar_events(calendars, as_of), 4: site_card_events(None, as_of, left),
        5: recruiting_card_events(None, as_of, left), 6: html_card_events(None, as_of, left),
    }
    every = feeds.drop("feed_ord").withColumn("extractor_ord", F.lit(0)).unionByName(script_events(as_of, left, 2, 3))
    for order, events in generic.items():
        every = every.unionByName(events.withColumn("extractor_ord", F.lit(order)))
    return dedupe_events(every, ["extractor_ord", "pos"], ["page_id"])
