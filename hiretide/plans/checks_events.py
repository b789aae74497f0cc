"""Registered queries: recruiting-event extraction (E, SRC3, SRC6, SNK2, SNK5).

Pages, feeds and calendars are written from the given events, five to a page, and
extracted again; the checks state the expected events straight from the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hiretide.operators import event_pages, events
from hiretide.operators.routing import host
from hiretide.operators.state import fetch_status
from hiretide.plans.checks_query import event_table, source_table
from hiretide.plans.duck_events import KIND, TAGS, TYPE, firm, with_events
from hiretide.plans.duck_rules import any_term
from hiretide.plans.registry import query
from hiretide.plans.standin import duck_views, view
from hiretide.plans.tables import joined, stamp
from hiretide.session import scratch_path
from hiretide.sources import artifacts, lists

AS_OF = "2024-01-15 00:00:00"
PER_PAGE = 5


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _events(spark, sf_dir):
    return view(spark, sf_dir, "recruiting_events")


def _pages(df, item, before="", after="", between="", scope="university_calendar", provider="company_events",
           url="https://campus.example.edu/events", content_type="text/html", aliases=(), per_page=PER_PAGE):
    """Pages of a few consecutive events each."""
    block = F.floor(F.col("event_id") / per_page)
    grouped = df.groupBy(block.alias("page_id")).agg(
        F.array_sort(F.collect_list(F.struct("event_id", item.alias("item")))).alias("items")
    )
    body = F.concat(F.lit(before), F.array_join(F.transform("items", lambda x: x["item"]), between), F.lit(after))
    names = F.array(*map(F.lit, aliases)) if aliases else F.array().cast("array<string>")
    return grouped.select(
        "page_id", F.lit(url).alias("url"), F.lit(content_type).alias("content_type"), body.alias("body"),
        F.lit("Campus Board").alias("firm_name"), F.lit("other").alias("firm_kind"), F.lit(provider).alias("source_provider"),
        F.lit(scope).alias("source_scope"), names.alias("firm_aliases"),
    )


def _out(df):
    return df.select(
        "event_url", "event_title", "firm_name", "event_type", joined("audience_tags").alias("audience"),
        joined("location").alias("location"), "location_type", stamp("starts_at").alias("starts"),
        F.coalesce(stamp("ends_at"), F.lit("")).alias("ends"),
    )


def _expect(place: str, title="event_title", text="event_title || ' ' || description", url="event_url", starts="starts_at",
            ends="ends_at", kind_text=None, where="true", kind_of="coalesce(firm, 'Campus Board')", tag_text=None,
            type_text=None, firm_text=None, place_list=None, kind=None) -> str:
    """Expected events: ``place`` is the location list; the place kind is read off
    it, or off ``kind_text``."""
    base = f"""
    SELECT e.*, {title} AS title, {url} AS url, {starts} AS s, {ends} AS e2, {place} AS places,
      lower({tag_text or text}) AS tag_t, lower({type_text or text}) AS type_t, lower({firm_text or text}) AS firm_t,
      lower({kind_text or "array_to_string(" + place + ", ' ')"}) AS kind_t
    FROM recruiting_events e WHERE {where}"""

    def over(expr: str, column: str) -> str:
        return expr.replace("contains(t,", f"contains({column},")

    kind_sql = kind or over(KIND, "kind_t")
    return f"""WITH {duck_views('recruiting_events')},
    base AS ({base}),
    shaped AS (SELECT *, {kind_sql} AS location_type, {firm('firm_t')} AS firm FROM base)
    SELECT url AS event_url, title AS event_title, {kind_of} AS firm_name, {over(TYPE, 'type_t')} AS event_type,
      array_to_string({over(TAGS, 'tag_t')}, '|') AS audience,
      CASE WHEN len(places) > 0 THEN array_to_string(places, '|') WHEN location_type = 'virtual' THEN 'Virtual'
        ELSE 'Unspecified' END AS location, location_type,
      strftime(s, '%Y-%m-%d %H:%M:%S') AS starts, coalesce(strftime(e2, '%Y-%m-%d %H:%M:%S'), '') AS ends
    FROM shaped"""


_iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _json(**fields):
    return F.to_json(F.struct(*[(v if not isinstance(v, str) else F.col(v)).alias(k) for k, v in fields.items()]))


# --- pages ------------------------------------------------------------------------------


def _ld_pages(spark, sf_dir):
    n = F.col("event_id")
    place = (
        F.when(n % 3 == 0, F.lit('{"name":"Online"}')).when(n % 3 == 1, F.lit('"Main Hall"'))
        .otherwise(F.lit('{"address":{"streetAddress":"1 Road","addressLocality":"Town"}}'))
    )
    kind = F.when(n % 7 == 0, "Person").when(n % 2 == 0, "Event").otherwise("https://schema.org/BusinessEvent")
    flat = _json(name="event_title", startDate=_iso("starts_at"), endDate=_iso("ends_at"), url="event_url",
                 description="description", identifier="source_event_id")
    item = F.concat(F.regexp_replace(flat, r"\}$", ""), F.lit(',"@type":"'), kind, F.lit('","location":'), place, F.lit("}"))
    return _pages(_events(spark, sf_dir), item, '<html><script type="application/ld+json">[', "]</script></html>", ",")


_LD_PLACE = "CASE CAST(event_id % 3 AS INT) WHEN 0 THEN ['Online'] WHEN 1 THEN ['Main Hall'] ELSE ['1 Road, Town'] END"


@query("e1_json_ld", _expect(_LD_PLACE, where="event_id % 7 <> 0"))
def e1(spark, sf_dir):
    return _out(event_pages.json_ld_events(_ld_pages(spark, sf_dir), _as_of()))


def _embedded_pages(spark, sf_dir):
    item = _json(headline="event_title", startTimestamp=F.unix_millis("starts_at"), end_date=_iso("ends_at"),
                 canonicalUrl="event_url", body="description", venue=F.array(F.lit(" Room  1 "), F.lit("")))
    return _pages(_events(spark, sf_dir), item, '<script>{"page":{"events":[', "]}}</script><script>var x = 1;</script>", ",",
                  scope="company_page")


@query("e2_embedded_json", _expect("['Room 1']", kind_of="'Campus Board'"))
def e2(spark, sf_dir):
    return _out(event_pages.embedded_events(_embedded_pages(spark, sf_dir), _as_of()))


def _calendar_pages(spark, sf_dir):
    stamp_of = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    lines = F.concat_ws(
        "\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "source_event_id"), F.concat(F.lit("SUMMARY:"), "event_title"),
        F.concat(F.lit("DTSTART;TZID=Europe/Paris:"), stamp_of("starts_at")), F.concat(F.lit("DTEND:"), stamp_of("ends_at")),
        F.lit("LOCATION:Main\\, \r\n Campus"), F.concat(F.lit("DESCRIPTION:"), "description"), F.concat(F.lit("URL:"), "event_url"),
        F.lit("END:VEVENT"), F.lit(""),
    )
    return _pages(_events(spark, sf_dir), lines, "BEGIN:VCALENDAR\r\n", "END:VCALENDAR\r\n", content_type="text/calendar")


@query("e3_calendar", _expect("['Main, Campus']", kind_of="'Campus Board'"))
def e3(spark, sf_dir):
    return _out(event_pages.calendar_events(_calendar_pages(spark, sf_dir), _as_of()))


def _card_pages(spark, sf_dir):
    card = F.concat(
        F.lit('<div class="event-card"><h3>'), "event_title", F.lit('</h3><time datetime="'), _iso("starts_at"),
        F.lit('"></time><p>'), "description", F.lit('</p><a href="/e/'), F.col("event_id").cast("string"),
        F.lit('">Register</a></div>'),
    )
    return _pages(_events(spark, sf_dir), card, "<html><body><h1>Board</h1>", "</body></html>", per_page=130)


_CARD_TEXT = "event_title || ' ' || description || ' Register'"
_LANGUAGE = any_term(
    f"lower({_CARD_TEXT})", ("event", "webinar", "career fair", "info session", "recruit", "workshop")
)
_CARD_URL = "'https://campus.example.edu/e/' || CAST(event_id AS VARCHAR)"
_TEXT_PLACE = (
    "CASE WHEN {0} THEN ['Virtual'] WHEN {1} THEN ['In person'] ELSE CAST([] AS VARCHAR[]) END".format(
        any_term(f"lower({_CARD_TEXT})", ("virtual", "online", "webinar", "zoom")),
        any_term(f"lower({_CARD_TEXT})", ("onsite", "on-site", "in-person", "in person")),
    )
)


@query(
    "e4_html_cards",
    _expect(_TEXT_PLACE, text=_CARD_TEXT, type_text=f"event_title || ' ' || {_CARD_TEXT}", url=_CARD_URL,
            starts="date_trunc('second', starts_at)", ends="CAST(NULL AS TIMESTAMP)", kind_text=_CARD_TEXT, where=_LANGUAGE,
            kind_of="'Campus Board'"),
)
def e4(spark, sf_dir):
    return _out(event_pages.html_card_events(_card_pages(spark, sf_dir), _as_of()))


def _list_pages(spark, sf_dir):
    item = F.concat(
        F.lit("<li><strong>"), "event_title", F.lit("</strong> on "), F.date_format("starts_at", "MMMM d, yyyy"), F.lit(" at "),
        F.date_format("starts_at", "h:mm a"), F.lit(' <a href="'), "event_url", F.lit('">join the event</a></li>'),
    )
    return _pages(_events(spark, sf_dir), item, "<ul>", "</ul>", per_page=260)


_LIST_TEXT = (
    "event_title || ' on ' || strftime(starts_at, '%B %-d, %Y') || ' at ' || strftime(starts_at, '%-I:%M %p') || ' join the event'"
)


@query(
    "e5_recruiting_cards",
    _expect("CASE WHEN contains(lower(event_title), 'virtual') OR contains(lower(event_title), 'webinar')"
            " THEN ['Virtual'] ELSE CAST([] AS VARCHAR[]) END", text=_LIST_TEXT, type_text=f"event_title || ' ' || {_LIST_TEXT}",
            starts="date_trunc('minute', starts_at)", ends="CAST(NULL AS TIMESTAMP)", kind_text=_LIST_TEXT, kind_of="firm",
            where="contains(event_title, 'Amazon') OR contains(event_title, 'NVIDIA')"),
)
def e5(spark, sf_dir):
    return _out(event_pages.recruiting_card_events(_list_pages(spark, sf_dir), _as_of()))


def _site_pages(spark, sf_dir):
    agency = F.concat(
        F.lit('<a class="hds-event-item" event-id="'), F.col("event_id").cast("string"), F.lit('" href="/ev/'),
        F.col("event_id").cast("string"), F.lit('"><span class="hds-event-title">'), "event_title",
        F.lit('</span><span data-event-start-date="'), F.date_format("starts_at", "yyyy-MM-dd"), F.lit('" data-event-timestamp-end="'),
        F.coalesce(F.unix_seconds("ends_at").cast("string"), F.lit("")), F.lit('">soon</span><span class="hds-event-type">Open Day</span></a>'),
    )
    evergreen = F.concat(
        F.lit('\\u003cdiv data-cy=\\"resultsList\\" data-tracking-title=\\"'), "event_title",
        F.lit('\\" data-glue-filter-event-type=\\"hosted virtual\\"\\u003e\\u003ca href=\\"'), "event_url",
        F.lit('\\"\\u003e'), "description", F.lit(" VIRTUAL\\u003c/a\\u003e\\u003c/div\\u003e"),
    )
    item = F.when(F.col("event_id") % 2 == 0, agency).otherwise(evergreen)
    return _pages(_events(spark, sf_dir), item, "<html>", "</html>")


@query(
    "e6_site_cards",
    f"""WITH {duck_views('recruiting_events')}
    SELECT CASE WHEN event_id % 2 = 0 THEN 'https://campus.example.edu/ev/' || CAST(event_id AS VARCHAR) ELSE event_url END AS event_url,
      event_title, CASE WHEN event_id % 2 = 0 THEN 'open_day' ELSE 'hosted_virtual' END AS event_type,
      CASE WHEN event_id % 2 = 0 THEN 'Unspecified' ELSE 'Virtual' END AS location,
      strftime(CASE WHEN event_id % 2 = 0 THEN date_trunc('day', starts_at) ELSE TIMESTAMP '{AS_OF}' END, '%Y-%m-%d %H:%M:%S') AS starts,
      coalesce(strftime(CASE WHEN event_id % 2 = 0 THEN ends_at ELSE TIMESTAMP '{AS_OF}' + INTERVAL 365 DAY END, '%Y-%m-%d %H:%M:%S'), '') AS ends
    FROM recruiting_events""",
)
def e6(spark, sf_dir):
    found = event_pages.site_card_events(_site_pages(spark, sf_dir), _as_of())
    return _out(found).select("event_url", "event_title", "event_type", "location", "starts", "ends")


# --- feeds -----------------------------------------------------------------------------------


def _feed(spark, sf_dir, item, before, after, provider, url):
    return _pages(_events(spark, sf_dir), item, before, after, ",", scope="provider_api", provider=provider, url=url,
                  content_type="application/json")


_JP_URL = "https://www.jpmorganchase.com/careers/events"


def _jpmorgan_feed(spark, sf_dir):
    item = _json(
        event_name="event_title", date_start=F.date_format("starts_at", "MM/dd/yyyy"),
        start_time=F.date_format("starts_at", "h:mm a"), date_end=F.date_format("ends_at", "MM/dd/yyyy"),
        end_time=F.date_format("ends_at", "h:mm a"), event_url="event_url", event_id="event_id", city=F.lit("Tokyo"),
        state=F.lit(""), country=F.lit("Japan"), event_classification=F.lit("Informational/Networking"),
        external_description=F.concat(F.lit("<p>"), "description", F.lit("</p>")),
    )
    return _feed(spark, sf_dir, item, '{"events":[', "]}", "jpmorgan_events", _JP_URL)


@query(
    "e7_jpmorgan_feed",
    _expect("['Tokyo', 'Japan']", type_text="'Informational/Networking ' || event_title", kind_of="'Campus Board'",
            starts="date_trunc('minute', starts_at)", ends="date_trunc('minute', ends_at)"),
)
def e7_jpmorgan(spark, sf_dir):
    return _out(event_pages.jpmorgan_events(_jpmorgan_feed(spark, sf_dir), _as_of()))


@query(
    "e7_morgan_stanley_feed",
    _expect("['Virtual']", type_text="'Webinar ' || description", kind_of="'Campus Board'",
            url="'https://www.morganstanley.com/careers/e/' || CAST(event_id AS VARCHAR)",
            starts="date_trunc('minute', starts_at)",
            ends="CASE WHEN ends_at IS NULL THEN NULL ELSE date_trunc('day', ends_at) + (date_trunc('minute', starts_at) - date_trunc('day', starts_at)) END"),
)
def e7_morgan_stanley(spark, sf_dir):
    item = _json(
        eventId="source_event_id", eventTitle="event_title", eventStartDate=F.concat(F.lit("Monday, "), F.date_format("starts_at", "MMMM dd, yyyy")),
        eventEndDate=F.date_format("ends_at", "MMMM dd, yyyy"), eventTime=F.concat(F.date_format("starts_at", "hh:mm a"), F.lit(" GMT")),
        eventDetailUrl=F.concat(F.lit("/careers/e/"), F.col("event_id").cast("string")), eventType=F.lit("Webinar"),
        eventCountry=F.lit("Virtual"), eventHtmlDescription=F.concat(F.lit("<p>"), "description", F.lit("</p>")),
    )
    feed = _feed(spark, sf_dir, item, '{"status":200,"eventResults":[', "]}", "morgan_stanley_events",
                 "https://www.morganstanley.com/careers/events-aggregate")
    return _out(event_pages.morgan_stanley_events(feed, _as_of()))


@query(
    "e7_nvidia_feed",
    _expect("['Hall 1']", text="event_title || ' ' || description || ' Expo'", kind_of="'Campus Board'",
            tag_text="event_title || ' university student campus'", starts="date_trunc('day', starts_at)",
            ends="date_trunc('day', ends_at)"),
)
def e7_nvidia(spark, sf_dir):
    item = _json(
        title="event_title", startDate=F.date_format("starts_at", "yyyy-MM-dd"), endDate=F.date_format("ends_at", "yyyy-MM-dd"),
        location=F.lit("Hall 1"), url="event_url", venue=F.lit("Expo"), description="description", id="source_event_id",
    )
    feed = _feed(spark, sf_dir, item, "[", "]", "nvidia_university_events", "https://www.nvidia.com/events/")
    return _out(event_pages.nvidia_events(feed, _as_of()))


@query(
    "e7_eightfold_pages",
    _expect("['Remote Room']", kind_of="'Campus Board'",
            kind="CASE WHEN event_id % 2 = 0 THEN 'virtual' ELSE 'unknown' END"),
)
def e7_eightfold(spark, sf_dir):
    """One event per page, inside script source."""
    item = _json(
        name="event_title", plannedEventEncId="source_event_id", eventLandingURL="event_url",
        eventLocationType=F.when(F.col("event_id") % 2 == 0, "virtual_event"), completeVenue=F.lit("Remote Room"),
        startTimestamp=F.unix_seconds("starts_at"), endTimestamp=F.unix_seconds("ends_at"),
        description=F.concat(F.lit("<p>"), "description", F.lit("</p>")),
    )
    pages = _pages(_events(spark, sf_dir), item, '<script>window.__DATA__ = {"eventData": ', "};</script>", per_page=1,
                   provider="eightfold_events", url="https://jobs.example.org/events")
    return _out(event_pages.eightfold_events(pages, _as_of()))


@query("e7_amazon_pages", _expect("['Room 1']", where="contains(event_title, 'Amazon')", kind_of="'Campus Board'"))
def e7_amazon(spark, sf_dir):
    return _out(event_pages.amazon_events(_embedded_pages(spark, sf_dir), _as_of()))


# --- scalars over all events --------------------------------------------------------------------


@query(
    "e8_generic_mapping",
    _expect("['Room 1']", kind_of="'Campus Board'"),
)
def e8(spark, sf_dir):
    items = event_pages.script_items(_embedded_pages(spark, sf_dir)).drop("linked")
    return _out(event_pages.map_items(items, _as_of()))


@query("e9_firm_match", with_events(f"SELECT event_id, coalesce({firm('t')}, '') AS firm FROM ev"))
def e9(spark, sf_dir):
    text = F.concat_ws(" ", "event_title", "description")
    match = events.firm_match(text, F.array().cast("array<string>"), F.col("firm_name"), F.col("firm_kind"))
    return _events(spark, sf_dir).select("event_id", F.coalesce(match["firm_name"], F.lit("")).alias("firm"))


def _scalar(name: str, column: str, sql: str, shape=F.col) -> None:
    @query(name, with_events(f"SELECT event_id, {sql} AS {column} FROM ev"))
    def build(spark, sf_dir):
        derived = events.with_event_columns(_events(spark, sf_dir))
        return derived.select("event_id", shape(column).alias(column))


_scalar("e10_location_type", "location_type", "location_type")
_scalar("e11_event_type", "event_type", "event_type")
_scalar("e12_audience_tags", "audience_tags", "array_to_string(audience_tags, '|')", joined)
_scalar("e13_location_default", "location", "array_to_string(location, '|')", joined)


@query(
    "e14_build_event",
    f"""WITH {duck_views('recruiting_events')}
    SELECT event_url, sha256(CASE WHEN event_id % 2 = 0 THEN source_event_id ELSE firm_name || '|' || event_title || '|' ||
      strftime(starts_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(starts_at) % 1000000 = 0 THEN '' ELSE strftime(starts_at, '.%f') END
      || '+00:00|' || event_url END) AS content_hash FROM recruiting_events""",
)
def e14(spark, sf_dir):
    own = F.when(F.col("event_id") % 2 == 0, F.col("source_event_id"))
    hashed = events.event_hash(own, F.col("firm_name"), F.col("event_title"), F.col("starts_at"), F.col("event_url"))
    return _events(spark, sf_dir).select("event_url", hashed.alias("content_hash"))


@query(
    "e14_all_fields",
    with_events(
        """SELECT CASE WHEN event_id % 5 = 0 THEN 'Other Firm' ELSE firm_name END AS firm_name,
        CASE WHEN event_id % 5 = 0 THEN 'retail' ELSE firm_kind END AS firm_kind, event_title, event_url,
        event_url || '/register' AS registration_url, 'feed' AS source_provider, coalesce(source_event_id, '') AS source_event_id,
        'open_day' AS event_type, array_to_string(audience_tags, '|') AS audience_tags,
        CASE WHEN event_id % 3 = 0 THEN 'Hall|Annex' WHEN location_type = 'virtual' THEN 'Virtual' ELSE 'Unspecified' END AS location,
        location_type, strftime(starts_at, '%Y-%m-%d %H:%M:%S') AS starts, coalesce(strftime(ends_at, '%Y-%m-%d %H:%M:%S'), '') AS ends,
        'UTC' AS timezone, description, CAST(event_id AS VARCHAR) AS raw_payload,
        sha256(coalesce(nullif(source_event_id, ''), firm_name || '|' || event_title || '|' || strftime(starts_at, '%Y-%m-%dT%H:%M:%S')
          || CASE WHEN microsecond(starts_at) % 1000000 = 0 THEN '' ELSE strftime(starts_at, '.%f') END || '+00:00|' || event_url)) AS content_hash
        FROM ev WHERE event_id % 11 > 0 AND event_id % 13 > 0"""
    ),
)
def e14_all(spark, sf_dir):
    """Every field of built events; the hash keeps the source's firm where a match names
    another.  Facts without a title or a start are left out."""
    c, n = F.col, F.col("event_id")
    text = F.concat_ws(" ", "event_title", "description")
    none = F.lit(None).cast("struct<firm_name:string,firm_kind:string>")
    found = _events(spark, sf_dir).select(
        "event_id", "firm_name", "firm_kind", F.lit("feed").alias("source_provider"),
        F.when(n % 5 == 0, F.struct(F.lit("Other Firm").alias("firm_name"), F.lit("retail").alias("firm_kind"))).otherwise(none).alias("firm"),
        F.when(n % 11 > 0, c("event_title")).otherwise("").alias("title"), c("event_url").alias("url"),
        F.concat("event_url", F.lit("/register")).alias("registration"), "source_event_id", F.lit(" Open  Day!").alias("type_text"),
        text.alias("audience_text"), F.when(n % 3 == 0, F.array(F.lit("Hall"), F.lit("Annex"))).alias("places"),
        events.location_type(text).alias("place_kind"), F.when(n % 13 > 0, c("starts_at")).alias("starts_at"), "ends_at",
        F.lit("UTC").alias("timezone"), "description", n.cast("string").alias("raw_payload"),
    )
    built = events.build_events(found, _as_of(), ["event_id"])
    blank = lambda x: F.coalesce(x, F.lit(""))
    return built.select(
        "firm_name", "firm_kind", "event_title", "event_url", "registration_url", "source_provider",
        blank(c("source_event_id")).alias("source_event_id"), "event_type", joined("audience_tags").alias("audience_tags"),
        joined("location").alias("location"), "location_type", stamp("starts_at").alias("starts"), blank(stamp("ends_at")).alias("ends"),
        "timezone", "description", "raw_payload", "content_hash",
    )


@query(
    "e15_dedupe_events",
    f"WITH {duck_views('recruiting_events')}\nSELECT user_id, event_title_key, min(event_id) AS event_id FROM"
    " (SELECT user_id, event_id, substr(event_title, 1, 12) AS event_title_key FROM recruiting_events) GROUP BY 1, 2",
)
def e15(spark, sf_dir):
    repeated = _events(spark, sf_dir).withColumn("event_title_key", F.substring("event_title", 1, 12))
    repeated = repeated.withColumn("content_hash", F.sha2("event_title_key", 256))
    unique = events.dedupe_events(repeated, ["event_id"], ["user_id"])
    return unique.select("user_id", "event_title_key", "event_id")


@query(
    "e16_extractor_precedence",
    f"""WITH {duck_views('recruiting_events')}
    SELECT event_url, CAST(CASE WHEN event_id // {PER_PAGE} % 2 = 0 THEN 0 ELSE 1 END AS BIGINT) AS extractor_ord
    FROM recruiting_events WHERE event_id // {PER_PAGE} % 2 = 0 OR event_id % 7 <> 0""",
)
def e16(spark, sf_dir):
    """Half of the pages have a provider feed; the rest fall back to JSON-LD."""
    feed = event_pages.jpmorgan_events(_jpmorgan_feed(spark, sf_dir).filter("page_id % 2 = 0"), _as_of())
    pages = _ld_pages(spark, sf_dir)
    chosen = events.with_precedence(
        feed, [lambda served: event_pages.json_ld_events(pages.join(served, "page_id", "left_anti"), _as_of())], "page_id"
    )
    return chosen.select("event_url", F.col("extractor_ord").cast("bigint").alias("extractor_ord"))


@query(
    "e16_page_events",
    f"""WITH {duck_views('recruiting_events')},
    ev AS (SELECT *, event_id // 30 AS page, contains(event_title, 'Amazon') AS amazon, contains(event_title, 'NVIDIA') AS nvidia,
             {_LANGUAGE} AS spoken FROM recruiting_events)
    SELECT event_url, 0::BIGINT AS extractor_ord, '' AS firm FROM ev WHERE page % 3 = 0
    UNION ALL SELECT event_url, 2, CASE WHEN amazon THEN 'Amazon' WHEN nvidia THEN 'NVIDIA' ELSE 'Campus Board' END
      FROM ev WHERE page % 3 > 0 AND event_id % 2 = 0
    UNION ALL SELECT event_url, 5, CASE WHEN amazon THEN 'Amazon' ELSE 'NVIDIA' END
      FROM ev WHERE page % 3 > 0 AND event_id % 2 = 1 AND (amazon OR nvidia) AND spoken
    UNION ALL SELECT event_url, 6, 'Campus Board' FROM ev WHERE page % 3 > 0 AND spoken AND event_id % 2 = 1 AND NOT amazon AND NOT nvidia""",
)
def e16_pages(spark, sf_dir):
    """Every third page has a feed; on the others all events are cards and every other
    one is in JSON-LD as well.  The hash holds the page's firm, not the one a card
    names, so each event counts once a page."""
    rows = _events(spark, sf_dir).withColumn("description", F.lit(""))
    ld = _json(name="event_title", startDate=_iso("starts_at"), url="event_url", **{"@type": F.lit("Event")})
    card = F.concat(
        F.lit('<article class="event"><h3>'), "event_title", F.lit('</h3><time datetime="'), _iso("starts_at"), F.lit('"></time><p>'),
        "description", F.lit('</p><a href="'), "event_url", F.lit('">Register</a></article>'),
    )
    listed = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>"), card)).otherwise(card)
    markup = _pages(rows, listed, "<html><body>", "</body></html>", per_page=30)
    feed = _json(title="event_title", startDate=_iso("starts_at"), link="event_url")
    feeds = _pages(rows, feed, "[", "]", ",", provider="nvidia_university_events", per_page=30)
    pages = markup.filter("page_id % 3 > 0").unionByName(feeds.filter("page_id % 3 = 0"))
    found = event_pages.page_events(pages, _as_of())
    firm_name = F.when(F.col("extractor_ord") > 0, F.col("firm_name")).otherwise("")
    return found.select("event_url", F.col("extractor_ord").cast("bigint").alias("extractor_ord"), firm_name.alias("firm"))


@query(
    "e16_feed_provider",
    f"""WITH {duck_views('event_sources')}
    SELECT source_url, CASE CAST(source_ord % 4 AS INT) WHEN 0 THEN 'nvidia' WHEN 1 THEN 'jpmorgan' WHEN 2 THEN 'eightfold' ELSE '' END AS feed
    FROM event_sources""",
)
def e16_feed(spark, sf_dir):
    n = F.col("source_ord") % 4
    provider = F.when(n == 0, "nvidia_university_events").otherwise("company_events")
    page = F.when(n == 1, "www.jpmorganchase.com").when(n == 2, "jobs.example.com").otherwise(host(F.col("source_url")))
    return view(spark, sf_dir, "event_sources").select(
        "source_url", F.coalesce(events.feed_provider(provider, page), F.lit("")).alias("feed")
    )


_CODES = "CASE CAST(source_ord % 5 AS INT) WHEN 0 THEN 401 WHEN 1 THEN 404 WHEN 2 THEN 500 END"


@query(
    "e17_event_run_summary",
    with_events(
        f"""SELECT s.source_url, CASE CAST(s.source_ord % 5 AS INT) WHEN 0 THEN 'auth-required' WHEN 1 THEN 'inactive' WHEN 2 THEN 'failed'
          ELSE CASE WHEN n > 0 THEN 'productive' ELSE 'empty' END END AS status,
          CASE WHEN s.source_ord % 5 < 3 THEN 0 ELSE n END AS event_count
        FROM (SELECT s.source_url, any_value(s.source_ord) AS source_ord, count(e.id) AS n FROM event_sources s
          LEFT JOIN event_table e ON e.source_url = s.source_url GROUP BY 1) s"""
    ),
)
def e17(spark, sf_dir):
    sources = view(spark, sf_dir, "event_sources").drop("status")
    failures = sources.withColumn("code", F.expr(_CODES)).filter("code IS NOT NULL").select(
        "source_url", fetch_status(F.col("source_url"), F.col("code")).alias("status"), F.lit("HTTPError").alias("error_type"),
        F.lit("").alias("message"),
    )
    named = source_table(spark, sf_dir).select(F.col("id").alias("source_id"), "source_url")
    found = event_table(spark, sf_dir).join(named, "source_id")
    summary = events.event_run_summary(sources, found, failures)
    return summary.select("source_url", "status", F.col("event_count").cast("bigint").alias("event_count"))


# --- artifacts ------------------------------------------------------------------------------------


def _full_events(spark, sf_dir):
    return events.with_event_columns(_events(spark, sf_dir)).select(*events.EVENT_FIELDS)


@query(
    "snk5_write_event_pull",
    f"WITH {duck_views('recruiting_events')}\nSELECT content_hash, event_title FROM recruiting_events",
)
def snk5(spark, sf_dir):
    path = scratch_path(spark, "event-pull")
    sources = view(spark, sf_dir, "event_sources").withColumn("event_count", F.lit(0))
    failures = sources.filter("status = 'failed'").select("source_url", "firm_name", "firm_kind", "source_provider")
    artifacts.write_event_pull(_full_events(spark, sf_dir), sources, failures, path, _as_of())
    return spark.read.schema("content_hash string, event_title string").json(f"{path}/events")


@query(
    "src3_read_event_pull",
    f"WITH {duck_views('recruiting_events')}\nSELECT event_url, strftime(starts_at, '%Y-%m-%d %H:%M:%S') AS starts FROM recruiting_events",
)
def src3(spark, sf_dir):
    """Nested event documents of fifty events each."""
    path = scratch_path(spark, "event-documents")
    block = F.floor(F.unix_seconds("starts_at") / 86400)
    nested = _full_events(spark, sf_dir).withColumn("_e", F.struct(*events.EVENT_FIELDS)).groupBy(
        block.alias("_day"), (F.crc32(F.col("content_hash")) % 16).alias("_slot")
    ).agg(F.collect_list("_e").alias("events"))
    nested.select(F.size("events").alias("event_count"), "events").write.json(path)
    _, found, _ = artifacts.read_event_pull(spark, [path], multi_line=False)
    return found.select("event_url", stamp("starts_at").alias("starts"))


@query(
    "src6_event_sources",
    f"WITH {duck_views('event_sources')}\nSELECT source_url AS event_page_url, firm_name FROM event_sources",
)
def src6(spark, sf_dir):
    """Configuration read back from JSON, every entry twice."""
    path = scratch_path(spark, "source-config")
    config = view(spark, sf_dir, "event_sources").select(
        "firm_name", "firm_kind", F.col("source_url").alias("event_page_url"), F.explode(F.array(F.lit(1), F.lit(2))).alias("_twice")
    )
    config.select(F.to_json(F.struct("firm_name", "firm_kind", "event_page_url")).alias("value")).write.text(path)
    sources = lists.read_event_sources(spark, path, multi_line=False)
    return lists.dedupe_sources(sources, ["pos"]).select("event_page_url", "firm_name")
