"""Tolerant date and time parsing (all results are UTC timestamps)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiretide.functions.expr import bound, not_empty, squeeze, strip

WEEKDAY = "(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day"
MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"

ISO_DATE = r"\d{4}-\d{2}-\d{2}"
ISO_STAMP = (
    ISO_DATE + r"(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)?(?:[+-]\d{2}:?\d{2}(?::\d{2})?)?)?"
)


def _when_like(text: Column, pattern: str, *formats: str) -> Column:
    """Parse only rows of the right shape, so that a lenient parser cannot
    accept more than intended."""
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.when(text.rlike(f"^{pattern}$"), F.coalesce(*tries))


def iso_timestamp(text: Column) -> Column:
    """ISO date or date-time, blank or T between the parts, optional offset."""
    compact = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    compact = F.regexp_replace(compact, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})([+-]|$)", "$1:00$2")
    return F.when(text.rlike(f"^{ISO_STAMP}$"), compact.try_cast("timestamp"))


def epoch_timestamp(value: Column) -> Column:
    """Seconds, or milliseconds when above ten billion."""
    seconds = F.when(value > 10_000_000_000, value / 1000).otherwise(value)
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint"))


def listing_timestamp(text: Column) -> Column:
    """Posting date given as text (T1): ISO, or one of five written forms."""

    def parse(compact: Column) -> Column:
        return F.coalesce(
            iso_timestamp(compact),
            bound(F.replace(compact, F.lit(". "), F.lit(" ")), written_form),
        )

    def written_form(written: Column) -> Column:
        # weekday names are not accepted by the parser: match and drop them
        stamped = F.regexp_replace(
            written, rf"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) ({MON}) (\d+) ([\d:]+) UTC (\d+)$", "$1 $2 $4 $3"
        )
        return F.coalesce(
            _when_like(written, r"[A-Za-z]+ \d{1,2}, \d{4}", "MMMM d, yyyy", "MMM d, yyyy"),
            _when_like(written, r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
            _when_like(stamped, rf"{MON} \d{{1,2}} \d{{4}} \d{{1,2}}:\d{{1,2}}:\d{{1,2}}", "MMM d yyyy H:m:s"),
        )

    return bound(F.replace(squeeze(text), F.lit("Z"), F.lit("+00:00")), parse)


def relative_posting(text: Column, as_of: Column) -> Column:
    """'Posted 3 days ago' style text relative to ``as_of``."""

    def age_in_days(lowered: Column) -> Column:
        # fixed pattern
        days = F.regexp_extract(lowered, r"^posted\s+(\d+)\+?\s+days?\s+ago$", 1)
        return (
            F.when(lowered.isin("posted today", "today"), F.lit(0))
            .when(lowered.isin("posted yesterday", "yesterday"), F.lit(1))
            .otherwise(not_empty(days).try_cast("int"))
        )

    return as_of - F.make_dt_interval(bound(F.lower(strip(text)), age_in_days))


def posting_date(as_of: Column, *absolute: Column, relative: Column) -> Column:
    """First absolute candidate that parses, else the relative text."""
    return F.coalesce(*map(listing_timestamp, absolute), relative_posting(relative, as_of))


def _bare_time(time: Column) -> Column:
    # fixed pattern
    zoneless = F.regexp_replace(squeeze(time), r"(?i)\b(?:GMT|UTC|ET|EST|EDT|CT|CST|CDT|PT|PST|PDT)\b", "")
    return F.upper(squeeze(F.replace(zoneless, F.lit("."))))


def _written_day(text: Column) -> Column:
    return F.coalesce(
        _when_like(text, r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
        _when_like(text, r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
        _when_like(text, r"[A-Za-z]+ \d{1,2}, \d{4}", "MMMM d, yyyy", "MMM d, yyyy"),
        _when_like(text, r"\d{1,2} [A-Za-z]+ \d{4}", "d MMMM yyyy", "d MMM yyyy"),
    )


def _clock_interval(clock: Column) -> Column:
    """Time of day as an interval; NULL when the text is not a time."""
    hour = F.regexp_extract(clock, r"^(\d{1,2})", 1).try_cast("int")
    minute = F.coalesce(
        not_empty(F.regexp_extract(clock, r"^\d{1,2}:(\d{1,2})", 1)).try_cast("int"), F.lit(0)
    )
    twelve = clock.rlike(r"^\d{1,2}:\d{1,2} (?:AM|PM)$|^\d{1,2} ?(?:AM|PM)$") & hour.between(1, 12)
    twentyfour = clock.rlike(r"^\d{1,2}:\d{1,2}$") & (hour <= 23)
    hours = F.when(twelve, hour % 12 + F.when(clock.endswith("PM"), 12).otherwise(0)).when(twentyfour, hour)
    return F.when(minute <= 59, F.make_dt_interval(F.lit(0), hours, minute))


def date_and_time(date: Column, time: Column) -> Column:
    """A written date plus an optional time of day.

    Weekday and zone names are dropped; the result counts as UTC.
    """
    day_text = F.replace(F.regexp_replace(squeeze(date), rf"^{WEEKDAY},\s+", ""), F.lit("."))
    clock = _bare_time(F.coalesce(not_empty(time), F.lit("12:00 AM")))
    return bound(
        bound(day_text, _written_day),
        lambda day: F.coalesce(day + bound(clock, _clock_interval), day),
    )


def event_timestamp(text: Column) -> Column:
    """Start or end of an event found anywhere in a text (T4)."""

    def narrowed(compact: Column) -> Column:
        # fixed pattern
        found = F.regexp_extract(
            compact, r"\b(\d{4}-\d{2}-\d{2}(?:[T ][0-9:]{4,8}(?:[+-][0-9:]+)?)?)\b", 1
        )
        return F.coalesce(not_empty(found), compact)

    def parse(candidate: Column) -> Column:
        # fixed patterns
        written = F.regexp_extract(
            candidate,
            rf"((?:{WEEKDAY},\s+)?(?:[A-Z][a-z]+\.?\s+\d{{1,2}},\s+\d{{4}}"
            r"|\d{1,2}\s+[A-Z][a-z]+\.?\s+\d{4}|\d{1,2}/\d{1,2}/\d{4}))",
            1,
        )
        clock = F.regexp_extract(
            candidate, r"\b(\d{1,2}(?::\d{2})?\s*(?:a\.?m\.?|p\.?m\.?|AM|PM|am|pm))\b", 1
        )
        return F.coalesce(
            iso_timestamp(candidate),
            date_and_time(not_empty(written), not_empty(clock)),
            _when_like(candidate, r"\d{8}", "yyyyMMdd"),
        )

    compact = F.replace(squeeze(text), F.lit("Z"), F.lit("+00:00"))
    return bound(bound(compact, narrowed), parse)


def flexible_timestamp(number: Column, text: Column) -> Column:
    """Numeric epoch when the value is a number, otherwise text (T4)."""
    return F.coalesce(epoch_timestamp(number), event_timestamp(text))


def calendar_timestamp(text: Column) -> Column:
    """iCalendar stamp: text after the last colon, zone ignored (T5)."""
    value = F.regexp_replace(squeeze(F.element_at(F.split(text, ":"), -1)), "Z$", "")
    return F.coalesce(
        _when_like(value, r"\d{8}T\d{6}", "yyyyMMdd'T'HHmmss"),
        _when_like(value, r"\d{8}", "yyyyMMdd"),
    )


def rss_timestamp(text: Column) -> Column:
    """RFC 2822 publication date."""
    dated = F.regexp_replace(squeeze(text), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(dated, r" (?:GMT|UT|UTC|Z)$", " +0000")
    return F.coalesce(
        _when_like(zoned, r"\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}", "d MMM yyyy HH:mm:ss Z"),
        _when_like(zoned, r"\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}", "d MMM yyyy HH:mm:ss"),
    )


def age_label(posted: Column, as_of: Column) -> Column:
    """Calendar age of a posting, as shown on cards."""
    days = F.datediff(as_of, posted)
    return (
        F.when(posted.isNull(), "Fresh")
        .when(days == -1, "Tomorrow")
        .when(days < 0, F.concat(F.lit("In "), F.abs(days).cast("string"), F.lit(" days")))
        .when(days == 0, "Today")
        .when(days == 1, "1 day")
        .otherwise(F.concat(days.cast("string"), F.lit(" days")))
    )


def age_sentence(posted: Column, as_of: Column) -> Column:
    """Long variant of :func:`age_label`."""
    age = age_label(posted, as_of)
    return (
        F.when(age == "Fresh", "Fresh posting")
        .when(age == "Today", "Posted today")
        .when(age == "Tomorrow", "Posts tomorrow")
        .when(age.startswith("In "), F.concat(F.lit("Posts "), F.lower(age)))
        .otherwise(F.concat(F.lit("Posted "), age, F.lit(" ago")))
    )


def age_compact(posted: Column, as_of: Column) -> Column:
    """Short variant of :func:`age_label`."""
    age = age_label(posted, as_of)
    fixed = age.isin("Fresh", "Today", "Tomorrow") | age.startswith("In ")
    return F.when(fixed, age).otherwise(F.concat(age, F.lit(" ago")))


def short_date(value: Column) -> Column:
    """'May 7, 2026', or a placeholder."""
    return F.coalesce(F.date_format(value, "MMM d, yyyy"), F.lit("Not available"))
