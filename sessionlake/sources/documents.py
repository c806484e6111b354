"""Whole-document sources and sinks: JSON documents, feeds, calendars, articles, pages."""

from __future__ import annotations

import zoneinfo
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import in_local_time

#: Names of the zone database that stand for a place or for UTC.
ZONES = frozenset(z for z in zoneinfo.available_timezones() if "/" in z or z in ("UTC", "GMT"))
#: Other names that calendars use for zones.
ZONE_NAMES = {
    "Taipei Standard Time": "Asia/Taipei", "China Standard Time": "Asia/Shanghai", "Tokyo Standard Time": "Asia/Tokyo", "GMT Standard Time": "Europe/London",
    "W. Europe Standard Time": "Europe/Berlin", "Eastern Standard Time": "America/New_York", "Central Standard Time": "America/Chicago", "Pacific Standard Time": "America/Los_Angeles",
}
FEED_ITEM = "title string, link string, pubDate string, source struct<_VALUE: string, _url: string>"


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file; files that are missing, empty or invalid give no row."""
    bad = "_corrupt_record"
    reader = spark.read.schema(f"{schema}, {bad} string").option("multiLine", True).option("columnNameOfCorruptRecord", bad)
    rows = reader.option("ignoreMissingFiles", True).json(path)
    return rows.filter(F.col(bad).isNull()).drop(bad)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: title, link, pubDate, source."""
    items = spark.read.format("xml").option("rowTag", "item").schema(FEED_ITEM).load(path)
    return items.select("title", "link", "pubDate", F.col("source._VALUE").alias("source"))


_BEGIN = "BEGIN:VEVENT"
# A property's parameters: names with values, which may be quoted.
_PARAMETERS = r'((?:;[^=:;\n]+=(?:"[^"\n]*"|[^":;\n])*)*)'


def _text(event: Column, name: str) -> Column:
    """Text of a calendar property, its parameters left out; null where it is missing."""
    found = F.regexp_extract(event, rf"(?mi)^{name}{_PARAMETERS}:(.*)$", 2)
    for old, new in (("\\n", "\n"), ("\\,", ","), ("\\;", ";"), ("\\\\", "\\")):
        found = F.replace(found, F.lit(old), F.lit(new))
    return F.nullif(F.trim(found), F.lit(""))


def _zone(parameters: Column, value: Column, zones: Mapping[str, str]) -> Column:
    """Zone of a time: UTC after a Z, else its TZID where that is known, else null."""
    named = F.regexp_extract(parameters, r'(?i);TZID="?/?([^";:]+)', 1)
    table = F.create_map(*[F.lit(x) for pair in zones.items() for x in pair])
    own = F.coalesce(table[named], F.when(named.isin(sorted(ZONES)), named))
    return F.when(F.endswith(value, F.lit("Z")), "UTC").when(F.length(value) > 8, own)


def _wall_clock(value: Column) -> Column:
    """yyyyMMdd'T'HHmmss, with or without a Z, or yyyyMMdd; null where it is neither."""
    forms = ((F.regexp_replace(value, "Z$", ""), "yyyyMMdd'T'HHmmss"), (value, "yyyyMMdd"))
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(form)) for v, form in forms]).cast("timestamp_ntz")


def _times(event: Column, name: str, zones: Mapping[str, str]) -> Column:
    """Local times of all values of all properties ``name``; of periods the start."""
    lines = F.regexp_extract_all(event, F.lit(rf"(?mi)^{name}{_PARAMETERS}:.*$"), 0)

    def values(line: Column) -> Column:
        parameters = F.regexp_extract(line, rf"(?i)^{name}{_PARAMETERS}:", 1)
        each = F.split(F.regexp_extract(line, rf"(?i)^{name}{_PARAMETERS}:(.*)$", 2), ",")
        return F.transform(each, lambda v: in_local_time(_wall_clock(F.trim(F.substring_index(v, "/", 1))), _zone(parameters, F.trim(F.substring_index(v, "/", 1)), zones)))

    return F.filter(F.flatten(F.transform(lines, values)), lambda t: t.isNotNull())


def parse_ics(text: Column, zones: Mapping[str, str] = ZONE_NAMES) -> Column:
    """Array of the events of a calendar, a struct each.

    dtstart is the start in local time and all_day says that it is a date;
    starts and zone are the same start on the event's own clock (null zone:
    local). uid, summary, description and rrule are text; exdates, rdates and
    recurrence_id are local times. Folded lines are joined. Components inside
    an event (alarms) are no part of it. A time with a Z is UTC, one with a
    TZID has that zone's rules (names beyond the zone database by ``zones``),
    any other is local. Events without a uid get one from their text. One
    that has no end before the next begins is none.
    """
    unfolded = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n[ \t]", "")
    begun = F.split(unfolded, r"(?im)^BEGIN:VEVENT[ \t]*\n")
    events = F.filter(F.transform(F.slice(begun, 2, F.greatest(F.size(begun) - 1, F.lit(0))), lambda e: F.regexp_extract(e, r"(?ims)\A(.*?)^END:VEVENT", 1)), lambda e: e != "")
    own = F.transform(events, lambda e: F.regexp_replace(e, r"(?ims)^BEGIN:([A-Z0-9-]+)[ \t]*\n.*?^END:\1[ \t]*\n?", ""))

    def one(event: Column) -> Column:
        raw, parameters = (F.trim(F.regexp_extract(event, rf"(?mi)^DTSTART{_PARAMETERS}:(.*)$", group)) for group in (2, 1))
        zone, starts = _zone(parameters, raw, zones), _wall_clock(raw)
        return F.struct(
            in_local_time(starts, zone).alias("dtstart"), (F.length(raw) == 8).alias("all_day"), _text(event, "SUMMARY").alias("summary"),
            _text(event, "DESCRIPTION").alias("description"), _text(event, "RRULE").alias("rrule"), F.coalesce(_text(event, "UID"), F.md5(event)).alias("uid"),
            starts.alias("starts"), zone.alias("zone"), _times(event, "EXDATE", zones).alias("exdates"), _times(event, "RDATE", zones).alias("rdates"),
            F.get(_times(event, "RECURRENCE-ID", zones), F.lit(0)).alias("recurrence_id"),
        )

    return F.transform(own, one)


def read_ics(spark: SparkSession, path: str) -> DataFrame:
    """One row per event of the calendar files under ``path``.

    Files are cut before each line that begins an event, so a large one is
    read by several tasks and none holds more of it than an event. Where the
    lines end in a lone carriage return, or say ``begin:vevent`` in small
    letters, the events up to the next cut are read together.
    """
    parts = spark.read.option("lineSep", f"\n{_BEGIN}").text(path)
    # the cut takes these words away, but for those at the beginning of a file
    event = F.when(F.startswith("value", F.lit(_BEGIN)), F.col("value")).otherwise(F.concat(F.lit(_BEGIN), "value"))
    return parts.select(F.inline(parse_ics(event)))


def parse_article(text: Column) -> Column:
    """struct(title, url, body): headers before the first line of three dashes; without one all is body."""
    parts = F.split(text, "\n---\n", 2)
    head = F.when(F.size(parts) > 1, F.get(parts, F.lit(0)))
    return F.struct(
        F.nullif(F.trim(F.regexp_extract(head, r"(?m)^Title:(.*)$", 1)), F.lit("")).alias("title"),
        F.nullif(F.trim(F.regexp_extract(head, r"(?m)^URL:(.*)$", 1)), F.lit("")).alias("url"),
        F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(text).alias("body"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole HTML files: path, html."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def write_outputs(df: DataFrame, path: str, by: str = "date", form: str = "parquet") -> None:
    """A dataset partitioned by date, and beside it a one-row build record (rows, first and last date)."""
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).format(form).save(f"{path}/data")
    record = df.sparkSession.read.format(form).load(f"{path}/data").agg(F.count(F.lit(1)).alias("row_count"), F.min(by).alias("first"), F.max(by).alias("last"))
    record.coalesce(1).write.mode("overwrite").json(f"{path}/build")
