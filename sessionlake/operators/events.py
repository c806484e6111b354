"""Economic events: classify, filter, number, agenda and calendar grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from .numbering import number_rows
from .recurrence import step

DAYS_AHEAD = 14
NOTE_LENGTH = 200
#: Events in one segment of a date's agenda.
SEGMENT_EVENTS = 1024


def classify_events(events: DataFrame, terms=text.TERMS, dst: bool = False) -> DataFrame:
    """Date, time, all_day, summary and description to the full event record; blank summaries are dropped."""
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    # each step is worked out once for a row: the next ones use it dozens of times
    base = events.select("date", "time", "all_day", "summary", "description")
    base = step(base, title=text.replace_terms(strip(F.col("summary")), terms), _described=text.replace_terms(strip(F.col("description")), terms)).filter("title != ''")
    base = step(base, _link=text.extract_link(F.col("_described")))
    base = step(base, _upper=F.upper(F.concat_ws(" ", "title", "_link.rest")))
    base = step(
        base, _country=text.country_of(F.col("title"), F.col("_upper"), is_upper=True), category=text.first_rule(F.col("_upper"), is_upper=True),
        importance=text.importance_of(F.col("_upper"), is_upper=True), _values=text.labelled_values(F.col("_link.rest")),
    )
    base = step(base, _times=dates.event_times(F.col("date"), F.when(~F.col("all_day"), F.col("time")), F.col("_country.country"), dst))
    note = F.nullif(F.substring("_link.rest", 1, NOTE_LENGTH), F.lit(""))
    return base.select(
        "date", "time", "all_day", "title", note.alias("description"), note.alias("note"), F.col("_link.link").alias("source_url"),
        "category", text.name_of(F.col("category")).alias("category_name"), "_country.*", "_times.*", "importance", "_values.*",
        numbers.surprise(F.col("_values.actual"), F.col("_values.forecast")).alias("comparison"),
    )


def in_date_range(df: DataFrame, today: Column, days: int = DAYS_AHEAD, day: str = "date", summary: str = "summary") -> DataFrame:
    """Events from today to ``days`` ahead that have a summary."""
    return df.filter(F.col(day).between(today, F.date_add(today, days)) & (F.trim(F.coalesce(F.col(summary), F.lit(""))) != ""))


def event_order(tie: str = "title") -> list[Column | str]:
    """By date, then time with all-day events first."""
    return ["date", F.col("time").asc_nulls_first(), tie]


def sort_events(df: DataFrame, tie: str = "title") -> DataFrame:
    """The events in that order."""
    return df.orderBy(*event_order(tie))


def number_events(df: DataFrame, calendar: Sequence[str] = (), tie: str = "title") -> DataFrame:
    """``event_no`` "ev-<date>-<n>": n counts the events of a calendar in the order of date, time and title.

    Without ``calendar`` columns the whole table is one calendar. Ranges of
    that order are counted apart, so neither a long calendar nor a date that
    holds many events meets in one task. Events without a date get none.
    """
    order = [F.col("date"), F.col("time").asc_nulls_first(), F.col(tie)]
    placed = number_rows(df.filter("date is not null"), *[F.col(c).asc_nulls_first() for c in calendar], *order, name="_place")
    if calendar:
        first = placed.groupBy(*calendar).agg(F.min("_place").alias("_first"))  # one row per calendar
        same = [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in calendar]
        placed = placed.alias("p").join(first.alias("f"), same).select("p.*", "_first")
    number = F.col("_place") - (F.col("_first") if calendar else F.lit(0)) + 1
    made = F.concat(F.lit("ev-"), F.date_format("date", "yyyy-MM-dd"), F.lit("-"), number.cast("string"))
    return placed.withColumn("event_no", made).select(*df.columns, "event_no").unionByName(df.filter("date is null").withColumn("event_no", F.lit(None).cast("string")))


def filter_events(df: DataFrame, today: Column, quick: Sequence[str] = (), countries: Sequence[str] = (), categories: Sequence[str] = (), search: str = "") -> DataFrame:
    """All given filters at once; an empty one keeps everything. ``quick``: star3, today, this_week (today to Sunday)."""
    keep = F.lit(True)
    if "star3" in quick:
        keep = keep & (F.col("importance") == 3)
    if "today" in quick:
        keep = keep & (F.col("date") == today)
    if "this_week" in quick:
        keep = keep & F.col("date").between(today, F.date_add(today, 6 - F.weekday(today)))
    if countries:
        keep = keep & F.col("country").isin(*countries)
    if categories:
        keep = keep & F.col("category").isin(*categories)
    if search:
        keep = keep & F.contains(F.lower("title"), F.lit(search.lower()))
    return df.filter(keep)


def _agenda_days(listed: DataFrame, today: Column, *more: str) -> DataFrame:
    relative, weekday = dates.relative_day(F.col("date"), today).alias("relative"), dates.weekday_label(F.col("date")).alias("weekday")
    return listed.select("date", *more, relative, weekday, (F.col("date") == today).alias("is_today"), F.transform("events", lambda e: e.dropFields("at")).alias("events"))


def _agenda_order(keep: Sequence[str]) -> Column:
    return F.struct(F.coalesce("time", F.lit("")).alias("at"), *keep)


def agenda(events: DataFrame, today: Column, keep: Sequence[str] = ("time", "title")) -> DataFrame:
    """One row per date: relative day, weekday, is_today and the ordered events (all-day first). ``agenda_segments`` bounds a row."""
    listed = events.filter("date is not null").groupBy("date").agg(F.sort_array(F.collect_list(_agenda_order(keep))).alias("events"))
    return _agenda_days(listed, today)


def agenda_segments(events: DataFrame, today: Column, keep: Sequence[str] = ("time", "title"), most: int = SEGMENT_EVENTS) -> DataFrame:
    """The agenda with each date's events in segments (from 0, in order) of at most ``most`` events.

    Events are placed by ranges of one order over all dates, so a date that
    holds many of them meets in no task and no row.
    """
    dated = events.filter("date is not null").select("date", _agenda_order(keep).alias("_event"))
    placed = number_rows(dated, "date", "_event", name="_place")
    starts = placed.groupBy(F.col("date").alias("_date")).agg(F.min("_place").alias("_start"))  # one row per date
    cut = placed.join(starts, F.col("date") == F.col("_date")).withColumn("segment", F.expr(f"(_place - _start) div {int(most)}"))
    return _agenda_days(cut.groupBy("date", "segment").agg(F.sort_array(F.collect_list("_event")).alias("events")), today, "segment")


def calendar_grid(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Weeks from Sunday to Saturday that cover each (today, range_end) of ``ranges``.

    One row per day: week (from 0), weekday (Sunday 0), day, month_label (on
    the 1st and the first cell), is_today, in_range, and the number of events,
    0 outside the range.
    """
    counts = events.groupBy(F.col("date").alias("_date")).count()
    start = F.date_sub("today", (F.weekday("today") + 1) % 7)
    end = F.date_add("range_end", 6 - (F.weekday("range_end") + 1) % 7)
    days = ranges.withColumn("_start", start).withColumn("date", F.explode(F.sequence(start, end)))
    joined = days.join(counts, days["date"] == counts["_date"], "left")
    inside = F.col("date").between(F.col("today"), F.col("range_end"))
    away = F.datediff("date", "_start")
    label = F.when((F.dayofmonth("date") == 1) | (away == 0), F.concat(F.month("date"), F.lit("/"), F.dayofmonth("date")))
    return joined.select(
        "today", "range_end", F.floor(away / 7).cast("int").alias("week"), (away % 7).alias("weekday"), "date", F.dayofmonth("date").alias("day"), label.alias("month_label"),
        (F.col("date") == F.col("today")).alias("is_today"), inside.alias("in_range"), F.when(inside, F.coalesce("count", F.lit(0))).otherwise(0).cast("long").alias("n_events"),
    )
