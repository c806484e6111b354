"""Dates and times of the feeds. Times without a zone are Taipei wall-clock times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAIPEI_HOURS = 8
LOCAL_ZONE = "Asia/Taipei"
#: Hours from UTC that event labels use, and the label; other countries show Taipei time.
ORIGINS = {"US": (-4, "ET", "America/New_York"), "JP": (9, "JST", "Asia/Tokyo"), "EU": (2, "CET", "Europe/Berlin"), "GB": (1, "GMT", "Europe/London")}
ALL_DAY = "全天"


def _int(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def roc_timestamp(date: Column, time: Column) -> Column:
    """"yyy/MM/dd" in years since 1911 and "HH:mm[:ss]" as a timestamp; null where either is bad."""
    d, t = F.split(date, "/"), F.split(time, ":")
    seconds = F.when(F.size(t) > 2, _int(F.get(t, F.lit(2)))).otherwise(F.lit(0))
    made = F.try_make_timestamp_ntz(_int(F.get(d, F.lit(0))) + 1911, _int(F.get(d, F.lit(1))), _int(F.get(d, F.lit(2))), _int(F.get(t, F.lit(0))), _int(F.get(t, F.lit(1))), seconds)
    return F.when((F.size(d) == 3) & (F.size(t) >= 2), made)


def parse_pubdate(text: Column) -> Column:
    """"Thu, 20 Aug 2026 15:30:00 GMT" as Taipei wall-clock time; null where it is bad."""
    core = F.regexp_extract(text, r"^[A-Za-z]{3}, (\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) (?:GMT|UTC)$", 1)
    utc = F.try_to_timestamp(F.nullif(core, F.lit("")), F.lit("d MMM yyyy HH:mm:ss"))
    return (utc + F.make_dt_interval(hours=F.lit(TAIPEI_HOURS))).cast("timestamp_ntz")


def event_times(date: Column, time: Column, country: Column, dst: bool = False) -> Column:
    """struct(datetime_utc, time_tpe_str, time_origin_str) of a Taipei date and "HH:mm".

    Without a time the event lasts all day and its UTC text is midnight of the
    date. Origin times use fixed offsets; ``dst`` takes the zones' own rules.
    """
    local = F.to_timestamp_ntz(F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" "), time), F.lit("yyyy-MM-dd HH:mm"))
    utc = local - F.make_dt_interval(hours=F.lit(TAIPEI_HOURS))
    tpe = F.concat(time, F.lit(" TPE"))
    origin = None
    for code, (hours, label, zone) in ORIGINS.items():
        there = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc) if dst else utc + F.make_dt_interval(hours=F.lit(hours))
        shift = F.datediff(there, date)
        day = F.when((F.lit(code) == "US") & (shift != 0), F.concat(F.when(shift > 0, "+").otherwise(""), shift.cast("string"))).otherwise("")
        text = F.concat(F.date_format(there, "HH:mm"), day, F.lit(f" {label}"))
        origin = F.when(country == code, text) if origin is None else origin.when(country == code, text)
    all_day = F.coalesce(time, F.lit("")) == ""
    return F.struct(
        F.when(all_day, F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("T00:00:00Z"))).otherwise(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("datetime_utc"),
        F.when(all_day, ALL_DAY).otherwise(tpe).alias("time_tpe_str"),
        F.when(all_day, ALL_DAY).otherwise(origin.otherwise(tpe)).alias("time_origin_str"),
    )


def in_local_time(stamp: Column, zone: Column) -> Column:
    """Wall clock of a zone as local wall clock, by the zone's own rules for summer time; local already where the zone is null. The zone must be a known one."""
    return F.when(zone.isNull(), stamp).otherwise(F.convert_timezone(zone, F.lit(LOCAL_ZONE), stamp))


def days_left(text: Column) -> Column:
    """first whole number in the text; null where there is none."""
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def hours_between(later: Column, earlier: Column) -> Column:
    """Exact hours from ``earlier`` to ``later``; both timestamps without zone."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(3_600_000_000.0)


def age_hours(now: Column, ts: Column) -> Column:
    """age to one decimal, never below zero."""
    from .numbers import py_round

    return F.greatest(F.lit(0.0), py_round(hours_between(now, ts), 1))


def freshness(hours: Column) -> Column:
    """fresh below 6 hours, aging below 12, else stale."""
    return F.when(hours < 6, "fresh").when(hours < 12, "aging").otherwise("stale")


def tile(hours: Column) -> Column:
    """fresh below 24 hours, amber up to 36, else danger."""
    return F.when(hours < 24, "fresh").when(hours <= 36, "amber").otherwise("danger")


def hours_since_us_close(now: Column) -> Column:
    """hours to one decimal since the last 04:00 in Taipei."""
    from .numbers import py_round

    close = F.date_trunc("DAY", now).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(4))
    last = F.when(now < close, close - F.make_dt_interval(days=F.lit(1))).otherwise(close)
    return py_round(hours_between(now, last), 1)


def event_status(now: Column, at: Column) -> Column:
    """countdown within two hours before, live within 15 minutes, past after 30; null between."""
    ahead = F.timestamp_diff("MICROSECOND", now, at)
    minute = 60_000_000
    return F.when(F.abs(ahead) <= 15 * minute, "live").when((ahead > 0) & (ahead <= 120 * minute), "countdown").when(ahead < -30 * minute, "past")


def relative_day(day: Column, today: Column) -> Column:
    """F16: today, tomorrow, this_week (up to Sunday, also the past), else next_week."""
    sunday = F.date_add(today, 6 - F.weekday(today))
    return F.when(day == today, "today").when(day == F.date_add(today, 1), "tomorrow").when(day <= sunday, "this_week").otherwise("next_week")


def weekday_label(day: Column) -> Column:
    """F16: name of the weekday."""
    names = F.array(*[F.lit(x) for x in ("週一", "週二", "週三", "週四", "週五", "週六", "週日")])
    return F.get(names, F.weekday(day))


def session_date(ts: Column, join_weekend: bool = False) -> Column:
    """Date of the session that a Taipei time belongs to.

    From 15:00 on it is the next weekday, whatever the holidays. Earlier hours
    belong to their own date; ``join_weekend`` moves those of a weekend to
    Monday as well.
    """
    day = ts.cast("date")
    weekday = F.weekday(day)
    evening = F.date_add(day, F.when(weekday == 4, 3).when(weekday == 5, 2).otherwise(1))
    early = F.date_add(day, F.when(weekday == 5, 2).when(weekday == 6, 1).otherwise(0)) if join_weekend else day
    return F.when(F.hour(ts) >= 15, evening).otherwise(early)
