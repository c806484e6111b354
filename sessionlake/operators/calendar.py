"""Trading calendar as a small dimension, and the time rules that join it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Exchange holidays of 2026, as given.
HOLIDAYS_2026 = (
    "2026-01-01", "2026-02-16", "2026-02-17", "2026-02-18", "2026-02-19", "2026-02-20", "2026-02-27",
    "2026-04-03", "2026-04-06", "2026-05-01", "2026-06-19", "2026-09-25", "2026-10-09", "2026-10-10",
)
_MARGIN = 40  # days around the range, so that its ends find their neighbours


def trading_calendar(spark: SparkSession, start: date, end: date, holidays: Sequence[str] = HOLIDAYS_2026) -> DataFrame:
    """One row per date: d, is_trading_day, prev_td, curr_td (at or before), next_td. A century has 36,525 rows."""
    span = f"explode(sequence(date'{start}' - interval {_MARGIN} day, date'{end}' + interval {_MARGIN} day)) as d"
    days = spark.range(1).selectExpr(span)
    open_ = (F.weekday("d") < 5) & ~F.date_format("d", "yyyy-MM-dd").isin(*holidays) if holidays else F.weekday("d") < 5
    days = days.withColumn("is_trading_day", open_)
    traded = F.when(F.col("is_trading_day"), F.col("d"))
    order, back = Window.orderBy("d"), Window.orderBy(F.desc("d"))  # looking ahead goes backwards: a frame that only grows
    return (
        days.withColumn("prev_td", F.last(traded, True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("curr_td", F.last(traded, True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("next_td", F.last(traded, True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
        .filter(F.col("d").between(F.lit(start), F.lit(end)))
    )


def with_calendar(df: DataFrame, day: Column, calendar: DataFrame) -> DataFrame:
    """Left join of the calendar on a date; the calendar is a dimension of days, small by its nature."""
    keyed = df.withColumn("_day", day)
    return keyed.join(F.broadcast(calendar), keyed["_day"] == calendar["d"], "left").drop("_day", "d")


def at_time(day: Column, hour: int, minute: int) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour), mins=F.lit(minute))


def last_cutoff(df: DataFrame, now: str, calendar: DataFrame) -> DataFrame:
    """Adds ``cutoff``: 13:30 of a trading day that has passed it, else of the trading day before (15 days back at most, else today)."""
    today = F.col(now).cast("date")
    joined = with_calendar(df, today, calendar)
    close = at_time(today, 13, 30)
    before = F.when(F.datediff(today, F.col("prev_td")) <= 15, at_time(F.col("prev_td"), 13, 30)).otherwise(close)
    cutoff = F.when(F.col("is_trading_day") & (F.col(now) >= close), close).otherwise(before)
    return joined.withColumn("cutoff", cutoff).select(*df.columns, "cutoff")


def news_window(df: DataFrame, now: str, calendar: DataFrame) -> DataFrame:
    """Adds ``window_start`` (13:30 of the trading day before today, 10 days back at most) and ``window_end`` (now)."""
    today = F.col(now).cast("date")
    joined = with_calendar(df, today, calendar)
    start = F.when(F.datediff(today, F.col("prev_td")) <= 10, at_time(F.col("prev_td"), 13, 30)).otherwise(F.col(now) - F.make_dt_interval(days=F.lit(10)))
    return joined.withColumn("window_start", start).withColumn("window_end", F.col(now)).select(*df.columns, "window_start", "window_end")


def reflecting_session(df: DataFrame, announced: str, calendar: DataFrame) -> DataFrame:
    """Adds ``reflected_on``: the first 13:30 close at or after each announcement, found by an equi-join on its date."""
    joined = with_calendar(df, F.col(announced).cast("date"), calendar)
    close = at_time(F.col(announced).cast("date"), 13, 30)
    day = F.when(F.col("is_trading_day") & (F.col(announced) <= close), F.col(announced).cast("date")).otherwise(F.col("next_td"))
    return joined.withColumn("reflected_on", day).select(*df.columns, "reflected_on")


def market_status(df: DataFrame, now: str, calendar: DataFrame) -> DataFrame:
    """adds status (open, closed, holiday), next_open and countdown ("1d 02h 03m", null while open)."""
    at, today = F.col(now), F.col(now).cast("date")
    joined = with_calendar(df, today, calendar)
    opens, closes = at_time(today, 9, 0), at_time(today, 13, 30)
    trading = F.col("is_trading_day")
    status = F.when(~trading, "holiday").when((at >= opens) & (at <= closes), "open").otherwise("closed")
    following = F.when(trading & (at < opens), opens).otherwise(at_time(F.col("next_td"), 9, 0))
    minutes = F.timestamp_diff("MINUTE", at, F.col("next_open"))
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat((F.floor(minutes / 1440)).cast("string"), F.lit("d "), pad(F.floor(minutes % 1440 / 60)), F.lit("h "), pad(minutes % 60), F.lit("m"))
    return joined.withColumn("status", status).withColumn("next_open", following).withColumn("countdown", F.when(F.col("status") != "open", text)).select(*df.columns, "status", "next_open", "countdown")


def date_alignment(df: DataFrame, today: str, applies_to: str, calendar: DataFrame, nearest_year: bool = True) -> DataFrame:
    """Adds alignment (ready, aligned_next, same_day, warning), diff_days and is_same_date.

    ``applies_to`` is "MM/DD" or an ISO date. A date without a year takes the
    year that brings it nearest to today, or always today's year if
    ``nearest_year`` is off. Nothing readable counts as ready.
    """
    text, now = F.col(applies_to), F.col(today)
    month, day = (F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})$", n).try_cast("int") for n in (1, 2))

    def in_year(shift: int) -> Column:
        return F.try_make_timestamp_ntz(F.year(now) + shift, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")

    year_less = in_year(0)
    if nearest_year:
        ways = [F.struct(F.abs(F.datediff(in_year(s), now)).alias("far"), in_year(s).alias("day")) for s in (0, -1, 1)]
        year_less = F.array_min(F.filter(F.array(*ways), lambda w: w["day"].isNotNull()))["day"]
    iso = F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), text).try_cast("date")
    joined = with_calendar(df.withColumn("_target", F.coalesce(year_less, iso)), F.col(today), calendar)
    target = F.col("_target")
    state = (
        F.when(target.isNull(), "ready").when(target == F.col("next_td"), "aligned_next")
        .when((target == now) | (target == F.col("curr_td")), "same_day").otherwise("warning")
    )
    same = F.coalesce((F.month(target) == F.month(now)) & (F.dayofmonth(target) == F.dayofmonth(now)), F.lit(False))
    return joined.withColumn("alignment", state).withColumn("diff_days", F.datediff(target, now)).withColumn("is_same_date", same).select(*df.columns, "alignment", "diff_days", "is_same_date")
