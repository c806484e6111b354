"""Queries of the trading calendar, of time rules, and of announcements.

An announcement is a row of ``orders``: the priority is its feed. Times of
``events`` count as Taipei wall-clock times.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import calendar, news
from .base import Tables, query

_HOLIDAYS = ("1996-12-25", "1997-01-01", "2000-02-28", "2024-01-01", "2024-01-15")
_SPAN = (date(1990, 1, 1), date(2030, 12, 31))

CALENDAR_SQL = f"""
days AS (SELECT t.d::DATE AS d FROM generate_series(DATE '1989-11-01', DATE '2031-02-28', INTERVAL 1 DAY) t(d)),
marked AS (SELECT d, isodow(d) < 6 AND strftime(d, '%Y-%m-%d') NOT IN {_HOLIDAYS} AS is_trading_day FROM days),
cal AS (SELECT d, is_trading_day,
  max(CASE WHEN is_trading_day THEN d END) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_td,
  max(CASE WHEN is_trading_day THEN d END) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS curr_td,
  min(CASE WHEN is_trading_day THEN d END) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_td FROM marked)
"""


def _calendar(t: Tables):
    return calendar.trading_calendar(t.spark, *_SPAN, _HOLIDAYS)


def _stamp(sql: str) -> str:
    return f"strftime({sql}, '%Y-%m-%d %H:%M:%S')"


def _day(sql: str) -> str:
    return f"strftime({sql}, '%Y-%m-%d')"


def close_of(sql: str) -> str:
    """13:30 of a date, in SQL."""
    return f"({sql}::TIMESTAMP + INTERVAL 810 MINUTE)"


@query(f"WITH {CALENDAR_SQL} SELECT o_orderkey, is_trading_day, {_day('prev_td')} AS prev_td, {_day('curr_td')} AS curr_td, {_day('next_td')} AS next_td FROM orders JOIN cal ON o_orderdate::DATE = d")
def C01_trading_calendar(t: Tables):
    orders = t.orders.select("o_orderkey", "o_orderdate")
    return calendar.with_calendar(orders, F.to_date("o_orderdate"), _calendar(t)).drop("o_orderdate")


@query(f"""SELECT event_id, {_day('CASE WHEN hour(ts) >= 15 THEN ts::DATE + (CASE isodow(ts) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::INTEGER ELSE ts::DATE END')} AS session_date,
{_day('CASE WHEN hour(ts) >= 15 THEN ts::DATE + (CASE isodow(ts) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::INTEGER ELSE ts::DATE + (CASE isodow(ts) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END)::INTEGER END')} AS joined FROM events""")
def C02_session_date(t: Tables):
    return t.events.select("event_id", dates.session_date(F.col("ts")).alias("session_date"), dates.session_date(F.col("ts"), join_weekend=True).alias("joined"))


_CUTOFF = f"CASE WHEN is_trading_day AND ts >= {close_of('ts::DATE')} THEN {close_of('ts::DATE')} ELSE {close_of('prev_td')} END"


@query(f"WITH {CALENDAR_SQL} SELECT event_id, {_stamp(_CUTOFF)} AS cutoff FROM events JOIN cal ON ts::DATE = d")
def C03_last_cutoff(t: Tables):
    return calendar.last_cutoff(t.events.select("event_id", "ts"), "ts", _calendar(t)).drop("ts")


@query(f"WITH {CALENDAR_SQL} SELECT event_id, {_stamp(close_of('prev_td'))} AS window_start, {_stamp('ts')} AS window_end FROM events JOIN cal ON ts::DATE = d")
def C04_news_window(t: Tables):
    return calendar.news_window(t.events.select("event_id", "ts"), "ts", _calendar(t)).drop("ts")


_REFLECTED = f"CASE WHEN is_trading_day AND ts <= {close_of('ts::DATE')} THEN ts::DATE ELSE next_td END"


@query(f"WITH {CALENDAR_SQL} SELECT event_id, {_day(_REFLECTED)} AS reflected_on FROM events JOIN cal ON ts::DATE = d")
def J11_reflecting_session(t: Tables):
    return calendar.reflecting_session(t.events.select("event_id", "ts"), "ts", _calendar(t)).drop("ts")


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-12 13:30:00' AND TIMESTAMP '2024-01-16 07:35:00'")
def P01_in_news_window(t: Tables):
    # the 15th is a holiday: the window of the 16th opens on Friday the 12th
    now = t.spark.range(1).select(F.lit("2024-01-16 07:35:00").cast("timestamp_ntz").alias("now"))
    window = calendar.news_window(now, "now", _calendar(t)).first()
    return news.in_news_window(t.events, "ts", F.lit(window.window_start), F.lit(window.window_end)).select("event_id")


_ANNOUNCED = "(o_orderdate + to_minutes(o_orderkey % 1440) + to_seconds(o_orderkey % 60))"


def _announcements(t: Tables):
    """Orders as announcements: dates in ROC years, times with seconds; some unreadable."""
    at = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"), secs=(F.col("o_orderkey") % 60).cast("decimal(18,6)"))
    day = F.concat(F.year(at) - 1911, F.date_format(at, "/MM/dd"))
    return t.orders.select(
        "o_orderkey", F.col("o_orderpriority").alias("feed"),
        F.when(F.col("o_orderkey") % 9 == 0, F.date_format(at, "MM/dd")).when(F.col("o_orderkey") % 9 == 1, "85/02/30").otherwise(day).alias("date"),
        F.when(F.col("o_orderkey") % 9 == 2, "").otherwise(F.date_format(at, "HH:mm:ss")).alias("time"),
    )


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 2 THEN {_stamp(_ANNOUNCED)} END AS announced_at FROM orders")
def F06_roc_timestamp(t: Tables):
    return news.with_announced_at(_announcements(t)).select("o_orderkey", "announced_at")


@query(f"SELECT o_orderkey FROM orders WHERE o_orderkey % 9 > 2 AND {_ANNOUNCED} > TIMESTAMP '1998-06-05 13:30:00'")
def P02_unreflected(t: Tables):
    now = t.spark.range(1).select(F.lit("1998-06-08 08:00:00").cast("timestamp_ntz").alias("now"))
    cutoff = calendar.last_cutoff(now, "now", _calendar(t)).first().cutoff
    return news.unreflected(news.with_announced_at(_announcements(t)), F.lit(cutoff)).select("o_orderkey")


@query(f"SELECT o_orderpriority AS feed, count(*) AS n FROM orders WHERE o_orderkey % 9 > 2 AND {_ANNOUNCED} > TIMESTAMP '1998-06-05 13:30:00' GROUP BY ROLLUP (o_orderpriority)")
def A05_unreflected_counts(t: Tables):
    rows = news.unreflected(news.with_announced_at(_announcements(t)), F.lit("1998-06-05 13:30:00").cast("timestamp_ntz"))
    return news.unreflected_counts(rows)


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'att' WHEN '2-HIGH' THEN 'fin' ELSE 'rev' END AS feed, CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END AS amount FROM orders")
def U03_union_feeds(t: Tables):
    orders = t.orders
    of = lambda p: orders.filter(F.col("o_orderpriority") == p)
    return news.union_feeds({
        "att": of("1-URGENT").select("o_orderkey"), "fin": of("2-HIGH").select("o_orderkey", F.col("o_totalprice").alias("amount")), "rev": orders.filter(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey"),
    }).select("o_orderkey", "feed", "amount")


@query(f"SELECT event_id, CASE WHEN event_id % 6 > 0 THEN {_stamp('ts + INTERVAL 8 HOUR')} END AS published FROM events")
def F07_parse_pubdate(t: Tables):
    written = F.when(F.col("event_id") % 6 == 0, "yesterday").otherwise(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    return t.events.select("event_id", dates.parse_pubdate(written).alias("published"))


_LOCAL = "date_trunc('minute', ts)"


@query(f"""WITH e AS (SELECT *, {_LOCAL} AS l, CASE event_id % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'JP' WHEN 2 THEN 'EU' WHEN 3 THEN 'GB' ELSE 'TW' END AS country FROM events),
o AS (SELECT *, l + to_hours(CASE country WHEN 'US' THEN -12 WHEN 'JP' THEN 1 WHEN 'EU' THEN -6 WHEN 'GB' THEN -7 ELSE 0 END) AS there FROM e)
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN strftime(l, '%Y-%m-%d') || 'T00:00:00Z' ELSE strftime(l - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS datetime_utc,
CASE WHEN event_id % 11 = 0 THEN '全天' ELSE strftime(l, '%H:%M') || ' TPE' END AS time_tpe_str,
CASE WHEN event_id % 11 = 0 THEN '全天' WHEN country = 'TW' THEN strftime(l, '%H:%M') || ' TPE'
 ELSE strftime(there, '%H:%M') || CASE WHEN country = 'US' AND there::DATE < l::DATE THEN '-1' ELSE '' END || ' ' || CASE country WHEN 'US' THEN 'ET' WHEN 'JP' THEN 'JST' WHEN 'EU' THEN 'CET' ELSE 'GMT' END END AS time_origin_str
FROM o""")
def F08_event_times(t: Tables):
    country = F.get(F.array(*[F.lit(c) for c in ("US", "JP", "EU", "GB", "TW")]), (F.col("event_id") % 5).cast("int"))
    time = F.when(F.col("event_id") % 11 > 0, F.date_format("ts", "HH:mm"))
    return t.events.select("event_id", dates.event_times(F.to_date("ts"), time, country).alias("x")).select("event_id", "x.*")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN user_id END AS days_left FROM events")
def F09_days_left(t: Tables):
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("約"), "user_id", F.lit("天/9"))).when(F.col("event_id") % 4 == 1, "出關").when(F.col("event_id") % 4 == 2, "")
    return t.events.select("event_id", dates.days_left(raw).alias("days_left"))


_NOW = "TIMESTAMP '2024-01-20 07:35:00'"
_HOURS = f"greatest(0.0, format('{{:.1f}}', date_diff('microsecond', ts, {_NOW}) / 3600000000.0::DOUBLE)::DOUBLE)"


@query(f"""SELECT event_id, h AS age, CASE WHEN h < 6 THEN 'fresh' WHEN h < 12 THEN 'aging' ELSE 'stale' END AS freshness, CASE WHEN h < 24 THEN 'fresh' WHEN h <= 36 THEN 'amber' ELSE 'danger' END AS tile,
format('{{:.1f}}', date_diff('microsecond', CASE WHEN ts::TIME < TIME '04:00:00' THEN ts::DATE - INTERVAL 20 HOUR ELSE ts::DATE + INTERVAL 4 HOUR END, ts) / 3600000000.0::DOUBLE)::DOUBLE AS since_us_close
FROM (SELECT *, {_HOURS} AS h FROM events)""")
def F13_age_hours(t: Tables):
    aged = t.events.select("event_id", "ts", dates.age_hours(F.lit("2024-01-20 07:35:00").cast("timestamp_ntz"), F.col("ts")).alias("age"))
    return aged.select("event_id", "age", dates.freshness(F.col("age")).alias("freshness"), dates.tile(F.col("age")).alias("tile"), dates.hours_since_us_close(F.col("ts")).alias("since_us_close"))


@query("""SELECT event_id, CASE WHEN abs(s) <= 900000000 THEN 'live' WHEN s > 0 AND s <= 7200000000 THEN 'countdown' WHEN s < -1800000000 THEN 'past' END AS status
FROM (SELECT event_id, date_diff('microsecond', ts::DATE + INTERVAL 12 HOUR, ts) AS s FROM events)""")
def F14_event_status(t: Tables):
    noon = calendar.at_time(F.to_date("ts"), 12, 0)
    return t.events.select("event_id", dates.event_status(noon, F.col("ts")).alias("status"))


@query(f"""WITH {CALENDAR_SQL},
s AS (SELECT event_id, ts, CASE WHEN NOT is_trading_day THEN 'holiday' WHEN ts::TIME BETWEEN TIME '09:00:00' AND TIME '13:30:00' THEN 'open' ELSE 'closed' END AS status,
  CASE WHEN is_trading_day AND ts::TIME < TIME '09:00:00' THEN ts::DATE + INTERVAL 9 HOUR ELSE next_td + INTERVAL 9 HOUR END AS next_open FROM events JOIN cal ON ts::DATE = d),
m AS (SELECT *, date_diff('microsecond', ts, next_open) // 60000000 AS minutes FROM s)
SELECT event_id, status, {_stamp('next_open')} AS next_open, CASE WHEN status <> 'open' THEN format('{{}}d {{:02d}}h {{:02d}}m', minutes // 1440, minutes % 1440 // 60, minutes % 60) END AS countdown FROM m""")
def F15_market_status(t: Tables):
    return calendar.market_status(t.events.select("event_id", "ts"), "ts", _calendar(t)).drop("ts")


@query("""SELECT o_orderkey, CASE WHEN d = DATE '1997-03-05' THEN 'today' WHEN d = DATE '1997-03-06' THEN 'tomorrow' WHEN d <= DATE '1997-03-09' THEN 'this_week' ELSE 'next_week' END AS relative,
['週一', '週二', '週三', '週四', '週五', '週六', '週日'][isodow(d)] AS weekday FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")
def F16_relative_day(t: Tables):
    day = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", dates.relative_day(day, F.lit(date(1997, 3, 5))).alias("relative"), dates.weekday_label(day).alias("weekday"))


@query(f"""WITH {CALENDAR_SQL},
o AS (SELECT o_orderkey, o_orderdate::DATE AS today, CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE o_orderdate::DATE + (o_orderkey % 7 - 3)::INTEGER END AS target FROM orders)
SELECT o_orderkey, CASE WHEN target IS NULL THEN 'ready' WHEN target = next_td THEN 'aligned_next' WHEN target = today OR target = curr_td THEN 'same_day' ELSE 'warning' END AS alignment,
target - today AS diff_days, coalesce(target = today, false) AS is_same_date FROM o JOIN cal ON today = d""")
def K05_date_alignment(t: Tables):
    today = F.to_date("o_orderdate")
    target = F.date_add(today, (F.col("o_orderkey") % 7 - 3).cast("int"))
    said = F.when(F.col("o_orderkey") % 4 == 0, "soon").when(F.col("o_orderkey") % 4 == 1, F.date_format(target, "MM/dd")).otherwise(F.date_format(target, "yyyy-MM-dd"))
    rows = t.orders.select("o_orderkey", today.alias("today"), said.alias("applies_to"))
    return calendar.date_alignment(rows, "today", "applies_to", _calendar(t)).drop("today", "applies_to")
