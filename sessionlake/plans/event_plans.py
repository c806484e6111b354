"""Queries of economic events and headlines.

Events of the calendar are rows of ``events`` (title from type and id) or of
``orders``; headlines are ``documents`` with a time made from their id.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import events, news, recurrence
from ..operators.numbering import number_rows
from .base import Tables, query

_TODAY = date(2024, 1, 10)


def _events(t: Tables):
    return t.events.select(
        "event_id", F.to_date("ts").alias("date"), F.when(F.col("event_id") % 5 > 0, F.date_format("ts", "HH:mm")).alias("time"),
        F.concat("event_type", F.lit(" "), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("title"), (F.col("user_id") % 3 + 1).alias("importance"),
        F.when(F.col("user_id") % 2 == 0, "US").otherwise("TW").alias("country"), F.col("event_type").alias("category"),
    )


_EVENTS = """e AS (SELECT event_id, ts::DATE AS date, CASE WHEN event_id % 5 > 0 THEN strftime(ts, '%H:%M') END AS time, event_type || ' ' || lpad(event_id::VARCHAR, 9, '0') AS title,
user_id % 3 + 1 AS importance, CASE WHEN user_id % 2 = 0 THEN 'US' ELSE 'TW' END AS country, event_type AS category FROM events)"""


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN DATE '1997-03-05' AND DATE '1997-03-19' AND o_orderkey % 6 > 0")
def P03_in_date_range(t: Tables):
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderkey") % 6 > 0, F.col("o_orderpriority")).otherwise("  ").alias("summary"))
    return events.in_date_range(rows, F.lit(date(1997, 3, 5))).select("o_orderkey")


@query(f"WITH {_EVENTS} SELECT strftime(date, '%Y-%m-%d') AS date, count(*) AS n FROM e WHERE importance = 3 AND country = 'US' AND category IN ('view', 'click') AND date BETWEEN DATE '2024-01-10' AND DATE '2024-01-14' AND contains(lower(title), 'i') GROUP BY 1")
def P05_filter_events(t: Tables):
    kept = events.filter_events(_events(t), F.lit(_TODAY), quick=("star3", "this_week"), countries=("US",), categories=("view", "click"), search="I")
    return kept.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EVENTS} SELECT event_id, row_number() OVER (ORDER BY date, coalesce(time, ''), title) - 1 AS place FROM e")
def T02_sort_events(t: Tables):
    return number_rows(_events(t), *events.event_order(), name="place").select("event_id", "place")


def _listed():
    return F.array_join(F.transform("events", lambda e: F.concat(F.coalesce(e["time"], F.lit("-")), F.lit(" "), e["title"])), ";")


@query(f"""WITH {_EVENTS} SELECT strftime(date, '%Y-%m-%d') AS date, CASE WHEN date = DATE '2024-01-10' THEN 'today' WHEN date = DATE '2024-01-11' THEN 'tomorrow' WHEN date <= DATE '2024-01-14' THEN 'this_week' ELSE 'next_week' END AS relative,
date = DATE '2024-01-10' AS is_today, string_agg(coalesce(time, '-') || ' ' || title, ';' ORDER BY coalesce(time, ''), title) AS listed FROM e GROUP BY date""")
def A07_agenda(t: Tables):
    return events.agenda(_events(t), F.lit(_TODAY)).select("date", "relative", "is_today", _listed().alias("listed"))


@query(f"""WITH {_EVENTS}, n AS (SELECT *, (row_number() OVER (PARTITION BY date ORDER BY coalesce(time, ''), title) - 1) // 50 AS segment FROM e)
SELECT strftime(date, '%Y-%m-%d') AS date, segment, date = DATE '2024-01-10' AS is_today, string_agg(coalesce(time, '-') || ' ' || title, ';' ORDER BY coalesce(time, ''), title) AS listed FROM n GROUP BY date, segment""")
def A07_agenda_segments(t: Tables):
    return events.agenda_segments(_events(t), F.lit(_TODAY), most=50).select("date", "segment", "is_today", _listed().alias("listed"))


@query("""WITH r AS (SELECT DISTINCT ts::DATE AS today, ts::DATE + 14 AS range_end FROM events),
d AS (SELECT today, range_end, today - isodow(today)::INTEGER % 7 AS start, unnest(generate_series(today - isodow(today)::INTEGER % 7, range_end + 6 - isodow(range_end)::INTEGER % 7, INTERVAL 1 DAY))::DATE AS date FROM r),
c AS (SELECT ts::DATE AS date, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(today, '%Y-%m-%d') AS today, strftime(range_end, '%Y-%m-%d') AS range_end, (date - start) // 7 AS week, (date - start) % 7 AS weekday, strftime(date, '%Y-%m-%d') AS date, day(date) AS day,
CASE WHEN day(date) = 1 OR date = start THEN month(date) || '/' || day(date) END AS month_label, date = today AS is_today, date BETWEEN today AND range_end AS in_range,
CASE WHEN date BETWEEN today AND range_end THEN coalesce(n, 0) ELSE 0 END AS n_events FROM d LEFT JOIN c USING (date)""")
def A08_calendar_grid(t: Tables):
    days = t.events.select(F.to_date("ts").alias("date"))
    ranges = days.distinct().select(F.col("date").alias("today"), F.date_add("date", 14).alias("range_end"))
    return events.calendar_grid(days, ranges)


@query(f"WITH {_EVENTS} SELECT event_id, 'ev-' || strftime(date, '%Y-%m-%d') || '-' || row_number() OVER (ORDER BY date, coalesce(time, ''), title) AS event_no FROM e")
def W04_number_events(t: Tables):
    return events.number_events(_events(t)).select("event_id", "event_no")


@query("""WITH o AS (SELECT o_orderkey, date_trunc('month', o_orderdate) + to_days((least(day(o_orderdate), 28) - 1)::INTEGER) + INTERVAL 9 HOUR AS s, (o_orderkey % 3 + 1)::INTEGER AS step, CASE o_orderkey % 5 WHEN 0 THEN 'DAILY' WHEN 1 THEN 'WEEKLY' WHEN 2 THEN 'MONTHLY' WHEN 3 THEN 'YEARLY' END AS f FROM orders),
i AS (SELECT o.*, unnest(range(CASE WHEN f IS NULL THEN 1 WHEN f = 'YEARLY' THEN 9 WHEN f = 'MONTHLY' THEN 100 ELSE CASE WHEN o_orderkey % 2 = 0 THEN 40 ELSE 3000 END END)) AS n FROM o),
x AS (SELECT *, CASE f WHEN 'DAILY' THEN s + to_days((n * step)::INTEGER) WHEN 'WEEKLY' THEN s + to_days((n * step * 7)::INTEGER) WHEN 'MONTHLY' THEN s + to_months((n * step)::INTEGER) WHEN 'YEARLY' THEN s + to_months((n * step * 12)::INTEGER) ELSE s END AS occurs FROM i)
SELECT o_orderkey, strftime(occurs, '%Y-%m-%d %H:%M:%S') AS occurs FROM x WHERE occurs >= DATE '1997-03-01' AND occurs < DATE '1997-05-01'""")
def R03_expand_recurrence(t: Tables):
    kind = F.get(F.array(*[F.lit(x) for x in ("DAILY", "WEEKLY", "MONTHLY", "YEARLY")]), (F.col("o_orderkey") % 5).cast("int"))
    limited = (F.col("o_orderkey") % 2 == 0) & kind.isin("DAILY", "WEEKLY")
    rule = F.concat(F.lit("FREQ="), kind, F.lit(";INTERVAL="), F.col("o_orderkey") % 3 + 1, F.when(limited, ";COUNT=40").otherwise(""))
    # from the 29th on, months differ in what they have; the general form has those
    start = F.date_add(F.trunc("o_orderdate", "month"), F.least(F.dayofmonth("o_orderdate"), F.lit(28)) - 1).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(9))
    rows = t.orders.select("o_orderkey", start.alias("dtstart"), rule.alias("rrule"))
    return recurrence.expand_recurrence(rows, "1997-03-01", "1997-04-30").select("o_orderkey", "occurs")


@query("""WITH d AS (SELECT o_orderkey, o_orderdate + INTERVAL 9 HOUR AS s FROM orders),
x AS (SELECT o_orderkey, s, unnest(generate_series(TIMESTAMP '1997-03-01', TIMESTAMP '1997-03-31', INTERVAL 1 DAY)) AS day FROM d),
y AS (SELECT o_orderkey, s, day, day + (s - date_trunc('day', s)) AS occurs FROM x)
SELECT o_orderkey, strftime(occurs, '%Y-%m-%d %H:%M:%S') AS occurs FROM y WHERE occurs >= s AND CASE WHEN o_orderkey % 2 = 0 THEN isodow(day) IN (1, 4) ELSE day::DATE = last_day(day::DATE) END""")
def R03_expand_recurrence_general(t: Tables):
    """Rules beyond plain sequences: weekdays, and month ends that short months lack."""
    rule = F.when(F.col("o_orderkey") % 2 == 0, "FREQ=WEEKLY;BYDAY=MO,TH").otherwise("FREQ=MONTHLY;BYMONTHDAY=-1")
    rows = t.orders.select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(9))).alias("dtstart"), rule.alias("rrule"))
    return recurrence.expand_recurrence(rows, "1997-03-01", "1997-03-31").select("o_orderkey", "occurs")


@query("""WITH d AS (SELECT o_orderkey, o_orderkey % 6 AS kind, o_orderdate + INTERVAL 9 HOUR AS s FROM orders),
x AS (SELECT o_orderkey, kind, s, unnest(CASE WHEN kind = 5 THEN generate_series(s::DATE, (s + INTERVAL 60 DAY)::DATE, INTERVAL 1 DAY) ELSE generate_series(DATE '1997-03-01', DATE '1997-06-30', INTERVAL 1 DAY) END) AS day FROM d),
y AS (SELECT *, last_day(day::DATE) AS month_end, (year(day) - year(s)) * 12 + month(day) - month(s) AS months FROM x),
z AS (SELECT *, CASE kind
  WHEN 0 THEN isodow(day) IN (1, 4) AND (datediff('day', date_trunc('week', s), date_trunc('week', day)) // 7) % 2 = 0
  WHEN 1 THEN isodow(day) = 5 AND datediff('day', day::DATE, month_end) < 7
  WHEN 2 THEN isodow(day) < 6 AND datediff('day', day::DATE, month_end) < CASE isodow(month_end) WHEN 6 THEN 2 WHEN 7 THEN 3 ELSE 1 END AND (day::DATE = month_end OR isodow(day) = 5)
  WHEN 3 THEN month(day) IN (3, 6) AND day(day) = 15
  WHEN 4 THEN months % 2 = 0 AND (day(day) = 1 OR day::DATE = month_end)
  ELSE isodow(day) > 5 END AS hit FROM y WHERE day::DATE >= s::DATE),
n AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY day) AS place FROM z WHERE hit)
SELECT o_orderkey, strftime(day + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS occurs FROM n WHERE day BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-06-30' AND (kind < 5 OR place <= 10)""")
def R03_expand_recurrence_days(t: Tables):
    """Rules that pick days: weekdays, numbered and last ones, set positions, months, and a count from the start on."""
    rules = (
        "FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,TH", "FREQ=MONTHLY;BYDAY=-1FR", "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1", "FREQ=YEARLY;BYMONTH=3,6;BYMONTHDAY=15",
        "FREQ=MONTHLY;INTERVAL=2;BYMONTHDAY=1,-1", "FREQ=DAILY;BYDAY=SA,SU;COUNT=10",
    )
    rule = F.get(F.array(*[F.lit(r) for r in rules]), (F.col("o_orderkey") % len(rules)).cast("int"))
    rows = t.orders.select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(9))).cast("timestamp_ntz").alias("dtstart"), rule.alias("rrule"))
    return recurrence.expand_recurrence(rows, "1997-03-01", "1997-06-30").select("o_orderkey", "occurs")


@query("""WITH d AS (SELECT o_orderkey, 60 * (o_orderkey % 9 + 7) AS step, epoch(o_orderdate)::BIGINT AS s, epoch(TIMESTAMP '1997-03-10')::BIGINT AS low FROM orders),
i AS (SELECT o_orderkey, step, s, greatest(0, (low - s + step - 1) // step) AS f, (low + 86399 - s) // step AS l FROM d WHERE s <= low + 86399)
SELECT o_orderkey, (l - f + 1)::BIGINT AS n, strftime(make_timestamp((s + f * step) * 1000000), '%Y-%m-%d %H:%M:%S') AS first, strftime(make_timestamp((s + l * step) * 1000000), '%Y-%m-%d %H:%M:%S') AS last FROM i WHERE l >= f""")
def R03_expand_recurrence_dense(t: Tables):
    """Every few minutes for years, counted over one day."""
    rule = F.concat(F.lit("FREQ=MINUTELY;INTERVAL="), F.col("o_orderkey") % 9 + 7)
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("dtstart"), rule.alias("rrule"))
    made = recurrence.expand_recurrence(rows, "1997-03-10", "1997-03-10")
    return made.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("occurs").alias("first"), F.max("occurs").alias("last"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS ny, i, o_orderdate + INTERVAL 9 HOUR + to_days(i::INTEGER) AS wall FROM orders, range(20) r(i)),
m AS (SELECT *, CASE WHEN i % 5 = 4 THEN wall + INTERVAL 3 HOUR ELSE wall END AS own, i % 5 = 4 AS moved FROM o WHERE i % 3 <> 2 OR i % 5 = 4),
l AS (SELECT o_orderkey, moved, CASE WHEN ny THEN timezone('Asia/Taipei', timezone('America/New_York', own)) ELSE own END AS occurs FROM m
UNION ALL SELECT o_orderkey, false, o_orderdate + INTERVAL 30 DAY + INTERVAL 20 HOUR FROM orders)
SELECT o_orderkey, moved, strftime(occurs, '%Y-%m-%d %H:%M:%S') AS occurs FROM l WHERE occurs >= TIMESTAMP '1997-03-20' AND occurs < TIMESTAMP '1997-05-01'""")
def R03_expand_calendar(t: Tables):
    """Every order a series of twenty days in its zone: every third day excluded, every fifth moved by three hours, one day added."""
    zone, clock = F.when(F.col("o_orderkey") % 2 == 0, "America/New_York"), (F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(9))).cast("timestamp_ntz")
    day = lambda i: F.make_dt_interval(days=i.cast("int"))
    base = t.orders.select("o_orderkey", F.col("o_orderkey").cast("string").alias("uid"), zone.alias("zone"), clock.alias("starts"), "o_orderdate")
    there = lambda stamp: dates.in_local_time(stamp, F.col("zone"))
    series = base.select(
        "o_orderkey", "uid", "zone", "starts", F.lit("FREQ=DAILY;COUNT=20").alias("rrule"), F.transform(F.sequence(F.lit(2), F.lit(19), F.lit(3)), lambda i: there(F.col("starts") + day(i))).alias("exdates"),
        F.array((F.col("o_orderdate") + F.make_dt_interval(days=F.lit(30), hours=F.lit(20))).cast("timestamp_ntz")).alias("rdates"), F.lit(None).cast("timestamp_ntz").alias("recurrence_id"),
    )
    moved = base.withColumn("i", F.explode(F.sequence(F.lit(4), F.lit(19), F.lit(5)))).select(
        "o_orderkey", "uid", "zone", (F.col("starts") + day(F.col("i")) + F.make_dt_interval(hours=F.lit(3))).alias("starts"), F.lit(None).cast("string").alias("rrule"),
        F.lit(None).cast("array<timestamp_ntz>").alias("exdates"), F.lit(None).cast("array<timestamp_ntz>").alias("rdates"), there(F.col("starts") + day(F.col("i"))).alias("recurrence_id"),
    )
    made = recurrence.expand_calendar(series.unionByName(moved), "1997-03-20", "1997-04-30")
    return made.select("o_orderkey", F.col("recurrence_id").isNotNull().alias("moved"), "occurs")


@query("""WITH e AS (SELECT *, event_id % 5 = 0 AS d, event_id % 2 = 0 AS us, date_trunc('minute', ts) AS m, '市場預期: ' || value || '%' || chr(10) || '前值: 1%' AS body FROM events)
SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M') AS time, d AS all_day, CASE WHEN us THEN '美國 GDP ' ELSE '日本 CPI ' END || event_id AS title, body AS description, body AS note,
'https://example.com/' || event_id AS source_url, 'macro' AS category, '總經' AS category_name, CASE WHEN us THEN 'US' ELSE 'JP' END AS country, CASE WHEN us THEN '🇺🇸' ELSE '🇯🇵' END AS flag,
CASE WHEN us THEN 'America/New_York' ELSE 'Asia/Tokyo' END AS timezone, CASE WHEN us THEN 'ET' ELSE 'JST' END AS label,
CASE WHEN d THEN strftime(ts, '%Y-%m-%dT00:00:00Z') ELSE strftime(m - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS datetime_utc, CASE WHEN d THEN '全天' ELSE strftime(m, '%H:%M TPE') END AS time_tpe_str,
CASE WHEN d THEN '全天' WHEN us THEN strftime(m - INTERVAL 12 HOUR, '%H:%M') || CASE WHEN (m - INTERVAL 12 HOUR)::DATE < m::DATE THEN '-1' ELSE '' END || ' ET' ELSE strftime(m + INTERVAL 1 HOUR, '%H:%M JST') END AS time_origin_str,
3 AS importance, value || '%' AS forecast, '1%' AS previous, NULL AS actual, 'pending' AS comparison FROM e""", importance="BIGINT", actual="VARCHAR")
def E01_classify_events(t: Tables):
    """The whole event record, from calendar rows made of ``events``."""
    rows = t.events.select(
        F.to_date("ts").alias("date"), F.date_format("ts", "HH:mm").alias("time"), (F.col("event_id") % 5 == 0).alias("all_day"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "美国 GDP ").otherwise("日本 CPI "), "event_id").alias("summary"), F.concat(F.lit("市场预期: "), "value", F.lit("%\n前值: 1%\nMM图表连结: https://example.com/"), "event_id").alias("description"),
    )
    return events.classify_events(rows)


_RULES = ((3, ("THE", "ELLE", "CIÓN")), (2, ("TION", "MENT")), (2, ("ERB", "OUA")))
_SCORED = """h AS (SELECT doc_id AS pos, source, TIMESTAMP '2024-01-01 00:00:00' + to_minutes((doc_id * 7) % 100) AS published,
3 * (contains(u, 'THE')::INTEGER + contains(u, 'ELLE')::INTEGER + contains(u, 'CIÓN')::INTEGER) + 2 * (contains(u, 'TION')::INTEGER + contains(u, 'MENT')::INTEGER) + 2 * (contains(u, 'ERB')::INTEGER + contains(u, 'OUA')::INTEGER) AS score
FROM (SELECT doc_id, source, upper(text) AS u FROM documents))"""


def _headlines(t: Tables):
    published = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("doc_id") * 7 % 100).cast("int"))
    return t.documents.select(F.col("doc_id").alias("pos"), "source", published.alias("published"), text.keyword_score(F.col("text"), _RULES).alias("score"))


@query(f"WITH {_SCORED} SELECT pos, score, strftime(published, '%Y-%m-%d %H:%M:%S') AS published FROM h ORDER BY score DESC, published DESC, pos LIMIT 5", score="BIGINT")
def T01_top_news(t: Tables):
    return news.top_news(_headlines(t)).select("pos", "score", "published")


@query(f"WITH {_SCORED} SELECT source, pos, score FROM h QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, published DESC, pos) <= 5", score="BIGINT")
def T01_top_news_by_source(t: Tables):
    return news.top_news(_headlines(t), by=["source"]).select("source", "pos", "score")


@query("SELECT source, min(doc_id) AS pos FROM documents WHERE contains(text, 'the') AND NOT contains(text, 'elle') AND lang <> 'de' GROUP BY source")
def P07_latest_article(t: Tables):
    rows = t.documents.select("source", F.col("doc_id").alias("pos"), F.col("text").alias("title"), F.when(F.col("lang") != "de", "/a").otherwise("").alias("link"))
    return news.latest_article(rows, by=["source"], wanted="the", unwanted="elle").select("source", "pos")
