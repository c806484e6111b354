"""Queries of sources and sinks, of sessions from ticks, and of the session stream.

A tick is a row of ``events``: value is the price, event_type the symbol.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import session_date
from ..functions.html import embedded_json
from ..operators import sessions
from ..operators.numbering import number_rows
from ..scratch import new_path
from ..sources import documents, snapshots
from ..streaming import sessions as stream
from .base import Tables, query

SESSION = "(CASE WHEN hour(ts) >= 15 THEN ts::DATE + (CASE isodow(ts) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::INTEGER ELSE ts::DATE END)"
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _lines(t: Tables):
    """Events as snapshot records in text."""
    fields = F.struct(
        F.lit("feed").alias("provider"), F.date_format("ts", _STAMP).alias("collected_at"), F.col("event_type").alias("symbol"),
        F.col("value").alias("price"), F.col("user_id").alias("volume"),
    )
    return t.events.select("event_id", F.to_json(fields).alias("value"))


@query("SELECT event_type AS symbol, value AS price, user_id AS volume, strftime(ts, '%Y-%m-%d %H:%M:%S') AS collected_at FROM events")
def S01_read_snapshots(t: Tables):
    path = new_path(t.spark, "ticks")
    good = _lines(t).select("value")
    bad = t.events.filter("event_id % 10 = 0").select(F.when(F.col("event_id") % 20 == 0, "").otherwise('{"price": ').alias("value"))
    good.unionByName(bad).write.text(path)
    return snapshots.read_snapshots(t.spark, path).select("symbol", "price", "volume", "collected_at")


@query(f"SELECT strftime({SESSION}, '%Y-%m-%d') AS session_date, event_type AS symbol, count(*) AS n, max(value) AS high FROM events GROUP BY 1, 2")
def S02_append_snapshots(t: Tables):
    path = new_path(t.spark, "sessions")
    ticks = t.events.select("event_id", F.col("ts").alias("collected_at"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), session_date(F.col("ts")).alias("session_date"))
    for half in (0, 1):
        snapshots.append_snapshots(ticks.filter(F.col("event_id") % 2 == half).drop("event_id"), path)
    back = snapshots.read_snapshots(t.spark, path, f"{snapshots.SNAPSHOT}, session_date date")
    return back.groupBy("session_date", "symbol").agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("high"))


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer")
def S03_read_documents(t: Tables):
    path = new_path(t.spark, "documents")
    row = F.struct("c_nationkey", "c_custkey", "c_acctbal")
    # documents of bounded size: a nation's customers in parts
    per_nation = t.customer.groupBy("c_nationkey", (F.col("c_custkey") % 4).alias("part")).agg(F.to_json(F.collect_list(row)).alias("value")).select("value")
    invalid = t.region.select(F.when(F.col("r_regionkey") % 2 == 0, "").otherwise("[{").alias("value"))
    per_nation.unionByName(invalid).coalesce(4).write.option("maxRecordsPerFile", 1).text(path)
    return documents.read_documents(t.spark, path, "c_nationkey int, c_custkey long, c_acctbal double")


@query("SELECT 'order ' || o_orderkey AS title, 'https://example.com/' || o_orderkey AS link, strftime(o_orderdate, '%d %b %Y') AS day, o_orderpriority AS source FROM orders")
def S04_read_feed(t: Tables):
    path = new_path(t.spark, "feed")
    items = t.orders.select(
        F.concat(F.lit("order "), "o_orderkey").alias("title"), F.concat(F.lit("https://example.com/"), "o_orderkey").alias("link"),
        F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("pubDate"),
        F.struct(F.col("o_orderpriority").alias("_VALUE"), F.lit("https://example.com").alias("_url")).alias("source"),
    )
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return documents.read_feed(t.spark, path).select("title", "link", F.substring("pubDate", 6, 11).alias("day"), "source")


@query("SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS dtstart, false AS all_day, event_type || ', no ' || event_id AS summary, props AS description, 'FREQ=DAILY' AS rrule FROM events")
def S05_read_ics(t: Tables):
    fold = F.concat(F.lit("SUMMARY;LANGUAGE=en:"), "event_type", F.lit("\\, \r\n no "), "event_id")
    lines = F.concat(
        F.lit("BEGIN:VEVENT\r\nDTSTART:"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.lit("\r\n"), fold, F.lit("\r\nDESCRIPTION:"),
        F.replace("props", F.lit(","), F.lit("\\,")), F.lit("\r\nRRULE:FREQ=DAILY\r\nEND:VEVENT\r\n"),
    )
    # calendars, many to a file
    path = new_path(t.spark, "calendars")
    t.events.select(lines.alias("value"), "event_id").repartition("event_id").select("value").write.option("lineSep", "\r\n").text(path)
    return documents.read_ics(t.spark, path).select("dtstart", "all_day", "summary", "description", "rrule")


@query("""WITH e AS (SELECT event_id, props, date_trunc('day', ts) + to_months((event_id % 12)::INTEGER) + to_hours((5 + event_id % 18)::INTEGER) AS wall, event_id % 4 AS kind FROM events)
SELECT 'e-' || event_id AS uid, strftime(CASE kind WHEN 0 THEN timezone('Asia/Taipei', timezone('America/New_York', wall)) WHEN 1 THEN timezone('Asia/Taipei', timezone('Europe/Berlin', wall))
WHEN 2 THEN timezone('Asia/Taipei', timezone('UTC', wall)) ELSE wall END, '%Y-%m-%d %H:%M:%S') AS dtstart, strftime(wall, '%Y-%m-%d %H:%M:%S') AS starts,
CASE kind WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Europe/Berlin' WHEN 2 THEN 'UTC' END AS zone, false AS all_day, 'no ' || event_id AS summary, CASE WHEN event_id % 3 = 0 THEN props END AS description,
strftime(CASE kind WHEN 0 THEN timezone('Asia/Taipei', timezone('America/New_York', wall + INTERVAL 7 DAY)) WHEN 1 THEN timezone('Asia/Taipei', timezone('Europe/Berlin', wall + INTERVAL 7 DAY))
WHEN 2 THEN timezone('Asia/Taipei', timezone('UTC', wall + INTERVAL 7 DAY)) ELSE wall + INTERVAL 7 DAY END, '%Y-%m-%d %H:%M:%S') AS excluded FROM e""")
def S05_read_ics_zones(t: Tables):
    """Events on the clocks of four zones, through all months, each with an alarm inside that has a text and a time of its own."""
    kind = F.col("event_id") % 4
    wall = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_ym_interval(months=(F.col("event_id") % 12).cast("int")) + F.make_dt_interval(hours=(5 + F.col("event_id") % 18).cast("int"))
    zone = F.when(kind == 0, ";TZID=America/New_York").when(kind == 1, ";X-SOURCE=\"a:b\";TZID=\"W. Europe Standard Time\"").otherwise("")
    stamp = lambda at: F.concat(zone, F.lit(":"), F.date_format(at, "yyyyMMdd'T'HHmmss"), F.when(kind == 2, "Z").otherwise(""), F.lit("\r\n"))
    alarm = F.concat(F.lit("BEGIN:VALARM\r\nTRIGGER:-PT15M\r\nDTSTART:20010101T000000Z\r\nSUMMARY:soon\r\nDESCRIPTION:an alarm's own text\r\nUID:alarm\r\nEND:VALARM\r\n"))
    lines = F.concat(
        F.lit("BEGIN:VEVENT\r\n"), F.when(F.col("event_id") % 2 == 0, alarm).otherwise(""), F.lit("UID:e-"), "event_id", F.lit("\r\nDTSTART"), stamp(wall), F.lit("SUMMARY:no "), "event_id", F.lit("\r\n"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("DESCRIPTION:"), F.replace("props", F.lit(","), F.lit("\\,")), F.lit("\r\n"))).otherwise(""),
        F.lit("EXDATE"), stamp(wall + F.make_dt_interval(days=F.lit(7))), alarm, F.lit("END:VEVENT\r\n"),
    )
    path = new_path(t.spark, "zoned-calendars")
    t.events.select(lines.alias("value"), "event_id").repartition("event_id").select("value").write.option("lineSep", "\r\n").text(path)
    return documents.read_ics(t.spark, path).select("uid", "dtstart", "starts", "zone", "all_day", "summary", "description", F.get("exdates", F.lit(0)).alias("excluded"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source END AS title, CASE WHEN doc_id % 3 > 0 THEN 'https://example.com/' || doc_id END AS url,
length(text) AS body_chars, md5(text) AS body_md5 FROM documents""")
def S06_parse_article(t: Tables):
    head = F.concat(F.lit("Title: "), "source", F.lit("\nURL: https://example.com/"), "doc_id", F.lit("\n---\n"))
    article = documents.parse_article(F.concat(F.when(F.col("doc_id") % 3 > 0, head).otherwise(""), "text"))
    return t.documents.select("doc_id", article.alias("a")).select("doc_id", "a.title", "a.url", F.length("a.body").alias("body_chars"), F.md5("a.body").alias("body_md5"))


@query("SELECT page_id, length(html) AS html_chars, md5(html) AS html_md5 FROM pages")
def S07_read_pages(t: Tables):
    """Pages as files, a page each; its number stands in front of it."""
    path = new_path(t.spark, "pages")
    t.pages.select(F.concat(F.col("page_id").cast("string"), F.lit("|"), "html").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\u001e").text(path)
    read = documents.read_pages(t.spark, path).withColumn("html", F.regexp_replace("html", "\u001e$", ""))  # the writer ends a record with its separator
    page = F.substr(F.col("html"), F.position(F.lit("|"), F.col("html")) + 1)
    return read.select(F.substring_index("html", "|", 1).cast("long").alias("page_id"), F.length(page).alias("html_chars"), F.md5(page).alias("html_md5"))


@query("SELECT event_id, 'E' || user_id AS code, (props->>'k')::BIGINT AS k FROM events WHERE event_id % 5 < 3")
def S08_embedded_json(t: Tables):
    body = F.concat(F.lit('{"E'), "user_id", F.lit('": '), "props", F.lit("}"))
    # a fifth of the pages lack the script, a fifth hold invalid JSON
    body = F.when(F.col("event_id") % 5 == 3, "{oops").otherwise(body)
    name = F.when(F.col("event_id") % 5 == 4, "other").otherwise("all-broker-data")
    html = F.concat(F.lit('<p>x</p><script id="'), name, F.lit('" type="application/json">'), body, F.lit("</script>"))
    found = t.events.select("event_id", embedded_json(html, "all-broker-data", "struct<k: bigint>").alias("m"))
    return found.select("event_id", F.explode("m").alias("code", "v")).select("event_id", "code", "v.k")


@query("SELECT count(*) AS row_count, min(strftime(o_orderdate, '%Y-%m')) AS first, max(strftime(o_orderdate, '%Y-%m')) AS last FROM orders")
def S09_write_outputs(t: Tables):
    path = new_path(t.spark, "outputs")
    documents.write_outputs(t.orders.withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), path, by="month")
    return documents.read_documents(t.spark, f"{path}/build", "row_count long, first string, last string")


def _ticks(t: Tables):
    return t.events.select(
        F.col("event_id").alias("tick_id"), "ts", F.col("ts").alias("collected_at"), F.col("event_type").alias("symbol"), F.col("value").alias("price"),
        F.col("user_id").alias("volume"), session_date(F.col("ts")).alias("session_date"), F.lit("feed").alias("provider"),
        F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("open"), F.when(F.col("event_id") % 4 > 0, F.col("value") - 1).alias("prev_close"),
        (F.col("value") + 1).alias("high"), (F.col("value") - 2).alias("low"),
    )


@query(f"""SELECT event_type AS symbol, strftime({SESSION}, '%Y-%m-%d') AS session_date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
last(value ORDER BY ts, event_id) AS close, sum(user_id)::BIGINT AS volume FROM events GROUP BY 1, 2""")
def A01_ohlcv(t: Tables):
    return sessions.ohlcv(_ticks(t), ["symbol", "session_date"])


_ASSEMBLED = f"""
SELECT event_type AS symbol, strftime({SESSION}, '%Y-%m-%d') AS session_date,
       first(CASE WHEN event_id % 3 > 0 THEN value END ORDER BY ts, event_id) AS open,
       first(CASE WHEN event_id % 4 > 0 THEN value - 1 END ORDER BY ts, event_id) AS prev_close,
       max(value + 1) AS high, min(value - 2) AS low, last(value ORDER BY ts, event_id) AS price, count(*) AS n_points
FROM events GROUP BY 1, 2
"""


@query(f"""WITH s AS ({_ASSEMBLED})
SELECT symbol, session_date, coalesce(open, 1.5) AS open, coalesce(prev_close, 2.5) AS prev_close, greatest(high, 3.5) AS high, least(low, 0.5) AS low, price, n_points FROM s""")
def A02_assemble_session(t: Tables):
    points = _ticks(t)
    live = points.select("symbol", "session_date").distinct().select("*", F.lit(1.5).alias("open"), F.lit(2.5).alias("prev_close"), F.lit(3.5).alias("high"), F.lit(0.5).alias("low"), F.lit(9.5).alias("price"), F.lit("live").alias("provider"))
    return sessions.assemble_session(points, live).select("symbol", "session_date", "open", "prev_close", "high", "low", "latest.price", "n_points")


_TICK_SCHEMA = "tick_id long, collected_at timestamp_ntz, symbol string, price double, provider string, open double, prev_close double, high double, low double"


def _streamed(t: Tables, ticks, label: str, files_per_trigger: int | None = None):
    """Sessions of ticks that come as files, through the stream and its table of current parts."""
    path = new_path(t.spark, f"{label}-in")
    ticks.write.parquet(path)
    parts = stream.session_parts(stream.read_ticks(t.spark, path, _TICK_SCHEMA, "parquet", files_per_trigger))
    table = stream.session_table(t.spark, new_path(t.spark, f"{label}-out"))
    stream.run_available(parts, new_path(t.spark, f"{label}-state"), table)
    whole = stream.merge_parts(table.read(parts.schema))
    return whole.select("symbol", F.to_date("session_ts").alias("session_date"), "open", "prev_close", "high", "low", "latest.price", "n_points")


@query(_ASSEMBLED)
def R01_stream_sessions(t: Tables):
    return _streamed(t, _ticks(t).select(*[c.split()[0] for c in _TICK_SCHEMA.split(", ")]), "stream")


@query(_ASSEMBLED)
def R02_late_ticks(t: Tables):
    """Ticks in random order over several batches, with the watermark on: late ones count as in the batch form."""
    ticks = _ticks(t).select(*[c.split()[0] for c in _TICK_SCHEMA.split(", ")]).withColumn("_order", F.xxhash64("tick_id"))
    return _streamed(t, ticks.repartition(6, "_order").drop("_order"), "late", files_per_trigger=2)


_SCALED = f"""
WITH e AS (SELECT event_type AS symbol, {SESSION} AS session_date, event_id AS tick_id, ts, CASE WHEN event_id % 11 > 0 THEN value END AS price, value - 1 AS prev_close FROM events),
w AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER s AS n, first_value(prev_close) OVER o AS fp, last_value(price) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lp,
  min(price) OVER s AS mn, max(price) OVER s AS mx
  FROM e WINDOW s AS (PARTITION BY symbol, session_date), o AS (PARTITION BY symbol, session_date ORDER BY ts, tick_id)),
r AS (SELECT *, least(mn, nullif(fp, 0)) AS lo, greatest(mx, nullif(fp, 0)) AS hi FROM w),
p AS (SELECT *, CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END AS span FROM r),
x AS (SELECT symbol, session_date, tick_id, i, 28.0 + 624.0 * (i / greatest(n - 1, 1)) AS x,
  28.0 + 124.0 * (1 - (price - (lo - span * 0.08)) / ((hi + span * 0.08) - (lo - span * 0.08))) AS y, coalesce(lp, 0.0) >= coalesce(fp, 0.0) AS is_rise
  FROM p WHERE price IS NOT NULL)
"""


def _scaled(t: Tables):
    points = _ticks(t).select("symbol", "session_date", "tick_id", "ts", F.when(F.col("tick_id") % 11 > 0, F.col("price")).alias("price"), (F.col("price") - 1).alias("prev_close"))
    return sessions.scale_series(points, ["symbol", "session_date"])


@query(_SCALED + "SELECT symbol, strftime(session_date, '%Y-%m-%d') AS session_date, tick_id, round(x, 6) AS x, round(y, 6) AS y, is_rise FROM x")
def W03_scale_series(t: Tables):
    return _scaled(t).select("symbol", "session_date", "tick_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "is_rise")


@query(_SCALED + """SELECT symbol, strftime(session_date, '%Y-%m-%d') AS session_date, string_agg(format('{:.1f}', x) || ',' || format('{:.1f}', y), ' ' ORDER BY i) AS polyline, count(*) AS n_dots FROM x GROUP BY 1, 2""")
def A10_series_polyline(t: Tables):
    return sessions.series_polyline(_scaled(t), ["symbol", "session_date"])


@query(_SCALED + """SELECT symbol, strftime(session_date, '%Y-%m-%d') AS session_date, i // 64 AS segment, string_agg(format('{:.1f}', x) || ',' || format('{:.1f}', y), ' ' ORDER BY i) AS polyline, count(*) AS n_dots FROM x GROUP BY 1, 2, 3""")
def A10_polyline_segments(t: Tables):
    return sessions.polyline_segments(_scaled(t), ["symbol", "session_date"], most=64)


@query("SELECT event_id AS tick_id, row_number() OVER (ORDER BY CASE WHEN event_id % 7 > 0 THEN ts END NULLS FIRST, event_id) - 1 AS place FROM events")
def T03_sort_points(t: Tables):
    points = _ticks(t).withColumn("collected_at", F.when(F.col("tick_id") % 7 > 0, F.col("collected_at")))
    return number_rows(points, *sessions.point_order(), name="place").select("tick_id", "place")
