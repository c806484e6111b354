"""Filters one by one, and the small functions that no query needs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from sessionlake.functions import text
from sessionlake.operators import events, sessions, watchlist
from sessionlake.sources import documents, snapshots

EVENTS = [
    (1, date(2026, 8, 19), "09:00", "US CPI", 3, "US", "macro"), (2, date(2026, 8, 21), None, "TW talk", 1, "TW", "speech"),
    (3, date(2026, 8, 23), "10:00", "us report", 2, "US", "earnings"), (4, date(2026, 8, 24), "08:00", "JP GDP", 3, "JP", "macro"), (5, None, None, None, None, None, None),
]


@pytest.mark.parametrize("given,want", [
    ({}, [1, 2, 3, 4, 5]), ({"quick": ("star3",)}, [1, 4]), ({"quick": ("today",)}, [2]), ({"quick": ("this_week",)}, [2, 3]), ({"quick": ("star3", "this_week")}, []),
    ({"countries": ("US", "JP")}, [1, 3, 4]), ({"categories": ("macro",)}, [1, 4]), ({"search": "US"}, [1, 3]), ({"search": "us", "categories": ("earnings",), "countries": ("US",)}, [3]),
])
def test_each_filter_and_their_sum(spark, given, want):
    df = spark.createDataFrame(EVENTS, "id int, date date, time string, title string, importance int, country string, category string")
    assert sorted(r.id for r in events.filter_events(df, F.lit(date(2026, 8, 21)), **given).collect()) == want


def test_sorts(spark):
    df = spark.createDataFrame(EVENTS, "id int, date date, time string, title string, importance int, country string, category string").filter("date is not null")
    assert [r.id for r in events.sort_events(df).collect()] == [1, 2, 3, 4]
    points = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "tick_id int, collected_at string")
    assert [r.tick_id for r in sessions.sort_points(points).collect()] == [2, 3, 1]
    shown = spark.createDataFrame([("b",), ("10 lots",), ("2",), ("a",)], "shown string")
    assert [r.shown for r in watchlist.typed_sort(shown, "shown").collect()] == ["2", "10 lots", "a", "b"]


def test_codes_and_lists(spark):
    r = spark.range(1).select(
        text.is_stock_code(F.lit("2330")).alias("a"), text.is_stock_code(F.lit("x2330")).alias("b"),
        watchlist.merge_arrays(F.array(F.lit("1"), F.lit("2")), F.array(F.lit("2"), F.lit("3"))).alias("m"), watchlist.remove_code(F.array(F.lit("1"), F.lit("2")), F.lit("1")).alias("d"),
    ).first()
    assert (r.a, r.b, r.m, r.d) == (True, False, ["1", "2", "3"], ["2"])


def test_snapshots_are_compacted(spark, tmp_path):
    ticks = spark.createDataFrame([(f"s{i % 2}", float(i), date(2026, 8, 20 + i % 3)) for i in range(12)], "symbol string, price double, session_date date")
    for _ in range(2):
        snapshots.append_snapshots(ticks, f"{tmp_path}/in")
    snapshots.compact_snapshots(spark, f"{tmp_path}/in", f"{tmp_path}/out", "symbol string, price double, session_date date")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 24 and sorted(map(str, back.select("symbol", "price", "session_date").distinct().collect())) == sorted(map(str, ticks.collect()))


def test_pages_and_calendars_are_read_as_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>\n one</p>")
    (tmp_path / "b.html").write_text("two")
    assert {r.path.rsplit("/", 1)[1]: r.html for r in documents.read_pages(spark, f"{tmp_path}/*.html").collect()} == {"a.html": "<p>\n one</p>", "b.html": "two"}
    (tmp_path / "c.ics").write_text("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nDTSTART;VALUE=DATE:20260820\r\nSUMMARY:long\r\n  line\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART:20260820T010000Z\r\nEND:VEVENT\r\nEND:VCALENDAR")
    rows = documents.read_ics(spark, f"{tmp_path}/*.ics").collect()
    assert sorted((r.all_day, str(r.dtstart), r.summary) for r in rows) == [(False, "2026-08-20 09:00:00", None), (True, "2026-08-20 00:00:00", "long line")]


def test_a_calendar_is_read_event_by_event(spark, tmp_path):
    """Small splits of one file: each task reads the events that begin in its part, none twice, and no whole file."""
    event = "BEGIN:VEVENT\r\nUID:e-{0}\r\nDTSTART:20260820T010000Z\r\nDESCRIPTION:BEGIN:VEVENT in a\r\n  text\r\nEND:VEVENT\r\n"
    events = [event.format(i) for i in range(400)]
    events[7] = events[7].replace("BEGIN:VEVENT\r", "begin:vevent\r").replace("END:VEVENT\r", "end:vevent\r")
    events[9] = events[9].replace("END:VEVENT\r\n", "")  # has no end
    (tmp_path / "a.ics").write_text("BEGIN:VCALENDAR\r\n" + "".join(events[:200]) + "END:VCALENDAR\r\n", newline="")
    (tmp_path / "b.ics").write_text("".join(events[200:]).replace("\r\n", "\n") + "BEGIN:VEVENT\nUID:cut off", newline="")
    (tmp_path / "c.ics").write_text("")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        read = documents.read_ics(spark, str(tmp_path)).select("uid", "summary", "description", F.spark_partition_id().alias("task"))
        rows = read.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted(r.uid for r in rows) == sorted(f"e-{i}" for i in range(400) if i != 9)
    assert {r.description for r in rows} == {"BEGIN:VEVENT in a text"} and len({r.task for r in rows}) > 3


def test_an_event_is_worked_out_step_by_step(spark):
    """Each step stands behind a generator, so its text is not worked out again by the next; input columns named like results do not matter."""
    rows = [(date(2026, 8, 20), "09:30", False, " 美国 CPI ", "预期: 1%, 前值: 2%\nMM图表连结: https://example.com/a", "kept out"), (None, None, True, " ", "blank", None)]
    made = events.classify_events(spark.createDataFrame(rows, "date date, time string, all_day boolean, summary string, description string, category string"))
    (row,) = made.collect()
    assert (row.title, row.country, row.category, row.importance, row.forecast, row.previous, row.source_url) == ("美國 CPI", "US", "macro", 3, "1%", "2%", "https://example.com/a")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") - plan.count("regexp_replace(") <= 2 * len(text.TERMS) and plan.count("Generate") >= 4
