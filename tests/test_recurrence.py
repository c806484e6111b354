"""Recurrence: rules against the recurrence library, dense and odd rules, zones and exceptions of calendars."""

import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from dateutil.rrule import rrulestr
from pyspark.sql import functions as F

from sessionlake.operators import recurrence
from sessionlake.sources import documents

ROWS = "i int, dtstart timestamp_ntz, rrule string"


def expand(spark, rows, low, high):
    return sorted((r.i, r.occurs) for r in recurrence.expand_recurrence(spark.createDataFrame(rows, ROWS), low, high).collect())


def library(rows, low, high):
    first, after = datetime.fromisoformat(low), datetime.fromisoformat(high) + timedelta(days=1)
    end = ";UNTIL=20260101T000000"  # beyond the range; a rule that never hits would run on for thousands of years
    return sorted((i, x) for i, s, r in rows for x in rrulestr(r + end * ("COUNT" not in r and "UNTIL" not in r), dtstart=s).between(first, after, inc=True) if x < after)


def random_rule(rng):
    freq = rng.choice(("DAILY", "WEEKLY", "MONTHLY", "YEARLY"))
    parts = [f"FREQ={freq}"]
    if rng.random() < 0.6:
        parts.append(f"INTERVAL={rng.randint(1, 4)}")
    if rng.random() < 0.6:
        days = rng.sample(("MO", "TU", "WE", "TH", "FR", "SA", "SU"), rng.randint(1, 4))
        numbered = freq in ("MONTHLY", "YEARLY") and rng.random() < 0.5
        parts.append("BYDAY=" + ",".join((rng.choice(("1", "2", "-1", "+3", "-2", "5")) if numbered else "") + d for d in days))
    picks = any("BYDAY" in p for p in parts)
    if rng.random() < 0.4 and freq != "WEEKLY" and not any("1" in p or "2" in p or "3" in p or "5" in p for p in parts if "BYDAY" in p):
        picks = False
        parts.append("BYMONTHDAY=" + ",".join(str(rng.choice((1, 2, 13, 15, 28, 29, 30, 31, -1, -2, -31))) for _ in range(rng.randint(1, 3))))
    if rng.random() < 0.4:
        parts.append("BYMONTH=" + ",".join(map(str, rng.sample(range(1, 13), rng.randint(1, 5)))))
    if rng.random() < 0.4 and (picks or freq in ("DAILY", "WEEKLY")):  # a rule that never hits takes the library minutes
        parts.append(f"BYSETPOS={rng.choice(('1', '-1', '1,-1', '2,-1', '1,9') if freq != 'DAILY' else ('1', '-1'))}")
    if rng.random() < 0.4 and not any(p.startswith(("BYSETPOS", "BYMONTHDAY")) or "5" in p for p in parts):
        parts.append(f"COUNT={rng.randint(1, 30)}")
    elif rng.random() < 0.3:
        parts.append(f"UNTIL={rng.randint(2024, 2026)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}0000")
    if rng.random() < 0.3:
        parts.append(f"WKST={rng.choice(('SU', 'MO', 'WE'))}")
    rng.shuffle(parts)
    return ";".join(parts)


def test_rules_equal_the_library(spark):
    rng = random.Random(11)
    rows = [(i, datetime(rng.randint(2022, 2025), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), 30) + timedelta(days=rng.randint(0, 3)), random_rule(rng)) for i in range(700)]
    want = library(rows, "2024-11-20", "2025-06-15")
    assert expand(spark, rows, "2024-11-20", "2025-06-15") == want and len({i for i, _ in want}) > 300


def test_day_rules_need_no_python(spark):
    kinds = {
        "FREQ=MONTHLY;BYDAY=-1FR": "days", "FREQ=DAILY": "plain", "FREQ=WEEKLY;BYHOUR=3": "general", "FREQ=MONTHLY;BYDAY=MO,1TU": "general", "FREQ=YEARLY;BYDAY=20MO": "days",
        "FREQ=WEEKLY;BYDAY=XX": "general", "FREQ=MONTHLY;BYMONTHDAY=0": "general", "FREQ=DAILY;FREQ=WEEKLY": "plain", "": "once", "FREQ=DAILY;INTERVAL=0;BYDAY=MO": "once",
    }
    rows = spark.createDataFrame([(i, datetime(2024, 1, 1), rule) for i, rule in enumerate(kinds)], ROWS)
    assert {r.rrule: r._kind for r in recurrence.read_rules(rows).collect()} == kinds


def test_no_rule_kills_the_job(spark):
    start = datetime(1997, 1, 1, 9)
    odd = [
        "FREQ=DAILY;INTERVAL=30000", "FREQ=WEEKLY;INTERVAL=4000", "FREQ=YEARLY;INTERVAL=200000000", "FREQ=YEARLY;BYEASTER=9999", "FREQ=SECONDLY;INTERVAL=99999999999999", "FREQ=DAILY;INTERVAL=99999999999999999999",
        "FREQ=MONTHLY;INTERVAL=2147483647;BYDAY=MO", "FREQ=DAILY;INTERVAL=9223372036854775807;BYDAY=WE", "FREQ=MONTHLY;BYSETPOS=400;BYDAY=MO", "FREQ=DAILY;COUNT=9999999999999;INTERVAL=90000", "FREQ=YEARLY;BYEASTER=x", "FREQ=DAILY;BYDAY=", "FREQ=DAILY;BYHOUR=99",
    ]
    got = expand(spark, [(i, start, r) for i, r in enumerate(odd)], "1996-12-01", "1997-01-20")
    assert got == sorted([(i, start) for i in range(len(odd)) if i != 6] + [(6, datetime(1997, 1, d, 9)) for d in (6, 13, 20)])


def test_dense_rules_are_listed_in_blocks(spark):
    rows = spark.createDataFrame([(1, datetime(1997, 1, 1), "FREQ=SECONDLY"), (2, datetime(1997, 1, 1), "FREQ=SECONDLY;COUNT=3000000"), (3, datetime(1997, 1, 1), "FREQ=MINUTELY;BYDAY=WE")], ROWS)
    made = recurrence.expand_recurrence(rows, "1997-01-20", "1997-02-20")
    got = {r.i: (r.n, r.low, r.high) for r in made.groupBy("i").agg(F.count("*").alias("n"), F.min("occurs").alias("low"), F.max("occurs").alias("high"), F.count_distinct("occurs").alias("d")).filter("n = d").collect()}
    assert got[1] == (32 * 86_400, datetime(1997, 1, 20), datetime(1997, 2, 20, 23, 59, 59))
    assert got[2] == (3_000_000 - 19 * 86_400, datetime(1997, 1, 20), datetime(1997, 1, 1) + timedelta(seconds=2_999_999))
    assert got[3] == (5 * 1440, datetime(1997, 1, 22), datetime(1997, 2, 19, 23, 59))


ICS = """BEGIN:VCALENDAR
BEGIN:VTIMEZONE
TZID:America/New_York
BEGIN:STANDARD
DTSTART:20071104T020000
RRULE:FREQ=YEARLY;BYMONTH=11;BYDAY=1SU
END:STANDARD
END:VTIMEZONE
BEGIN:VEVENT
UID:daily
DTSTART;TZID=America/New_York:20240308T083000
RRULE:FREQ=DAILY;UNTIL=20240314T123000Z
EXDATE;TZID=America/New_York:20240309T083000,20240310T083000
EXDATE:20240312T123000Z
RDATE;VALUE=PERIOD:20240320T010000Z/PT1H,20240311T123000Z
SUMMARY:jobs
BEGIN:VALARM
TRIGGER:-PT5M
DESCRIPTION:ring
END:VALARM
END:VEVENT
BEGIN:VEVENT
UID:daily
RECURRENCE-ID;TZID=America/New_York:20240313T083000
DTSTART;TZID=America/New_York:20240313T100000
SUMMARY:jobs\\, later
DESCRIPTION:BEGIN:VEVENT is only text
END:VEVENT
begin:vevent
dtstart;value=date:20240310
rrule:FREQ=WEEKLY;BYDAY=SU;COUNT=3
exdate;value=date:20240317
summary:all day
end:vevent
BEGIN:VEVENT
UID:odd
DTSTART;TZID=Nowhere/Land:20240311T090000
SUMMARY:local
END:VEVENT
BEGIN:VEVENT
SUMMARY:no start
END:VEVENT
END:VCALENDAR
"""


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_a_calendar_with_zones_alarms_and_exceptions(spark, newline):
    parsed = spark.createDataFrame([(ICS.replace("\n", newline),)], "value string").select(F.inline(documents.parse_ics(F.col("value"))))
    rows = parsed.collect()
    first = rows[0]
    assert first.zone == "America/New_York" and first.starts == datetime(2024, 3, 8, 8, 30) and first.dtstart == datetime(2024, 3, 8, 21, 30) and first.description is None
    assert rows[1].summary == "jobs, later" and rows[1].description == "BEGIN:VEVENT is only text" and rows[1].recurrence_id == datetime(2024, 3, 13, 20, 30)
    assert rows[2].all_day and rows[2].exdates == [datetime(2024, 3, 17)] and rows[2].uid
    assert rows[3].zone is None and rows[3].dtstart == datetime(2024, 3, 11, 9) and rows[4].dtstart is None
    got = sorted((r.occurs, r.summary) for r in recurrence.expand_calendar(parsed, "2024-03-01", "2024-03-31").collect())
    ny = lambda *t: datetime(*t, tzinfo=ZoneInfo("America/New_York")).astimezone(ZoneInfo("Asia/Taipei")).replace(tzinfo=None)
    want = [(ny(2024, 3, 8, 8, 30), "jobs"), (ny(2024, 3, 11, 8, 30), "jobs"), (ny(2024, 3, 14, 8, 30), "jobs"), (datetime(2024, 3, 20, 9), "jobs"), (ny(2024, 3, 13, 10, 0), "jobs, later")]
    want += [(datetime(2024, 3, 10), "all day"), (datetime(2024, 3, 24), "all day"), (datetime(2024, 3, 11, 9), "local")]
    assert got == sorted(want)


def test_moved_occurrences_leave_and_enter_the_range(spark):
    schema = "uid string, starts timestamp_ntz, zone string, rrule string, exdates array<timestamp_ntz>, rdates array<timestamp_ntz>, recurrence_id timestamp_ntz, occurs string"
    day = lambda d: datetime(2024, 5, d, 9)
    rows = [("a", day(1), None, "FREQ=DAILY;COUNT=9", None, None, None, "clash"), ("a", day(20), None, None, None, None, day(5), "clash"), ("a", day(5) + timedelta(hours=4), None, None, None, None, day(9), "clash")]
    rows += [(None, day(4), None, None, [day(4)], None, None, "no series"), (None, None, None, None, None, None, None, None)]
    calendar = spark.createDataFrame(rows, schema).drop("occurs")
    got = sorted(r.occurs for r in recurrence.expand_calendar(calendar, "2024-05-04", "2024-05-06").collect())
    assert got == sorted([day(4), day(6), day(5) + timedelta(hours=4), day(4)])
    assert recurrence.expand_calendar(calendar.limit(0), "2024-05-04", "2024-05-06").count() == 0


def test_every_zone_is_known_to_spark(spark):
    zones = spark.createDataFrame([(z,) for z in sorted(documents.ZONES | set(documents.ZONE_NAMES.values()))], "z string")
    noon = F.lit(datetime(2024, 7, 1, 12)).cast("timestamp_ntz")
    assert zones.select(F.convert_timezone("z", F.lit("UTC"), noon).alias("t")).filter("t is not null").count() == zones.count()


def test_a_rule_that_many_events_share_is_read_once(spark):
    """What depends on the start stays with the event."""
    starts = [datetime(2024, 1, d, 9) for d in (5, 30, 31)]
    rules = ["FREQ=MONTHLY;COUNT=3", "FREQ=WEEKLY", "FREQ=YEARLY;BYMONTHDAY=7", "", None]
    rows = spark.createDataFrame([(n, starts[n % 3], rules[n // 3 % 5]) for n in range(300)], "n int, dtstart timestamp_ntz, rrule string")
    read = recurrence.read_rules(rows)
    assert read.count() == 300
    kinds = {(r.rrule, r.dtstart.day): r._kind for r in read.collect()}
    assert kinds["FREQ=MONTHLY;COUNT=3", 5] == "plain" and kinds["FREQ=MONTHLY;COUNT=3", 30] == "days" and kinds[None, 31] == kinds["", 31] == "once"
    assert {r._month_days[0] for r in read.filter("rrule = 'FREQ=MONTHLY;COUNT=3'").collect()} == {5, 30, 31}
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Generate") < plan.index("Aggregate")  # all reading stands above the distinct texts, none above the events


def test_rules_of_a_calendar_are_worked_out_once(spark):
    """Additions that a rule hits, exclusions, and rows without a series; the occurrences by rule are made in one place of the plan."""
    at = lambda day, hour=9: datetime(2024, 3, day, hour)
    schema = "uid string, starts timestamp_ntz, zone string, all_day boolean, rrule string, exdates array<timestamp_ntz>, rdates array<timestamp_ntz>, recurrence_id timestamp_ntz"
    rows = [
        ("a", at(1), None, False, "FREQ=DAILY;COUNT=4", [at(2)], [at(2), at(3), at(9), at(9)], None), ("a", at(4, 15), None, False, None, None, None, at(4)),
        (None, at(1), None, False, "FREQ=DAILY;COUNT=2", [at(1)], [at(2)], None), ("b", at(5), None, False, None, None, [at(5), at(6)], None), ("b", at(5), None, False, None, None, [at(6)], None),
    ]
    made = recurrence.expand_calendar(spark.createDataFrame(rows, schema), "2024-03-01", "2024-03-31")
    got = sorted((r.uid or "", r.occurs) for r in made.collect())
    want = [("", at(1)), ("", at(2)), ("", at(2)), ("a", at(1)), ("a", at(3)), ("a", at(4, 15)), ("a", at(9)), ("b", at(5)), ("b", at(5)), ("b", at(6)), ("b", at(6))]
    assert got == want
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
