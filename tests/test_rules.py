"""Numbers, dates, text rules, calendars and matching on stated cases."""

import math
from datetime import date, datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sessionlake.functions import dates, numbers, text
from sessionlake.operators import calendar, events, matching, quotes, recurrence, sessions
from sessionlake.streaming import sessions as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("value,decimals", [(2.675, 2), (1.005, 2), (0.125, 2), (-0.001, 2), (1234567.895, 2), (0.5, 0), (1.5, 0), (-2.5, 0)])
def test_rounding_and_display_as_python(spark, value, decimals):
    assert one(spark, numbers.py_round(F.lit(value), decimals)) == round(value, decimals)
    assert one(spark, numbers.fmt_num(F.lit(value), decimals)) == f"{value:,.{decimals}f}"
    assert one(spark, numbers.fmt_pct(F.lit(value), decimals)) == f"{value:+.{decimals}f}%"


def test_missing_and_odd_numbers(spark):
    for value in (None, "", "NaN", "null", "None"):
        assert one(spark, numbers.fmt_num(F.lit(value).cast("string"))) == "—" == one(spark, numbers.fmt_pct(F.lit(value).cast("string")))
    assert one(spark, numbers.fmt_num(F.lit("abc"))) == "abc"
    assert one(spark, numbers.parse_number(F.lit("+3,750.5"))) == 3750.5 and one(spark, numbers.parse_int(F.lit("--"))) is None
    for price in (12.5, 100.0, 1234.5678, 99999.96, 0.05, 123456.7):
        assert one(spark, numbers.fmt_broker_price(F.lit(price))) == f"{price:g}"


def test_signs_and_surprise(spark):
    assert tuple(one(spark, numbers.reconcile_sign(F.lit(65.0), F.lit(-0.14)))) == (-65.0, -0.14)
    assert tuple(one(spark, numbers.reconcile_sign(F.lit(-65.0), F.lit(0.14)))) == (-65.0, -0.14)
    for actual, forecast, want in (("1.5%", "1.50%", "inline"), ("210K", "200K", "beat"), ("1.4", "1.5", "miss"), (None, "1", "pending"), ("", "1", "pending"), ("x", "1", "inline")):
        assert one(spark, numbers.surprise(F.lit(actual).cast("string"), F.lit(forecast))) == want


def test_announcement_times(spark):
    rows = [("115/08/21", "13:30:01", datetime(2026, 8, 21, 13, 30, 1)), ("115/08/21", "13:30", datetime(2026, 8, 21, 13, 30)), ("115/02/30", "10:00", None), ("08/21", "10:00", None), ("115/08/21", "", None), (None, "1:00", None), ("a/b/c", "1:00", None), ("115/08/21", "25:00", None)]
    got = spark.createDataFrame([r[:2] for r in rows], "d string, t string").select(dates.roc_timestamp(F.col("d"), F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [r[2] for r in rows]


def test_feed_time(spark):
    assert one(spark, dates.parse_pubdate(F.lit("Thu, 20 Aug 2026 15:30:00 GMT"))) == datetime(2026, 8, 20, 23, 30)
    assert one(spark, dates.parse_pubdate(F.lit("20 Aug"))) is None


@pytest.mark.parametrize("day,time,country,want", [
    (date(2026, 8, 27), "20:30", "US", ("2026-08-27T12:30:00Z", "20:30 TPE", "08:30 ET")),
    (date(2026, 9, 3), "02:00", "US", ("2026-09-02T18:00:00Z", "02:00 TPE", "14:00-1 ET")),
    (date(2026, 9, 3), "17:00", "EU", ("2026-09-03T09:00:00Z", "17:00 TPE", "11:00 CET")),
    (date(2026, 9, 3), None, "JP", ("2026-09-03T00:00:00Z", "全天", "全天")),
    (date(2026, 9, 3), "09:00", "TW", ("2026-09-03T01:00:00Z", "09:00 TPE", "09:00 TPE")),
])
def test_event_times(spark, day, time, country, want):
    assert tuple(one(spark, dates.event_times(F.lit(day), F.lit(time).cast("string"), F.lit(country)))) == want


def test_daylight_saving_is_an_option(spark):
    winter = dates.event_times(F.lit(date(2026, 1, 8)), F.lit("21:30"), F.lit("US"), dst=True)
    assert one(spark, winter).time_origin_str == "08:30 ET"


def test_session_dates(spark):
    for ts, plain, joined in (("2026-08-21 15:00:00", 24, 24), ("2026-08-22 02:00:00", 22, 24), ("2026-08-22 22:27:13", 24, 24), ("2026-08-20 20:52:49", 21, 21), ("2026-08-20 14:59:59", 20, 20)):
        c = F.lit(ts).cast("timestamp_ntz")
        assert one(spark, dates.session_date(c)).day == plain and one(spark, dates.session_date(c, join_weekend=True)).day == joined


def test_calendar_and_cutoffs(spark):
    cal = calendar.trading_calendar(spark, date(2026, 2, 1), date(2026, 3, 1))
    rows = {r.d: r for r in cal.collect()}
    assert len(rows) == 29 and not rows[date(2026, 2, 18)].is_trading_day
    assert rows[date(2026, 2, 18)].prev_td == date(2026, 2, 13) and rows[date(2026, 2, 18)].next_td == date(2026, 2, 23)
    nows = spark.createDataFrame([(datetime(2026, 2, 13, 13, 30),), (datetime(2026, 2, 13, 13, 29),), (datetime(2026, 2, 20, 8, 0),)], "now timestamp_ntz")
    assert [r.cutoff for r in calendar.last_cutoff(nows, "now", cal).orderBy("now").collect()] == [datetime(2026, 2, 12, 13, 30), datetime(2026, 2, 13, 13, 30), datetime(2026, 2, 13, 13, 30)]
    assert [r.window_start for r in calendar.news_window(nows, "now", cal).orderBy("now").collect()] == [datetime(2026, 2, 12, 13, 30), datetime(2026, 2, 12, 13, 30), datetime(2026, 2, 13, 13, 30)]


def test_alignment_around_new_year(spark):
    cal = calendar.trading_calendar(spark, date(2026, 12, 1), date(2027, 1, 31))
    df = spark.createDataFrame([(date(2026, 12, 31), "01/01")], "today date, applies_to string")
    near, same = (calendar.date_alignment(df, "today", "applies_to", cal, nearest_year=n).first() for n in (True, False))
    assert (near.alignment, near.diff_days) == ("aligned_next", 1) and (same.alignment, same.diff_days) == ("warning", -364)


def test_scores_and_classes(spark):
    assert one(spark, text.keyword_score(F.lit("台積電法說會後大漲 CoWoS nvidia"))) == 3 + 2 + 2 + 3  # mixed case in a rule never hits
    assert one(spark, text.first_rule(F.lit("US CPI"))) == "macro" and one(spark, text.first_rule(F.lit("Fed and CPI"))) == "central_bank" and one(spark, text.first_rule(F.lit("x"))) == "other"
    assert one(spark, text.first_rule(F.lit("futures settlement"), text.SIMPLE_CATEGORY_RULES, "general")) == "futures"
    assert one(spark, text.country_of(F.lit("加拿大利率決議"), F.lit(""))).country == "GLOBAL" and one(spark, text.country_of(F.lit("x"), F.lit("fomc"))).country == "US"
    assert one(spark, text.importance_of(F.lit("原油庫存"))) == 2


def test_terms_keep_their_order(spark):
    assert one(spark, text.replace_terms(F.lit("季环比 非农"))) == "季月增率(MoM) 非农"


def test_event_record(spark):
    df = spark.createDataFrame([(date(2026, 8, 27), "20:30", False, " 美国 GDP ", "市场预期: 1.50%\n前值:  1.50%\nMM图表连结: https://e.example/1"), (date(2026, 8, 27), None, True, " ", "x")], "date date, time string, all_day boolean, summary string, description string")
    rows = events.classify_events(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.title, r.category, r.country, r.importance, r.forecast, r.previous, r.actual, r.comparison) == ("美國 GDP", "macro", "US", 3, "1.50%", "1.50%", None, "pending")
    assert r.source_url == "https://e.example/1" and r.description == "市場預期: 1.50%\n前值:  1.50%" and r.time_origin_str == "08:30 ET"


def test_value_is_cut_at_a_comma(spark):
    assert one(spark, text.labelled_values(F.lit("預期值：4,405; Actual: 7"))).forecast == "4"


def test_tokens_and_codes(spark):
    assert one(spark, text.tokenize_list(F.lit("2426.2851，聯一光　\n中再保、"))) == ["2426", "2851", "聯一光", "中再保"]
    for nothing in ("0", " - ", "無", ""):
        assert one(spark, text.tokenize_list(F.lit(nothing))) == []
    assert one(spark, text.stock_codes(F.lit("號2330，123456 2330 1101a 00878"))) == ["2330", "00878"]


NAMES = ["中再保", "聯一光", "鼎元", "abcd", "abce", "diet", "abcdefgh"]
TOKENS = ["中再堡", "聯一先", "鼎緣", "鼎元", "abcf", "tide", "1101", "abcdefgx", "", "xyz", "hgfedcba"]


def test_matching_in_stages(spark):
    rows = spark.createDataFrame([("d", str(1101 + n), name, n) for n, name in enumerate(NAMES)] + [("d", "9999", "鼎元", 99)], "date string, code string, name string, row_pos int")
    tokens = spark.createDataFrame([("d", n, t) for n, t in enumerate(TOKENS)], "date string, pos int, token string")
    got = {r.token: (r.match_type, r.row_name) for r in matching.match_tokens(tokens, rows).collect()}
    for token in TOKENS:
        if token == "1101":
            want = ("code", "中再保")
        elif token in NAMES:
            want = ("name", token)
        else:
            ratios = [(SequenceMatcher(None, name, token).ratio(), name) for name in NAMES]
            best = max(ratios)
            want = ("fuzzy_name", best[1]) if token and best[0] >= 0.6 else (None, None)
        assert got[token] == want, token
    assert got["中再堡"] == ("fuzzy_name", "中再保") and got["鼎緣"] == (None, None)


def test_first_point_may_be_empty(spark):
    points = spark.createDataFrame([("s", 1, None, None, None, None, None), ("s", 2, 45220.0, 45138.0, 45474.0, 45126.0, 45203.0)], "symbol string, at int, open double, prev_close double, high double, low double, price double").withColumn("provider", F.lit("p"))
    live = spark.createDataFrame([("s", 1.0, 2.0, 3.0, 4.0, 5.0, "live"), ("t", 1.0, 2.0, 3.0, 4.0, 5.0, "live")], "symbol string, open double, prev_close double, high double, low double, price double, provider string")
    rows = {r.symbol: r for r in sessions.assemble_session(points, live, ["symbol"], "at", "at").collect()}
    assert (rows["s"].open, rows["s"].high, rows["s"].low, rows["s"].latest.price) == (1.0, 45474.0, 4.0, 45203.0)
    assert rows["t"].latest.price == 5.0 and rows["t"].n_points == 0


def test_provider_fallback(spark):
    df = spark.createDataFrame([(1, "finmind", 2.0), (1, "yahoo", None), (1, "wantgoo", 3.0), (2, "yahoo", None)], "k int, provider string, price double")
    got = {r.k: (r.provider, r.price, r.is_fallback) for r in quotes.first_available(df, ["k"]).collect()}
    assert got == {1: ("finmind", 2.0, False), 2: ("fixture", 45203.0, True)}
    assert {r.k: r.provider for r in quotes.first_available(df, ["k"], preferred="wantgoo").collect()}[1] == "wantgoo"


def test_general_recurrence_matches_the_library(spark):
    from dateutil.rrule import rrulestr

    rules = ["FREQ=WEEKLY;BYDAY=MO,TH;UNTIL=20260910T000000", "FREQ=MONTHLY", "FREQ=DAILY;INTERVAL=3;COUNT=4", "FREQ=YEARLY", "FREQ=DAILY;UNTIL=20260815T090000Z", "FREQ=MONTHLY;INTERVAL=2"]
    starts = [datetime(2026, 7, 31, 9), datetime(2026, 8, 13, 9), datetime(2024, 2, 29, 9), datetime(2025, 9, 1, 9)]
    rows = [(n * 10 + m, s, r) for n, s in enumerate(starts) for m, r in enumerate(rules)]
    got = sorted((r.i, r.occurs) for r in recurrence.expand_recurrence(spark.createDataFrame(rows, "i int, dtstart timestamp_ntz, rrule string"), "2026-08-01", "2026-09-15").collect())
    want = sorted((i, x) for i, s, r in rows for x in rrulestr(r.replace("Z", ""), dtstart=s).between(datetime(2026, 8, 1), datetime(2026, 9, 15, 23, 59), inc=True))
    assert got == want


def test_late_ticks_drop_from_the_stream_but_not_from_the_batch(spark, tmp_path):
    schema = "tick_id long, collected_at timestamp_ntz, symbol string, price double, provider string, open double, prev_close double, high double, low double"
    row = lambda i, day: (i, datetime(2026, 8, day, 10), "s", float(i), "p", 1.0, 1.0, float(i), 0.0)
    for n, rows in enumerate(([row(1, 3)], [row(2, 20)], [row(3, 20)], [row(4, 3)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    seen = {}

    def upsert(df, _):
        for r in df.collect():
            seen[r.session_ts.day] = r.n_points

    ticks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = stream.stream_sessions(stream.session_states(ticks), str(tmp_path / "state"), upsert).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == {3: 1, 20: 2}  # the late tick of the 3rd came after the watermark
    batch = spark.read.schema(schema).parquet(str(tmp_path / "in" / "*")).withColumn("session_date", dates.session_date(F.col("collected_at")))
    assert {r.session_date.day: r.n_points for r in sessions.assemble_session(batch).collect()} == {3: 2, 20: 2}


def test_broker_prices_of_any_size(spark):
    prices = [0.0, 1234567.0, 999999.9, 0.00001234, 1e-4, 9.9999996e-5, 100000.5, 12345.65, 1e100, -3.5e-300, 120.5, -1234567.5, math.inf, -math.inf, math.nan]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(prices)], "i int, p double").select("i", numbers.fmt_broker_price(F.col("p")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [f"{p:g}" for p in prices]
    assert one(spark, numbers.fmt_broker_price(F.lit(None).cast("double"))) == numbers.MISSING


def test_rules_that_cannot_be_read_occur_once(spark):
    start = datetime(2026, 8, 13, 9)
    odd = ["FREQ=DAILY;INTERVAL=0", "FREQ=DAILY;INTERVAL=-1", "FREQ=DAILY;INTERVAL=x", "FREQ=DAILY;COUNT=0", "FREQ=DAILY;COUNT=z", "FREQ=DAILY;UNTIL=soon", "FREQ=NEVER", "INTERVAL=2", "no rule", ";;", "", None, "FREQ=WEEKLY;BYDAY=XX", "FREQ=DAILY;INTERVAL=0;BYDAY=MO"]
    rows = spark.createDataFrame([(i, start, r) for i, r in enumerate(odd)] + [(99, None, "FREQ=DAILY")], "id int, dtstart timestamp_ntz, rrule string")
    got = recurrence.expand_recurrence(rows, "2026-08-01", "2026-08-31").collect()
    assert sorted((r.id, r.occurs) for r in got) == [(i, start) for i in range(len(odd))]


def test_short_months_and_hours(spark):
    rows = spark.createDataFrame(
        [(1, datetime(2026, 1, 31, 9), "FREQ=MONTHLY"), (2, datetime(2026, 3, 1, 22), "freq=hourly;interval=3;COUNT=3"), (3, datetime(2026, 1, 31, 9), "FREQ=MONTHLY;COUNT=2"), (4, datetime(2026, 3, 1), "FREQ=DAILY;FREQ=WEEKLY;COUNT=2")],
        "id int, dtstart timestamp_ntz, rrule string",
    )
    got = sorted((r.id, r.occurs) for r in recurrence.expand_recurrence(rows, "2026-01-01", "2026-04-30").collect())
    assert got == [
        (1, datetime(2026, 1, 31, 9)), (1, datetime(2026, 3, 31, 9)), (2, datetime(2026, 3, 1, 22)), (2, datetime(2026, 3, 2, 1)), (2, datetime(2026, 3, 2, 4)),
        (3, datetime(2026, 1, 31, 9)), (3, datetime(2026, 3, 31, 9)), (4, datetime(2026, 3, 1)), (4, datetime(2026, 3, 2)),
    ]


def test_event_numbers_per_calendar(spark):
    rows = [("a", date(2026, 1, 2), None, "x"), ("a", date(2026, 1, 1), "10:00", "y"), (None, date(2026, 1, 5), "09:00", "z"), ("a", None, "08:00", "no date"), (None, date(2026, 1, 5), None, "w")]
    df = spark.createDataFrame(rows, "cal string, date date, time string, title string")
    got = {r.title: r.event_no for r in events.number_events(df, ["cal"]).collect()}
    assert got == {"y": "ev-2026-01-01-1", "x": "ev-2026-01-02-2", "w": "ev-2026-01-05-1", "z": "ev-2026-01-05-2", "no date": None}


def test_saved_record_stands_in(spark):
    df = spark.createDataFrame([(1, "a", "yahoo", None), (2, "b", "yahoo", None), (3, "a", "yahoo", 7.0)], "k int, symbol string, provider string, price double")
    saved = spark.createDataFrame([("a", 5.0, 1), ("a", 6.0, 2), ("a", None, 3)], "symbol string, price double, collected_at int")
    got = {r.k: (r.provider, r.price, r.is_fallback) for r in quotes.first_available(df, ["k", "symbol"], saved=saved, saved_keys=["symbol"]).collect()}
    assert got == {1: ("fixture", 6.0, True), 2: ("fixture", 45203.0, True), 3: ("yahoo", 7.0, False)}


def test_category_names(spark):
    assert one(spark, text.name_of(text.first_rule(F.lit("FOMC")))) == "央行" and one(spark, text.name_of(F.lit("none"))) is None
    simple = text.first_rule(F.lit("結算"), text.SIMPLE_CATEGORY_RULES, "general")
    assert one(spark, text.name_of(simple, text.SIMPLE_CATEGORY_NAMES)) == "期貨結算"
