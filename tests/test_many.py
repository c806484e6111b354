"""Many labels, headings and keywords at once, and bounded segments, against the plain forms."""

from datetime import date

from pyspark.sql import functions as F

from sessionlake.functions import html, keywords, numbers, text
from sessionlake.operators import events, sessions


def test_broker_price_is_six_digits_as_written_with_g(spark):
    values = [0.0, -0.0, 1.0, -1.5, 123456.0, 999999.5, 999999.4, 1e6, 1234567.0, 1e15, 1e-4, 0.00012345678, 9.99999e-5, 9.9999996e-5, -2.5e-7, 1.0000005, 0.1000005, 100.0, 10.25, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = [r.s for r in df.select(numbers.fmt_broker_price(F.col("v")).alias("s")).collect()]
    assert got == [f"{v:g}" for v in values] + ["—"]


def test_all_labels_give_what_each_alone_gives(spark):
    pages = [
        (1, "A\n\n1.5\n-0.5\n(0.25%)\nB \n2,000.5\n1.0 (3%)\nA\n\n9.5\n9.5\n(9%)"),
        (2, "x\n  C\n^SYM\n10.0\n-1.0\n2%\n01/02 03:04\nD\n\n7.0\n1.0\n-3%\nE\nno quote"),
        (3, "C\nD\n10.0\n-1.0\n2%"),
        (4, None), (5, ""), (6, "A"), (None, "A\n1.5\n0.5\n(1%)"), (7, "blank\r\nA\r\n1.5\r\n0.5\r\n(1%)\r\n"),
    ]
    df = spark.createDataFrame(pages, "page int, text string")
    labels = [(f"{x}-{layout}", x, layout) for x in "ABCDE" for layout in html.QUOTE_LAYOUTS]
    targets = spark.createDataFrame([*labels, labels[0], ("none", None, "markets"), ("odd", "A", "other"), ("null", "A", None)], "key string, label string, layout string")
    got = {tuple(r) for r in html.labelled_quotes(df, "text", targets, ["page"]).collect()}
    want = set()
    for key, label, layout in labels:
        for r in df.select("page", html.labelled_quote(F.col("text"), label, layout).alias("q")).filter("q is not null").collect():
            want.add((r.page, key, label, layout, *r.q))
    assert got == want and len(want) == 7
    assert html.labelled_quotes(df.limit(0), "text", targets, ["page"]).count() == 0


def test_several_lists_of_a_page_equal_each_alone(spark):
    page = "<p>one</p><table><tr><td>a<td>b<tr><td>c<td>d</table><p>two</p><p>three</p><table><tr><td>e</td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, "no list"), (3, None), (4, "<table><tr><td>x")], "page int, html string")
    lists = {"one": 2, "two": 1, "three": 1, None: 1, "absent": 1}
    got = sorted(((r.page, r.heading or "", r.row_pos, [c.text for c in r.cells]) for r in html.tables_after_headings(df, "html", lists).collect()))
    want = []
    for heading, least in lists.items():
        columns = [f"c{n}" for n in range(least)]
        want += [(r.page, heading or "", r.row_pos, [c.text for c in r.cells]) for r in html.table_after_heading(df, "html", heading, columns).collect()]
    assert got == sorted(want) and len(got) == 7


def test_rule_hits_equal_the_loop(spark):
    rules = [(3, "x", ("AB", "ABC", "B", "ÉÉ")), (-1, "y", ("B", "AB", "ZZ")), (2, "z", ("C", "聯準會")), (5, "never", ())]
    texts = ["abc", "b", "", None, "c", "éé", "zz", "nothing", "聯準會", "ABCABC"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    for used, default in ((rules, "other"), (rules, None), ([], "other"), ([*rules, (7, "all", ("",))], "other")):
        scores, classes = [(w, words) for w, _, words in used], [(name, words) for _, name, words in used if words]
        plain = F.lit("other") if not classes else text.first_rule(F.col("text"), classes, "other")
        rows = df.select(keywords.rule_hits(F.col("text"), used, default).alias("h"), text.keyword_score(F.col("text"), scores).alias("score"), plain.alias("rule")).collect()
        for r in rows:
            assert r.h.score == r.score and (r.h.rule or "other") == r.rule
    assert df.limit(0).select(keywords.rule_hits(F.col("text"), rules)).count() == 0


def test_the_plan_does_not_grow_with_the_keywords(spark):
    df = spark.createDataFrame([("a",)], "text string")
    size = lambda n: len(df.select(keywords.rule_hits(F.col("text"), [(1, "r", tuple(f"W{i}" for i in range(n)))]))._jdf.queryExecution().toString())
    assert abs(size(10) - size(10_000)) < 50


def test_a_hot_date_and_a_hot_series_come_in_bounded_rows(spark):
    day = date(2024, 1, 10)
    rows = spark.range(5000).select(F.lit(day).alias("date"), F.when(F.col("id") % 3 > 0, F.lpad(F.col("id") % 24, 2, "0")).alias("time"), F.concat(F.lit("t"), F.col("id") % 4000).alias("title"))
    rows = rows.unionByName(spark.createDataFrame([(None, "01", "gone"), (date(2024, 1, 11), None, None)], "date date, time string, title string"))
    parts = events.agenda_segments(rows, F.lit(day), most=700).orderBy("date", "segment").collect()
    assert [len(p.events) for p in parts] == [700] * 7 + [100, 1]
    whole = {r.date: r.events for r in events.agenda(rows, F.lit(day)).collect()}
    assert [(e.time or "", e.title) for p in parts[:-1] for e in p.events] == [(e.time or "", e.title) for e in whole[day]]

    points = spark.range(3000).select(F.lit(None).cast("string").alias("symbol"), F.timestamp_seconds(F.col("id") % 900).alias("ts"), F.col("id").alias("tick_id"), F.when(F.col("id") % 5 > 0, F.rand(1)).alias("price"), F.lit(0.5).alias("prev_close"))
    points = points.unionByName(spark.createDataFrame([("one", None, 1, 2.0, None), ("none", None, 1, None, 0.0)], "symbol string, ts timestamp, tick_id long, price double, prev_close double"))
    scaled = sessions.scale_series(points, ["symbol"]).persist()
    pieces = sessions.polyline_segments(scaled, ["symbol"], most=400).orderBy("symbol", "segment").collect()
    line = {r.symbol: r.polyline for r in sessions.series_polyline(scaled, ["symbol"]).collect()}
    assert max(p.n_dots for p in pieces) <= 400 and {p.symbol for p in pieces} == {None, "one"}
    assert " ".join(p.polyline for p in pieces if p.symbol is None) == line[None]
    scaled.unpersist()
