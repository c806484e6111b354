"""Tables, badges, segments, dates, quotes and embedded data of pages."""

from datetime import datetime

from pyspark.sql import functions as F

from sessionlake.functions import dates, html, text
from sessionlake.operators import brokers, watchlist

BADGES = "".join(f'<td title="run {n} {n}/5"><div></div></td>' for n in (3, 4)) + '<td><div title="run 6 of 6 2/6"></div></td><td>x</td>'
PAGE = f"""<html><head><script>var t = "<table>";</script></head><body><p>適用 08/22 交易日</p>
<select><option>2026/08/20 (四)</option><option selected>2026/08/21 (五)</option></select>
<div>&#128308; 差1次就處置 (1 檔)</div>
<table><tbody><tr><td>上市</td><td>⏸7100</td><td> 石橋 </td><td>95.1</td>
<td><span style="color:#e74c3c">近6日</span><b style="color: #FFF;font-weight:bold">已達</b><i style="color:#123456">?</i><u style="top:0">no</u></td>
<td>08-25 第2次2分</td>{BADGES}</tr><tr><td colspan="10">detail</td></tr></tbody></table>
<div><b>目前</b><i>處置中</i></div>
<table><tr><th>x</th></tr>
<tr><td>board one</td><td>7001</td><td>A</td><td>5分</td><td>a</td><td>b</td><td>c</td><td></td><td>r</td><td>extra</td></tr>
<tr><td>board two</td><td>7002</td><td>B</td><td>20分</td><td>a</td><td>b</td><td>c</td><td>in 0 days</td><td>r</td></tr>
<tr><td>board two</td><td>7003</td><td>C</td><td></td><td>a</td><td>b</td><td>c</td><td>12天</td><td>r</td></tr>
<tr><td>board two</td><td>7004</td><td>D</td><td></td><td>a</td><td>b</td><td>c</td><td>1</td><td>r</td></tr></table></body></html>"""


def pages(spark):
    return spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>差1次就處置 and nothing more"), (4, "")], "id long, html string")


def test_near_list(spark):
    rows = html.table_after_heading(pages(spark), "html", "差1次就處置", html.NEAR_COLUMNS).withColumn("badges", html.badges(F.col("cells"))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.id, r.market, r.code, r["name"], r.close, r.earliest_disposal) == (1, "上市", "⏸7100", "石橋", "95.1", "08-25 第2次2分")
    assert [(b.short, b.current, b.threshold) for b in r.badges] == [("3①", 3, 5), ("5", 4, 5), ("6", 2, 6), ("12", None, None)]
    assert [(s.text, s.color, s.bold) for s in r.cells[4].segments] == [("近6日", "rise", False), ("已達", "text", True), ("?", "muted", False)]


def test_restricted_list_with_a_split_heading(spark):
    rows = html.table_after_heading(pages(spark), "html", "目前處置中", html.RESTRICTED_COLUMNS)
    found = rows.withColumn("left", dates.days_left(F.col("trading_days_left"))).orderBy("row_pos")
    grouped = watchlist.split_restricted(found.drop("trading_days_text"), "left", "trading_days_left")
    assert [(r.code, r.left, r.restricted_group) for r in grouped.orderBy("row_pos").collect()] == [("7001", None, "hidden"), ("7002", 0, "exiting"), ("7003", 12, "rest"), ("7004", 1, "rest")]
    assert html.table_after_heading(pages(spark), "html", "差2次處置", html.NEAR_COLUMNS).count() == 0


def test_first_table_and_dates(spark):
    assert html.table_after_heading(pages(spark), "html", None, ("market", "code")).first().code == "⏸7100"
    d = pages(spark).filter("id = 1").select(html.page_date(F.col("html")).alias("d")).first().d
    assert (d.applies_to, d.selected, d.listed) == ("08/22", "2026/08/21 (五)", None)
    other = spark.range(1).select(html.page_date(F.lit("x 漲停當日 2026/08/20 y")).alias("d")).first().d
    assert other.listed == "2026/08/20" and other.selected is None


def test_segments_without_colour(spark):
    rows = spark.createDataFrame([("<b>flat</b> text",), ("",), (None,)], "c string").select(html.condition_segments(F.col("c")).alias("s")).collect()
    assert [[(x.text, x.color, x.bold) for x in r.s] for r in rows] == [[("flattext", None, False)], [], []]


def test_text_of_a_page(spark):
    r = spark.range(1).select(html.html_to_text(F.lit("<SCRIPT>x<b></SCRIPT>a<br>b &lt;&amp;lt; c")).alias("raw"), html.html_to_text(F.lit("a &lt;&amp;lt; c"), unescape=True).alias("decoded")).first()
    assert r.raw == "a\nb &lt;&amp;lt; c" and r.decoded == "a <&lt; c"


def test_quotes(spark):
    a = "道瓊工業指數\n\n53,463.05\n119.65\n(0.22%)\n"
    b = "韓國綜合指數\n^KS11\n6,852.58\n-381.41\n-5.89%\n6,680.34\n301,744\n08/20 14:32\n"
    r = spark.range(1).select(html.labelled_quote(F.lit(a), "道瓊工業指數", "markets").alias("a"), html.labelled_quote(F.lit(b), "韓國綜合指數", "world").alias("b"), html.labelled_quote(F.lit(a), "韓國綜合指數", "world").alias("none")).first()
    assert tuple(r.a) == (53463.05, 119.65, 0.22, None) and tuple(r.b) == (6852.58, -381.41, -5.89, "08/20 14:32") and r.none is None


def test_trend(spark):
    card = '<div><a class="{}"><span>韓國綜合指數</span><b>1</b></a></div><p class="c-trend-down">x</p>'
    deep = "<i>" * 13 + "韓國綜合指數" + "</i>" * 13
    values = [card.format("c-trend-up"), card.format("c-trend-down"), card.format("none"), "nothing", None, f'<div class="c-trend-down">{deep}</div>']
    rows = spark.createDataFrame([(v,) for v in values], "h string").select(html.trend_sign(F.col("h"), "韓國綜合指數").alias("s")).collect()
    assert [r.s for r in rows] == [1, -1, 1, 1, 1, 1]


def test_deep_and_broken_pages(spark):
    """Nesting without end, stray end tags and cut-off markup give rows or none, never an error."""
    table = "<table><tr><td>a</td><td>b</td></tr></table>"
    odd = ["<p>" * 100_000 + "near" + table, "<i>" * 50_000 + "</b>" * 50_000 + "near" + table, "near" + table + "<div", "<table><tr><td>near", "</table>" * 9 + "near<table></table>", "<div><b>ne</b><i>ar</i></div>" + table]
    df = spark.createDataFrame(list(enumerate(odd)), "id int, html string")
    got = {r.id: (r.x, r.y) for r in html.table_after_heading(df, "html", "near", ("x", "y")).collect()}
    assert got == {0: ("a", "b"), 1: ("a", "b"), 2: ("a", "b"), 5: ("a", "b")}
    deep = spark.createDataFrame([("<u>" * 30_000 + '<b style="color:#555">x</b>',), ('<div class="c-trend-down">' + "<p>" * 30_000 + "idx",)], "h string")
    rows = deep.select(html.condition_segments(F.col("h")).alias("s"), html.trend_sign(F.col("h"), "idx").alias("t")).collect()
    assert [(x.text, x.color) for x in rows[0].s] == [("x", "muted")] and [r.t for r in rows] == [1, 1]


def test_nested_tables_and_rows(spark):
    page = "<table><tr><td>a<table><tr><td>in</td></tr></table></td><td>b</td></tr></table>"
    rows = html.table_after_heading(spark.createDataFrame([(page,)], "html string"), "html", None, ("x", "y")).collect()
    assert [(r.x, r.y) for r in rows] == [("ain", "in")]  # the cells inside a cell are the row's too


def test_broker_page(spark):
    body = '{"1515": {"buyers": [{"name": " A ", "net": 5000, "buyV": 6000, "sellV": 1000, "buyP": 12.50, "sellP": null}], "daytraders": [{"name": "D", "buyV": 1, "sellV": 1, "total": 2500}]}}'
    page = f'<script src="x"></script><script id="all-broker-data" type="application/json">{body}</script><script id="all-prices-data">oops</script>'
    df = spark.createDataFrame([(page,)], "html string")
    detail = df.select(F.explode(html.embedded_json(F.col("html"), "all-broker-data", brokers.BROKER_SCHEMA)).alias("code", "detail"))
    rows = brokers.format_rows(brokers.explode_sides(detail, "detail")).orderBy("side").collect()
    assert [(r.code, r.side, r.pos, r.broker, r.buyV, r.buyP, r.sellP, r.net, r.total) for r in rows] == [
        ("1515", "buyers", 1, "A", "6", "12.5", "—", "+5", None), ("1515", "daytraders", 1, "D", "0", "—", "—", None, "2"),
    ]
    assert df.select(html.embedded_json(F.col("html"), "all-prices-data", brokers.PRICE_SCHEMA).alias("m")).first().m == {}


def test_article_sections(spark):
    article = "一、目前沒有找到族群：\n2426.2851.5314.3441.\n\n二、目前有發現有族群：\n0\n\n《end"
    s = spark.range(1).select(text.group_sections(F.lit(article)).alias("s")).select(text.tokenize_list(F.col("s.not_found")).alias("a"), text.tokenize_list(F.col("s.found")).alias("b")).first()
    assert s.a == ["2426", "2851", "5314", "3441"] and s.b == []


def test_odd_markup_stops_nothing_and_open_cells_end_where_the_next_begins():
    from sessionlake.functions.html import _Page

    for odd in ("<![foo[", "<![>", "<![foo[ x > y", "<!", "<![CDATA[ a", "<a <b>", "</", "<table><tr><td>"):
        assert _Page(f"<p>one</p>{odd}").texts[0] == "one"
    page = _Page("<![if x]><table><tr><th>h<tr><td>a<td>b<table><tr><td>in</table><td>c</table><ul><li>x<li>y<ul><li>z</ul></ul>")
    rows = [[page.text(c) for c in range(r + 1, page.last[r] + 1) if page.tags[c] in ("td", "th") and page.parents[c] == r] for r in range(len(page.tags)) if page.tags[r] == "tr"]
    assert rows == [["h"], ["a", "bin", "c"], ["in"]]
    assert [page.text(n) for n, t in enumerate(page.tags) if t == "li"] == ["x", "yz", "z"]
    many = _Page("<table><tr>" + "<td>cell" * 8000 + "</table>")
    assert sum(len(many.text(n)) for n, t in enumerate(many.tags) if t == "td") == 8000 * 4


def test_pages_of_one_task_are_parsed_by_many(spark):
    """Rows of one partition are dealt out before they are parsed; columns of all kinds come through, null ones too."""
    rows = [(n, None if n % 2 else datetime(2024, 1, 1), [n], f"<table><tr><td>{n}</td><td title='t'>b</td></tr></table>" if n % 5 else "no list") for n in range(400)]
    pages = spark.createDataFrame(rows, "n int, ts timestamp_ntz, ns array<int>, html string").coalesce(1)
    got = html.table_after_heading(pages, "html", None, ("a", "b")).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.n, r.ts, r.ns, r.a, r.b, r.cells[1].title, r.row_pos) for r in got if r.ts) == [(n, ts, ns, str(n), "b", "t", 0) for n, ts, ns, page in rows if n % 5 and ts]
    assert len(got) == 320 and len({r.task for r in got}) > 4
