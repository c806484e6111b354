"""Queries of text and page extraction, numbers, and rules.

The tables hold invented prose in Latin script, so rules and labels are given
as arguments; pages and lists are built from columns around the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, keywords, numbers, text
from .base import Tables, query

_WS = r"[\x20\x09-\x0D]"


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', chr(10), 'g')) AS text_md5 FROM pages")
def X01_html_to_text(t: Tables):
    return t.pages.select("page_id", F.md5(html.html_to_text(F.col("html"))).alias("text_md5"))


@query("SELECT page_id, md5(html || '<p>kept</p>' || html) AS html_md5 FROM pages")
def X02_strip_trackers(t: Tables):
    ads = '<script async src="//x/adsbygoogle.js">a\nb</script><LINK rel="manifest" href="m"><p>kept</p><ins class="adsbygoogle">ad</ins><iframe src="//doubleclick.net/x">y</iframe>'
    return t.pages.select("page_id", F.md5(html.strip_trackers(F.concat("html", F.lit(ads), "html"))).alias("html_md5"))


def _part_pages(t: Tables):
    """One page per part: a near-restricted list of one row, with a detail row that has fewer cells; dealt to all cores, which parse them."""
    td = lambda c, more="": F.concat(F.lit(f"<td{more}>"), c, F.lit("</td>"))
    condition = F.concat(F.lit('<td><span style="color:#e74c3c">'), "p_type", F.lit('</span><b style="color:#FFF">met</b></td>'))
    badge = F.concat(F.lit('<td><div title="run '), F.col("p_size") % 5, F.lit("/5\"></div></td>"))
    page = F.concat(
        F.lit("<html><body><p>intro</p><table><tr><td>other</td></tr></table><div>&#128308; near list (1)</div><table><thead><tr><th>h</th></tr></thead><tbody><tr>"),
        td(F.col("p_brand")), td(F.col("p_partkey").cast("string")), td(F.concat(F.lit(" "), "p_name", F.lit(" "))), td(F.col("p_size").cast("string")), condition,
        td(F.concat(F.lit("08-25 "), "p_type")), badge, badge, badge, badge, F.lit("</tr><tr><td colspan=10>detail</td></tr></tbody></table></body></html>"),
    )
    return t.part.repartition(t.spark.sparkContext.defaultParallelism).select("p_partkey", page.alias("html"))


@query("SELECT p_partkey, 0 AS row_pos, p_brand AS market, p_partkey::VARCHAR AS code, p_name AS name, p_size::VARCHAR AS close, p_type || 'met' AS condition, '08-25 ' || p_type AS earliest_disposal FROM part", row_pos="BIGINT")
def X03_table_after_heading(t: Tables):
    return html.table_after_heading(_part_pages(t), "html", "near list", html.NEAR_COLUMNS).drop("cells")


@query("""SELECT p_partkey, 'near list' AS heading, 0 AS row_pos, p_brand AS first, 10 AS n_cells FROM part UNION ALL SELECT p_partkey, 'intro', 0, 'other', 1 FROM part
UNION ALL SELECT p_partkey, 'far list', n, 'far ' || n || ' ' || p_name, 2 FROM part, (VALUES (0), (1)) r(n)""", row_pos="BIGINT", n_cells="BIGINT")
def X03_tables_after_headings(t: Tables):
    """Three lists of one page, from one parse."""
    far = F.concat(F.lit("<h2>far list</h2><table><tr><td>far 0 "), "p_name", F.lit("<td>x<tr><td>far 1 "), "p_name", F.lit("<td>y</table>"))
    pages = _part_pages(t).join(t.part.select("p_partkey", far.alias("far")), "p_partkey").select("p_partkey", F.concat("html", "far").alias("html"))
    rows = html.tables_after_headings(pages, "html", {"near list": 6, "intro": 1, "far list": 2})
    return rows.select("p_partkey", "heading", "row_pos", F.col("cells")[0]["text"].alias("first"), F.size("cells").alias("n_cells"))


@query("SELECT p_partkey, 0 AS row_pos, p_brand AS market, p_name AS code FROM part", row_pos="BIGINT")
def X04_first_table(t: Tables):
    page = F.concat(F.lit('<select id="date-picker"><option>2026/08/20</option></select><TABLE><tr><td>'), "p_brand", F.lit("</td><td>"), "p_name", F.lit("</td></tr></table>"))
    return html.table_after_heading(t.part.select("p_partkey", page.alias("html")), "html", None, ("market", "code")).drop("cells")


@query("""SELECT p_partkey, b.n AS n, 'run ' || (p_size % 5) || '/5' AS title, p_size % 5 AS current, 5 AS threshold, (p_size % 5) * 20.0::DOUBLE AS progress
FROM part, (VALUES (0), (1), (2), (3)) b(n)""", n="BIGINT", current="BIGINT", threshold="BIGINT")
def X05_badge_progress(t: Tables):
    rows = html.table_after_heading(_part_pages(t), "html", "near list", html.NEAR_COLUMNS)
    marked = rows.select("p_partkey", F.posexplode(html.badges(F.col("cells"))).alias("n", "b"))
    progress = text.badge_progress(F.col("b.title"))
    return marked.select("p_partkey", "n", "b.title", "b.current", "b.threshold", progress["progress"].alias("progress"))


@query("""SELECT p_partkey, 0 AS n, p_type AS text, 'rise' AS color, false AS bold FROM part UNION ALL SELECT p_partkey, 1, 'met', 'text', true FROM part""", n="BIGINT")
def X06_condition_segments(t: Tables):
    cell = F.concat(F.lit('<span style="color:#e74c3c">'), "p_type", F.lit('</span><b style="color:#FFF">met</b>'))
    return t.part.select("p_partkey", F.posexplode(html.condition_segments(cell)).alias("n", "s")).select("p_partkey", "n", "s.text", "s.color", "s.bold")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%m/%d') AS applies_to, strftime(o_orderdate, '%Y/%m/%d') AS selected, strftime(o_orderdate, '%Y/%m/%d') AS listed FROM orders""")
def X07_page_date(t: Tables):
    day = F.date_format("o_orderdate", "yyyy/MM/dd")
    page = F.concat(F.lit("<p>適用 "), F.date_format("o_orderdate", "MM/dd"), F.lit(" 交易日</p><select><option>1999/01/01</option><option value=x selected> "), day, F.lit(" </option></select>"))
    return t.orders.select("o_orderkey", html.page_date(page).alias("d")).select("o_orderkey", "d.*")


_QUOTES = "SELECT o_orderkey, o_orderkey * 1000 + 0.25::DOUBLE AS value, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END * (o_custkey + 0.5::DOUBLE) AS change, 0.75::DOUBLE AS change_pct"


@query(_QUOTES + ", NULL::VARCHAR AS updated, 'markets' AS layout FROM orders UNION ALL " + _QUOTES + ", strftime(o_orderdate, '%m/%d %H:%M') AS updated, 'world' AS layout FROM orders")
def X08_labelled_quote(t: Tables):
    value = F.concat(F.format_number(F.col("o_orderkey") * 1000, 0), F.lit(".25"))
    diff = F.concat(F.when(F.col("o_custkey") % 2 == 0, "").otherwise("-"), "o_custkey", F.lit(".5"))
    markets = F.concat(F.lit("noise\nIndex (A)\n\n"), value, F.lit("\n"), diff, F.lit("\n(0.75%)\nmore"))
    world = F.concat(F.lit("Index (A)\n^SYM\n"), value, F.lit("\n"), diff, F.lit("\n0.75%\n6,680.34\n301,744\n"), F.date_format("o_orderdate", "MM/dd HH:mm"), F.lit("\nend"))
    read = lambda c, layout: t.orders.select("o_orderkey", html.labelled_quote(c, "Index (A)", layout).alias("q"), F.lit(layout).alias("layout"))
    return read(markets, "markets").unionByName(read(world, "world")).select("o_orderkey", "q.*", "layout")


_PLACED = "SELECT o_orderkey, k.n AS n, (o_custkey + 7 * k.n) % 30 AS label, o_orderkey * 10 + k.n + 0.25::DOUBLE AS value, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END * (k.n + 0.5::DOUBLE) AS change, strftime(o_orderdate, '%m/%d %H:%M') AS seen FROM orders, (VALUES (0), (1), (2)) k(n)"


@query(f"""SELECT o_orderkey, n_nationkey AS key, 'Index ' || n_nationkey AS label, layout, value, change, 0.75::DOUBLE AS change_pct, CASE WHEN layout = 'world' THEN seen END AS updated
FROM ({_PLACED}) p JOIN nation ON p.label = n_nationkey JOIN (VALUES ('markets', 0), ('world', 1)) l(layout, odd) ON p.n % 2 = odd""")
def X08_labelled_quotes(t: Tables):
    """Three of thirty labels on every page, two in one layout and one in the other; 25 of them are wanted."""
    blocks = []
    for n in range(3):
        value = F.concat((F.col("o_orderkey") * 10 + n).cast("string"), F.lit(".25"))
        diff = F.concat(F.when(F.col("o_custkey") % 2 == 0, "").otherwise("-"), F.lit(f"{n}.5"))
        label = F.concat(F.lit("Index "), (F.col("o_custkey") + 7 * n) % 30)
        markets = F.concat(label, F.lit("\n\n"), value, F.lit("\n"), diff, F.lit("\n(0.75%)\nmore\n"))
        world = F.concat(F.lit("  "), label, F.lit(" \n^SYM\n"), value, F.lit("\n"), diff, F.lit("\n0.75%\n6,680.34\n"), F.date_format("o_orderdate", "MM/dd HH:mm"), F.lit("\n"))
        blocks.append(world if n % 2 else markets)
    pages = t.orders.select("o_orderkey", F.concat(F.lit("noise\n"), *blocks).alias("page"))
    layouts = F.explode(F.array(*[F.lit(layout) for layout in html.QUOTE_LAYOUTS]))
    targets = t.nation.select(F.col("n_nationkey").alias("key"), F.concat(F.lit("Index "), "n_nationkey").alias("label"), layouts.alias("layout"))
    return html.labelled_quotes(pages, "page", targets, ["o_orderkey"])


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN -1 ELSE 1 END AS sign FROM part", sign="BIGINT")
def X09_trend_sign(t: Tables):
    cls = F.when(F.col("p_size") % 3 == 0, "c-trend-down").when(F.col("p_size") % 3 == 1, "c-trend-up").otherwise("flat")
    page = F.concat(F.lit('<ul><li class="a"><a><span>'), "p_name", F.lit(' index</span></a><b class="x '), cls, F.lit('">1.5</b></li></ul>'))
    return t.part.select("p_partkey", html.trend_sign(page, " index").alias("sign"))


@query("SELECT o_orderkey, o_orderkey + 0.25::DOUBLE AS value, (o_custkey + 0.5::DOUBLE) * sign AS change, 0.75::DOUBLE * sign AS change_pct FROM (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN -1 ELSE 1 END AS sign FROM orders)")
def X09_signed_quote(t: Tables):
    """The page's text has no signs; its trend class gives them."""
    cls = F.when(F.col("o_custkey") % 3 == 0, "c-trend-down").otherwise("c-trend-up")
    value, diff = F.concat("o_orderkey", F.lit(".25")), F.concat("o_custkey", F.lit(".5"))
    page = F.concat(F.lit('<ul><li class="'), cls, F.lit('"><b>Index (A)\n\n</b>'), value, F.lit("\n"), diff, F.lit("\n(0.75%)</li></ul>"))
    plain = html.labelled_quote(F.regexp_replace(page, "<[^>]+>", ""), "Index (A)", "markets")
    rows = t.orders.repartition(t.spark.sparkContext.defaultParallelism).select("o_orderkey", page.alias("html"), plain.alias("q"))
    return rows.select("o_orderkey", html.signed_quote(F.col("html"), F.col("q"), "Index (A)").alias("s")).select("o_orderkey", "s.value", "s.change", "s.change_pct")


@query("SELECT p_partkey, p_partkey || '.' || p_size AS not_found, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '0' END AS found FROM part")
def X10_group_sections(t: Tables):
    second = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("0")
    heading = F.when(F.col("p_size") % 2 == 0, "二、目前有發現有族群：").otherwise("二，目前發現族群:")
    article = F.concat(F.lit("前言\n一、目前沒有找到族群： \n"), "p_partkey", F.lit("."), "p_size", F.lit("\n\n"), heading, F.lit("\n"), second, F.lit("\n\n《完》"))
    return t.part.select("p_partkey", text.group_sections(article).alias("s")).select("p_partkey", "s.*")


@query(r"""SELECT doc_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, '|')) AS tokens_md5
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.．,，、\s]+'), lambda x: x <> '') AS tokens FROM documents)""")
def X11_tokenize_list(t: Tables):
    tokens = text.tokenize_list(F.col("text"))
    return t.documents.select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", "|")).alias("tokens_md5"))


@query(r"""SELECT doc_id, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ',') AS codes
FROM (SELECT doc_id, regexp_extract_all(text || ' 2330 (' || (1000 + doc_id % 5000) || ')', '\b(\d{4,5})\b', 1) AS c FROM documents)""")
def X12_stock_codes(t: Tables):
    said = F.concat("text", F.lit(" 2330 ("), 1000 + F.col("doc_id") % 5000, F.lit(")"))
    return t.documents.select("doc_id", F.array_join(text.stock_codes(said), ",").alias("codes"))


_TERMS = (("the", "THE"), ("and", "AND"), ("THEre", "there"), ("elle", "ELLE"), ("ción", "CION"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(text, 'the', 'THE'), 'and', 'AND'), 'THEre', 'there'), 'elle', 'ELLE'), 'ción', 'CION')) AS text_md5 FROM documents")
def X13_replace_terms(t: Tables):
    return t.documents.select("doc_id", F.md5(text.replace_terms(F.col("text"), _TERMS)).alias("text_md5"))


@query("SELECT page_id, url AS link, 'see  end' AS rest FROM pages")
def X14_extract_link(t: Tables):
    note = F.concat(F.lit("see chart: "), "url", F.lit(" end"))
    return t.pages.select("page_id", text.extract_link(note, "chart").alias("x")).select("page_id", "x.*")


@query("SELECT event_id, value || '%' AS forecast, CASE WHEN user_id % 2 = 0 THEN user_id::VARCHAR END AS previous, NULL::VARCHAR AS actual FROM events")
def X15_labelled_values(t: Tables):
    note = F.concat(F.lit("FORECAST: "), "value", F.lit("%\n"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("前值： "), "user_id", F.lit(",5; x"))).otherwise("none"), F.lit("\nactual - 3"))
    return t.events.select("event_id", text.labelled_values(note).alias("v")).select("event_id", "v.*")


@query("SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE text || ' - other' END) AS title_md5 FROM documents")
def X16_clean_headline(t: Tables):
    title = F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" - "), "source")).otherwise(" - other"))
    return t.documents.select("doc_id", F.md5(text.clean_headline(title, F.col("source"))).alias("title_md5"))


@query("SELECT p_partkey, p_partkey::VARCHAR AS code, p_size % 2 = 0 AS paused FROM part")
def X17_clean_code(t: Tables):
    code = F.concat(F.when(F.col("p_size") % 2 == 0, "⏸ ").otherwise(""), "p_partkey")
    return t.part.select("p_partkey", text.clean_code(code).alias("c")).select("p_partkey", "c.*")


@query("SELECT p_partkey, '08-25' AS date, p_name AS label FROM part")
def X18_split_earliest(t: Tables):
    return t.part.select("p_partkey", text.split_earliest(F.concat(F.lit("08-25 "), "p_name")).alias("s")).select("p_partkey", "s.*")


_CENTS = "(o_totalprice * 100)::DECIMAL(18,0)::BIGINT"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END END AS number, o_orderkey * 1000 AS whole FROM orders")
def F01_parse_number(t: Tables):
    shown = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-"), F.format_number("o_totalprice", 2))
    number = F.when(F.col("o_orderkey") % 7 > 0, shown).otherwise("n/a")
    return t.orders.select("o_orderkey", numbers.parse_number(number).alias("number"), numbers.parse_int(F.format_number(F.col("o_orderkey") * 1000, 0)).alias("whole"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '—' WHEN o_orderkey % 5 = 1 THEN 'abc' ELSE format('{:,.2f}', o_totalprice) END AS num,
format('{:,.0f}', o_totalprice) AS whole, format('{:+.2f}', (o_custkey - 700) / 64.0::DOUBLE) || '%' AS pct FROM orders""")
def F02_fmt_num(t: Tables):
    value = F.when(F.col("o_orderkey") % 5 == 0, "NaN").when(F.col("o_orderkey") % 5 == 1, "abc").otherwise(F.col("o_totalprice").cast("string"))
    return t.orders.select("o_orderkey", numbers.fmt_num(value).alias("num"), numbers.fmt_num(F.col("o_totalprice"), 0).alias("whole"), numbers.fmt_pct((F.col("o_custkey") - 700) / 64.0).alias("pct"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, format('{:,.0f}', l_extendedprice / 1000.0::DOUBLE) AS lots,
CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END || format('{:,.0f}', (l_quantity * 1000 + 600) / 1000.0::DOUBLE) AS net, format('{:g}', l_extendedprice) AS price FROM lineitem""", l_linenumber="BIGINT")
def F03_fmt_lots(t: Tables):
    net = F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * (F.col("l_quantity") * 1000 + 600)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", numbers.fmt_lots(F.col("l_extendedprice")).alias("lots"), numbers.fmt_net_lots(net).alias("net"), numbers.fmt_broker_price(F.col("l_extendedprice")).alias("price")
    )


@query("""SELECT event_id, CASE WHEN p IS NOT NULL THEN format('{:.2f}', value - p)::DOUBLE END AS change,
CASE WHEN p = 0 THEN 0.0 WHEN p IS NOT NULL THEN format('{:.2f}', (value - p) / p * 100)::DOUBLE END AS change_pct
FROM (SELECT *, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS p FROM events)""")
def F04_change(t: Tables):
    from pyspark.sql import Window

    before = F.lag("value").over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id"))
    return t.events.select("event_id", "value", before.alias("p")).select("event_id", numbers.change(F.col("value"), F.col("p")).alias("c")).select("event_id", "c.*")


@query("""SELECT event_id, CASE WHEN p < 0 AND c > 0 THEN -c ELSE c END AS change, CASE WHEN p > 0 AND c < 0 THEN -p ELSE p END AS change_pct
FROM (SELECT event_id, value - 20 AS c, user_id - 75.0::DOUBLE AS p FROM events)""")
def F05_reconcile_sign(t: Tables):
    signs = numbers.reconcile_sign(F.col("value") - 20, F.col("user_id") - F.lit(75.0))
    return t.events.select("event_id", signs.alias("s")).select("event_id", "s.*")


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'pending' WHEN event_id % 10 = 1 THEN 'inline' WHEN abs(value - user_id) < 0.001 THEN 'inline' WHEN value > user_id THEN 'beat' ELSE 'miss' END AS comparison FROM events""")
def F10_surprise(t: Tables):
    actual = F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 10 == 1, "tba").otherwise(F.concat("value", F.lit(" %")))
    return t.events.select("event_id", numbers.surprise(actual, F.concat("user_id", F.lit("k"))).alias("comparison"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '20m' WHEN 1 THEN '5m' WHEN 2 THEN '20m' ELSE 'none' END AS tier FROM part")
def F11_matching_tier(t: Tables):
    kind = F.when(F.col("p_size") % 4 == 0, "第2次20分").when(F.col("p_size") % 4 == 1, "第1次5分").when(F.col("p_size") % 4 == 2, "全額 5分").otherwise("")
    return t.part.select("p_partkey", text.matching_tier(F.concat("p_name", kind)).alias("tier"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'rise' WHEN c_acctbal < 0 THEN 'fall' ELSE 'flat' END AS of_number, CASE WHEN c_acctbal < 0 THEN 'fall' ELSE 'rise' END AS of_text FROM customer")
def F12_direction(t: Tables):
    signed = F.concat(F.when(F.col("c_acctbal") < 0, "").otherwise("+"), F.format_number("c_acctbal", 2))
    return t.customer.select("c_custkey", numbers.direction(F.col("c_acctbal")).alias("of_number"), numbers.text_direction(signed).alias("of_text"))


_SCORES = ((3, ("THE", "ELLE")), (2, ("TION", "MENT", "xyz")))
_CLASSES = (("anglo", ("THE ", " AND ")), ("gallic", ("ELLE", "AUX")), ("hispanic", ("LLA", "QUE")))
_COUNTRIES = (("US", "u", "America/New_York", "ET", ("The ",)), ("FR", "f", "Europe/Paris", "CET", ("elle", "eaux")), ("ES", "e", "Europe/Madrid", "CET", ("mente",)))
_has = "(contains(upper(text), '{}'))::INTEGER"


@query("SELECT doc_id, 3 * (contains(u, 'THE')::INTEGER + contains(u, 'ELLE')::INTEGER) + 2 * (contains(u, 'TION')::INTEGER + contains(u, 'MENT')::INTEGER) AS score FROM (SELECT doc_id, upper(text) AS u FROM documents)", score="BIGINT")
def K01_keyword_score(t: Tables):
    return t.documents.select("doc_id", text.keyword_score(F.col("text"), _SCORES).alias("score"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUV"
#: Every word of three of these letters, 10,648 of them, in three rules by the first letter.
_MANY_RULES = tuple((n + 1, f"from {part[0]}", tuple(a + b + c for a in part for b in _LETTERS for c in _LETTERS)) for n, part in enumerate((_LETTERS[:8], _LETTERS[8:16], _LETTERS[16:])))


@query(f"""WITH g AS (SELECT DISTINCT doc_id, substr(u, i, 3) AS w FROM (SELECT doc_id, u, unnest(range(1, length(u) - 1)) AS i FROM (SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS u FROM documents))),
h AS (SELECT doc_id, CASE WHEN w < 'I' THEN 1 WHEN w < 'Q' THEN 2 ELSE 3 END AS n FROM g WHERE regexp_full_match(w, '[A-V]{{3}}'))
SELECT doc_id, coalesce(sum(n), 0)::BIGINT AS score, CASE min(n) WHEN 1 THEN 'from A' WHEN 2 THEN 'from I' WHEN 3 THEN 'from Q' ELSE 'other' END AS rule FROM documents LEFT JOIN h USING (doc_id) GROUP BY doc_id""")
def K01_rule_hits(t: Tables):
    """In upper case a sharp s is SS, as Unicode has it; the SQL says so itself."""
    return t.documents.select("doc_id", keywords.rule_hits(F.col("text"), _MANY_RULES, "other").alias("hit")).select("doc_id", "hit.*")


@query("SELECT doc_id, CASE WHEN contains(u, 'THE ') OR contains(u, ' AND ') THEN 'anglo' WHEN contains(u, 'ELLE') OR contains(u, 'AUX') THEN 'gallic' WHEN contains(u, 'LLA') OR contains(u, 'QUE') THEN 'hispanic' ELSE 'other' END AS category FROM (SELECT doc_id, upper(text) AS u FROM documents)")
def K02_first_rule(t: Tables):
    return t.documents.select("doc_id", text.first_rule(F.col("text"), _CLASSES).alias("category"))


@query("SELECT doc_id, CASE WHEN contains(text, 'The ') OR contains(upper(text), 'FED') THEN 'US' WHEN contains(text, 'elle') OR contains(text, 'eaux') THEN 'FR' WHEN contains(text, 'mente') THEN 'ES' ELSE 'GLOBAL' END AS country, CASE WHEN contains(text, 'The ') OR contains(upper(text), 'FED') THEN 'ET' WHEN contains(text, 'elle') OR contains(text, 'eaux') OR contains(text, 'mente') THEN 'CET' ELSE 'UTC' END AS label FROM documents")
def K03_country_of(t: Tables):
    found = text.country_of(F.col("text"), F.col("text"), _COUNTRIES, ("FED",))
    return t.documents.select("doc_id", found.alias("c")).select("doc_id", "c.country", "c.label")


@query("SELECT doc_id, CASE WHEN contains(u, 'LICENSE') OR contains(u, '@') THEN 3 WHEN contains(u, 'ELLE') THEN 2 ELSE 1 END AS importance FROM (SELECT doc_id, upper(text) AS u FROM documents)", importance="BIGINT")
def K04_importance_of(t: Tables):
    return t.documents.select("doc_id", text.importance_of(F.col("text"), ((3, ("LICENSE", "@")), (2, ("ELLE",)))).alias("importance"))
