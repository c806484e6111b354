"""Queries of quotes: vendor records, fallback, aliases, sources, institutional flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quotes
from .base import Tables, query


@query("""SELECT event_id, 'numeric' AS provider, price, change, change_pct, format('{:.2f}', price - change)::DOUBLE AS prev_close, open, high, low, volume FROM (
SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END, 0), value + 5) AS price, CASE WHEN event_id % 4 > 0 THEN value / 8 ELSE 0 END AS change,
CASE WHEN event_id % 4 > 0 THEN user_id * 0.5::DOUBLE ELSE 0 END AS change_pct, user_id AS volume,
coalesce(CASE WHEN event_id % 5 > 0 THEN nullif(value - 1, 0) END, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END, 0), value + 5)) AS open, value + 7 AS high,
coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END, 0), value + 5) AS low FROM events)""")
def X19_normalize_provider(t: Tables):
    record = t.events.select(
        "event_id", F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value")).alias("close"), (F.col("value") + 5).alias("price"), F.lit(1.0).alias("settlement_price"),
        F.when(F.col("event_id") % 5 > 0, F.col("value") - 1).alias("open"), (F.col("value") + 7).alias("high"), F.lit(None).cast("double").alias("low"),
        F.when(F.col("event_id") % 4 > 0, F.col("value") / 8).alias("change"), F.when(F.col("event_id") % 4 > 0, F.col("user_id") * 0.5).alias("change_rate"), F.col("user_id").alias("volume"),
    )
    return quotes.normalize_numeric(record, "numeric").select("event_id", "provider", "price", "change", "change_pct", "prev_close", "open", "high", "low", "volume")


@query("""SELECT o_orderkey, 'text' AS provider, o_totalprice AS price, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN -1 WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 1 ELSE -1 END * (o_custkey + 1) AS change,
CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 0.5 ELSE -0.5 END ELSE -0.5 END AS change_pct, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey * 1000 END AS volume FROM orders""", change="DOUBLE", change_pct="DOUBLE")
def X19_normalize_text_provider(t: Tables):
    sign = F.when(F.col("o_custkey") % 2 == 0, "").otherwise("-")
    record = t.orders.select(
        "o_orderkey", F.format_number("o_totalprice", 2).alias("CLastPrice"), F.concat(sign, F.format_number(F.col("o_custkey") + 1, 2)).alias("CDiff"),
        F.when(F.col("o_orderkey") % 3 == 0, "0.5").otherwise("-0.50").alias("CDiffRate"), F.when(F.col("o_orderkey") % 5 > 0, F.format_number(F.col("o_orderkey") * 1000, 0)).otherwise("--").alias("CTotalVolume"),
    )
    fields = {"price": "CLastPrice", "change": "CDiff", "change_pct": "CDiffRate", "volume": "CTotalVolume"}
    return quotes.normalize_text(record, "text", fields).select("o_orderkey", "provider", "price", "change", "change_pct", "volume")


@query("""SELECT event_id, CASE WHEN ok THEN format('{:.2f}', value)::DOUBLE END AS value, CASE WHEN ok THEN format('{:.2f}', value - user_id)::DOUBLE END AS change,
CASE WHEN ok AND user_id = 0 THEN 0.0 WHEN ok THEN format('{:.2f}', (value - user_id) / user_id * 100)::DOUBLE END AS change_pct, NOT ok AS is_missing FROM (SELECT *, event_id % 6 NOT IN (0, 1) AS ok FROM events)""")
def X20_quote_from_chart(t: Tables):
    price = F.when(F.col("event_id") % 6 == 0, "null").otherwise(F.col("value").cast("string"))
    chart = F.concat(F.lit('{"chart": {"result": [{"meta": {"regularMarketPrice": '), price, F.lit(', "chartPreviousClose": '), "user_id", F.lit('}, "timestamp": [1]}], "error": null}}'))
    document = F.when(F.col("event_id") % 6 == 1, '{"chart": {"result": null}}').otherwise(chart)
    return t.events.select("event_id", quotes.quote_from_chart(document).alias("q")).select("event_id", "q.*")


@query("SELECT c_custkey, a.alias, c_acctbal AS value, c_acctbal AS price FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (VALUES ('NATION_1', 'one'), ('NATION_1', '^N1'), ('NATION_7', 'seven')) a(n_name, alias) USING (n_name)")
def J08_with_aliases(t: Tables):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("key"), F.col("c_acctbal").alias("value"))
    return quotes.with_aliases(rows, {"NATION_1": ("one", "^N1"), "NATION_7": ("seven",)}).select("c_custkey", "alias", "value", "price")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_totalprice ELSE -o_totalprice END AS value, CASE WHEN o_totalprice > 200000 THEN 'a' ELSE 'b' END AS origin FROM orders WHERE o_totalprice > 200000 OR o_orderstatus <> 'P'")
def J09_prefer_source(t: Tables):
    a = t.orders.filter("o_totalprice > 200000").select("o_orderkey", F.col("o_totalprice").alias("value"), F.lit("a").alias("origin"))
    b = t.orders.filter("o_orderstatus != 'P'").select("o_orderkey", (-F.col("o_totalprice")).alias("value"), F.lit("b").alias("origin"))
    return quotes.prefer_source(a, b, ["o_orderkey"])


@query("""WITH r AS (SELECT user_id, date_trunc('hour', ts) AS tick, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS rank, event_type AS provider, event_id,
  CASE WHEN event_id % 3 > 0 THEN value END AS price FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, tick ORDER BY price IS NULL, rank, event_id) AS n FROM r)
SELECT user_id, strftime(tick, '%Y-%m-%d %H:%M:%S') AS tick, CASE WHEN price IS NULL THEN 'fixture' ELSE provider END AS provider, coalesce(price, 45203.0) AS price, event_id, price IS NULL AS is_fallback FROM b WHERE n = 1""")
def J10_first_available(t: Tables):
    records = t.events.select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("tick"), F.col("event_type").alias("provider"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("price"), "event_id")
    return quotes.first_available(records, ["user_id", "tick"], order=("click", "view", "purchase"), preferred="view", tie="event_id")


@query("""WITH r AS (SELECT user_id, date_trunc('hour', ts) AS tick, event_type AS provider, event_id, ts, CASE WHEN event_id % 3 > 0 THEN value END AS price FROM events),
b AS (SELECT user_id, tick, min(provider) FILTER (WHERE price IS NOT NULL) AS p, arg_min(price, (provider, event_id)) FILTER (WHERE price IS NOT NULL) AS price FROM r GROUP BY 1, 2),
s AS (SELECT user_id, arg_max(value, (ts, event_id)) AS saved FROM events WHERE event_id % 5 = 0 GROUP BY 1)
SELECT user_id, strftime(tick, '%Y-%m-%d %H:%M:%S') AS tick, coalesce(p, 'fixture') AS provider, coalesce(price, saved, 45203.0) AS price, price IS NULL AS is_fallback FROM b LEFT JOIN s USING (user_id)""")
def J10_first_available_saved(t: Tables):
    """Keys without any price take the user's last saved record: every fifth event."""
    records = t.events.select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("tick"), F.col("event_type").alias("provider"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("price"), "event_id")
    saved = t.events.filter("event_id % 5 = 0").select("user_id", F.col("value").alias("price"), F.struct("ts", "event_id").alias("collected_at"))
    picked = quotes.first_available(records, ["user_id", "tick"], order=("click", "error", "purchase", "signup", "view"), tie="event_id", saved=saved, saved_keys=["user_id"])
    return picked.select("user_id", "tick", "provider", "price", "is_fallback")


@query("""WITH c AS (SELECT p_brand, p_partkey AS pos, p_name AS name, (p_size % 2)::VARCHAR AS market_type, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice::VARCHAR ELSE '' END AS last_price
  FROM part WHERE p_partkey % 4 < 3 AND contains(p_name, 'e')),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY p_brand, market_type ORDER BY pos) = 1)
SELECT p_brand, pos, market_type, last_price FROM f WHERE last_price <> '' QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY market_type DESC) = 1""")
def P06_pick_contract(t: Tables):
    quotes_list = t.part.select(
        "p_brand", F.col("p_partkey").alias("pos"), F.concat("p_type", F.when(F.col("p_partkey") % 4 < 3, "-M").otherwise("-F")).alias("symbol"), F.col("p_name").alias("name"),
        (F.col("p_size") % 2).cast("string").alias("market_type"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice").cast("string")).otherwise("").alias("last_price"),
    )
    return quotes.pick_contract(quotes_list, by=["p_brand"], name_part="e").select("p_brand", "pos", "market_type", "last_price")


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS date,
CASE WHEN count(*) FILTER (o_orderpriority = '1-URGENT') > 0 THEN format('{:.2f}', (last(v ORDER BY o_orderkey) FILTER (o_orderpriority = '1-URGENT')) / 1e4)::DOUBLE END AS "foreign",
CASE WHEN count(*) FILTER (o_orderpriority = '2-HIGH') > 0 THEN format('{:.2f}', (last(v ORDER BY o_orderkey) FILTER (o_orderpriority = '2-HIGH')) / 1e4)::DOUBLE END AS trust,
CASE WHEN count(*) FILTER (o_orderpriority IN ('3-MEDIUM', '5-LOW')) > 0 THEN format('{:.2f}', (sum(v) FILTER (o_orderpriority IN ('3-MEDIUM', '5-LOW'))) / 1e4)::DOUBLE END AS dealer
FROM (SELECT *, floor(o_totalprice)::BIGINT * CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END AS v FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1""")
def A03_institutional_flows(t: Tables):
    kind = F.col("o_orderpriority")
    name = F.when(kind == "1-URGENT", "外資及陸資(不含外資自營商)").when(kind == "2-HIGH", "投信").when(kind == "3-MEDIUM", "自營商(自行買賣)").when(kind == "5-LOW", "自營商(避險)").otherwise("合計")
    net = F.concat(F.when(F.col("o_custkey") % 2 == 0, "").otherwise("-"), F.format_number(F.floor("o_totalprice"), 0))
    rows = t.orders.select(
        F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "P", "no data").otherwise("OK").alias("stat"), F.col("o_orderkey").alias("pos"),
        F.array(name, F.lit("1,000"), F.lit("2,000"), net).alias("row"),
    )
    return quotes.institutional_flows(rows, unit=1e4)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW'")
def A09_missing_fields(t: Tables):
    have = t.orders.filter("o_orderstatus != 'P'").select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("value"))
    return quotes.missing_fields(have, t.orders.select("o_orderkey"), ["o_orderkey"], "value")
