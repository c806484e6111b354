"""Queries of surveillance lists and watchlists. Watched codes are customers, list entries are orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import days_left
from ..operators import watchlist
from ..operators.numbering import number_rows
from .base import Tables, query


def _restricted(t: Tables):
    raw = F.when(F.col("event_id") % 6 == 0, "出關").when(F.col("event_id") % 6 == 1, "0天").when(F.col("event_id") % 6 == 2, "").when(F.col("event_id") % 6 == 3, F.lit(None)).otherwise(F.concat("user_id", F.lit("天")))
    rows = t.events.select("event_id", F.to_date("ts").alias("date"), raw.alias("trading_days_text"))
    return watchlist.split_restricted(rows.withColumn("trading_days_left", days_left(F.col("trading_days_text"))))


_GROUP = "CASE WHEN event_id % 6 < 2 OR (event_id % 6 > 3 AND user_id = 0) THEN 'exiting' WHEN event_id % 6 < 4 THEN 'hidden' ELSE 'rest' END"


@query(f"SELECT event_id, {_GROUP} AS restricted_group FROM events")
def P04_split_restricted(t: Tables):
    return _restricted(t).select("event_id", "restricted_group")


@query(f"""SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) FILTER (event_type = 'error') AS one_away, count(*) FILTER ({_GROUP} = 'exiting') AS exiting,
count(*) FILTER (event_type = 'error') + count(*) FILTER ({_GROUP} = 'exiting') AS total, count(*) FILTER ({_GROUP} = 'hidden') AS hidden FROM events GROUP BY 1""")
def A04_alert_summary(t: Tables):
    near = t.events.filter("event_type = 'error'").select(F.to_date("ts").alias("date"))
    return watchlist.alert_summary(near, _restricted(t))


_LISTS = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 END"


@query(f"""SELECT c_custkey AS code, CASE WHEN r <= 2 THEN 'alert' WHEN r <= 4 THEN 'candidate' ELSE 'other' END AS watch_class
FROM customer LEFT JOIN (SELECT o_custkey, min({_LISTS}) AS r FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def J06_classify_watchlist(t: Tables):
    p = F.col("o_orderpriority")
    name = F.when(p == "1-URGENT", "one_away").when(p == "2-HIGH", "exiting").when(p == "3-MEDIUM", "found").when(p == "4-NOT SPECIFIED", "not_found").otherwise("elsewhere")
    listed = t.orders.select(F.col("o_custkey").alias("code"), name.alias("list_name"))
    return watchlist.classify_watchlist(t.customer.select(F.col("c_custkey").alias("code")), listed).select("code", "watch_class")


@query("SELECT o_orderkey, o_custkey AS code FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def J07_watch_only(t: Tables):
    watched = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("code"))
    return watchlist.watch_only(t.orders.select("o_orderkey", F.col("o_custkey").alias("code")), watched)


def _lists(t: Tables):
    orders = t.orders.select(F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 13).alias("code"), F.col("o_orderkey").alias("pos"), "o_orderstatus")
    return orders.filter("o_orderstatus = 'F'").drop("o_orderstatus"), orders.filter("o_orderstatus != 'F'").drop("o_orderstatus")


@query("""SELECT owner, code, min_by(list_no, k) AS list_no, min_by(pos, k) AS pos FROM (SELECT o_custkey AS owner, o_orderkey % 13 AS code, o_orderkey AS pos, CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS list_no,
CASE WHEN o_orderstatus <> 'F' THEN 1000000000000 ELSE 0 END + o_orderkey AS k FROM orders) GROUP BY 1, 2""", list_no="BIGINT")
def U02_merge_watchlist(t: Tables):
    return watchlist.merge_watchlist(*_lists(t))


@query("SELECT o_custkey AS owner, o_orderkey % 13 AS code, 1 AS list_no, min(o_orderkey) AS pos FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2", list_no="BIGINT")
def U02_replace_watchlist(t: Tables):
    return watchlist.merge_watchlist(*_lists(t), override=True)


@query("""WITH k AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN p_partkey * 1000.0 WHEN 2 THEN (p_size % 12 + 1) * 100.0 + 15 ELSE -p_size - 0.5 END AS number, CASE p_size % 4 WHEN 0 THEN p_name ELSE '' END AS text FROM part)
SELECT p_partkey, row_number() OVER (ORDER BY number NULLS LAST, text, p_partkey) - 1 AS place FROM k""")
def T04_typed_sort(t: Tables):
    s = F.col("p_size")
    month = F.lpad((s % 12 + 1).cast("string"), 2, "0")
    shown = F.when(s % 4 == 0, F.col("p_name")).when(s % 4 == 1, F.format_number(F.col("p_partkey") * 1000, 0)).when(s % 4 == 2, F.concat(month, F.lit("-15 late"))).otherwise(F.concat(F.lit("-"), s, F.lit(".5 pts")))
    rows = t.part.select("p_partkey", shown.alias("shown"))
    return number_rows(rows, *watchlist.typed_order("shown", tie="p_partkey"), name="place").select("p_partkey", "place")
