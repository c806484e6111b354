"""Queries of broker detail and of token matching.

A trade is a row of ``lineitem``: the part is the stock, the supplier the
broker, return flag R sells; the shipping month is the date.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import brokers, matching
from .base import Tables, query


def _trades(t: Tables):
    return t.lineitem.select(
        F.date_format("l_shipdate", "yyyy").alias("date"), F.col("l_partkey").alias("code"), F.col("l_suppkey").alias("broker"),
        (F.col("l_returnflag") == "R").alias("is_sell"), F.col("l_quantity").cast("long").alias("volume"),
    )


@query("""WITH s AS (SELECT strftime(l_shipdate, '%Y') AS date, l_partkey AS code, l_suppkey AS broker, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END)::BIGINT AS buyV,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::BIGINT AS sellV FROM lineitem GROUP BY 1, 2, 3),
n AS (SELECT *, buyV - sellV AS net FROM s),
r AS (SELECT *, CASE WHEN net >= 0 THEN 'buyers' ELSE 'sellers' END AS side, abs(net) AS weight, 15 AS most FROM n
  UNION ALL SELECT *, 'daytraders', least(buyV, sellV), 10 FROM n WHERE buyV > 0 AND sellV > 0)
SELECT date, code, side, row_number() OVER (PARTITION BY date, code, side ORDER BY weight DESC, broker) AS pos, broker, buyV, sellV, net FROM r QUALIFY pos <= most""")
def W02_top_brokers(t: Tables):
    return brokers.top_brokers(_trades(t), ["date", "code"])


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos FROM lineitem)
SELECT l_orderkey, 'buyers' AS side, pos, l_suppkey::VARCHAR AS broker, format('{:,.0f}', q * 1000 / 1000.0::DOUBLE) AS buyV, CASE WHEN q >= 0 THEN '+' ELSE '' END || format('{:,.0f}', q * 1000 / 1000.0::DOUBLE) AS net FROM n WHERE pos <= 15""")
def W02_explode_sides(t: Tables):
    line = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey",
        F.struct(F.concat(F.lit(" "), "l_suppkey").alias("name"), (F.col("l_quantity").cast("long") * 1000).alias("net"), (F.col("l_quantity").cast("long") * 1000).alias("buyV"), F.lit(0).cast("long").alias("sellV"), F.lit(1.5).alias("buyP"), F.lit(None).cast("double").alias("sellP"), F.lit(None).cast("long").alias("total")).alias("x"),
    )
    nested = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(line)), lambda r: r["x"]).alias("buyers"))
    detail = nested.select("l_orderkey", F.struct("buyers", F.array().cast(nested.schema["buyers"].dataType).alias("sellers"), F.lit(None).cast(nested.schema["buyers"].dataType).alias("daytraders")).alias("detail"))
    rows = brokers.explode_sides(detail, "detail")
    return brokers.format_rows(rows).select("l_orderkey", "side", "pos", "broker", "buyV", "net")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_retailprice, p_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 20) ON l_partkey = p_partkey", l_linenumber="BIGINT")
def J01_broker_with_prices(t: Tables):
    broker = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("code"))
    prices = t.part.filter("p_size > 20").select(F.col("p_partkey").alias("code"), "p_retailprice", "p_name")
    return brokers.broker_with_prices(broker, prices, ["code"]).withColumnRenamed("code", "l_partkey")


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1", l_linenumber="BIGINT")
def W01_first_per_key(t: Tables):
    return brokers.first_per_key(t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"), ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"])


_MATCHED = "SELECT strftime(l_shipdate, '%Y') AS date, l_partkey AS code, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS list_no FROM lineitem"
_CANDIDATES = f"SELECT date, code, min_by(list_no, list_no * 1000000000 + pos) AS list_no, min_by(pos, list_no * 1000000000 + pos) AS pos FROM ({_MATCHED}) GROUP BY 1, 2"


def _candidates(t: Tables):
    rows = t.lineitem.select(F.date_format("l_shipdate", "yyyy").alias("date"), F.col("l_partkey").alias("code"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "l_returnflag")
    return brokers.candidates(rows.filter("l_returnflag = 'R'").drop("l_returnflag"), rows.filter("l_returnflag != 'R'").drop("l_returnflag"))


@query(_CANDIDATES, list_no="BIGINT")
def U01_candidates(t: Tables):
    return _candidates(t).select("date", "code", "list_no", "pos")


@query(f"""SELECT c.date, c.code, CASE WHEN p_size % 4 = 0 THEN c.code::VARCHAR WHEN p_size % 4 = 1 THEN 'row ' || c.code ELSE p_name END AS name, p_retailprice
FROM ({_CANDIDATES}) c JOIN part ON c.code = p_partkey WHERE p_size > 10""")
def J05_institutional_detail(t: Tables):
    rows = _candidates(t).join(t.part.select(F.col("p_partkey").alias("code"), F.col("p_size").alias("s")), "code").withColumn("name", F.when(F.col("s") % 4 == 1, F.concat(F.lit("row "), "code")).otherwise(""))
    detail = t.part.filter("p_size > 10").select(F.col("p_partkey").alias("code"), F.when(F.col("p_size") % 4 > 0, F.col("p_name")).alias("name"), "p_retailprice")
    return brokers.institutional_detail(rows, detail, keys=("code",)).select("date", "code", "name", "p_retailprice")


@query(f"SELECT c.date, CASE WHEN c.date >= '1997' THEN count(*) ELSE 0 END AS candidate_count, CASE WHEN c.date >= '1997' THEN count(p_partkey) ELSE 0 END AS matched_count FROM ({_CANDIDATES}) c LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON c.code = p_partkey GROUP BY c.date")
def A06_detail_counts(t: Tables):
    found = _candidates(t)
    stocks = t.part.filter("p_size > 10").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"))
    detail = found.filter("date >= '1997'").join(stocks, "code").select("date", "code", "name")  # no detail before that year
    return brokers.detail_counts(found, brokers.institutional_detail(found.withColumn("name", F.lit("")), detail), detail)


def _rows(t: Tables):
    return t.part.select(F.col("p_brand").alias("date"), F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"), F.col("p_partkey").alias("row_pos"))


def _tokens(t: Tables):
    token = F.when(F.col("p_size") % 3 == 0, F.col("p_partkey").cast("string")).when(F.col("p_size") % 3 == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit("?")))
    return t.part.select(F.col("p_brand").alias("date"), F.col("p_partkey").alias("pos"), token.alias("token"))


_TOKENS = "SELECT p_brand AS date, p_partkey AS pos, CASE p_size % 3 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN p_name ELSE p_name || '?' END AS token FROM part"
_STAGES = f"""
WITH t AS ({_TOKENS}), c AS (SELECT p_brand AS date, p_partkey::VARCHAR AS token, min(p_partkey) AS row_pos FROM part GROUP BY 1, 2), n AS (SELECT p_brand AS date, p_name AS token, min(p_partkey) AS row_pos FROM part GROUP BY 1, 2),
m AS (SELECT t.*, CASE WHEN c.row_pos IS NOT NULL THEN 'code' WHEN n.row_pos IS NOT NULL THEN 'name' END AS match_type, coalesce(c.row_pos, n.row_pos) AS row_pos FROM t LEFT JOIN c USING (date, token) LEFT JOIN n USING (date, token))
"""


@query(_STAGES + "SELECT date, pos, token, match_type, row_pos FROM m")
def J02_match_tokens(t: Tables):
    return matching.match_tokens(_tokens(t), _rows(t), fuzzy=False).select("date", "pos", "token", "match_type", F.col("row_row_pos").alias("row_pos"))


@query()
def J02_match_tokens_fuzzy(t: Tables):
    return matching.match_tokens(_tokens(t), _rows(t)).select("date", "pos", "token", "match_type", F.col("row_row_pos").alias("row_pos"))


@query()
def J03_fuzzy_names(t: Tables):
    """Part names with their third letter changed, against the names of the same brand."""
    typo = F.concat(F.substring("p_name", 1, 2), F.lit("x"), F.substring("p_name", F.lit(4), F.length("p_name")))
    tokens = t.part.select(F.col("p_brand").alias("date"), typo.alias("token"))
    return matching.fuzzy_names(tokens, _rows(t))


@query(_STAGES + "SELECT date, pos, token FROM m WHERE match_type IS NULL")
def J04_unmatched(t: Tables):
    return matching.unmatched(_tokens(t), _rows(t)).select("date", "pos", "token")


@query(_STAGES + "SELECT date, count(*) AS raw, count(match_type) AS matched, count(*) - count(match_type) AS unmatched, count(DISTINCT row_pos) AS candidates FROM m GROUP BY date")
def A06_match_counts(t: Tables):
    return matching.match_counts(matching.match_tokens(_tokens(t), _rows(t), fuzzy=False))
