"""Broker detail per stock: nested pages to rows, ranks, and the join with matched stocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import fmt_broker_price, fmt_lots, fmt_net_lots

_TRADE = "name: string, net: bigint, buyV: bigint, sellV: bigint, buyP: double, sellP: double, total: bigint"
BROKER_SCHEMA = f"struct<buyers: array<struct<{_TRADE}>>, sellers: array<struct<{_TRADE}>>, daytraders: array<struct<{_TRADE}>>>"
PRICE_SCHEMA = "struct<close: double, flat: double, limitUp: string, name: string>"
SIDES = (("buyers", 15), ("sellers", 15), ("daytraders", 10))
#: Trades that a task should sum, and tasks that the brokers of one stock are dealt to.
TASK_ROWS, SLOTS = 250_000, 8


def explode_sides(df: DataFrame, detail: str, sides: Sequence[tuple[str, int]] = SIDES) -> DataFrame:
    """One row per broker of the nested lists, each list cut to its first entries before it is exploded.

    Adds side, pos (from 1), broker, net, buyV, sellV, buyP, sellP, total.
    """
    kept = [c for c in df.columns if c != detail]
    one = lambda side, n: F.transform(F.slice(F.coalesce(F.col(f"{detail}.{side}"), F.array()), 1, n), lambda x, i: F.struct(F.lit(side).alias("side"), (i + 1).alias("pos"), x.alias("x")))
    rows = df.select(*kept, F.explode(F.concat(*[one(s, n) for s, n in sides])).alias("_r"))
    return rows.select(*kept, "_r.side", "_r.pos", F.trim("_r.x.name").alias("broker"), *[F.col(f"_r.x.{c}").alias(c) for c in ("net", "buyV", "sellV", "buyP", "sellP", "total")])


def top_brokers(trades: DataFrame, keys: Sequence[str], n_side: int = 15, n_day: int = 10) -> DataFrame:
    """W02 from raw trades (keys, broker, is_sell, volume): top buyers, sellers and day-traders of each stock.

    Trades are summed per broker first, then ranked: buyers have a net of at
    least zero and sellers one below, both by the size of the net;
    day-traders both buy and sell and rank by the smaller side. Ties by broker.

    The trades are counted and dealt to so many tasks that each gets about
    TASK_ROWS; there are nearly as many sums as trades, so none are made before
    the shuffle. The brokers of a stock are dealt to SLOTS tasks, ranked
    there, and only the first of each meet. The trades of one broker in one stock
    are summed by one task, which holds one row for them.
    """
    spark, most = trades.sparkSession, max(n_side, n_day)
    tasks = max(spark.sparkContext.defaultParallelism, -(-trades.count() // TASK_ROWS))
    dealt = trades.withColumn("_slot", F.pmod(F.xxhash64("broker"), F.lit(SLOTS)).cast("int")).repartition(tasks, *keys, "_slot")
    sums = dealt.groupBy(*keys, "_slot", "broker").agg(
        F.sum(F.when(~F.col("is_sell"), F.col("volume")).otherwise(0)).alias("buyV"), F.sum(F.when(F.col("is_sell"), F.col("volume")).otherwise(0)).alias("sellV")
    ).withColumn("net", F.col("buyV") - F.col("sellV"))
    roles = F.array_compact(F.array(
        F.when(F.col("net") >= 0, F.struct(F.lit("buyers").alias("side"), F.abs("net").alias("weight"), F.lit(n_side).alias("most"))).otherwise(
            F.struct(F.lit("sellers").alias("side"), F.abs("net").alias("weight"), F.lit(n_side).alias("most"))),
        F.when((F.col("buyV") > 0) & (F.col("sellV") > 0), F.struct(F.lit("daytraders").alias("side"), F.least("buyV", "sellV").alias("weight"), F.lit(n_day).alias("most"))),
    ))

    def first(rows: DataFrame, *within: str) -> DataFrame:
        order = Window.partitionBy(*keys, *within).orderBy(F.desc("weight"), "broker")
        return rows.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most).filter(F.col("pos") <= F.col("most"))

    ranked = first(sums.withColumn("_role", F.explode(roles)).select("*", "_role.*").drop("_role"), "_slot", "side").drop("_slot", "pos")
    return first(ranked.repartition(tasks, *keys, "side"), "side").select(*keys, "side", "pos", "broker", "buyV", "sellV", "net")


def format_rows(rows: DataFrame) -> DataFrame:
    """F03 over broker rows: volumes in lots, prices in six digits, net with its sign."""
    return rows.withColumns({
        "buyV": fmt_lots(F.col("buyV")), "sellV": fmt_lots(F.col("sellV")), "buyP": fmt_broker_price(F.col("buyP")), "sellP": fmt_broker_price(F.col("sellP")),
        "net": F.when(F.col("side") != "daytraders", fmt_net_lots(F.col("net"))), "total": F.when(F.col("side") == "daytraders", fmt_lots(F.col("total"))),
    })


def broker_with_prices(broker: DataFrame, prices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Broker codes with their price record where there is one."""
    return broker.join(prices, list(keys), "left")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; a partial aggregate, so a frequent key costs one row per task."""
    columns = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return first.select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def candidates(not_found: DataFrame, found: DataFrame, keys: Sequence[str] = ("date", "code"), pos: str = "pos") -> DataFrame:
    """Both matched lists in one, first occurrence of each code kept, the not-found list before the found one."""
    both = not_found.withColumn("list_no", F.lit(0)).unionByName(found.withColumn("list_no", F.lit(1)))
    return first_per_key(both.filter(F.coalesce(F.col(keys[-1]).cast("string"), F.lit("")) != ""), keys, ["list_no", pos])


def institutional_detail(matched: DataFrame, detail: DataFrame, keys: Sequence[str] = ("date", "code")) -> DataFrame:
    """Matched stocks that have broker detail; the name is the row's, else the detail's, else the code."""
    named = detail.withColumnRenamed("name", "detail_name")
    joined = matched.join(named, list(keys))
    return joined.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.nullif("detail_name", F.lit("")), F.col(keys[-1]).cast("string"))).drop("detail_name")


def detail_counts(candidate_rows: DataFrame, detail_rows: DataFrame, detail: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """candidate_count and matched_count per key; both 0 where the key has no broker detail at all."""
    have = detail.select(*keys).distinct().withColumn("_has", F.lit(True))
    counts = candidate_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).join(detail_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), list(keys), "left").join(have, list(keys), "left")
    value = lambda c: F.when(F.col("_has"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return counts.select(*keys, value("_c").alias("candidate_count"), value("_m").alias("matched_count"))
