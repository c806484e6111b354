"""Quotes: vendor records to one schema, provider fallback, aliases, index sources, institutional flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import change, parse_int, parse_number, py_round, reconcile_sign

# Order of the quote providers, the record that stands in when none answers, and the names of each quote, as given.
PROVIDERS = ("yahoo", "finmind", "wantgoo", "fixture")
FALLBACK = {
    "provider": "fixture", "provider_name": "fixtures/fallback", "symbol": "臺指期 (離線快照)", "price": 45203.0, "change": 65.0,
    "change_pct": 0.14, "open": 45220.0, "prev_close": 45138.0, "high": 45474.0, "low": 45126.0, "volume": 15611,
}
QUOTE_ALIASES = {
    "sp500": ("^GSPC", "S&P 500", "sp500", "S&P 500指數"),
    "nasdaq": ("^IXIC", "那斯達克", "nasdaq", "NASDAQ指數"),
    "dow": ("^DJI", "道瓊工業", "dow", "道瓊工業指數"),
    "sox": ("^SOX", "費城半導體", "sox", "費城半導體指數"),
    "tsmc": ("TSM", "台積電 ADR", "tsmc"),
    "nvda": ("NVDA", "輝達 (NVDA)", "nvda"),
    "aapl": ("AAPL", "蘋果 (AAPL)", "aapl"),
    "tsmc_tw": ("2330.TW", "台積電 現貨", "tsmc_tw", "2330"),
    "umc": ("UMC", "聯電 ADR", "umc"),
    "ase": ("ASX", "日月光 ADR", "ase"),
    "nikkei225": ("^N225", "日經 225", "日經225指數", "nikkei225"),
    "kospi": ("^KS11", "韓國 KOSPI", "韓國綜合指數", "kospi"),
}


def _given(*columns: Column) -> Column:
    """First value that is neither null nor zero."""
    return F.coalesce(*[F.nullif(c.cast("double"), F.lit(0.0)) for c in columns])


def normalize_numeric(df: DataFrame, provider: str) -> DataFrame:
    """A vendor's numeric record (close, price, settlement_price, open, high, low, change, change_rate, volume) as a quote.

    Zero counts as missing here, as the vendor means it: open, high and low
    fall back to the price, which is the first of its three fields.
    """
    price = _given(F.col("close"), F.col("price"), F.col("settlement_price"))
    diff = F.coalesce(F.col("change").cast("double"), F.lit(0.0))
    return df.withColumns({
        "provider": F.lit(provider), "_price": price, "change_pct": F.coalesce(F.col("change_rate").cast("double"), F.lit(0.0)), "change": diff,
        "prev_close": py_round(price - diff),
        "open": F.coalesce(_given(F.col("open")), price), "high": F.coalesce(_given(F.col("high")), price), "low": F.coalesce(_given(F.col("low")), price),
        "volume": F.coalesce(F.col("volume").cast("long"), F.lit(0)),
    }).withColumn("price", F.col("_price")).drop("_price", "close", "settlement_price", "change_rate")


def normalize_text(df: DataFrame, provider: str, fields: dict[str, str]) -> DataFrame:
    """A vendor's text record as a quote: ``fields`` maps quote fields to vendor fields; the signs are reconciled."""
    numbers = {name: (parse_int if name == "volume" else parse_number)(F.col(source)) for name, source in fields.items()}
    out = df.withColumns({f"_{name}": value for name, value in numbers.items()}).drop(*fields.values()).withColumnsRenamed({f"_{name}": name for name in numbers})
    signs = reconcile_sign(F.col("change"), F.col("change_pct"))
    return out.withColumn("_signs", signs).withColumns({"change": F.col("_signs.change"), "change_pct": F.col("_signs.change_pct"), "provider": F.lit(provider)}).drop("_signs")


def quote_from_chart(json: Column) -> Column:
    """struct(value, change, change_pct, is_missing) of a chart document; either price missing flags the quote."""
    meta = F.get(F.from_json(json, "chart struct<result: array<struct<meta: struct<regularMarketPrice: double, chartPreviousClose: double>>>>")["chart"]["result"], F.lit(0))["meta"]
    price, previous = meta["regularMarketPrice"], meta["chartPreviousClose"]
    missing = price.isNull() | previous.isNull()
    moved = change(price, previous)
    return F.struct(
        F.when(~missing, py_round(price)).alias("value"),
        F.when(~missing, moved["change"]).alias("change"),
        F.when(~missing, moved["change_pct"]).alias("change_pct"),
        F.coalesce(missing, F.lit(True)).alias("is_missing"),
    )


def with_aliases(quotes: DataFrame, aliases: dict[str, Sequence[str]] = QUOTE_ALIASES, key: str = "key") -> DataFrame:
    """One row per alias of each known quote; price repeats the value."""
    spark = quotes.sparkSession
    table = spark.createDataFrame([(k, a) for k, names in aliases.items() for a in names], f"{key} string, alias string")
    return quotes.join(F.broadcast(table), key).withColumn("price", F.col("value"))  # the alias table is an argument of this call


def prefer_source(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the preferred source, else of the other; both have the same columns."""
    values = [c for c in first.columns if c not in keys]
    pack = lambda df, name: df.select(*keys, F.struct(*values).alias(name))
    joined = pack(first, "_a").join(pack(second, "_b"), list(keys), "full")
    return joined.select(*keys, F.coalesce("_a", "_b").alias("_v")).select(*keys, *[F.col("_v")[c].alias(c) for c in values])


def first_available(
    records: DataFrame, keys: Sequence[str], order: Sequence[str] = PROVIDERS, preferred: str | None = None, tie: str | None = None,
    saved: DataFrame | None = None, saved_keys: Sequence[str] = (), saved_at: str = "collected_at",
) -> DataFrame:
    """Per key the record of the first provider with a price; ``preferred`` goes to the front, unknown providers last.

    A key whose records all lack a price is flagged ``is_fallback``. It takes
    the numbers of the last ``saved`` record with a price, that of the same
    ``saved_keys`` (some of the keys), or, without one, of the constant record.
    """
    order = [*([preferred] if preferred in order else []), *(p for p in order if p != preferred)]
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in order]), F.col("provider")), F.lit(0)), F.lit(len(order) + 1))
    values = [c for c in records.columns if c not in keys]
    best = F.struct(F.col("price").isNull().alias("lacks"), rank.alias("rank"), *([F.col(tie).alias("tie")] if tie else []), F.col("provider").alias("p"))
    out = records.groupBy(*keys).agg(F.min_by(F.struct(*values), best).alias("_v"))
    missing = F.col("_v.price").isNull()
    stand_in = {c: F.lit(FALLBACK[c]).cast(records.schema[c].dataType) for c in values if c in FALLBACK}
    if saved is not None:
        kept = [c for c in stand_in if c in saved.columns and c != "provider"]
        last = saved.filter("price is not null").groupBy(*saved_keys).agg(F.max_by(F.struct(*kept), saved_at).alias("_s"))
        out = out.join(last, list(saved_keys), "left")
        stand_in |= {c: F.when(F.col("_s").isNotNull(), F.col("_s")[c].cast(records.schema[c].dataType)).otherwise(stand_in[c]) for c in kept}
    return out.select(*keys, *[F.when(missing, stand_in[c]).otherwise(F.col("_v")[c]).alias(c) if c in stand_in else F.col("_v")[c].alias(c) for c in values], missing.alias("is_fallback"))


def pick_contract(df: DataFrame, by: Sequence[str] = (), name_part: str = "臺指", suffix: str = "-M") -> DataFrame:
    """The month contract to quote: of each market type its first candidate by pos, if it has a last price; type "1" before "0"."""
    candidates = df.filter(F.endswith("symbol", F.lit(suffix)) & F.contains("name", F.lit(name_part)) & F.col("market_type").isin("0", "1"))
    columns = [c for c in df.columns if c not in by]
    first = candidates.groupBy(*by, "market_type").agg(F.min_by(F.struct(*columns), "pos").alias("_row"))
    usable = first.filter(F.coalesce(F.col("_row.last_price"), F.lit("")) != "")
    return usable.groupBy(*by).agg(F.max_by("_row", "market_type").alias("_row")).filter("_row is not null").select(*by, "_row.*")


def institutional_flows(rows: DataFrame, by: Sequence[str] = ("date",), names=("外資及陸資", "不含外資自營商", "投信", "自營商", "自行買賣", "避險"), unit: float = 1e8) -> DataFrame:
    """Net flows per key in units of 1e8: foreign, trust (the last row counts) and dealer (own account plus hedging).

    In: stat (only "OK" is used), pos, row (array of texts: name, buy, sell,
    net). A later rule never sees what an earlier one took.
    """
    foreign_1, foreign_2, trust, dealer, own, hedge = names
    name, net = F.get("row", F.lit(0)), parse_int(F.get("row", F.lit(3)))
    has = lambda part: F.contains(name, F.lit(part))
    kind = F.when(has(foreign_1) & has(foreign_2), "foreign").when(has(trust), "trust").when(has(dealer) & (has(own) | has(hedge)), "dealer")
    used = rows.filter("stat = 'OK'").withColumn("_kind", kind).withColumn("_net", net)
    scaled = lambda c: py_round(c / F.lit(unit))
    return used.groupBy(*by).agg(
        *[scaled(F.max_by(F.when(F.col("_kind") == k, F.col("_net")), F.when(F.col("_kind") == k, F.col("pos")))).alias(k) for k in ("foreign", "trust")],
        scaled(F.sum(F.when(F.col("_kind") == "dealer", F.col("_net")))).alias("dealer"),
    )


def missing_fields(df: DataFrame, expected: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The expected keys that have no value."""
    return expected.join(df.filter(F.col(value).isNotNull()), list(keys), "left_anti")
