"""Ticks to sessions: OHLC, assembled sessions and chart series."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points in one segment of a polyline.
SEGMENT_POINTS = 1024


def ohlcv(ticks: DataFrame, keys: Sequence[str], at: str = "ts", price: str = "price", volume: str = "volume", tie: str = "tick_id") -> DataFrame:
    """First, highest, lowest and last price and summed volume per key.

    ``tie`` is a whole number. Time and tie make one decimal to order by, so
    all aggregates have buffers of fixed width and hash without a sort of the
    ticks; a missing time comes first.
    """
    micros = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**56)))
    order = micros.cast("decimal(18,0)") * F.lit(Decimal(2**64)) + F.coalesce(F.col(tie), F.lit(0)).cast("decimal(19,0)")
    return ticks.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum(volume).alias("volume"),
    )


def session_aggregates(at: str = "collected_at", tie: str = "tick_id") -> list:
    """The aggregates of A02, shared by the batch and the streaming form. The first and the last point count even where a value is null."""
    order = F.struct(at, tie)
    return [
        F.min_by(F.struct("open"), order)["open"].alias("open"),
        F.min_by(F.struct("prev_close"), order)["prev_close"].alias("prev_close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by(F.struct("price", "provider"), order).alias("latest"),
        F.count(F.lit(1)).alias("n_points"),
    ]


def assemble_session(points: DataFrame, live: DataFrame | None = None, keys: Sequence[str] = ("symbol", "session_date"), at: str = "collected_at", tie: str = "tick_id", with_points: bool = False) -> DataFrame:
    """One row per session: open and prev_close of the first point, high and low over all, latest is the last point.

    ``live`` (the keys, open, prev_close, high, low, price, provider) fills
    what the first point lacks, takes part in high and low, and stands for a
    session without points. ``with_points`` adds the ordered points; a session
    has few dozen.
    """
    aggregates = session_aggregates(at, tie)
    if with_points:
        aggregates.append(F.sort_array(F.collect_list(F.struct(at, tie, "price"))).alias("points"))
    out = points.groupBy(*keys).agg(*aggregates)
    if live is None:
        return out
    now = live.select(*keys, *[F.col(c).alias(f"live_{c}") for c in ("open", "prev_close", "high", "low")], F.struct("price", "provider").alias("live_latest"))
    joined = out.join(now, list(keys), "full")
    columns = [
        F.coalesce("open", "live_open").alias("open"),
        F.coalesce("prev_close", "live_prev_close").alias("prev_close"),
        F.greatest("high", "live_high").alias("high"),
        F.least("low", "live_low").alias("low"),
        F.coalesce("latest", "live_latest").alias("latest"),
        F.coalesce("n_points", F.lit(0)).alias("n_points"),
    ]
    return joined.select(*keys, *columns, *(["points"] if with_points else []))


def point_order(at: str = "collected_at", tie: str = "tick_id") -> list[Column | str]:
    """By time, points without one first."""
    return [F.col(at).asc_nulls_first(), tie]


def sort_points(points: DataFrame, at: str = "collected_at", tie: str = "tick_id") -> DataFrame:
    """The points in that order."""
    return points.orderBy(*point_order(at, tie))


def scale_series(points: DataFrame, keys: Sequence[str], at: str = "ts", tie: str = "tick_id", width: float = 680, height: float = 180, pad: float = 28) -> DataFrame:
    """X and y of every point that has a price, in the plot of its series.

    x goes by the place among all points, y by the range of prices with the
    first point's previous close (zero and null do not count) and a margin of
    8 %. Adds prev_y and is_rise. ``at`` is a time: points are ranked within
    each minute of a series, and minutes are summed before they meet their
    series, so no task holds a whole series.
    """
    minute = F.date_trunc("minute", F.col(at)).alias("_minute")
    first, last = (lambda c, f=f: f(F.struct(c), F.struct(at, tie))[c] for f in (F.min_by, F.max_by))
    minutes = points.groupBy(*[F.col(c).alias(f"_key_{c}") for c in keys], minute).agg(
        F.count(F.lit(1)).alias("_count"), F.min("price").alias("_least"), F.max("price").alias("_most"), first("prev_close").alias("_first"), last("price").alias("_last")
    )
    series = Window.partitionBy(*[f"_key_{c}" for c in keys])  # a row per minute
    order, whole = series.orderBy("_minute"), series.orderBy("_minute").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    facts = minutes.select(
        *[f"_key_{c}" for c in keys], F.col("_minute").alias("_of"),
        (F.sum("_count").over(order) - F.col("_count")).alias("_before"), F.sum("_count").over(series).alias("n"),
        F.min("_least").over(series).alias("_least"), F.max("_most").over(series).alias("_most"), F.first("_first").over(whole).alias("_first"), F.last("_last").over(whole).alias("_last"),
    )
    inside = points.withColumn("_minute", minute).withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_minute").orderBy(at, tie)) - 1)
    ranked = (
        inside.join(facts, [*[F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys], F.col("_minute").eqNullSafe(F.col("_of"))])
        .withColumn("i", F.col("_before") + F.col("_place"))
        .withColumn("_prev", F.when(F.col("_first") != 0, F.col("_first")))
        .withColumn("_lo", F.least("_least", "_prev"))
        .withColumn("_hi", F.greatest("_most", "_prev"))
        .withColumn("_span", F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo")))
    )

    def y(price):
        low, high = F.col("_lo") - F.col("_span") * 0.08, F.col("_hi") + F.col("_span") * 0.08
        return pad + (height - pad * 2) * (1 - (price - low) / (high - low))

    return ranked.filter("price is not null").select(
        *points.columns, "i",
        (pad + (width - pad * 2) * (F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("x"),
        y(F.col("price")).alias("y"),
        y(F.col("_first")).alias("prev_y"),
        (F.coalesce("_last", F.lit(0.0)) >= F.coalesce("_first", F.lit(0.0))).alias("is_rise"),
    )


def _polyline() -> list[Column]:
    one = lambda c: F.replace(F.format_number(c, 1), F.lit(","), F.lit(""))
    point = F.struct("i", F.concat(one("x"), F.lit(","), one("y")).alias("xy"))
    return [F.array_join(F.transform(F.sort_array(F.collect_list(point)), lambda p: p["xy"]), " ").alias("polyline"), F.count(F.lit(1)).alias("n_dots")]


def series_polyline(scaled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A10: "x,y x,y ..." per series, one decimal each, and the number of points. A series is one row; ``polyline_segments`` bounds it."""
    return scaled.groupBy(*keys).agg(*_polyline())


def polyline_segments(scaled: DataFrame, keys: Sequence[str], most: int = SEGMENT_POINTS) -> DataFrame:
    """A10: the polyline in segments (from 0, in order) of ``most`` places each, so no row or task holds more points than that.

    Places without a price count too; a segment that has none is left out.
    """
    return scaled.groupBy(*keys, F.expr(f"i div {int(most)}").alias("segment")).agg(*_polyline())
