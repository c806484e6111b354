"""Session aggregation as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions.dates import session_date
from ..operators.sessions import session_aggregates
from .current import CurrentTable

WATERMARK = "1 day"


def read_ticks(spark: SparkSession, path: str, schema: str, form: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """New tick files under ``path`` as a stream."""
    reader = spark.readStream.schema(schema).format(form)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def session_states(ticks: DataFrame, at: str = "collected_at", symbol: str = "symbol", tie: str = "tick_id", watermark: str | None = WATERMARK) -> DataFrame:
    """Running session per symbol.

    The session's date as a timestamp is a grouping key and carries the
    watermark, so state is dropped once sessions a day newer have come. Ticks
    that come later than that no longer count here; ``session_parts`` is the
    form that counts them. ``None`` keeps all state.
    """
    ticks = ticks.withColumn("session_ts", session_date(F.col(at)).cast("timestamp"))
    if watermark:
        ticks = ticks.withWatermark("session_ts", watermark)
    return ticks.groupBy(symbol, "session_ts").agg(*session_aggregates(at, tie))


def stream_sessions(states: DataFrame, checkpoint: str, upsert: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Hand each batch's changed sessions to ``upsert``; call ``start()`` on the result."""
    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert)


def session_parts(ticks: DataFrame, at: str = "collected_at", symbol: str = "symbol", tie: str = "tick_id", arrived: Column | None = None, watermark: str = WATERMARK) -> DataFrame:
    """What each day's arrivals say about a session, so that no tick is ever too late.

    The watermark stands on the arrival, not on the session: a tick that
    comes long after its session opens a part of its own there, and
    ``merge_parts`` puts a session's parts together. State holds only the
    sessions that ticks arrived for within the watermark. ``arrived`` is the
    time of the batch unless the ticks bring their own, which must then not
    go back by more than the watermark.
    """
    ticks = ticks.withColumn("session_ts", session_date(F.col(at)).cast("timestamp")).withColumn("_arrived", F.current_timestamp() if arrived is None else arrived.cast("timestamp"))
    parts = ticks.withWatermark("_arrived", watermark).groupBy(symbol, "session_ts", F.window("_arrived", "1 day").alias("_day")).agg(
        F.min(F.struct(at, tie, "open", "prev_close")).alias("first"), F.max(F.struct(at, tie, "price", "provider")).alias("last"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.count(F.lit(1)).alias("n_points"),
    )
    return parts.select(symbol, "session_ts", F.col("_day.start").alias("arrived"), "first", "last", "high", "low", "n_points")


def merge_parts(parts: DataFrame, symbol: str = "symbol") -> DataFrame:
    """One row per session from its parts, with the columns of ``session_states``."""
    whole = parts.groupBy(symbol, "session_ts").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("n_points").alias("n_points"))
    return whole.select(symbol, "session_ts", "first.open", "first.prev_close", "high", "low", F.struct("last.price", "last.provider").alias("latest"), "n_points")


def session_table(spark: SparkSession, path: str, symbol: str = "symbol", spread: int = 8) -> CurrentTable:
    """Parts by symbol, session and day of arrival, in buckets of a month and a share of the symbols: months that get no ticks are left alone."""
    share = F.pmod(F.xxhash64(symbol), F.lit(spread)).cast("string")
    return CurrentTable(spark, path, (symbol, "session_ts", "arrived"), F.concat_ws("-", F.coalesce(F.date_format("session_ts", "yyyyMM"), F.lit("none")), share))


def run_available(parts: DataFrame, checkpoint: str, table: CurrentTable) -> StreamingQuery:
    """Process what is there, batch after batch, and merge each batch's changed parts into ``table``."""
    query = stream_sessions(parts, checkpoint, table.upsert).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
