"""Quote snapshots as JSON Lines, one folder per session date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A quote snapshot; every field may be missing.
SNAPSHOT = (
    "provider string, provider_name string, collected_at timestamp_ntz, symbol string, price double, change double, "
    "change_pct double, open double, prev_close double, high double, low double, volume long, is_fallback boolean"
)


def read_snapshots(spark: SparkSession, path: str, schema: str = SNAPSHOT) -> DataFrame:
    """The ticks under ``path``; blank and undecodable lines are skipped.

    A folder per session date (``session_date=...``) becomes a column.
    """
    bad = "_corrupt_record"
    rows = spark.read.schema(f"{schema}, {bad} string").option("columnNameOfCorruptRecord", bad).json(path)
    return rows.filter(F.col(bad).isNull()).drop(bad)


def append_snapshots(df: DataFrame, path: str, session: str = "session_date") -> None:
    """Append ticks to the folders of their sessions; rows are dealt by session first, so a batch adds few files, but a long session is split."""
    df.hint("rebalance", session).write.mode("append").partitionBy(session).json(path)


def compact_snapshots(spark: SparkSession, path: str, target: str, schema: str = SNAPSHOT, session: str = "session_date") -> None:
    """Rewrite many small appends as one columnar table partitioned by session."""
    read_snapshots(spark, path, schema).hint("rebalance", session).write.mode("overwrite").partitionBy(session).parquet(target)
