"""Row numbers over a whole table without one task holding it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def number_rows(df: DataFrame, *order: Column | str, name: str = "row_number") -> DataFrame:
    """Adds ``name`` (long, from 0) in the given order.

    Range partitions are sorted and written once; the row counts of the
    partitions before give each its offset, so no task sees more than its
    range. Equal rows are told apart by where they were read, so that any
    number of them spreads over ranges too. The offsets have one row per
    partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (*order, "n_read")
    ranged = df.withColumn("n_read", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("n_read")
    ranged = materialize(ranged.withColumn("n_place", F.monotonically_increasing_id()), "number-ranges")
    part, inside = F.shiftright("n_place", 33), F.col("n_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("n_part")).count()
    before = Window.orderBy("n_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("n_offset"))
    return ranged.withColumn("n_part", part).join(F.broadcast(offsets), "n_part").withColumn(name, F.col("n_offset") + inside).drop("n_part", "n_offset", "n_place")
