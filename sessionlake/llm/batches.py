"""Batches of whole texts on their way to Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Texts in one Arrow batch. Spark's own 10,000 rows are meant for short ones; a batch stands in memory several times.
TEXTS = 1000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def of_texts(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands at most TEXTS rows to Python at once (never more than it did before)."""
    conf = df.sparkSession.conf
    now = int(conf.get(_SETTING))
    if not 0 < now <= TEXTS:
        conf.set(_SETTING, TEXTS)
    return df
