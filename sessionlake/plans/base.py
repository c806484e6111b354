"""Registration of queries: a Spark plan and, beside it, the same question in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The driver's tables by name: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, dates and times as ISO text, so that results compare across engines."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        columns.append(c.alias(name))
    return df.select(*columns)


def query(sql: str | None = None, **types: str):
    """Register a plan ``f(t: Tables) -> DataFrame`` under its own name; ``types`` are SQL types of result columns."""
    if sql and types:
        casts = ", ".join(f"{name}::{kind} AS {name}" for name, kind in types.items())
        sql = f"SELECT * REPLACE ({casts}) FROM ({sql.strip()})"

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: _plain(f(Tables(spark, sf_dir)))
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register
