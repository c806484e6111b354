"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. A table written there cuts lineage
as ``checkpoint()`` does, survives lost executors, and keeps its columns apart,
so later steps read only what they select.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
_owners: ContextVar[tuple[Tables, ...]] = ContextVar("owners", default=())


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder for this application.

    Only where ``spark.checkpoint.dir`` is unset and one machine does all the
    work (tests) a temporary folder of the driver stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if "base" not in _own_folder:
            _own_folder["base"] = tempfile.mkdtemp(prefix="spark-sessionlake-")
        base = _own_folder["base"]
    folder = f"{base.rstrip('/')}/sessionlake-{spark.sparkContext.applicationId}"
    if _own_folder.get("registered") != folder:
        _own_folder["registered"] = folder
        atexit.register(remove, spark, folder)
    return folder


class Tables:
    """Tables that one piece of work has made, and may delete."""

    def __init__(self):
        self._paths: list[str] = []

    def free(self, spark: SparkSession) -> None:
        """Delete them, once nothing reads them any more."""
        while self._paths:
            remove(spark, self._paths.pop())


@contextmanager
def owned() -> Iterator[Tables]:
    """The tables that this thread makes inside the block. Blocks may stand inside each other; a table belongs to all that are open."""
    tables = Tables()
    before = _owners.set((*_owners.get(), tables))
    try:
        yield tables
    finally:
        _owners.reset(before)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    for tables in _owners.get():
        tables._paths.append(path)
    return path


def materialize(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if it is there and the session still lives."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session is gone; the folder stays for the cluster's own cleaning
        pass


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
