"""The current rows of a keyed table that a stream changes batch by batch.

The table lies in buckets. A batch reads and writes only the buckets that hold
its keys; a manifest says which version of each bucket is current. A batch
that runs again starts from the manifest of its predecessor and replaces what
it wrote, so each counts once. What neither of the last two manifests names is
deleted: files and reading grow with the table, not with the batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import exists, remove


class CurrentTable:
    """Rows by ``keys`` under ``path``; ``bucket`` is a text column of a row's keys with few values that a batch touches."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], bucket: Column):
        self._spark, self._path, self._keys, self._bucket = spark, path.rstrip("/"), list(keys), bucket

    def _manifests(self) -> list[int]:
        folder = f"{self._path}/manifests"
        if not exists(self._spark, folder):
            return []
        path = self._spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = path.getFileSystem(self._spark._jsc.hadoopConfiguration()).listStatus(path)
        # a manifest counts once it is written as a whole
        return sorted(int(s.getPath().getName()) for s in found if exists(self._spark, f"{s.getPath()}/_SUCCESS"))

    def _manifest(self, batch: int | None) -> dict[str, int]:
        """Version of each bucket; a row for each bucket."""
        if batch is None:
            return {}
        return {r["bucket"]: r["version"] for r in self._spark.read.parquet(f"{self._path}/manifests/{batch}").collect()}

    def _folder(self, bucket: str, version: int) -> str:
        return f"{self._path}/versions/{version}/bucket={bucket}"

    def upsert(self, changed: DataFrame, batch: int) -> None:
        """Put the rows of one batch in place of those with the same keys; at most one row a key."""
        staged_at = f"{self._path}/staged/{batch}"
        changed.withColumn("bucket", self._bucket).write.mode("overwrite").parquet(staged_at)
        staged = self._spark.read.parquet(staged_at)
        touched = [r["bucket"] for r in staged.select("bucket").distinct().collect()]
        known = [n for n in self._manifests() if n < batch]
        before = self._manifest(known[-1] if known else None)
        current = {**before, **dict.fromkeys(touched, batch)}
        if touched:
            merged, old = staged, [self._folder(b, before[b]) for b in touched if b in before]
            if old:
                kept = self._spark.read.schema(changed.schema).option("recursiveFileLookup", True).parquet(*old).withColumn("bucket", self._bucket)
                same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self._keys]
                merged = kept.alias("o").join(staged.select(*self._keys).alias("n"), same, "left_anti").unionByName(staged)
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self._path}/versions/{batch}")
        rows = self._spark.createDataFrame(list(current.items()), "bucket string, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self._path}/manifests/{batch}")
        remove(self._spark, staged_at)
        for n in known[:-1]:  # the last one but this stays, for a batch that runs again
            for bucket, version in self._manifest(n).items():
                if before.get(bucket) != version:
                    remove(self._spark, self._folder(bucket, version))
            remove(self._spark, f"{self._path}/manifests/{n}")

    def read(self, schema) -> DataFrame:
        """All current rows; none before the first batch."""
        known = self._manifests()
        folders = [self._folder(b, v) for b, v in self._manifest(known[-1] if known else None).items()]
        if not folders:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*folders)
