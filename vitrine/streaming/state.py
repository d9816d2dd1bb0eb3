"""Tables that a stream keeps, written by parts.

A table is cut into ``buckets`` by a hash of its key. A micro-batch rewrites only the
buckets it touches, as ``data/v=<version>/bucket=<n>``; a manifest for each version
(one row per bucket) names the version in which each bucket was written last. Version
b + 1 comes from version b and micro-batch b, so a retried batch writes the same files
again. Files that neither of the two newest manifests names are removed.

What reaches the driver is the manifest and the touched bucket numbers, at most
``buckets`` rows each.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_BUCKET = "_bucket"


class BucketedState:
    """``keys``: the columns that place a row. ``pinned``: version 0 is kept for good."""

    def __init__(self, spark: SparkSession, path: str, seed: DataFrame, keys: list[str],
                 resume: bool = False, buckets: int = BUCKETS, pinned: bool = False):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.buckets, self.pinned, self.schema = buckets, pinned, seed.schema
        found = self._newest() if resume else None
        if found is None:
            self._store(0, self._placed(seed), {})
            found = 0
        self.last = found

    # ---- layout
    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _data(self, version: int, bucket: int | None = None) -> str:
        base = f"{self.path}/data/v={version:010d}"
        return base if bucket is None else f"{base}/{_BUCKET}={bucket}"

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/v={version:010d}"

    def _newest(self) -> int | None:
        try:
            files = self.spark.read.parquet(f"{self.path}/manifest").inputFiles()
        except Exception:  # noqa: BLE001 - no table yet
            return None
        return max((int(m[1]) for f in files if (m := re.search(r"/v=(\d+)/", f))), default=None)

    def placement(self, version: int) -> dict[int, int]:
        """bucket -> version that holds its rows."""
        rows = self.spark.read.schema("bucket int, version int").parquet(self._manifest(version))
        return {r.bucket: r.version for r in rows.collect()}

    def _read(self, placement: dict[int, int]) -> DataFrame:
        paths = [self._data(v, b) for b, v in sorted(placement.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _store(self, version: int, placed: DataFrame, kept: dict[int, int]) -> None:
        placed.repartition(self.buckets, _BUCKET).write.mode("overwrite").partitionBy(
            _BUCKET).parquet(self._data(version))
        written = {b: version for b in range(self.buckets) if self._exists(self._data(version, b))}
        rows = sorted((kept | written).items())
        (self.spark.createDataFrame(rows, "bucket int, version int").coalesce(1)
         .write.mode("overwrite").parquet(self._manifest(version)))

    # ---- files
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm  # noqa: SLF001 - Hadoop's file system API
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p  # noqa: SLF001

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _forget(self, version: int) -> None:
        """Remove what only manifests before ``version`` - 1 name."""
        old = version - 2
        if old < 0 or not self._exists(self._manifest(old)):
            return
        kept = set(self.placement(version).items()) | set(self.placement(version - 1).items())
        for b, v in self.placement(old).items():
            if (b, v) not in kept and not (self.pinned and v == 0):
                fs, p = self._fs(self._data(v, b))
                fs.delete(p, True)
        if not (self.pinned and old == 0):
            fs, p = self._fs(self._manifest(old))
            fs.delete(p, True)

    # ---- use
    def read(self, version: int) -> DataFrame:
        return self._read(self.placement(version))

    def read_for(self, version: int, rows: DataFrame) -> DataFrame:
        """The buckets that hold the keys of ``rows``."""
        touched = {r[0] for r in self._placed(rows).select(_BUCKET).distinct().collect()}
        return self._read({b: v for b, v in self.placement(version).items() if b in touched})

    def latest(self) -> DataFrame:
        return self.read(self.last)

    def upsert(self, batch: int, changed: DataFrame,
               combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
        """Version ``batch`` + 1: ``combine(stored, changed)`` of the touched buckets, which
        must keep every row's bucket; without it ``changed`` replaces rows of equal keys."""
        changed = self._placed(changed).checkpoint()
        before = self.placement(batch)
        touched = {r[0] for r in changed.select(_BUCKET).distinct().collect()}
        stored = self._read({b: v for b, v in before.items() if b in touched})
        changed = changed.drop(_BUCKET)
        if combine is None:
            after = stored.join(changed.select(*self.keys), self.keys, "left_anti").unionByName(changed)
        else:
            after = combine(stored, changed)
        self._store(batch + 1, self._placed(after.select(*self.schema.names)),
                    {b: v for b, v in before.items() if b not in touched})
        self.last = max(self.last, batch + 1)
        self._forget(batch + 1)
