"""Stored tables cut into buckets by key, of which an update rewrites the touched ones alone.

A bucket is a folder with a number of its own for each version. A small file names the current
version of every bucket; it is written last and under a new name, so readers see all of an update or
nothing of it, and a run that failed left folders that no one reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skillstrata.sources.lake import CODEC

BUCKET, VERSION = "bucket", "version"


@dataclass(frozen=True)
class BucketTable:
    """``schema`` are the columns of a row, ``by`` those whose hash names its bucket, or one whose value does.

    ``by_value`` suits a column of few values that an update touches few of, such as a month;
    NULL is then bucket -1.
    """

    path: str
    schema: StructType
    by: Sequence[str]
    n_buckets: int = 64
    by_value: bool = False

    def bucket_of(self) -> Column:
        if self.by_value:
            return F.coalesce(F.col(self.by[0]).cast("int"), F.lit(-1))
        return F.pmod(F.xxhash64(*self.by), F.lit(self.n_buckets)).cast("int")

    def _files(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/current")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _pointer(self, spark: SparkSession) -> dict:
        files, path = self._files(spark)
        names = sorted(status.getPath().getName() for status in files.listStatus(path)) if files.exists(path) else []
        if not names:
            return {"tag": None, "buckets": {}}
        return json.loads(spark.read.text(f"{self.path}/current/{names[-1]}", wholetext=True).head()[0])

    def current(self, spark: SparkSession) -> dict[int, str]:
        """Version of each bucket: one short entry for a bucket."""
        return {int(bucket): version for bucket, version in self._pointer(spark)["buckets"].items()}

    def tag(self, spark: SparkSession) -> str | None:
        """What the last update was called."""
        return self._pointer(spark)["tag"]

    def read(self, spark: SparkSession, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some: no other folder is opened."""
        current = self.current(spark)
        chosen = current if buckets is None else {b: current[b] for b in buckets if b in current}
        if not chosen:
            return spark.createDataFrame([], self.schema)
        folders = [f"{self.path}/data/{VERSION}={version}/{BUCKET}={bucket}" for bucket, version in sorted(chosen.items())]
        return spark.read.schema(self.schema).parquet(*folders)

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of some rows: at most ``n_buckets`` numbers, or one a value."""
        return [r[0] for r in rows.select(self.bucket_of().alias(BUCKET)).distinct().collect()]

    def replace(
        self,
        spark: SparkSession,
        rows: DataFrame,
        buckets: Sequence[int] | None,
        tag: str | None = None,
        gather: bool = True,
        changed: Callable[[], Sequence[int]] | None = None,
    ) -> None:
        """Puts ``rows`` in place of the given buckets, of all if None. A bucket without rows is gone.

        With ``gather`` a rebalance shuffle brings the rows of a bucket into few files. Leave it out where a shuffle
        has just been and tasks are few for the rows: each then writes a file to every bucket it has rows of.
        ``changed`` is asked after the write which of the buckets differ from before: the others stay as they were.
        """
        version = uuid.uuid4().hex
        dealt = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn(BUCKET, self.bucket_of())
        folder = f"{self.path}/data/{VERSION}={version}"
        (dealt.hint("rebalance", BUCKET) if gather else dealt).write.partitionBy(BUCKET).option("compression", CODEC).parquet(folder)
        files, _ = self._files(spark)
        written = [s.getPath().getName() for s in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder))]
        if changed:
            buckets = [b for b in changed() if buckets is None or b in set(buckets)]
            for name in [n for n in written if n.startswith(f"{BUCKET}=") and int(n.split("=")[1]) not in buckets]:
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
                written.remove(name)
            if not buckets:
                return
        before = {} if buckets is None else {b: v for b, v in self.current(spark).items() if b not in set(buckets)}
        after = before | {int(name.split("=")[1]): version for name in written if name.startswith(f"{BUCKET}=")}
        self._point(spark, {"tag": tag, "buckets": after})

    def _point(self, spark: SparkSession, pointer: dict) -> None:
        files, path = self._files(spark)
        taken = [int(s.getPath().getName()) for s in files.listStatus(path)] if files.exists(path) else []
        hidden = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pending-{uuid.uuid4().hex}")
        out = files.create(hidden)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        files.mkdirs(path)
        if not files.rename(hidden, spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/current/{max(taken, default=0) + 1:012d}")):
            raise RuntimeError(f"{self.path} was changed by another run meanwhile")
