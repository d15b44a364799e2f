"""Where results go: keyed upserts, appends with a generated id, JSON artifacts, and a stream's profile table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


class Versions:
    """A keyed table of Parquet versions under a path: a merge writes a new version beside the one it reads, then names it in a small table, so a failed write leaves the old one in place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> str | None:
        if not _exists(self.spark, f"{self.path}/current"):
            return None
        names = self.spark.read.schema("n long, name string").json(f"{self.path}/current")
        return names.agg(F.max_by("name", "n")).first()[0]  # one row

    def read(self) -> DataFrame | None:
        name = self.current()
        return self.spark.read.parquet(f"{self.path}/{name}") if name else None

    def write(self, df: DataFrame) -> None:
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        n = self.spark.read.schema("n long, name string").json(f"{self.path}/current").agg(F.max("n")).first()[0] if self.current() else 0
        row = self.spark.createDataFrame([(n + 1, name)], "n long, name string")
        row.coalesce(1).write.mode("append").json(f"{self.path}/current")

    def upsert(self, new: DataFrame, keys: list[str], latest: list[Column] | None = None, set_nulls: bool = False) -> None:
        """Rows of new take the place of those of equal key; the latest of new counts."""
        old = self.read()
        first = R.keep_first(new, keys, latest) if latest else new.dropDuplicates(keys)
        self.write(first if old is None else R.upsert(old, new, keys, latest=latest, set_nulls=set_nulls))

    def insert_new(self, new: DataFrame, keys: list[str]) -> None:
        """Rows whose key stands already change nothing."""
        old = self.read()
        self.write(new.dropDuplicates(keys) if old is None else R.insert_new(old, new, keys))


def append(df: DataFrame, path: str, id_col: str = "id") -> None:
    """Adds rows, each under a generated id. The id comes from the row, so a task that is run again gives the same."""
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    df.withColumn(id_col, F.sha2(F.concat_ws(":", F.lit(uuid.uuid4().hex), F.monotonically_increasing_id().cast("string"), content), 256)).write.mode("append").parquet(path)


def write_artifact(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines; in one file if the artifact is small."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def bulk_copy(df: DataFrame, target: Versions, keys: list[str], most: int = 1000) -> None:
    """The first rows by key go to the table (the limit is the feature)."""
    target.upsert(df.orderBy(*keys).limit(min(most, 1000)), keys)


def profile_sink(path: str, keys: list[str], order: Column):
    """For foreachBatch: each batch's last state of a key replaces the stored one. A batch that is run again writes the same rows."""

    def write(batch: DataFrame, number: int) -> None:
        Versions(batch.sparkSession, path).upsert(batch, keys, latest=[order])

    return write
