"""What several operators need: a place in the shared folder, a cache for each worker process, Arrow helpers."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session (tests) that names none gets a temporary one; on a cluster that is an error, as executors wouldn't share it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="placelens-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Tables written in the shared folder, so that later stages neither recompute them nor depend on one executor. They stay until close(), as lazy results read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/placelens-{uuid.uuid4().hex}", 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def write(self, df: DataFrame, partition_by: str | None = None) -> str:
        path = self.path()
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
        return path

    def keep(self, df: DataFrame) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.write(df))

    def bucketed(self, df: DataFrame, buckets: int, *keys: str) -> str:
        """The name of a table in the shared folder, bucketed and sorted by the keys: merges by them need no exchange."""
        path, name = self.path(), f"placelens_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
        self.tables = {**getattr(self, "tables", {}), name: path}
        return name

    def drop_table(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        self.drop(self.tables.pop(name))

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        """Deletes all tables. For whoever has written the results that read them."""
        for name in list(getattr(self, "tables", {})):
            self.drop_table(name)
        self.drop(self.root)


def process_cache(key, make):
    """make() once for each worker process. The cache is a module of its own: functions that travel by value have new globals in each task."""
    cache = sys.modules.setdefault("_placelens_cache", types.ModuleType("_placelens_cache")).__dict__
    if key not in cache:
        cache[key] = make()
    return cache[key]


#: A key in more rows than HOT_ROWS is split over tasks; where that would be more than HOT_KEYS keys, the limit is the rows' HOT_KEYS-th part, so there never are more.
HOT_ROWS, HOT_KEYS = 20_000, 10_000


def spread_join(rows: DataFrame, one: DataFrame, key: str, by: str, keep_n: bool = False) -> DataFrame:
    """rows joined with one by key. one has a row for each key, with n, the number of rows that hold it. The rows of a hot key are dealt by a hash of `by` over as many parts
    as it needs, and its row of `one` is copied to each; only the hot keys are broadcast, HOT_KEYS at most."""
    limit = max(HOT_ROWS, (one.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = one.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("__parts"))
    if not keep_n:
        one = one.drop("n")
    if hot.isEmpty():
        return rows.join(one, key)
    hot = F.broadcast(hot)
    dealt = rows.join(hot, key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    copies = one.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copies, [key, "__part"]).drop("__part")


def packed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns id, text and row (all columns as a struct), so that no column of the input can clash with an operator's own."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str], text_col: str, text) -> DataFrame:
    """The columns of the input again, with another text."""
    return df.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns])


def partitions_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
