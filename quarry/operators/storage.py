"""Tables and files in folders: append, staging with commit and rollback, text sinks, rotation, copies, statistics, a result cache.

Everything goes through Spark's writers and Hadoop's file system, so a folder may lie in any store that Spark reaches.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder's name that all executors share: under the checkpoint folder, else under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    """Whether there was anything to remove."""
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    if exists(spark, new) or not fs.rename(p, _fs(spark, new)[1]):
        raise FileExistsError(new)


def copy(spark: SparkSession, old: str, new: str) -> None:
    """A file or folder, byte by byte; nothing is overwritten."""
    if exists(spark, new):
        raise FileExistsError(new)
    (a, p), (b, q) = _fs(spark, old), _fs(spark, new)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, spark._jsc.hadoopConfiguration())


def append(rows: DataFrame, path: str) -> DataFrame:
    """The table with the rows added."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Staged:
    """Writes of several tables that all come into force at once, or not at all.

    ``with Staged(spark, folder) as t: t.write("files", df)``: tables are written beside the folder's current version; leaving the block
    normally writes the pointer to the new version last, an error leaves the old one in force and removes what was written.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), f"v-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def current(self) -> str | None:
        if not exists(self.spark, f"{self.folder}/current"):
            return None
        rows = self.spark.read.text(f"{self.folder}/current").orderBy(F.desc("value")).limit(1).collect()
        return rows[0]["value"].split(" ", 1)[1] if rows else None

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.current()}/{table}")

    def write(self, table: str, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.folder}/{self.name}/{table}")
        self.tables.append(table)

    def __enter__(self) -> Staged:
        return self

    def __exit__(self, kind, error, trace) -> bool:
        if kind is not None:
            delete(self.spark, f"{self.folder}/{self.name}")
            return False
        before = self.current()
        for table in ([] if before is None else [x.getPath().getName() for x in _fs(self.spark, self.folder)[0].listStatus(_fs(self.spark, f"{self.folder}/{before}")[1])]):
            if table not in self.tables:  # tables that were not written stay as they were
                copy(self.spark, f"{self.folder}/{before}/{table}", f"{self.folder}/{self.name}/{table}")
        stamp = f"{time.time_ns():020d} {self.name}"
        self.spark.range(1).select(F.lit(stamp).alias("value")).coalesce(1).write.mode("append").text(f"{self.folder}/current")
        return False


def save_pairs(rows: DataFrame, path: str, key: str = "key", value: str = "value") -> None:
    """``key=value`` lines."""
    rows.select(F.concat_ws("=", F.col(key), F.col(value)).alias("value")).write.mode("overwrite").text(path)


def append_lines(lines: DataFrame, path: str) -> None:
    lines.select(F.col("value").cast("string")).write.mode("append").text(path)


def rotate(spark: SparkSession, path: str) -> str:
    """Moves a log folder aside; the next append starts a new one. Returns where the old one is."""
    old = f"{path.rstrip('/')}.{time.time_ns()}"
    move(spark, path, old)
    return old


def statistics(df: DataFrame, name: str) -> DataFrame:
    """Statistics of a table as Spark's optimiser has them after an ANALYZE: rows, and for each column its distinct values, nulls, least and greatest."""
    spark = df.sparkSession
    df.write.mode("overwrite").saveAsTable(name)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    stats = spark._jsparkSession.sessionState().catalog().getTableMetadata(spark._jvm.org.apache.spark.sql.catalyst.TableIdentifier(name)).stats().get()
    return spark.createDataFrame([(name, int(str(stats.rowCount().get())))], "name string, n_rows long")


class ResultCache:
    """Results of queries by key, kept by Spark and made again after ``ttl`` seconds."""

    def __init__(self, ttl: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock, self.held = ttl, clock, {}

    def get(self, key, make: Callable[[], DataFrame]) -> DataFrame:
        found = self.held.get(key)
        if found is None or self.clock() - found[0] >= self.ttl:
            if found is not None:
                found[1].unpersist()
            self.held[key] = found = (self.clock(), make().persist())
        return found[1]
