"""Changes of tables as plans: each takes old rows and changes and returns the new rows, to be written beside the old table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows, and the new rows whose key is not there yet; of new rows that share a key the least by its columns comes in."""
    one = new.groupBy(key).agg(F.min(F.struct(*[c for c in old.columns if c != key])).alias("_x"))
    return old.unionByName(one.join(old.select(key), key, "left_anti").select(*[F.col(c) if c == key else F.col(f"_x.{c}").alias(c) for c in old.columns]))


def updated(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of ``changes`` replace those of the same key; its nulls change nothing, and of changes that share a key the greatest value counts."""
    names = [c for c in changes.columns if c != key]
    new = changes.groupBy(key).agg(*[F.max(c).alias(f"_new_{c}") for c in names])
    return old.join(new, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in old.columns])


def nulled(rows: DataFrame, reference: str, gone: DataFrame, key: str = "id") -> DataFrame:
    """References to rows that are gone become null."""
    lost = gone.select(F.col(key).alias("_gone")).distinct()
    return rows.join(lost, F.col(reference) == F.col("_gone"), "left").select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == reference else F.col(c) for c in rows.columns])


def changed(old: DataFrame, new: DataFrame, key: str, content_hash: str) -> DataFrame:
    """(key, change) of the rows that are added, removed, or of another hash."""
    a = old.select(key, F.col(content_hash).alias("_a"), F.lit(True).alias("_old"))
    b = new.select(key, F.col(content_hash).alias("_b"), F.lit(True).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change IS NOT NULL")


def reindexed(old: DataFrame, fresh: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of unchanged keys as they were, rows of changed keys from the fresh extraction."""
    return old.join(changes.select(key), key, "left_anti").select(*old.columns).unionByName(fresh.join(changes.select(key), key, "left_semi").select(*old.columns))


def dump(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table each; a folder that holds a dump already is not overwritten."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def restore(spark, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def compacted(df: DataFrame, folder: str, files: int) -> DataFrame:
    """The table rewritten as so many files at most, without a shuffle."""
    df.coalesce(files).write.mode("errorifexists").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
