"""Event streams: per-session text, sessions, caches, logs; batch forms and a streaming form of the windowed count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def concatenated(turns: DataFrame, key: str, seq: str, text: str, out: str) -> DataFrame:
    """The texts of each key in order of ``seq``."""
    return turns.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), "").alias(out))


def sessions(events: DataFrame, gap: str = "120 seconds") -> DataFrame:
    """Runs of one user's events, ended by a gap; works on batch and streaming input."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("started"), "n_events")


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window; with a watermark on streams."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("day"), "event_type", "n_events")


def running_sum(rows: DataFrame, key: str, ts: str, order: list[str], value: Column, out: str, size: str = "DAY") -> DataFrame:
    """The rows with the sum of ``value`` over their key's rows up to them, in order of time and ``order``.

    Each span of time is summed by itself and added to the totals of the spans before it, so a key with many rows is as many tasks as it has spans.
    """
    spans = rows.withColumn("_span", F.date_trunc(size, F.col(ts))).withColumn("_v", value)
    totals = spans.groupBy(key, "_span").agg(F.sum("_v").alias("_t"))
    earlier = W.partitionBy(key).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col(key).alias("_k"), F.col("_span").alias("_s"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    here = F.sum("_v").over(W.partitionBy(key, "_span").orderBy(ts, *order))
    joined = spans.withColumn("_here", here).join(totals, F.col(key).eqNullSafe(F.col("_k")) & F.col("_span").eqNullSafe(F.col("_s")))
    return joined.withColumn(out, F.col("_here") + F.col("_before")).drop("_span", "_v", "_k", "_s", "_here", "_before")


def latest_by_key(ops: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The last value written under each key."""
    return ops.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def cache_state(ops: DataFrame) -> DataFrame:
    """(key, value) after a log of (seq, op, key, value): set writes, delete removes the key, clear removes all before it."""
    cut = ops.agg(F.coalesce(F.max(F.when(F.col("op") == "clear", F.col("seq"))), F.lit(-1)).alias("_cut"))  # one row
    live = ops.filter(F.col("op").isin("set", "delete")).join(F.broadcast(cut), F.col("seq") > F.col("_cut"))
    last = live.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("x"))
    return last.filter("x.op = 'set'").select("key", "x.value")


def alive_after(entries: DataFrame, sweeps: int) -> DataFrame:
    """Entries whose lifetime outlasts so many sweeps."""
    return entries.filter(F.col("ttl") >= sweeps)


def upsert_batch(path: str, key: str, parts: int = 64):
    """A foreachBatch sink that merges each batch into a Parquet table by key (newest batch wins); ``current_table`` reads it.

    Rows lie in ``parts`` partitions by a hash of the key, and a batch rewrites only those that it touches, as a new version of each. A
    partition's versions are numbered by batch, so a batch that is replayed overwrites its own, and one that left no rows is no gap.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")
        new = batch.withColumn("_part", part).persist()
        touched = [r["_part"] for r in new.select("_part").distinct().collect()]  # at most ``parts`` numbers
        if touched:
            old = current_table(spark, path, number, new.columns)
            if old is not None:
                old = old.filter(F.col("_part").isin(touched)).join(new.select(key), key, "left_anti")
            merged = new if old is None else old.unionByName(new)
            merged.withColumn("_version", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part", "_version").parquet(path)
        new.unpersist()

    return sink


def current_table(spark, path: str, before: int | None = None, columns: list[str] | None = None) -> DataFrame | None:
    """The table that ``upsert_batch`` keeps: each partition's newest version (older than ``before`` where given); None if there is none."""
    from ..operators.storage import exists

    if not exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    old = rows if before is None else rows.filter(F.col("_version") < before)
    last = old.select("_part", "_version").groupBy("_part").agg(F.max("_version").alias("_version"))  # folder names only
    kept = old.join(F.broadcast(last), ["_part", "_version"], "left_semi").drop("_version")
    return kept if columns is None else kept.select(*columns)
