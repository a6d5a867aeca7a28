"""Stored objects as tables: chunks, shards, replicas, integrity, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_chunks(objects: DataFrame, key: str, data: str, size: int) -> DataFrame:
    """(key, chunk, part): pieces of at most ``size`` characters or bytes. Null has none, empty one."""
    n = F.greatest(F.lit(1), F.ceil(F.length(data) / size).cast("int"))
    numbered = objects.where(F.col(data).isNotNull()).select(key, data, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return numbered.select(key, "chunk", F.substring(F.col(data), F.col("chunk") * size + 1, F.lit(size)).alias("part"))


def join_chunks(chunks: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """(key, data, complete): objects put together again; complete where no number is missing (and the count is as told)."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "part")))
    out = chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("data"), (F.max("chunk") + 1 == F.count_distinct("chunk")).alias("complete"), F.count_distinct("chunk").alias("chunks"))
    if counts is not None:
        out = out.join(counts, key, "left").withColumn("complete", F.col("complete") & (F.col("chunks") == F.col("expected")))
    return out


def shard(key: Column, shards: int) -> Column:
    """Shard of a key: first 64 bits of its SHA-256, unsigned, modulo the number of shards."""
    wide = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (wide % F.lit(shards).cast("decimal(20,0)")).cast("int")


def rebalance_plan(keys: DataFrame, key: str, old: int, new: int) -> DataFrame:
    """Keys that move, and where, when the number of shards changes."""
    return keys.select(key, shard(F.col(key), old).alias("from_shard"), shard(F.col(key), new).alias("to_shard")).where("from_shard <> to_shard")


def quorum(copies: DataFrame, key: str, replica: str, need: int) -> DataFrame:
    """(key, replicas, durable): on how many replicas a key stands, and whether that's enough."""
    return copies.groupBy(key).agg(F.count_distinct(replica).alias("replicas")).withColumn("durable", F.col("replicas") >= need)


def replica_repair(source: DataFrame, target: DataFrame, key: str, checksum: str) -> DataFrame:
    """(key, action): what makes the target equal to its source: put, replace or delete."""
    s = source.select(key, F.col(checksum).alias("__s")).dropDuplicates([key])
    t = target.select(key, F.col(checksum).alias("__t")).dropDuplicates([key])
    action = F.when(F.col("__t").isNull(), "put").when(F.col("__s").isNull(), "delete").when(F.col("__s") != F.col("__t"), "replace")
    return s.join(t, key, "full").select(key, action.alias("action")).where(F.col("action").isNotNull())


def integrity(objects: DataFrame, data: str, checksum: str) -> DataFrame:
    """One row: objects checked, healthy, corrupted, missing."""
    d, c = F.col(data), F.col(checksum)
    return objects.agg(F.count("*").alias("checked"), F.count_if(F.sha2(d.cast("binary"), 256) == c).alias("healthy"), F.count_if(d.isNotNull() & (F.sha2(d.cast("binary"), 256) != c)).alias("corrupted"), F.count_if(d.isNull()).alias("missing"))


def replay(log: DataFrame, key: str, order: str, op: str, value: str) -> DataFrame:
    """State after a log of puts and deletes: the last entry of each key, unless it's a delete."""
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(op, value), order).alias("l"))
    return last.where(F.col(f"l.{op}") != "delete").select(key, F.col(f"l.{value}").alias(value))


def overlay(base: DataFrame, changes: DataFrame, key: str, value: str, deleted: str) -> DataFrame:
    """What a transaction sees: its own writes over the base, without what it deleted."""
    c = changes.select(key, F.col(value).alias("__v"), F.col(deleted).alias("__d"))
    both = base.select(key, value, F.lit(True).alias("__b")).join(c, key, "full")
    return both.where(~F.coalesce("__d", F.lit(False))).select(key, F.when(F.col("__d").isNotNull(), F.col("__v")).otherwise(F.col(value)).alias(value))
