"""A feed of inserts, updates and deletes, applied by a keyed stream.

The state of a key is its payload with the sequence number of its newest change, the number of its
newest insert and its tombstone, the number of its newest delete. Each part moves only to a newer
number, so repeated changes and changes out of order, within a batch or over batches, lead to the
same state. Spark adds a batch up by key before the shuffle, so a key with a third of all changes
sends one row a task. Every micro-batch writes the keys it touched under its own version; a batch
run again replaces its own output. Old batches can be folded into a base.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import files_of, scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Feed:
    """How to read a change feed. inserts and deletes: values of ``action``; any other updates."""

    key: str
    sequence: str
    action: str
    inserts: tuple[str, ...]
    deletes: tuple[str, ...]
    payload: tuple[str, ...] = field(default=())


def _states(changes: DataFrame, feed: Feed) -> DataFrame:
    seq, act = F.col(feed.sequence).cast("long"), F.col(feed.action)

    def newest(when: Column) -> Column:
        return F.max(F.when(when, seq))

    payload = [F.col(c).alias(c) for c in dict.fromkeys((feed.action, *feed.payload)) if c not in (feed.key, feed.sequence)]
    return (
        changes.where(F.col(feed.key).isNotNull() & seq.isNotNull())
        .groupBy(feed.key)
        .agg(F.max(F.struct(seq.alias("__sequence"), *payload)).alias("__last"), newest(act.isin(*feed.inserts)).alias("__inserted"), newest(act.isin(*feed.deletes)).alias("__tombstone"))
    )


def source(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """A stream of a parquet folder, or of a single file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(schema).options(**options)
    return reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent().toString())) if single else reader.parquet(path)


def apply_stream(changes: DataFrame, feed: Feed, out: str, checkpoint: str) -> None:
    """Runs a stream of changes to its present end; upserts go to ``out``/__batch=<number>."""
    spark, setting = changes.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/__batch={number}")

    spark.conf.set(setting, ROCKSDB)  # keys on disk, not on the heap
    try:
        query = _states(changes, feed).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the complete tables ``prefix``<number> of a folder, in order."""
    return sorted(int(n.removeprefix(prefix)) for n, _, _ in files_of(spark, path) if n.startswith(prefix) and any(f == "_SUCCESS" for f, _, _ in files_of(spark, f"{path}/{n}")))


def _upserts(spark: SparkSession, out: str, schema: T.StructType) -> tuple[list[DataFrame], int]:
    """The newest base, if there is one, and the batches after it, oldest first; the last batch's number."""
    bases, batches = _numbers(spark, f"{out}-base", "upto="), _numbers(spark, out, "__batch=")
    last = bases[-1] if bases else -1
    paths = [f"{out}-base/upto={last}"] * bool(bases) + [f"{out}/__batch={n}" for n in batches if n > last]
    return [spark.read.schema(schema).parquet(p) for p in paths], max([last, *batches])


def fold(spark: SparkSession, out: str, like: DataFrame, feed: Feed) -> None:
    """Folds all batches so far into one base, tombstones too; later reads take the base and the batches after it."""
    tables, last = _upserts(spark, out, _states(like, feed).schema)
    if len(tables) > 1:
        _newest(tables, feed).write.mode("overwrite").parquet(f"{out}-base/upto={last}")


def _newest(tables: list[DataFrame], feed: Feed) -> DataFrame:
    """One row a key. A batch holds whole states, one row a key, so a single table is left as it is."""
    if len(tables) == 1:
        return tables[0]
    parts = ("__last", "__inserted", "__tombstone")
    return reduce(DataFrame.unionByName, tables).groupBy(feed.key).agg(*[F.max(c).alias(c) for c in parts])


def present(spark: SparkSession, out: str, like: DataFrame, feed: Feed) -> DataFrame:
    """The present table from the written upserts. like: a batch or stream with the feed's columns.

    Keys whose tombstone is newer than their insert are gone; else the last change is the insert or newer: it was applied.
    """
    states = _states(like, feed)
    tables, _ = _upserts(spark, out, states.schema)
    newest = _newest(tables, feed) if tables else states.limit(0)
    there = F.col("__inserted") > F.coalesce("__tombstone", F.lit(-(1 << 63)))
    return newest.where(there).select(feed.key, F.col("__last.__sequence").alias(feed.sequence), *[F.col(f"__last.{c}").alias(c) for c in dict.fromkeys((feed.action, *feed.payload))])


def rebuild(spark: SparkSession, path: str, feed: Feed, *, bytes_per_batch: int = 16 << 30) -> DataFrame:
    """Present state of a table from the feed stored at ``path``: key, sequence, action, payload of each live key.

    Changes without key or sequence can't be placed and are passed over; a null action updates. Updates of a key
    that isn't there change nothing; a key without insert after its last delete doesn't come out. An empty feed
    gives an empty table.
    """
    batch = spark.read.parquet(path)
    need = list(dict.fromkeys((feed.key, feed.sequence, feed.action, *feed.payload)))
    schema = T.StructType([batch.schema[c] for c in need])
    out, checkpoint = scratch(spark, "upserts"), scratch(spark, "stream")
    apply_stream(source(spark, path, schema, maxBytesPerTrigger=str(bytes_per_batch)), feed, out, checkpoint)
    return present(spark, out, batch.select(*need), feed)
