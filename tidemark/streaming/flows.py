"""Streams: windows with late data, duplicates, incremental index segments, leases that run out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize, scratch
from tidemark.streaming.changes import source

__all__ = ["append", "dedup", "deliver", "fenced", "index_segments", "leases", "source", "upserts", "windowed"]


def append(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream to its present end in append mode; what it gave, as a table."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def upserts(stream: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Runs a stream of changing rows to its present end; the newest version of each key, as a table.

    Every micro-batch writes what changed under its own number, so a batch run again replaces its own output.
    """
    spark, out = stream.sparkSession, scratch(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", scratch(spark, f"{name}-state")).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    versions = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    w = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return versions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "batch")


def windowed(events: DataFrame, time: str, width: str, keys: Sequence[str], value: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums over windows of event time; rows later than ``late`` may be dropped from a stream's state."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withWatermark(time, late).groupBy(w.alias("window"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Sessions of each key, closed by a gap of event time."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("session.start").alias("start"), "n")


def dedup(stream: DataFrame, keys: Sequence[str], time: str, within: str) -> DataFrame:
    """The first row of each key; a key is remembered for a span of event time, so that state has an end."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([*keys])


def deliver(spark: SparkSession, path: str, handle: Callable[[DataFrame], DataFrame], attempts: int = 3, base: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Runs a stream of messages (message_id, ...) of a parquet folder through ``handle``, which adds ``failed``.

    Messages that fail come again, up to so many attempts with waits of base^n seconds between them (told, not slept);
    then they are dead. Each batch replaces its own output. Tables: delivered (message_id, attempts, waited) and dead.
    """
    out = scratch(spark, "delivery")

    def process(batch: DataFrame, number: int) -> None:
        left = batch.withColumn("__attempt", F.lit(0))
        for n in range(1, attempts + 1):
            tried = materialize(handle(left.withColumn("__attempt", F.lit(n))), "attempt")
            tried.where("not failed").select("message_id", F.col("__attempt").alias("attempts"), F.lit(sum(base**k for k in range(1, n))).alias("waited"), F.lit(False).alias("dead")).write.mode("overwrite").parquet(f"{out}/batch={number}/attempt={n}")
            left = tried.where("failed").drop("failed")
        left.select("message_id", F.lit(attempts).alias("attempts"), F.lit(sum(base**k for k in range(1, attempts))).alias("waited"), F.lit(True).alias("dead")).write.mode("overwrite").parquet(f"{out}/batch={number}/attempt={attempts + 1}")

    messages = source(spark, path, spark.read.parquet(path).schema)
    messages.writeStream.option("checkpointLocation", scratch(spark, "delivery-state")).foreachBatch(process).trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema("message_id long, attempts int, waited double, dead boolean, batch long, attempt int").parquet(out).drop("batch", "attempt")
    return told.where("not dead").drop("dead"), told.where("dead").drop("dead")


def fenced(writes: DataFrame, key: str, token: str, order: str) -> DataFrame:
    """Adds ``accepted``: a write counts unless an earlier one of its key bore a higher token. Null tokens are refused."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return writes.withColumn("accepted", F.coalesce(F.col(token) >= F.max(token).over(before), F.lit(False)))


def index_segments(documents: DataFrame, add: Callable[[DataFrame, int], object], checkpoint: str) -> None:
    """Indexes a stream of documents: each micro-batch becomes a segment of its own number, in its place if it's run again."""

    def write(batch: DataFrame, number: int) -> None:
        add(batch, number)

    query = documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


LEASES = "work_id string, worker_id string, state string, at double"


def _lease(seconds: float):
    def lease(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            worker, until = state.get
            state.remove()
            yield pd.DataFrame([(key[0], worker, "expired", until)], columns=["work_id", "worker_id", "state", "at"])
            return
        rows = pd.concat([*batches]).sort_values(["event_id"])
        held = state.get if state.exists else None
        out = []
        for r in rows.itertuples():
            if held and r.at > held[1]:
                out.append((key[0], held[0], "expired", held[1]))
                held = None
            if r.claims:
                held = (r.worker_id, r.at + seconds)
                out.append((key[0], r.worker_id, "leased", r.at))
            elif held:
                out.append((key[0], held[0], "released", r.at))
                held = None
        if held:
            state.update(held)
            state.setTimeoutTimestamp(max(int(held[1] * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["work_id", "worker_id", "state", "at"])

    return lease


def leases(events: DataFrame, seconds: float, late: str = "10 minutes") -> DataFrame:
    """Leases of a stream (work_id, event_id, worker_id, claims, at, time): taken, released by a later event, or expired.

    time: TIMESTAMP of ``at``. A lease that nothing ends expires when the watermark passes its end.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.withWatermark("time", late).groupBy("work_id").applyInPandasWithState(_lease(seconds), LEASES, "worker_id string, until double", "append", GroupStateTimeout.EventTimeTimeout)


def stream_of(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    """A stream of one of the engine's tables."""
    path = f"{sf_dir}/{name}.parquet"
    return source(spark, path, spark.read.parquet(path).schema, **options)
