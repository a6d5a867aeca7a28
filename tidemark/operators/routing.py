"""Routing of keys to partitions: hash ranges, value ranges, prefixes, times of validity.

Ranges join on bins of the value line, prefixes on their lengths, so that every join is one of equal keys, however
many routes there are. What is joined is broadcast up to ``MOST_ROUTES`` rows, counted first.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import running_sum
from tidemark.session import ship

ship(sys.modules[__name__])

MOST_ROUTES = 100_000
#: Bins up to which each end of a range makes one of its own; routes a bin, about, and bins beyond.
OWN_BINS, BIN_ROUTES, MOST_BINS = 1000, 100, 10_000


def _routes(routes: DataFrame) -> DataFrame:
    return F.broadcast(routes) if routes.limit(MOST_ROUTES + 1).count() <= MOST_ROUTES else routes


def _number(c: Column, kind: str) -> Column:
    """A number that never falls where the value rises; texts by their first six bytes."""
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return (F.unix_date(c) if kind == "date" else c).cast("double")


def _binned(edges: np.ndarray):
    def binned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(np.searchsorted(edges, b.to_numpy("float64"), side="right").astype("int32"))

    return F.pandas_udf(binned, "int")


def _by_ranges(keys: DataFrame, value: str, routes: DataFrame, low: str, high: str) -> DataFrame:
    """Keys with the routes whose range [low, high) holds their value, null ends open; keys without a value have none."""
    fits = (F.col(low).isNull() | (F.col(value) >= F.col(low))) & (F.col(high).isNull() | (F.col(value) < F.col(high)))
    keys = keys.where(F.col(value).isNotNull())
    # Each key is in one bin, each route in all that its range touches: what fits meets once.
    kinds = dict(routes.dtypes)
    n = routes.count()
    bins = min(MOST_BINS, n // BIN_ROUTES + 1)
    ends = routes.where(F.col(low).isNotNull()).select(_number(F.col(low), kinds[low]).alias("e")).union(routes.where(F.col(high).isNotNull()).select(_number(F.col(high), kinds[high]).alias("e")))
    if 2 * n <= OWN_BINS:
        at = [r.e for r in ends.distinct().collect()]  # OWN_BINS at most
    else:
        at = ends.agg(F.percentile_approx("e", [k / bins for k in range(1, bins)] or [0.5], 10 * MOST_BINS)).first()[0]
    bin_of = _binned(np.unique(np.array(at or [], dtype="float64")))
    ends = routes.withColumn("__from", F.coalesce(_number(F.col(low), kinds[low]), F.lit(float("-inf")))).withColumn("__to", F.coalesce(_number(F.col(high), kinds[high]), F.lit(float("nan"))))
    ends = ends.withColumn("__from", bin_of("__from")).withColumn("__to", bin_of("__to")).where("__from <= __to")
    spread = ends.withColumn("__bin", F.explode(F.sequence("__from", "__to"))).drop("__from", "__to")
    binned = keys.withColumn("__at", _number(F.col(value), dict(keys.dtypes)[value])).withColumn("__bin", bin_of("__at")).drop("__at")
    return binned.join(_routes(spread), "__bin").where(fits).drop("__bin", low, high)


def by_hash_range(keys: DataFrame, hashed: Column, routes: DataFrame) -> DataFrame:
    """Each key with the partition whose range [start, end) holds its hash."""
    bounded = routes.where("start is not null and end is not null")
    return _by_ranges(keys.withColumn("__h", hashed), "__h", bounded, "start", "end").drop("__h")


def by_value_range(keys: DataFrame, value: str, routes: DataFrame) -> DataFrame:
    """Each key with the partitions whose range holds its value; a null end is open."""
    return _by_ranges(keys, value, routes, "low", "high")


def by_prefix(keys: DataFrame, value: str, routes: DataFrame) -> DataFrame:
    """Each key with the partitions any of whose ``prefixes`` it begins with, once each. Null values and prefixes match nothing.

    Of a partition's prefixes those that begin with another of them are left out: at most one of the rest fits a key.
    """
    known = F.array_distinct(F.filter("prefixes", lambda p: p.isNotNull()))
    shortest = routes.withColumn("prefixes", known).withColumn("__p", F.explode(F.filter("prefixes", lambda p: ~F.exists("prefixes", lambda q: (q != p) & p.startswith(q))))).drop("prefixes")
    lengths = [r[0] for r in shortest.select(F.length("__p")).distinct().collect()]  # as many as the longest prefix has letters
    starts = F.array(*[F.when(F.length(value) >= n, F.substring(F.col(value), 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    begun = keys.where(F.col(value).isNotNull()).withColumn("__p", F.explode(F.filter(starts, lambda p: p.isNotNull())))
    return begun.join(_routes(shortest), "__p").drop("__p")


def routed(keys: DataFrame, fallback: Column, found: DataFrame, key: str) -> DataFrame:
    """Keys with their partitions; those that no route holds get the fallback (the hash modulo the number of partitions)."""
    return keys.join(found.select(key, "partition"), key, "left").withColumn("partition", F.coalesce("partition", fallback))


def active_at(records: DataFrame, at: Column, start: str = "valid_from", end: str = "valid_until") -> DataFrame:
    """Records valid at a time; both ends belong to it, null ends are open."""
    return records.where((F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (F.col(end) >= at)))


def replica_score(health: Column, load: Column, same_region: Column, same_zone: Column) -> Column:
    """0.6 x health + 0.25 x (1 - load), and 0.1 and 0.05 more for the region and zone that are preferred (fixed values)."""
    near = F.when(same_region, 0.1).otherwise(0.0) + F.when(same_zone, 0.05).otherwise(0.0)
    return 0.6 * health + 0.25 * (1 - load) + near


def split_plan(partitions: DataFrame, size: str, most: int) -> DataFrame:
    """(partition, child, low, high): partitions with more than ``most`` rows cut into equal ranges of their hash range [start, end)."""
    n = F.ceil(F.col(size) / most).cast("long")
    big = partitions.where(F.col(size) > most).withColumn("__n", n).withColumn("child", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    width = F.col("end") - F.col("start")
    edge = lambda k: F.col("start") + F.floor(width * k / F.col("__n"))
    return big.select("partition", "child", edge(F.col("child")).alias("low"), edge(F.col("child") + 1).alias("high"))


def merge_plan(partitions: DataFrame, size: str, most: int) -> DataFrame:
    """(partition, into): neighbours, in order of ``start``, put together as long as their sizes fit into ``most``.

    Sums run over the whole table of partitions, a row each; a block of sums holds what goes into one.
    """
    upto = running_sum(partitions, [], [F.col("start")], size, "__upto")
    block = upto.withColumn("__b", F.floor((F.col("__upto") - F.col(size)) / most))
    return block.withColumn("into", F.min("start").over(Window.partitionBy("__b"))).select("partition", F.col("into"))


def replica_rank(replicas: DataFrame, partition: str, order: list[Column]) -> DataFrame:
    """The best replica of each partition."""
    return replicas.withColumn("__n", F.row_number().over(Window.partitionBy(partition).orderBy(*order))).where("__n = 1").drop("__n")
