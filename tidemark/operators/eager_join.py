"""Eager aggregation through joins, for keys of which a few hold most rows.

Both inputs shrink to one row a key before they meet: the shuffle carries partial sums, so a hot
key costs one row a map task and the join itself is one row against one. What the join of the raw
rows would have given follows by algebra: counts multiply, and a sum of one side is taken as often
as the other side has rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def states(rows: DataFrame, keys: list[str], sums: Mapping[str, str] = {}, maxima: Mapping[str, str] = {}, count: str = "n") -> DataFrame:
    """Compact state of each key: its number of rows, sums and maxima (output name: column)."""
    aggs = [F.count("*").alias(count)]
    aggs += [F.coalesce(F.sum(F.col(c)), F.lit(0)).alias(out) for out, c in sums.items()]
    aggs += [F.max(F.col(c)).alias(out) for out, c in maxima.items()]
    return rows.groupBy(*keys).agg(*aggs)


def joined(left: DataFrame, right: DataFrame, key: str, *, left_count: str, right_count: str, left_sums: list[str], right_sums: list[str], how: str = "left") -> DataFrame:
    """Joins two compact states as if their raw rows had been joined.

    ``pairs`` is the number of joined rows; sums become those over the joined rows. In a left join a key without
    partner counts as one joined row for each of its own, as it would have been. Null keys match nothing.
    """
    n, m = F.col(left_count), F.col(right_count)
    times = F.greatest(F.coalesce(m, F.lit(0)), F.lit(1)) if how == "left" else m
    out = left.join(right, key, how)
    out = out.withColumn("pairs", n * times).withColumn(right_count, F.coalesce(m, F.lit(0)))
    for c in left_sums:
        out = out.withColumn(c, F.col(c) * times)
    for c in right_sums:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)) * n)
    return out


def dominant(compact: DataFrame, key: str, count: str, share: float) -> DataFrame:
    """Keys that hold at least a share of all rows: 1 / share rows at most. Null keys neither count nor come out."""
    known = compact.where(F.col(key).isNotNull())
    total = known.agg(F.sum(count).alias("total")).scalar()
    return known.where(F.col(count) >= total * F.lit(share)).select(key, count)
