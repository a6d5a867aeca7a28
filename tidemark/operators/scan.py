"""Running sums over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize, parallelism


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over a key's rows up to and with each row, in an order without ties.

    Two levels: rows are cut into ranges of (keys, order), so a key that holds a third of all rows fills as many ranges
    as it needs; a range's sum of the ranges before it is worked out from one row a key and range. Null values add
    nothing; null keys are a key like others.
    """
    spark = rows.sparkSession
    ranged = materialize(rows.repartitionByRange(parallelism(spark), *[F.col(k) for k in keys], *order).withColumn("__range", F.spark_partition_id()), "ranges")
    upto = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "__range").agg(F.sum(value).alias("__sum"))
    before = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"), F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__before"))
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(before, same).withColumn(name, F.col("__before") + F.coalesce(F.sum(value).over(within), F.lit(0)))
    return out.drop("__range", "__r", "__before", *[f"__k{i}" for i in range(len(keys))])
