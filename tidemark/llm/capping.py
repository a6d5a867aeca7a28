"""Caps on records per contributor: weighted reservoirs without replacement.

Every record draws an exponential random key scaled by its quality; each contributor keeps the
records with the largest keys. In logarithms the key is ``quality / temperature + noise`` with
Gumbel noise, the larger the better; weights are then ``exp(quality / temperature)``. As the
temperature goes to 0, quality alone decides, which is the plain "best first" cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import running_sum


def random_key(quality: Column, unit: Column, temperature: float) -> Column:
    """Sort key of a record. unit: uniform in (0, 1), fixed for the record. Temperature 0: quality itself.

    Null and NaN quality give a null key, which stands last.
    """
    q = F.nanvl(quality.cast("double"), F.lit(None).cast("double"))
    return q if temperature == 0 else q / F.lit(float(temperature)) - F.log(-F.log(unit))


def unit_of(seed: int, *columns: Column) -> Column:
    """Uniform number in (0, 1) from a record's id: the same whenever and wherever it is computed."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def reservoir(records: DataFrame, contributor: str, quality: str, record_id: str, cap: int, *, temperature: float = 0.0, seed: int = 7, over_cap_only: bool = False) -> DataFrame:
    """Keeps at most ``cap`` records of each contributor: those with the largest keys, ties by smaller id.

    Records without a contributor (null) belong to none and are left out; a contributor with fewer records
    keeps them all, unless over_cap_only, which returns the kept records of cut contributors only. Other
    columns come through unchanged. Repeated rows count each. No rows in: no rows out.

    Spark cuts each map task's records to the best cap + 1 of each contributor before the shuffle
    (WindowGroupLimit), so a contributor with a third of all rows sends cap + 1 rows a task.
    """
    key, rank = "__reservoir_key", "__reservoir_rank"
    keyed = records.where(F.col(contributor).isNotNull()).withColumn(key, random_key(F.col(quality), unit_of(seed, F.col(record_id)), temperature))
    w = Window.partitionBy(contributor)
    limit = cap + 1 if over_cap_only else cap
    kept = keyed.withColumn(rank, F.row_number().over(w.orderBy(F.col(key).desc_nulls_last(), F.col(record_id).asc()))).where(F.col(rank) <= limit)
    if over_cap_only:
        kept = kept.withColumn(key, F.max(rank).over(w)).where((F.col(key) > cap) & (F.col(rank) <= cap))
    return kept.drop(key, rank)


def share_cap(records: DataFrame, contributor: str, quality: str, record_id: str, share: float, *, temperature: float = 0.0, seed: int = 7) -> DataFrame:
    """Caps each contributor at a share of all records that have one (at least one record each), as ``reservoir`` does.

    Such a cap grows with the data, so records are numbered by ranges of (contributor, key) over the whole cluster: a
    contributor with a third of all rows, or a cap of many millions, fills as many ranges as it needs.
    """
    known = records.where(F.col(contributor).isNotNull())
    cap = max(1, int(known.count() * share))
    key, rank = "__reservoir_key", "__reservoir_rank"
    keyed = known.withColumn(key, random_key(F.col(quality), unit_of(seed, F.col(record_id)), temperature)).withColumn("__one", F.lit(1))
    kept = running_sum(keyed, [contributor], [F.col(key).desc_nulls_last(), F.col(record_id).asc()], "__one", rank).where(F.col(rank) <= cap)
    return kept.drop(key, rank, "__one")
