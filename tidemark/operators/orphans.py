"""References to records that do not exist, at the time of the reference.

Parents and children are put into one long form, tagged, and swept in time order within each
(parent table, key): a parent's appearance counts +1, its removal -1. A child is an orphan where
the running sum is 0. The sweep is one running window: it holds no group in memory and takes any
number of lives of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import day_of
from tidemark.session import materialize

#: One child in so many, by hash, tells which keys are hot; all children are swept.
PROBE = 64
#: A hot key holds at least this share of all children, so that there are at most 1 / SHARE of them.
SHARE = 1 / 50_000


def _time(c: Column, null: str) -> Column:
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(float(null)))


def _hot(children: DataFrame, hot_rows: int) -> DataFrame:
    """(ref, key, salts) of keys with more than ``hot_rows`` children and more than SHARE of them all.

    Whether a key is hot decides how it's dealt to tasks, not what comes out, so a probe by hash is enough.
    """
    probe = materialize(children.where(F.pmod(F.xxhash64("tbl", *[c for c in ("id",) if c in children.columns], "t"), F.lit(PROBE)) == 0).groupBy("ref", "key").agg(F.count("*").alias("n")), "hot")
    all_ = probe.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(hot_rows / PROBE, all_ * SHARE, 1)
    return F.broadcast(probe.where(F.col("n") > least).select("ref", "key", F.ceil(F.col("n") / least).cast("int").alias("salts")))  # 1 / SHARE rows at most


def _swept(children: DataFrame, parents: DataFrame, carried: list[str], salt: Column, hot_rows: int) -> DataFrame:
    """Children without a live parent: ref, key, tbl, at (infinite: unknown) and the carried columns."""
    kids = children.where(F.col("key").isNotNull())
    hot = _hot(kids, hot_rows)
    nothing = F.lit(None)
    kids = kids.join(hot, ["ref", "key"], "left").select("ref", "key", F.pmod(salt, F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), _time(F.col("t"), "inf").alias("at"), F.lit(0).alias("delta"), "tbl", *carried)
    lives = parents.where(F.col("key").isNotNull()).select("ref", "key", _time(F.col("added"), "-inf").alias("added"), _time(F.col("removed"), "inf").alias("removed"))
    # Repeated parents are dropped before they're repeated for the salts.
    lives = lives.where(F.col("removed") > F.col("added")).distinct().join(hot, ["ref", "key"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    ends = lives.select("ref", "key", "salt", F.explode(F.array(F.struct(F.col("added").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("removed").alias("at"), F.lit(-1).alias("delta")))).alias("e"))
    ends = ends.where((F.col("e.delta") > 0) | (F.col("e.at") < float("inf")))
    kinds = dict(kids.dtypes)
    ends = ends.select("ref", "key", "salt", F.col("e.at").alias("at"), F.col("e.delta").alias("delta"), *[nothing.cast(kinds[c]).alias(c) for c in ("tbl", *carried)])
    # At one time parents come before children.
    sweep = Window.partitionBy("ref", "key", "salt").orderBy("at", (F.col("delta") == 0)).rowsBetween(Window.unboundedPreceding, 0)
    return kids.unionByName(ends).withColumn("live", F.sum("delta").over(sweep)).where((F.col("delta") == 0) & (F.col("live") <= 0)).drop("salt", "delta", "live")


def _period() -> Column:
    return day_of(F.when(F.col("at") < float("inf"), F.col("at")))


def orphans(children: DataFrame, parents: DataFrame, *, hot_rows: int = 200_000) -> DataFrame:
    """Children (ref, tbl, key, t, id) whose key has no live row among parents (ref, key, added, removed) at t.

    A parent lives from ``added`` (null: always) up to, not including, ``removed`` (null: for ever). Null keys
    refer to nothing. A child of unknown time (null or NaN) is held against the parents alive in the end and has a
    null period. Repeated children come out each time, repeated parents don't matter. Rows out: tbl, period
    (UTC day), id, key. No children: no rows; no parents: every child.

    Keys of more than ``hot_rows`` children and of more than 1 / 50,000 of them all are salted, their parents' few rows
    repeated for each salt; any other key is a small part of a task's share.
    """
    kids = children.select("ref", "tbl", "key", "t", F.col("id").cast("long").alias("id"))
    return _swept(kids, parents, ["id"], F.xxhash64("tbl", "id"), hot_rows).select("tbl", _period().alias("period"), "id", "key")


def counts(children: DataFrame, parents: DataFrame, *, hot_rows: int = 200_000) -> DataFrame:
    """Orphan references and their keys per table and day: (tbl, period, orphans, orphan_keys).

    Children are added up by key and time before the sweep, which carries counts, no rows; what one day or one key holds
    is added up before it's shuffled.
    """
    kids = children.where(F.col("key").isNotNull()).groupBy("ref", "tbl", "key", "t").agg(F.count("*").alias("n"))
    found = _swept(kids, parents, ["n"], F.xxhash64("tbl", "t"), hot_rows)
    keys = found.groupBy("tbl", _period().alias("period"), "key").agg(F.sum("n").alias("n"))
    return keys.groupBy("tbl", "period").agg(F.sum("n").alias("orphans"), F.count("*").alias("orphan_keys"))
