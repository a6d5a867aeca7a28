import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import sketches


def test_registers_are_exponential_and_mergeable():
    rng = np.random.default_rng(5)
    keys = rng.integers(-(1 << 62), 1 << 62, 5000)
    whole, left, right = (np.full((1, 512), np.inf) for _ in range(3))
    sketches.add(whole, np.zeros(5000, np.int64), keys)
    sketches.add(left, np.zeros(3000, np.int64), keys[:3000])
    sketches.add(right, np.zeros(3500, np.int64), keys[1500:])
    assert (np.minimum(left, right) == whole).all()
    again = whole.copy()
    sketches.add(again, np.zeros(5000, np.int64), keys[::-1].copy())
    assert (again == whole).all()
    # Registers times the count follow the unit exponential distribution.
    u = np.sort(1 - np.exp(-whole[0] * 5000))
    assert np.abs(u - (np.arange(512) + 0.5) / 512).max() < 1.63 / math.sqrt(512)


def test_estimates_hold_their_bounds():
    rng = np.random.default_rng(6)
    inside, ratios = 0, []
    for n in (1, 10, 1000, 20_000):
        for _ in range(15):
            r = np.full((1, 256), np.inf)
            sketches.add(r, np.zeros(n, np.int64), rng.integers(-(1 << 62), 1 << 62, n))
            est, lo, hi = sketches.interval(float(r.sum()), 256, 0.95)
            inside += lo <= n <= hi
            ratios.append(est / n)
    assert inside >= 52
    assert abs(np.mean(ratios) - 1) < 4 / math.sqrt(254 * len(ratios))


def test_cube_with_nulls_and_skew(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 7)).alias("day"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), F.col("id") % 4)).alias("source"),
        F.concat(F.lit("h"), F.col("id") % 9000).alias("host"),
        F.lit(1).alias("grp"),
    )
    rows = rows.unionByName(rows.limit(100).withColumn("host", F.lit(None).cast("string")))
    got = {(r.grouped, r.day, r.source): r for r in sketches.distinct_cube(rows.repartition(6), ["day", "source"], "host").collect()}
    for dims in ([], ["day"], ["source"], ["day", "source"]):
        for r in rows.groupBy(*dims).agg(F.count_distinct("host").alias("n")).collect():
            x = got.pop((",".join(dims), r["day"] if "day" in dims else None, r["source"] if "source" in dims else None))
            assert abs(x.estimate / r.n - 1) < 5 * x.rel_error and x.lo < x.estimate < x.hi
    assert not got
    assert sketches.distinct_cube(rows.limit(0), ["day"], "host").collect() == []


def test_stored_sketches_merge_with_later_ones(spark):
    rows = spark.range(4000).select(F.lit("g").alias("day"), F.col("id").cast("string").alias("host"))
    a, b = (sketches.sketches(rows.where(c), ["day"], "host", 128) for c in ("id < 2500", "id >= 1500")) if "id" in rows.columns else (sketches.sketches(rows.where(F.col("host").cast("long") < 2500), ["day"], "host", 128), sketches.sketches(rows.where(F.col("host").cast("long") >= 1500), ["day"], "host", 128))
    both = sketches.merged(a.unionByName(b), 128).collect()
    whole = sketches.merged(sketches.sketches(rows, ["day"], "host", 128), 128).collect()
    assert len(both) == 1 and both == whole


def test_few_identifiers_stay_hashes(spark):
    """Small groups cost 8 bytes an identifier, and give the same registers in the end."""
    rows = spark.range(3000).select(F.concat(F.lit("d"), F.col("id") % 300).alias("day"), F.col("id").cast("string").alias("host"))
    parts = sketches.sketches(rows.repartition(3), ["day"], "host").collect()
    assert max(len(r.registers) for r in parts) <= 80
    one = np.frombuffer(sketches.merged(sketches.sketches(rows, ["day"], "host")).where("grp = '=d7'").first().registers, "<u8")
    dense, some = sketches._dense([one, one[:4]], 1024)
    assert (sketches._union([some, one[4:]], 1024) == dense).all() and len(one) == 10
    assert (sketches._union([one[:4], one[2:]], 1024) == one).all()
