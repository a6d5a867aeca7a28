import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import capping

SCHEMA = "host string, q double, id long, rank int"


def test_best_first_at_temperature_zero(spark):
    r = random.Random(4)
    rows = [("big" if r.random() < 0.4 else r.choice([None, *"abcdefgh"]), r.choice([None, 1.0, 2.0, 3.0, float("nan")]), i, 0) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    by = defaultdict(list)
    for h, q, i, _ in rows:
        if h is not None:
            q = None if q is None or q != q else q
            by[h].append((q is None, -(q or 0), i))
    want = sorted(i for v in by.values() for *_, i in sorted(v)[:7])
    assert sorted(x.id for x in capping.reservoir(df, "host", "q", "id", 7).collect()) == want
    over = sorted(i for v in by.values() if len(v) > 70 for *_, i in sorted(v)[:70])
    assert sorted(x.id for x in capping.reservoir(df, "host", "q", "id", 70, over_cap_only=True).collect()) == over


def test_random_keys_follow_the_weights(spark):
    """Of two records the one with twice the weight comes first twice as often (weights exp(q))."""
    import math

    df = spark.range(20_000).select(F.col("id"), F.concat(F.lit("h"), (F.col("id") / 2).cast("long")).alias("host"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(math.log(2)).alias("q"))
    kept = Counter(r.id % 2 for r in capping.reservoir(df, "host", "q", "id", 1, temperature=1.0).collect())
    assert abs(kept[1] / 10_000 - 2 / 3) < 0.02
    again = capping.reservoir(df.repartition(7), "host", "q", "id", 1, temperature=1.0)
    assert Counter(r.id % 2 for r in again.collect()) == kept


def test_share_and_edges(spark):
    df = spark.createDataFrame([("a", 1.0, i, 0) for i in range(80)] + [("b", 1.0, 100 + i, 0) for i in range(20)], SCHEMA)
    assert Counter(r.host for r in capping.share_cap(df, "host", "q", "id", 0.1).collect()) == {"a": 10, "b": 10}
    assert capping.reservoir(df.limit(0), "host", "q", "id", 3).collect() == []
    assert capping.reservoir(df, "host", "q", "id", 3).columns == df.columns
    assert len(capping.reservoir(df, "host", "q", "id", 80, over_cap_only=True).collect()) == 0
