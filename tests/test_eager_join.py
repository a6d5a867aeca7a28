from pyspark.sql import functions as F

from tidemark.operators import eager_join as E

LEFT = "k string, x int, n long, pairs long"


def make(spark, left, right, how):
    a = E.states(spark.createDataFrame(left, LEFT).where("k is not null"), ["k"], {"sx": "x"}, {"mx": "x"}, count="ln")
    b = E.states(spark.createDataFrame(right, "k string, y int, n long").where("k is not null"), ["k"], {"sy": "y"}, count="rn")
    return E.joined(a, b, "k", left_count="ln", right_count="rn", left_sums=["sx"], right_sums=["sy"], how=how)


def test_equals_the_join_of_raw_rows(spark):
    left = [("a", i, 1, 1) for i in range(50)] + [("b", None, 1, 1), ("b", 3, 1, 1), ("c", 7, 1, 1), (None, 1, 1, 1)]
    right = [("a", 1, 2), ("a", None, 2), ("b", 5, 2), ("b", 5, 2), ("z", 9, 2), (None, 4, 2)]
    for how in ("left", "inner"):
        raw = spark.createDataFrame(left, LEFT).where("k is not null").join(spark.createDataFrame(right, "k string, y int, m long"), "k", how)
        want = raw.groupBy("k").agg(F.count("*"), F.coalesce(F.sum("x"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0)), F.max("x"))
        got = make(spark, left, right, how).select("k", "pairs", "sx", "sy", "mx")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_empty_sides(spark):
    assert make(spark, [], [("a", 1, 1)], "left").collect() == []
    assert [(r.pairs, r.sy) for r in make(spark, [("a", 1, 1, 1)], [], "left").collect()] == [(1, 0)]


def test_dominant_keys(spark):
    rows = [("big",)] * 60 + [("tie",)] * 20 + [(f"k{i}",) for i in range(20)] + [(None,)] * 50
    compact = E.states(spark.createDataFrame(rows, "k string"), ["k"], count="n")
    assert {r.k for r in E.dominant(compact, "k", "n", 0.2).collect()} == {"big", "tie"}
    assert E.dominant(compact.limit(0), "k", "n", 0.2).collect() == []
