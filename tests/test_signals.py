import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.udfs import prefixed_url
from tidemark.operators import frontier, routing, scan, signals


def test_running_sums_match_brute_force(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), i, r.choice([None, 1, 2, 5])) for i in range(800)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n int, v int")
    got = {(x.k, x.n): x.s for x in scan.running_sum(df, ["k"], [F.col("n").desc()], "v", "s").collect()}
    sums = {}
    for k, n, v in sorted(rows, key=lambda x: -x[1]):
        sums[k] = sums.get(k, 0) + (v or 0)
        assert got[k, n] == sums[k]
    assert scan.running_sum(df.limit(0), ["k"], [F.col("n")], "v", "s").collect() == []


def test_clamped_feedback_folds_any_history(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), r.randrange(-50, 5000), r.choice([1, -1, 3, None])) for _ in range(1500)] + [(None, 1, 1), ("a", None, 1)]
    df = spark.createDataFrame(rows, "k string, n long, s int")
    want = {}
    for k, n, s in sorted([x for x in rows if None not in x], key=lambda x: (x[0], x[1], x[2] > 0)):
        want[k] = max(-20, min(20, want.get(k, 0) + s))
    # Steps of one order and sign count together.
    for block in (4, 1024):
        assert {x.k: x.score for x in frontier.clamped_feedback(df, "k", "n", "s", block=block).collect()} == want
    assert frontier.clamped_feedback(df.limit(0), "k", "n", "s").collect() == []


def test_weighted_signals(spark):
    long = spark.createDataFrame([("d", "a", 0.5, 1.0), ("d", "b", 2.0, 0.5), ("d", "c", 1.0, 1.0), ("d", "a", None, 1.0), ("e", "a", -1.0, 1.0)], "k string, name string, value double, confidence double")
    w = spark.createDataFrame([("f", "a", 1.0), ("f", "b", 2.0)], "family string, name string, weight double")
    got = {r.k: (r.score, r.evidence) for r in signals.weigh(long, w, ["k"]).collect()}
    assert got == {"d": (0.75, 2), "e": (0.0, 1)}
    assert {r.k: r.score for r in signals.weigh(long, w, ["k"], "sum").collect()} == {"d": 1.5, "e": 0.0}
    assert signals.weigh(long.limit(0), w, ["k"]).collect() == []


def test_waits_and_overtaking(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(frontier.failure_backoff(F.lit(n))) for n in (0, 1, 2, 99)] == [0.0, 30.0, 60.0, 3600.0]
    # Ten hours of waiting are worth 20, no more.
    over = lambda a, since, b: one(frontier.overtakes(F.lit(a), F.lit(since), F.lit(b), F.lit(100_000.0), 100_000.0))
    assert over(10.0, 64_000.0, 29.0) and not over(10.0, 64_000.0, 30.0) and not over(10.0, 0.0, 30.0)


def test_prefixes_and_fallback(spark):
    keys = spark.createDataFrame([("m.x",), ("m.blog.y",), ("zz",), (None,), ("",)], "h string")
    routes = spark.createDataFrame([("web", ["m.", "m.blog.", None]), ("blog", ["m.blog."]), ("none", []), ("null", None)], "partition string, prefixes array<string>")
    found = routing.by_prefix(keys, "h", routes)
    assert sorted(map(tuple, found.collect())) == [("m.blog.y", "blog"), ("m.blog.y", "web"), ("m.x", "web")]
    all_ = routing.routed(keys.where("h = 'zz'"), F.lit("p7"), found, "h")
    assert [tuple(r) for r in all_.collect()] == [("zz", "p7")]


@pytest.mark.parametrize("raw,want", [("https://Ex.com:443/a//?b=2&UTM_source=x&a=&refresh=1#f", "https://ex.com/a?b=2&a="), ("http://ex.com:8080", "http://ex.com:8080/"), ("HTTP://ex.com", None), ("http://localhost/", None), ("ftp://a.b", None), (None, None), ("http://a.b:x/", None)])
def test_prefixed_urls(raw, want):
    assert prefixed_url(raw) == want
