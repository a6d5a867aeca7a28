import random

from pyspark.sql import functions as F

from tidemark.operators import graph, knowledge


def test_components_match_union_find(spark):
    r = random.Random(4)
    edges = [(f"n{r.randrange(90):02}", f"n{r.randrange(90):02}") for _ in range(60)] + [("hub", f"x{i}") for i in range(40)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)] + [(None, "a"), ("s", "s")]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(edges, "source string, target string"))
    assert {x.node: x.component for x in got.collect()} == {n: find(n) for n in up}
    assert graph.components(spark.createDataFrame([], "source string, target string")).collect() == []


def test_inference(spark):
    t = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.8), ("a", "d", 1.0), ("d", "c", 0.2), ("c", "a", 1.0), ("a", "e", 1.0), ("e", "b", 1.0)], "subject string, object string, confidence double")
    got = {(r.subject, r.object): (round(r.confidence, 3), r.evidence) for r in knowledge.infer(t, 0.5).collect()}
    assert got[("a", "c")] == (0.2, 2) and ("a", "b") not in got and ("a", "a") not in got


def test_percentiles_are_exact(spark):
    import math

    r = random.Random(5)
    rows = [(r.choice("ab"), r.choice([None, *range(20)])) for _ in range(500)]
    got = {x.k: x for x in knowledge.percentile_gate(spark.createDataFrame(rows, "k string, v int"), ["k"], "v", {"p50": 0.5, "p99": 0.99}, "p99", 18).collect()}
    for k in "ab":
        v = sorted(x for g, x in rows if g == k and x is not None)
        assert got[k].p50 == v[math.ceil(len(v) * 0.5) - 1] and got[k].p99 == v[math.ceil(len(v) * 0.99) - 1] and got[k].passed == (got[k].p99 <= 18)


def test_validation_gaps_allocation(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", None)], "k string, v int")
    got = knowledge.validated(df, [("no key", F.col("k").isNull()), ("no value", F.col("v").isNull())])
    assert sorted((str(r.reason), r.accepted) for r in got.collect()) == [("None", True), ("no key", False), ("no value", False)]
    g = knowledge.gaps(spark.createDataFrame([("a", 4), ("b", 0)], "k string, expected int"), spark.createDataFrame([("a", 1)], "k string, actual int"), "k")
    assert {(r.k, r.deficit, r.gap) for r in g.collect()} == {("a", 3, 75.0), ("b", 0, 0.0)}
    w = spark.createDataFrame([("p", i, 2) for i in range(5)], "k string, n int, c int")
    assert sorted(r.n for r in knowledge.allocate(w, "k", "c", [F.col("n")], 5).collect()) == [0, 1]
    c = spark.createDataFrame([("u", 1, "a", None), ("u", 2, "a", None), ("u", 3, None, "x")], "k string, n int, a string, b string")
    assert [(r.n, r.changes, r.magnitude) for r in knowledge.compared(c, "k", "n", ["a", "b"]).orderBy("n").collect()] == [(2, 0, 0.0), (3, 2, 1.0)]
