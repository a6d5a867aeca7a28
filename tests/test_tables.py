import hashlib
import random

from pyspark.sql import functions as F

from tidemark.operators import frontier, graph, index, routing, storage


def test_chunks_round_trip(spark):
    rows = [(1, "abcdefg"), (2, ""), (3, None), (4, "é" * 9)]
    df = spark.createDataFrame(rows, "k int, d string")
    back = storage.join_chunks(storage.split_chunks(df, "k", "d", 3), "k")
    assert {r.k: (r.data, r.complete) for r in back.collect()} == {1: ("abcdefg", True), 2: ("", True), 4: ("é" * 9, True)}
    holes = storage.split_chunks(df, "k", "d", 3).where("not (k = 1 and chunk = 1)")
    assert {r.k: r.complete for r in storage.join_chunks(holes, "k").collect()}[1] is False


def test_shards_match_sha256(spark):
    keys = [f"key-{i}" for i in range(50)]
    got = {r.k: r.s for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", storage.shard(F.col("k"), 7).alias("s")).collect()}
    assert got == {k: int.from_bytes(hashlib.sha256(k.encode()).digest()[:8], "big") % 7 for k in keys}
    moves = storage.rebalance_plan(spark.createDataFrame([(k,) for k in keys], "k string"), "k", 4, 6).collect()
    assert all(r.from_shard != r.to_shard for r in moves)


def test_replicas_and_integrity(spark):
    s, t = (spark.createDataFrame(x, "k string, c string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("b", "2"), ("c", "x"), ("d", "4")]))
    assert {(r.k, r.action) for r in storage.replica_repair(s, t, "k", "c").collect()} == {("a", "put"), ("c", "replace"), ("d", "delete")}
    copies = spark.createDataFrame([("a", "r1"), ("a", "r2"), ("a", "r2"), ("b", "r1")], "k string, r string")
    assert {(r.k, r.replicas, r.durable) for r in storage.quorum(copies, "k", "r", 2).collect()} == {("a", 2, True), ("b", 1, False)}
    o = spark.createDataFrame([("x", hashlib.sha256(b"x").hexdigest()), ("y", "bad"), (None, "z")], "d string, c string")
    assert tuple(storage.integrity(o, "d", "c").first()) == (3, 1, 1, 1)


def test_replay_and_overlay(spark):
    log = spark.createDataFrame([("a", 1, "put", "x"), ("a", 3, "delete", None), ("a", 2, "put", "y"), ("b", 1, "delete", None), ("b", 2, "put", "z"), (None, 9, "put", "q")], "k string, n int, op string, v string")
    assert [(r.k, r.v) for r in storage.replay(log, "k", "n", "op", "v").collect()] == [("b", "z")]
    base, tx = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string"), spark.createDataFrame([("b", None, True), ("c", "3", False), ("a", "9", False)], "k string, v string, gone boolean")
    assert sorted(tuple(r) for r in storage.overlay(base, tx, "k", "v", "gone").collect()) == [("a", "9"), ("c", "3")]


def test_fair_claim_matches_brute_force(spark):
    r = random.Random(3)
    urls = [(f"u{i}", "hot" if r.random() < 0.4 else f"h{r.randrange(9)}", r.choice([None, 1.0, 2.0]), float(r.randrange(5)), i) for i in range(300)]
    hosts = [("hot", 3, 0.0)] + [(f"h{i}", 1 + i % 3, 0.0) for i in range(7)]
    got = frontier.fair_claim(spark.createDataFrame(urls, "url string, host string, priority double, ready_at double, sequence int"), spark.createDataFrame(hosts, "host string, slots int, last_claim double"), 0.0, 10)
    order = lambda u: (u[2] is None, -(u[2] or 0), u[3], u[4])
    want = sorted((u for h, n, _ in hosts for u in sorted((u for u in urls if u[1] == h), key=order)[:n]), key=order)[:10]
    assert [r.url for r in got.collect()] == [u[0] for u in want]


def test_clamped_feedback_matches_the_fold(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), i, r.choice([1, 1, 1, -1])) for i in range(9000)] + [(None, 1, 1)]
    want = {}
    for k, _, s in sorted((x for x in rows if x[0]), key=lambda x: x[1]):
        want[k] = min(max(want.get(k, 0) + s, -20), 20)
    got = frontier.clamped_feedback(spark.createDataFrame(rows, "k string, n long, s int"), "k", "n", "s")
    assert {x.k: x.score for x in got.collect()} == want


def test_upsert_and_insert(spark):
    old, new = (spark.createDataFrame(x, "k string, n int") for x in ([("a", 1), ("b", 5)], [("a", 2), ("b", 4), ("c", 1), ("c", 1)]))
    assert sorted(map(tuple, frontier.upsert(old, new, "k", ["n"]).collect())) == [("a", 2), ("b", 5), ("c", 1)]
    assert list(map(tuple, frontier.insert_absent(old, new, "k").collect())) == [("c", 1)]
    assert sorted(map(tuple, index.latest(old.union(new), "k", ["n"]).collect())) == [("a", 2), ("b", 5), ("c", 1)]


def test_routing(spark):
    keys = spark.createDataFrame([("a", 5), ("b", 50), ("c", None)], "k string, v int")
    routes = spark.createDataFrame([("low", None, 10), ("high", 10, None)], "p string, low int, high int")
    assert sorted((r.k, r.p) for r in routing.by_value_range(keys, "v", routes).collect()) == [("a", "low"), ("b", "high")]
    ranges = spark.createDataFrame([("x", 0, 10), ("y", 10, 100)], "p string, start int, end int")
    assert sorted((r.k, r.p) for r in routing.by_hash_range(keys, F.col("v"), ranges).collect()) == [("a", "x"), ("b", "y")]
    prefixes = spark.createDataFrame([("p", ["a", "b"]), ("q", ["b"])], "p string, prefixes array<string>")
    assert sorted((r.k, r.p) for r in routing.by_prefix(keys, "k", prefixes).collect()) == [("a", "p"), ("b", "p"), ("b", "q")]
    lives = spark.createDataFrame([("a", None, 5), ("b", 5, None), ("c", 6, 9)], "k string, valid_from int, valid_until int")
    assert sorted(r.k for r in routing.active_at(lives, F.lit(5)).collect()) == ["a", "b"]
    best = routing.replica_rank(keys.withColumn("p", F.lit(1)), "p", [F.col("v").desc_nulls_last()])
    assert best.first().k == "b"


def test_graph(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "x"), (None, "a")], "s string, t string")
    e = graph.edges(links, "s", "t")
    assert sorted(map(tuple, e.collect())) == [("a", "b", 2), ("b", "a", 1), ("b", "c", 1), ("c", "d", 1), ("d", "a", 1)]
    assert list(map(tuple, graph.reciprocal(e).collect())) == [("a", "b", 3)]
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.hops for r in graph.within(e, start, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert graph.within(e, start.limit(0), 2).collect() == []
    facts = spark.createDataFrame([("s", "p", "1", 0.5), ("s", "p", "1", 0.6), ("s", "p", "2", 0.7), ("s", "q", "1", 0.1)], "subject string, predicate string, value string, confidence double")
    assert [(r.subject, r.predicate, r["values"], r.first, r.second) for r in graph.conflicts(facts).collect()] == [("s", "p", 2, "1", "2")]
    act = spark.createDataFrame([("a", 1.0)], "node string, strength double")
    assert {r.node: r.strength for r in graph.spread(act, e).collect()} == {"a": 1.0, "b": 0.75}
