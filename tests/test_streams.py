import datetime

from pyspark.sql import functions as F

from tidemark.operators import index
from tidemark.session import scratch
from tidemark.streaming import flows


def write(spark, path, rows, schema):
    for i, r in enumerate(rows):
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append" if i else "overwrite").parquet(path)
    return spark.read.parquet(path).schema


def at(minutes):
    return datetime.datetime(2025, 1, 1) + datetime.timedelta(minutes=minutes)


def test_windows_grow_over_batches(spark, tmp_path):
    path = str(tmp_path / "e")
    schema = write(spark, path, [[(at(1), "a", 1.0), (at(70), "a", 2.0)], [(at(2), "a", 3.0), (at(3), "b", 1.0)]], "ts timestamp, k string, v double")
    w = flows.windowed(flows.source(spark, path, schema, maxFilesPerTrigger="1"), "ts", "1 hour", ["k"], "v", late="5 hours")
    got = {(r.start.hour, r.k): (r.n, r.total) for r in flows.upserts(w, ["start", "k"], "w").collect()}
    assert got == {(0, "a"): (2, 4.0), (1, "a"): (1, 2.0), (0, "b"): (1, 1.0)}


def test_dedup_over_batches(spark, tmp_path):
    path = str(tmp_path / "e")
    schema = write(spark, path, [[(at(1), "a")], [(at(2), "a"), (at(2), "b")]], "ts timestamp, k string")
    s = flows.source(spark, path, schema, maxFilesPerTrigger="1")
    assert sorted(r.k for r in flows.append(flows.dedup(s, ["k"], "ts", "1 hour"), "d").collect()) == ["a", "b"]


def test_leases_expire(spark, tmp_path):
    path = str(tmp_path / "e")
    rows = [[("w1", 1, "x", True, 0.0), ("w2", 2, "y", True, 0.0), ("w2", 3, "y", False, 5.0)], [("w3", 4, "z", True, 4000.0)], [("w4", 5, "z", True, 9000.0)], [("w5", 6, "z", True, 20000.0)]]
    rows = [[(*r[:4], r[4] + 1e6) for r in b] for b in rows]
    schema = write(spark, path, rows, "work_id string, event_id long, worker_id string, claims boolean, at double")
    s = flows.source(spark, path, schema, maxFilesPerTrigger="1").withColumn("time", F.timestamp_seconds("at"))
    got = sorted((r.work_id, r.state) for r in flows.append(flows.leases(s, 60.0), "l").collect())
    assert ("w1", "expired") in got and ("w2", "released") in got and ("w2", "expired") not in got and ("w3", "expired") in got


def test_index_segments(spark, tmp_path):
    path = str(tmp_path / "e")
    schema = write(spark, path, [[(1, "a b")], [(2, "b c")]], "doc_id int, t string")
    out = scratch(spark, "seg")
    add = lambda b, n: index.add_segment(spark, out, b, [("body", "t")], n, buckets=2)
    flows.index_segments(flows.source(spark, path, schema, maxFilesPerTrigger="1"), add, scratch(spark, "state"))
    made = index.Index.open(spark, out)
    assert len(made.segments) == 2
    assert sorted((r.doc_id, r.term) for r in made.postings().collect()) == [(1, "a"), (1, "b"), (2, "b"), (2, "c")]


def test_delivery_retries_and_gives_up(spark, tmp_path):
    path = str(tmp_path / "m")
    write(spark, path, [[(1, 0), (2, 1), (3, 9)]], "message_id long, fails int")
    done, dead = flows.deliver(spark, path, lambda m: m.withColumn("failed", F.col("fails") >= F.col("__attempt")))
    assert sorted(map(tuple, done.collect())) == [(1, 1, 0.0), (2, 2, 2.0)]
    assert list(map(tuple, dead.collect())) == [(3, 3, 6.0)]


def test_fencing(spark):
    w = spark.createDataFrame([("k", 1, 5), ("k", 2, 4), ("k", 3, 5), ("k", 4, None), ("j", 1, 1)], "k string, n int, t int")
    assert sorted((r.k, r.n, r.accepted) for r in flows.fenced(w, "k", "t", "n").collect()) == [("j", 1, True), ("k", 1, True), ("k", 2, False), ("k", 3, True), ("k", 4, False)]
