import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming.changes import Feed, apply_stream, present, rebuild, source

FEED = Feed("k", "seq", "op", ("new",), ("gone",), ("v",))
SCHEMA = "k string, seq long, op string, v int, batch int, last string"


def expected(rows):
    """The feed applied one by one."""
    state = {}
    for seq, k, op, v in sorted({(r[1], r[0], r[2], r[3]) for r in rows if r[0] is not None and r[1] is not None}, key=lambda x: x[0]):
        if op == "new":
            state[k] = (seq, op, v)
        elif op == "gone":
            state.pop(k, None)
        elif k in state:
            state[k] = (seq, op, v)
    return {(k, *x) for k, x in state.items()}


def feed_rows(n, keys, seed):
    r = random.Random(seed)
    rows = [(f"k{r.choice(keys)}", i, r.choice(["new", "gone", "a", "b", None]), r.randrange(9)) for i in range(n)]
    rows += r.sample(rows, n // 3)
    r.shuffle(rows)
    return [(*x, 1, "z") for x in rows]


@pytest.mark.parametrize("files", [1, 4])
def test_matches_one_by_one(spark, tmp_path, files):
    rows = feed_rows(400, [0] * 30 + list(range(1, 30)), files) + [(None, 5, "new", 1, 1, "z"), ("q", None, "new", 1, 1, "z")]
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.parquet(str(tmp_path / "feed"))
    got = rebuild(spark, str(tmp_path / "feed"), FEED)
    assert got.columns == ["k", "seq", "op", "v"]
    assert {tuple(r) for r in got.collect()} == expected(rows)


def test_batches_arriving_out_of_order(spark, tmp_path):
    rows = feed_rows(300, range(12), 7)
    path, out, check = (str(tmp_path / x) for x in ("feed", "out", "check"))
    for k in range(5):
        spark.createDataFrame(rows[k::5], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        like = spark.read.parquet(path)
        apply_stream(source(spark, path, like.schema, maxFilesPerTrigger="1"), FEED, out, check)
        seen = [r for j in range(k + 1) for r in rows[j::5]]
        assert {tuple(r) for r in present(spark, out, like, FEED).collect()} == expected(seen)


def test_delete_first_then_late_insert(spark, tmp_path):
    rows = [("a", 9, "gone", 1, 1, "z"), ("a", 4, "new", 2, 1, "z"), ("b", 9, "x", 1, 1, "z"), ("b", 4, "new", 2, 1, "z"), ("c", 1, "x", 1, 1, "z")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append" if i else "overwrite").parquet(str(tmp_path / "f"))
    assert {tuple(r) for r in rebuild(spark, str(tmp_path / "f"), FEED, bytes_per_batch=1).collect()} == {("b", 9, "x", 1)}


def test_empty_feed(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "f"))
    assert rebuild(spark, str(tmp_path / "f"), FEED).collect() == []


def test_single_file(spark, tmp_path):
    spark.createDataFrame([("a", 1, "new", 2, 1, "z")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "f"))
    one = next((tmp_path / "f").glob("*.parquet")).rename(tmp_path / "one.parquet")
    assert rebuild(spark, str(one), FEED).select(F.col("seq")).collect()[0][0] == 1
