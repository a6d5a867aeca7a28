import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm import formatting


def key(url):
    words = lambda x: tuple(w.lower() for w in re.findall(r"[^\W_]+", x))
    head, _, tail = url.partition("?")
    return words(head), tuple(sorted(w for w in map(words, re.split("[&;]", tail)) if w))


def groups(rows):
    out = defaultdict(list)
    for tbl, url, i in rows:
        if url is not None:
            out[tbl, key(url)].append(i)
    return out


URLS = ["http://a.b/c?x=1&y=2", "HTTP://A.B/c/?y=2;x=1", "http://a.b/c?x=1&y=2&", "https://a.b/c?x=1&y=2", "http://a.b/c", "http://a.b/c?", "http://a.b/c?&;&", "http://a.b/Café", "http://a.b/café ", "", "???", "x?a=1&a=1", "x?a=1", "x?a&b&c", "x?c&a&b", "Éa?b", "éA?B"]


def records(spark, rows):
    df = spark.createDataFrame(rows, "tbl string, url string, id long").withColumn("head", F.lit(1))
    return df.withColumn("key", formatting.url_key(F.col("url"))).withColumn("part", F.lit("x"))


def test_copies_and_groups_match_brute_force(spark):
    r = random.Random(1)
    rows = [(r.choice("st"), r.choice(URLS[:2] if r.random() < 0.4 else [*URLS, None]), i) for i in range(700)]
    r.shuffle(rows)
    want = groups(rows)
    for n in (1, 2, 7, 40):
        got = formatting.copies_of(records(spark, rows), n)
        assert sorted((x.tbl, x.kept_id, x.copy_id) for x in got.collect()) == sorted((t, min(v), i) for (t, _), v in want.items() for i in v if i != min(v))
        got = formatting.collapse(records(spark, rows), n)
        assert sorted((x.tbl, x.kept_id, x.copies) for x in got.collect()) == sorted((t, min(v), len(v)) for (t, _), v in want.items())


def test_one_group_over_all_partitions(spark):
    rows = [("t", "http://a/b", i) for i in range(500)]
    assert [(x.kept_id, x.copies) for x in formatting.collapse(records(spark, rows), 16).collect()] == [(0, 500)]
    got = formatting.copies_of(records(spark, rows), 16).collect()
    assert {x.kept_id for x in got} == {0} and sorted(x.copy_id for x in got) == list(range(1, 500))


def test_empty_null_and_long(spark):
    assert formatting.copies_of(records(spark, [])).collect() == []
    assert formatting.copies_of(records(spark, [("t", None, 1), ("t", None, 2)])).collect() == []
    long = "a/" * 50_000
    assert [(x.kept_id, x.copy_id) for x in formatting.copies_of(records(spark, [("t", long, 5), ("t", long.upper(), 9), ("t", long + "b", 1)])).collect()] == [(5, 9)]
    assert formatting.copies_of(records(spark, [("t", "a", 5), ("t", "A", 5)])).collect() == []


def test_fields_in_any_order(spark):
    df = spark.createDataFrame([("A b", "c", None), ("c", None, "a B!"), ("c b", "a", None)], "x string, y string, z string")
    a, b, c = [r[0] for r in df.select(formatting.text_key(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert a == b != c
