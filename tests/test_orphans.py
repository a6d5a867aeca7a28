import random

from tidemark.operators import orphans

KIDS = "ref string, tbl string, key string, t double, id long, salts int, live int"
LIVES = "ref string, key string, added double, removed double, salt int"


def expected(kids, lives):
    out = []
    for ref, tbl, key, t, id_, *_ in kids:
        if key is None:
            continue
        at = float("inf") if t is None or t != t else t
        lo = lambda a: float("-inf") if a is None else a
        hi = lambda a: float("inf") if a is None else a
        live = any(r == ref and k == key and hi(d) > lo(a) and lo(a) <= at and (d is None or d > at) for r, k, a, d, _ in lives)
        if not live:
            out.append((tbl, id_))
    return sorted(out)


def run(spark, kids, lives, **options):
    found = orphans.orphans(spark.createDataFrame(kids, KIDS), spark.createDataFrame(lives, LIVES), **options)
    return sorted((r.tbl, r.id) for r in found.collect())


def test_matches_brute_force_with_hot_keys(spark):
    r = random.Random(3)
    maybe = lambda x: r.choice([None, x, x, x])
    kids = [("p", r.choice("ab"), maybe("hot" if r.random() < 0.4 else f"k{r.randrange(20)}"), maybe(float(r.randrange(50))), i, 1, 1) for i in range(600)]
    lives = [("p", maybe(f"k{r.randrange(20)}" if r.random() < 0.8 else "hot"), maybe(float(r.randrange(50))), maybe(float(r.randrange(50))), 3) for _ in range(30)]
    lives += lives[:10]
    for hot in (10, 200_000):
        assert run(spark, kids, lives, hot_rows=hot) == expected(kids, lives)


def test_ends_belong_to_the_right_side(spark):
    lives = [("p", "k", 10.0, 20.0, 1)]
    kids = [("p", "c", "k", t, i, 1, 1) for i, t in enumerate((9.0, 10.0, 19.9, 20.0))]
    assert run(spark, kids, lives) == [("c", 0), ("c", 3)]


def test_unknown_times_and_empty_tables(spark):
    kids = [("p", "c", "k", None, 1, 1, 1), ("p", "c", "k", float("nan"), 2, 1, 1), ("p", "c", None, 1.0, 3, 1, 1)]
    assert run(spark, kids, [("p", "k", None, None, 1)]) == []
    assert run(spark, kids, [("p", "k", None, 5.0, 1)]) == [("c", 1), ("c", 2)]
    assert run(spark, kids, []) == [("c", 1), ("c", 2)]
    assert run(spark, [], [("p", "k", None, None, 1)]) == []


def test_repeated_children_and_report(spark):
    kids = [("p", "c", "k", 86400.0, 1, 1, 1)] * 2 + [("p", "c", "j", 86401.0, 2, 1, 1)]
    found = orphans.counts(spark.createDataFrame(kids, KIDS), spark.createDataFrame([], LIVES))
    assert [tuple(r) for r in found.collect()] == [("c", "1970-01-02", 3, 2)]


def test_every_hot_key_is_dealt_out(spark, monkeypatch):
    """Whatever their number, keys above the bound are salted; the rows are the same."""
    monkeypatch.setattr(orphans, "PROBE", 1)
    kids = [("p", "c", f"k{i % 150}", float(i), i, 1, 1) for i in range(3000)]
    lives = [("p", f"k{i}", 100.0, 2000.0, 1) for i in range(0, 150, 2)]
    assert run(spark, kids, lives, hot_rows=5) == expected(kids, lives)
    hot = orphans._hot(spark.createDataFrame(kids, KIDS).drop("salts"), 5)
    assert hot.count() == 150
