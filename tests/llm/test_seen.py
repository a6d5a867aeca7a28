import random

import numpy as np

from tidemark.llm import seen


def arrivals(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "tbl string, id long, key string, h long, kind string")


def expected(rows):
    first = {}
    for t, i, k in rows:
        if k is not None:
            first[t, k] = min(i, first.get((t, k), i))
    return sorted({(t, i) for t, i, k in rows if k is not None and i > first[t, k]})


def found(spark, rows, **options):
    return sorted((r.tbl, r.id) for r in seen.seen_before(arrivals(spark, rows), **options).collect())


def test_exact_even_with_a_bad_filter(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), i, "hot" if r.random() < 0.3 else r.choice([None, f"k{r.randrange(900)}"])) for i in range(2500)]
    r.shuffle(rows)
    assert found(spark, rows) == expected(rows)
    assert found(spark, rows, capacity=16, error=0.3, shards=3) == expected(rows)
    # Keys of one Arrow batch are told apart exactly; small batches let the filters err.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert found(spark, rows, capacity=16, error=0.3, shards=3) == expected(rows)
        report = {x.tbl: x for x in seen.error_report(arrivals(spark, rows), capacity=16, error=0.3, shards=3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(x.wrong > 0 and x.layers > 2 for x in report.values())
    distinct = {t: len({k for u, _, k in rows if u == t and k}) for t in "ab"}
    assert all(x.kept_keys + x.wrong == distinct[t] for t, x in report.items())


def test_empty_null_repeated(spark):
    assert found(spark, []) == []
    assert found(spark, [("a", 1, None), ("a", 2, None)]) == []
    assert found(spark, [("a", 1, "k"), ("a", 1, "k"), ("a", 2, "k"), ("a", 2, "k"), ("b", 3, "k")]) == [("a", 2)]
    assert found(spark, [("a", 2, ""), ("a", 1, "")]) == [("a", 2)]


def test_chain_keeps_its_bound():
    rng = np.random.default_rng(1)
    chain = seen.Chain(1024, 0.01, 2.0, 0.5)
    keys = rng.integers(0, 1 << 63, 60_000).astype(np.uint64)
    wrong = sum(int(chain.seen(b).sum()) for b in np.array_split(keys, 20))
    assert len(chain.layers) > 4
    assert chain.bound() <= 0.02 and wrong / len(keys) < 1.2 * chain.bound()
    assert all(chain.seen(b).all() for b in np.array_split(keys, 20))


def test_chains_go_on_where_they_ended(spark, tmp_path):
    """Two halves in two runs, the chains stored in between, say what one run says; earlier arrivals aren't read again."""
    r = random.Random(8)
    rows = [(r.choice("ab"), i, "hot" if r.random() < 0.3 else f"k{r.randrange(1500)}") for i in range(3000)]
    ask = lambda part, **o: seen.verdicts(arrivals(spark, part), capacity=64, error=1e-6, shards=3, **o)
    one = ask(rows)
    first = ask(rows[:1500], keep=True)
    seen.layers(first).write.parquet(str(tmp_path / "store"))
    second = ask(rows[1500:], before=spark.read.parquet(str(tmp_path / "store")))
    said = lambda v: {(x.tbl, x.id) for x in v.where("kind = 'seen'").collect()}
    assert said(first) | said(second) == said(one) == set(expected(rows))
    # Other histories merge: what either held is seen.
    a, b = ask(rows[:700], keep=True), ask(rows[700:1500], keep=True)
    both = ask(rows[1500:], before=seen.merged(seen.layers(a), seen.layers(b)))
    assert said(both) == said(second)
    held = lambda v: v.where("kind = 'chain'").agg({"bound": "max"}).first()[0]
    assert max(held(a), held(b)) < held(both) < 1e-4
    nothing = ask([], before=seen.layers(first))
    assert said(nothing) == set() and seen.layers(nothing).count() == seen.layers(first).count()


def test_a_share_is_audited(spark):
    rows = [("a", i, f"k{i}") for i in range(4000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        whole, part = (seen.error_report(arrivals(spark, rows), share=x, capacity=16, error=0.3, shards=2).first() for x in (1.0, 0.5))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole.wrong > 500 and abs(part.wrong - whole.wrong) < 0.25 * whole.wrong
