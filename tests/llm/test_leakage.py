import random
import re

from tidemark.llm import leakage

SCHEMA = "doc_id long, text string, words string, tiles int"


def words(x):
    return [w.lower() for w in re.findall(r"[^\W_]+", x or "")]


def expected(docs, items, n=13):
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    parts = [(i, grams(words(p))) for i, p in items]
    return sorted({(d, i) for d, t, *_ in docs for g in [grams(words(t))] for i, p in parts if g & p})


def test_matches_brute_force(spark, monkeypatch):
    r = random.Random(5)
    vocab = ["Straße", "l'été", "x1", "ДОМ", *"abcdefghij"]
    passages = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(5, 40)))) for i in range(25)]
    docs = []
    for d in range(120):
        t = [r.choice(vocab) for _ in range(r.randrange(0, 80))]
        if d % 3 == 0:
            p = words(r.choice(passages)[1])
            k = r.randrange(max(1, len(p) - 12))
            t[5:5] = p[k : k + r.choice([11, 12, 13, 14, 20])]
        docs.append((d, r.choice([" ", ", ", "\n"]).join(t).upper() if d % 2 else " ".join(t), "w", 1))
    docs += [(900, None, "", 1), (901, "", "", 1), (902, "   \n", "", 1), (903, "a " * 200_000 + passages[0][1], "", 1)]
    df, it = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(passages, "item_id long, passage string")
    got = leakage.leaks(df.repartition(3), it)
    assert sorted((x.doc_id, x.item_id) for x in got.collect()) == expected(docs, passages)
    # A full bitmap lets every window pass: the join tells.
    monkeypatch.setattr(leakage, "LEAST_BITS", 7)
    monkeypatch.setattr(leakage, "MOST_BITS", 7)
    monkeypatch.setattr(leakage, "PIECE_BYTES", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = leakage.leaks(df.repartition(3), it)
        assert sorted((x.doc_id, x.item_id) for x in got.collect()) == expected(docs, passages)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_pass_however_large_the_suite(spark, tmp_path):
    """Repeated and many items: documents are scanned once, and no passage is in the plan."""
    words = [f"w{k}" for k in range(40_000)]
    items = [(k, " ".join(words[20 * k : 20 * k + 20])) for k in range(2000)]
    spark.createDataFrame([(1, "x " + items[7][1] + " y", "", 1), (2, "none", "", 1)], SCHEMA).write.parquet(str(tmp_path / "d"))
    got = leakage.leaks(spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(items * 2, "item_id long, passage string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text#") and plan.count("Relation [doc_id") == 1 and "w39999" not in plan
    assert [(r.doc_id, r.item_id, r.covered) for r in got.collect()] == [(1, 7, 20)]


def test_reordered_parts_and_coverage(spark):
    p = [f"w{i}" for i in range(40)]
    mixed = p[30:] + ["z"] + p[10:30] + ["z"] + p[:10]
    docs = [(1, " ".join(mixed), "", 1), (2, " ".join(p[:25]), "", 1), (3, " ".join(reversed(p)), "", 1)]
    got = leakage.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(7, " ".join(p))], "item_id long, passage string"), shortest=5, coverage=0.8).collect()
    assert [(x.doc_id, x.tiles, x.longest, x.covered, x.words) for x in got] == [(1, 3, 20, 40, 40)]


def test_tiles_dont_overlap():
    tiles = leakage.tile([(0, 0, 10), (5, 20, 10), (30, 5, 12)], 3)
    assert sum(n for *_, n in tiles) <= 32
    for a in (0, 1):
        marks = [x[a] + k for x in tiles for k in range(x[2])]
        assert len(marks) == len(set(marks))
    assert tiles[0] == (30, 5, 12)


def test_empty_sides(spark):
    d, i = spark.createDataFrame([(1, "a b c", "", 1)], SCHEMA), spark.createDataFrame([(1, "a b c")], "item_id long, passage string")
    assert leakage.leaks(d.limit(0), i, shortest=2).collect() == []
    assert leakage.leaks(d, i.limit(0), shortest=2).collect() == []
    assert leakage.leaks(d, i).collect() == []
    assert len(leakage.leaks(d.union(d), i.union(i), shortest=2).collect()) == 1
    other = d.union(spark.createDataFrame([(1, "b c d", "", 1)], SCHEMA))
    assert sorted(r.covered for r in leakage.leaks(other, i, shortest=2).collect()) == [2, 3]
    assert leakage.leaks(d, i, shortest=2, least=4).collect() == []
