import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import packing


def sizes(spark, rows):
    return spark.createDataFrame([(*r, 5, 1) for r in rows], "doc_id long, n_tokens long, shard int, container int").select("doc_id", "n_tokens")


def check(rows, placed, capacity):
    room, parts = {}, {}
    for r in placed:
        if r.container is None:
            assert r.n_tokens == 0
            parts.setdefault(r.doc_id, []).append((0, 0))
            continue
        room[r.shard, r.container] = room.get((r.shard, r.container), 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append((r.from_token, r.n_tokens))
    assert max(room.values(), default=0) <= capacity
    for d, n in rows:
        p = sorted(parts.pop(d))
        assert sum(x for _, x in p) == n and (len(p) == 1 or n > capacity)
        assert [a for a, _ in p] == list(np.cumsum([0, *[x for _, x in p[:-1]]]))
    assert not parts
    return room


def test_whole_texts_and_full_containers(spark):
    r = random.Random(8)
    rows = [(i, int(r.lognormvariate(5, 1.2)) if i % 50 else r.choice([0, 1, 1000, 1001, 5000])) for i in range(5000)]
    room = check(rows, packing.pack(sizes(spark, rows), 1000, docs_per_shard=2000).collect(), 1000)
    assert sum(n for _, n in rows) / (1000 * len(room)) > 0.98


def test_costs_are_balanced():
    r = np.random.default_rng(3)
    n = r.integers(1, 400, 3000)
    at = packing.assign(n, 1000)
    cost = np.bincount(at, n + 1e-4 * n.astype(float) ** 2)
    assert cost.std() / cost.mean() < 0.05


def test_edges(spark):
    assert packing.pack(sizes(spark, []), 10).collect() == []
    check([(1, 10), (2, 10), (3, 0), (4, 21)], packing.pack(sizes(spark, [(1, 10), (2, 10), (3, 0), (4, 21)]), 10).collect(), 10)
    got = packing.pack(sizes(spark, [(None, 3), (None, 4)]), 10).collect()
    assert sorted(x.n_tokens for x in got) == [3, 4]


def test_token_counts_of_whole_texts(spark):
    d = spark.createDataFrame([(1, "hello world", 0), (2, None, 0), (3, "", 0), (4, "a b " * 30_000, 0), (5, "<|endoftext|> é\x00", 0)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(d).collect()}
    enc = packing.tokenizer(open(packing.TOKENIZER, "rb").read())
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 60_000
    assert enc.decode(enc.encode_ordinary("<|endoftext|> é\x00")) == "<|endoftext|> é\x00" and got[5] > 3
