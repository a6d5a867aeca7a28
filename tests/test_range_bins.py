import datetime
import random

import pytest

from pyspark.sql import functions as F

from tidemark.operators import routing

DAY = datetime.date(2020, 1, 1)
KINDS = {"int": lambda x: x, "double": float, "string": lambda x: f"é{x:05}", "date": lambda x: DAY + datetime.timedelta(x)}


@pytest.mark.parametrize("kind", KINDS)
def test_long_route_tables_join_by_bins(spark, monkeypatch, kind):
    """Beyond MOST_ROUTES: the same rows, without a nested loop."""
    r, make = random.Random(6), KINDS[kind]
    starts = [r.randrange(900) for _ in range(300)]
    ranges = [(f"p{i}", make(a), make(a + r.randrange(40))) for i, a in enumerate(starts)] + [("below", None, make(50)), ("above", make(700), None), ("all", None, None)]
    values = [(f"k{i}", make(r.randrange(1000))) for i in range(500)] + [("k0", make(3)), ("null", None)]
    keys = spark.createDataFrame(values, f"k string, v {kind}")
    routes = spark.createDataFrame(ranges, f"p string, low {kind}, high {kind}")
    want = sorted((k, v, p) for k, v in values for p, a, b in ranges if v is not None and (a is None or v >= a) and (b is None or v < b))
    monkeypatch.setattr(routing, "MOST_ROUTES", 10)
    monkeypatch.setattr(routing, "BIN_ROUTES", 20)
    got = routing.by_value_range(keys, "v", routes)
    assert got.columns == ["k", "v", "p"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(map(tuple, got.collect())) == want
    hashed = routing.by_hash_range(keys, F.col("v"), routes.toDF("p", "start", "end"))
    assert "NestedLoop" not in hashed._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, hashed.collect())) == [w for w in want if w[2].startswith("p")]
