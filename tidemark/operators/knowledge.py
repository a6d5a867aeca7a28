"""Evidence, gates, inference and allocation over tables of facts and observations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import fold
from tidemark.operators.scan import running_sum


def net_evidence(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """(key, net): sum of signed weights, within -1 and 1."""
    return rows.groupBy(key).agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sum(weight))).alias("net"))


def percentile_gate(rows: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], gate: str, most: float) -> DataFrame:
    """Exact percentiles of each group, and whether one of them keeps a limit.

    Values are counted first, so a group is as large as its number of distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("__upto", F.sum("__n").over(w.orderBy(value))).withColumn("__all", F.sum("__n").over(w))
    reached = [F.min(F.when(F.col("__upto") >= F.ceil(F.col("__all") * s), F.col(value))).alias(name) for name, s in shares.items()]
    return ranked.groupBy(*keys).agg(*reached).withColumn("passed", F.col(gate) <= most)


def threshold_gate(metrics: DataFrame, keys: Sequence[str], limits: DataFrame) -> DataFrame:
    """(keys, name, value, passed): each metric column against the row of limits (name, least, most) of its name."""
    names = [c for c in metrics.columns if c not in keys]
    long = metrics.unpivot([*keys], names, "name", "value")
    return long.join(F.broadcast(limits), "name").select(*keys, "name", "value", ((F.col("value") >= F.col("least")) & (F.col("value") <= F.col("most"))).alias("passed"))


def validated(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds the first rule a row breaks (reason), and whether it breaks none (accepted)."""
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(broken, name).otherwise(reason)
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def recall(rows: DataFrame, key: str, text: str, confidence: str, words: Sequence[str], k: int) -> DataFrame:
    """(key, score): the k rows that cover most of the words, weighed with their confidence."""
    hits = sum((F.when(fold(F.col(text)).contains(w), 1).otherwise(0) for w in words), F.lit(0))
    out = rows.select(key, hits.alias("__hits"), F.col(confidence).alias("__c")).where("__hits > 0")
    return out.select(key, F.round(0.7 * F.col("__hits") / len(words) + 0.3 * F.col("__c"), 6).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def infer(triples: DataFrame, decay: float) -> DataFrame:
    """(subject, object, confidence, evidence) over two triples in a row, where no triple says so already.

    Only the best of many ways and their number are kept; AQE splits a middle node with many edges.
    """
    a = triples.select("subject", F.col("object").alias("__m"), F.col("confidence").alias("__a"))
    b = triples.select(F.col("subject").alias("__m"), "object", F.col("confidence").alias("__b"))
    ways = a.join(b, "__m").where(F.col("subject") != F.col("object"))
    out = ways.groupBy("subject", "object").agg(F.max(F.col("__a") * F.col("__b") * decay).alias("confidence"), F.count("*").alias("evidence"))
    return out.join(triples.select("subject", "object"), ["subject", "object"], "left_anti")


def gaps(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, expected, actual, deficit, gap): what is missing, in percent of what was expected."""
    out = expected.join(actual, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    out = out.withColumn("deficit", F.greatest(F.lit(0), F.col("expected") - F.col("actual")))
    return out.withColumn("gap", 100.0 * F.col("deficit") / F.greatest(F.col("expected"), F.lit(1)))


def compared(rows: DataFrame, key: str, order: str, parts: Sequence[str]) -> DataFrame:
    """Each row after a key's first with the number of parts that differ from the row before, and their share."""
    w = Window.partitionBy(key).orderBy(order)
    changed = sum((F.when(F.col(p).eqNullSafe(F.lag(p).over(w)), 0).otherwise(1) for p in parts), F.lit(0))
    out = rows.withColumn("changes", changed).withColumn("__n", F.row_number().over(w)).where("__n > 1").drop("__n")
    return out.withColumn("magnitude", F.col("changes") / float(len(parts)))


def allocate(rows: DataFrame, key: str, cost: str, order: Sequence[Column], capacity: float) -> DataFrame:
    """Rows of each key, in an order without ties, as long as the sum of their costs keeps within a capacity."""
    return running_sum(rows, [key], order, cost, "__used").where(F.col("__used") <= capacity).drop("__used")


def provenance_rules(source: str, evidence: str, at: str, metadata: str) -> list[tuple[str, Column]]:
    """Rules for ``validated``: a source that isn't blank; evidence not blank, time not negative, metadata JSON where given."""
    blank = lambda c: F.trim(F.col(c)) == ""
    return [
        ("source", F.col(source).isNull() | blank(source)),
        ("evidence", F.coalesce(blank(evidence), F.lit(False))),
        ("time", F.coalesce(F.col(at) < 0, F.lit(False))),
        ("metadata", F.col(metadata).isNotNull() & F.try_parse_json(metadata).isNull()),
    ]


def confidence(source: Column, validation: Column, provenance: Column, inferred: Column) -> Column:
    """0.5 x source + 0.35 x validation + 0.15 x provenance, and 0.85 of it for what is inferred (fixed values)."""
    return (0.5 * source + 0.35 * validation + 0.15 * provenance) * F.when(inferred, 0.85).otherwise(1.0)
