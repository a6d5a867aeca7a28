"""Fusion of ranking signals: row-wise means, interactions, calibration, diversity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(values: Sequence[Column], weights: Sequence[float], confidences: Sequence[Column] | None = None) -> Column:
    """Sum of value x confidence x weight over that of confidence x weight; missing values don't count; 0 without any."""
    confidences = confidences or [F.lit(1.0)] * len(values)
    top, base = F.lit(0.0), F.lit(0.0)
    for v, w, c in zip(values, weights, confidences, strict=True):
        top = top + F.coalesce(v * c * w, F.lit(0.0))
        base = base + F.when(v.isNotNull(), c * w).otherwise(0.0)
    return F.when(base > 0, top / base).otherwise(0.0)


def group_mean_without_zeros(groups: Sequence[tuple[Column, float]]) -> Column:
    """Weighted mean of group averages in which groups of average 0 have no weight."""
    top = sum((F.when(v > 0, v * w).otherwise(0.0) for v, w in groups), F.lit(0.0))
    base = sum((F.when(v > 0, F.lit(w)).otherwise(0.0) for v, w in groups), F.lit(0.0))
    return F.when(base > 0, top / base).otherwise(0.0)


def interaction(kind: str, values: Sequence[Column]) -> Column:
    """Product, geometric or harmonic mean, minimum, maximum or mean of several values in a row."""
    n = len(values)
    product = values[0]
    for v in values[1:]:
        product = product * v
    if kind == "product":
        return product
    if kind == "geometric":
        return F.pow(product, F.lit(1 / n))
    if kind == "harmonic":
        return F.when(F.least(*values) > 0, n / sum((1 / v for v in values), F.lit(0.0))).otherwise(0.0)
    if kind == "minimum":
        return F.least(*values)
    if kind == "maximum":
        return F.greatest(*values)
    if kind == "mean":
        return sum(values, F.lit(0.0)) / n
    raise ValueError(f"unknown interaction {kind!r}")


def calibrated(score: Column, confidence: Column) -> Column:
    return score * (0.5 + 0.5 * confidence)


def diversity_penalty(rows: DataFrame, keys: Sequence[str], weight: float = 0.1) -> DataFrame:
    """Adds ``penalty``: for each key, ``weight`` x min(n - 1, 10) / 10, where n rows share it. Null keys don't repeat.

    The counts are added up before they join the rows, so a dominant key isn't gathered in one task.
    """
    out, total = rows, F.lit(0.0)
    for i, k in enumerate(keys):
        counts = rows.where(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias(f"__n{i}"))
        out = out.join(counts, k, "left")
        total = total + weight * F.least(F.coalesce(F.col(f"__n{i}"), F.lit(1)) - 1, F.lit(10)) / 10
    return out.withColumn("penalty", total).drop(*[f"__n{i}" for i in range(len(keys))])


def bands(score: Column, limits: Mapping[str, float], otherwise: str) -> Column:
    """Name of the first band whose limit the score reaches."""
    out = None
    for name, limit in sorted(limits.items(), key=lambda x: -x[1]):
        out = F.when(score >= limit, name) if out is None else out.when(score >= limit, name)
    return out.otherwise(otherwise)


def top_by(rows: DataFrame, partition: str, order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(partition).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Rows of a table of weights that may be broadcast.
MOST_WEIGHTS = 10_000


def weigh(signals: DataFrame, weights: DataFrame, keys: Sequence[str], how: str = "mean") -> DataFrame:
    """(keys, family, score, evidence): signals (keys, name, value, confidence) by a table of weights (family, name, weight).

    ``mean``: sum of value x confidence x weight over that of confidence x weight, within 0 and 1; ``sum``: the sum alone.
    Values are cut to 0 and 1 first; signals without weight, value or confidence don't count. evidence: signals that do.
    A table of more than MOST_WEIGHTS rows joins by shuffle.
    """
    w = weights.select("family", "name", "weight")
    w = F.broadcast(w) if w.limit(MOST_WEIGHTS + 1).count() <= MOST_WEIGHTS else w
    known = signals.where(F.col("value").isNotNull() & F.col("confidence").isNotNull()).join(w, "name")
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value"))) * F.col("confidence") * F.col("weight")
    sums = known.groupBy(*keys, "family").agg(F.sum(v).alias("__v"), F.sum(F.col("confidence") * F.col("weight")).alias("__w"), F.count("*").alias("evidence"))
    score = F.col("__v") if how == "sum" else F.when(F.col("__w") > 0, F.col("__v") / F.col("__w")).otherwise(0.0)
    return sums.select(*keys, "family", F.round(score, 6).alias("score"), "evidence")


def long_signals(rows: DataFrame, keys: Sequence[str], signals: Mapping[str, Column], confidence: Mapping[str, float] = {}) -> DataFrame:
    """(keys, name, value, confidence): one row for each signal that a row of the table has."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value"), F.lit(confidence.get(n, 1.0)).alias("confidence")) for n, c in signals.items()])
    return rows.select(*keys, F.explode(each).alias("s")).select(*keys, "s.*").where("value is not null")


def blend(families: DataFrame, keys: Sequence[str], shares: Mapping[str, float], name: str = "score") -> DataFrame:
    """(keys, score): families' scores by their shares; families that aren't there count as 0."""
    parts = [F.coalesce(F.max(F.when(F.col("family") == f, F.col("score"))), F.lit(0.0)) * s for f, s in shares.items()]
    return families.groupBy(*keys).agg(sum(parts, F.lit(0.0)).alias(name))


def history(rows: DataFrame, key: str, order: str, magnitude: str) -> DataFrame:
    """Adds what is known of a key's changes up to each row: ``observations``, ``changes``, ``mean_magnitude`` (a running
    mean of those that changed) and ``volatility`` = 0.4 x share of changes + 0.35 x mean + 0.25 x the present one."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    m = F.coalesce(F.col(magnitude), F.lit(0.0))
    out = rows.withColumn("observations", F.count("*").over(w)).withColumn("changes", F.count_if(m > 0).over(w)).withColumn("mean_magnitude", F.coalesce(F.avg(F.when(m > 0, m)).over(w), F.lit(0.0)))
    return out.withColumn("volatility", 0.4 * F.col("changes") / F.col("observations") + 0.35 * F.col("mean_magnitude") + 0.25 * m)


def normalized(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Features put between 0 and 1 by their least and greatest values, and their mean (``reference``): the vector and score
    of a ranker that isn't trained. A feature without spread is 0, as is a missing one."""
    ends = rows.agg(*[F.min(c).alias(f"__lo_{c}") for c in columns], *[F.max(c).alias(f"__hi_{c}") for c in columns])
    out = rows.crossJoin(F.broadcast(ends))  # one row
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.when(F.col(f"__hi_{c}") > F.col(f"__lo_{c}"), (F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))), F.lit(0.0)))
    return out.withColumn("reference", sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)).drop(*[f"__{e}_{c}" for e in ("lo", "hi") for c in columns])


def rank_merge(parts: DataFrame, key: str, value: str, confidence: str) -> DataFrame:
    """(key, score, parts): what several rankings say of a key, added up with their confidence."""
    return parts.groupBy(key).agg(F.round(F.sum(F.col(value) * F.col(confidence)), 6).alias("score"), F.count("*").alias("parts"))


def query_authority(topical: Column, link: Column, domain: Column, neighbour: Column, relevance: Column) -> Column:
    """0.4 x topical + 0.25 x link + 0.2 x domain + 0.15 x neighbour authority, by half and half of relevance (fixed values)."""
    return (0.4 * topical + 0.25 * link + 0.2 * domain + 0.15 * neighbour) * (0.5 + 0.5 * relevance)
