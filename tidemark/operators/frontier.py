"""Crawl frontier: due work, fair claims, upserts, new-key detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States in which a url may be claimed.
READY = ("discovered", "queued", "retry")


def is_due(now: float, state: str = "state", due_at: str = "next_crawl_at") -> Column:
    return F.col(state).isin(*READY) & (F.col(due_at).isNull() | (F.col(due_at) <= now))


def open_hosts(hosts: DataFrame, now: float) -> DataFrame:
    """(host, slots, last_claim) of hosts that may be crawled now."""
    ready = F.greatest(F.col("last_crawl_time") + F.col("crawl_delay"), F.col("next_allowed_time"), F.col("backoff_until"))
    return hosts.where((ready <= now) & (F.col("active_concurrency") < F.col("max_concurrency"))).select("host", (F.col("max_concurrency") - F.col("active_concurrency")).alias("slots"), F.col("scheduler_last_claim").alias("last_claim"))


def fair_claim(urls: DataFrame, hosts: DataFrame, now: float, limit: int) -> DataFrame:
    """Urls to claim: of each open host as many as it has slots, best priority, then longest ready, then first come.

    urls: host, priority, ready_at, sequence and others; hosts as ``open_hosts`` gives them. No host has more than the
    largest number of slots, a constant that lets Spark cut every task's rows a host before the shuffle.
    """
    most = hosts.agg(F.coalesce(F.max("slots"), F.lit(0))).first()[0]
    w = Window.partitionBy("host").orderBy(F.col("priority").desc_nulls_last(), "ready_at", "sequence")
    ranked = urls.where(F.col("host").isNotNull()).withColumn("host_rank", F.row_number().over(w)).where(F.col("host_rank") <= most)
    claimed = ranked.join(hosts, "host").where(F.col("host_rank") <= F.col("slots"))
    return claimed.orderBy(F.col("priority").desc_nulls_last(), "ready_at", "sequence").limit(limit)


def organization_claim(urls: DataFrame, hosts: DataFrame, now: float, limit: int) -> DataFrame:
    """Urls in the order of a single claim: organisations that waited longest first."""
    return urls.join(hosts, "host").orderBy("organization_last_claim", "last_claim", F.col("priority").desc_nulls_last(), "ready_at", "sequence").limit(limit)


def upsert(old: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Union of two tables with one row a key: the newest by the given columns."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return old.unionByName(new).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key ``old`` doesn't hold, one a key."""
    return new.dropDuplicates([key]).join(old.select(key).distinct(), key, "left_anti")


def per_key_cap(rows: DataFrame, key: str, order: Sequence[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each key in an order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= cap).drop("__n")


def adaptive_interval(current: Column, changed: Column, failures: Column, priority: Column, lowest: float = 3600.0, highest: float = 2_592_000.0) -> Column:
    """Next interval between crawls: shorter after a change, longer without one, after failures and for low priority."""
    factor = F.when(changed, 0.5).otherwise(1.35) * F.pow(F.lit(2.0), F.least(F.greatest(failures, F.lit(0)), F.lit(4)))
    weight = F.greatest(F.lit(0.25), F.least(F.lit(4.0), 100 / F.greatest(F.lit(1.0), priority)))
    return F.least(F.lit(highest), F.greatest(F.lit(lowest), current * factor * (0.75 + 0.25 * weight)))


def aging_bonus(since: Column, now: float, unit: float = 3600.0, per_unit: float = 2.0, most: float = 20.0) -> Column:
    """Bonus that grows with waiting, up to a limit."""
    return F.least(F.lit(most), F.greatest(F.lit(0.0), now - since) / unit * per_unit)


def change_state(status: Column, content: Column, before: Column, seen: Column) -> Column:
    """State of a page from its answer: NEW, CHANGED, UNCHANGED, GONE or UNKNOWN. seen: whether there was an earlier one."""
    return (
        F.when(status.isin(404, 410), "GONE")
        .when(status == 304, F.when(seen, "UNCHANGED").otherwise("UNKNOWN"))
        .when(content.isNull(), "UNKNOWN")
        .when(~seen | before.isNull(), "NEW")
        .when(content == before, "UNCHANGED")
        .otherwise("CHANGED")
    )


def clamped_feedback(events: DataFrame, key: str, order: str, step: str, low: int = -20, high: int = 20, block: int = 1024) -> DataFrame:
    """Running score of each key, clamped after every step in order: (key, score).

    Steps of a score form maps ``min(max(x + a, b), c)``, and such maps can be put together: those of ``block`` orders in
    a row make one, of ``block`` such blocks one again, until a key has one left. No task holds more than 2 x ``block``
    maps of a key. Steps of equal order are added up first, those down before those up. Null keys, orders and steps
    don't count; orders are whole numbers.
    """
    at, by = F.col(order).cast("long"), F.col(step).cast("long")
    known = events.where(F.col(key).isNotNull() & at.isNotNull() & by.isNotNull() & (by != 0))
    sums = known.groupBy(key, at.alias("__at"), (by > 0).alias("__up")).agg(F.sum(by).alias("a"))
    maps = sums.select(key, "__at", F.col("__up").cast("int").alias("__i"), F.struct("a", F.lit(low).cast("long").alias("b"), F.lit(high).cast("long").alias("c")).alias("m"))
    ends = known.agg(F.max(F.abs(at))).first()[0]
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(low).cast("long").alias("b"), F.lit(high).cast("long").alias("c"))

    def then(m: Column, n: Column) -> Column:
        """First m, then n."""
        return F.struct((m["a"] + n["a"]).alias("a"), F.least(F.greatest(m["b"] + n["a"], n["b"]), n["c"]).alias("b"), F.least(F.greatest(m["c"] + n["a"], n["b"]), n["c"]).alias("c"))

    width = 1
    while True:
        width *= block
        part = F.floor(F.col("__at") / width) if width <= 2 * (ends or 0) else F.lit(0).cast("long")
        held = F.array_sort(F.collect_list(F.struct("__at", "__i", "m")))
        maps = maps.groupBy(key, part.alias("__part")).agg(F.aggregate(held, start, lambda m, x: then(m, x["m"])).alias("m"), F.min("__at").alias("__at")).select(key, "__at", F.lit(0).alias("__i"), "m")
        if width > 2 * (ends or 0):
            return maps.select(key, F.least(F.greatest(F.col("m.a"), F.col("m.b")), F.col("m.c")).cast("int").alias("score"))


def failure_backoff(failures: Column, base: float = 30.0, most: float = 3600.0) -> Column:
    """Seconds to wait after so many failures in a row: doubled each time, up to a limit; 0 without a failure."""
    return F.when(failures > 0, F.least(F.lit(most), base * F.pow(F.lit(2.0), F.least(failures, F.lit(40)) - 1))).otherwise(0.0)


def overtakes(waiting: Column, waiting_since: Column, new: Column, new_since: Column, now: float, **aging: float) -> Column:
    """Whether what waits comes before what is new, both with the bonus for their waiting."""
    return waiting + aging_bonus(waiting_since, now, **aging) > new + aging_bonus(new_since, now, **aging)
