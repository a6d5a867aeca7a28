"""Queries on problems 3, 4 and 6, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import clean_host
from tidemark.operators import eager_join, orphans
from tidemark.session import materialize, scratch
from tidemark.sources.tables import table
from tidemark.streaming.changes import Feed, rebuild

WORK_FEED = Feed("work_id", "event_id", "new_state", ("discovered",), ("purged",))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items that exist at the end of the feed, with the last event applied to each."""
    return rebuild(spark, f"{sf_dir}/recovery_events.parquet", WORK_FEED).select("work_id", "event_id")


def p3_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present items by state."""
    return rebuild(spark, f"{sf_dir}/recovery_events.parquet", WORK_FEED).groupBy(F.col("new_state").alias("state")).agg(F.count("*").alias("items"), F.max("event_id").alias("newest_event"))


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    urls = table(spark, sf_dir, "urls").select(F.lit("hosts").alias("ref"), F.lit("urls").alias("tbl"), clean_host(F.col("host")).alias("key"), F.col("discovered_at").alias("t"), F.col("row_id").alias("id"))
    events = table(spark, sf_dir, "recovery_events").groupBy("event_id", "work_id").agg(F.min("created_at").alias("t"))
    events = events.select(F.lit("discovery_work").alias("ref"), F.lit("recovery_events").alias("tbl"), F.col("work_id").alias("key"), "t", F.col("event_id").alias("id"))
    hosts = table(spark, sf_dir, "hosts").select(F.lit("hosts").alias("ref"), clean_host(F.col("host")).alias("key"), F.col("added_at").alias("added"), F.col("removed_at").alias("removed"))
    work = table(spark, sf_dir, "discovery_work").select(F.lit("discovery_work").alias("ref"), F.col("work_id").alias("key"), F.col("created_at").alias("added"), F.col("removed_at").alias("removed"))
    return urls.unionByName(events), hosts.unionByName(work)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose key has no live row at their time."""
    return orphans.orphans(*_references(spark, sf_dir)).select("tbl", "period", F.col("id").alias("record_id"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table and day."""
    return orphans.counts(*_references(spark, sf_dir))


def _urls_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "urls").select(clean_host(F.col("host")).alias("host"), F.col("attempts").cast("long").alias("attempts"), F.nanvl("priority", F.lit(None).cast("double")).alias("priority"))
    return eager_join.states(urls.where(F.col("host").isNotNull()), ["host"], {"attempts": "attempts"}, {"top_priority": "priority"}, count="urls")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "hosts").select(clean_host(F.col("host")).alias("host"), F.col("failures").cast("long").alias("failures"), F.col("active_concurrency").cast("long").alias("active"), "organization_domain")
    hosts = eager_join.states(hosts.where(F.col("host").isNotNull()), ["host"], {"failures": "failures", "active": "active"}, {"organization": "organization_domain"}, count="host_rows")
    return eager_join.joined(_urls_by_host(spark, sf_dir), hosts, "host", left_count="urls", right_count="host_rows", left_sums=["attempts"], right_sums=["failures", "active"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that hold at least 2% of the urls with a host: named among the joined states, which are written once."""
    return eager_join.dominant(materialize(_joined(spark, sf_dir), "joined"), "host", "urls", 0.02).select("host")


def p3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state, rebuilt over several micro-batches of whole files, and events that came in more than one of them."""
    events = table(spark, sf_dir, "recovery_events")
    parts = scratch(spark, "feed")
    # Dealt without regard to order: changes to one item come late, early and again over the batches.
    events.repartition(6, F.xxhash64("event_id", "created_at")).write.parquet(parts)
    return rebuild(spark, parts, WORK_FEED, bytes_per_batch=1).select("work_id", "event_id", F.col("new_state").alias("state"))


def p6_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of urls joined with hosts, for each host."""
    return _joined(spark, sf_dir).select("host", "urls", "host_rows", "pairs", "attempts", "failures", "active", "top_priority", "organization")


def p6_organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, rolled up to organisations (null: hosts unknown or without one)."""
    return _joined(spark, sf_dir).groupBy("organization").agg(F.count("*").alias("hosts"), F.sum("urls").alias("urls"), F.sum("pairs").alias("pairs"), F.sum("attempts").alias("attempts"), F.sum("failures").alias("failures"), F.max("top_priority").alias("top_priority"))


QUERIES = {f.__name__: f for f in (p3_found, p3_states, p3_batches, p4_found, p4_report, p6_found, p6_hosts, p6_organizations)}


def host_sql(c: str) -> str:
    return rf"nullif(regexp_replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '\.$', ''), '')"


_PRESENT = """
  select work_id, max(event_id) as event_id, max_by(new_state, event_id) as state
  from recovery_events where work_id is not null and event_id is not null group by work_id
  having max(case when new_state = 'discovered' then event_id end) > coalesce(max(case when new_state = 'purged' then event_id end), -9223372036854775808)
"""
_ORPHANS = f"""
  select 'urls' as tbl, u.row_id as id, u.k, u.discovered_at as t from (select row_id, {host_sql("host")} as k, discovered_at from urls) u
  where u.k is not null and not exists (select 1 from (select {host_sql("host")} as k, added_at, removed_at from hosts) h
    where h.k = u.k and coalesce(h.added_at, '-inf'::double) <= u.discovered_at and coalesce(h.removed_at, 'inf'::double) > u.discovered_at)
  union all
  select 'recovery_events', e.event_id, e.work_id, e.t from (select event_id, work_id, min(created_at) as t from recovery_events where work_id is not null group by 1, 2) e
  where not exists (select 1 from discovery_work w
    where w.work_id = e.work_id and coalesce(w.created_at, '-inf'::double) <= e.t and coalesce(w.removed_at, 'inf'::double) > e.t)
"""
_DAY = "strftime(make_timestamp((t * 1000000)::bigint), '%Y-%m-%d')"
_JOINED = f"""
  select u.host, count(distinct u.row_id) as urls, count(distinct h.id) as host_rows, count(*) as pairs, coalesce(sum(u.attempts), 0)::bigint as attempts,
    coalesce(sum(h.failures), 0)::bigint as failures, coalesce(sum(h.active_concurrency), 0)::bigint as active, max(u.priority) as top_priority, max(h.organization_domain) as organization
  from (select row_id, {host_sql("host")} as host, attempts, priority from urls) u
  left join (select row_number() over () as id, {host_sql("host")} as host, failures, active_concurrency, organization_domain from hosts) h on u.host = h.host
  where u.host is not null group by u.host
"""
SQL = {
    "p3_found": f"select work_id, event_id from ({_PRESENT})",
    "p3_states": f"select state, count(*) as items, max(event_id) as newest_event from ({_PRESENT}) group by state",
    "p3_batches": f"select work_id, event_id, state from ({_PRESENT})",
    "p4_found": f"select tbl, {_DAY} as period, id as record_id from ({_ORPHANS})",
    "p4_report": f"select tbl, {_DAY} as period, count(*) as orphans, count(distinct k) as orphan_keys from ({_ORPHANS}) group by 1, 2",
    "p6_found": f"select host from (select {host_sql('host')} as host, count(*) as n from urls group by 1) where host is not null and n >= 0.02 * (select count(*) from urls where {host_sql('host')} is not null)",
    "p6_hosts": f"select * from ({_JOINED})",
    "p6_organizations": f"select organization, count(*) as hosts, sum(urls)::bigint as urls, sum(pairs)::bigint as pairs, sum(attempts)::bigint as attempts, sum(failures)::bigint as failures, max(top_priority) as top_priority from ({_JOINED}) group by organization",
}
