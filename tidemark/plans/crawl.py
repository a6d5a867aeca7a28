"""Queries on the crawl tables: frontier, counts, duplicates, routing, storage, links. With SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.text import clean_host, day_of
from tidemark.operators import frontier, graph, index, routing, signals, storage
from tidemark.plans.core_problems import host_sql
from tidemark.plans.search import tokens_sql
from tidemark.sources.tables import spread, table

NOW = 1_747_000_000.0
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _hosts(spark, sf_dir):
    h = table(spark, sf_dir, "hosts").withColumn("host", clean_host(F.col("host")))
    return h


def _ready(spark, sf_dir):
    u = table(spark, sf_dir, "urls").where(frontier.is_due(NOW))
    return u.select("url", clean_host(F.col("host")).alias("host"), "priority", F.coalesce("next_crawl_at", "discovered_at").alias("ready_at"), F.col("row_id").alias("sequence"))


_DUE = f"state in ('discovered', 'queued', 'retry') and (next_crawl_at is null or next_crawl_at <= {NOW})"
_READY = f"(select url, {host_sql('host')} as host, priority, coalesce(next_crawl_at, discovered_at) as ready_at, row_id as sequence from urls where {_DUE})"
_OPEN = f"""(select {host_sql('host')} as host, max_concurrency - active_concurrency as slots, scheduler_last_claim as last_claim, organization_domain from hosts
  where greatest(last_crawl_time + crawl_delay, next_allowed_time, backoff_until) <= {NOW} and active_concurrency < max_concurrency)"""


@query(f"""select sequence, host, priority from (select r.*, slots, row_number() over (partition by r.host order by priority desc nulls last, ready_at, sequence) as host_rank
  from {_READY} r join {_OPEN} h using (host)) where host_rank <= slots order by priority desc nulls last, ready_at, sequence limit 256""")
def frontier_fair_claim(spark, sf_dir):
    return frontier.fair_claim(_ready(spark, sf_dir), frontier.open_hosts(_hosts(spark, sf_dir), NOW), NOW, 256).select("sequence", "host", "priority")


@query(f"""with org as (select organization_domain, min(scheduler_last_claim) as organization_last_claim from hosts where organization_domain is not null group by 1)
  select sequence, host, organization_last_claim from {_READY} r join {_OPEN} h using (host) join org using (organization_domain)
  order by organization_last_claim, last_claim, priority desc nulls last, ready_at, sequence limit 256""")
def frontier_organization_claim(spark, sf_dir):
    hosts = _hosts(spark, sf_dir)
    org = hosts.where(F.col("organization_domain").isNotNull()).groupBy("organization_domain").agg(F.min("scheduler_last_claim").alias("organization_last_claim"))
    open_ = frontier.open_hosts(hosts, NOW).join(hosts.select("host", "organization_domain"), "host").join(org, "organization_domain")
    return frontier.organization_claim(_ready(spark, sf_dir), open_, NOW, 256).select("sequence", "host", "organization_last_claim")


@query(f"select {host_sql('host')} as host, count(*) as due, max(priority) as best from urls where {_DUE} group by 1")
def frontier_due(spark, sf_dir):
    return _ready(spark, sf_dir).groupBy("host").agg(F.count("*").alias("due"), F.max("priority").alias("best"))


@query("select row_id, priority from urls order by priority desc nulls last, discovered_at, row_id limit 100")
def frontier_pop(spark, sf_dir):
    return table(spark, sf_dir, "urls").orderBy(F.col("priority").desc_nulls_last(), "discovered_at", "row_id").limit(100).select("row_id", "priority")


@query("select state, count(*) as n from urls group by 1")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "urls").groupBy("state").agg(F.count("*").alias("n"))


@query("""select logical_partition, count(*) as items, sum(case when status = 'completed' then 1 else 0 end)::bigint as completed, sum(case when status = 'leased' and lease_until < 1747000000 then 1 else 0 end)::bigint as expired,
  min(case when status <> 'completed' then available_at end) as oldest_open, sum(attempts)::bigint as attempts from discovery_work group by 1""")
def conditional_counts(spark, sf_dir):
    done = F.col("status") == "completed"
    return table(spark, sf_dir, "discovery_work").groupBy("logical_partition").agg(F.count("*").alias("items"), F.count_if(done).alias("completed"), F.count_if((F.col("status") == "leased") & (F.col("lease_until") < NOW)).alias("expired"), F.min(F.when(~done, F.col("available_at"))).alias("oldest_open"), F.sum(F.col("attempts").cast("long")).alias("attempts"))


@query("select partition_id, max(discovered_at) as latest from discovery_records group by 1 order by 2, 1 limit 10")
def stalest_partitions(spark, sf_dir):
    return table(spark, sf_dir, "discovery_records").groupBy("partition_id").agg(F.max("discovered_at").alias("latest")).orderBy("latest", "partition_id").limit(10)


@query("select partition_id, count(distinct hostname) as hostnames, count(distinct source) as sources from discovery_records group by 1")
def distinct_per_partition(spark, sf_dir):
    return table(spark, sf_dir, "discovery_records").groupBy("partition_id").agg(F.count_distinct("hostname").alias("hostnames"), F.count_distinct("source").alias("sources"))


@query("select distinct source, status from domain_candidates")
def group_as_distinct(spark, sf_dir):
    return table(spark, sf_dir, "domain_candidates").select("source", "status").distinct()


@query("select source, count(*) as open, avg(priority) as mean_priority from discovery_work where status <> 'completed' group by 1")
def backlog_by_source(spark, sf_dir):
    return table(spark, sf_dir, "discovery_work").where("status <> 'completed'").groupBy("source").agg(F.count("*").alias("open"), F.avg("priority").alias("mean_priority"))


@query("select partition_id, coalesce(sum(length(hostname) + coalesce(length(url), 0) + coalesce(length(metadata_json), 0)), 0)::bigint as characters from discovery_records group by 1")
def size_estimate(spark, sf_dir):
    n = F.length("hostname") + F.coalesce(F.length("url"), F.lit(0)) + F.coalesce(F.length("metadata_json"), F.lit(0))
    return table(spark, sf_dir, "discovery_records").groupBy("partition_id").agg(F.coalesce(F.sum(n.cast("long")), F.lit(0)).alias("characters"))


@query("select distinct url from urls where url like 'https://%' order by url limit 500")
def source_scan(spark, sf_dir):
    """Scan, filter, distinct, limit over parquet."""
    return table(spark, sf_dir, "urls").where(F.col("url").startswith("https://")).select("url").distinct().orderBy("url").limit(500)


@query(f"""select host, url from (select *, row_number() over (partition by host order by url) as n from (select distinct {host_sql('host')} as host, url from urls) where host is not null and url is not null) where n <= 25""")
def per_host_cap(spark, sf_dir):
    u = table(spark, sf_dir, "urls").select(clean_host(F.col("host")).alias("host"), "url").where("host is not null and url is not null").distinct()
    return frontier.per_key_cap(u, "host", [F.col("url")], 25)


@query("select candidate_id from expansion_candidates c where first_url is not null and not exists (select 1 from urls u where u.url = c.first_url)")
def new_urls(spark, sf_dir):
    c = table(spark, sf_dir, "expansion_candidates").where("first_url is not null").select("candidate_id", F.col("first_url").alias("url"))
    return c.join(table(spark, sf_dir, "urls").select("url").distinct(), "url", "left_anti").select("candidate_id")


@query(f"select distinct h as host from (select {host_sql('hostname')} as h from domain_candidates) where h is not null and h not in (select {host_sql('host')} from hosts where {host_sql('host')} is not null)")
def insert_absent(spark, sf_dir):
    c = table(spark, sf_dir, "domain_candidates").select(clean_host(F.col("hostname")).alias("host")).where("host is not null")
    return frontier.insert_absent(_hosts(spark, sf_dir), c, "host").select("host")


@query("select url, row_id, state from (select *, row_number() over (partition by url order by row_id desc) as n from urls where url is not null) where n = 1")
def upsert_latest(spark, sf_dir):
    u = table(spark, sf_dir, "urls").where("url is not null").select("url", "row_id", "state")
    cut = u.select(F.max("row_id")).first()[0] or 0
    return frontier.upsert(u.where(F.col("row_id") <= cut // 2), u.where(F.col("row_id") > cut // 2), "url", ["row_id"])


@query(f"""select h as hostname, candidate_id from (select *, row_number() over (partition by h order by case source when 'seed' then 5 when 'manual' then 4 when 'certificate_transparency' then 3 when 'sitemap' then 2 else 1 end desc,
    (evidence is not null) desc, (metadata_json is not null) desc, source, candidate_id) as n from (select *, {host_sql('hostname')} as h from domain_candidates) where h is not null) where n = 1""")
def best_candidate(spark, sf_dir):
    rank = F.when(F.col("source") == "seed", 5).when(F.col("source") == "manual", 4).when(F.col("source") == "certificate_transparency", 3).when(F.col("source") == "sitemap", 2).otherwise(1)
    c = table(spark, sf_dir, "domain_candidates").withColumn("hostname", clean_host(F.col("hostname"))).where("hostname is not null")
    return frontier.per_key_cap(c, "hostname", [rank.desc(), F.col("evidence").isNotNull().desc(), F.col("metadata_json").isNotNull().desc(), F.col("source").asc_nulls_last(), F.col("candidate_id")], 1).select("hostname", "candidate_id")


_FOLD = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query("select sha256(text) as content, min(doc_id) as first, count(*) as copies from documents where text is not null group by 1")
def exact_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))


@query("select doc_id, owner from (select doc_id, min(doc_id) over (partition by text) as owner from documents where text is not null)")
def first_seen_owner(spark, sf_dir):
    """Owner of each text. Owners are few rows a text, so hot texts meet a table of one row each."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("owner")), "h").select("doc_id", "owner")


@query("select work_id, event_id, version, previous from (select work_id, event_id, row_number() over w as version, lag(new_state) over w as previous from (select distinct work_id, event_id, new_state from recovery_events) window w as (partition by work_id order by event_id))")
def version_numbers(spark, sf_dir):
    w = Window.partitionBy("work_id").orderBy("event_id")
    return table(spark, sf_dir, "recovery_events").select("work_id", "event_id", "new_state").distinct().select("work_id", "event_id", F.row_number().over(w).alias("version"), F.lag("new_state").over(w).alias("previous"))


@query("""select row_id, case when state = 'failed' then 'GONE' when document_id is null then 'UNKNOWN' when before is null then 'NEW' when document_id = before then 'UNCHANGED' else 'CHANGED' end as change
  from (select *, lag(document_id) over (partition by url order by row_id) as before from urls where url is not null)""")
def change_states(spark, sf_dir):
    before = F.lag("document_id").over(Window.partitionBy("url").orderBy("row_id"))
    u = table(spark, sf_dir, "urls").where("url is not null").select("row_id", "state", "document_id", before.alias("before"))
    return u.select("row_id", frontier.change_state(F.when(F.col("state") == "failed", 404).otherwise(200), F.col("document_id"), F.col("before"), F.col("before").isNotNull()).alias("change"))


@query(f"""select row_id, round(least(2592000, greatest(3600, (coalesce(next_crawl_at, last_crawled_at + 86400) - last_crawled_at) * (case when state = 'crawled' then 1.35 else 0.5 end) * power(2, least(greatest(attempts, 0), 4))
    * (0.75 + 0.25 * greatest(0.25, least(4.0, 100 / greatest(1.0, coalesce(priority, 50))))))), 3) as next_interval, least(20, greatest(0, {NOW} - discovered_at) / 3600 * 2) as bonus from urls where last_crawled_at is not null""")
def recrawl_intervals(spark, sf_dir):
    u = table(spark, sf_dir, "urls").where("last_crawled_at is not null")
    current = F.coalesce("next_crawl_at", F.col("last_crawled_at") + 86400) - F.col("last_crawled_at")
    nxt = frontier.adaptive_interval(current, F.col("state") != "crawled", F.col("attempts"), F.coalesce("priority", F.lit(50.0)))
    return u.select("row_id", F.round(nxt, 3).alias("next_interval"), frontier.aging_bonus(F.col("discovered_at"), NOW).alias("bonus"))


@query("""select source, list_reduce(list_prepend(0, list(case when state = 'crawled' then 1 else -1 end order by row_id)), lambda s, x: least(20, greatest(-20, s + x)))::int as score from urls where state in ('crawled', 'failed') and source is not null group by 1""")
def source_feedback(spark, sf_dir):
    """Score of each source: +1 for a crawled url, -1 for a failed one, clamped after every step."""
    u = table(spark, sf_dir, "urls").where(F.col("state").isin("crawled", "failed") & F.col("source").isNotNull())
    return frontier.clamped_feedback(u.select("source", "row_id", F.when(F.col("state") == "crawled", 1).otherwise(-1).alias("step")), "source", "row_id", "step")


@query("select json_extract_string(metadata_json, '$.depth')::int as depth, json_extract_string(metadata_json, '$.batch') as batch, count(*) as n from domain_candidates group by 1, 2")
def json_metadata(spark, sf_dir):
    m = F.from_json("metadata_json", "depth int, batch string")
    return table(spark, sf_dir, "domain_candidates").select(m.alias("m")).groupBy("m.depth", "m.batch").agg(F.count("*").alias("n"))


@query(r"select row_id, 'DOC-' || sha256(regexp_replace(url, '^\s+|\s+$', '', 'g')) as document_id from urls where url is not null")
def document_ids(spark, sf_dir):
    return table(spark, sf_dir, "urls").where("url is not null").select("row_id", F.concat(F.lit("DOC-"), F.sha2(F.regexp_replace("url", r"^\s+|\s+$", "").cast("binary"), 256)).alias("document_id"))


_SHARD = "(('0x' || substr(sha256({0}), 1, 16))::ubigint % {1})::int"


@query(f"select {_SHARD.format('work_id', 16)} as shard, count(*) as keys from discovery_work group by 1")
def shard_balance(spark, sf_dir):
    return table(spark, sf_dir, "discovery_work").groupBy(storage.shard(F.col("work_id"), 16).alias("shard")).agg(F.count("*").alias("keys"))


@query(f"select from_shard, to_shard, count(*) as keys from (select {_SHARD.format('work_id', 4)} as from_shard, {_SHARD.format('work_id', 6)} as to_shard from discovery_work) where from_shard <> to_shard group by 1, 2")
def shard_rebalance(spark, sf_dir):
    return storage.rebalance_plan(table(spark, sf_dir, "discovery_work"), "work_id", 4, 6).groupBy("from_shard", "to_shard").agg(F.count("*").alias("keys"))


@query("select doc_id, greatest(1, ceil(length(text) / 256.0))::int as chunks, sha256(text) as digest, true as complete from documents where text is not null")
def chunk_round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = storage.join_chunks(storage.split_chunks(d, "doc_id", "text", 256), "doc_id")
    return back.select("doc_id", F.col("chunks").cast("int").alias("chunks"), F.sha2(F.col("data").cast("binary"), 256).alias("digest"), "complete")


@query("select record_id, url from (select record_id, arg_max(struct_pack(op := case when priority < 20 then 'delete' else 'put' end, url := url), created_at) as l from discovery_records group by 1) t, lateral (select l.op as op, l.url as url) x where op <> 'delete'")
def log_replay(spark, sf_dir):
    r = table(spark, sf_dir, "discovery_records").select("record_id", "created_at", F.when(F.col("priority") < 20, "delete").otherwise("put").alias("op"), "url")
    return storage.replay(r, "record_id", "created_at", "op", "url")


@query("select work_id, count(distinct worker_id) as replicas, count(distinct worker_id) >= 2 as durable from recovery_events where worker_id is not null group by 1")
def replica_quorum(spark, sf_dir):
    return storage.quorum(table(spark, sf_dir, "recovery_events").where("worker_id is not null"), "work_id", "worker_id", 2)


_RANGES = [(f"part-{i}", i * 16, (i + 1) * 16) for i in range(16)]


@query("select work_id, 'part-' || (('0x' || substr(sha256(work_id), 1, 2))::int // 16) as partition from discovery_work")
def hash_range_route(spark, sf_dir):
    routes = spark.createDataFrame(_RANGES, "partition string, start int, end int")
    h = F.conv(F.substring(F.sha2("work_id", 256), 1, 2), 16, 10).cast("int")
    return routing.by_hash_range(table(spark, sf_dir, "discovery_work").select("work_id"), h, routes)


@query("select row_id, case when priority < 25 then 'low' when priority < 75 then 'middle' else 'high' end as partition from urls where priority is not null")
def value_range_route(spark, sf_dir):
    routes = spark.createDataFrame([("low", None, 25.0), ("middle", 25.0, 75.0), ("high", 75.0, None)], "partition string, low double, high double")
    return routing.by_value_range(table(spark, sf_dir, "urls").select("row_id", "priority"), "priority", routes).select("row_id", "partition")


@query(f"select h as host, p as partition from (select distinct {host_sql('host')} as h from hosts) join (values ('web', 'm.'), ('web', 'blog.'), ('api', 'api.'), ('news', 'news.')) v(p, x) on starts_with(h, x)")
def prefix_route(spark, sf_dir):
    routes = spark.createDataFrame([("web", ["m.", "blog."]), ("api", ["api."]), ("news", ["news."])], "partition string, prefixes array<string>")
    return routing.by_prefix(_hosts(spark, sf_dir).select("host").distinct(), "host", routes)


@query(f"select {host_sql('host')} as host from hosts where (added_at is null or added_at <= {NOW}) and (removed_at is null or removed_at >= {NOW})")
def temporal_active(spark, sf_dir):
    return routing.active_at(_hosts(spark, sf_dir), F.lit(NOW), "added_at", "removed_at").select("host")


@query(f"""select h as hostname, max(priority) as priority, count(*) - 1 as duplicates, coalesce(array_to_string(list_sort(list(distinct source) filter (where source is not null)), ','), '') as sources from (select {host_sql('hostname')} as h, priority, source from domain_candidates
  union all select {host_sql('hostname')}, priority, source from discovery_records) where h is not null group by 1""")
def candidate_fusion(spark, sf_dir):
    """Observations of one host from several sources, put together."""
    one = [table(spark, sf_dir, t).select(clean_host(F.col("hostname")).alias("hostname"), "priority", "source") for t in ("domain_candidates", "discovery_records")]
    both = one[0].unionByName(one[1]).where("hostname is not null")
    # Sources first by (host, source): what a hot host collects is its distinct sources.
    each = both.groupBy("hostname", "source").agg(F.max("priority").alias("priority"), F.count("*").alias("n"))
    return each.groupBy("hostname").agg(F.max("priority").alias("priority"), (F.sum("n") - 1).alias("duplicates"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))


def _edges(spark, sf_dir):
    e = table(spark, sf_dir, "expansion_candidates").select(clean_host(F.col("source_hostname")).alias("s"), clean_host(F.col("hostname")).alias("t"))
    return graph.edges(e, "s", "t")


_EDGES = f"edges as (select s as source, t as target, count(*) as links from (select {host_sql('source_hostname')} as s, {host_sql('hostname')} as t from expansion_candidates) where s is not null and t is not null and s <> t group by 1, 2)"
_SAT = "least(1, ln(1 + {0}) / ln(1001))"


@query(f"with {_EDGES} select * from edges")
def link_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"""with {_EDGES}, g as (select target, sum(links)::bigint as links, count(*) as hosts, count(distinct regexp_extract(source, '[^.]+\\.[^.]+$')) as domains from edges group by 1)
  select *, round({_SAT.format('links')}, 6) as volume, round(domains / links, 6) as diversity, round(({_SAT.format('links')} + {_SAT.format('hosts')} + {_SAT.format('domains')}) / 3, 6) as authority from g""")
def link_authority(spark, sf_dir):
    return graph.inbound(_edges(spark, sf_dir), F.regexp_extract("source", r"[^.]+\.[^.]+$", 0))


@query(f"""with recursive {_EDGES}, r(node, hops) as (select source, 0 from (select source from edges order by links desc, source limit 5) union select e.target, r.hops + 1 from r join edges e on e.source = r.node where r.hops < 4)
  select node, min(hops) as hops from r group by 1""")
def link_paths(spark, sf_dir):
    """What is reached from the five heaviest linkers within four hops."""
    e = _edges(spark, sf_dir)
    return graph.within(e, e.orderBy(F.col("links").desc(), "source").limit(5).select(F.col("source").alias("node")), 4)


@query(f"""with {_EDGES}, a as (select target as node, sum(links) / 10.0 as strength from edges group by 1), p as (select e.target as node, a.strength * 0.75 as strength from edges e join a on a.node = e.source)
  select node, round(max(strength), 6) as strength from (select * from a union all select * from p) group by 1""")
def spreading_activation(spark, sf_dir):
    e = _edges(spark, sf_dir)
    start = e.groupBy(F.col("target").alias("node")).agg((F.sum("links") / 10.0).alias("strength"))
    return graph.spread(start, e).withColumn("strength", F.round("strength", 6))


@query(f"""select subject, 'source' as predicate, count(distinct source) as values, list_sort(list(distinct source))[1] as first, list_sort(list(distinct source))[2] as second from (select {host_sql('hostname')} as subject, source from domain_candidates) where subject is not null and source is not null group by 1 having count(distinct source) > 1""")
def conflict_detect(spark, sf_dir):
    c = table(spark, sf_dir, "domain_candidates").select(clean_host(F.col("hostname")).alias("subject"), F.lit("source").alias("predicate"), F.col("source").alias("value"), F.col("priority").alias("confidence"))
    return graph.conflicts(c.where("subject is not null"))


@query("""select row_id, round(case when p is null and b = 0 then 0 else (coalesce(p, 0) * 1.5 + b * 1.0) / (case when p is not null then 1.5 else 0 end + 1.0) end, 6) as mean, round(sqrt(coalesce(p, 0) * b), 6) as geometric,
  round(case when least(coalesce(p, 0), b) > 0 then 2 / (1 / p + 1 / b) else 0 end, 6) as harmonic, round(case when coalesce(p, 0) > 0 or b > 0 then (case when p > 0 then p * 0.7 else 0 end + case when b > 0 then b * 0.3 else 0 end) / (case when p > 0 then 0.7 else 0 end + case when b > 0 then 0.3 else 0 end) else 0 end, 6) as without_zeros
  from (select row_id, priority / 100 as p, 1 / (1.0 + attempts) as b from urls)""")
def signal_fusion(spark, sf_dir):
    u = table(spark, sf_dir, "urls").select("row_id", (F.col("priority") / 100).alias("p"), (1 / (1.0 + F.col("attempts"))).alias("b"))
    p, b = F.col("p"), F.col("b")
    q = F.coalesce(p, F.lit(0.0))
    return u.select(
        "row_id",
        F.round(signals.weighted_mean([p, b], [1.5, 1.0]), 6).alias("mean"),
        F.round(signals.interaction("geometric", [q, b]), 6).alias("geometric"),
        F.round(signals.interaction("harmonic", [q, b]), 6).alias("harmonic"),
        F.round(signals.group_mean_without_zeros([(q, 0.7), (b, 0.3)]), 6).alias("without_zeros"),
    )


@query("""select doc_id, round(0.1 * least(n - 1, 10) / 10 + 0.1 * least(m - 1, 10) / 10, 6) as penalty from (select doc_id, case when source is null then 1 else count(*) over (partition by source) end as n, case when lang is null then 1 else count(*) over (partition by lang) end as m from documents)""")
def diversity_penalty(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return signals.diversity_penalty(d, ["source", "lang"]).select("doc_id", F.round("penalty", 6).alias("penalty"))


@query("select source, row_id, rank from (select source, row_id, row_number() over (partition by source order by priority desc nulls last, row_id) as rank from urls where source is not null) where rank <= 20")
def top_by_source(spark, sf_dir):
    u = table(spark, sf_dir, "urls").where("source is not null").select("source", "row_id", "priority")
    return signals.top_by(u, "source", [F.col("priority").desc_nulls_last(), F.col("row_id")], 20).select("source", "row_id", "rank")


@query("select strftime(make_timestamp((discovered_at * 1000000)::bigint), '%Y-%m-%d') as day, lower(trim(source)) as source, count(*) as finds, count(distinct record_id) as records from discovery_records group by 1, 2")
def discoveries_by_day(spark, sf_dir):
    r = table(spark, sf_dir, "discovery_records").select(day_of(F.col("discovered_at")).alias("day"), F.lower(F.trim("source")).alias("source"), "record_id")
    each = r.groupBy("day", "source", "record_id").agg(F.count("*").alias("n"))
    return each.groupBy("day", "source").agg(F.sum("n").alias("finds"), F.count("record_id").alias("records"))


@query("select work_id, max(event_id) as last_event, arg_max(new_state, event_id) as state from recovery_events group by 1")
def latest_per_key(spark, sf_dir):
    return table(spark, sf_dir, "recovery_events").groupBy("work_id").agg(F.max("event_id").alias("last_event"), F.max_by("new_state", "event_id").alias("state"))


@query(f"select term, doc_id, count(*) as tf from (select doc_id, unnest({tokens_sql('title')} || {tokens_sql('text')}) as term from documents) group by 1, 2")
def segment_merge(spark, sf_dir):
    """Postings of all documents, merged from one segment a crawl day."""
    held = F.struct(F.unix_date(F.to_date("crawled_at")).alias("segment_id"), "doc_id").alias("held")
    d = spread(table(spark, sf_dir, "documents").select(held, "title", "text"))
    p = index.postings(index.token_rows(d, [("title", "title"), ("body", "text")], "held"), "held")
    return index.merge_segments(p.select("held.segment_id", "term", "held.doc_id", "tf")).select("term", "doc_id", "tf")


@query("""with s as (select strftime(crawled_at, '%Y-%m-%d') || '/' || source as segment_id, sum(coalesce(n_chars, 0))::bigint as bytes from documents where crawled_at is not null and source is not null group by 1),
  l as (select *, floor(coalesce(ln(greatest(bytes, 1) / (select min(bytes) from s where bytes > 0)), 0) / ln(10) + 1e-9)::int as level from s), n as (select level, count(*) as n from l group by 1)
  select level, segment_id, place from (select *, row_number() over (partition by level order by bytes, segment_id) as place from l) join n using (level) where place <= 32 and n >= case when level = 0 then 8 else 16 end""")
def compaction_plan(spark, sf_dir):
    """Segments to merge, of the segments that the documents of a site and day make."""
    d = table(spark, sf_dir, "documents").where("crawled_at is not null and source is not null")
    s = d.groupBy(F.concat(F.date_format("crawled_at", "yyyy-MM-dd"), F.lit("/"), F.col("source")).alias("segment_id")).agg(F.sum(F.coalesce("n_chars", F.lit(0)).cast("long")).alias("bytes"))
    return index.compaction_plan(s)
