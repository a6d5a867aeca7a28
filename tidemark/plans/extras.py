"""More queries: merges of observations, gates, rescoring, knowledge, allocation, components. With SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import numbers
from tidemark.functions.text import clean_host, day_of
from tidemark.operators import graph, knowledge, signals
from tidemark.plans.core_problems import host_sql
from tidemark.plans.crawl import _EDGES, _edges
from tidemark.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""select url, max(attempts) as attempts, arg_min(source, row_id) filter (where source is not null) as first_source, max(priority) as priority, count(*) as hits from urls where url is not null group by 1""")
def hit_merge(spark, sf_dir):
    """Hits on one url put together: largest numbers, first known source."""
    u = table(spark, sf_dir, "urls").where("url is not null")
    return u.groupBy("url").agg(F.max("attempts").alias("attempts"), F.min_by("source", F.when(F.col("source").isNotNull(), F.col("row_id"))).alias("first_source"), F.max("priority").alias("priority"), F.count("*").alias("hits"))


@query(f"""select h as hostname, greatest(-1, least(1, sum(case when status = 'accepted' then priority / 100 when status = 'rejected' then -priority / 100 else 0 end))) as net from (select *, {host_sql('hostname')} as h from domain_candidates) where h is not null group by 1""")
def evidence_strength(spark, sf_dir):
    """Net evidence for each host, clamped."""
    c = table(spark, sf_dir, "domain_candidates").withColumn("hostname", clean_host(F.col("hostname"))).where("hostname is not null")
    p = F.col("priority") / 100
    return knowledge.net_evidence(c.select("hostname", F.when(F.col("status") == "accepted", p).when(F.col("status") == "rejected", -p).otherwise(0.0).alias("w")), "hostname", "w")


@query("""select state, quantile_disc(attempts, 0.5) as p50, quantile_disc(attempts, 0.95) as p95, quantile_disc(attempts, 0.99) as p99, quantile_disc(attempts, 0.95) <= 4 as passed from urls group by 1""")
def percentile_gate(spark, sf_dir):
    """Exact percentiles by state, from counts by value, against a limit."""
    return knowledge.percentile_gate(table(spark, sf_dir, "urls"), ["state"], "attempts", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "p95", 4)


@query("""with m as (select source, count(*) as urls, avg(attempts) as attempts, sum(case when state = 'failed' then 1 else 0 end) / count(*) as failed from urls where source is not null group by 1)
  select source, name, round(value, 6) as value, value >= least_value and value <= most_value as passed from (unpivot (select source, urls::double as urls, attempts, failed from m) on urls, attempts, failed into name name value value) join (values ('urls', 100.0, 1e12), ('attempts', 0.0, 2.0), ('failed', 0.0, 0.1)) t(name, least_value, most_value) using (name)""")
def threshold_gates(spark, sf_dir):
    """Metrics of each source against a table of thresholds."""
    u = table(spark, sf_dir, "urls").where("source is not null")
    m = u.groupBy("source").agg(F.count("*").cast("double").alias("urls"), F.avg("attempts").alias("attempts"), (F.count_if(F.col("state") == "failed") / F.count("*")).alias("failed"))
    limits = spark.createDataFrame([("urls", 100.0, 1e12), ("attempts", 0.0, 2.0), ("failed", 0.0, 0.1)], "name string, least double, most double")
    return knowledge.threshold_gate(m, ["source"], limits).withColumn("value", F.round("value", 6))


@query(f"""select accepted, reason, count(*) as n from (select reason is null as accepted, reason from (select case when h is null then 'no name' when not regexp_matches(h, '^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\\.)+[a-z0-9-]+$') then 'no host' when url is null then 'no url' when evidence is null then 'no evidence' when priority is null or priority < 10 then 'low priority' end as reason
  from (select *, {host_sql('hostname')} as h from domain_candidates))) group by 1, 2""")
def candidate_validation(spark, sf_dir):
    """Candidates accepted or refused, by the first rule they break."""
    c = table(spark, sf_dir, "domain_candidates").withColumn("h", clean_host(F.col("hostname")))
    rules = [("no name", F.col("h").isNull()), ("no host", ~F.col("h").rlike(r"^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z0-9-]+$")), ("no url", F.col("url").isNull()), ("no evidence", F.col("evidence").isNull()), ("low priority", F.col("priority").isNull() | (F.col("priority") < 10))]
    return knowledge.validated(c, rules).groupBy("accepted", "reason").agg(F.count("*").alias("n"))


@query("""select row_id, round((p + 1.5 * s + 0.25 * a) / 5.7, 6) as score, decision from (select row_id, case when priority > 0 then 1 else 0 end as p, case when source is not null then 1 else 0 end as s, 1 / (1.0 + attempts) as a,
  case when state = 'failed' then 'FAILED' when priority is null or source is null then 'DEFERRED' else 'PASSED' end as decision from urls) where decision <> 'FAILED' order by score desc, row_id limit 500""")
def rescore_prune(spark, sf_dir):
    """Gate, rescore and cut a set of candidates."""
    one = lambda c: F.when(c, 1).otherwise(0)
    u = table(spark, sf_dir, "urls").select(
        "row_id",
        F.round((one(F.col("priority") > 0) + 1.5 * one(F.col("source").isNotNull()) + 0.25 / (1.0 + F.col("attempts"))) / 5.7, 6).alias("score"),
        F.when(F.col("state") == "failed", "FAILED").when(F.col("priority").isNull() | F.col("source").isNull(), "DEFERRED").otherwise("PASSED").alias("decision"),
    )
    return u.where("decision <> 'FAILED'").orderBy(F.col("score").desc(), "row_id").limit(500)


@query("""select doc_id, round(0.7 * hits / 2.0 + 0.3 * quality, 6) as score from (select doc_id, contains(lower(coalesce(title, '')), 'crawl')::int + contains(lower(coalesce(title, '')), 'index')::int as hits, least(1.0, coalesce(n_chars, 0) / 1000.0) as quality from documents) where hits > 0 order by 2 desc, 1 limit 20""")
def knowledge_retrieval(spark, sf_dir):
    """What is known on a query: 0.7 coverage + 0.3 confidence."""
    d = table(spark, sf_dir, "documents").select("doc_id", "title", F.least(F.lit(1.0), F.coalesce("n_chars", F.lit(0)) / 1000.0).alias("confidence"))
    return knowledge.recall(d, "doc_id", "title", "confidence", ["crawl", "index"], 20)


@query("""with p as (select logical_partition as p, count(*) as expected from discovery_work group by 1), d as (select partition_id as p, count(distinct hostname) as actual from discovery_records group by 1)
  select p as partition, expected, coalesce(actual, 0) as actual, greatest(0, expected - coalesce(actual, 0)) as deficit, round(100.0 * greatest(0, expected - coalesce(actual, 0)) / greatest(expected, 1), 4) as gap from p left join d using (p)""")
def coverage_gaps(spark, sf_dir):
    """Hosts found of those expected, by partition."""
    e = table(spark, sf_dir, "discovery_work").groupBy(F.col("logical_partition").alias("partition")).agg(F.count("*").alias("expected"))
    a = table(spark, sf_dir, "discovery_records").groupBy(F.col("partition_id").alias("partition")).agg(F.count_distinct("hostname").alias("actual"))
    return knowledge.gaps(e, a, "partition").withColumn("gap", F.round("gap", 4))


@query("""select row_id, changes, round(magnitude, 6) as magnitude, case when magnitude >= 0.93 then 'all' when magnitude >= 0.55 then 'major' when magnitude >= 0.3 then 'moderate' when magnitude >= 0.02 then 'minor' else 'none' end as band from (
  select row_id, a + b + c as changes, (a + b + c) / 3.0 as magnitude from (select row_id, (state is distinct from lag(state) over w)::int as a, (priority is distinct from lag(priority) over w)::int as b, (attempts is distinct from lag(attempts) over w)::int as c, row_number() over w as n
    from urls where url is not null window w as (partition by url order by row_id)) where n > 1)""")
def change_comparison(spark, sf_dir):
    """Successive observations of a url compared part by part."""
    u = table(spark, sf_dir, "urls").where("url is not null")
    bands = {"all": 0.93, "major": 0.55, "moderate": 0.3, "minor": 0.02}
    out = knowledge.compared(u, "url", "row_id", ["state", "priority", "attempts"])
    return out.select("row_id", "changes", F.round("magnitude", 6).alias("magnitude"), signals.bands(F.col("magnitude"), bands, "none").alias("band"))


@query("""select logical_partition, work_id from (select logical_partition, work_id, sum(attempts + 1) over (partition by logical_partition order by priority desc nulls last, work_id rows unbounded preceding) as used from discovery_work where status <> 'completed') where used <= 25""")
def capacity_allocation(spark, sf_dir):
    """Work that fits each partition's capacity, by priority."""
    w = table(spark, sf_dir, "discovery_work").where("status <> 'completed'").withColumn("cost", F.col("attempts") + 1)
    return knowledge.allocate(w, "logical_partition", "cost", [F.col("priority").desc_nulls_last(), F.col("work_id")], 25).select("logical_partition", "work_id")


@query("""select case when age < 7 then 'hot' when age < 30 then 'warm' else 'cold' end as tier, count(*) as documents, sum(coalesce(n_chars, 0))::bigint as characters from (select n_chars, date_diff('second', crawled_at, timestamp '2026-01-01') / 86400.0 as age from documents) group by 1""")
def storage_tiers(spark, sf_dir):
    age = (F.lit(1_767_225_600) - F.unix_timestamp(F.col("crawled_at").cast("timestamp"))) / 86400.0
    tier = F.when(age < 7, "hot").when(age < 30, "warm").otherwise("cold")
    return table(spark, sf_dir, "documents").groupBy(tier.alias("tier")).agg(F.count("*").alias("documents"), F.sum(F.coalesce("n_chars", F.lit(0)).cast("long")).alias("characters"))


@query(f"""with recursive {_EDGES}, e as (select source as a, target as b from edges union select target, source from edges), r(node, label) as (select a, a from e union select r.node, least(r.label, e.b) from r join e on e.a = r.label where e.b < r.label),
  c(node, label) as (select a, a from e union select e.b, c.label from c join e on e.a = c.node where c.label < e.b) select node, min(label) as component from c group by 1""")
def components(spark, sf_dir):
    """Connected components of hosts under links in either direction."""
    return graph.components(_edges(spark, sf_dir).select("source", "target"))


@query("""select strftime(make_timestamp((discovered_at * 1000000)::bigint), '%Y-%m-%d') as day, count(*) as n, sum(count(*)) over (order by strftime(make_timestamp((discovered_at * 1000000)::bigint), '%Y-%m-%d'))::bigint as running from urls where discovered_at is not null group by 1""")
def running_totals(spark, sf_dir):
    """Urls by day and up to it: days are few, so their running sum is one task's."""
    d = table(spark, sf_dir, "urls").where("discovered_at is not null").groupBy(day_of(F.col("discovered_at")).alias("day")).agg(F.count("*").alias("n"))
    return d.withColumn("running", F.sum("n").over(Window.orderBy("day")))


@query("select work_id, list_reduce(list_prepend(0::bigint, list_transform(string_split(work_id || ':1', ''), lambda c: ord(c)::bigint)), lambda h, c: (h * 131 + c) & 4294967295) / 4294967296.0 as unit from discovery_work")
def schedule_jitter(spark, sf_dir):
    """A fixed number in [0, 1) for each work item."""
    return table(spark, sf_dir, "discovery_work").select("work_id", numbers.unit_of_text(F.concat("work_id", F.lit(":1"))).alias("unit"))


@query("select doc_id, round(exp(-age / 30 * ln(2)), 9) as month, round(exp(-age / 7 * ln(2)), 9) as week from (select doc_id, date_diff('second', crawled_at, timestamp '2026-01-01') / 86400.0 as age from documents where crawled_at < timestamp '2026-01-01')")
def recency_scores(spark, sf_dir):
    """Decay of each document's age over a month and a week."""
    d = table(spark, sf_dir, "documents").select("doc_id", ((F.lit(1_767_225_600) - F.unix_timestamp(F.col("crawled_at").cast("timestamp"))) / 86400.0).alias("age")).where("age > 0")
    return d.select("doc_id", F.round(numbers.recency(F.col("age"), 30), 9).alias("month"), F.round(numbers.recency(F.col("age"), 7), 9).alias("week"))


@query("select status, case when status >= 500 then 'server_error' when status >= 400 then 'client_error' when status >= 300 then 'redirect' else 'success' end as class, count(*) as n from (select case state when 'crawled' then 200 when 'retry' then 503 when 'failed' then 404 else 302 end as status from urls) group by 1, 2")
def status_classes(spark, sf_dir):
    s = F.when(F.col("state") == "crawled", 200).when(F.col("state") == "retry", 503).when(F.col("state") == "failed", 404).otherwise(302)
    return table(spark, sf_dir, "urls").select(s.alias("status")).groupBy("status", numbers.status_class(F.col("status")).alias("class")).agg(F.count("*").alias("n"))
