"""Queries on families of signals: weights are tables, scores are sums and means over them. With SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.text import clean_host
from tidemark.operators import frontier, graph, knowledge, routing, search, signals
from tidemark.plans.core_problems import host_sql
from tidemark.plans.crawl import _EDGES, _SAT, NOW, QUERIES as QUERIES_OF_CRAWL, SQL as SQL_OF_CRAWL, _edges
from tidemark.plans.search import _ROWS, QUERY, _index
from tidemark.sources.tables import table

QUERIES, SQL = {}, {}
SOURCE_SCORES = SQL_OF_CRAWL["source_feedback"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _values(rows) -> str:
    return "(values " + ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows) + ")"


def _weights(spark, rows):
    return spark.createDataFrame(rows, "family string, name string, weight double")


def _long_sql(key: str, exprs: dict[str, str], source: str) -> str:
    return " union all ".join(f"select {key}, '{n}' as name, ({e})::double as value from {source}" for n, e in exprs.items())


def _weigh_sql(long: str, weights, key: str, how: str = "mean") -> str:
    v = "least(1.0, greatest(0.0, value)) * weight"
    score = f"sum({v})" if how == "sum" else f"sum({v}) / sum(weight)"
    return f"select {key}, family, round({score}, 6) as score, count(*) as evidence from ({long}) s join {_values(weights)} w(family, name, weight) using (name) where value is not null group by 1, 2"


#: Weights of what speaks for a document, given a query; their sum is its relevance.
RELEVANCE = [("relevance", "coverage", 2.0), ("relevance", "title", 3.0), ("relevance", "url", 1.5), ("relevance", "phrase", 4.0), ("relevance", "field", 3.0)]
_TERMS = search.query_terms(QUERY)


@query(f"""with {_ROWS}, q as (select doc_id, field, term, pos from rows where term in {tuple(_TERMS)}), f as (select doc_id, count(distinct term) as n, count(distinct case when field = 'title' then term end) as t, count(distinct case when field = 'url' then term end) as u, count(distinct field) as f from q group by 1),
  p as (select distinct a.doc_id from q a join q b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = '{_TERMS[0]}' and b.term = '{_TERMS[1]}'), s as (select f.*, (p.doc_id is not null)::int as p from f left join p using (doc_id))
  {_weigh_sql(_long_sql("doc_id", {"coverage": "n / 2.0", "title": "t / 2.0", "url": "u / 2.0", "phrase": "p", "field": "f / 4.0"}, "s"), RELEVANCE, "doc_id", "sum")}""")
def relevance_signals(spark, sf_dir):
    """What speaks for each candidate of a query, from its postings."""
    found = search.candidates(_index(spark, sf_dir), _TERMS)
    number = {f: n for n, f in enumerate(_index(spark, sf_dir).fields)}
    hits = lambda f: search._hits(_TERMS, [number[f]])
    n = sum((F.when(F.col(f"tf{i}").isNotNull(), 1).otherwise(0) for i in range(len(_TERMS))), F.lit(0))
    fields = F.coalesce("fields0", F.lit(0)).bitwiseOR(F.coalesce("fields1", F.lit(0)))
    from tidemark.operators.ranking import phrase_places

    phrase = F.when(F.col("tf0").isNotNull() & F.col("tf1").isNotNull() & (F.size(phrase_places([F.col("positions0"), F.col("positions1")])) > 0), 1).otherwise(0)
    long = signals.long_signals(found, ["doc_id"], {"coverage": n / 2, "title": hits("title") / 2, "url": hits("url") / 2, "phrase": phrase, "field": F.bit_count(fields) / 4})
    return signals.weigh(long, _weights(spark, RELEVANCE), ["doc_id"], "sum")


QUALITY = [("quality", "length", 1.0), ("quality", "depth", 1.0), ("quality", "titled", 1.0), ("authority", "site", 1.0), ("trust", "secure", 2.0), ("trust", "language", 1.0)]
_QUALITY = {"length": "n_chars / 2000.0", "depth": "n_chars / 5000.0", "titled": "case when coalesce(title, '') <> '' then 1 else 0 end", "site": "sqrt(least(100, n) / 100.0)", "secure": "case when url like 'https://%' then 1 else 0 end", "language": "case when length(lang) = 2 then 1 else 0 end"}


@query(_weigh_sql(_long_sql("doc_id", _QUALITY, "(select d.*, n from documents d left join (select source, count(*) as n from documents where source is not null group by 1) using (source))"), QUALITY, "doc_id"))
def quality_families(spark, sf_dir):
    """Quality, authority and trust of documents, each a weighted mean."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "title", "url", "lang", "source")
    d = d.join(d.where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("n")), "source", "left")
    given = {"length": F.col("n_chars") / 2000, "depth": F.col("n_chars") / 5000, "titled": F.when(F.coalesce("title", F.lit("")) != "", 1).otherwise(0), "site": F.sqrt(F.when(F.col("n").isNotNull(), F.least(F.lit(100), F.col("n"))) / 100), "secure": F.when(F.col("url").startswith("https://"), 1).otherwise(0), "language": F.when(F.length("lang") == 2, 1).otherwise(0)}
    return signals.weigh(signals.long_signals(d, ["doc_id"], given), _weights(spark, QUALITY), ["doc_id"])


_AGE = f"greatest(0, {NOW} - last_crawled_at) / 86400"


@query(f"""select row_id, round(exp(-ln(2) * age / 30), 6) as fresh, round(exp(-ln(2) * age / 14), 6) as updated, round(exp(-ln(2) * age / 7), 6) as news, round(0.35 * exp(-ln(2) * age / 30) + 0.25 * least(1, attempts / 4.0) + 0.2 * (state = 'failed')::int + 0.15 * (1 - exp(-ln(2) * age / 14)) + 0.05 * (next_crawl_at is null)::int, 6) as urgency
  from (select *, {_AGE} as age from urls where last_crawled_at is not null)""")
def freshness_urgency(spark, sf_dir):
    """Decays of each url's age over a month, a fortnight and a week, and its urgency."""
    from tidemark.functions.numbers import recency

    age = F.greatest(F.lit(0.0), NOW - F.col("last_crawled_at")) / 86400
    u = table(spark, sf_dir, "urls").where("last_crawled_at is not null").withColumn("age", age)
    month, fortnight, week = (recency(F.col("age"), d) for d in (30, 14, 7))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    urgency = 0.35 * month + 0.25 * F.least(F.lit(1.0), F.col("attempts") / 4) + 0.2 * one(F.col("state") == "failed") + 0.15 * (1 - fortnight) + 0.05 * one(F.col("next_crawl_at").isNull())
    return u.select("row_id", F.round(month, 6).alias("fresh"), F.round(fortnight, 6).alias("updated"), F.round(week, 6).alias("news"), F.round(urgency, 6).alias("urgency"))


@query(f"""with {_EDGES}, g as (select target, var_pop(links) as variance, count(*) as n, sum(links)::bigint as links, count(distinct regexp_extract(source, '[^.]+\\.[^.]+$')) as domains from edges group by 1)
  select target, round(variance, 6) as variance, round(greatest(0, 1 - sqrt(variance)), 6) as evenness, (links >= 10 and 1 - domains / links >= 0.7) as few_domains, (ln(1 + links) / ln(1000001) >= 0.8) as flooded, n as sources from g""")
def link_spread(spark, sf_dir):
    """How evenly links come in, and what is odd about them."""
    return graph.spread_of(_edges(spark, sf_dir), F.regexp_extract("source", r"[^.]+\.[^.]+$", 0))


SPAM = [("content", "repetition", 1.0), ("content", "thin", 0.5), ("host", "crowd", 1.0), ("history", "copies", 1.0)]
_SPAM_SQL = {"repetition": "1 - distinct_words / greatest(words, 1)", "thin": "case when words < 20 then 1 else 0 end", "crowd": "least(1, ln(1 + site) / ln(1001))", "copies": "case when copies > 1 then 1 else 0 end"}
SHARES = {"content": 0.55, "host": 0.15, "history": 0.15}


@query(f"""with w as (select doc_id, len(w) as words, len(list_distinct(w)) as distinct_words, count(*) over (partition by source) as site, count(*) over (partition by text) as copies from (select *, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from documents where text is not null and source is not null)),
  f as ({_weigh_sql(_long_sql("doc_id", _SPAM_SQL, "w"), SPAM, "doc_id")}), b as (select doc_id, round(0.55 * coalesce(max(case when family = 'content' then score end), 0) + 0.15 * coalesce(max(case when family = 'host' then score end), 0) + 0.15 * coalesce(max(case when family = 'history' then score end), 0) + 1e-9, 6) as score from f group by 1)
  select doc_id, score, case when score >= 0.9 then 'critical' when score >= 0.7 then 'high' when score >= 0.4 then 'medium' when score >= 0.15 then 'low' else 'none' end as band from b""")
def spam_families(spark, sf_dir):
    """Signs of spam of documents by families, blended and banded."""
    from tidemark.functions.text import ascii_words

    d = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    w = d.select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("h"), ascii_words(F.col("text")).alias("w")).select("doc_id", "source", "h", F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("distinct_words"))
    w = w.join(w.groupBy("source").agg(F.count("*").alias("site")), "source").join(w.groupBy("h").agg(F.count("*").alias("copies")), "h")
    given = {"repetition": 1 - F.col("distinct_words") / F.greatest("words", F.lit(1)), "thin": F.when(F.col("words") < 20, 1).otherwise(0), "crowd": graph.saturation(F.col("site")), "copies": F.when(F.col("copies") > 1, 1).otherwise(0)}
    out = signals.blend(signals.weigh(signals.long_signals(w, ["doc_id"], given), _weights(spark, SPAM), ["doc_id"]), ["doc_id"], SHARES)
    out = out.withColumn("score", F.round(F.col("score") + 1e-9, 6))  # halves go up in every engine
    return out.withColumn("band", signals.bands(F.col("score"), {"critical": 0.9, "high": 0.7, "medium": 0.4, "low": 0.15}, "none"))


@query("""with m as (select *, (state is distinct from lag(state) over w)::int * 0.6 + (priority is distinct from lag(priority) over w)::int * 0.4 as x, row_number() over w as n from urls where url is not null window w as (partition by url order by row_id)), y as (select row_id, url, case when n = 1 then 0.0 else x end::double as x from m)
  select row_id, observations, changes, round(mean_magnitude, 6) as mean_magnitude, round(0.4 * changes / observations + 0.35 * mean_magnitude + 0.25 * x, 6) as volatility from (select row_id, x, count(*) over w as observations, count(*) filter (where x > 0) over w as changes, coalesce(avg(case when x > 0 then x end) over w, 0) as mean_magnitude from y window w as (partition by url order by row_id rows unbounded preceding))""")
def change_history(spark, sf_dir):
    """What is known of each url's changes, observation by observation."""
    w = Window.partitionBy("url").orderBy("row_id")
    differs = lambda c: F.when(F.col(c).eqNullSafe(F.lag(c).over(w)), 0.0).otherwise(1.0)
    u = table(spark, sf_dir, "urls").where("url is not null").select("row_id", "url", F.when(F.row_number().over(w) == 1, 0.0).otherwise(differs("state") * 0.6 + differs("priority") * 0.4).alias("x"))
    out = signals.history(u, "url", "row_id", "x")
    return out.select("row_id", "observations", "changes", F.round("mean_magnitude", 6).alias("mean_magnitude"), F.round("volatility", 6).alias("volatility"))


@query("""with f as (select source, avg(priority) as priority, count(*)::double as urls, avg(attempts) as attempts from urls where source is not null group by 1), e as (select min(priority) as a, max(priority) as b, min(urls) as c, max(urls) as d, min(attempts) as g, max(attempts) as h from f)
  select source, round((case when b > a then (priority - a) / (b - a) else 0 end + case when d > c then (urls - c) / (d - c) else 0 end + case when h > g then (attempts - g) / (h - g) else 0 end) / 3, 6) as reference from f, e""")
def feature_vectors(spark, sf_dir):
    """Features of sources put between 0 and 1, and their mean."""
    f = table(spark, sf_dir, "urls").where("source is not null").groupBy("source").agg(F.avg("priority").alias("priority"), F.count("*").cast("double").alias("urls"), F.avg("attempts").alias("attempts"))
    return signals.normalized(f, ["priority", "urls", "attempts"]).select("source", F.round("reference", 6).alias("reference"))


@query(f"""select hostname, round(sum(v * c), 6) as score, count(*) as parts from (select {host_sql('hostname')} as hostname, max(priority) / 100 as v, 0.9::double as c from domain_candidates group by 1 union all select {host_sql('hostname')}, max(priority) / 100, 0.5::double from discovery_records group by 1) where hostname is not null group by 1""")
def rank_merged(spark, sf_dir):
    """Hosts as two rankings see them, added up with their confidence."""
    part = lambda t, c: table(spark, sf_dir, t).groupBy(clean_host(F.col("hostname")).alias("hostname")).agg((F.max("priority") / 100).alias("v")).withColumn("c", F.lit(c))
    both = part("domain_candidates", 0.9).unionByName(part("discovery_records", 0.5)).where("hostname is not null")
    return signals.rank_merge(both, "hostname", "v", "c")


@query("""select row_id, round(0.9 * greatest(0, (p * 1.0 + a * 0.5) / 1.5 * (0.5 + 0.5 * c) - 0.1 * least(n - 1, 10) / 10) + 0.1 * p, 6) as final from (select row_id, coalesce(priority, 0) / 100 as p, 1 / (1.0 + attempts) as a, case when source is null then 0.4 else 0.9 end as c, case when source is null then 1 else count(*) over (partition by source) end as n from urls)""")
def final_scores(spark, sf_dir):
    """Base score, calibrated by confidence, less what others of its source have, blended with the score it came with."""
    u = table(spark, sf_dir, "urls").select("row_id", "source", (F.coalesce("priority", F.lit(0.0)) / 100).alias("p"), (1 / (1.0 + F.col("attempts"))).alias("a"), F.when(F.col("source").isNull(), 0.4).otherwise(0.9).alias("c"))
    u = signals.diversity_penalty(u, ["source"])
    base = signals.calibrated(signals.weighted_mean([F.col("p"), F.col("a")], [1.0, 0.5]), F.col("c"))
    return u.select("row_id", F.round(0.9 * F.greatest(F.lit(0.0), base - F.col("penalty")) + 0.1 * F.col("p"), 6).alias("final"))


@query(f"""select row_id, case when failures > 0 then least(3600.0, 30 * power(2, least(failures, 40) - 1)) else 0 end as backoff from urls u join (select {host_sql('host')} as h, max(failures) as failures from hosts group by 1) on h = {host_sql('u.host')}""")
def failure_waits(spark, sf_dir):
    """Seconds for which each url's host waits after its failures."""
    h = table(spark, sf_dir, "hosts").groupBy(clean_host(F.col("host")).alias("h")).agg(F.max("failures").alias("failures")).where("h is not null")
    u = table(spark, sf_dir, "urls").select("row_id", clean_host(F.col("host")).alias("h"))
    return u.join(h, "h").select("row_id", frontier.failure_backoff(F.col("failures")).alias("backoff"))


@query(f"""select logical_partition, count(*) as overtaken from (select *, first_value(priority) over w as p0, first_value(created_at) over w as t0 from discovery_work where priority is not null and created_at is not null window w as (partition by logical_partition order by created_at, work_id rows between unbounded preceding and unbounded following))
  where p0 + least(20, greatest(0, {NOW} - t0) / 3600 * 2) > priority + least(20, greatest(0, {NOW} - created_at) / 3600 * 2) group by 1""")
def starvation(spark, sf_dir):
    """For how many items of each partition the oldest one, aged, comes first."""
    d = table(spark, sf_dir, "discovery_work").where("priority is not null and created_at is not null")
    oldest = d.groupBy("logical_partition").agg(F.min_by(F.struct("priority", "created_at"), F.struct("created_at", "work_id")).alias("o"))
    both = d.join(oldest, "logical_partition")
    return both.where(frontier.overtakes(F.col("o.priority"), F.col("o.created_at"), F.col("priority"), F.col("created_at"), NOW)).groupBy("logical_partition").agg(F.count("*").alias("overtaken"))


@query("""with r as (select worker_id, logical_partition as p, avg(attempts) as a, count(*) as n from discovery_work where worker_id is not null group by 1, 2), s as (select *, round(0.6 / (1 + a) + 0.25 * (1 - least(1, n / 10.0)) + case when p % 4 = length(worker_id) % 4 then 0.1 else 0 end, 6) as score from r)
  select p as logical_partition, worker_id, score from (select *, row_number() over (partition by p order by score desc, worker_id) as k from s) where k = 1""")
def replica_choice(spark, sf_dir):
    """The best worker of each partition by health, load and region."""
    r = table(spark, sf_dir, "discovery_work").where("worker_id is not null").groupBy("worker_id", "logical_partition").agg(F.avg("attempts").alias("a"), F.count("*").alias("n"))
    score = routing.replica_score(1 / (1 + F.col("a")), F.least(F.lit(1.0), F.col("n") / 10), F.col("logical_partition") % 4 == F.length("worker_id") % 4, F.lit(False))
    return routing.replica_rank(r.withColumn("score", F.round(score, 6)), "logical_partition", [F.col("score").desc(), F.col("worker_id")]).select("logical_partition", "worker_id", "score")


_PARTS = "p as (select logical_partition as partition, count(*) as size, logical_partition * 1000::bigint as \"start\", (logical_partition + 1) * 1000::bigint as \"end\" from discovery_work group by 1)"


def _partitions(spark, sf_dir):
    p = F.col("logical_partition").cast("long")
    return table(spark, sf_dir, "discovery_work").groupBy(p.alias("partition")).agg(F.count("*").alias("size")).select("partition", "size", (F.col("partition") * 1000).alias("start"), ((F.col("partition") + 1) * 1000).alias("end"))


@query(f"with {_PARTS}, n as (select *, ceil(size / 10.0)::bigint as n, unnest(range(0, ceil(size / 10.0)::bigint)) as child from p where size > 10) select partition, child, \"start\" + (1000 * child) // n as low, \"start\" + (1000 * (child + 1)) // n as high from n")
def partition_splits(spark, sf_dir):
    """Partitions of more than ten items cut into equal ranges."""
    return routing.split_plan(_partitions(spark, sf_dir), "size", 10)


@query(f"with {_PARTS}, u as (select *, sum(size) over (order by \"start\") - size as before from p) select partition, min(\"start\") over (partition by (before / 25.0)::int - case when (before / 25.0)::int > before / 25.0 then 1 else 0 end) as into from u")
def partition_merges(spark, sf_dir):
    """Neighbouring partitions put together while they're small."""
    return routing.merge_plan(_partitions(spark, sf_dir), "size", 25)


@query("""select case when source is null or trim(source) = '' then 'source' when evidence is not null and trim(evidence) = '' then 'evidence' when discovered_at is not null and discovered_at < 0 then 'time' when metadata_json is not null and not coalesce(json_valid(metadata_json), false) then 'metadata' end as reason, count(*) as n from domain_candidates group by 1""")
def provenance_validation(spark, sf_dir):
    """Candidates by what is wrong with what is told of their origin."""
    c = table(spark, sf_dir, "domain_candidates")
    return knowledge.validated(c, knowledge.provenance_rules("source", "evidence", "discovered_at", "metadata_json")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""with c as (select work_id, count(distinct worker_id) as workers, avg((error is null)::int) as sound, max((previous_state is not null)::int) as known from recovery_events group by 1)
  select work_id, round((0.5 * least(1, workers / 3.0) + 0.35 * sound + 0.15 * known) * case when workers = 0 then 0.85 else 1 end, 6) as confidence, round(1 - (0.5 * least(1, workers / 3.0) + 0.35 * sound + 0.15 * known) * case when workers = 0 then 0.85 else 1 end, 6) as uncertainty from c where work_id is not null""")
def fact_confidence(spark, sf_dir):
    """How sure the state of each item is: by its sources, their soundness, and whether its origin is known."""
    e = table(spark, sf_dir, "recovery_events").where("work_id is not null")
    each = e.groupBy("work_id").agg(F.count_distinct("worker_id").alias("workers"), F.avg(F.when(F.col("error").isNull(), 1.0).otherwise(0.0)).alias("sound"), F.max(F.when(F.col("previous_state").isNotNull(), 1).otherwise(0)).alias("known"))
    c = knowledge.confidence(F.least(F.lit(1.0), F.col("workers") / 3), F.col("sound"), F.col("known"), F.col("workers") == 0)
    return each.select("work_id", F.round(c, 6).alias("confidence"), F.round(1 - c, 6).alias("uncertainty"))


@query("""select event_id, work_id, accepted from (select *, coalesce(fencing_token >= max(fencing_token) over (partition by work_id order by event_id rows unbounded preceding), false) as accepted from (select distinct event_id, work_id, fencing_token from recovery_events where work_id is not null))""")
def fenced_events(spark, sf_dir):
    """Events whose token no earlier one of their item outdoes."""
    from tidemark.streaming import flows

    e = table(spark, sf_dir, "recovery_events").where("work_id is not null").select("event_id", "work_id", "fencing_token").distinct()
    return flows.fenced(e, "work_id", "fencing_token", "event_id").select("event_id", "work_id", "accepted")


@query(f"""with {_EDGES}, g as (select target as host, sum(links)::bigint as links, count(*) as hosts from edges group by 1), r as (select {host_sql('hostname')} as host, max(priority) / 100 as rel, count(distinct source) / 8.0 as topical from domain_candidates group by 1), e as (select {host_sql('hostname')} as host, count(*) / 20.0 as near from expansion_candidates group by 1)
  select g.host, round((0.4 * coalesce(topical, 0) + 0.25 * {_SAT.format('links')} + 0.2 * {_SAT.format('hosts')} + 0.15 * least(1, coalesce(near, 0))) * (0.5 + 0.5 * coalesce(rel, 0)), 6) as authority,
    round(sqrt(greatest(0, (0.4 * coalesce(topical, 0) + 0.25 * {_SAT.format('links')} + 0.2 * {_SAT.format('hosts')} + 0.15 * least(1, coalesce(near, 0))) * (0.5 + 0.5 * coalesce(rel, 0)) * coalesce(rel, 0))), 6) as balance from g left join r using (host) left join e using (host)""")
def query_authority(spark, sf_dir):
    """Authority of hosts, weighed with how far they matter to what is asked, and the balance of both."""
    g = _edges(spark, sf_dir).groupBy(F.col("target").alias("host")).agg(F.sum("links").alias("links"), F.count("*").alias("hosts"))
    r = table(spark, sf_dir, "domain_candidates").groupBy(clean_host(F.col("hostname")).alias("host")).agg((F.max("priority") / 100).alias("rel"), (F.count_distinct("source") / 8).alias("topical")).where("host is not null")
    e = table(spark, sf_dir, "expansion_candidates").groupBy(clean_host(F.col("hostname")).alias("host")).agg((F.count("*") / 20).alias("near")).where("host is not null")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = g.join(r, "host", "left").join(e, "host", "left")
    authority = signals.query_authority(zero("topical"), graph.saturation(F.col("links")), graph.saturation(F.col("hosts")), F.least(F.lit(1.0), zero("near")), zero("rel"))
    return out.select("host", F.round(authority, 6).alias("authority"), F.round(F.sqrt(F.greatest(F.lit(0.0), authority * zero("rel"))), 6).alias("balance"))


@query(f"""select queue, count(*) as urls, round(sum(wait), 3) as wait from (select case when s >= 0.9 then 'critical' when s >= 0.72 then 'high' when s >= 0.5 then 'normal' when s >= 0.25 then 'low' else 'idle' end as queue, power(2, least(attempts, 10))::double as wait
  from (select attempts, 0.6 * coalesce(priority, 0) / 100 + 0.4 * (1 - exp(-ln(2) * greatest(0, {NOW} - coalesce(last_crawled_at, 0)) / 86400 / 14)) as s from urls)) group by 1""")
def freshness_queues(spark, sf_dir):
    """Queues of urls by bands of what they're worth and how old they are, with the waits of their retries."""
    from tidemark.functions.numbers import recency

    age = F.greatest(F.lit(0.0), NOW - F.coalesce("last_crawled_at", F.lit(0.0))) / 86400
    s = 0.6 * F.coalesce("priority", F.lit(0.0)) / 100 + 0.4 * (1 - recency(age, 14))
    u = table(spark, sf_dir, "urls").select(signals.bands(s, {"critical": 0.9, "high": 0.72, "normal": 0.5, "low": 0.25}, "idle").alias("queue"), F.pow(F.lit(2.0), F.least("attempts", F.lit(10))).alias("wait"))
    return u.groupBy("queue").agg(F.count("*").alias("urls"), F.round(F.sum("wait"), 3).alias("wait"))


@query(f"""with f as ({SOURCE_SCORES}) select work_id, least(100.0, greatest(0.0, priority + least(10, greatest(-10, coalesce(score, 0))))) as adjusted from discovery_work left join f using (source) where priority is not null""")
def feedback_adjusted(spark, sf_dir):
    """Priorities of work adjusted by what its source has brought, ten up or down at most."""
    score = QUERIES_OF_CRAWL["source_feedback"](spark, sf_dir)
    w = table(spark, sf_dir, "discovery_work").where("priority is not null").join(score, "source", "left")
    by = F.least(F.lit(10), F.greatest(F.lit(-10), F.coalesce("score", F.lit(0))))
    return w.select("work_id", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("priority") + by)).alias("adjusted"))


RISK = [("url", "address", 1.0), ("url", "punycode", 0.6), ("url", "labels", 0.4), ("url", "long", 0.3), ("url", "encoded", 0.3)]
_HOST = r"lower(regexp_extract(trim(url, ' '), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_RISK_SQL = {"address": rf"regexp_matches({_HOST}, '^[0-9.]+$')::int", "punycode": f"contains({_HOST}, 'xn--')::int", "labels": f"least(1, greatest(0, len(string_split({_HOST}, '.')) - 3) / 3.0)", "long": "least(1, length(url) / 200.0)", "encoded": "least(1, (length(url) - length(replace(url, '%', ''))) / 10.0)"}


@query(f"""with r as ({_weigh_sql(_long_sql("row_id", _RISK_SQL, "(select * from urls where url is not null)"), RISK, "row_id")}) select row_id, score, case when score >= 0.95 then 'block' when score >= 0.8 then 'danger' when score >= 0.6 then 'suspect' else 'none' end as band from r""")
def url_risk(spark, sf_dir):
    """What makes urls look harmful, as a weighted mean with bands."""
    from tidemark.functions import url as U

    u = table(spark, sf_dir, "urls").where("url is not null").select("row_id", "url", U.host(F.col("url")).alias("h"))
    one = lambda c: F.when(c, 1).otherwise(0)
    given = {"address": one(F.col("h").rlike(r"^[0-9.]+$")), "punycode": one(F.col("h").contains("xn--")), "labels": F.least(F.lit(1.0), F.greatest(F.lit(0), F.size(F.split("h", r"\.")) - 3) / 3), "long": F.least(F.lit(1.0), F.length("url") / 200), "encoded": F.least(F.lit(1.0), (F.length("url") - F.length(F.replace("url", F.lit("%"), F.lit("")))) / 10)}
    out = signals.weigh(signals.long_signals(u, ["row_id"], given), _weights(spark, RISK), ["row_id"])
    return out.select("row_id", "score", signals.bands(F.col("score"), {"block": 0.95, "danger": 0.8, "suspect": 0.6}, "none").alias("band"))
