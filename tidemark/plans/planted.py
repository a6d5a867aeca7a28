"""Queries on sources, pages and stores, over inputs made from the tables: what goes in must come out. With SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import query as Q
from tidemark.functions.text import clean_host
from tidemark.functions.udfs import url_prefixed
from tidemark.operators import graph, knowledge, storage
from tidemark.plans.core_problems import host_sql
from tidemark.sources import web
from tidemark.sources.tables import table
from tidemark.streaming import flows
from tidemark.session import scratch

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Urls that links can be made of without losing anything: no fragment, space, backslash, control character or empty query.
_PLAIN = r"^https?://[a-z0-9.-]+/(?:[^#\s\\<>\x00-\x1f\x85\xa0]*[^#\s\\<>\x00-\x1f\x85\xa0?])?\z"
_LINKS = f"(select distinct url from urls where regexp_matches(url, '{_PLAIN}'))"


def _urls(spark, sf_dir):
    return table(spark, sf_dir, "urls").select("url").where(F.col("url").rlike(_PLAIN)).distinct()


def _escaped(c):
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


@query(f"select distinct {host_sql('hostname')} as hostname from domain_candidates where {host_sql('hostname')} is not null")
def certificate_hosts(spark, sf_dir):
    """Host names of certificate log records, made from the candidates, with wildcards and several names a record."""
    names = F.concat_ws("\n", F.concat(F.lit("*."), F.trim("hostname")), F.col("hostname"))
    logs = table(spark, sf_dir, "domain_candidates").select(F.to_json(F.array(F.struct(names.alias("name_value"), F.col("hostname").alias("common_name")))).alias("json"))
    return web.certificate_names(logs)


@query(f"select 'url' as kind, url as loc from {_LINKS}")
def sitemap_urls(spark, sf_dir):
    """Locations of sitemaps made from the urls."""
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '), _escaped(F.col("url")), F.lit(" </loc></url></urlset>"))
    return web.sitemap_locations(_urls(spark, sf_dir).select(xml.alias("xml")))


@query(f"select count(*) as links from {_LINKS}")
def feed_entries(spark, sf_dir):
    """Links of feeds made from the urls, half of them RSS, half Atom."""
    u = _escaped(F.col("url"))
    rss = F.concat(F.lit("<rss><channel><item><link>"), u, F.lit("</link></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="'), u, F.lit('"/></entry></feed>'))
    feeds = _urls(spark, sf_dir).select("url", F.when(F.pmod(F.xxhash64("url"), F.lit(2)) == 0, rss).otherwise(atom).alias("xml"))
    return web.feed_links(feeds).where("link = url").agg(F.count_distinct("link").alias("links"))


@query("select count(*) as pages, count(*) as found from documents where regexp_matches(url, '^https://[a-z0-9./-]+$')")
def feed_endpoints(spark, sf_dir):
    """Feeds that pages announce by relative links."""
    pages = table(spark, sf_dir, "documents").select("url").where(F.col("url").rlike(r"^https://[a-z0-9./-]+$"))
    html = F.lit('<html><head><link rel="alternate" type="application/rss+xml" href="/feed.xml"><link rel="stylesheet" href="/a.css"></head></html>')
    found = web.feed_endpoints(pages.withColumn("html", html))
    right = F.col("link") == F.concat(F.regexp_extract("url", r"^(https://[^/]+)", 1), F.lit("/feed.xml"))
    return pages.agg(F.count("*").alias("pages")).crossJoin(found.agg(F.count_if(right).alias("found")))  # one row each


@query(f"select count(*) as links from {_LINKS}")
def page_links(spark, sf_dir):
    """Links of pages made from the urls."""
    html = F.concat(F.lit('<html><body><a href="'), _escaped(F.col("url")), F.lit('">x</a><a href="mailto:a@b.c">y</a><a>z</a></body></html>'))
    pages = _urls(spark, sf_dir).select("url", html.alias("html"))
    return web.links(pages).where("link = url").agg(F.count("*").alias("links"))


@query("select doc_id, source as title, url as canonical, lang as navigation, source as headings, lang as footer, 'side' as sidebar from documents where regexp_matches(source, '^[a-z0-9.-]+$') and regexp_matches(lang, '^[a-z-]+$') and regexp_matches(url, '^https://[a-z0-9.-]+/[a-z0-9./-]+$')")
def page_regions(spark, sf_dir):
    """Title, canonical link and regions of pages made from the documents; scripts don't count."""
    d = table(spark, sf_dir, "documents").where(F.col("source").rlike("^[a-z0-9.-]+$") & F.col("lang").rlike("^[a-z-]+$") & F.col("url").rlike("^https://[a-z0-9.-]+/[a-z0-9./-]+$"))
    html = F.format_string('<html><head><title>%s</title><link rel="canonical" href="%s"><script>var title;</script></head><body><nav>%s</nav><aside>side</aside><h1>%s</h1><p>%s</p><footer>%s</footer></body></html>', "source", "url", "lang", "source", _escaped(F.coalesce("title", F.lit(""))), "lang")
    return web.pages(d.select("doc_id", "url", html.alias("html"))).select("doc_id", "title", "canonical", "navigation", "headings", "footer", "sidebar")


@query(f"""with a as (select {host_sql('hostname')} as hostname, priority, 'work' as source, 0 as o from discovery_work union all select {host_sql('hostname')}, priority, 'records', 1 from discovery_records union all select {host_sql('hostname')}, priority, 'candidates', 2 from domain_candidates)
  select hostname, priority, source from (select *, row_number() over (partition by hostname order by o, priority nulls first) as n from a where hostname is not null) where n = 1""")
def federated_hosts(spark, sf_dir):
    """Hosts of three sources, each from the first that has it."""
    part = lambda t: table(spark, sf_dir, t).select(clean_host(F.col("hostname")).alias("hostname"), "priority").where("hostname is not null")
    return web.federated({"work": part("discovery_work"), "records": part("discovery_records"), "candidates": part("domain_candidates")}, "hostname", ["hostname", "priority"])


@query("""select doc_id, title from documents where doc_id % 3 <> 0 union all select doc_id, title || '!' from documents where doc_id % 3 = 0 and doc_id % 6 <> 0 union all select -doc_id, 'new' from documents where doc_id % 50 = 1""")
def transaction_view(spark, sf_dir):
    """What a transaction sees that changed, deleted and added documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "title")
    changes = d.where("doc_id % 3 = 0").select("doc_id", F.concat("title", F.lit("!")).alias("title"), (F.col("doc_id") % 6 == 0).alias("deleted"))
    changes = changes.unionByName(d.where("doc_id % 50 = 1").select((-F.col("doc_id")).alias("doc_id"), F.lit("new").alias("title"), F.lit(False).alias("deleted")))
    return storage.overlay(d, changes, "doc_id", "title", "deleted")


@query("""select checked, checked - missing - corrupted as healthy, corrupted, missing from (select count(*) as checked, count(*) filter (where text is null) as missing, count(*) filter (where text is not null and doc_id % 7 = 0) as corrupted from documents)""")
def integrity_scan(spark, sf_dir):
    """Texts held against checksums, one in seven of which is that of another content."""
    d = table(spark, sf_dir, "documents").withColumn("checksum", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary"), 256))
    return storage.integrity(d, "text", "checksum")


@query(f"""with s as (select {host_sql('host')} as k, max(failures) > 0 as x from hosts group by 1), t as (select {host_sql('hostname')} as k, max(attempts) > 1 as x from discovery_work group by 1)
  select * from (select coalesce(s.k, t.k) as key, case when t.k is null then 'put' when s.k is null then 'delete' when s.x <> t.x then 'replace' end as action from (select * from s where k is not null) s full join (select * from t where k is not null) t on s.k = t.k) where action is not null""")
def replica_repair(spark, sf_dir):
    """What makes one store of hosts equal to another: keys to put, replace and delete."""
    h = table(spark, sf_dir, "hosts").groupBy(clean_host(F.col("host")).alias("key")).agg((F.max("failures") > 0).alias("x")).where("key is not null")
    w = table(spark, sf_dir, "discovery_work").groupBy(clean_host(F.col("hostname")).alias("key")).agg((F.max("attempts") > 1).alias("x")).where("key is not null")
    digest = F.sha2(F.col("x").cast("string"), 256)
    return storage.replica_repair(h.select("key", digest.alias("sum")), w.select("key", digest.alias("sum")), "key", "sum")


@query(f"""select w.work_id, h.organization_domain from (select *, {host_sql('hostname')} as h from discovery_work) w join (select *, {host_sql('host')} as k from hosts) h on w.h = h.k
  where w.status <> 'completed' order by w.created_at desc nulls last, w.work_id, h.organization_domain limit 200""")
def pending_handoff(spark, sf_dir):
    """Open work of known hosts, newest first."""
    w = table(spark, sf_dir, "discovery_work").where("status <> 'completed'").withColumn("host", clean_host(F.col("hostname")))
    h = table(spark, sf_dir, "hosts").select(clean_host(F.col("host")).alias("host"), "organization_domain")
    return w.join(h, "host").orderBy(F.col("created_at").desc_nulls_last(), "work_id", F.col("organization_domain").asc_nulls_last()).limit(200).select("work_id", "organization_domain")


_HANDOFFS = """h as (select source, target, count(*) as links from (select lag(worker_id) over (partition by work_id order by event_id) as source, worker_id as target from (select distinct work_id, event_id, worker_id from recovery_events where worker_id is not null)) where source is not null and source <> target group by 1, 2)"""


def _handoffs(spark, sf_dir):
    e = table(spark, sf_dir, "recovery_events").where("worker_id is not null").select("work_id", "event_id", "worker_id").distinct()
    return graph.edges(e.withColumn("before", F.lag("worker_id").over(Window.partitionBy("work_id").orderBy("event_id"))), "before", "worker_id")


@query(f"with {_HANDOFFS} select a.source as a, a.target as b, a.links + b.links as links from h a join h b on a.source = b.target and a.target = b.source and a.source < a.target")
def link_reciprocity(spark, sf_dir):
    """Workers that hand items to each other."""
    return graph.reciprocal(_handoffs(spark, sf_dir))


_STEPS = """t as (select s, o, n / sum(n) over (partition by s) as c from (select previous_state as s, new_state as o, count(*) as n from recovery_events where previous_state is not null and previous_state <> new_state group by 1, 2))"""


@query(f"""with {_STEPS} select a.s as subject, b.o as object, round(max(a.c * b.c * 0.85), 6) as confidence, count(*) as evidence from t a join t b on a.o = b.s and a.s <> b.o where not exists (select 1 from t x where x.s = a.s and x.o = b.o) group by 1, 2""")
def inference(spark, sf_dir):
    """Changes of state in two steps that never came in one."""
    e = table(spark, sf_dir, "recovery_events").where("previous_state is not null and previous_state <> new_state").groupBy(F.col("previous_state").alias("subject"), F.col("new_state").alias("object")).agg(F.count("*").alias("n"))
    all_ = e.groupBy("subject").agg(F.sum("n").alias("all"))
    t = e.join(all_, "subject").select("subject", "object", (F.col("n") / F.col("all")).alias("confidence"))
    return knowledge.infer(t, 0.85).withColumn("confidence", F.round("confidence", 6))


@query("select doc_id, sha256(to_json(struct_pack(p0 := lower(title), p1 := regexp_extract_all(lower(title), '[a-z0-9]+')))) as canonical from documents where title is not null and regexp_matches(title, '^[ -!#-.0-\\[\\]-~]*$')")
def canonical_hashes(spark, sf_dir):
    """Hashes of titles as queries, in the order of their words."""
    d = table(spark, sf_dir, "documents").where(F.col("title").rlike(r"^[ -!#-.0-\[\]-~]*$"))
    return d.select("doc_id", Q.canonical_hash(F.lower("title"), F.regexp_extract_all(F.lower("title"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("canonical"))


@query()
def url_prefixes(spark, sf_dir):
    """Urls by the normaliser that keeps the order of parameters and drops those with tracking prefixes."""
    return table(spark, sf_dir, "urls").select(url_prefixed("url").alias("normalized")).groupBy("normalized").agg(F.count("*").alias("n"))


@query("""select count(*) as messages, count(*) filter (where event_id % 11 <> 0) as delivered, count(*) filter (where event_id % 11 = 0) as dead from (select distinct event_id from recovery_events)""")
def message_delivery(spark, sf_dir):
    """A stream of messages of which every fifth fails once and every eleventh always."""
    path = scratch(spark, "messages")
    table(spark, sf_dir, "recovery_events").select(F.col("event_id").alias("message_id")).distinct().write.parquet(path)
    fails = (F.col("message_id") % 11 == 0) | ((F.col("message_id") % 5 == 0) & (F.col("__attempt") < 2))
    done, dead = flows.deliver(spark, path, lambda m: m.withColumn("failed", fails))
    d, x = done.agg(F.count("*").alias("delivered")), dead.agg(F.count("*").alias("dead"))
    return d.crossJoin(x).select((F.col("delivered") + F.col("dead")).alias("messages"), "delivered", "dead")  # one row each
