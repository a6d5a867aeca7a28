"""Queries on problems 1, 2, 5, 7, 8, 9 and 10, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import clean_host, day_of, words_text
from tidemark.llm import capping, encoding, formatting, leakage, packing, seen, sketches
from tidemark.plans.core_problems import host_sql
from tidemark.session import materialize
from tidemark.sources.tables import spread, table


def _discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "discovery_records")
    return r.select(day_of(F.col("discovered_at")).alias("day"), F.lower(F.trim("source")).alias("source"), clean_host(F.col("hostname")).alias("hostname"))


def p1_distinct_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct host names a day, a source, both, and in all, with 95% intervals."""
    return sketches.distinct_cube(_discoveries(spark, sf_dir), ["day", "source"], "hostname")


def _beside_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates with their exact counts, ``hosts``."""
    rows = _discoveries(spark, sf_dir).where(F.col("hostname").isNotNull()).distinct()
    # Each level counts pairs that are distinct by then; no level counts within one task.
    levels = {"": [], "day": ["day"], "source": ["source"], "day,source": ["day", "source"]}
    exact = None
    for name, dims in levels.items():
        one = rows.select(*dims, "hostname").distinct().groupBy(*dims).agg(F.count("*").alias("hosts")).select(F.lit(name).alias("grouped"), *[F.col(d) if d in dims else F.lit(None).cast("string").alias(d) for d in ("day", "source")], "hosts")
        exact = one if exact is None else exact.unionByName(one)
    e, x = sketches.distinct_cube(_discoveries(spark, sf_dir), ["day", "source"], "hostname").alias("e"), exact.where(F.col("hosts") > 0).alias("x")
    both = e.join(x, (F.col("e.grouped") == F.col("x.grouped")) & F.col("e.day").eqNullSafe(F.col("x.day")) & F.col("e.source").eqNullSafe(F.col("x.source")))
    return both.select("x.grouped", "x.day", "x.source", "hosts", "estimate", "lo", "hi", "rel_error")


def p1_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts beside the estimates: whether each estimate lies within six standard errors."""
    return _beside_exact(spark, sf_dir).select("grouped", "day", "source", "hosts", (F.abs(F.col("estimate") - F.col("hosts")) <= 6 * F.col("rel_error") * F.col("hosts")).alias("within"))


def p1_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are, and whether nine tenths of their 95% intervals, at least, hold the exact count."""
    holds = F.col("hosts").between(F.col("lo"), F.col("hi"))
    return _beside_exact(spark, sf_dir).agg(F.count("*").alias("groups"), (F.count_if(holds) >= 0.9 * F.count("*")).alias("hold"))


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = spread(table(spark, sf_dir, "urls").select("url", "row_id")).select(F.lit("urls").alias("tbl"), formatting.url_key(F.col("url")).alias("key"), F.col("row_id").alias("id"))
    found = spread(table(spark, sf_dir, "expansion_candidates").select("first_url", "candidate_id")).select(F.lit("expansion_candidates").alias("tbl"), formatting.url_key(F.col("first_url")).alias("key"), F.col("candidate_id").alias("id"))
    return urls.unionByName(found)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose url is a copy, but for its formatting, of that of a row with a smaller id."""
    return formatting.copies_of(_addresses(spark, sf_dir))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct record with its number of copies."""
    return formatting.collapse(_addresses(spark, sf_dir))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "urls").select(F.lit("urls").alias("tbl"), F.col("row_id").alias("id"), F.col("url").alias("key"))
    names = table(spark, sf_dir, "domain_candidates").select(F.lit("domain_candidates").alias("tbl"), F.col("candidate_id").alias("id"), clean_host(F.col("hostname")).alias("key"))
    return urls.unionByName(names)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals whose key came before."""
    return seen.seen_before(_arrivals(spark, sf_dir)).select("tbl", F.col("id").alias("record_id"))


def p5_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of wrong answers of the filter chains, as measured and as bounded."""
    return seen.error_report(_arrivals(spark, sf_dir))


def p5_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chains counted, with their wrong answers put right, and whether their rate keeps the bound."""
    r = seen.error_report(_arrivals(spark, sf_dir))
    return r.select("tbl", "arrivals", (F.col("kept_keys") + F.col("wrong")).alias("keys"), (F.col("said_seen") - F.col("wrong")).alias("repeats"), (F.col("wrong_rate") <= F.col("bound")).alias("within"))


def p5_in_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of the second half whose key came before: the first half's chains are stored and loaded again."""
    rows = _arrivals(spark, sf_dir)
    half = F.col("id") <= rows.agg(F.max("id")).first()[0] // 2
    kept = materialize(seen.layers(seen.verdicts(rows.where(half), keep=True)), "chains")
    said = seen.verdicts(rows.where(~half), before=kept).where("kind = 'seen'").select("tbl", "id", "h")
    # Checked exactly against all keys under suspicion.
    return said.select("tbl", "id").join(seen.wrong(rows, said.withColumn("kind", F.lit("seen"))).hint("merge"), ["tbl", "id"], "left_anti").select("tbl", F.col("id").alias("record_id"))


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "urls").select(clean_host(F.col("host")).alias("host"), "priority", "row_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 rows to keep of each host with more: the reservoir at temperature 0."""
    return capping.reservoir(_frontier(spark, sf_dir), "host", "priority", "row_id", 40, over_cap_only=True).select("host", "row_id")


def p7_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 40 rows of each host, drawn with weights exp(priority / 10)."""
    return capping.reservoir(_frontier(spark, sf_dir), "host", "priority", "row_id", 40, temperature=10.0).select("host", "row_id")


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each host and how many of them were drawn, and whether each drawn one is a row of its own."""
    n = _frontier(spark, sf_dir).where("host is not null").groupBy("host").agg(F.count("*").alias("rows"))
    drawn = p7_sampled(spark, sf_dir).groupBy("host").agg(F.count("*").alias("kept"), (F.count("*") == F.count_distinct("row_id")).alias("once"))
    return n.join(drawn, "host", "left").select("host", "rows", F.coalesce("kept", F.lit(0)).alias("kept"), "once")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows of each host up to half a percent of all rows."""
    return capping.share_cap(_frontier(spark, sf_dir), "host", "priority", "row_id", 0.005).select("host", "row_id")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Tokens a container holds.
CAPACITY = 8192


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each text goes."""
    return packing.pack_documents(_documents(spark, sf_dir), CAPACITY)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full each container is, and what it costs."""
    return packing.containers(p8_pack(spark, sf_dir), CAPACITY)


def p8_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packing must keep: texts that come out, containers over capacity, texts split without need, texts with tokens
    lost or doubled, and whether no more containers were opened than one a shard and one percent above the least."""
    sizes = materialize(packing.token_counts(_documents(spark, sf_dir)), "tokens")
    placed = materialize(packing.pack(sizes, CAPACITY), "placed")
    texts = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("out"), F.count("*").alias("pieces"), F.count_distinct("from_token").alias("starts")).join(sizes, "doc_id", "full")
    counts = texts.agg(F.count("out").alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= CAPACITY)).alias("wrongly_split"), F.count_if(~F.col("out").eqNullSafe(F.col("n_tokens")) | (F.col("starts") < F.col("pieces"))).alias("lost"), F.sum("n_tokens").alias("__all"))
    full = packing.containers(placed, CAPACITY).agg(F.count_if(F.col("unused") < 0).alias("overfull"), F.count("*").alias("__containers"), F.count_distinct("shard").alias("__shards"))
    tight = F.col("__containers") <= F.ceil(F.col("__all") / CAPACITY * 1.01) + F.col("__shards")
    return counts.crossJoin(full).select("texts", "overfull", "wrongly_split", "lost", tight.alias("tight"))  # one row each


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select("item_id", "passage")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 13 words in a row of a passage: tiles of 13 words or more that cover at least 13 of its words."""
    return leakage.leaks(_documents(spark, sf_dir), _items(spark, sf_dir), shortest=13, least=13).select("doc_id", "item_id")


def p9_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold most of a passage in parts, in any order: tiles of five words or more over 0.8 of it."""
    return leakage.leaks(_documents(spark, sf_dir), _items(spark, sf_dir), shortest=5, coverage=0.8)


def p9_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 30 words or more, cut in three and put in another order between words of its own documents: which
    are found, and how much of each is covered."""
    items = _items(spark, sf_dir).select("item_id", F.split(words_text(F.col("passage")), " ").alias("w")).where(F.size("w") >= 30)
    third = F.floor(F.size("w") / 3).cast("int")
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    mixed = F.concat(F.lit("alien "), part(2 * third + 1, F.size("w") - 2 * third), F.lit(" foreign "), part(F.lit(1), third), F.lit(" strange "), part(third + 1, third))
    planted = items.select(F.col("item_id").alias("doc_id"), mixed.alias("text"))
    found = leakage.leaks(planted, _items(spark, sf_dir), shortest=5, coverage=0.8).where("doc_id = item_id")
    return found.select("item_id", "words", (F.col("covered") == F.col("words")).alias("whole"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that were garbled in whole or in part."""
    return encoding.garbled_documents(_documents(spark, sf_dir))


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled texts put right as far as possible."""
    return encoding.restored_documents(_documents(spark, sf_dir))


def p10_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound texts garbled in ways of their languages and set beside all others: whether at least 95% of them are found, and
    90% of their spoilt words put right. (Words of one or two letters that were one byte each stay as they are.)"""
    docs = _documents(spark, sf_dir)
    bad = materialize(encoding.garbled_documents(docs), "found")
    wide = (F.octet_length("text") > F.length("text") + 20) & (F.length("text") < 20_000)
    sound = docs.where(wide & (F.pmod(F.xxhash64("doc_id"), F.lit(20)) == 0)).join(bad, "doc_id", "left_anti")
    planted = materialize(encoding.planted(sound), "planted")
    got = encoding.restored_documents(docs.unionByName(planted.select("doc_id", F.col("garbled").alias("text"))))
    both = planted.join(got, "doc_id", "left")
    words = F.explode(F.arrays_zip(*[F.split(F.coalesce(c, F.lit("")), " ").alias(c) for c in ("text", "garbled", "restored")]))
    spoilt = both.select(words.alias("w")).where("w.text <> w.garbled").agg((F.count_if(F.col("w.restored") == F.col("w.text")) >= 0.9 * F.count("*")).alias("restored"))
    return both.agg((F.count("restored") >= 0.95 * F.count("*")).alias("found")).crossJoin(spoilt)  # one row each


QUERIES = {f.__name__: f for f in (p1_distinct_hosts, p1_audit, p1_intervals, p2_found, p2_groups, p5_found, p5_error_rate, p5_audit, p5_in_two_runs, p7_found, p7_sampled, p7_audit, p7_shares, p8_pack, p8_containers, p8_audit, p9_found, p9_reordered, p9_planted, p10_found, p10_restored, p10_planted)}


def _words_sql(c: str) -> str:
    return rf"lower(trim(regexp_replace({c}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"


def _key_sql(c: str) -> str:
    tail = f"case when instr({c}, '?') > 0 then substr({c}, instr({c}, '?') + 1) else '' end"
    return f"{_words_sql(f'split_part({c}, chr(63), 1)')} || '?' || array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array({tail}, '[&;]'), lambda x: {_words_sql('x')}), lambda x: x <> '')), '&')"


_KEYED = f"""
  select 'urls' as tbl, row_id as id, {_key_sql("url")} as k from urls where url is not null
  union all select 'expansion_candidates', candidate_id, {_key_sql("first_url")} from expansion_candidates where first_url is not null
"""
_ARRIVED = f"""
  select 'urls' as tbl, row_id as id, url as k from urls
  union all select 'domain_candidates', candidate_id, {host_sql("hostname")} from domain_candidates
"""
SQL = {
    "p2_found": f"select tbl, kept_id, id as copy_id from (select tbl, id, min(id) over (partition by tbl, k) as kept_id from ({_KEYED})) where id > kept_id",
    "p2_groups": f"select tbl, min(id) as kept_id, count(*) as copies from ({_KEYED}) group by tbl, k",
    "p5_found": f"select tbl, id as record_id from (select tbl, id, min(id) over (partition by tbl, k) as first from ({_ARRIVED}) where k is not null) where id > first",
    "p5_audit": f"select tbl, count(*) as arrivals, count(distinct k) as keys, count(*) - count(distinct k) as repeats, true as within from ({_ARRIVED}) where k is not null group by 1",
    "p5_in_two_runs": f"with a as ({_ARRIVED}) select tbl, id as record_id from (select tbl, id, min(id) over (partition by tbl, k) as first from a where k is not null) where id > first and id > (select max(id) // 2 from a)",
    "p7_found": f"""
      select host, row_id from (select host, row_id, count(*) over (partition by host) as n, row_number() over (partition by host order by priority desc nulls last, row_id) as r
        from (select {host_sql("host")} as host, priority, row_id from urls) where host is not null) where n > 40 and r <= 40
    """,
    "p10_planted": "select true as found, true as restored",
    "p1_intervals": f"""
      select count(*) as groups, true as hold from (select day, source, grouping(day, source) as g from (
        select strftime(make_timestamp((discovered_at * 1000000)::bigint), '%Y-%m-%d') as day, lower(trim(source)) as source, {host_sql("hostname")} as h from discovery_records) where h is not null
        group by grouping sets ((), (day), (source), (day, source)))
    """,
    "p7_audit": f"select host, count(*) as rows, least(count(*), 40) as kept, true as once from (select {host_sql('host')} as host from urls) where host is not null group by 1",
    "p7_shares": f"""
      with u as (select {host_sql("host")} as host, priority, row_id from urls), k as (select * from u where host is not null)
      select host, row_id from (select host, row_id, row_number() over (partition by host order by priority desc nulls last, row_id) as r from k) where r <= greatest(1, (select count(*) from k) * 0.005::double)
    """,
    "p8_audit": "select count(*) as texts, 0 as overfull, 0 as wrongly_split, 0 as lost, true as tight from documents",
    "p1_audit": f"""
      select case when g = 0 then 'day,source' when g = 1 then 'day' when g = 2 then 'source' else '' end as grouped, day, source, hosts, true as within
      from (select day, source, grouping(day, source) as g, count(distinct h) as hosts from (
        select strftime(make_timestamp((discovered_at * 1000000)::bigint), '%Y-%m-%d') as day, lower(trim(source)) as source, {host_sql("hostname")} as h from discovery_records) where h is not null
        group by grouping sets ((), (day), (source), (day, source)))
    """,
    "p9_planted": f"select item_id, len(w)::int as words, true as whole from (select item_id, string_split({_words_sql('passage')}, ' ') as w from eval_items) where len(w) >= 30",
    "p9_found": f"""
      with d as (select doc_id, string_split({_words_sql("text")}, ' ') as w from documents where text is not null),
        i as (select item_id, string_split({_words_sql("passage")}, ' ') as w from eval_items),
        dg as (select distinct doc_id, array_to_string(w[k:k + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from d)),
        ig as (select distinct item_id, array_to_string(w[k:k + 12], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 11)) as k from i))
      select distinct doc_id, item_id from dg join ig using (g)
    """,
}
