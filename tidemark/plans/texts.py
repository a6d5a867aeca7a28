"""Queries on texts and urls: url parts, queries, sentences, facts, snippets, streams. With SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import query as Q
from tidemark.functions import url as U
from tidemark.functions.text import clean_host, fold
from tidemark.functions.udfs import highlight, url_normalize
from tidemark.operators import index, present
from tidemark.plans.core_problems import host_sql
from tidemark.plans.search import FIELDS, QUERIES as SEARCH, SQL as SEARCH_SQL, fold_sql
from tidemark.session import materialize, scratch
from tidemark.sources.tables import spread, table
from tidemark.streaming import flows

QUERIES, SQL = {}, {}
TERMS = ["crawl", "budget"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_HEAD = "^[A-Za-z][A-Za-z0-9+.-]*://"


@query(rf"""select row_id, lower(regexp_extract(trim(url, ' '), '{_HEAD}(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host, lower(regexp_extract(trim(url, ' '), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme,
  len(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> ''))::int as parameters from urls where url is not null""")
def url_parts(spark, sf_dir):
    u = table(spark, sf_dir, "urls").where("url is not null")
    return u.select("row_id", U.host(F.col("url")).alias("host"), U.scheme(F.col("url")).alias("scheme"), F.size(U.parameters(F.col("url"))).alias("parameters"))


_PATH = rf"regexp_extract(trim(url, ' '), '{_HEAD}[^/?#]*([^?#]*)', 1)"
_VIEWS = "[" + ", ".join(f"'{x}'" for x in U.VIEW_PARAMETERS) + "]"


@query(rf"""with p as (select row_id, {_PATH} as path, list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: lower(split_part(x, '=', 1))) as names from urls where url is not null),
  s as (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as seg, regexp_matches(path, '{U.VIEW_PATHS}') as pattern from p),
  c as (select *, len(names) as n, len(list_filter(names, lambda x: list_contains({_VIEWS}, x))) as views, len(list_filter(seg, lambda x: regexp_full_match(x, '[0-9]+'))) as numeric,
    coalesce(list_max(map_values(list_aggregate(list_transform(seg, lambda x: regexp_replace(lower(x), '[0-9]+', '{{n}}', 'g')), 'histogram'))), 0) as most from s)
  select row_id, (case when regexp_matches(path, '{U.STATIC}') then 0 else greatest(0, 100 - least(n * 3, 18) - least(views * 7, 28) - case when n > 12 then 20 else 0 end - case when pattern then 30 else 0 end
    - case when numeric >= 3 and not pattern then 8 else 0 end - case when len(seg) >= 5 and most >= 3 then 15 else 0 end - case when len(seg) > 20 then 15 else 0 end) end)::int as score from c""")
def crawl_space(spark, sf_dir):
    return table(spark, sf_dir, "urls").where("url is not null").select("row_id", U.crawl_space(F.col("url")).alias("score"))


@query(rf"""select valid, registrable, count(*) as n from (select coalesce(length(h) <= 253 and regexp_matches(h, '^(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?$'), false) as valid,
  regexp_extract(h, '[^.]+\.[^.]+$') as registrable from (select {host_sql('hostname')} as h from domain_candidates)) group by 1, 2""")
def host_validation(spark, sf_dir):
    h = table(spark, sf_dir, "domain_candidates").select(clean_host(F.col("hostname")).alias("h"))
    return h.select(F.coalesce(U.is_host(F.col("h")), F.lit(False)).alias("valid"), U.registrable(F.col("h")).alias("registrable")).groupBy("valid", "registrable").agg(F.count("*").alias("n"))


@query()
def url_normalized(spark, sf_dir):
    """Distinct rows a normalised url."""
    return table(spark, sf_dir, "urls").select(url_normalize("url").alias("normalized")).groupBy("normalized").agg(F.count("*").alias("n"))


@query(f"select doc_id, {fold_sql('title')} as folded from documents")
def folded_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fold(F.col("title")).alias("folded"))


_SENTENCES = r"(select doc_id, sentence from (select doc_id, unnest(string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' '), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31))) as sentence from documents where text is not null) where sentence <> '')"


def _sentences(spark, sf_dir):
    return present.sentences(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


@query(f"select doc_id, count(*) as sentences, max(length(sentence)) as longest from {_SENTENCES} group by 1")
def sentence_split(spark, sf_dir):
    return _sentences(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("sentence")).alias("longest"))


_ASKS = " ".join(f"when starts_with(t, '{w} ') then '{k}'" for w, k in Q.ASKS.items())


@query(f"""select kind, count(*) as n from (select case when t = '' then 'unknown' when split_part(t, ' ', 1) = 'how' and split_part(t, ' ', 2) in {Q.EXPLAIN} then 'explanation' {_ASKS} when ends_with(t, '?') then 'question' else 'statement' end as kind
  from (select lower(sentence) as t from {_SENTENCES})) group by 1""")
def question_kinds(spark, sf_dir):
    return _sentences(spark, sf_dir).select(Q.question_kind(F.col("sentence")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def _phrase_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '^[ .,;:]+|[ .,;:]+$', '', 'g')"


def _first_sql(rules, confidence: float, fits: str) -> str:
    """The first rule that holds, as a struct."""
    out = "null"
    for predicate, verb in reversed(rules):
        parts = [_phrase_sql(f"regexp_extract(s, '{present.stated(verb)}', {k})") for k in (1, 2)]
        holds = " and ".join([f"regexp_matches(s, '{present.stated(verb)}')", *[fits.format(x) for x in parts]])
        out = f"case when {holds} then struct_pack(subject := {parts[0]}, predicate := '{predicate}', value := {parts[1]}, confidence := {confidence}) else {out} end"
    return out


_SHORT = "length({0}) between 1 and 300 and len(string_split({0}, ' ')) <= 40"
_FACTS = f"unnest([{_first_sql([('definition', v) for v in present.DEFINES], present.DEFINITION, _SHORT)}, {_first_sql(present.RELATES, present.RELATION, 'length({0}) >= 1')}])"


@query(rf"""select f.predicate as predicate, f.subject as subject, f.value as value, count(*) as n, max(f.confidence)::double as confidence from (select {_FACTS} as f
  from (select replace(replace(replace(sentence, chr(133), ' '), chr(8232), ' '), chr(8233), ' ') as s from {_SENTENCES})) where f is not null group by 1, 2, 3""")
def fact_extract(spark, sf_dir):
    """What sentences define and relate, both of a sentence that does both."""
    f = _sentences(spark, sf_dir).select(F.explode(present.facts(F.translate("sentence", "\x85  ", "   "))).alias("f"))
    return f.groupBy("f.predicate", "f.subject", "f.value").agg(F.count("*").alias("n"), F.max("f.confidence").alias("confidence"))


@query(r"""select entity, count(*) as documents from (select doc_id, unnest(list_transform(list_filter(u, lambda x, i: not list_contains(list_transform(u[1:i - 1], lambda y: lower(y)), lower(x))), lambda x: x)) as entity from (select doc_id, list_filter(list_transform(string_split(
  array_to_string(list_transform(list_filter(list_transform(string_split(trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g'), ' '), ' '), lambda w: regexp_replace(w, '^[.,!?;:()\[\]{}"'']+|[.,!?;:()\[\]{}"'']+$', '', 'g')), lambda w: w <> ''),
  lambda w: case when regexp_matches(w, '^\p{Lu}') then w else chr(31) end), ' '), chr(31)), lambda r: trim(r, ' ')), lambda r: r <> '') as u from documents)) group by 1""")
def entity_runs(spark, sf_dir):
    """Runs of capitalised words in titles."""
    e = table(spark, sf_dir, "documents").select(F.explode(present.entities(F.col("title"))).alias("entity"))
    return e.groupBy("entity").agg(F.count("*").alias("documents"))


_T = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ')"


@query(f"""with t as (select doc_id, {_T} as t from documents), a as (select *, least(nullif(instr(lower(t), 'crawl'), 0), nullif(instr(lower(t), 'budget'), 0)) - 1 as pos from t),
  e as (select *, least(length(t), greatest(0, pos - 90) + 180) as e from a), s as (select *, greatest(0, least(greatest(0, pos - 90), e - 180)) as s from e)
  select doc_id, case when pos is null then rtrim(substr(t, 1, 180), ' ') else case when e < length(t) then rtrim(case when s > 0 then '… ' else '' end || trim(substr(t, s + 1, e - s), ' '), ' ') || ' …' else case when s > 0 then '… ' else '' end || trim(substr(t, s + 1, e - s), ' ') end end as snippet from s""")
def snippets(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", present.snippet(F.col("text"), TERMS).alias("snippet"))


@query()
def highlighted(spark, sf_dir):
    """Results of the search with their snippets, terms marked."""
    best = SEARCH["search_full"](spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select("doc_id", "title", "url", present.snippet(F.col("text"), TERMS).alias("s"))
    return best.join(texts, "doc_id").select("rank", "doc_id", "score", "title", "url", highlight("s", F.array(*map(F.lit, TERMS))).alias("snippet"))


_STOP = "[" + ", ".join(f"'{w}'" for w in present.STOP) + "]"
#: The first page of results with title and snippet, as one text each.
_PAGE = f"""page as (select r.rank, d.doc_id, d.url, d.title, coalesce(d.title, '') || ' ' || coalesce(s.snippet, '') as text from ({SEARCH_SQL["search_full"]}) r join documents d using (doc_id) join ({SQL["snippets"]}) s using (doc_id))"""


def _page(spark, sf_dir):
    """Results of the search, a page of rows, with title and snippet as one text."""
    best = SEARCH["search_full"](spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", "url", "title", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce(present.snippet(F.col("text"), TERMS), F.lit(""))).alias("text"))
    return best.join(d, "doc_id")


@query(f"""with {_PAGE}, w as (select doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2 and not list_contains({_STOP}, x)))) as name from page)
  select name, count(*) as sources, round(count(*) / (select count(*) from page) + case when name in ('crawl', 'budget') then 0.5 else 0 end, 6) as relevance from w group by 1 order by 3 desc, 2 desc, 1 desc limit 12""")
def concepts(spark, sf_dir):
    """Concepts of the results of a search."""
    return present.concepts(materialize(_page(spark, sf_dir), "page"), "text", TERMS)


@query()
def related_results(spark, sf_dir):
    """Results like the best one, among the first page."""
    best = materialize(SEARCH["search_full"](spark, sf_dir), "page")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("domain"))
    page = best.join(d, "doc_id").withColumn("matched_terms", F.array(*map(F.lit, TERMS)))
    top = best.where("rank = 1").first()
    return present.related(page, top.doc_id if top else -1)


@query(f"""with {_PAGE} select doc_id, contains(lower(text), 'crawl')::int + contains(lower(text), 'budget')::int as overlap from page order by 2 desc, (coalesce(url, '') <> '')::int desc, (coalesce(title, '') <> '')::int desc, doc_id limit 5""")
def evidence(spark, sf_dir):
    """The best evidence among the results of a search."""
    return present.evidence(_page(spark, sf_dir), "doc_id", "text", TERMS, url="url", title="title")


_EDGE = Q.EDGE.replace("'", "''")


@query(rf"""select kind, count(*) as n from (select case when regexp_matches(t, '(?i)^(?:https?://|www\.)\S+$') then 'URL' when regexp_matches(t, '^[^@\s]+@[^@\s]+\.[^@\s]+$') then 'EMAIL' when regexp_matches(t, '^\p{{Nd}}+$') then 'NUMBER'
  when regexp_matches(t, '(?i)^(?:AND|OR|NOT)$') then 'OPERATOR' when regexp_matches(t, '[^\p{{L}}\p{{N}}]') then 'SYMBOL' else 'TERM' end as kind from (select regexp_replace(unnest(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')), '{_EDGE}', '', 'g') as t from documents where text is not null) where t <> '') group by 1""")
def token_kinds(spark, sf_dir):
    """Kinds of all tokens of the texts."""
    t = spread(table(spark, sf_dir, "documents").select("text")).where("text is not null").select(F.explode(F.split(F.regexp_replace("text", "[\\t\\n\\f\\r ]+", " "), " ")).alias("t"))
    return t.select(Q.bare_token(F.col("t")).alias("t")).where("t <> ''").groupBy(Q.token_kind(F.col("t")).alias("kind")).agg(F.count("*").alias("n"))


@query(r"""select kind, value, count(*) as n from (select case when v like '"%"' and length(v) > 1 then 'PHRASE' when v = '(' then 'LPAREN' when v = ')' then 'RPAREN' when upper(v) in ('AND', 'OR', 'NOT') then upper(v) else 'TERM' end as kind, v as value
  from (select unnest(regexp_extract_all(passage, '"[^"]*"|\(|\)|[^\s()]+')) as v from eval_items)) group by 1, 2""")
def query_lexer(spark, sf_dir):
    """Tokens of a lexer of queries, over the passages."""
    v = table(spark, sf_dir, "eval_items").select(F.explode(Q.lexemes(F.col("passage"))).alias("v"))
    return v.groupBy("v.kind", "v.value").agg(F.count("*").alias("n"))


_SCRIPTS = ["Latin", "Cyrillic", "Greek", "Han", "Arabic", "Hebrew"]
_COUNTS = ", ".join(rf"length(regexp_replace(text, '[^\p{{{s}}}]', '', 'g')) as c{i}" for i, s in enumerate(_SCRIPTS))
_BEST = "greatest(" + ", ".join(f"c{i}" for i in range(6)) + ")"


@query(f"select lower(coalesce(lang, 'und')) as lang, case when {_BEST} = 0 then 'Unknown' " + " ".join(f"when c{i} = {_BEST} then '{s}'" for i, s in enumerate(_SCRIPTS)) + f" end as script, count(*) as n from (select lang, {_COUNTS} from documents where text is not null) group by 1, 2")
def scripts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(F.lower(F.coalesce("lang", F.lit("und"))).alias("lang"), Q.script(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


def _title_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("title is not null")
    return d.select(F.col("doc_id").alias("query_id"), F.explode(F.array_distinct(F.split(F.lower("title"), "[^a-z]+"))).alias("term")).where("term <> ''")


_TITLE_TERMS = "(select distinct query_id, term from (select doc_id as query_id, unnest(regexp_split_to_array(lower(title), '[^a-z]+')) as term from documents where title is not null) where term <> '')"
_LEARNED = f"""w as materialized (select distinct title as context, term from (select title, unnest(regexp_split_to_array(lower(title), '[^a-z]+')) as term from documents where title is not null) where term <> ''),
  n as (select term, count(*) as n from w group by 1), few as (select context from w group by 1 having count(*) between 2 and 8), p as (select a.term, b.term as synonym, count(*) as common from w a join few using (context) join w b on a.context = b.context and a.term <> b.term group by 1, 2 having count(*) >= 2),
  syn as (select p.term, synonym, round(common / (n.n + m.n - common), 6) as confidence from p join n on p.term = n.term join n m on p.synonym = m.term where round(common / (n.n + m.n - common), 6) >= 0.45)"""


@query(f"""with {_LEARNED}, r as (select query_id, t.term, synonym, confidence, row_number() over (partition by query_id, t.term order by confidence desc, synonym) as n from {_TITLE_TERMS} t join syn on t.term = syn.term)
  select query_id, term, synonym, confidence from (select *, row_number() over (partition by query_id order by confidence desc, synonym, term) as m from r where n <= 8) where m <= 128""")
def synonym_expansion(spark, sf_dir):
    """Terms of titles with those that stand in the same titles: a vocabulary learned from the corpus."""
    sets = table(spark, sf_dir, "documents").where("title is not null").select(F.col("title").alias("context"), F.explode(F.array_distinct(F.split(F.lower("title"), "[^a-z]+"))).alias("term")).where("term <> ''")
    return Q.expand(_title_terms(spark, sf_dir), Q.learned_synonyms(sets))


_SECTION = "split_part(source, '.', 1)"


@query(f"""with v as (select term, intent, round(count(*) / sum(count(*)) over (partition by term), 6) as weight from {_TITLE_TERMS} t join (select doc_id as query_id, {_SECTION} as intent from documents where source is not null) using (query_id) group by 1, 2)
  select * from (select query_id, intent, round(sum(weight), 6) as score, row_number() over (partition by query_id order by round(sum(weight), 6) desc, intent desc) as rank from {_TITLE_TERMS} t join v on t.term = v.term group by 1, 2) where rank <= 6""")
def intent_scores(spark, sf_dir):
    """Intents of titles: kinds of sites, weighted by how often each term stands in titles of theirs."""
    terms = _title_terms(spark, sf_dir)
    kinds = table(spark, sf_dir, "documents").where("source is not null").select(F.col("doc_id").alias("query_id"), F.substring_index("source", ".", 1).alias("intent"))
    return Q.intents(terms, Q.learned_intents(terms.join(kinds, "query_id")))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_windows(spark, sf_dir):
    """Hourly counts of a stream of events, kept up to date batch by batch."""
    e = flows.stream_of(spark, sf_dir, "events")
    e = flows.windowed(e.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), "ts", "1 hour", ["event_type"], "value", late="1 day")
    return flows.upserts(e, ["start", "event_type"], "windows").withColumn("total", F.round("total", 4))


@query("""select user_id, min(ts) as start, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as fresh from events)) group by user_id, s""")
def sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return flows.sessions(e, "ts", "30 minutes", ["user_id"])


@query("select event_id, user_id from events")
def stream_dedup(spark, sf_dir):
    """Events that are delivered twice, once each; a key is remembered for an hour of event time."""
    e = flows.stream_of(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return flows.append(flows.dedup(e.unionByName(e), ["event_id"], "ts", "1 hour"), "dedup").select("event_id", "user_id")


@query(SEARCH_SQL["posting_stats"])
def stream_index(spark, sf_dir):
    """Statistics of an index built by a stream: each batch is a segment, and many segments are merged."""
    path = scratch(spark, "index")
    docs = flows.stream_of(spark, sf_dir, "documents", maxFilesPerTrigger="4")
    flows.index_segments(docs, lambda b, n: index.maintain(index.add_segment(spark, path, spread(b), FIELDS, n)), scratch(spark, "index-state"))
    p = index.Index.open(spark, path).postings()
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("positions"), F.round(F.avg("tf"), 6).alias("average"))
