"""Search queries over ``documents``, with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.query import parse
from tidemark.functions.text import ascii_words, tokens
from tidemark.operators import index, ranking, search
from tidemark.session import files_of, materialize, scratch, session_dir
from tidemark.sources.tables import spread, table

QUERY = "crawl budget"
NOW = 1_767_225_600.0
FIELDS = (("title", "title"), ("url", "url"), ("domain", "source"), ("body", "text"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").drop("n_chars"))
    return d.withColumn("crawled", F.unix_micros("crawled_at") / 1e6)


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a text with a smaller id, exact or but for white space, and texts that are there at all. Only hashes are
    shuffled; owners are a row a text."""
    text = F.col("text")
    bare = F.trim(F.regexp_replace(text, r"\s+", " "))
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.cast("binary"), 256).alias("exact"), F.sha2(bare.cast("binary"), 256).alias("possible"), F.coalesce(text.rlike(r"\S"), F.lit(False)).alias("active"))
    d = materialize(d, "hashes")
    for kind in ("exact", "possible"):
        owners = d.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.min("doc_id").alias(f"{kind}_owner"))
        d = d.join(owners, kind, "left")
    return d.select("doc_id", *[F.coalesce(F.col("doc_id") > F.col(f"{k}_owner"), F.lit(False)).alias(f"{k}_duplicate") for k in ("exact", "possible")], "active")


_opened: dict[str, index.Index] = {}


def _place(spark: SparkSession, sf_dir: str) -> str:
    """Where the index of these documents stands: another one for other files."""
    state = repr((sf_dir, files_of(spark, f"{sf_dir}/documents.parquet")))
    return f"{session_dir(spark)}/index-{hashlib.sha256(state.encode()).hexdigest()[:16]}"


def _index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of all documents; built where this application hasn't built it yet."""
    path = _place(spark, sf_dir)
    if path not in _opened:
        _opened[path] = index.Index.open(spark, path)
        if not _opened[path].segments:
            _opened[path] = index.add_segment(spark, path, _documents(spark, sf_dir), FIELDS, 0, flags=_flags(spark, sf_dir))
    return _opened[path]


def index_build(spark, sf_dir):
    """Builds the index of all documents, anew, and gives its manifest."""
    path = _place(spark, sf_dir)
    made = _opened[path] = index.add_segment(spark, path, _documents(spark, sf_dir), FIELDS, 0, flags=_flags(spark, sf_dir))
    return spark.createDataFrame([(r.documents, r.with_tokens, r.tokens, r.postings) for r in made.segments], "documents long, with_tokens long, tokens long, postings long")


def index_verify(spark, sf_dir):
    """Segments read back and held against their checksums."""
    return index.verify(_index(spark, sf_dir)).select("segment_id", "version", "healthy")


def index_merge(spark, sf_dir):
    """Twelve segments by crawl time, some documents again in a later one with their title only; merged, then counted."""
    path = scratch(spark, "index")
    d = _documents(spark, sf_dir).withColumn("part", F.pmod(F.floor(F.col("crawled") / 86400), F.lit(11)))
    for k in range(11):
        made = index.add_segment(spark, path, d.where(F.col("part") == k), FIELDS, k, buckets=4)
    made = index.add_segment(spark, path, d.where("doc_id % 10 = 3").withColumn("text", F.lit(None).cast("string")), FIELDS, 11, buckets=4)
    made = index.maintain(made)
    return made.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("positions"), F.lit(len(made.segments)).alias("segments"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.token_rows(_documents(spark, sf_dir), FIELDS)


def tokenize_positions(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy("doc_id", "field").agg(F.count("*").alias("tokens"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("term").alias("least_term"))


def postings(spark, sf_dir):
    return index.postings(_tokens(spark, sf_dir)).select("term", "doc_id", "tf", F.array_join("positions", ",").alias("positions"))


def posting_stats(spark, sf_dir):
    return index.posting_stats(_tokens(spark, sf_dir)).select("term", "df", "positions", F.round("average", 6).alias("average"))


def document_stats(spark, sf_dir):
    return index.doc_stats(_tokens(spark, sf_dir))


def corpus_totals(spark, sf_dir):
    """Totals from the stored index."""
    made = _index(spark, sf_dir)
    vocabulary = made._table("terms").agg(F.count("*").alias("vocabulary"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
    return vocabulary.select(F.lit(made.docs).cast("long").alias("documents"), F.round(F.lit(made.average_length), 6).alias("average_length"), "vocabulary", "postings")


def active_postings(spark, sf_dir):
    """Frequencies of terms over the postings of active documents."""
    made = _index(spark, sf_dir)
    live = index.active(made.postings(), made.documents().where("active"))
    return live.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("positions"))


def _found(spark, sf_dir, mode="or"):
    terms = search.query_terms(QUERY)
    return search.candidates(_index(spark, sf_dir), terms, mode), terms


def _retrieved(spark, sf_dir, mode):
    found, terms = _found(spark, sf_dir, mode)
    return found.select("doc_id", "length", F.array_join(search.matched_terms(terms), " ").alias("matched_terms"))


def retrieve_or(spark, sf_dir):
    return _retrieved(spark, sf_dir, "or")


def retrieve_and(spark, sf_dir):
    return _retrieved(spark, sf_dir, "and")


def search_bm25_or(spark, sf_dir):
    return search.search(_index(spark, sf_dir), QUERY)


def search_bm25_and(spark, sf_dir):
    return search.search(_index(spark, sf_dir), QUERY, mode="and")


def search_full(spark, sf_dir):
    return search.search(_index(spark, sf_dir), QUERY, profile="full", now=NOW, k=20)


SYNTAX = '"crawl budget" site:news NOT mirror'


def search_syntax(spark, sf_dir):
    """A query with a phrase, a field and an exclusion."""
    return search.search(_index(spark, sf_dir), parse(SYNTAX), k=20)


def selectivity_order(spark, sf_dir):
    """Terms of a query in the order in which their postings are looked up."""
    terms = search.query_terms("the crawl budget of nowhere")
    known = _index(spark, sf_dir).frequencies(terms)
    return spark.createDataFrame([(n, t, known.get(t, 0)) for n, t in enumerate(search.selectivity(known, terms), 1)], "place int, term string, df long")


def proximity_span(spark, sf_dir):
    found, terms = _found(spark, sf_dir)
    return found.select("doc_id", F.round(ranking.proximity([F.col(f"positions{i}") for i in range(len(terms))]), 6).alias("proximity")).where("proximity > 0")


def proximity_gap(spark, sf_dir):
    found, _ = _found(spark, sf_dir)
    return found.select("doc_id", F.round(ranking.gap_proximity(F.col("positions0")), 6).alias("proximity")).where("proximity > 0")


def proximity_adjacent(spark, sf_dir):
    """Neighbouring body tokens that both stand in the query."""
    terms = search.query_terms(QUERY)
    arrays = _documents(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("t"))
    pairs = F.arrays_zip(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))).alias("a"), F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))).alias("b"))
    n = F.size(F.filter(pairs, lambda p: p["a"].isin(*terms) & p["b"].isin(*terms)))
    return arrays.select("doc_id", n.alias("pairs")).where("pairs > 0")


def document_signals(spark, sf_dir):
    """Signals of documents as the index stores them."""
    d = _index(spark, sf_dir).documents()
    return d.select("doc_id", *[F.round(c, 6).alias(c) for c in ("quality", "spam", "trust", "duplicate")], F.round(ranking.freshness(F.col("crawled"), NOW), 6).alias("freshness"), "active")


def word_counts(spark, sf_dir):
    """ASCII words of each language, by frequency of use."""
    d = _documents(spark, sf_dir).select("lang", F.explode(ascii_words(F.col("text"))).alias("word"))
    return d.groupBy("lang", "word").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        index_build, index_verify, index_merge, tokenize_positions, postings, posting_stats, document_stats, corpus_totals, active_postings, retrieve_or, retrieve_and, search_bm25_or,
        search_bm25_and, search_full, search_syntax, selectivity_order, proximity_span, proximity_gap, proximity_adjacent, document_signals, word_counts,
    )
}


def _changed() -> tuple[str, str, list[str]]:
    """Characters that folding makes one other or several: from, to, and "from + to" of the others."""
    one, other, several = [], [], []
    for n in [*range(0x41, 0x3000), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF)]:
        c = chr(n)
        if unicodedata.category(c) in ("Cs", "Cn"):
            continue
        f = unicodedata.normalize("NFKC", c).casefold()
        if f != c and unicodedata.normalize("NFC", c) == c:
            if len(f) == 1:
                one.append(c)
                other.append(f)
            else:
                several.append(c + f)
    return "".join(one), "".join(other), several


_ONE, _OTHER, _SEVERAL = _changed()
_OTHER = _OTHER.replace("'", "''")
_LIST = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _SEVERAL) + "]"


def fold_sql(c: str) -> str:
    wide = f"list_reduce(list_prepend(translate(nfc_normalize({c}), '{_ONE}', '{_OTHER}'), {_LIST}), lambda a, p: replace(a, left(p, 1), substr(p, 2)))"
    return f"case when {c} is null then '' when strlen({c}) = length({c}) then lower({c}) else {wide} end"


_TOKEN = r"'[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*'"


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all({fold_sql(c)}, {_TOKEN})"


_NAMES = [f for f, _ in FIELDS]
#: Folded texts, and the tokens of each field, once for all that follows.
_ND = "nd as materialized (select doc_id, crawled_at, " + ", ".join(f"{fold_sql(c)} as {f}" for f, c in FIELDS) + " from documents), td as materialized (select *, " + ", ".join(f"regexp_extract_all({f}, {_TOKEN}) as t_{f}" for f in _NAMES) + " from nd)"
_ENDS = ["0"]
for _f in _NAMES:
    _ENDS.append(f"{_ENDS[-1]} + len(t_{_f})")
_ROWS = f"""{_ND},
  rows as (select doc_id, pos, t[pos + 1] as term, {"case " + " ".join(f"when pos < e{i + 1} then '{f}'" for i, f in enumerate(_NAMES)) + " end"} as field from (
    select *, unnest(range(len(t))) as pos from (select doc_id, {" || ".join(f"t_{f}" for f in _NAMES)} as t, {", ".join(f"{e} as e{i}" for i, e in enumerate(_ENDS) if i)} from td)))
"""
_TERMS = search.query_terms(QUERY)
_IN = "(" + ", ".join(f"'{t}'" for t in _TERMS) + ")"
_N = len(_TERMS)
_FOUND = f"""
  {_ROWS},
  lens as (select doc_id, count(*) as length from rows group by 1),
  tfs as (select doc_id, term, count(*) as tf from rows where term in {_IN} group by 1, 2),
  stats as (select count(*) as docs, avg(length) as avg_length from lens),
  dfs as (select term, count(*) as df from tfs group by 1),
  scored as (select doc_id, count(*) as matched, any_value(length) as length, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) as bm25,
    string_agg(term, ' ' order by list_position([{", ".join(f"'{t}'" for t in _TERMS)}], term)) as matched_terms
    from tfs join dfs using (term) join lens using (doc_id) cross join stats group by doc_id)
"""
_TOP = "row_number() over (order by score desc, matched desc, doc_id) as rank"
_ASCII = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_U = "lower(trim(coalesce(url, '')))"
_BARE = r"trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')"
_SIGNALS = f"""
  select doc_id, case when n > 0 then 1 else 0 end * least(0.2, 0.2 * len(list_distinct(w)) / greatest(n, 1)) + case when length(trim(coalesce(title, ''))) > 0 then 0.2 else 0 end
      + case when n >= 20 then 0.2 else 0 end + case when n >= 100 then 0.15 else 0 end + case when n >= 300 then 0.15 else 0 end + case when n >= 800 then 0.1 else 0 end as quality,
    case when n = 0 then 0 else least(1, case when top >= 0.4 then 0.65 when top >= 0.25 then 0.35 else 0 end + case when n >= 12 and top >= 0.25 then 0.15 else 0 end
      + case when regexp_matches({_U}, 'casino|betting|viagra|payday-loan') then 0.1 else 0 end + case when len(regexp_split_to_array(trim(coalesce(title, '')), '\\s+')) > 25 then 0.1 else 0 end) end as spam,
    0.45 + case when starts_with({_U}, 'https://') then 0.2 else 0 end + case when length(coalesce(title, '')) > 0 then 0.1 else 0 end + case when n >= 100 then 0.1 else 0 end
      + case when {_U} <> '' then 0.05 else 0 end - case when not contains({_U}, '://') or contains({_U}, ' ') then 0.2 else 0 end as trust,
    coalesce(power(0.5, greatest(0, {NOW} - epoch_us(crawled_at) / 1e6) / 2592000), 0.5) as freshness,
    case when text is null then 0 when doc_id > min(doc_id) over (partition by text) then 1 when doc_id > min(doc_id) over (partition by {_BARE}) then 0.45 else 0 end as duplicate, coalesce(regexp_matches(text, '\\S'), false) as active
  from (select *, {_ASCII} as w, len({_ASCII}) as n, coalesce(list_max(map_values(list_histogram({_ASCII}))) / greatest(len({_ASCII}), 1), 0) as top from documents)
"""
_SIGNALS = _SIGNALS.replace("list_histogram(", "list_aggregate(").replace(f"list_aggregate({_ASCII})", f"list_aggregate({_ASCII}, 'histogram')")


def _hits(c: str) -> str:
    return "(" + " + ".join(f"list_contains(t_{c}, '{t}')::int" for t in _TERMS) + ")"


def _share(c: str) -> str:
    return "(" + " + ".join(f"contains({c}, '{t}')::int" for t in _TERMS) + f") / {_N}.0"


_SCORE = "ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))"
_MERGED = f"""{_ROWS}, live as (select doc_id, term, count(*) as tf from rows where not (doc_id % 10 = 3 and field = 'body') and exists (select 1 from documents d where d.doc_id = rows.doc_id and d.crawled_at is not null or rows.doc_id % 10 = 3) group by 1, 2)"""
SQL = {
    "index_build": f"with {_ROWS} select (select count(*) from documents) as documents, count(distinct doc_id) as with_tokens, count(*) as tokens, (select count(*) from (select distinct term, doc_id from rows)) as postings from rows",
    "index_verify": "select 0::bigint as segment_id, 1 as version, true as healthy",
    "index_merge": f"with {_MERGED} select term, count(*) as df, sum(tf)::bigint as positions, 1 as segments from live group by 1",
    "active_postings": f"with {_ROWS} select term, count(*) as df, sum(tf)::bigint as positions from (select term, doc_id, count(*) as tf from rows join documents using (doc_id) where regexp_matches(text, '\\S') group by 1, 2) group by 1",
    "selectivity_order": f"with {_ROWS}, q as (select unnest(range(1, 6)) as n, unnest(['the', 'crawl', 'budget', 'of', 'nowhere']) as term) select row_number() over (order by df, n)::int as place, term, df from (select n, q.term, count(distinct doc_id) as df from q left join rows using (term) group by 1, 2)",
    "search_syntax": f"""with {_ROWS}, p as (select distinct a.doc_id from rows a join rows b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'crawl' and b.term = 'budget'), s as (select distinct doc_id from rows where field = 'domain' and term = 'news'),
      lens as (select doc_id, count(*) as length from rows group by 1), stats as (select count(*) as docs, avg(length) as avg_length from lens), tfs as (select doc_id, term, count(*) as tf from rows where term in ('crawl', 'budget', 'news') group by 1, 2),
      dfs as (select term, count(*) as df from tfs group by 1), scored as (select doc_id, count(*)::int as matched, round(sum({_SCORE}), 6) as score from tfs join dfs using (term) join lens using (doc_id) cross join stats group by 1)
      select *, row_number() over (order by score desc, matched desc, doc_id)::int as rank from scored where doc_id in (from p) and doc_id in (from s) and doc_id not in (select doc_id from rows where term = 'mirror') order by rank limit 20""",
    "tokenize_positions": f"with {_ROWS} select doc_id, field, count(*) as tokens, min(pos) as first_pos, max(pos) as last_pos, min(term) as least_term from rows group by 1, 2",
    "postings": f"with {_ROWS} select term, doc_id, count(*) as tf, string_agg(pos::varchar, ',' order by pos) as positions from rows group by 1, 2",
    "posting_stats": f"with {_ROWS} select term, count(*) as df, sum(tf)::bigint as positions, round(avg(tf), 6) as average from (select term, doc_id, count(*) as tf from rows group by 1, 2) group by 1",
    "document_stats": f"with {_ROWS} select doc_id, count(*) as length, count(distinct term) as terms from rows group by 1",
    "corpus_totals": f"with {_ROWS} select count(distinct doc_id) as documents, round(count(*) / count(distinct doc_id), 6) as average_length, count(distinct term) as vocabulary, (select count(*) from (select distinct term, doc_id from rows)) as postings from rows",
    "retrieve_or": f"with {_FOUND} select doc_id, length, matched_terms from scored",
    "retrieve_and": f"with {_FOUND} select doc_id, length, matched_terms from scored where matched = {_N}",
    "search_bm25_or": f"with {_FOUND} select *, {_TOP} from (select doc_id, round(bm25, 6) as score, matched from scored) order by rank limit 10",
    "search_bm25_and": f"with {_FOUND} select *, {_TOP} from (select doc_id, round(bm25, 6) as score, matched from scored where matched = {_N}) order by rank limit 10",
    "proximity_span": f"""with {_ROWS}, q as (select doc_id, term, pos from rows where term in {_IN}),
      spans as (select a.doc_id, min(abs(a.pos - b.pos)) as span from q a join q b on a.doc_id = b.doc_id and a.term < b.term group by 1) select doc_id, round(1 / (1 + span), 6) as proximity from spans""",
    "proximity_gap": f"""with {_ROWS}, q as (select doc_id, pos, pos - lag(pos) over (partition by doc_id order by pos) as gap from rows where term = '{_TERMS[0]}')
      select doc_id, round(1 / (1 + avg(gap)), 6) as proximity from q group by 1 having count(gap) > 0""",
    "proximity_adjacent": f"""with {_ND}, b as (select doc_id, t_body as t from td), w as (select doc_id, pos, t[pos] as a, t[pos + 1] as b from (select doc_id, t, unnest(range(1, len(t))) as pos from b))
      select doc_id, count(*) as pairs from w where a in {_IN} and b in {_IN} group by 1""",
    "document_signals": f"select doc_id, round(quality, 6) as quality, round(spam, 6) as spam, round(trust, 6) as trust, round(freshness, 6) as freshness, duplicate, active from ({_SIGNALS})",
    "word_counts": f"select lang, word, count(*) as n from (select lang, unnest({_ASCII}) as word from documents) group by 1, 2",
    "search_full": f"""with {_FOUND},
      q as (select doc_id, term, pos from rows where term in {_IN}),
      spans as (select a.doc_id, min(abs(a.pos - b.pos)) as span from q a join q b on a.doc_id = b.doc_id and a.term < b.term group by 1),
      texts as (select doc_id, case when active then 1 + 0.1 * freshness + 0.1 * quality + 0.05 * trust - 0.2 * spam - 0.15 * duplicate else 0 end as signals from ({_SIGNALS})),
      parts as (select doc_id, case when title = '{QUERY}' then 8 when {_hits("title")} = {_N} then 5 when {_hits("url")} = {_N} or contains(url, '{QUERY}') then 4 when {_hits("title")} > 0 then 2.5
          when {_hits("url")} > 0 then 2 when {_hits("domain")} = {_N} then 4 when {_hits("domain")} > 0 then 2 when {_hits("body")} > 0 then 1 else 0.25 end as factor,
        case when trim(title) = '{QUERY}' then 5 when contains(title, '{QUERY}') then 1.5 else 0 end as exact, 3 * {_share("title")} as in_title, 1.5 * {_share("url")} as in_url,
        {_hits("title")} + {_hits("url")} + {_hits("domain")} > 0 as strong from td)
      select *, {_TOP} from (select doc_id, round((bm25 + matched / {_N}.0 + coalesce(1 / (1 + span), 0) + 8 * exact + 4 * in_title + 3 * in_url) * signals * factor, 6) as score, matched
        from scored join texts using (doc_id) join parts using (doc_id) left join spans using (doc_id) where matched >= {(_N + 1) // 2} or strong) order by rank limit 20""",
}
