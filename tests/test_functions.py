import pytest
from pyspark.sql import functions as F

from tidemark.functions import query as Q
from tidemark.functions import text as T
from tidemark.functions import udfs
from tidemark.functions import url as U
from tidemark.operators import frontier, present, signals
from tidemark.sources import web


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_clean_host(spark):
    for raw, want in ((" A.b. ", "a.b"), ("\tx.Y\n", "x.y"), ("", None), ("  ", None), (".", None), (None, None), ("ß.É", "ß.é")):
        assert one(spark, T.clean_host(F.lit(raw).cast("string"))) == want


def test_words(spark):
    assert one(spark, T.words_text(F.lit("Ein—Maß_2: Ça va?\nЖ"))) == "ein maß 2 ça va ж"
    assert one(spark, T.day_of(F.lit(0.0))) == "1970-01-01" and one(spark, T.day_of(F.lit(None).cast("double"))) is None


@pytest.mark.parametrize(
    "raw,want",
    [
        ("HTTP://Ex.com:80/a/../b/?utm_source=x&b=2&a=1#f", "http://ex.com/b?a=1&b=2"),
        ("https://ex.com.:443", "https://ex.com/"),
        ("https://ex.com:8443/%7Ea/./b//c", "https://ex.com:8443/~a/b/c"),
        ("http://bücher.example/?x", "http://xn--bcher-kva.example/?x="),
        ("ftp://ex.com", None),
        ("http://", None),
        ("http://a:b:c/", None),
        (None, None),
        ("", None),
    ],
)
def test_url_normalize(spark, raw, want):
    assert udfs.canonical_url(raw) == want
    assert spark.createDataFrame([(raw,)], "u string").select(udfs.url_normalize("u")).first()[0] == want


def test_url_parts(spark):
    u = F.lit(" HTTPS://user:pw@Ex.Com:8080/a/b?x=1&&y#z")
    assert one(spark, U.host(u)) == "ex.com" and one(spark, U.scheme(u)) == "https" and one(spark, U.path(u)) == "/a/b"
    assert one(spark, U.parameters(u)) == ["x=1", "y"]
    assert one(spark, U.is_valid(u)) and not one(spark, U.is_valid(F.lit("mailto:a@b")))
    assert one(spark, U.is_host(F.lit("a-b.example"))) and not one(spark, U.is_host(F.lit("-a.example"))) and not one(spark, U.is_host(F.lit("localhost")))


def test_crawl_space(spark):
    for url, want in (("http://a.b/", 100), ("http://a.b/x.JPG?y=1", 0), ("http://a.b/page/3?sort=a&q=b", 100 - 6 - 14 - 30), ("http://a.b/1/2/3", 92), ("http://a.b/x1/x2/x3/y/z", 85)):
        assert one(spark, U.crawl_space(F.lit(url))) == want


def test_html_page(spark):
    html = "<html><head><title> T&amp;x </title><link rel=canonical href='/c#f'><script>no</script></head><body><nav>menu <a href='/n'>nav</a></nav><main>Hello <br><h1>Big</h1><a href='p?q#r'>Go</a></main><footer>end</footer><a href='mailto:x'>m</a></body>"
    r = web.pages(spark.createDataFrame([("http://e.x/d/", html, 1), ("http://e.x/", None, 1)], "url string, html string, n int")).collect()
    assert r[0].title == "T&x" and r[0].canonical == "http://e.x/c" and r[0].main == "Hello Big Go" and r[0].headings == "Big"
    assert r[0].navigation == "menu nav" and r[0].footer == "end" and r[0].links == ["http://e.x/n", "http://e.x/d/p?q"]
    assert "no" not in r[0].text.split() and r[1].text == "" and r[1].links == []


def test_web_sources(spark):
    xml = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://a/1 </loc></url><url><loc>http://a/2</loc></url></urlset>'
    assert sorted(tuple(r) for r in web.sitemap_locations(spark.createDataFrame([(xml,)], "xml string")).collect()) == [("url", "http://a/1"), ("url", "http://a/2")]
    feed = "<rss><channel><link>/x#y</link><item><link>http://b/2</link></item></channel></rss>"
    assert sorted(r.link for r in web.feed_links(spark.createDataFrame([("http://a/", feed)], "url string, xml string")).collect()) == ["http://a/x", "http://b/2"]
    page = '<link rel="alternate" type="application/rss+xml" href="/feed">'
    assert [r.link for r in web.feed_endpoints(spark.createDataFrame([("http://a/p", page)], "url string, html string")).collect()] == ["http://a/feed"]
    logs = '[{"name_value":"*.A.example\\nb.example","common_name":"a.example"},{"name_value":null}]'
    assert sorted(r.hostname for r in web.certificate_names(spark.createDataFrame([(logs,), ("broken",)], "json string")).collect()) == ["a.example", "b.example"]
    a, b = (spark.createDataFrame(x, "k string, v int") for x in ([("x", 1)], [("x", 2), ("y", 3)]))
    assert sorted((r.k, r.v, r.source) for r in web.federated({"a": a, "b": b}, "k", ["k", "v"]).collect()) == [("x", 1, "a"), ("y", 3, "b")]


def test_objects_by_prefix(spark, tmp_path):
    for name in ("a/1", "a/2", "b/1"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"xy")
    assert [(r.key, r.length) for r in web.objects(spark, str(tmp_path), "a/").collect()] == [("a/1", 2), ("a/2", 2)]


def test_query_parse():
    q = Q.parse('Crawl "Search Engine" AND (re-use OR crawl) NOT site:Ex.com "search engine"')
    assert q.terms == ["crawl", "re-use"] and q.phrases == [["search", "engine"]] and q.operators == ["AND", "OR", "NOT"] and q.fields == [("domain", "ex.com")]
    assert Q.parse("a NOT B-c d").excluded == ["b-c"] and Q.parse("a NOT B-c d").terms == ["a", "d"]
    assert [k for k, _ in Q.lex("(a)")] == ["LPAREN", "TERM", "RPAREN"] and Q.parse("").terms == []


def test_query_columns(spark):
    kinds = {"http://a.b": "URL", "a@b.c": "EMAIL", "15": "NUMBER", "1,5": "SYMBOL", "and": "OPERATOR", "re-use": "SYMBOL", "x1": "TERM"}
    for t, want in kinds.items():
        assert one(spark, Q.token_kind(F.lit(t))) == want
    assert one(spark, Q.bare_token(F.lit("(word)!,"))) == "word"
    for t, want in (("How does it work", "explanation"), ("how many", "method"), ("Is it so?", "question"), ("", "unknown"), ("It is.", "statement")):
        assert one(spark, Q.question_kind(F.lit(t))) == want
    assert one(spark, Q.script(F.lit("abc где")) ) == "Latin" and one(spark, Q.script(F.lit("12"))) == "Unknown" and one(spark, Q.script(F.lit("где a"))) == "Cyrillic"
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("x"), F.lit("y"))
    assert one(spark, Q.fingerprint(a)) == one(spark, Q.fingerprint(b))


def test_snippet_and_highlight(spark):
    text = "x " * 200 + "Crawl here " + "y " * 200
    s = one(spark, present.snippet(F.lit(text), ["crawl", "zzz"]))
    assert s.startswith("… x") and s.endswith("y …") and "Crawl here" in s and len(s) <= 184
    assert one(spark, present.snippet(F.lit("a  b\nc"), ["zzz"])) == "a b c" and one(spark, present.snippet(F.lit(None).cast("string"), ["a"])) == ""
    df = spark.createDataFrame([("The Searcher searches", ["search", "searcher"]), (None, ["a"]), ("x", None)], "t string, w array<string>")
    assert [r[0] for r in df.select(udfs.highlight("t", "w")).collect()] == ["The [Searcher] [search]es", "", "x"]


def test_facts_and_sentences(spark):
    df = spark.createDataFrame([(1, "Rome is located in Italy. A crawler is a program!  Nodes are small? Plain text"), (2, None)], "id int, t string")
    s = present.sentences(df, "id", "t")
    assert [r.sentence for r in s.orderBy("n").collect()] == ["Rome is located in Italy.", "A crawler is a program!", "Nodes are small?", "Plain text"]
    f = [[tuple(x)[:3] for x in r.f] for r in s.orderBy("n").select(present.facts(F.col("sentence")).alias("f")).collect()]
    assert f == [[("Rome", "located in", "Italy")], [("A crawler", "definition", "program")], [("Nodes", "definition", "small")], []]


def test_a_sentence_that_defines_and_relates(spark):
    facts = lambda t: [tuple(x)[:3] for x in one(spark, present.facts(F.lit(t)))]
    assert facts("Spark is the engine that uses shuffle.") == [("Spark", "definition", "engine that uses shuffle"), ("Spark is the engine that", "uses", "shuffle")]
    assert facts("; Rome, is part of Italy ,!") == [("Rome", "part of", "Italy")]
    assert facts(f"A is a {'long ' * 41}one.") == [] and facts("") == [] and one(spark, present.facts(F.lit(None).cast("string"))) == []


def test_entities(spark):
    runs = lambda t: one(spark, present.entities(F.lit(t)))
    assert runs('Who met "Ada Lovelace" and ada LOVELACE, or Élise (Paris)?') == ["Who", "Ada Lovelace", "LOVELACE", "Élise Paris"]
    assert runs("") == [] and one(spark, present.entities(F.lit(None).cast("string"))) == []


def test_related_and_concepts(spark):
    rows = [(1, "alpha beta gamma", ["a"], "x"), (2, "alpha beta delta", ["a", "b"], "x"), (3, "omega", ["z"], "y"), (4, None, None, None)]
    page = spark.createDataFrame(rows, "doc_id int, text string, matched_terms array<string>, domain string")
    got = {r.doc_id: r.score for r in present.related(page, 1).collect()}
    assert got == {2: pytest.approx(0.6 * 2 / 4 + 0.3 / 2 + 0.1)}
    assert [(r.name, r.sources) for r in present.concepts(page, "text", ["omega"], 2).collect()] == [("omega", 1), ("beta", 2)]
    turns = spark.createDataFrame([("c", i) for i in range(5)] + [("d", 1)], "c string, t int")
    assert sorted((r.c, r.t) for r in present.last_turns(turns, "c", "t", 2).collect()) == [("c", 3), ("c", 4), ("d", 1)]


def test_signals(spark):
    v = [F.lit(0.5), F.lit(None).cast("double"), F.lit(1.0)]
    assert one(spark, signals.weighted_mean(v, [1, 5, 3])) == pytest.approx(3.5 / 4)
    assert one(spark, signals.group_mean_without_zeros([(F.lit(0.0), 9), (F.lit(0.5), 1)])) == 0.5
    for kind, want in (("product", 0.25), ("geometric", 0.5), ("harmonic", 0.5), ("minimum", 0.5), ("maximum", 0.5), ("mean", 0.5)):
        assert one(spark, signals.interaction(kind, [F.lit(0.5), F.lit(0.5)])) == pytest.approx(want)
    assert one(spark, signals.bands(F.lit(0.5), {"high": 0.9, "middle": 0.5}, "low")) == "middle"
    assert one(spark, signals.calibrated(F.lit(0.8), F.lit(0.5))) == pytest.approx(0.6)
    with pytest.raises(ValueError):
        signals.interaction("other", [F.lit(1.0)])


def test_change_states(spark):
    s = lambda status, content, before, seen: one(spark, frontier.change_state(F.lit(status), F.lit(content).cast("string"), F.lit(before).cast("string"), F.lit(seen)))
    assert s(404, None, None, False) == "GONE" and s(304, None, None, False) == "UNKNOWN" and s(304, None, "a", True) == "UNCHANGED"
    assert s(200, "a", "a", True) == "UNCHANGED" and s(200, "b", "a", True) == "CHANGED" and s(200, "b", None, False) == "NEW" and s(200, None, "a", True) == "UNKNOWN"


def test_intervals_and_aging(spark):
    f = lambda *a: one(spark, frontier.adaptive_interval(*map(F.lit, a)))
    assert f(86400.0, True, 0, 100.0) == 43200 and f(86400.0, False, 2, 100.0) == pytest.approx(86400 * 1.35 * 4) and f(1.0, True, 0, 1.0) == 3600
    a = lambda at: one(spark, frontier.aging_bonus(F.lit(at), 1000.0, 100.0, 5.0, 20.0))
    assert a(1000.0) == 0 and a(900.0) == 5 and a(500.0) == 20
